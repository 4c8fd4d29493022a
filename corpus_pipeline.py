"""From raw documents to a sharded training mixture: toxicity, near-duplicates, contamination, mixing, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.decontamination import contaminated
from loomspark.llm.mixing import mix_sources
from loomspark.llm.neardup import near_duplicates
from loomspark.llm.sharding import with_shards
from loomspark.llm.tables import free_name, read, written
from loomspark.llm.toxicity import REJECTED_FROM, learnable, toxicity

#: So many ids (16 MB) are broadcast to be left out; more are left out by a shuffled join.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows that have one of the ids; rows with a null id stay."""
    gone = written(ids.select("doc_id").filter("doc_id is not null").distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out every document that scores 0.3 or more. Labels of the ids that are held out are not read."""
    scored = toxicity(docs, learnable(read(spark, sf_dir, "labels")))
    return _without(docs, scored.filter(F.col("score") >= REJECTED_FROM))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near-duplicates (five words, 0.8), the one with the least id.

    Of rows that repeat an id one stays: the one whose text, and then whose whole row, has the least SHA-256, so that
    a task that runs again keeps the same.
    """
    rest = _without(docs, near_duplicates(docs).filter("not kept"))
    rows, ids = docs.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if rows == ids:
        return rest
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.min_by(whole, F.struct(F.sha2("text", 256), F.sha2(F.to_json(whole), 256)))
    one = rest.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(first.alias("_row")).select("_row.*")
    return one.unionByName(rest.filter("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out every document that repeats a benchmark item."""
    return _without(docs, contaminated(docs, read(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes most of it: never, once or twice.

    Weights 3, 1, 2 by source, for 150% of all words. Documents without words have nothing to take and go.
    """
    key, times = free_name(docs, "_mixed_id"), free_name(docs, "_copies")
    mixed = mix_sources(docs).groupBy(F.col("doc_id").alias(key)).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    taken = mixed.filter("size > 0").select(key, F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(times)).filter(F.col(times) > 0)
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(key)))
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard, of 24, by doc_id."""
    return with_shards(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near-duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Stages that fit models, align words or hash as Spark does have no SQL; tests/llm compares each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
