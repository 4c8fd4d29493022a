"""Mixing sources to target weights by a low-discrepancy schedule, in SQL functions only.

The golden-ratio sequence u(i) = frac((i + 1/2) / phi) is mapped through the cumulative target shares: slot i of the
schedule belongs to the source whose interval holds u(i), so every stretch of the schedule has nearly the target
shares. The k-th slot of a source takes the k-th block of its stream: its documents in hashed order, laid end to end,
and repeated from the start when they run out. All blocks have the same number of words, but the stream ends where the
source's target is reached: slots behind that stay empty, and the last slot of a source holds all that is left then.
The mix is the slots in order, so where a document's words stand in it follows from the schedule alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import read, word_count, written

#: frac(1 / golden ratio).
STEP = 0.6180339887498949
_CHUNK, _CELLS = 4096, 1024


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources; ``sizes`` has source and source_size, a row for each source.

    Weights go to the sources in code-point order (null last), repeating. The targets share ``budget`` times all sizes
    by weight; where one would exceed ``most`` times its source's size it stops there and the rest is shared again
    among the others. That fixed point needs no rounds: with sources in the order of cap/weight, a source is capped
    just when giving all those behind it the same level would use the budget up.
    The table has one row per source, so its windows are as small as the list of sources.
    """
    share = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(share, F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(behind))
    every = Window.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(every) * float(budget))
    ranked = ranked.withColumn("full", F.col("used") + F.col("level") * F.col("open") <= F.col("total"))
    ranked = ranked.withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0)))
    ranked = ranked.withColumn("left", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), (F.col("total") - F.col("spent")) / F.col("left") * F.col("weight")))
    ranked = ranked.withColumn("target", target)
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("high", F.sum("target").over(upto)).withColumn("goal", F.sum("target").over(every))
    low = F.lag("high", 1, 0.0).over(Window.orderBy("sid"))
    last = F.col("sid") == F.max("sid").over(every)
    ranked = ranked.withColumn("low", F.when(F.col("goal") > 0, low / F.col("goal")).otherwise(0.0))
    ranked = ranked.withColumn("high", F.when(F.col("goal") > 0, F.when(last, 1.0).otherwise(F.col("high") / F.col("goal"))).otherwise(0.0))
    return ranked.select("source", "source_size", "sid", "weight", "target", "low", "high", "goal")


def schedule(spark: SparkSession, targets: DataFrame, n_slots: int, step: float = STEP) -> DataFrame:
    """(slot, sid, block): which block of which source each slot of the schedule takes.

    Slots find their source by a join on the cell (1/1024 of the unit interval) that point and interval share. The
    rank of a slot among its source's slots is a count per chunk of slots and source, summed over earlier chunks, plus
    its place in the chunk, so a source with most of the slots is no single group.
    """
    point = F.col("i") + 0.5
    slots = spark.range(n_slots).select(F.col("id").alias("i")).select("i", (point * step - F.floor(point * step)).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * _CELLS).cast("int")).withColumn("chunk", F.floor(F.col("i") / _CHUNK))
    live = targets.filter(F.col("high") > F.col("low"))
    cells = F.sequence(F.floor(F.col("low") * _CELLS).cast("int"), F.least(F.floor(F.col("high") * _CELLS), F.lit(_CELLS - 1)).cast("int"))
    spans = live.select("sid", "low", "high", F.explode(cells).alias("cell"))
    owned = slots.join(spans, "cell").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("i", "chunk", "sid")
    per = owned.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("sid", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "chunk").orderBy("i")
    ranked = owned.withColumn("k", F.row_number().over(inside) - 1).join(per, ["sid", "chunk"])
    return ranked.select(F.col("i").alias("slot"), "sid", (F.col("k") + F.col("before")).alias("block"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
    block: int = 1024,
    buckets: int = 1024,
    seed: int = 17,
    step: float = STEP,
) -> DataFrame:
    """For every row of ``docs``: its id, source, size in words, its source's size and target, the words taken, and places.

    places lists where the words taken stand in the mix, in order: slot, offset (in words, inside the slot), words. A
    document's pass through its source's stream has a piece for each block of ``block`` words that it meets, so pieces
    grow with the document alone. A source's words are its target's, rounded; a document's may be taken twice (``most``
    passes at most), in part where the target ends inside it. A source so small that no slot of the schedule is its own
    has one behind the schedule. Null texts have size 0 and nothing is taken of them; a null source is a source of its
    own, the last one. Repeated rows are separate documents. Columns other than the three named are not read. Same
    input, same result.
    """
    spark = docs.sparkSession
    sized = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")), "mix-sizes")
    targets = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most), "mix-targets")
    goal = targets.agg(F.max("goal")).first()[0] or 0.0  # one number
    slots = -int(-goal // block)
    plan = schedule(spark, targets, slots, step)
    ends = targets.join(plan.groupBy("sid").agg((F.max("block")).alias("last")), "sid", "left")
    ends = written(ends.withColumn("last", F.coalesce("last", F.lit(0))).withColumn("whole", F.round("target").cast("long")), "mix-ends")

    spot = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    dealt = sized.join(ends.select(F.col("source").alias("_source"), "sid", "source_size", "target", "last", "whole"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("spot", spot).withColumn("bucket", F.pmod(F.xxhash64(F.col("spot")), F.lit(buckets)))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).select("sid", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("sid", "bucket").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.withColumn("start", F.sum("size").over(inside) - F.col("size")).withColumn("nth", F.row_number().over(inside))
    laid = laid.join(starts, ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("ahead"))

    passes = int(-(-most // 1))
    first = F.col("start") + F.col("pass") * F.col("source_size")
    laid = laid.withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(passes)]))).withColumn("first", first)
    laid = laid.withColumn("stop", F.least(F.col("first") + F.col("size"), "whole"))
    # the last block has no end but the stream's
    met = lambda at: F.least(F.floor(at / block), F.col("last"))
    reach = F.when(F.col("stop") > F.col("first"), F.sequence(met(F.col("first")), met(F.col("stop") - 1)))
    pieces = laid.withColumn("block", F.explode_outer(reach))
    low = F.greatest(F.col("first"), F.col("block") * block)
    high = F.when(F.col("block") < F.col("last"), F.least(F.col("stop"), (F.col("block") + 1) * block)).otherwise(F.col("stop"))
    held = pieces.join(plan, ["sid", "block"], "left").withColumn("slot", F.coalesce("slot", F.lit(slots) + F.col("sid")))
    piece = F.when(F.col("block").isNotNull(), F.struct(F.col("slot").cast("long").alias("slot"), (low - F.col("block") * block).cast("long").alias("offset"), (high - low).cast("long").alias("words")))
    row = ["sid", "bucket", "nth", "start", "doc_id", "source", "size", "source_size", "target"]
    mixed = held.groupBy(*row).agg(F.array_sort(F.collect_list(piece)).alias("places"))
    taken = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return mixed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "places")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 3, 1, 2, repeating, to 150% of all words; slot and offset are where one first stands."""
    first = F.get("places", F.lit(0))
    return mix_sources(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", first["slot"].alias("slot"), first["offset"].alias("offset"), F.size("places").cast("long").alias("pieces")
    )
