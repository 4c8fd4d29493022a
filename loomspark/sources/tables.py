"""Typed readers, and the library's entities as views over the supplied star-schema tables.

Works are customers, their chapters are orders (status F: done, O: pending, P: error), a chapter's segments are its
lineitems, pages and documents are themselves, and the progress stream is the events table.
"""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "array<struct<type:string,level:int,text:string,src:string,alt:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: dict[str, list] = {}


def _deleted() -> None:
    """Deletes what `remembered` was told, as far as the store can still be reached."""
    for path, store in [x for own in _made.values() for x in own]:
        try:
            store.delete(path, True)
        except Exception as e:  # the session's machine may be gone at the end
            print(f"left behind: {path}: {type(e).__name__}", file=sys.stderr)
            break
    _made.clear()


atexit.register(_deleted)


def remembered(spark: SparkSession, root: str) -> str:
    """A folder of this application below ``root`` for intermediate tables, deleted when the program ends."""
    app = spark.sparkContext.applicationId
    folder = f"{root.rstrip('/')}/loomspark-{app}"
    if folder not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        _made[folder] = [(path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()))]
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all machines share; one of this machine only where Spark runs on it alone.

    It is deleted when the program ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{remembered(spark, root)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df``, made once and read again from a shared folder, for what reads it many times over."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seconds_of(ts: str):
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) / 1e6")


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(story_id, title, site, updated_at, new_chapters)."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("story_id"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("site"),
        F.col("c_acctbal").alias("updated_at"),
        F.when(F.col("c_nationkey") == 3, 2).otherwise(0).alias("new_chapters"),
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(story_id, order, url, title, status, seconds, created)."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    return o.select(
        F.col("o_custkey").alias("story_id"),
        F.col("o_orderkey").alias("order"),
        F.concat(F.lit("https://s/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_orderpriority").alias("title"),
        status.alias("status"),
        F.col("o_totalprice").alias("seconds"),
        F.col("o_orderdate").alias("created"),
    )


def with_defaults(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Forward-only schema evolution: columns that ``df`` lacks are added with their type and default."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (t, v) in defaults.items() if c not in df.columns})


def settings_record(kv: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Key-value rows as one typed record; missing or null values get their defaults. Of repeated keys the last
    counts, by the column ``seq`` where the table has one, else by value.
    """
    seq = F.col("seq") if "seq" in kv.columns else F.col("value")
    found = [F.coalesce(F.max_by(F.col("value"), F.when(F.col("key") == k, seq)), F.lit(v)).alias(k) for k, v in defaults.items()]
    return kv.agg(*found)


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(bytes, files) below a folder, read from the listing alone; zeros where it is missing."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(1).select(F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("files"))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def json_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, one record each; unreadable ones give no row."""
    kept = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(f"{schema}, _corrupt_record string").json(path)
    whole = F.struct(*[F.col(c) for c in kept.columns])  # all columns are read, as the corrupt one alone can't be asked for
    return kept.withColumn("_row", whole).filter(F.col("_row._corrupt_record").isNull()).drop("_row", "_corrupt_record")
