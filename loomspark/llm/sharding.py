"""Rendezvous hashing of stable record keys over weighted shards, in SQL functions only.

Every (key, shard) pair has a hash of its own; a record goes to the shard whose weighted score is best. A further
shard can only win records for itself, so growing from n to n + 1 shards moves about 1/(n + 1) of the records and
none between old shards. No state is kept and nothing is shuffled to place a record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import free_name, read

#: 13 hexadecimal digits make a whole number below 2**52, which a double holds exactly.
_DIGITS, _RANGE = 13, float(1 << 52)


def _draw(key: Column, shard: int) -> Column:
    """The pair's hash, from 0 to 2**52 - 1."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, _DIGITS), 16, 10).cast("long")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) of a string key; shard i gets a share of the keys in proportion to ``weights[i]``.

    With equal weights the largest hash wins, else the largest ln(u)/weight; equal scores go to the smaller shard.
    Shards of weight 0 or less get nothing. A null key is placed as the empty string.
    """
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    key = F.coalesce(key, F.lit(""))
    even = len({w for _, w in live}) == 1
    ranked = [
        F.struct((_draw(key, i) if even else F.log((_draw(key, i) + 0.5) / _RANGE) / w).alias("score"), F.lit(-i).alias("shard"))
        for i, w in live
    ]
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    return (-best["shard"]).cast("int")


def with_shards(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 24, out: str = "shard") -> DataFrame:
    """``df`` with the shard of every row; a column that has the name already is replaced.

    Rows with equal keys share a shard. Null keys all go where the empty string goes. An empty table stays empty.
    """
    return df.withColumn(out, shard_of(F.col(f"`{key}`").cast("string"), weights))


def with_slots(df: DataFrame, shard: str = "shard", order: Sequence[str] = ("doc_id",), out: str = "slot", buckets: int = 4096) -> DataFrame:
    """``df`` with gapless positions from 0 within each shard.

    A shard is cut into ``buckets`` by a hash of the order columns; positions run through the buckets in turn and
    within a bucket in the columns' order. So no task holds a shard: the work is one count per bucket, a running sum
    over those counts (shards x buckets rows, whatever the input), and a sort within buckets. Rows that agree in all
    order columns get neighbouring positions in any order. Null order values come first. Null shards make a group too.
    """
    bucket, before, mine, its = (free_name(df, c) for c in ("_bucket", "_before", "_shard_of", "_bucket_of"))
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in order]), F.lit(buckets)).cast("int"))
    ahead = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(shard, bucket).agg(F.count("*").alias(before))
    starts = counts.select(F.col(shard).alias(mine), F.col(bucket).alias(its), F.coalesce(F.sum(before).over(ahead), F.lit(0)).alias(before))
    inside = Window.partitionBy(shard, bucket).orderBy(*[F.col(f"`{c}`") for c in order])
    ranked = dealt.withColumn(out, F.row_number().over(inside) - 1)
    # shards x buckets rows of 20 bytes: the bound on what is broadcast
    found = ranked.join(F.broadcast(starts), F.col(shard).eqNullSafe(F.col(mine)) & (F.col(bucket) == F.col(its)))
    return found.withColumn(out, (F.col(out) + F.col(before)).cast("long")).drop(mine, its, bucket, before)


def op1_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents in ``shards`` equal shards by doc_id, and where one more shard would put them."""
    key = F.col("doc_id").cast("string")
    sized = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, [1.0] * shards).alias("shard"),
        shard_of(key, [1.0] * (shards + 1)).alias("grown_shard"),
    )
    placed = with_slots(sized, order=("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
