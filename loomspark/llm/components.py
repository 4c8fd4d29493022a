"""Connected components by alternating large and small stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every vertex links neighbours (larger ones, or those not larger) to the least vertex around it."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    linked = around.join(least, around["u"] == least["c"])
    if large:
        moved = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that a link names; component is the least id that can be reached.

    Links may be in any direction, repeated, or from an id to itself (those name no id unless another link does).
    Rounds repeat until a round changes nothing; each round is written to the shared folder. The number of rounds grows
    with the logarithm of a component's diameter, and no vertex's links are gathered in one task. Ids are never null.
    """
    pair = [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    edges = written(links.select(*pair).filter(F.col("u") > F.col("v")).distinct(), "links")
    before = None
    while True:
        after = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))).first()
        if after[0] == 0 or after == before:
            break
        before, old = after, edges
        edges = written(_star(_star(edges, True), False), "links")
        dropped(old)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
