"""Queries that pack ordered items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import split_text
from ..operators import packing as P
from ..sources.tables import table
from .ordered import _SEG, segments
from .registry import query


def _fit(guard: str, weight: str = "q", cap: int = 60) -> str:
    return f"""WITH RECURSIVE {_SEG}, r AS (SELECT k, i, {weight} AS w, CAST({weight} AS DOUBLE) AS total, 0 AS part FROM seg WHERE i = 1
UNION ALL SELECT s.k, s.i, s.{weight}, CASE WHEN {guard} r.total + s.{weight} > {cap} THEN s.{weight} ELSE r.total + s.{weight} END, CASE WHEN {guard} r.total + s.{weight} > {cap} THEN r.part + 1 ELSE r.part END
FROM r JOIN seg s ON s.k = r.k AND s.i = r.i + 1)
SELECT k, i, CAST(part AS BIGINT) AS part FROM r"""


@query("pck01_parts", _fit(""))
def parts(spark, d):
    """PCK-01, PCK-02: next-fit by length."""
    return P.next_fit(segments(spark, d), "k", "i", "q", 60).select("k", "i", "part")


@query("pck01_folded", _fit(""))
def folded(spark, d):
    """PCK-01 as a fold over an order's lineitems."""
    items = F.array_sort(F.collect_list(F.struct(F.col("i").alias("pos"), F.col("q").alias("weight"))))
    got = segments(spark, d).groupBy("k").agg(items.alias("items"))
    each = got.select("k", F.posexplode(P.next_fit_folded(F.col("items"), 60)).alias("n", "part"))
    return each.select("k", (F.col("n") + 1).alias("i"), F.col("part").cast("long").alias("part"))


@query("pck03_windows", f"""WITH RECURSIVE s AS (SELECT conv_id AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) * (turn % 3) AS w FROM conversations),
r AS (SELECT k, i, CAST(w AS DOUBLE) AS total, 0 AS part FROM s WHERE i = 1 UNION ALL SELECT s.k, s.i, CASE WHEN r.total > 0 AND r.total + s.w > 150 THEN s.w ELSE r.total + s.w END, CASE WHEN r.total > 0 AND r.total + s.w > 150 THEN r.part + 1 ELSE r.part END FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)
SELECT k, i, CAST(part AS BIGINT) AS part FROM r""".replace("\\\\", "\\"))
def windows(spark, d):
    """PCK-03: by words, where items without words close nothing."""
    from pyspark.sql.window import Window

    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) * (F.col("turn") % 3)
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("k"), i.alias("i"), words.alias("w"))
    return P.next_fit(s, "k", "i", "w", 150, count_empty=False).select("k", "i", "part")


@query("pck05_split_text")
def split_parts(spark, d):
    """PCK-05: sentences packed up to 250 characters; too long ones cut at a comma or space."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(split_text(F.col("text"))).alias("part", "text"))
    return docs.select("doc_id", "part", "text")


@query("pck08_budget", """WITH w AS (SELECT p_brand AS k, p_partkey AS i, p_name AS t FROM part WHERE length(p_name) BETWEEN 1 AND 100), u AS (SELECT k, i, t, sum(length(t) + 1) OVER (PARTITION BY k ORDER BY i) AS used FROM w)
SELECT k, i, t FROM u WHERE used <= 500""")
def budget(spark, d):
    """PCK-08."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("i"), F.col("p_name").alias("t"))
    return P.budgeted(p, ["k"], "i", "t").select("k", "i", "t")


@query("pck07_chunks", "SELECT (o_orderkey - 1) // 20 AS chunk, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders WHERE o_orderkey > 0 GROUP BY 1")
def chunks(spark, d):
    """PCK-07."""
    got = P.fixed_chunks(table(spark, d, "orders").filter("o_orderkey > 0"), "o_orderkey", 20)
    return got.groupBy("chunk").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("pck09_scenes", "SELECT conv_id, CAST(greatest(1, least(count(*), 80, floor(sum(length(text)) / 100.0 / 7 + 0.5))) AS BIGINT) AS scenes FROM conversations GROUP BY 1")
def scenes(spark, d):
    """PCK-09."""
    a = table(spark, d, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")) / 100.0).alias("seconds"), F.count("*").alias("parts"))
    return a.select("conv_id", P.target_scenes(F.col("seconds"), F.col("parts")).cast("long").alias("scenes"))


@query("pck10_islands", f"""WITH {_SEG}, x AS (SELECT k, i, q, sum(CASE WHEN q < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM seg) SELECT k, run, min(i) AS first, count(*) AS n FROM x WHERE q < 30 GROUP BY ALL""")
def runs(spark, d):
    """PCK-10."""
    got = P.islands(segments(spark, d), ["k"], "i", F.col("q") < 30)
    return got.groupBy("k", "run").agg(F.min("i").alias("first"), F.count("*").alias("n"))


@query("pck06_halved")
def halved(spark, d):
    """PCK-06: scenes longer than 30 seconds are cut at part boundaries."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("k").orderBy("i")
    t = segments(spark, d).withColumn("start", F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    got = t.groupBy("k").agg(F.sum("q").alias("ends"), F.array_sort(F.collect_list("start")).alias("starts"), F.count("*").alias("n"))  # an order's lineitems
    return P.halved_scenes(got.select(F.col("k").alias("id"), F.lit(0).cast("long").alias("first"), (F.col("n") - 1).alias("last"), "starts", "ends"))
