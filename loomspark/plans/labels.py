"""Queries over labels, titles and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as B
from ..functions.pagehtml import parsed
from ..sources.sites import dispatch, register, valid_listing
from ..sources.tables import table
from .registry import query


@query("fn10_feed_label", """SELECT p_partkey, CASE WHEN l = '' THEN 'Oneshot' ELSE l END || ' – ' || p_name AS label FROM (SELECT p_partkey, p_name, trim(CASE WHEN p_size % 2 = 0 THEN 'Vol. ' || p_size ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' Ch. ' || p_partkey ELSE '' END) AS l FROM part)""")
def feed_label(spark, d):
    """FN-10."""
    volume = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))
    chapter = F.when(F.col("p_size") % 3 == 0, F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", B.feed_label(volume, chapter, F.col("p_name")).alias("label"))


@query("fn10_part_label", """SELECT o_orderkey, CASE WHEN o_custkey % 3 > 1 THEN 'Audio Phần ' || (o_orderkey % 3) || ' (Chương ' || o_orderkey || '-' || (o_orderkey + 5) || ')' ELSE 'Audio (Chương ' || o_orderkey || '-' || (o_orderkey + 5) || ')' END AS label FROM orders""")
def part_label(spark, d):
    """FN-10."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", B.part_label(F.lit("Audio"), k % 3, F.col("o_custkey") % 3, k, k + 5).alias("label"))


@query("fn07_decoded", """SELECT p_partkey, p_name || ' & <' || p_size || '> é &copy;' AS title FROM part""")
def decoded(spark, d):
    """FN-07."""
    raw = F.concat(F.col("p_name"), F.lit("  &amp; &lt;"), F.col("p_size").cast("string"), F.lit("&gt;&nbsp;&#xe9; &copy; "))
    return table(spark, d, "part").select("p_partkey", B.decoded_title(raw).alias("title"))


@query("fn19_intro", "SELECT p_partkey, 'Welcome to Radio: ' || p_name AS intro FROM part")
def intro(spark, d):
    """FN-19, FN-12."""
    title = F.concat("p_name", F.lit(" – Somebody"))
    return table(spark, d, "part").select("p_partkey", B.intro(F.lit(" Welcome to  {channel}: {title} "), "x", F.lit("Radio "), title).alias("intro"))


@query("fn16_description", """SELECT p_partkey, 'Hear ' || p_name || chr(10) || chr(10) || 'Brand: ' || p_brand || CASE WHEN p_size > 25 THEN chr(10) || 'Type: ' || p_type ELSE '' END || chr(10) || chr(10) || 'Bye' || chr(10) || chr(10) || '#a #b' AS text FROM part""")
def description(spark, d):
    """FN-16."""
    facts = [("Brand", F.col("p_brand")), ("Type", F.when(F.col("p_size") > 25, F.col("p_type")))]
    text = B.described(F.concat(F.lit("Hear "), F.col("p_name")), F.lit("  "), facts, F.lit("Bye"), F.array(F.lit("#a"), F.lit("#b")))
    return table(spark, d, "part").select("p_partkey", text.alias("text"))


@query("top06_page_title")
def page_title(spark, d):
    """TOP-06, TXT-14: title cascade and blocks without the leading heading."""
    got = parsed(table(spark, d, "pages"), "page_id", "url", "html")
    title = B.page_title(F.lit(None).cast("string"), F.col("blocks"), F.col("title"), F.lit(None).cast("string"))
    return got.select("page_id", title.alias("page_title"), F.size(B.without_leading_heading(F.col("blocks"))).alias("n"))


@query("src30_dispatch", r"""SELECT page_id, CASE WHEN h LIKE '%.example.net' OR h = 'example.net' THEN 'net' WHEN h LIKE '%.example.com' OR h = 'example.com' THEN 'com' END AS reader FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages)""")
def readers(spark, d):
    """SRC-30, UDF-03."""
    p = table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"))
    return dispatch(p, "host", [("example.net", "net"), ("example.com", "com")]).select("page_id", "reader")


@query("udf01_blocks")
def table_function(spark, d):
    """UDF-01, UDF-02: a table function from pages to blocks."""
    register(spark)
    table(spark, d, "pages").createOrReplaceTempView("loomspark_pages")
    return spark.sql("SELECT page_id, pos, type, level, text FROM loomspark_pages, LATERAL page_blocks(html, url)")


@query("ded05_listing", r"""WITH l AS (SELECT conv_id AS page_id, turn AS pos, 'https://h.org/t/' || (turn % 5) AS url, row_number() OVER (PARTITION BY conv_id, turn % 5 ORDER BY turn) AS n FROM conversations WHERE turn % 7 <> 6),
k AS (SELECT page_id, pos, url, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS m FROM l WHERE n = 1) SELECT page_id, pos, url FROM k WHERE m <= 3""")
def listing(spark, d):
    """DED-05, UDF-02: a list made safe."""
    c = table(spark, d, "conversations")
    host = F.when(F.col("turn") % 7 == 6, "https://x.org/t/").otherwise("https://h.org/t/")
    rows = c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("pos"), F.concat(host, (F.col("turn") % 5).cast("string"), F.lit("#a")).alias("url"), F.lit("www.h.org").alias("page_host"))
    return valid_listing(rows, "page_host", 3).select("page_id", "pos", "url")
