"""Queries of what is taken from outside: readers' results, bodies, written times; and of what is counted for display."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import library as L
from ..sources.sites import valid_articles, valid_chapters
from ..sources.tables import chapters, table
from .registry import query


def _block(kind: str, text, src=None):
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), F.lit(None).cast("int").alias("level"), text.alias("text"), (none if src is None else src).alias("src"), none.alias("alt"))


@query("udf02_chapters", """WITH x AS (SELECT doc_id, coalesce(length(trim(text)), 0) AS chars, doc_id % 10 = 0 AS pictured FROM documents)
SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN 'https://h.org/' || doc_id ELSE 'No ' || doc_id END AS title, CAST((chars > 0)::INT + pictured::INT AS INT) AS n_blocks, chars,
CASE WHEN doc_id % 11 = 0 THEN 'locked' WHEN chars < 200 AND NOT pictured THEN 'too short' END AS problem FROM x""")
def contract_chapters(spark, d):
    """UDF-02: chapters as readers return them, made safe; locked and nearly empty ones are named."""
    picture = F.when(F.col("doc_id") % 10 == 0, "https://h.org/i.png").otherwise("javascript:i")
    blocks = F.array(_block("paragraph", F.col("text")), _block("script", F.lit("x")), _block("image", F.lit(None).cast("string"), picture))
    title = F.when(F.col("doc_id") % 3 == 0, " \n ").otherwise(F.concat(F.lit(" No \t "), F.col("doc_id").cast("string")))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://h.org/"), F.col("doc_id").cast("string")).alias("url"), title.alias("title"), (F.col("doc_id") % 11 == 0).alias("locked"), blocks.alias("blocks"))
    chars = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.coalesce(F.length(b["text"]), F.lit(0)))
    return valid_chapters(rows).select("page_id", "title", F.size("blocks").alias("n_blocks"), chars.alias("chars"), "problem")


@query("udf02_articles", r"""WITH x AS (SELECT doc_id, lang, coalesce(string_split(text, chr(10)), []) AS l FROM documents),
k AS (SELECT *, list_filter(list_zip(l, range(1, len(l) + 1))[:20000], lambda z: trim(z[1]) <> '') AS k FROM x)
SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 0 THEN 'h.org' ELSE 'Text ' || doc_id END AS title, CASE WHEN length(lang) BETWEEN 2 AND 3 THEN lang END AS language,
CASE WHEN doc_id % 3 > 0 THEN 'https://h.org/c.png' END AS cover_url, CAST(len(k) AS INT) AS n_chapters,
array_to_string(list_transform(k, lambda z, i: CASE WHEN z[2] % 2 = 1 THEN CAST(i AS VARCHAR) ELSE 'Part ' || z[2] END), '|') AS titles,
CASE WHEN doc_id % 13 = 0 THEN 'locked' WHEN coalesce(list_sum(list_transform(k, lambda z: length(trim(z[1])))), 0) < 200 THEN 'too short' END AS problem FROM k""")
def contract_articles(spark, d):
    """UDF-02: whole texts as readers return them, a chapter a line."""
    part = lambda t, i: F.struct(F.when(i % 2 == 0, "").otherwise(F.concat(F.lit("Part "), (i + 1).cast("string"))).alias("title"), F.array(_block("paragraph", t)).alias("blocks"))
    number = F.col("doc_id").cast("string")
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.lit("https://www.h.org/a").alias("url"),
        F.concat(F.lit('<!doctype html><html class=a lang="'), F.coalesce("lang", F.lit("")), F.lit('">')).alias("html"),
        F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("Text "), number)).alias("title"),
        F.lit(" ").alias("author"),
        F.when(F.col("doc_id") % 3 == 0, "ftp://h.org/c.png").otherwise("https://h.org/c.png").alias("cover_url"),
        (F.col("doc_id") % 13 == 0).alias("locked"),
        F.transform(F.split("text", "\n"), part).alias("chapters"),
    )
    titles = F.array_join(F.transform("chapters", lambda c: c["title"]), "|")
    return valid_articles(rows).select("page_id", "title", "language", "cover_url", F.size("chapters").alias("n_chapters"), titles.alias("titles"), "problem")


@query("src18_capped", "SELECT page_id, CASE WHEN coalesce(page_id % 4 = 0 AND page_id * 100 > 3000, false) OR strlen(html) > 3000 THEN NULL ELSE coalesce(html, '') END AS body FROM pages")
def capped(spark, d):
    """SRC-18: bodies up to a number of bytes, by what is declared and by what there is."""
    declared = F.when(F.col("page_id") % 4 == 0, F.col("page_id") * 100)
    return table(spark, d, "pages").select("page_id", V.capped_body(F.col("html"), declared, 3000).alias("body"))


@query("fn34_chunks", """WITH w AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(text, ' ') END AS w FROM documents), c AS (SELECT doc_id, list_transform(range(0, len(w), 50), lambda i: w[i + 1 : i + 50]) AS c FROM w)
SELECT doc_id, CAST(len(c) AS INT) AS n, CAST(len(c[-1]) AS INT) AS last, array_to_string(list_transform(c, lambda x: x[1]), ' ') AS firsts FROM c""")
def sliced(spark, d):
    """FN-34: a text's words in slices of 50."""
    words = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " "))
    got = table(spark, d, "documents").select("doc_id", V.chunked(words, 50).alias("c"))
    return got.select("doc_id", F.size("c").alias("n"), F.size(F.try_element_at("c", F.lit(-1))).alias("last"), F.array_join(F.transform("c", lambda x: x[0]), " ").alias("firsts"))


@query("fn36_local_times", """WITH x AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN ts + INTERVAL 570 MINUTE WHEN 1 THEN ts + INTERVAL 7 HOUR ELSE ts END AS shown FROM events)
SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:00+07:00') AS iso, strftime(ts + INTERVAL 31 HOUR, '%Y-%m-%d') AS tomorrow, strftime(shown, '%Y-%m-%dT%H:%M') AS input, strftime(shown, '%H:%M %d/%m/%Y') AS label FROM x""")
def local_times(spark, d):
    """FN-36: times as a zone writes them, from UTC and from written times with an offset, in UTC and without."""
    zone, rest = "Asia/Ho_Chi_Minh", F.col("event_id") % 3
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest == 0, "-02:30").when(rest == 1, "Z").otherwise(""))
    return e.select("event_id", V.iso_with_offset(F.col("ts"), zone).alias("iso"), V.tomorrow(F.col("ts"), zone).alias("tomorrow"), V.local_input(written, zone).alias("input"), V.publish_label(written, zone).alias("label"))


@query("agg23_counters", """WITH c AS (SELECT o_custkey AS story_id, 'https://s/' || o_orderkey AS url, o_orderstatus AS s FROM orders), live AS (SELECT 'https://s/' || event_id AS url, event_id % 3 AS r FROM events),
x AS (SELECT story_id, CASE WHEN s = 'F' OR (s = 'O' AND r = 0) THEN 'done' WHEN s NOT IN ('F', 'O') OR r = 1 THEN 'error' ELSE 'pending' END AS state FROM c LEFT JOIN live USING (url))
SELECT story_id, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'error') AS error, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state <> 'done') AS remaining FROM x GROUP BY 1""")
def shown_counters(spark, d):
    """AGG-23: a work's chapters by state while a run goes on."""
    rest = F.col("event_id") % 3
    live = table(spark, d, "events").select(F.concat(F.lit("https://s/"), F.col("event_id").cast("string")).alias("url"), F.when(rest == 0, "done").when(rest == 1, "error").otherwise("fetching").alias("state"))
    return L.counters(chapters(spark, d), live)


@query("agg26_usage", """SELECT o_orderkey AS "order", count(l_orderkey) AS files, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS bytes FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1""")
def usage(spark, d):
    """AGG-26: files and bytes of each chapter; one without files has none."""
    files = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order"), F.col("l_quantity").cast("long").alias("size"))
    return L.owned_bytes(chapters(spark, d).select("order"), files, ["order"], "size")
