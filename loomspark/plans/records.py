"""Queries over records: scans, filters, playlists, saved media, retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import library as L
from ..operators import ordered as O
from ..operators import pages as P
from ..sources.tables import chapters, folder_bytes, table
from .registry import query


@query("src06_platform", "SELECT l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_returnflag = 'R' ORDER BY l_linenumber, l_partkey, l_quantity")
def platform(spark, d):
    """SRC-06: one work's rows of one platform, in order."""
    rows = table(spark, d, "lineitem").filter("l_orderkey = 7 and l_returnflag = 'R'")
    return rows.select("l_linenumber", "l_partkey", "l_quantity").orderBy("l_linenumber", "l_partkey", "l_quantity")


@query("src08_published", """SELECT o_orderkey AS "order", o_orderstatus AS kind FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey""")
def published(spark, d):
    """SRC-08: one work's publishing records by order."""
    return table(spark, d, "orders").filter("o_custkey = 7").select(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("kind")).orderBy("order")


@query("src24_batched", """SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 50 AS BIGINT) AS batch, CASE WHEN p_size > 25 THEN p_name END AS name FROM part""")
def batched(spark, d):
    """SRC-24, FN-34: ids in batches of 50, and the details that are found for them."""
    ids = O.numbered(table(spark, d, "part").select("p_partkey"), [("p_partkey", True)])
    details = table(spark, d, "part").filter("p_size > 25").select("p_partkey", F.col("p_name").alias("name"))
    return ids.join(details, "p_partkey", "left").select("p_partkey", F.floor((F.col("place") - 1) / 50).alias("batch"), "name")


@query("flt04_readable", "SELECT p_partkey FROM part WHERE NOT (p_brand LIKE '%1') AND p_size - 10 > 0")
def readable(spark, d):
    """FLT-04: releases without an address elsewhere and with pages."""
    feed = table(spark, d, "part").select("p_partkey", F.when(F.col("p_brand").endswith("1"), "https://x").alias("external_url"), (F.col("p_size") - 10).alias("pages"))
    return feed.filter("external_url is null and pages > 0").select("p_partkey")


@query("flt05_included", "SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0")
def included(spark, d):
    """FLT-05: chapters that are not taken out of the book; unset is included."""
    flag = F.when(F.col("o_custkey") % 3 == 0, False).when(F.col("o_custkey") % 3 == 1, True)
    return table(spark, d, "orders").withColumn("include", flag).filter(F.coalesce("include", F.lit(True))).select("o_orderkey")


@query("flt21_exact_name", "SELECT p_type AS title, min(p_partkey) AS id FROM part WHERE p_size < 20 GROUP BY 1")
def exact_name(spark, d):
    """FLT-21: the first list with just the wanted title."""
    lists = table(spark, d, "part").filter("p_size < 20").select(F.col("p_type").alias("title"), F.col("p_partkey").alias("id"))
    wanted = table(spark, d, "part").select(F.explode(F.array("p_type", F.upper("p_name"))).alias("title"))
    return L.first_named(lists, wanted, "title", "id")


@query("prj01_records", """SELECT '{"storyId":' || o_custkey || ',"chapterOrder":' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"errorKind":"' || o_orderpriority || '"' END || '}' AS record FROM orders""")
def records(spark, d):
    """PRJ-01: rows as records."""
    kind = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return L.camel_record(table(spark, d, "orders").select(F.col("o_custkey").alias("story_id"), F.col("o_orderkey").alias("chapter_order"), kind.alias("error_kind")))


@query("prj02_extracted", """SELECT 'https://s/' || o_orderkey AS source_url, o_orderpriority AS title, CASE WHEN o_orderstatus = 'P' OR o_custkey % 4 = 0 THEN '' ELSE o_orderpriority END AS text,
  CASE WHEN o_orderstatus = 'P' THEN CASE o_custkey % 3 WHEN 0 THEN 'Unknown error' WHEN 1 THEN 'Unknown error' ELSE 'locked' END END AS error, CASE WHEN o_orderstatus = 'P' AND o_custkey % 3 = 2 THEN 'locked' END AS error_kind FROM orders""")
def extracted(spark, d):
    """PRJ-02: chapters as the book builder sees them."""
    k = F.col("order") * 0 + F.col("story_id")
    block = F.struct(F.lit("paragraph").alias("type"), F.col("title").alias("text"))
    error = F.when(k % 3 == 1, "").when(k % 3 == 2, "locked")
    rows = chapters(spark, d).withColumns({"blocks": F.when(k % 4 != 0, F.array(block)), "error": error, "error_kind": F.when(k % 3 == 2, "locked")})
    got = L.extracted_chapters(rows)
    return got.select("source_url", "title", F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("text"), "error", "error_kind")


_LIST = """e AS (SELECT user_id AS story_id, event_id AS pos, event_id % 40 AS n, CASE WHEN event_id % 6 <> 0 THEN 'v' || event_id END AS video_id, event_type FROM events)"""


@query("join06_playlist", f"""WITH {_LIST}, done AS (SELECT DISTINCT story_id, n % 20 AS n FROM e WHERE event_type <> 'purchase'), known AS (SELECT story_id, n, 'v' || min(pos) AS known FROM e WHERE pos % 9 = 0 GROUP BY ALL),
m AS (SELECT e.*, row_number() OVER (PARTITION BY e.story_id, e.n ORDER BY pos) AS i FROM e JOIN done USING (story_id, n) LEFT JOIN known USING (story_id, n) WHERE video_id IS NOT NULL AND (known IS NULL OR known = video_id))
SELECT story_id, n AS "order", video_id, 'Chapter ' || n AS title FROM m WHERE i = 1""")
def playlist(spark, d):
    """JOIN-06: a list's items matched with done chapters."""
    n = F.col("event_id") % 40
    e = table(spark, d, "events").select(F.col("user_id").alias("story_id"), F.col("event_id").alias("pos"), n.alias("n"), F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("video_id"), "event_type")
    items = e.withColumn("title", F.concat(F.lit("Chapter "), F.col("n").cast("string"))).withColumn("order", F.regexp_extract("title", r"(\d+)", 1).cast("long"))
    done = e.filter("event_type <> 'purchase'").select("story_id", (F.col("n") % 20).alias("order"), F.lit("done").alias("status"))
    known = e.filter("pos % 9 = 0").groupBy("story_id", F.col("n").alias("order")).agg(F.concat(F.lit("v"), F.min("pos").cast("string")).alias("video_id"))
    return L.playlist_matches(items, done, known)


@query("join18_images", r"""SELECT page_id, regexp_replace(html, '<img\b[^>]*>', '', 'g') || CASE WHEN page_id % 5 < 3 THEN '<img src="file:///m/' || page_id % 5 || '" alt="x">' ELSE '' END || '<p>t</p>' AS html FROM pages""")
def images(spark, d):
    """JOIN-18: images point at their saved files; those without one go."""
    k = (F.col("page_id") % 5).cast("string")
    html = F.concat("html", F.lit('<img alt="x" src="https://i/'), k, F.lit('"><p>t</p><img src="/none">'))
    saved = table(spark, d, "nation").filter("n_nationkey < 3").select(F.concat(F.lit("https://i/"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("/m/"), F.col("n_nationkey").cast("string")).alias("file"))
    return P.saved_images(table(spark, d, "pages").select("page_id", html.alias("html")), saved, "page_id", "html")


@query("agg09_margins", "SELECT l_orderkey AS page, min(l_discount * 100) AS \"left\", greatest(max(l_quantity), 60 - min(l_discount * 100)) AS \"right\" FROM lineitem WHERE l_linenumber = 2 GROUP BY 1")
def margins(spark, d):
    """AGG-09: each page's margins by its body lines."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_discount") * 100).alias("x"), F.col("l_quantity").alias("right"), F.col("l_linenumber").alias("size"))
    return O.page_margins(lines, ["page"], F.lit(2), F.lit(60))


@query("agg20_hours", "SELECT o_custkey AS story_id, year(o_orderdate) AS part, round(sum(o_totalprice) / 3600, 6) AS hours FROM orders GROUP BY ALL")
def hours(spark, d):
    """AGG-20: hours of each part."""
    return chapters(spark, d).groupBy("story_id", F.year("created").alias("part")).agg(F.round(F.sum("seconds") / 3600, 6).alias("hours"))


@query("agg21_expiry", "SELECT user_id, min(CASE WHEN event_id % 3 = 0 THEN event_id * 1000 END) AS expires FROM events GROUP BY 1")
def expiry(spark, d):
    """AGG-21: when a session's first token ends."""
    claims = F.concat(F.lit('{"sub":"~~~???","exp":'), (F.col("event_id") * 1000).cast("string"), F.lit("}"))
    token = F.concat(F.lit("h."), F.translate(F.base64(claims.cast("binary")), "+/=", "-_"), F.lit(".s"))
    cookies = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, token).when(F.col("event_id") % 3 == 1, "plain").otherwise("a.%%%.c").alias("value"))
    return P.earliest_expiry(cookies, ["user_id"], "value")


@query("agg22_first_chapter", "SELECT o_custkey AS story_id, min(o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def first_chapter(spark, d):
    """AGG-22: each work's first done chapter."""
    return chapters(spark, d).filter("status = 'done'").groupBy("story_id").agg(F.min("order").alias("first"))


@query("agg26_folder_bytes")
def folder(spark, d):
    """AGG-26: bytes of a folder's files; a missing folder has none."""
    return folder_bytes(spark, f"{d}/documents.parquet").unionByName(folder_bytes(spark, f"{d}/no such folder"))


_RULES = [(r"^https?://[^/]*example\.org/\w+/(\d+).*$", "https://example.org/s/$1"), (r"^https?://[^/]*example\.net/(\w+)/(\d+).*$", "https://example.net/$1/$2/")]


@query("fn23_canonical", r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]*example\.org/\w+/\d+') THEN regexp_replace(url, '^https?://[^/]*example\.org/\w+/(\d+).*$', 'https://example.org/s/\1')
  WHEN regexp_matches(url, '^https?://[^/]*example\.net/\w+/\d+') THEN regexp_replace(url, '^https?://[^/]*example\.net/(\w+)/(\d+).*$', 'https://example.net/\1/\2/') ELSE url END AS url FROM pages""")
def canonical(spark, d):
    """FN-23: one address for each work by its site's rule."""
    return table(spark, d, "pages").select("page_id", V.canonical(F.col("url"), _RULES).alias("url"))


@query("str08_retries", """WITH x AS (SELECT user_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, min(i) FILTER (ok) AS first, count(*) AS n FROM x GROUP BY 1)
SELECT user_id, CASE WHEN first <= 3 THEN first ELSE least(n, 3) END AS attempts, CASE WHEN first <= 3 THEN 'done' WHEN n >= 3 THEN 'failed' ELSE 'retrying' END AS state FROM f""")
def retries(spark, d):
    """STR-08: a retry loop that ends with a success or at the third failure."""
    return L.retry_states(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", 3)
