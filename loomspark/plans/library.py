"""Queries over works and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import library as L
from ..sources.tables import chapters, settings_record, stories, table
from .registry import query

_STORIES = """stories AS (SELECT c_custkey AS story_id, c_name AS title, c_mktsegment AS site, c_acctbal AS updated_at,
  CASE WHEN c_nationkey = 3 THEN 2 ELSE 0 END AS new_chapters FROM customer)"""
_CHAPTERS = """chapters AS (SELECT o_custkey AS story_id, o_orderkey AS "order", 'https://s/' || o_orderkey AS url, o_orderpriority AS title,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'error' END AS status, o_totalprice AS seconds, o_orderdate AS created FROM orders)"""

_SUMMARY = f"""WITH {_STORIES}, {_CHAPTERS},
g AS (SELECT s.*, count(c."order") AS total, coalesce(sum((c.status = 'done')::INT), 0)::BIGINT AS done, coalesce(sum((c.status = 'error')::INT), 0)::BIGINT AS errors
  FROM stories s LEFT JOIN chapters c USING (story_id) GROUP BY s.story_id, s.title, s.site, s.updated_at, s.new_chapters)
SELECT *, total - done - errors AS remaining,
  CASE WHEN new_chapters > 0 THEN 'new' WHEN total - done - errors > 0 THEN 'pending' WHEN errors > 0 THEN 'error' ELSE 'done' END AS state FROM g"""


@query("agg01_library_summary", _SUMMARY)
def library_summary(spark, d):
    """AGG-01, JOIN-01, PRJ-03, PRJ-04."""
    return L.with_status(L.summaries(stories(spark, d), chapters(spark, d)))


@query("srt01_library_page", f"SELECT * FROM ({_SUMMARY}) WHERE site LIKE '%BUILD%' ORDER BY updated_at DESC, story_id LIMIT 10 OFFSET 10")
def library_page(spark, d):
    """FLT-03, SRT-01, LIM-01: the second page of ten after a search, newest first."""
    rows = library_summary(spark, d).filter(fold(F.concat_ws(" ", "title", "site")).contains("build"))
    return rows.orderBy(F.desc("updated_at"), "story_id").offset(10).limit(10)


@query("agg25_library_totals", f"WITH {_STORIES}, {_CHAPTERS} SELECT (SELECT count(*) FROM stories) AS stories, (SELECT count(*) FROM chapters) AS chapters")
def library_totals(spark, d):
    """AGG-25."""
    s = L.summaries(stories(spark, d), chapters(spark, d))
    return s.agg(F.count("*").alias("stories"), F.sum("total").alias("chapters"))


@query("agg02_content_bytes", "SELECT source, sum(strlen(text)) AS bytes, count(*) AS n FROM documents GROUP BY source")
def content_bytes(spark, d):
    """AGG-02, AGG-03."""
    return table(spark, d, "documents").groupBy("source").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("n"))


@query("src02_outline", f"""WITH {_CHAPTERS} SELECT story_id, "order", title, status FROM chapters WHERE story_id = 7""")
def outline(spark, d):
    """SRC-01, SRC-02, SRC-03: a pruned scan of one work."""
    return chapters(spark, d).filter("story_id = 7").select("story_id", "order", "title", "status").orderBy("order")


@query("src04_nested_story", f"""WITH {_CHAPTERS} SELECT story_id, string_agg("order" || ':' || status, ',' ORDER BY "order") AS chapters, count(*) AS n FROM chapters GROUP BY story_id""")
def nested_story(spark, d):
    """SRC-04: a work with its chapters in order."""
    listed = F.array_sort(F.collect_list(F.struct("order", "status")))  # the chapters of one work
    got = chapters(spark, d).groupBy("story_id").agg(listed.alias("c"), F.count("*").alias("n"))
    return got.select("story_id", F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["order"].cast("string"), x["status"])), ",").alias("chapters"), "n")


@query("src05_settings", "SELECT coalesce(max(n_name) FILTER (n_nationkey = 3), 'vi') AS lang, coalesce(max(n_name) FILTER (n_nationkey = 99), 'off') AS proxy FROM nation")
def settings(spark, d):
    """SRC-05."""
    n = table(spark, d, "nation")
    kv = n.select(F.when(F.col("n_nationkey") == 3, "lang").when(F.col("n_nationkey") == 99, "proxy").alias("key"), F.col("n_name").alias("value"))
    return settings_record(kv, {"lang": "vi", "proxy": "off"})


_TOC = f"""toc AS (SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY created, "order") AS pos, url,
  CASE WHEN "order" % 3 = 0 THEN NULL ELSE 'T' || "order" END AS title FROM chapters WHERE "order" % 5 <> 0)"""
_STORED = """stored AS (SELECT * FROM chapters WHERE "order" % 7 <> 0)"""


def _toc(spark, d):
    from pyspark.sql.window import Window

    listed = chapters(spark, d).filter(F.col("order") % 5 != 0)
    place = F.row_number().over(Window.partitionBy("story_id").orderBy("created", "order"))
    title = F.when(F.col("order") % 3 != 0, F.concat(F.lit("T"), F.col("order").cast("string")))
    return listed.select("story_id", place.alias("pos"), "url", title.alias("title"))


def _stored(spark, d):
    return chapters(spark, d).filter(F.col("order") % 7 != 0)


@query("join02_merge_toc", f"""WITH {_CHAPTERS}, {_TOC}, {_STORED}
SELECT t.story_id, t.pos AS "order", t.url, coalesce(t.title, CASE WHEN s.status <> 'pending' THEN s.title END) AS title,
  CASE WHEN s.status <> 'pending' THEN s.status ELSE 'pending' END AS status FROM toc t LEFT JOIN stored s USING (story_id, url)""")
def merge_toc(spark, d):
    """JOIN-02."""
    return L.merge_toc(_toc(spark, d), _stored(spark, d))


@query("join03_new_chapters", f"""WITH {_CHAPTERS}, {_TOC}, {_STORED}
SELECT story_id, count(*) AS new_chapters FROM toc t WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.story_id = t.story_id AND s.url = t.url) GROUP BY story_id""")
def new_chapters(spark, d):
    """JOIN-03, SET-02."""
    return L.new_chapter_counts(_toc(spark, d), _stored(spark, d))


@query("flt01_to_crawl", f"""WITH {_CHAPTERS} SELECT story_id, "order", status FROM chapters WHERE status <> 'done'""")
def to_crawl(spark, d):
    """FLT-01."""
    return L.to_crawl(chapters(spark, d)).select("story_id", "order", "status").orderBy("story_id", "order")


@query("flt02_requested", f"""WITH {_CHAPTERS} SELECT story_id, "order", status FROM chapters WHERE "order" IN (3, 5, 8, 13, 21, 34)""")
def requested(spark, d):
    """FLT-01 with a list, FLT-02, FLT-17."""
    return L.to_crawl(chapters(spark, d), [3, 5, 8, 13, 21, 34]).select("story_id", "order", "status")


@query("join05_live_counts", f"""WITH {_CHAPTERS}, live AS (SELECT 'https://s/' || event_id AS url, CASE WHEN event_id % 3 = 0 THEN 'done' WHEN event_id % 3 = 1 THEN 'error' ELSE 'fetching' END AS state FROM events)
SELECT story_id, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'error') AS failed, count(*) AS live FROM chapters JOIN live USING (url) WHERE status = 'pending' GROUP BY story_id""")
def live_counts(spark, d):
    """JOIN-05."""
    rest = F.col("event_id") % 3
    live = table(spark, d, "events").select(F.concat(F.lit("https://s/"), F.col("event_id").cast("string")).alias("url"), F.when(rest == 0, "done").when(rest == 1, "error").otherwise("fetching").alias("state"))
    return L.live_counts(chapters(spark, d), live)


@query("join08_ready_to_post", f"""WITH {_CHAPTERS} SELECT story_id, "order", status FROM chapters c WHERE status IN ('done', 'error') AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = c."order" AND l.l_returnflag = 'R')""")
def ready_to_post(spark, d):
    """JOIN-08, FLT-06, FLT-18."""
    posted = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order")).distinct()
    return L.ready_to_post(chapters(spark, d), posted, ["order"], ["done", "error"]).select("story_id", "order", "status")


_AUDIO = """audio AS (SELECT DISTINCT o_custkey AS story_id, o_orderkey AS "order", o_orderkey % 4 AS audio_hash FROM orders WHERE o_orderkey % 3 <> 0)"""
_VIDEOS = """videos AS (SELECT DISTINCT o_custkey AS story_id, o_orderkey AS "order", CASE WHEN o_orderkey % 10 < 8 THEN o_orderkey % 5 END AS video_hash,
  CASE WHEN o_orderkey % 6 = 0 THEN 'uploaded' ELSE 'draft' END AS video_status, CASE WHEN o_orderkey % 8 = 0 THEN 'kept' END AS video_title FROM orders WHERE o_orderkey % 2 = 0)"""


def _audio(spark, d):
    return chapters(spark, d).filter(F.col("order") % 3 != 0).select("story_id", "order", (F.col("order") % 4).alias("audio_hash"))


def _videos(spark, d):
    o = F.col("order")
    return chapters(spark, d).filter(o % 2 == 0).select("story_id", "order", F.when(o % 10 < 8, o % 5).alias("video_hash"), F.when(o % 6 == 0, "uploaded").otherwise("draft").alias("video_status"), F.when(o % 8 == 0, "kept").alias("video_title"))


@query("join09_publishing_state", f"""WITH {_CHAPTERS}, {_AUDIO}, {_VIDEOS}
SELECT story_id, "order", audio_hash, video_hash, video_status, audio_hash IS NOT NULL AS has_audio, coalesce(audio_hash <> video_hash, false) AS audio_changed
FROM (SELECT * FROM chapters WHERE status = 'done') LEFT JOIN audio USING (story_id, "order") LEFT JOIN videos USING (story_id, "order")""")
def publishing_state(spark, d):
    """JOIN-09."""
    return L.publishing_state(chapters(spark, d), _audio(spark, d), _videos(spark, d))


@query("join24_publish_plan", f"""WITH {_CHAPTERS}, {_AUDIO}, {_VIDEOS}
SELECT story_id, "order", CASE WHEN video_status = 'uploaded' THEN 'skip' WHEN coalesce(status, '') <> 'done' OR audio_hash IS NULL THEN 'fail' ELSE 'prepare' END AS action,
  coalesce(video_title, title) AS video_title
FROM (SELECT story_id, "order", title, status FROM chapters) LEFT JOIN audio USING (story_id, "order") LEFT JOIN videos USING (story_id, "order")""")
def publish_plan(spark, d):
    """JOIN-24, FLT-18."""
    c = chapters(spark, d)
    return L.publish_plan(c.select("story_id", "order"), c, _audio(spark, d), _videos(spark, d))


@query("join07_filled", f"""WITH {_CHAPTERS}, {_VIDEOS}, a AS (SELECT story_id, "order", CASE WHEN "order" % 2 = 0 THEN NULL ELSE title END AS title FROM chapters)
SELECT a.story_id, a."order", coalesce(a.title, v.video_title) AS title, a.title IS NULL AND v.video_title IS NOT NULL AS filled FROM a LEFT JOIN videos v USING (story_id, "order")""")
def filled(spark, d):
    """JOIN-06, JOIN-07."""
    local = chapters(spark, d).select("story_id", "order", F.when(F.col("order") % 2 != 0, F.col("title")).alias("title"))
    return L.filled(local, _videos(spark, d).select("story_id", "order", F.col("video_title").alias("title")), ["story_id", "order"], ["title"])


@query("join10_missing_audio", f"""WITH {_CHAPTERS}, {_AUDIO} SELECT story_id, count(*) AS planned, count(audio_hash) AS present, count(*) - count(audio_hash) AS missing
FROM chapters LEFT JOIN audio USING (story_id, "order") GROUP BY story_id""")
def missing_audio(spark, d):
    """JOIN-10, JOIN-25."""
    joined = chapters(spark, d).join(_audio(spark, d), ["story_id", "order"], "left")
    return joined.groupBy("story_id").agg(F.count("*").alias("planned"), F.count("audio_hash").alias("present"), F.count_if(F.col("audio_hash").isNull()).alias("missing"))


@query("join20_rewrite_state", f"""WITH {_CHAPTERS}, r AS (SELECT DISTINCT l_orderkey AS "order" FROM lineitem WHERE l_returnflag = 'A')
SELECT story_id, count(*) AS done, count(*) FILTER (r."order" IS NULL) AS remaining FROM chapters c LEFT JOIN r ON r."order" = c."order" WHERE status = 'done' GROUP BY story_id""")
def rewrite_state(spark, d):
    """JOIN-20."""
    seen = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("order")).distinct().withColumn("r", F.lit(1))
    joined = chapters(spark, d).filter("status = 'done'").join(seen, "order", "left")
    return joined.groupBy("story_id").agg(F.count("*").alias("done"), F.count_if(F.col("r").isNull()).alias("remaining"))


@query("join21_rewrite_plan", f"""WITH {_CHAPTERS}, {_AUDIO} SELECT story_id, "order" FROM chapters c WHERE status = 'done' AND NOT EXISTS (SELECT 1 FROM audio a WHERE a.story_id = c.story_id AND a."order" = c."order")""")
def rewrite_plan(spark, d):
    """JOIN-21."""
    return L.rewrite_plan(chapters(spark, d), _audio(spark, d).select("story_id", "order"))


@query("join22_narration_states", f"""WITH {_CHAPTERS}, {_AUDIO} SELECT story_id, "order", CASE WHEN audio_hash IS NULL THEN 'missing' ELSE 'ready' END AS audio
FROM (SELECT * FROM chapters WHERE status = 'done') LEFT JOIN audio USING (story_id, "order")""")
def narration_states(spark, d):
    """JOIN-22, FLT-20."""
    return L.narration_states(chapters(spark, d), _audio(spark, d))


@query("join04_export_lookup", """WITH asked AS (SELECT range AS pos, (range * 37) % 15000 AS "order" FROM range(200))
SELECT pos, "order", o_custkey AS story_id, coalesce(o_orderpriority, '') AS title FROM asked JOIN orders ON o_orderkey = "order" """)
def export_lookup(spark, d):
    """JOIN-04: asked chapters in the order they were asked for."""
    asked = spark.range(200).select(F.col("id").alias("pos"), ((F.col("id") * 37) % 15000).alias("order"))
    return asked.join(chapters(spark, d), "order").select("pos", "order", "story_id", F.coalesce("title", F.lit("")).alias("title")).orderBy("pos")


@query("join14_suffix", """WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages), r(domain) AS (VALUES ('example.net'), ('example.com'), ('net'))
SELECT page_id, host, domain FROM h JOIN r ON host = domain OR ends_with(host, '.' || domain)""")
def suffix(spark, d):
    """JOIN-14, SRC-30."""
    hosts = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return L.suffix_matches(hosts, "host", spark.createDataFrame([("example.net",), ("example.com",), ("net",)], "domain string"), "domain").select("page_id", "host", "domain")


@query("join23_merged_list", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v, a.k IS NULL AS appended, coalesce(a.pos, b.pos) AS pos
FROM (SELECT p_partkey AS k, p_name AS v, p_partkey AS pos FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS k, p_brand AS v, p_partkey AS pos FROM part WHERE p_partkey % 2 = 0) b ON a.k = b.k""")
def merged_list(spark, d):
    """JOIN-23."""
    p = table(spark, d, "part")
    side = lambda v: [F.col("p_partkey").alias("k"), F.col(v).alias("v"), F.col("p_partkey").alias("pos")]
    return L.merged_list(p.filter("p_partkey % 3 <> 0").select(*side("p_name")), p.filter("p_partkey % 2 = 0").select(*side("p_brand")), ["k"], ["v"], "pos")


@query("snk01_upsert", f"""WITH {_CHAPTERS}, n AS (SELECT story_id, "order", 'done' AS status, 'new' AS title, 5.0 AS seconds FROM chapters WHERE "order" % 4 = 0)
SELECT story_id, "order", status, title, seconds FROM chapters WHERE "order" % 4 <> 0 UNION ALL
SELECT n.story_id, n."order", n.status, n.title, c.seconds FROM n JOIN chapters c USING (story_id, "order")""")
def upsert(spark, d):
    """SNK-01, SNK-02: upsert that keeps a column that is set."""
    old = chapters(spark, d).select("story_id", "order", "status", "title", "seconds")
    new = old.filter("order % 4 = 0").withColumns({"status": F.lit("done"), "title": F.lit("new"), "seconds": F.lit(5.0)})
    return L.upsert(old, new, ["story_id", "order"], keep=["seconds"])


@query("snk05_created", """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS created_at FROM orders),
n AS (SELECT k + 2 AS k, 'new' AS status, CASE WHEN k % 4 = 0 THEN NULL ELSE TIMESTAMP '2020-01-01' END AS created_at FROM o WHERE k % 5 <> 0)
SELECT coalesce(n.k, o.k) AS k, coalesce(n.status, o.status) AS status, CASE WHEN n.k IS NULL THEN o.created_at ELSE coalesce(o.created_at, n.created_at, TIMESTAMP '2024-02-03') END AS created_at FROM o FULL JOIN n ON n.k = o.k""")
def created(spark, d):
    """SNK-05: the time of creation is the stored one, else the record's, else now."""
    old, new = _records(spark, d)
    return L.upsert(old, new.withColumn("created_at", F.coalesce("created_at", F.lit("2024-02-03").cast("timestamp_ntz"))), ["k"], keep=["created_at"])


@query("snk06_first_created", """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS created_at FROM orders),
n AS (SELECT k + 2 AS k, 'new' AS status, CASE WHEN k % 4 = 0 THEN NULL ELSE TIMESTAMP '2020-01-01' END AS created_at FROM o WHERE k % 5 <> 0)
SELECT coalesce(n.k, o.k) AS k, coalesce(n.status, o.status) AS status, CASE WHEN o.k IS NULL THEN n.created_at ELSE o.created_at END AS created_at FROM o FULL JOIN n ON n.k = o.k""")
def first_created(spark, d):
    """SNK-06: an update never touches the time of creation, not even a missing one."""
    old, new = _records(spark, d)
    return L.upsert(old, new, ["k"], fixed=["created_at"])


def _records(spark, d):
    """Stored records, of which some have no time of creation, and later ones that partly meet them."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).cast("timestamp_ntz").alias("created_at"))
    n = o.filter("k % 5 <> 0").select((F.col("k") + 2).alias("k"), F.lit("new").alias("status"), F.when(F.col("k") % 4 != 0, F.lit("2020-01-01")).cast("timestamp_ntz").alias("created_at"))
    return o, n


@query("snk03_replace", f"""WITH {_CHAPTERS} SELECT story_id, "order", status FROM chapters WHERE story_id % 2 <> 0 UNION ALL SELECT story_id, "order", 'pending' FROM chapters WHERE story_id % 2 = 0 AND "order" % 2 = 0
UNION ALL SELECT story_id, "order", status FROM chapters WHERE story_id % 2 = 0 AND story_id NOT IN (SELECT story_id FROM chapters WHERE story_id % 2 = 0 AND "order" % 2 = 0)""")
def replace(spark, d):
    """SNK-03."""
    old = chapters(spark, d).select("story_id", "order", "status")
    return L.replace_all(old, old.filter("story_id % 2 = 0 and order % 2 = 0").withColumn("status", F.lit("pending")), "story_id")


@query("snk04_insert_absent", """WITH n AS (SELECT l_orderkey AS k, min(l_partkey) AS v FROM lineitem GROUP BY 1)
SELECT k, v, 'new' AS side FROM n WHERE k % 2 = 1 UNION ALL SELECT o_orderkey, o_custkey, 'old' FROM orders WHERE o_orderkey % 2 = 0""")
def insert_absent(spark, d):
    """SNK-04: what came first stays."""
    old = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), F.lit("old").alias("side"))
    new = table(spark, d, "lineitem").filter("l_orderkey % 2 = 1").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"), F.lit("new").alias("side"))
    return L.insert_absent(old, new, ["k"], "v")


@query("snk08_patch", f"""WITH {_CHAPTERS} SELECT story_id, "order", CASE WHEN "order" % 6 = 0 THEN NULL WHEN "order" % 6 = 3 THEN 'set' ELSE title END AS title FROM chapters""")
def patch(spark, d):
    """SNK-07, SNK-08: a patch that sets, clears or keeps."""
    old = chapters(spark, d).select("story_id", "order", "title")
    change = old.filter("order % 3 = 0 or order % 5 = 0").select("story_id", "order", (F.col("order") % 3 == 0).alias("set_title"), F.when(F.col("order") % 6 == 3, "set").alias("title"))
    return L.patched(old, change, ["story_id", "order"], ["title"])


@query("snk09_cascade", """SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def cascade(spark, d):
    """SNK-09: children of deleted rows go."""
    gone = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return L.without(table(spark, d, "lineitem"), gone, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("snk14_content_addressed", """SELECT doc_id, substr(sha1(text), 1, 12) AS name, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) = 1 AS stored FROM documents""")
def content_addressed(spark, d):
    """SNK-14, DED-04: where each text is stored; of equal ones the first is written."""
    named = table(spark, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("hash"))
    first = named.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return named.join(first, "hash").select("doc_id", F.substring("hash", 1, 12).alias("name"), (F.col("doc_id") == F.col("first")).alias("stored"))


@query("str09_guarded", f"""WITH {_CHAPTERS} SELECT story_id, "order", CASE WHEN "order" % 2 = 1 OR (status = 'done' AND "order" % 4 = 0) THEN status WHEN "order" % 4 = 0 THEN 'error' ELSE 'done' END AS status FROM chapters""")
def guarded(spark, d):
    """STR-09: a failed second crawl doesn't undo a done chapter."""
    old = chapters(spark, d).select("story_id", "order", "status")
    new = old.filter("order % 2 = 0").withColumn("status", F.when(F.col("order") % 4 == 0, "error").otherwise("done"))
    return L.guarded(old, new, ["story_id", "order"])


@query("set05_union_orders", """SELECT o_orderkey AS "order" FROM orders WHERE o_orderstatus = 'P' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49""")
def union_orders(spark, d):
    """SET-01, SET-05."""
    a = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("order"))
    return a.union(table(spark, d, "lineitem").filter("l_quantity >= 49").select("l_orderkey")).distinct().orderBy("order")


@query("set03_semi", """SELECT o_orderkey AS "order" FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""")
def semi(spark, d):
    """SET-03, FLT-16."""
    asked = table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("order"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order")).join(asked, "order", "left_semi")
