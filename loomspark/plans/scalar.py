"""Queries that apply the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..sources.tables import table
from .registry import query


@query("fn01_fold", "SELECT doc_id, lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')) AS folded FROM documents")
def fold(spark, d):
    """FN-01."""
    return table(spark, d, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query("fn02_collapse", r"SELECT doc_id, trim(regexp_replace(text, '[\s]+', ' ', 'g')) AS text FROM documents")
def collapse(spark, d):
    """FN-02."""
    return table(spark, d, "documents").select("doc_id", X.collapsed(F.col("text")).alias("text"))


@query("fn03_words", r"SELECT doc_id, len(regexp_extract_all(text, '[^\s]+')) AS words FROM documents")
def words(spark, d):
    """FN-03, AGG-11 by document."""
    return table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).cast("long").alias("words"))


@query("fn04_names", """SELECT item_id, array_to_string(list_filter(list_distinct_ordered, lambda x: length(x) >= 3), '|') AS names FROM (SELECT item_id, list_reduce(list_transform(regexp_extract_all(text, '[A-ZÀ-Ỹ][a-zà-ỹ]+(?:\\s+[A-ZÀ-Ỹ][a-zà-ỹ]+)*'), lambda x: [x]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_ordered FROM benchmark)""".replace("\\\\", "\\"))
def names(spark, d):
    """FN-04."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.proper_names(F.col("text")), "|").alias("names"))


@query("fn06_escape", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM pages")
def escape(spark, d):
    """FN-05, FN-06."""
    return table(spark, d, "pages").select("page_id", X.escaped(F.col("html")).alias("safe"))


@query("fn13_hashtag", r"SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name, '[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '') AS tag FROM part")
def hashtag(spark, d):
    """FN-12, FN-13."""
    return table(spark, d, "part").select("p_partkey", X.hashtag(F.col("p_name")).alias("tag"))


@query("fn14_title", "SELECT doc_id, CASE WHEN length(t) <= 100 THEN t ELSE rtrim(substr(t, 1, 97)) || '...' END AS title FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)")
def title(spark, d):
    """FN-14."""
    t = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", X.shortened(t).alias("title"))


@query("fn15_variant", """SELECT p_partkey, (['a', 'b', 'c', 'd', 'e'])[CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % 5 AS INT) + 1] AS variant FROM part""")
def variant(spark, d):
    """FN-15."""
    return table(spark, d, "part").select("p_partkey", X.variant(F.col("p_name"), ["a", "b", "c", "d", "e"]).alias("variant"))


@query("fn17_stem", r"""SELECT page_id, coalesce(nullif(trim(substr(trim(regexp_replace(regexp_replace(url, '[\\/:*?"<>|]', ' ', 'g'), '\s+', ' ', 'g')), 1, 120)), ''), 'book') AS stem FROM pages""")
def stem(spark, d):
    """FN-17."""
    return table(spark, d, "pages").select("page_id", X.file_stem(F.col("url"), "book").alias("stem"))


@query("fn20_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug(spark, d):
    """FN-20, FN-39."""
    return table(spark, d, "part").select("p_partkey", X.slug(F.col("p_type")).alias("slug"))


@query("fn21_story_id", "SELECT page_id, substr(sha1(url), 1, 16) AS id, true AS valid FROM pages")
def story_id(spark, d):
    """FN-21, FLT-14."""
    got = table(spark, d, "pages").select("page_id", V.story_id(F.col("url")).alias("id"))
    return got.withColumn("valid", V.valid_id(F.col("id")))


@query("fn24_shape", r"SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\d+', '#', 'g') AS shape, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages")
def shape(spark, d):
    """FN-24, FN-25."""
    return table(spark, d, "pages").select("page_id", V.address_shape(F.col("url")).alias("shape"), V.host_name(F.col("url")).alias("host"))


@query("fn22_normalized", r"""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' || CASE WHEN p = '' THEN '' ELSE p || '/' END AS url FROM (SELECT page_id, url, array_to_string(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), '/') AS p FROM pages)""")
def normalized(spark, d):
    """FN-22."""
    return table(spark, d, "pages").select("page_id", V.normalized_story_url(F.col("url")).alias("url"))


@query("fn33_clock", """SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS clock FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 40) AS BIGINT) AS s FROM orders)""")
def clock(spark, d):
    """FN-33."""
    return table(spark, d, "orders").select("o_orderkey", V.clock(F.col("o_totalprice") / 40).alias("clock"))


@query("fn35_labels", """SELECT o_orderkey, CASE WHEN ms < 60000 THEN 'under 1 min' WHEN m < 60 THEN '~' || m || ' min' WHEN m % 60 = 0 THEN '~' || m // 60 || ' hr' ELSE '~' || m // 60 || ' hr ' || m % 60 || ' min' END AS eta,
 CASE WHEN ago < 1 THEN 'just now' WHEN ago < 60 THEN ago || ' min ago' WHEN ago < 1440 THEN ago // 60 || ' hr ago' WHEN ago < 10080 THEN ago // 1440 || ' days ago' END AS ago
FROM (SELECT o_orderkey, o_totalprice * 100 AS ms, CAST(floor(o_totalprice * 100 / 60000 + 0.5) AS BIGINT) AS m, CAST(floor(o_totalprice / 30) AS BIGINT) AS ago FROM orders)""")
def labels(spark, d):
    """FN-35."""
    ms = F.col("o_totalprice") * 100
    return table(spark, d, "orders").select("o_orderkey", V.eta_label(ms).alias("eta"), V.time_ago(F.col("o_totalprice") / 30).alias("ago"))


@query("fn31_delays", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN least(event_id % 50 * 1000.0, 30000.0) ELSE least(1000.0 * 2 ** (event_id % 8), 30000.0) END AS http, CASE WHEN event_id % 5 = 0 THEN 300 ELSE least((event_id % 8 + 1) * 1000, 3000) END AS crawl FROM events""")
def delays(spark, d):
    """FN-31, FN-32."""
    n = F.col("event_id") % 8 + 1
    header = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 50).cast("string"))
    return table(spark, d, "events").select("event_id", V.retry_delay(n, header).alias("http"), V.crawl_delay(F.col("event_id") % 5 == 0, n).alias("crawl"))


@query("fn37_versions", """SELECT a.n_nationkey AS a, b.n_nationkey AS b, sign(a.n_nationkey // 5 - b.n_nationkey // 5) * 2 + sign(a.n_nationkey % 5 - b.n_nationkey % 5) AS s,
 CAST(CASE WHEN a.n_nationkey // 5 <> b.n_nationkey // 5 THEN sign(a.n_nationkey // 5 - b.n_nationkey // 5) ELSE sign(a.n_nationkey % 5 - b.n_nationkey % 5) END AS INT) AS o FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def versions(spark, d):
    """FN-37."""
    n = table(spark, d, "nation")
    ver = F.concat_ws(".", F.floor(F.col("n_nationkey") / 5).cast("string"), (F.col("n_nationkey") % 5).cast("string"))
    a = n.select("n_regionkey", F.col("n_nationkey").alias("a"), ver.alias("va"))
    b = n.select("n_regionkey", F.col("n_nationkey").alias("b"), ver.alias("vb"))
    whole, rest = F.signum(F.floor(F.col("a") / 5) - F.floor(F.col("b") / 5)), F.signum(F.col("a") % 5 - F.col("b") % 5)
    return a.join(b, "n_regionkey").select("a", "b", (whole * 2 + rest).cast("int").alias("s"), V.version_order(F.col("va"), F.col("vb")).alias("o"))


@query("fn38_importance", "SELECT event_id, CAST(greatest(1, least(5, floor(coalesce(value, 1) / 20 + 0.5))) AS BIGINT) AS importance FROM events")
def importance(spark, d):
    """FN-38."""
    return table(spark, d, "events").select("event_id", V.importance(F.col("value") / 20).cast("long").alias("importance"))


@query("flt11_private", """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN true WHEN s_suppkey % 4 = 1 THEN s_suppkey % 64 BETWEEN 16 AND 31 ELSE false END AS private FROM supplier""")
def private(spark, d):
    """FLT-11."""
    k = F.col("s_suppkey")
    ip = F.when(k % 4 == 0, F.concat(F.lit("10.0.0."), (k % 256).cast("string"))).when(k % 4 == 1, F.concat_ws(".", F.lit("172"), (k % 64).cast("string"), F.lit("1.1"))).otherwise(F.lit("8.8.8.8"))
    return table(spark, d, "supplier").select("s_suppkey", V.private_address(ip).alias("private"))


@query("flt12_ranges", """SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber >= 0 AND l_linenumber < l_quantity AND l_returnflag IN ('A', 'R') GROUP BY 1""")
def highlight_ranges(spark, d):
    """FLT-12, FLT-19, JOIN-19."""
    ok = (F.col("l_linenumber") >= 0) & (F.col("l_linenumber") < F.col("l_quantity")) & F.col("l_returnflag").isin("A", "R")
    return table(spark, d, "lineitem").filter(ok).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("flt15_problems", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 30 THEN 'size' END, CASE WHEN p_retailprice < 1000 THEN 'price' END, CASE WHEN p_brand LIKE '%1' THEN 'brand' END], lambda x: x IS NOT NULL), ',') AS problems FROM part""")
def problems(spark, d):
    """FLT-15, FLT-13."""
    rules = [("size", F.col("p_size") > 30), ("price", F.col("p_retailprice") < 1000), ("brand", F.col("p_brand").endswith("1"))]
    return table(spark, d, "part").select("p_partkey", F.array_join(V.violated(rules), ",").alias("problems"))


@query("flt10_predicates", r"""SELECT page_id, regexp_matches(html, '(?i)<title>[^<]*just a moment') AS challenge, regexp_matches(html, '(?i)nội dung (chương|chapter).{0,20}(đang bị khóa|bị khóa)|vui lòng (tắt|mở lại).{0,30}quảng cáo') AS locked
FROM (SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN '<p>Nội dung CHƯƠNG này đang bị khóa</p>' WHEN 1 THEN '<p>Vui lòng tắt chặn quảng cáo</p>' ELSE '' END AS html FROM pages)""")
def predicates(spark, d):
    """FLT-09, FLT-10."""
    notice = F.when(F.col("page_id") % 4 == 0, "<p>Nội dung CHƯƠNG này đang bị khóa</p>").when(F.col("page_id") % 4 == 1, "<p>Vui lòng tắt chặn quảng cáo</p>").otherwise("")
    pages = table(spark, d, "pages").select("page_id", F.concat("html", notice).alias("html"))
    heading = F.regexp_extract("html", "(?i)<title>([^<]*)", 1)
    return pages.select("page_id", heading.rlike("(?i)just a moment").alias("challenge"), X.locked(F.col("html")).alias("locked"))


@query("json_props", "SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def props(spark, d):
    """JSON by a fixed schema (§2.9)."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"))


@query("txt15_rewrite", r"""WITH x AS (SELECT a.conv_id, a.turn, a.text AS s, b.text AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
c AS (SELECT conv_id, turn, t, len(regexp_extract_all(s, '[^\s]+')) AS ws, len(regexp_extract_all(t, '[^\s]+')) AS wt,
  len(list_filter(string_split(s, chr(10)), lambda p: trim(p) <> '')) AS ps, len(list_filter(string_split(t, chr(10)), lambda p: trim(p) <> '')) AS pt,
  list_filter(list_distinct(regexp_extract_all(s, '[A-ZÀ-Ỹ][a-zà-ỹ]+(?:\s+[A-ZÀ-Ỹ][a-zà-ỹ]+)*')), lambda n: length(n) >= 3) AS ns FROM x),
l AS (SELECT *, len(list_filter(ns, lambda n: NOT contains(t, n))) AS lost FROM c)
SELECT conv_id, turn, CASE WHEN pt = 0 THEN 'empty' WHEN pt < ps THEN 'merged' WHEN ws >= 20 AND wt / ws < 0.7 THEN 'short' WHEN ws >= 20 AND wt / ws > 1.7 THEN 'long'
  WHEN regexp_matches(t, '[*#>|_\[\]{}()]') THEN 'symbol' WHEN regexp_matches(t, '[0-9]') THEN 'digits' WHEN len(ns) >= 5 AND lost >= 2 AND lost > len(ns) * 0.15 THEN 'names' END AS problem FROM l""")
def rewrite(spark, d):
    """TXT-15, SET-04: the first rule that a rewrite breaks; each turn is taken as a rewrite of the one before."""
    a = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("s"))
    b = table(spark, d, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    parts = lambda c: F.size(F.filter(F.split(c, "\n"), lambda p: F.trim(p) != ""))
    found = X.rewrite_problem(F.col("s"), F.col("t"), parts("s"), parts("t"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", found.alias("problem"))


@query("txt16_written", r"""SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '[^\s]+')) < 30 THEN 'short' WHEN regexp_matches(text, '[*#>|_\[\]{}()]') THEN 'symbol' WHEN regexp_matches(text, '[0-9]') THEN 'digits' END AS problem FROM conversations""")
def written_text(spark, d):
    """TXT-16: the first rule that a new text breaks."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.written_problem(F.col("text"), 30).alias("problem"))


@query("txt16_scanned", """WITH x AS (SELECT o_orderkey, o_custkey % 7 AS a, o_custkey % 9 AS i, o_orderpriority AS p FROM orders)
SELECT o_orderkey, CASE WHEN a NOT BETWEEN 1 AND 5 THEN 'order' WHEN i = 8 THEN 'what' END AS problem, CASE WHEN a BETWEEN 1 AND 5 AND i <> 8 THEN a || ':' || greatest(1, least(5, i)) || ':x y|3:1:' || p END AS twists FROM x""")
def scanned(spark, d):
    """TXT-16, FLT-16: the notes in a JSON reply inside prose, each on one of the chapters shown."""
    a, i = F.col("o_custkey") % 7, F.col("o_custkey") % 9
    first = F.concat(F.lit('{"order": '), a.cast("string"), F.lit(', "what": "'), F.when(i == 8, "  ").otherwise(" x  y "), F.lit('", "importance": '), i.cast("string"), F.lit("}"))
    second = F.concat(F.lit('{"order": 3, "title": " t ", "what": "'), F.col("o_orderpriority"), F.lit('"}'))
    reply = F.concat(F.lit('Here: {"twists": ['), first, F.lit(", "), second, F.lit("]} - done"))
    notes = X.scan_notes(reply)
    problem = X.scan_problem(notes, F.sequence(F.lit(1), F.lit(5)))
    listed = F.transform(notes, lambda n: F.concat_ws(":", n["order"].cast("string"), n["importance"].cast("string"), n["what"]))
    return table(spark, d, "orders").select("o_orderkey", problem.alias("problem"), F.when(problem.isNull(), F.array_join(listed, "|")).alias("twists"))


@query("txt25_repaired", r"""WITH x AS (SELECT item_id, string_split(replace(replace(text, 'a', '|'), 'A', '|'), '') AS c FROM benchmark)
SELECT item_id, array_to_string(list_transform(c, lambda x, i: CASE WHEN x <> '|' THEN x
  WHEN i > 1 AND regexp_matches(c[i - 1], '\p{L}') THEN CASE WHEN regexp_matches(c[i - 1], '\p{Lu}') THEN 'A' ELSE 'a' END
  WHEN regexp_matches(coalesce(c[i + 1], ''), '\p{L}') THEN CASE WHEN regexp_matches(c[i + 1], '\p{Lu}') THEN 'A' ELSE 'a' END ELSE x END), '') AS text FROM x""")
def repaired(spark, d):
    """TXT-25: symbols beside letters become the letters that they stand for, in their neighbour's case."""
    return table(spark, d, "benchmark").select("item_id", X.with_letters(F.translate("text", "aA", "||"), {"|": "a"}).alias("text"))


@query("txt24_broken", r"""SELECT doc_id, len(regexp_extract_all(replace(text, 'a', '|'), '\p{L}[|{}]|[|{}]\p{L}')) >= 20 AS symbols FROM documents""")
def broken(spark, d):
    """TXT-24: texts with many symbols beside letters."""
    return table(spark, d, "documents").select("doc_id", (X.symbol_marks(F.replace("text", F.lit("a"), F.lit("|"))) >= 20).alias("symbols"))


@query("agg11_vocabulary", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY 1")
def vocabulary(spark, d):
    """AGG-11."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    return table(spark, d, "documents").select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("agg17_partial_list", r"""SELECT regexp_extract(url, '://[^/?#]*/(..)', 1) AS part, count(n) AS numbered, max(n) AS top, count(n) >= 2 AND max(n) >= 20 AND count(n) < max(n) / 2 AS partial FROM (SELECT url, try_cast(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS n FROM pages) GROUP BY 1""")
def partial_list(spark, d):
    """AGG-17, AGG-24."""
    n = F.regexp_extract("url", r"/(\d+)", 1).try_cast("long")
    x = table(spark, d, "pages").select(F.regexp_extract("url", "://[^/?#]*/(..)", 1).alias("part"), n.alias("n"))
    g = x.groupBy("part").agg(F.count("n").alias("numbered"), F.max("n").alias("top"))
    return g.withColumn("partial", (F.col("numbered") >= 2) & (F.col("top") >= 20) & (F.col("numbered") < F.col("top") / 2))


@query("fn28_keys", """SELECT doc_id, sha1(CAST(to_json(string_split(text, chr(10))) AS VARCHAR)) AS key, sha1('[' || CAST(to_json(lang) AS VARCHAR) || ',["' || source || '"],' || CAST(to_json(string_split(text, chr(10))) AS VARCHAR) || ']') AS board FROM documents""")
def keys(spark, d):
    """FN-28: keys of each document's lines, alone and with a cast list."""
    parts = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", V.parts_key(parts).alias("key"), V.storyboard_key(F.col("lang"), F.array("source"), parts).alias("board"))


@query("fn40_narratable", """SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END, ''), 'vi') = 'vi' AS narratable, CASE WHEN source LIKE '%5' THEN 14100 ELSE 39600 END AS seconds FROM documents""")
def narratable(spark, d):
    """FN-40: works without a language count as Vietnamese; the longest part depends on the platform."""
    language = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang"))
    platform = F.when(F.col("source").endswith("5"), "facebook").otherwise("youtube")
    return table(spark, d, "documents").select("doc_id", V.narratable(language).alias("narratable"), V.part_seconds(platform).alias("seconds"))


@query("fn29_kinds", """SELECT doc_id, CASE WHEN length(text) >= 12 THEN (['wav', 'flac', 'ogg', 'm4a', 'mp3', 'mp3', NULL, NULL])[doc_id % 8 + 1] END AS audio, CASE WHEN doc_id % 8 = 6 AND length(text) >= 12 THEN 'webp' END AS image FROM documents""")
def kinds(spark, d):
    """FN-29: kinds of sound and pictures by the first bytes, put before each document; of a short one only four are left."""
    heads = ["52494646 00000000 57415645", "664C6143", "4F676753", "00000018 66747970", "494433", "FFFB90", "52494646 00000000 57454250", ""]
    head = F.unhex(F.get(F.array(*[F.lit(h.replace(" ", "")) for h in heads]), (F.col("doc_id") % 8).cast("int")))
    whole = F.when(F.length("text") < 12, F.substring(head, 1, 4)).otherwise(F.concat(head, F.encode("text", "UTF-8")))
    return table(spark, d, "documents").select("doc_id", V.audio_kind(whole).alias("audio"), V.image_kind(whole).alias("image"))


@query("fn09_titles", r"""WITH p AS (SELECT p_partkey, p_name AS listed, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || '  and  more ' WHEN 1 THEN substr(p_name, 2) || ' other' WHEN 2 THEN p_name END AS found FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN trim(regexp_replace(found, '\s+', ' ', 'g')) ELSE listed END AS title FROM p""")
def titles(spark, d):
    """FN-09: a page's title is taken where it goes on from the listed one."""
    i = F.col("p_partkey") % 4
    found = F.when(i == 0, F.concat(F.upper("p_name"), F.lit("  and  more "))).when(i == 1, F.concat(F.expr("substr(p_name, 2)"), F.lit(" other"))).when(i == 2, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.chosen_title(F.col("p_name"), found).alias("title"))

