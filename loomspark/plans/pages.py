"""Queries over page sources, links, fragments and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.pagehtml import parsed
from ..operators import pages as P
from ..sources.tables import table
from .ordered import _SEG, segments
from .registry import query


@query("txt08_missed_links", r"""WITH l AS (SELECT page_id, pos, 'https://h.org/t/' || conv || '/' || pos AS url FROM (SELECT conv_id AS page_id, conv_id AS conv, turn AS pos FROM conversations))
SELECT page_id, url, 'T' || pos AS title FROM l WHERE pos % 3 = 2""")
def missed(spark, d):
    """TXT-08, SET-02, AGG-16: links of the common shape that the list lacks."""
    c = table(spark, d, "conversations")
    url = F.concat(F.lit("https://h.org/t/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    links = c.select(F.col("conv_id").alias("page_id"), F.lit("https://www.h.org/").alias("page_url"), F.col("turn").alias("pos"), F.concat(url, F.lit("#top")).alias("url"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("title"))
    other = links.filter("pos = 0").withColumn("url", F.lit("https://h.org/about"))
    return P.missed_links(links.unionByName(other), c.filter("turn % 3 <> 2").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("pos"), url.alias("url")))


@query("src14_json", "SELECT doc_id, text AS page FROM documents")
def embedded(spark, d):
    """SRC-14: the value of a key in JSON that is inside a page."""
    inner = F.to_json(F.struct(F.struct(F.lit(1).alias("n"), F.col("text").alias("page")).alias("a"), F.lit('"page').alias("b")))
    html = F.concat(F.lit('<p>"page": none</p><script>var x = '), inner, F.lit(";</script>"))
    return table(spark, d, "documents").select("doc_id", P.json_text(html, "page").alias("page"))


@query("src15_calls", "SELECT c.conv_id AS id, CAST(c.turn AS INT) AS page, c.turn % 2 = 0 AS blurred, 'u' || c.turn AS url FROM conversations c")
def calls(spark, d):
    """SRC-15."""
    t = F.col("turn").cast("string")
    call = F.concat(F.lit("addPage({pageNum: "), t, F.when(F.col("turn") % 2 == 0, ", blur: true").otherwise(""), F.lit(', contentUrl: "u'), t, F.lit('"});'))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat_ws("\n", F.collect_list(call)).alias("html"))  # the turns of one dialogue
    return P.repeated_calls(c, "conv_id", "html")


@query("txt18_hardcoded", r"""WITH x AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, list_filter(list_concat(string_split(p, '/'), regexp_extract_all(q, '=([^&]*)', 1)), lambda v: length(v) >= 4 AND (regexp_matches(v, '\d') OR length(v) - length(replace(v, '-', '')) >= 2))[1] AS part FROM x""")
def hardcoded(spark, d):
    """TXT-18."""
    return table(spark, d, "pages").select("page_id", P.hardcoded(F.concat(F.lit("fetch("), F.col("url"), F.lit(")")), F.col("url")).alias("part"))


@query("txt19_media", "SELECT doc_id, '<img src=\"epub-media/s1/' || doc_id || '.png\">' AS stored, '<img src=\"/api/stories/s1/media/' || doc_id || '.png\">' AS shown FROM documents")
def media(spark, d):
    """TXT-19: markers to addresses and back."""
    stored = F.concat(F.lit('<img src="epub-media/s1/'), F.col("doc_id").cast("string"), F.lit('.png">'))
    got = table(spark, d, "documents").select("doc_id", P.resolved_media(stored, "s1").alias("shown"))
    return got.select("doc_id", P.restored_media(F.replace("shown", F.lit("/api"), F.lit("http://localhost:1/api")), "s1").alias("stored"), "shown")


@query("agg18_coverage")
def coverage(spark, d):
    """AGG-18, AGG-19: pages of which too little was kept."""
    got = parsed(table(spark, d, "pages"), "page_id", "url", "html").join(table(spark, d, "pages").select("page_id", F.length("html").alias("whole")), "page_id")
    kept = F.aggregate(F.transform("blocks", lambda b: F.coalesce(F.length(b["text"]), F.lit(0))), F.lit(0), lambda a, n: a + n)
    return got.select("page_id", kept.alias("kept"), P.too_little_kept(kept, F.col("whole")).alias("missing"))


@query("txt30_highlights", "SELECT doc_id, CASE WHEN length(text) >= 25 THEN substr(text, 11, 15) END AS marked FROM documents")
def highlights(spark, d):
    """TXT-30."""
    return table(spark, d, "documents").select("doc_id", P.highlight_text(F.col("text"), F.lit(10), F.lit(25)).alias("marked"))


@query("src07_highlights", """WITH h AS (SELECT conv_id AS story, turn AS chapter, unnest([40, 3, 11]) AS start, unnest([60, 3 + turn, 25]) AS stop, text FROM conversations),
k AS (SELECT story, chapter, start, stop, substr(text, start + 1, stop - start) AS marked FROM h WHERE stop > start AND stop <= length(text))
SELECT *, CAST(row_number() OVER (PARTITION BY story ORDER BY chapter, start, stop) AS INT) AS place FROM k""")
def highlight_scan(spark, d):
    """SRC-07: the highlights of a dialogue in reading order; those outside of their turn's text are left out."""
    ranges = F.array(F.struct(F.lit(40).alias("start"), F.lit(60).cast("long").alias("stop")), F.struct(F.lit(3).alias("start"), (F.col("turn") + 3).alias("stop")), F.struct(F.lit(11).alias("start"), F.lit(25).cast("long").alias("stop")))
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("story"), F.col("turn").alias("chapter"), "text", F.explode(ranges).alias("r"))
    return P.highlight_scan(c.select("story", "chapter", "text", "r.start", "r.stop"), "story", "chapter", "start", "stop", "text")


@query("src16_rows", f"""WITH RECURSIVE {_SEG}, f AS (SELECT k, p AS x, q * 3 AS y, s, row_number() OVER (PARTITION BY k ORDER BY q * 3, p) AS n FROM seg),
r AS (SELECT k, n, y AS y0, 0 AS line FROM f WHERE n = 1
UNION ALL SELECT f.k, f.n, CASE WHEN abs(f.y - r.y0) > 5 THEN f.y ELSE r.y0 END, CASE WHEN abs(f.y - r.y0) > 5 THEN r.line + 1 ELSE r.line END FROM r JOIN f ON f.k = r.k AND f.n = r.n + 1)
SELECT CAST(k AS INT) AS page, line AS row, string_agg(CAST(s AS VARCHAR), ' ' ORDER BY x, y, CAST(s AS VARCHAR)) AS text, CAST(10 AS DOUBLE) AS size FROM r JOIN f USING (k, n) GROUP BY k, line""")
def rows(spark, d):
    """SRC-16, TXT-20: fragments of a page clustered into rows."""
    f = segments(spark, d).select(F.col("k").cast("int").alias("page"), F.col("p").cast("double").alias("x"), (F.col("q") * 3).alias("y"), F.lit(10.0).alias("size"), F.col("s").cast("string").alias("text"))
    return P.text_rows(f)


@query("pck04_chunks", r"""WITH RECURSIVE t AS (SELECT conv_id, text, len(regexp_extract_all(text, '[^\s]+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations),
c AS (SELECT conv_id, i, text, w, w AS held, 1 AS chunk FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.i, t.text, t.w, CASE WHEN c.held + t.w > 400 THEN t.w ELSE c.held + t.w END, c.chunk + (c.held + t.w > 400)::INT FROM c JOIN t ON t.conv_id = c.conv_id AND t.i = c.i + 1)
SELECT conv_id, chunk - 1 AS chunk, count(*) AS n, string_agg(text, chr(10) ORDER BY i) AS text FROM c GROUP BY conv_id, chunk""")
def chunks(spark, d):
    """PCK-04: a dialogue's turns packed into chunks of 400 words."""
    return P.paragraph_chunks(table(spark, d, "conversations"), "conv_id", ["turn"], "text", 400)


@query("top03_files", """SELECT l_orderkey AS item, arg_min(l_partkey, (CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END, l_quantity, l_partkey)) AS name FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity <= 40 AND l_linestatus <> 'O' GROUP BY 1""")
def files(spark, d):
    """TOP-03, FLT-07."""
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("name"), F.col("l_returnflag").alias("format"), F.col("l_quantity").alias("size"), (F.col("l_linestatus") == "O").alias("private"))
    return P.best_files(f, {"A": 1, "R": 2}, 40).select("item", "name")


@query("join11_previous", f"""WITH {_SEG}, plan AS (SELECT k, min(i) AS f, max(i) AS t FROM seg GROUP BY 1) SELECT k, f AS from_order, t AS to_order, CASE WHEN t > 2 THEN 'x' || k END AS previous FROM plan""")
def previous(spark, d):
    """JOIN-11."""
    plan = segments(spark, d).groupBy("k").agg(F.min("i").alias("from_order"), F.max("i").alias("to_order")).withColumn("part", F.col("k"))
    done = plan.filter("to_order > 2").select("from_order", "to_order", "part", F.concat(F.lit("x"), F.col("k").cast("string")).alias("file"))
    return P.previous_match(plan, done).select("k", "from_order", "to_order", "previous")


@query("fn26_links_absolute", r"""WITH x AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o, regexp_extract_all(regexp_replace(html, '<script.*?</script>', '', 'gs'), '<a href="([^"]+)">[^<]*</a>', 1) AS h FROM pages)
SELECT page_id, generate_subscripts(h, 1) - 1 AS pos, o || unnest(h) AS url FROM x""")
def absolute(spark, d):
    """FN-26, TXT-07: addresses of all links against the page's own."""
    got = parsed(table(spark, d, "pages"), "page_id", "url", "html")
    return got.select("page_id", F.posexplode("links").alias("pos", "l")).select("page_id", "pos", "l.url")


@query("flt13_schedule", "SELECT event_id, value * 10000 BETWEEN 600 AND 2592000 AS ok FROM events")
def publishable(spark, d):
    """FLT-13."""
    return table(spark, d, "events").select("event_id", V.publish_window(F.col("value") * 10000).alias("ok"))
