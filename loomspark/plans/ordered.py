"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from ..sources.tables import seconds_of, table
from .registry import query

_KEY = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
_SQL_KEY = ", ".join(_KEY)
_SEG = f"seg AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SQL_KEY}) AS i, l_quantity AS q, l_partkey AS p, l_suppkey AS s FROM lineitem)"


#: So many rows go to a task, which sorts them in some 100 MB.
_TASK_ROWS = 500_000


def tasks(spark, d, **times):
    """Over how many tasks the rows of the given tables are dealt, each so many times; Parquet files tell their rows."""
    rows = sum(n * table(spark, d, name).count() for name, n in times.items())
    return max(spark.sparkContext.defaultParallelism, rows // _TASK_ROWS + 1)


def segments(spark, d):
    """(k, i, q, p, s): lineitems of an order, numbered in a total order."""
    from pyspark.sql.window import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_KEY))
    dealt = table(spark, d, "lineitem").select("l_orderkey", *_KEY).repartition(tasks(spark, d, lineitem=1), "l_orderkey")
    return dealt.select(F.col("l_orderkey").alias("k"), i.alias("i"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("chars"), "role")


@query("win01_toc", f"WITH {_SEG} SELECT k, i, coalesce(sum(q) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM seg")
def toc(spark, d):
    """WIN-01, WIN-03: cumulative table of contents."""
    return O.running_start(segments(spark, d), ["k"], ["i"], "q").select("k", "i", "start")


@query("win02_timeline", """WITH p AS (SELECT conv_id, turn, length(text) AS chars, CAST(60 AS DOUBLE) AS seconds FROM conversations),
s AS (SELECT conv_id, turn, chars, greatest(CAST(0 AS DOUBLE), seconds - CAST(0.35 AS DOUBLE) * count(*) OVER (PARTITION BY conv_id)) AS speech, greatest(sum(chars) OVER (PARTITION BY conv_id), 1) AS total,
 coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM p)
SELECT conv_id, turn, floor(speech * before / total + CAST(0.35 AS DOUBLE) * i) AS start, floor(speech * before / total + CAST(0.35 AS DOUBLE) * i + speech * chars / total - 0.0001) AS "end" FROM s""")
def timeline(spark, d):
    """WIN-02, here to whole seconds, of the exact times: one just below a second is not rounded up to it first."""
    parts = O.estimated_timeline(turns(spark, d).withColumn("seconds", F.lit(60.0)), ["conv_id"], ["turn"], "chars", "seconds", exact=True)
    return parts.select("conv_id", "turn", F.floor("start").cast("double").alias("start"), F.floor(F.col("end") - 0.0001).cast("double").alias("end"))


@query("win04_ranges", f"WITH {_SEG}, b AS (SELECT k, i * 10 AS page FROM seg) SELECT k, page, coalesce(lead(page) OVER (PARTITION BY k ORDER BY page) - 1, 999) AS until FROM b")
def ranges(spark, d):
    """WIN-04, WIN-07: each chapter reaches to the next one's page."""
    return O.lead_ranges(segments(spark, d).select("k", (F.col("i") * 10).alias("page")), ["k"], "page", F.lit(999))


@query("win05_increasing", f"WITH {_SEG}, x AS (SELECT k, i, p, lag(p) OVER (PARTITION BY k ORDER BY i DESC) AS b FROM seg) SELECT k, i, p FROM x WHERE b IS NULL OR p > b")
def increasing(spark, d):
    """WIN-05."""
    return O.strictly_increasing(segments(spark, d), ["k"], [F.desc("i")], "p").select("k", "i", "p")


@query("win06_runs", """WITH x AS (SELECT user_id, event_id, event_type, lead(event_type) OVER w AS n, lead(true) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, event_type FROM x WHERE m IS NULL OR n IS DISTINCT FROM event_type""")
def runs(spark, d):
    """WIN-06."""
    return O.last_of_runs(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("win08_padded", f"WITH {_SEG} SELECT k, i, lpad(CAST(i AS VARCHAR), greatest(3, length(CAST(i AS VARCHAR)))::INT, '0') AS name, length(CAST(max(i) OVER (PARTITION BY k) AS VARCHAR)) AS width FROM seg")
def padded(spark, d):
    """WIN-08, WIN-16."""
    from pyspark.sql.window import Window

    text = F.col("i").cast("string")
    width = F.length(F.max("i").over(Window.partitionBy("k")).cast("string")).cast("long")
    return segments(spark, d).select("k", "i", F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0")).alias("name"), width.alias("width"))


@query("win09_unique_names", """WITH x AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n, p_brand FROM part)
SELECT p_partkey, CASE WHEN n = 1 THEN p_type ELSE p_type || ' (' || n || ')' END AS name FROM x""")
def names(spark, d):
    """WIN-09, SNK-15."""
    return O.unique_names(table(spark, d, "part"), ["p_brand"], ["p_partkey"], "p_type", "name").select("p_partkey", "name")


@query("win10_position", """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS position,
 lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_order, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous_order FROM orders""")
def position(spark, d):
    """WIN-10, WIN-17."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("position"), F.lead("o_orderkey").over(w).alias("next_order"), F.lag("o_orderkey").over(w).alias("previous_order"))


@query("win11_schedule", """SELECT o_orderkey, strftime(DATE '2024-01-01' + CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 3) AS INT), '%Y-%m-%d') AS day FROM orders""")
def scheduled(spark, d):
    """WIN-11, FN-36."""
    got = O.schedule(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], F.to_date(F.lit("2024-01-01")), 3)
    return got.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("win14_contiguous", f"""WITH {_SEG}, x AS (SELECT k, i, s % 3 AS w, coalesce(lag(i + s % 3) OVER (PARTITION BY k ORDER BY i), 0) + 1 AS want FROM seg)
SELECT k, count(*) FILTER (i <> want) AS breaks FROM x GROUP BY k""")
def contiguous(spark, d):
    """WIN-14: how often a scene doesn't begin where the one before ends."""
    from pyspark.sql.window import Window

    reach = F.lag(F.col("i") + F.col("s") % 3).over(Window.partitionBy("k").orderBy("i"))
    x = segments(spark, d).withColumn("want", F.coalesce(reach, F.lit(0)) + 1)
    return x.groupBy("k").agg(F.count_if(F.col("i") != F.col("want")).alias("breaks"))


@query("win15_numeric_sort", """SELECT page_id, row_number() OVER (ORDER BY coalesce(try_cast(regexp_extract(url, 'page=(\\d+)', 1) AS BIGINT), 0), coalesce(try_cast(regexp_extract(url, '/(\\d+)', 1) AS BIGINT), 9007199254740991), page_id) AS place FROM pages""".replace("\\\\", "\\"))
def numeric_sort(spark, d):
    """WIN-15."""
    part = lambda p: F.regexp_extract("url", p, 1).try_cast("long")
    order = [F.coalesce(part(r"page=(\d+)"), F.lit(0)), F.coalesce(part(r"/(\d+)"), F.lit(2**53 - 1)), F.col("page_id")]
    keyed = table(spark, d, "pages").select("page_id", *[c.alias(f"k{i}") for i, c in enumerate(order)])
    return O.numbered(keyed, [(f"k{i}", True) for i in range(len(order))]).select("page_id", "place")


@query("ded01_first_seen", f"WITH {_SEG} SELECT k, p % 5 AS u, min(i) AS i FROM seg GROUP BY ALL")
def first_seen(spark, d):
    """DED-01, DED-02, SRC-20."""
    return O.first_seen(segments(spark, d).withColumn("u", F.col("p") % 5), ["k", "u"], ["i"]).select("k", "u", "i")


@query("ded03_distinct_words", "SELECT item_id, length(list_aggregate(list_distinct(string_split(text, ' ')), 'string_agg', '')) AS n, len(list_distinct(string_split(text, ' '))) AS words FROM benchmark")
def distinct_words(spark, d):
    """DED-03, FN-34."""
    words = F.array_distinct(F.split("text", " "))
    return table(spark, d, "benchmark").select("item_id", F.length(F.array_join(words, "")).cast("long").alias("n"), F.size(words).cast("long").alias("words"))


@query("top01_best", """WITH g AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) AS size FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY size DESC, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_tax, l_discount, l_quantity) AS n FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, size FROM r WHERE n = 1""")
def best(spark, d):
    """TOP-01, AGG-15: of releases with one number the largest group's, then the earliest."""
    from pyspark.sql.window import Window

    sized = table(spark, d, "lineitem").withColumn("size", F.count("*").over(Window.partitionBy("l_orderkey", "l_suppkey")))
    order = [F.desc("size"), "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_discount", "l_quantity"]
    return O.best_per_key(sized, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "size")


@query("top02_strongest", f"WITH {_SEG}, r AS (SELECT k, i, q, row_number() OVER (PARTITION BY k ORDER BY q DESC, i) AS n FROM seg) SELECT k, i, q FROM r WHERE n <= 2")
def strongest(spark, d):
    """TOP-02."""
    return O.best_per_key(segments(spark, d), ["k"], [F.desc("q"), "i"], 2).select("k", "i", "q").orderBy("k", "i")


@query("top03_pick", "SELECT n_regionkey, arg_min(n_name, (length(n_name), n_nationkey)) AS n_name FROM nation GROUP BY 1")
def pick(spark, d):
    """TOP-03, TOP-04, AGG-16."""
    order = [F.length("n_name"), "n_nationkey"]
    return O.best_per_key(table(spark, d, "nation"), ["n_regionkey"], order).select("n_regionkey", "n_name")


@query("top07_per_host", """WITH h AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) SELECT host, arg_min(url, page_id) AS url, count(DISTINCT url) AS urls FROM h GROUP BY 1""")
def per_host(spark, d):
    """TOP-07."""
    p = table(spark, d, "pages").withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1))
    return p.groupBy("host").agg(F.min_by("url", "page_id").alias("url"), F.countDistinct("url").alias("urls"))


@query("top08_excerpt", """WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, substr(string_agg(text, chr(10) ORDER BY turn), 1, 500) AS excerpt FROM r WHERE n <= 3 GROUP BY 1""")
def excerpt(spark, d):
    """TOP-08: the first three turns, cut at 500 characters."""
    head = O.best_per_key(table(spark, d, "conversations"), ["conv_id"], ["turn"], 3)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")  # three rows
    return head.groupBy("conv_id").agg(F.substring(text, 1, 500).alias("excerpt"))


@query("join15_as_of", """WITH v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL)
SELECT e.event_id, v.value AS active FROM (SELECT * FROM events WHERE event_type <> (SELECT min(event_type) FROM events)) e ASOF LEFT JOIN v ON e.user_id = v.user_id AND v.ts <= e.ts""")
def as_of(spark, d):
    """JOIN-15, JOIN-16."""
    e = table(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("kind"))
    marked = e.join(F.broadcast(kind)).withColumn("is", F.col("event_type") == F.col("kind"))  # one row
    left = marked.filter("not is").select("event_id", "user_id", "ts")
    right = marked.filter("is").select("user_id", F.col("ts").alias("since"), F.col("value").alias("active"))
    return O.as_of(left, right, ["user_id"], "ts", "since", "active").select("event_id", "active")


@query("join17_nearest", f"""WITH {_SEG}, iv AS (SELECT k, i AS idx, s AS lo, s + 5 AS hi, p % 2 = 0 AS preferred FROM seg), pt AS (SELECT o_orderkey AS k, o_custkey % 100 AS "at" FROM orders),
x AS (SELECT k, "at", idx, greatest(0, lo - "at", "at" - hi) AS distance, row_number() OVER (PARTITION BY k, "at" ORDER BY preferred DESC, greatest(0, lo - "at", "at" - hi), idx) AS n FROM pt JOIN iv USING (k))
SELECT k, "at", idx, distance FROM x WHERE n = 1""")
def nearest(spark, d):
    """JOIN-17."""
    iv = segments(spark, d).select("k", F.col("i").alias("idx"), F.col("s").alias("lo"), (F.col("s") + 5).alias("hi"), (F.col("p") % 2 == 0).alias("preferred"))
    pt = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 100).alias("at"))
    return O.nearest_interval(pt, iv, ["k"], "at", [], tasks(spark, d, lineitem=1, orders=1))


@query("txt31_slides", f"""WITH {_SEG}, iv AS (SELECT k, i AS idx, (i - 1) * 40.0 AS lo, i * 40.0 - 5 AS hi, p % 2 = 0 AS preferred FROM seg), c AS (SELECT o_orderkey AS k, o_custkey % 300 AS seconds FROM orders),
t AS (SELECT k, seconds, unnest(CASE WHEN seconds >= 90 THEN [0, 1] ELSE [0] END) AS slide FROM c), a AS (SELECT *, seconds * CASE WHEN seconds < 90 THEN 0.5 WHEN slide = 0 THEN 0.25 ELSE 0.75 END AS sec FROM t),
x AS (SELECT k, slide, idx, seconds, row_number() OVER (PARTITION BY k, slide ORDER BY preferred DESC, greatest(0, lo - sec, sec - hi), idx) AS n FROM a JOIN iv USING (k))
SELECT k, slide, idx, CASE WHEN seconds >= 90 THEN seconds / 2 ELSE seconds END AS shown FROM x WHERE n = 1""")
def slides(spark, d):
    """TXT-31: one slide at a chapter's middle, or two at its quarters."""
    iv = segments(spark, d).select("k", F.col("i").alias("idx"), ((F.col("i") - 1) * 40.0).alias("lo"), (F.col("i") * 40.0 - 5).alias("hi"), (F.col("p") % 2 == 0).alias("preferred"))
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 300).cast("double").alias("seconds"))
    return O.slides(c, iv, ["k"], "seconds", tasks(spark, d, lineitem=1, orders=2))


@query("lim02_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 100")
def paged(spark, d):
    """LIM-02."""
    return O.page(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 2, 100)


@query("srt02_multi", "SELECT p_partkey, row_number() OVER (ORDER BY p_brand DESC, p_size, p_partkey) AS place FROM part")
def multi_sort(spark, d):
    """SRT-02, SRT-04."""
    return O.numbered(table(spark, d, "part"), [("p_brand", False), ("p_size", True), ("p_partkey", True)]).select("p_partkey", "place")


_TITLES = "Ấm ấm am Ầm đá da Đa dạ ê e Ế ể ơ ô o Ở ư u Ừ zebra Ánh anh ảnh Y ý ỷ".split()


@query("srt02_vietnamese", f"""WITH t AS (SELECT p_partkey, p_size, {_TITLES!r}[p_partkey % {len(_TITLES)} + 1] || ' ' || p_brand AS title FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY title COLLATE vi, p_size DESC, p_partkey) AS up, row_number() OVER (ORDER BY title COLLATE vi DESC, p_size, p_partkey) AS down FROM t""")
def vietnamese(spark, d):
    """SRT-02: titles in Vietnamese order, then sizes, both ways."""
    title = F.concat(F.get(F.array(*[F.lit(t) for t in _TITLES]), (F.col("p_partkey") % len(_TITLES)).cast("int")), F.lit(" "), F.col("p_brand"))
    p = table(spark, d, "part").select("p_partkey", "p_size", title.alias("title"))
    up = O.numbered(p, [("title", True, "vi"), ("p_size", False), ("p_partkey", True)], "up").select("p_partkey", "up")
    down = O.numbered(p, [("title", False, "vi"), ("p_size", True), ("p_partkey", True)], "down").select("p_partkey", "down")
    return up.join(down, "p_partkey")


@query("str07_rate_limit", """WITH RECURSIVE x AS (SELECT user_id, event_id, epoch(ts) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT user_id, event_id, i, "at" AS slot FROM x WHERE i = 1 UNION ALL SELECT x.user_id, x.event_id, x.i, greatest(x."at", s.slot + 20000.0) FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i + 1)
SELECT event_id, round(slot, 1) AS slot FROM s""")
def rate_limit(spark, d):
    """STR-07."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", seconds_of("ts").alias("at"))
    return O.rate_limited(e, ["user_id"], ["ts", "event_id"], "at", 20000.0).select("event_id", F.round("slot", 1).alias("slot"))


@query("agg27_largest_gap", """WITH g AS (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS g, value FROM events)
SELECT user_id, round(CASE WHEN count(*) = 1 AND max(value) > 20 THEN max(value) ELSE max(g) END, 3) AS gap FROM g GROUP BY 1""")
def largest_gap(spark, d):
    """AGG-27."""
    e = table(spark, d, "events").select("user_id", seconds_of("ts").alias("at"), "value")
    return O.largest_gap(e, ["user_id"], "at", "value").select("user_id", F.round("gap", 3).alias("gap"))


@query("agg08_upper_median", "WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, l_quantity AS median FROM r WHERE i = floor(n / 2)")
def upper_median(spark, d):
    """AGG-08."""
    return O.upper_median(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity")


@query("agg06_weighted_mode", """WITH t AS (SELECT l_orderkey, l_linenumber AS v, sum(l_quantity) AS w, min(l_partkey) AS s FROM lineitem GROUP BY ALL)
SELECT l_orderkey, arg_max(v, (w, -s)) AS mode FROM t GROUP BY 1""")
def weighted_mode(spark, d):
    """AGG-06, AGG-07, AGG-13."""
    return O.weighted_mode(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity", "l_partkey")


@query("agg04_eta", """WITH a AS (SELECT user_id, count(*) FILTER (event_type <> 'purchase') AS done, count(*) AS total, epoch(max(ts)) - epoch(min(ts)) AS elapsed FROM events GROUP BY 1)
SELECT user_id, CASE WHEN done >= 3 AND done < total AND elapsed > 0 THEN CAST(floor(elapsed / done * (total - done) + 0.5) AS BIGINT) END AS eta FROM a""")
def eta(spark, d):
    """AGG-04, AGG-05."""
    seconds = seconds_of("ts")
    a = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "purchase").alias("done"), F.count("*").alias("total"), (F.max(seconds) - F.min(seconds)).alias("elapsed"))
    left = F.floor(F.col("elapsed") / F.col("done") * (F.col("total") - F.col("done")) + 0.5)
    return a.select("user_id", F.when((F.col("done") >= 3) & (F.col("done") < F.col("total")) & (F.col("elapsed") > 0), left).alias("eta"))
