"""URL filters: given host and path rules, then association rules over URL tokens mined with Spark's FP-growth."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dropped, free_name, read, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or without "://"."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _ends(host: Column) -> Column:
    """The host and what is left of it after each dot."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def tokens_of(url: Column) -> Column:
    """The set of a URL's tokens: scheme, host ends, host labels, path words, extension, query names and pairs, fragment.

    Numbers become their length, so that page numbers don't make tokens of their own.
    """
    rest = F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(rest, r"(?s)^\?([^#]*)", 1)
    tagged = lambda tag, items: F.transform(items, lambda x: F.concat(F.lit(tag), x))
    masked = lambda x: F.regexp_replace(x, r"^\d+", F.concat(F.lit("#"), F.length(F.regexp_extract(x, r"^(\d+)", 1)).cast("string")))
    words = F.filter(F.split(path, "/"), lambda x: x != "")
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    all_ = F.concat(
        tagged("s:", F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^([A-Za-z][\w+.-]*)://", 1))),
        tagged("d:", _ends(host)),
        tagged("h:", F.split(host, r"[.-]")),
        tagged("p:", F.transform(words, lambda x: masked(F.regexp_replace(x, r"\.\w+$", "")))),
        tagged("x:", F.transform(words, lambda x: F.regexp_extract(x, r"\.(\w+)$", 1))),
        tagged("q:", F.transform(pairs, lambda x: F.regexp_extract(x, r"^([^=]*)", 1))),
        tagged("v:", F.transform(pairs, masked)),
        tagged("f:", F.array(F.regexp_extract(rest, r"#(.+)$", 1))),
    )
    return F.array_sort(F.array_distinct(F.filter(all_, lambda x: F.length(x) > 2)))


def _counted(itemsets: DataFrame, urls: DataFrame) -> DataFrame:
    """``itemsets`` (tokens) with rows, hits, held_rows and held_hits: URLs that hold all their tokens, and blocked ones.

    urls: (own, blocked, held). An itemset is listed under the one of its tokens that the fewest URLs have, so a URL meets
    only the itemsets that its own tokens list.
    """
    use = urls.select(F.explode("own").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    keyed = itemsets.select("tokens", F.explode("tokens").alias("t")).join(use, "t", "left").groupBy("tokens").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t")).alias("k"))
    spread = urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), "own")  # few URLs can meet many itemsets
    met = spread.withColumn("t", F.explode("own")).join(keyed.select("tokens", F.col("k.t").alias("t")), "t").filter(F.size(F.array_except("tokens", "own")) == 0)
    one = lambda c: F.count_if(c)
    return met.groupBy("tokens").agg(
        one(~F.col("held")).alias("rows"), one(~F.col("held") & F.col("blocked")).alias("hits"), one(F.col("held")).alias("held_rows"), one(F.col("held") & F.col("blocked")).alias("held_hits")
    )


def mine(labelled: DataFrame, min_support: float = 0.002, min_rows: int = 8, min_confidence: float = 0.5, min_lift: float = 2.0, false_rules: float = 0.05) -> DataFrame:
    """Rules (tokens, confidence, support, lift) for blocking, from (url, blocked).

    Two thirds of the URLs (by their hash) are mined, with FP-growth over the blocked ones: an itemset needs ``min_support``
    of the mined URLs and ``min_rows`` of them. Tokens that the same URLs have are one, so itemsets don't multiply.
    Confidence and lift are then counted over all mined URLs. A rule stands if it holds on the other third too: with
    confidence and lift there, and with a Wilson bound above the rate of blocked URLs, at a level at which all candidates
    together give ``false_rules`` wrong rules. A rule goes when a rule of fewer of its tokens has at least its confidence.
    Rows whose label or URL is null don't count; equal URLs are one, blocked if most of their rows are. With fewer than
    ``min_rows`` blocked URLs there are no rules.
    """
    spark = labelled.sparkSession
    known = labelled.filter("blocked is not null and url is not null").groupBy("url").agg((F.avg(F.col("blocked").cast("int")) > 0.5).alias("blocked"))
    known = known.select(F.xxhash64("url").alias("u"), "blocked", (F.pmod(F.xxhash64("url"), F.lit(3)) == 0).alias("held"), tokens_of(F.col("url")).alias("own"))
    rows = written(known, "labelled")
    n, hits, held, held_hits = rows.agg(F.count_if(~F.col("held")), F.count_if(~F.col("held") & F.col("blocked")), F.count_if(F.col("held")), F.count_if(F.col("held") & F.col("blocked"))).first()
    if hits < max(1, min_rows) or not held_hits:
        dropped(rows)
        return spark.createDataFrame([], "tokens array<string>, confidence double, support double, lift double")
    least = max(min_support * n, min_rows)
    each = rows.filter("not held").select("u", "blocked", F.explode("own").alias("t"))
    sets = each.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.col("u") % (1 << 40)).alias("sum"), F.count_if("blocked").alias("hits")).filter(F.col("hits") >= least)
    apart = sets.groupBy("n", "sum").agg(F.min("t").alias("t")).select("t")
    items = each.filter("blocked").join(apart, "t").groupBy("u").agg(F.collect_set("t").alias("items"))  # the tokens of one URL
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / hits), numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(items)
    itemsets = written(model.freqItemsets.filter(F.col("freq") >= least).select(F.array_sort("items").alias("tokens")), "itemsets")
    counted = _counted(itemsets, rows).withColumns({"confidence": F.col("hits") / F.col("rows"), "support": F.col("hits") / n})
    counted = counted.withColumn("lift", F.col("confidence") / (hits / n))
    rules = written(counted.filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)), "rules")
    z = NormalDist().inv_cdf(1 - false_rules / max(1, rules.count()))
    share, size = F.col("held_hits") / F.col("held_rows"), F.col("held_rows")
    bound = (share + z * z / (2 * size) - z * F.sqrt(share * (1 - share) / size + z * z / (4 * size * size))) / (1 + z * z / size)
    rate = held_hits / held
    holds = (size > 0) & (share >= min_confidence) & (share >= min_lift * rate) & (bound > rate)
    rules = written(rules.filter(holds).select("tokens", "confidence", "support", "lift"), "rules")
    dropped(rows, itemsets)
    # a shorter rule can only be within a longer one that has its rarest token
    use = rules.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    short = rules.select("tokens", F.col("confidence").alias("least"), F.explode("tokens").alias("t")).join(use, "t").groupBy(F.col("tokens").alias("part"), "least").agg(F.min(F.struct("n", "t")).alias("k"))
    parts = rules.select("tokens", "confidence", F.explode("tokens").alias("t")).join(short.select("part", "least", F.col("k.t").alias("t")), "t")
    covered = parts.filter((F.size("part") < F.size("tokens")) & (F.col("least") >= F.col("confidence")) & (F.size(F.array_except("part", "tokens")) == 0))
    return rules.join(covered.select("tokens").distinct(), "tokens", "left_anti")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined, confidence): the most confident mined rule of each of the distinct ``urls`` that one matches.

    Inverted index: a rule is listed under the one of its tokens that the fewest rules have, so a URL meets only the
    rules listed under its tokens, and no URL is compared with all rules.
    """
    use = rules.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    keyed = rules.select("tokens", "confidence", F.explode("tokens").alias("t")).join(use, "t").groupBy("tokens", "confidence").agg(F.min(F.struct("n", "t")).alias("k"))
    index = keyed.select(F.col("k.t").alias("t"), F.col("tokens").alias("rule"), "confidence")
    met = urls.withColumn("own", tokens_of(F.col("url"))).withColumn("t", F.explode("own")).join(index, "t")
    hit = met.filter(F.size(F.array_except("rule", "own")) == 0)
    best = hit.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("rule", " ").alias("mined"))).alias("b"))
    return best.select("url", "b.mined", "b.confidence")


def judged(pages: DataFrame, given: Sequence[tuple[str, str, str]], labelled: DataFrame, url_col: str = "url", **limits) -> DataFrame:
    """``pages`` with host, path, rule, mined, confidence and verdict (allow or block); columns of these names are replaced.

    ``given``: (host, path, verdict). A given rule fits its host and all subdomains of it where the path begins with the
    rule's; the longest (host and path) wins, and its verdict stands. Else a mined rule that matches blocks, and a URL
    without one is allowed. rule is the given rule as text, else null. A null URL or one without "://" has an empty host
    and path and fits no rule. ``labelled``: (url, blocked) to mine from. Each distinct URL is judged once. Repeated
    rows are all returned.
    """
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "mined", "confidence", "verdict"}]
    urls = pages.select(F.col(f"`{url_col}`").alias("url")).filter("url is not null").distinct()
    split = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    listed = spark.createDataFrame([(h, p, v, h + p) for h, p, v in given], "end string, begin string, verdict string, rule string")
    fits = split.withColumn("end", F.explode(_ends(F.col("host")))).join(listed, "end").filter(F.col("path").startswith(F.col("begin")))
    fits = fits.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("f")).select("url", "f.rule", F.col("f.verdict").alias("said"))
    found = split.join(fits, "url", "left").join(matches(urls, mine(labelled, **limits)), "url", "left")
    name = free_name(pages, "_url")
    found = found.select(F.col("url").alias(name), "host", "path", "rule", "mined", "confidence", F.coalesce("said", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"))
    whole = pages.select(*[F.col(f"`{c}`") for c in keep]).join(found, F.col(f"`{url_col}`") == F.col(name), "left").drop(name)
    return whole.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")), "verdict": F.coalesce("verdict", F.lit("allow"))})


#: Fixed rules of the query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; mined rules block what goes with low quality or toxicity of the document that a URL's number names."""
    pages = read(spark, sf_dir, "pages")
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d+)(?:\D|$)", 1).try_cast("long")
    marks = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("blocked"))
    labelled = pages.select("url", number.alias("doc_id")).join(marks, "doc_id").select("url", "blocked")
    return judged(pages, RULES, labelled).select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")
