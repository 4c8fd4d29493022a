"""How filters interact: Hart-Mas-Colell potentials of the removal game, in SQL functions only.

Every document has a set of filters that it fails. In the removal game a coalition S of filters is worth the number of
documents that fail any of them. The potential is P({}) = 0, P(S) = (worth(S) + sum of P(S without i) over i in S) / |S|;
a filter's Shapley value is P(all) - P(all without it). What a filter removes at a step of an order is the difference
between the worths of the coalitions after and before it, so documents are counted once, by the set that they fail, and
no order is ever applied to them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import WORD, read

FILTERS = "ABCDE"
#: Orders and coalitions are listed in full, so there can't be many filters.
MOST_FILTERS = 7


def text_failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself; a null text is empty.

    A (1): under 200 words. B (2): under half of the words distinct (by case). C (4): over 3% of the code points in A-Z.
    D (8): holds one of ``#$%&*|``.
    """
    whole = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    few = F.size(words) < 200
    dull = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    loud = 100 * F.regexp_count(whole, F.lit("[A-Z]")) > 3 * F.char_length(whole)
    signs = whole.rlike(r"[#$%&*|]")
    return sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate((few, dull, loud, signs))), F.lit(0)).cast("int")


def counted_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, n, good, toxic): documents by the set of filters that they fail (the bits of `text_failures`, and E).

    E (16): the text is identical to that of a smaller id, whatever the part. A null id is smaller than none and has
    none before it; rows that repeat an id and its text are all counted, and none comes before another. ``labels`` has
    id_col, quality, toxic; an id with several rows there is good (toxic) if any of them says 1. A null part is "".
    Texts are compared by SHA-256. Copies are counted before they meet, so that a text of a third of all rows is no
    large group, and what a group of equal texts holds in the end is a row for each part and label.
    """
    text = F.col(f"`{text_col}`")
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), digest.alias("same"), text_failures(text).alias("fails"))
    said = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    rows = found.join(said, "id", "left").select("id", "part", "same", "fails", *known)
    kind = ["same", "part", "fails", "good", "toxic"]
    rows = rows.groupBy("id", *kind).agg(F.count("*").alias("n"))
    alike = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("lone"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("same"))
    ahead = F.col("lone") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    split = alike.select("part", "fails", "good", "toxic", "n", ahead.alias("ahead"))
    sides = F.array(F.struct(F.col("fails").alias("fails"), F.col("ahead").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("ahead")).alias("n")))
    each = split.select("part", "good", "toxic", F.explode(sides).alias("side")).select("part", "good", "toxic", "side.*").filter("n > 0")
    of = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0)).alias(flag)
    return each.groupBy("part", "fails").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def games(counts: DataFrame, n_filters: int, amounts: Sequence[str], part: str = "part", fails: str = "fails") -> DataFrame:
    """A row per part: for each amount an array of the worths of all coalitions (bit i: filter i), and ``<amount>_all``.

    ``counts`` has rows of part, the bits that fail, and amounts to add up.
    """
    worth = lambda a, s: F.sum(F.when(F.col(fails).bitwiseAND(F.lit(s)) != 0, F.col(a)).otherwise(0)).cast("long")
    columns = [F.array(*[worth(a, s) for s in range(1 << n_filters)]).alias(a) for a in amounts]
    return counts.groupBy(part).agg(*columns, *[F.sum(a).cast("long").alias(f"{a}_all") for a in amounts])


def potentials(worth: Column, n_filters: int) -> Column:
    """The potentials of all coalitions, times n_filters! (they are whole numbers then); ``worth``: an array as in `games`."""
    bits = F.array(*[F.lit(1 << i) for i in range(n_filters)])
    scale = F.lit(factorial(n_filters)).cast("long")

    def following(found: Column, s: Column) -> Column:
        without = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + F.when(s.bitwiseAND(b) != 0, F.get(found, s - b)).otherwise(0))
        return F.concat(found, F.array(F.call_function("div", scale * F.get(worth, s) + without, F.bit_count(s))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), F.array(F.lit(0).cast("long")), following)


def interactions(counts: DataFrame, filters: str = FILTERS, lost: Mapping[str, str] | None = None) -> DataFrame:
    """Each part, order of all filters and step: kept, removed, redundant, unique_fails, shapley, and losses.

    ``counts``: part, fails, n, and further amounts (as `counted_failures` gives); ``filters``: a letter for each bit;
    ``lost``: names of columns for the amounts that a step removes. shapley is the filter's Shapley value times the
    number of orders: what it removes, summed over them. A part without documents has no rows. More than `MOST_FILTERS`
    filters, or a letter twice, are refused.
    """
    n, lost = len(filters), dict(lost or {})
    if n > MOST_FILTERS or len(set(filters)) < n or not n:
        raise ValueError(f"1 to {MOST_FILTERS} different letters, not {filters!r}")
    whole = (1 << n) - 1
    each = games(counts, n, ["n", *lost.values()]).withColumn("potential", potentials(F.col("n"), n))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    steps = F.sequence(F.lit(1), F.lit(n))
    rows = each.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(steps))
    bits = F.array(*[F.lit(1 << i) for i in range(n)])
    bit = lambda at: F.get(bits, F.position(F.substring("filter_order", at, F.lit(1)), F.lit(filters)) - 1)
    rows = rows.withColumn("own", bit(F.col("step")))
    rows = rows.withColumn("before", F.aggregate(F.filter(steps, lambda i: i < F.col("step")), F.lit(0), lambda a, i: a.bitwiseOR(bit(i))))
    rows = rows.withColumn("after", F.col("before").bitwiseOR(F.col("own")))
    at = lambda a, s: F.get(F.col(a), s)
    step = lambda a: at(a, F.col("after")) - at(a, F.col("before"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("n_all") - at("n", F.col("after"))).alias("kept"),
        step("n").alias("removed"),
        (at("n", F.col("own")) - step("n")).alias("redundant"),
        (at("n", F.lit(whole)) - at("n", F.lit(whole) - F.col("own"))).alias("unique_fails"),
        *[step(a).alias(name) for name, a in lost.items()],
        (at("potential", F.lit(whole)) - at("potential", F.lit(whole) - F.col("own"))).alias("shapley"),
    )


def op13_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by language, in all 120 orders."""
    counts = counted_failures(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return interactions(counts, FILTERS, {"good_lost": "good", "toxic_lost": "toxic"})
