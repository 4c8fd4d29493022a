"""Ordered computations: timelines, neighbours, as-of joins, first-seen, best-per-key, pages.

Each is a window over the rows of one work, chapter or key; nothing is ordered globally but final reports.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.tables import shared_folder


def _over(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def running_start(df: DataFrame, keys: Sequence[str], order: Sequence, length: str, out: str = "start") -> DataFrame:
    """Where each row begins when the rows' lengths are laid end to end; null lengths are 0."""
    before = _over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(F.coalesce(length, F.lit(0))).over(before), F.lit(0)))


def estimated_timeline(parts: DataFrame, keys: Sequence[str], order: Sequence, chars: str, seconds: str, pause: float = 0.35, exact: bool = False) -> DataFrame:
    """start and end of each part: speech is shared by length, with a pause after each part; rounded to milliseconds, or ``exact``."""
    every, w = Window.partitionBy(*keys), _over(keys, order)
    speech = F.greatest(F.lit(0.0), F.col(seconds) - pause * F.count("*").over(every))
    total = F.greatest(F.sum(chars).over(every), F.lit(1))
    before = F.coalesce(F.sum(chars).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = speech * before / total + pause * (F.row_number().over(w) - 1)
    end = start + speech * F.col(chars) / total
    told = lambda x: x if exact else F.floor(x * 1000 + 0.5) / 1000
    return parts.withColumn("start", told(start)).withColumn("end", told(end))


def lead_ranges(df: DataFrame, keys: Sequence[str], start: str, last: Column, out: str = "until") -> DataFrame:
    """Each row reaches to just before the next row's start; the final one to ``last``."""
    return df.withColumn(out, F.coalesce(F.lead(start).over(_over(keys, [start])) - 1, last))


def strictly_increasing(df: DataFrame, keys: Sequence[str], order: Sequence, value: str) -> DataFrame:
    """Leaves out rows whose value is not above the row's before it (kept or not)."""
    return df.withColumn("_p", F.lag(value).over(_over(keys, order))).filter(F.col("_p").isNull() | (F.col(value) > F.col("_p"))).drop("_p")


def last_of_runs(df: DataFrame, keys: Sequence[str], order: Sequence, value: str) -> DataFrame:
    """Of neighbouring rows with the same value the last stays."""
    nxt = F.lead(value).over(_over(keys, order))
    more = F.lead(F.lit(True)).over(_over(keys, order))
    return df.withColumn("_k", more.isNull() | ~nxt.eqNullSafe(F.col(value))).filter("_k").drop("_k")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(_over(keys, order))).filter("_n = 1").drop("_n")


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order; the order must be total for a repeatable result."""
    return df.withColumn("_n", F.row_number().over(_over(keys, order))).filter(F.col("_n") <= n).drop("_n")


def unique_names(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, out: str) -> DataFrame:
    """Names that are unique within the keys: a name that is taken gets " (2)", " (3)" and so on, the first that is free.

    Only names that differ by such endings can meet, so rows are dealt by key and by the name without them, and each such
    family is read in order as a stream.
    """
    family = F.regexp_replace(F.col(name), r"( \(\d+\))+$", "")
    dealt = df.withColumn("_family", family)
    schema = StructType([*df.schema.fields, StructField(out, StringType())])
    at = [dealt.columns.index(c) for c in (*keys, "_family")]
    n = dealt.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken, tried = None, set(), {}
        for batch in batches:
            names = []
            for row in zip(*(batch.column(i).to_pylist() for i in (*at, n)), strict=True):
                if row[:-1] != now:
                    now, taken, tried = row[:-1], set(), {}
                own = found = row[-1]
                if own is not None:
                    i = tried.get(own, 2)
                    while found in taken:
                        found, i = f"{own} ({i})", i + 1
                    tried[own] = i
                    taken.add(found)
                names.append(found)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string())], names=[*batch.schema.names[:-1], out])

    return dealt.repartition(*keys, "_family").sortWithinPartitions(*keys, "_family", *order).mapInArrow(run, schema)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, since: str, value: str) -> DataFrame:
    """For each left row the value of the last right row of its keys with ``since`` <= ``at``; null before the first.

    Both sides are put on one line and carried forward, so a key's rows are sorted once and no pairs are made. At equal
    times right rows come first, and of several the last value by order of the value.
    """
    a = left.withColumn("_t", F.col(at)).withColumn("_left", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*keys, F.col(since).alias("_t"), F.lit(0).alias("_left"), value)
    line = a.unionByName(b, allowMissingColumns=True)
    w = _over(keys, ["_t", "_left", F.col(value).asc_nulls_first()]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_left = 1").drop("_t", "_left")


#: Up to so many intervals are held before ended ones are looked for.
_FEW_HELD = 1024


def _held(n_keys: int, few: int):
    """Of rows (keys, place, turn, idx, until, more), in order, the points (turn 1), with what is nearest at or before each.

    That is the least idx of the intervals that hold the point, or if none does the one that ended last, and its distance.
    An interval's row (turn 0) has its idx and end; it is held while it is open, with at most as many that have ended.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_now, most, ended = None, [], few, None
        for batch in batches:
            asked, near, far = [], [], []
            for *key, at, turn, idx, until in zip(*(batch.column(i).to_pylist() for i in range(n_keys + 4)), strict=True):
                if key != now:
                    now, open_now, most, ended = key, [], few, None
                asked.append(turn == 1)
                if turn == 0:
                    if len(open_now) >= most:
                        open_now = [x for x in open_now if x[1] >= at]
                        heapq.heapify(open_now)
                        most = max(few, 2 * len(open_now))
                    heapq.heappush(open_now, (idx, until))
                    ended = (until, -idx) if ended is None else max(ended, (until, -idx))
                    continue
                while open_now and open_now[0][1] < at:
                    heapq.heappop(open_now)
                if open_now:
                    near.append(open_now[0][0])
                    far.append(0.0)
                else:  # all that began have ended
                    near.append(None if ended is None else -ended[1])
                    far.append(None if ended is None else at - ended[0])
            points = batch.filter(pa.array(asked, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*points.columns, pa.array(near, pa.int64()), pa.array(far, pa.float64())], names=[*batch.schema.names, "_near", "_far"])

    return run


def nearest_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, point_key: Sequence[str], tasks: int | None = None) -> DataFrame:
    """For each point the interval of its keys that holds it or is nearest; preferred ones first, then the first by idx.

    intervals: keys, idx, lo, hi, preferred; they may overlap. Repeated points count once; points of a key without
    intervals, and points or intervals without a place, go. No pairs are made: starts and points are put on one line and
    dealt by key over ``tasks`` (else the session's number of partitions), read backwards for the next start and forwards,
    with the open intervals held, for what holds the point or ended last.
    """
    dealt = lambda df: df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
    any_preferred = F.max("preferred").over(Window.partitionBy(*keys))
    iv = intervals.withColumn("_any", any_preferred).filter("(preferred or not _any) and lo <= hi")
    place = F.col(at).cast("double")
    known = points.select(*keys, *point_key, at).filter(place.isNotNull())
    for key in keys:
        known = known.filter(F.col(key).isNotNull())
    pts = dealt(known).distinct()
    told = F.struct(*dict.fromkeys([*point_key, at]))
    asked = pts.select(*keys, place.alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast("long").alias("_idx"), F.lit(None).cast("double").alias("_until"), told.alias("_point"))
    starts = iv.select(*keys, F.col("lo").cast("double").alias("_at"), F.lit(0).alias("_turn"), F.col("idx").cast("long").alias("_idx"), F.col("hi").cast("double").alias("_until"), F.lit(None).cast(asked.schema["_point"].dataType).alias("_point"))
    line = dealt(starts.unionByName(asked))
    back = _over(keys, [F.desc("_at"), "_turn", F.desc("_idx")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.when(F.col("_turn") == 0, F.struct("_at", "_idx"))
    line = line.withColumn("_next", F.last(start, ignorenulls=True).over(back)).sortWithinPartitions(*keys, "_at", "_turn")
    both = line.mapInArrow(_held(len(keys), _FEW_HELD), StructType([*line.schema.fields, StructField("_near", LongType()), StructField("_far", DoubleType())]))
    sides = F.array_compact(F.array(
        F.when(F.col("_near").isNotNull(), F.struct(F.col("_far").alias("distance"), F.col("_near").alias("idx"))),
        F.when(F.col("_next").isNotNull(), F.struct((F.col("_next._at") - F.col("_at")).alias("distance"), F.col("_next._idx").alias("idx"))),
    ))
    best = both.withColumn("_b", F.array_min(sides)).filter("_b is not null")
    kinds = intervals.schema["idx"].dataType, intervals.select(F.col("lo") - F.col("hi")).schema[0].dataType
    return best.select(*keys, *[F.col("_point")[c].alias(c) for c in (*point_key, at)], F.col("_b.idx").cast(kinds[0]).alias("idx"), F.col("_b.distance").cast(kinds[1]).alias("distance"))


#: From this length on a chapter has two slides.
TWO_SLIDES_SECONDS = 90


def slides(chapters: DataFrame, scenes: DataFrame, keys: Sequence[str], seconds: str, tasks: int | None = None) -> DataFrame:
    """(keys, slide, idx, shown): the scene of each slide of a chapter and how long it is shown.

    A chapter has one slide, of the scene nearest to its middle, or from `TWO_SLIDES_SECONDS` on two, of those nearest to
    a quarter and three quarters, half of the time each; scenes with somebody in them (``preferred``) come before others,
    then the nearest, then the first. scenes and ``tasks`` as in `nearest_interval`; a chapter without scenes has no slides.
    """
    two = F.col(seconds) >= TWO_SLIDES_SECONDS
    shares = F.when(two, F.array(F.lit(0.25), F.lit(0.75))).otherwise(F.array(F.lit(0.5)))
    points = chapters.select(*keys, seconds, F.posexplode(shares).alias("slide", "_share"))
    points = points.withColumn("_at", F.col(seconds) * F.col("_share"))
    found = nearest_interval(points.select(*keys, "slide", "_at", seconds), scenes, keys, "_at", ["slide", seconds], tasks)
    return found.select(*keys, "slide", "idx", F.when(two, F.col(seconds) / 2).otherwise(F.col(seconds)).alias("shown"))


def page(df: DataFrame, order: Sequence, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1), or the last there is."""
    n = df.count()
    number = max(1, min(number, -(-n // size)))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def numbered(df: DataFrame, order: Sequence[tuple], out: str = "place") -> DataFrame:
    """The place of each row, from 1, in one order of the whole table: (column, whether it ascends), for text also (…, a
    collation such as "vi", in whose order the text is put).

    The order must be total for a repeatable result; nulls come first where it ascends, last elsewhere. Rows are dealt by
    ranges of the order, sorted within each and stored with their range and their place in it; ranges are counted, and
    what stands before a range (a row for each) is added. So no task orders the table, and rows are shuffled once.
    """
    keys = []
    for c, up, *collation in order:
        key = F.collate(F.col(c), collation[0]) if collation else F.col(c)
        keys.append(key.asc() if up else key.desc())
    path = shared_folder(df.sparkSession)
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    stored = df.sparkSession.read.schema(dealt.schema).parquet(path)
    stored = stored.withColumn("_range", F.shiftright("_id", 33)).withColumn("_inside", F.col("_id") - F.shiftleft("_range", 33))
    counts = stored.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each range
    return stored.join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_before") + F.col("_inside") + 1).cast("long").alias(out))


def rate_limited(df: DataFrame, keys: Sequence[str], order: Sequence, at: str, interval: float, out: str = "slot") -> DataFrame:
    """slot = max(own time, former slot + interval), without a loop: the running maximum of time - i * interval, plus i * interval."""
    w = _over(keys, order)
    i = F.row_number().over(w) - 1
    stepped = df.withColumn("_i", i).withColumn("_b", F.col(at) - F.col("_i") * interval)
    run = F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn(out, run + F.col("_i") * interval).drop("_i", "_b")


def largest_gap(df: DataFrame, keys: Sequence[str], at: str, length: str) -> DataFrame:
    """Largest gap between neighbours; of a single row of more than 20 the length; else null."""
    gaps = df.withColumn("_g", F.col(at) - F.lag(at).over(_over(keys, [at])))
    one = (F.count("*") == 1) & (F.max(length) > 20)
    return gaps.groupBy(*keys).agg(F.when(one, F.max(length)).otherwise(F.max("_g")).alias("gap"))


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value at floor(n / 2) of the sorted values, by rank, not by interpolation."""
    n = F.count(value).over(Window.partitionBy(*keys))
    ranked = df.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(_over(keys, [value])) - 1).withColumn("_n", n)
    return ranked.filter("_i = floor(_n / 2)").select(*keys, F.col(value).alias("median"))


def weighted_mode(df: DataFrame, keys: Sequence[str], value: str, weight: str, seen: str) -> DataFrame:
    """The value with the greatest total weight; of equals the first seen."""
    totals = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"), F.min(seen).alias("s"))
    return totals.groupBy(*keys).agg(F.max_by(value, F.struct("w", (-F.col("s")).alias("s"))).alias("mode"))


def schedule(df: DataFrame, keys: Sequence[str], order: Sequence, start: Column, per_day: int, out: str = "day") -> DataFrame:
    """Days from ``start`` on, ``per_day`` rows each."""
    i = F.row_number().over(_over(keys, order)) - 1
    return df.withColumn(out, F.date_add(start, F.floor(i / per_day).cast("int")))


def page_margins(lines: DataFrame, keys: Sequence[str], body_size: Column, width: Column) -> DataFrame:
    """(keys, left, right) of each page's body lines: the right margin mirrors the left where no line reaches it."""
    body = lines.filter(F.abs(F.col("size") - body_size) < 0.5).withColumn("_w", width)
    left = F.min("x")
    return body.groupBy(*keys).agg(left.alias("left"), F.greatest(F.max("right"), F.max("_w") - left).alias("right"))
