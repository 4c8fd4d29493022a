"""Greedy packing of ordered items into bounded parts.

Next-fit depends on what came before it in its own key only, so keys are packed in parallel. Small keys are folded with
a higher-order function; a key of any length is streamed: rows are dealt by key, sorted by position, and one running
total is kept, so no key's items are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_fit(df: DataFrame, key: str, pos: str, weight: str, cap: float, count_empty: bool = True, out: str = "part") -> DataFrame:
    """(key, pos, weight, part): parts from 0; an item that would exceed ``cap`` begins a part.

    An item that is too large alone gets a part of its own. ``count_empty``: whether a part that holds only items of
    weight 0 can be closed (some plans close a part that has an item, others one that has weight). A null weight is 0.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, part, some = object(), 0.0, 0, False
        for batch in batches:
            parts = []
            for k, w in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w = w or 0
                if k != now:
                    now, total, part, some = k, 0.0, 0, False
                if (some if count_empty else total > 0) and total + w > cap:
                    part, total = part + 1, 0.0
                total += w
                some = True
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(parts, pa.int64())], names=[key, pos, weight, out])

    dealt = df.select(key, pos, weight).repartition(key).sortWithinPartitions(key, pos)
    return dealt.mapInArrow(run, f"`{key}` {kind[key]}, `{pos}` {kind[pos]}, `{weight}` {kind[weight]}, `{out}` long")


def next_fit_folded(items: Column, cap: float) -> Column:
    """Parts of an array of structs (pos, weight) in order, as an array of part numbers; for keys of bounded length."""
    start = F.struct(F.lit(-1).alias("part"), F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("parts"))

    def step(a, x):
        w = F.coalesce(x["weight"].cast("double"), F.lit(0.0))
        fresh = (a["part"] < 0) | (a["total"] + w > cap)
        part = F.when(fresh, a["part"] + 1).otherwise(a["part"])
        return F.struct(part.alias("part"), F.when(fresh, w).otherwise(a["total"] + w).alias("total"), F.concat(a["parts"], F.array(part)).alias("parts"))

    return F.aggregate(items, start, step, lambda a: a["parts"])


def budgeted(df: DataFrame, keys: list[str], pos: str, text: str, budget: int = 500, longest: int = 100) -> DataFrame:
    """Texts in order while their lengths plus one fit the budget; too long ones are passed over, the first overflow ends it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit = df.filter((F.length(text) > 0) & (F.length(text) <= longest)).withColumn("_used", F.sum(F.length(text) + 1).over(w))
    return fit.filter(F.col("_used") <= budget).drop("_used")


def fixed_chunks(df: DataFrame, pos: str, size: int, out: str = "chunk") -> DataFrame:
    """Chunks of ``size`` positions, from position 1."""
    return df.withColumn(out, F.floor((F.col(pos) - 1) / size))


def target_scenes(seconds: Column, parts: Column) -> Column:
    """How many scenes a chapter gets: one for 7 seconds, 80 and its parts at most, one at least."""
    return F.greatest(F.lit(1), F.least(parts, F.lit(80), F.floor(seconds / 7 + 0.5)))


def islands(df: DataFrame, keys: list[str], pos: str, member: Column, out: str = "run") -> DataFrame:
    """Runs of neighbouring members: those with one number of non-members before them make a run."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(F.when(member, 0).otherwise(1)).over(w)).filter(member)


def halved_scenes(scenes: DataFrame, longest: float = 30.0) -> DataFrame:
    """Scenes (id, first, last, starts, ends) cut in the middle part until none is longer or it has one part.

    starts: the parts' start times; ends: the end of the last. Returns (id, piece, first, last).
    """
    kind = scenes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                at = [*r["starts"], r["ends"]]
                todo, piece = [(r["first"], r["last"])], 0
                while todo:
                    a, b = todo.pop()
                    if a >= b or at[b + 1 - r["first"]] - at[a - r["first"]] <= longest:
                        rows.append((r["id"], piece, a, b))
                        piece += 1
                        continue
                    mid = a + (b - a + 1) // 2
                    todo += [(mid, b), (a, mid - 1)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("id").type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["id", "piece", "first", "last"])

    return scenes.select("id", "first", "last", "starts", "ends").mapInArrow(run, f"id {kind}, piece long, first long, last long")
