"""Progress-event streams: the current state of each key, throttling, bounded history, idempotent append.

The folds work on static and streaming frames alike: as a stream, run them in update mode; keys are the state's keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def partial_states(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Each key's number of events and its last one; the order is (ts, seq)."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.max(F.struct("ts", seq, "event_type", "value")).alias("last"))


def settled(partial: DataFrame, key: str) -> DataFrame:
    """Partial states of the same keys put together."""
    got = partial.groupBy(key).agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return got.select(key, "n", F.col("last.event_type").alias("state"), F.col("last.value").alias("value"), F.col("last.ts").alias("at"))


def job_states(events: DataFrame, key: str = "user_id", seq: str = "event_id") -> DataFrame:
    """Each key's number of events, last event and last time; the order is (ts, seq)."""
    return settled(partial_states(events, key, seq), key)


def retried(attempts: DataFrame, keys: list[str], order: list, outcome: str, terminal: list[str], most: int = 3) -> DataFrame:
    """(keys, attempts, state, error_kind): how the attempts at each item ended.

    ``outcome`` is "ok" or the kind of error (null: "other"). The first success, the first terminal error or attempt
    ``most`` ends it; later rows don't count. state: done, failed, or pending while neither has come. A failure that is
    not terminal has the kind "other".
    """
    kind = F.coalesce(F.col(outcome), F.lit("other"))
    tried = attempts.select(*keys, kind.alias("_k"), F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("_n")).filter(F.col("_n") <= most)
    stops = (F.col("_k") == "ok") | F.col("_k").isin(terminal) | (F.col("_n") == most)
    ended = tried.groupBy(*keys).agg(F.min(F.when(stops, F.struct("_n", "_k"))).alias("end"), F.max("_n").alias("seen"))
    state = F.when(F.col("end").isNull(), "pending").when(F.col("end._k") == "ok", "done").otherwise("failed")
    error = F.when(state == "failed", F.when(F.col("end._k").isin(terminal), F.col("end._k")).otherwise("other"))
    return ended.select(*keys, F.coalesce("end._n", "seen").alias("attempts"), state.alias("state"), error.alias("error_kind"))


def chapter_states(events: DataFrame, key: str, item: str, seq: str) -> DataFrame:
    """The last reported state of each item."""
    return events.groupBy(key, item).agg(F.max_by("event_type", F.struct("ts", seq)).alias("state"))


def history(events: DataFrame, key: str, order: list, keep: int) -> DataFrame:
    """The last ``keep`` events of each key."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")


def idempotent(events: DataFrame, event_id: str) -> DataFrame:
    """Each event id once; as a stream, ids are kept as state."""
    return events.dropDuplicates([event_id])


def throttled(events: DataFrame, key: str, at: str, phase: str, final: str, interval: float) -> DataFrame:
    """Events that are sent: the phase changed, or it is a final one, or ``interval`` passed since the last that was sent.

    It depends on what was kept, so rows are streamed by key in time order with one remembered row.
    """
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sent, last = object(), 0.0, None
        for batch in batches:
            keep = []
            for k, t, p, f in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if k != now:
                    now, sent, last = k, float("-inf"), None
                keep.append(p != last or bool(f) or t - sent >= interval)
                if keep[-1]:
                    sent, last = t, p
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns], names=batch.schema.names)

    cols = [key, "event_id", at, phase, final]
    dealt = events.select(*cols).repartition(key).sortWithinPartitions(key, at, "event_id")
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {kind[c]}" for c in cols))


class StateTable:
    """States and events of a stream, as Parquet by version in a shared folder.

    Every micro-batch adds its events and its partial states as one version, and one that runs again replaces its own.
    A subscriber reads a snapshot, then the events of later versions.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "user_id", seq: str = "event_id"):
        self.spark, self.folder, self.key, self.seq = spark, folder.rstrip("/"), key, seq
        self.kinds: dict[str, T.StructType] = {}

    def take(self, source: DataFrame, first: int = 0) -> int:
        """Takes in what a stream has now, as versions from ``first``; returns the first version that is free."""
        self.kinds = {"events": source.schema, "states": partial_states(source, self.key, self.seq).schema}
        taken = [first]

        def add(batch: DataFrame, number: int) -> None:
            version = f"version={first + number}"
            batch.write.mode("overwrite").parquet(f"{self.folder}/events/{version}")
            partial_states(batch, self.key, self.seq).write.mode("overwrite").parquet(f"{self.folder}/states/{version}")
            taken.append(first + number + 1)

        at = f"{self.folder}/checkpoint-{first}"
        source.writeStream.foreachBatch(add).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return max(taken)

    def _read(self, kind: str) -> DataFrame:
        schema = T.StructType([*self.kinds[kind].fields, T.StructField("version", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}")

    def held(self, before: int) -> DataFrame:
        """Partial states of the versions below ``before``, to which those of a tail can be added."""
        return self._read("states").filter(F.col("version") < before).drop("version")

    def snapshot(self, before: int) -> DataFrame:
        """The state of each key after the versions below ``before``."""
        return settled(self.held(before), self.key)

    def tail(self, since: int) -> DataFrame:
        """The events of version ``since`` and later."""
        return self._read("events").filter(F.col("version") >= since).drop("version")
