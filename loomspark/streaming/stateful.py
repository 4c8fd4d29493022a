"""Operators that remember: throttling, retries and caches with expiry, with one state per key over all micro-batches.

States live in the RocksDB store and its checkpoints, so a query that is stopped, or an executor that is lost, goes on
where it was. Rows of a key come in any order within a micro-batch and are put in order there; a batch is as large as the
trigger lets it be. A row that comes in a later batch than its place is taken as it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _known(value) -> bool:
    return value is not None and value == value  # NaN is no place


def _time(value) -> float:
    return float("nan") if value is None else value


def _in_order(rows: Iterator[Row], order: Sequence[str]) -> list[Row]:
    """The rows of a key; nulls first. Most keys have few rows, so these are sorted as they are, not as a table."""
    return sorted(rows, key=lambda r: [(True, r[c]) if _known(r[c]) else (False, 0) for c in order])


class Throttle(StatefulProcessor):
    """Sends a row if the phase changed, it is a final one, or ``interval`` passed since the last that was sent."""

    def __init__(self, columns: Sequence[str], order: Sequence[str], at: str, phase: str, final: str, interval: float):
        self.columns, self.order, self.at, self.phase, self.final, self.interval = list(columns), list(order), at, phase, final, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sent double, phase string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sent, phase = self.last.get() or (float("-inf"), None)
        kept = []
        for r in _in_order(rows, self.order):
            at, own = _time(r[self.at]), r[self.phase]
            if own != phase or r[self.final] or at - sent >= self.interval:
                sent, phase = float(at), own
                kept.append(Row(**{c: r[c] for c in self.columns}))
        if kept:
            self.last.update((sent, phase))
        yield from kept

    def close(self) -> None:
        pass


class Retries(StatefulProcessor):
    """How the attempts at an item stand: attempts, state, error_kind, and the outcomes that counted.

    The first success, the first terminal error or attempt ``most`` ends it; what comes later doesn't count. The state
    is one value, of the outcomes so far and whether they have ended; a row goes out whenever there are more.
    """

    def __init__(self, keys: Sequence[str], order: Sequence[str], outcome: str, terminal: Sequence[str], most: int):
        self.keys, self.order, self.outcome, self.terminal, self.most = list(keys), list(order), outcome, set(terminal), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tried = handle.getValueState("tried", "outcomes array<string>, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, ended = self.tried.get() or ((), False)
        if ended:
            for _ in rows:
                pass
            return
        tried, state = list(held), "pending"
        for r in _in_order(rows, self.order):
            said = r[self.outcome] or "other"
            tried.append(said)
            if said == "ok" or said in self.terminal or len(tried) == self.most:
                state = "done" if said == "ok" else "failed"
                break
        self.tried.update((tried, state != "pending"))
        kind = (tried[-1] if tried[-1] in self.terminal else "other") if state == "failed" else None
        yield Row(**dict(zip(self.keys, key, strict=True)), attempts=len(tried), state=state, error_kind=kind, outcomes=",".join(tried))

    def close(self) -> None:
        pass


class Cache(StatefulProcessor):
    """Answers questions from entries that are not too old, by the times that rows carry.

    A row with a value is an entry, one without a question. An entry is forgotten ``ttl`` seconds of the clock after it
    came (a state with expiry), and a timer then sends a row of kind "expired"; a new entry puts both off.
    """

    def __init__(self, keys: Sequence[str], order: Sequence[str], at: str, value: str, ttl: float):
        self.keys, self.order, self.at, self.value, self.ttl = list(keys), list(order), at, value, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at double, value double", ttlDurationMs=int(self.ttl * 1000))
        self.due = handle.getValueState("due", "at long")

    def _rows(self, key, kind: list[str], ids: list, values: list) -> list[Row]:
        own = dict(zip(self.keys, key, strict=True))
        return [Row(**own, **{self.order[-1]: n}, kind=k, value=v) for n, k, v in zip(ids, kind, values, strict=True)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, value = self.entry.get() or (None, None)
        ids, kinds, values, new = [], [], [], False
        for r in _in_order(rows, self.order):
            n, now, own = r[self.order[-1]], _time(r[self.at]), r[self.value]
            if _known(own):
                at, value, new = float(now), float(own), True
                continue
            hit = at is not None and now - at < self.ttl
            ids.append(n)
            kinds.append("hit" if hit else "miss")
            values.append(value if hit else None)
        if new:
            self.entry.update((at, value))
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            due = timerValues.getCurrentProcessingTimeInMs() + int(self.ttl * 1000)
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield from self._rows(key, kinds, ids, values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        self.entry.clear()
        yield from self._rows(key, ["expired"], [None], [None])

    def close(self) -> None:
        pass


def _kinds(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields)


def throttled_stream(events: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, phase: str, final: str, interval: float) -> DataFrame:
    """The events of a stream that are sent, as `Throttle` has it."""
    columns = list(dict.fromkeys([*keys, *order, at, phase, final]))
    return events.select(*columns).groupBy(*keys).transformWithState(Throttle(columns, order, at, phase, final, interval), _kinds(events, columns), "Append", "None")


def retried_stream(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], outcome: str, terminal: Sequence[str], most: int = 3) -> DataFrame:
    """(keys, attempts, state, error_kind, outcomes) whenever an item's attempts have grown, as `Retries` has it."""
    columns = list(dict.fromkeys([*keys, *order, outcome]))
    kinds = _kinds(attempts, keys) + ", attempts int, state string, error_kind string, outcomes string"
    return attempts.select(*columns).groupBy(*keys).transformWithState(Retries(keys, order, outcome, terminal, most), kinds, "Update", "None")


def cached_stream(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, value: str, ttl: float) -> DataFrame:
    """(keys, the last column of ``order``, kind, value) of questions, and of entries that expired, as `Cache` has it."""
    columns = list(dict.fromkeys([*keys, *order, at, value]))
    kinds = _kinds(rows, [*keys, order[-1]]) + ", kind string, value double"
    return rows.select(*columns).groupBy(*keys).transformWithState(Cache(keys, order, at, value, ttl), kinds, "Update", "ProcessingTime")


def run_now(stream: DataFrame, folder: str, first: int = 0, once: bool = False) -> int:
    """Takes in all that the stream's source has now, and ends; what comes out is written below ``folder`` by micro-batch.

    ``once``: in one micro-batch; a stream with timers of the clock would wait for these else, and not end.

    Started again with the same folder it goes on with the states it had. A batch that runs again replaces what it wrote.
    Returns the number of batches so far.
    """
    spark, done = stream.sparkSession, [first]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        done.append(number + 1)

    trigger = {"once": True} if once else {"availableNow": True}
    with_store(spark, lambda: stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start().awaitTermination())
    return max(done)


def with_store(spark, start: Callable):
    """Runs ``start`` while new queries get the store that these states need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        return start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def written_so_far(stream: DataFrame, folder: str) -> DataFrame:
    """What `run_now` has written, with the number of the batch."""
    return stream.sparkSession.read.schema(f"{_kinds(stream, stream.columns)}, batch int").parquet(f"{folder}/out")
