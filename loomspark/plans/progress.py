"""Queries over the progress stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import seconds_of, shared_folder, table
from ..streaming import progress as S
from ..streaming import stateful as W
from .registry import SQL, query

_STATES = "SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS state, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1"


@query("str01_states", _STATES)
def states(spark, d):
    """STR-01, STR-03 as a batch."""
    return S.job_states(table(spark, d, "events")).drop("at")


def _events(spark, d):
    """The events table as a stream."""
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)


@query("str03_stream", _STATES)
def stream(spark, d):
    """STR-01, STR-03 as a stream over the same events."""
    kept = S.StateTable(spark, shared_folder(spark))
    return kept.snapshot(kept.take(_events(spark, d))).drop("at")


@query("str02_snapshot_tail", _STATES)
def snapshot_and_tail(spark, d):
    """STR-02, SNK-18: one who holds the snapshot after the first events and is sent the others has the state of now."""
    kept = S.StateTable(spark, shared_folder(spark))
    middle = kept.take(_events(spark, d).filter("event_type IN ('click', 'signup')"))
    kept.take(_events(spark, d).filter("event_type IS NULL OR event_type NOT IN ('click', 'signup')"), middle)
    return S.settled(kept.held(middle).unionByName(S.partial_states(kept.tail(middle), "user_id", "event_id")), "user_id").drop("at")


@query("str08_ended", """WITH t AS (SELECT user_id, event_id % 7 AS item, event_type AS k, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY ts, event_id) AS n FROM events),
e AS (SELECT user_id, item, min(n) FILTER (WHERE k IN ('purchase', 'error') OR n = 3) AS stop, max(n) AS seen FROM t WHERE n <= 3 GROUP BY ALL)
SELECT e.user_id, CAST(e.item AS BIGINT) AS item, CAST(coalesce(stop, seen) AS INT) AS attempts, CASE WHEN stop IS NULL THEN 'pending' WHEN k = 'purchase' THEN 'done' ELSE 'failed' END AS state,
CASE WHEN stop IS NULL OR k = 'purchase' THEN NULL WHEN k = 'error' THEN 'error' ELSE 'other' END AS error_kind FROM e LEFT JOIN t ON t.user_id = e.user_id AND t.item = e.item AND t.n = e.stop""")
def retries(spark, d):
    """STR-08: purchases count as successes, errors end an item at once."""
    e = table(spark, d, "events").withColumn("item", F.col("event_id") % 7).withColumn("outcome", F.when(F.col("event_type") == "purchase", "ok").otherwise(F.col("event_type")))
    return S.retried(e, ["user_id", "item"], ["ts", "event_id"], "outcome", ["error"])


@query("str04_items", "SELECT user_id, CAST(event_id % 7 AS BIGINT) AS item, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY ALL")
def items(spark, d):
    """STR-04."""
    return S.chapter_states(table(spark, d, "events").withColumn("item", F.col("event_id") % 7), "user_id", "item", "event_id")


@query("str06_history", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def bounded(spark, d):
    """STR-06."""
    return S.history(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("str13_idempotent", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def idempotent(spark, d):
    """STR-13: events that come twice count once."""
    e = table(spark, d, "events")
    return S.idempotent(e.unionByName(e.filter("event_id % 3 = 0")), "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


_SENT = """WITH RECURSIVE t AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, event_type AS phase, event_type = 'purchase' AS final, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, true AS keep, sec AS sent, phase FROM t WHERE i = 1
UNION ALL SELECT t.user_id, t.event_id, t.i, k.keep, CASE WHEN k.keep THEN t.sec ELSE r.sent END, CASE WHEN k.keep THEN t.phase ELSE r.phase END
FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1, LATERAL (SELECT t.phase IS DISTINCT FROM r.phase OR coalesce(t.final, false) OR t.sec - r.sent >= 3600 AS keep) AS k)
SELECT user_id, event_id FROM r WHERE keep"""


@query("str05_throttled", _SENT)
def throttled(spark, d):
    """STR-05, SNK-17."""
    e = table(spark, d, "events").select("user_id", "event_id", seconds_of("ts").alias("at"), F.col("event_type").alias("phase"), (F.col("event_type") == "purchase").alias("final"))
    return S.throttled(e, "user_id", "at", "phase", "final", 3600.0).select("user_id", "event_id")


@query("str10_resume", "SELECT o_custkey, count(*) AS left FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def resume(spark, d):
    """STR-10: what is finished is left out next time."""
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, d, "orders").join(done, "o_orderkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("left"))


def _in_three(spark, rows, at):
    """A stream over a folder, and three functions that each put a third of the rows there, by time."""
    folder = shared_folder(spark)
    low, high = rows.agg(F.percentile_approx(at, F.array(F.lit(1 / 3), F.lit(2 / 3)))).first()[0]
    parts = [F.coalesce(F.col(at) <= low, F.lit(True)), (F.col(at) > low) & (F.col(at) <= high), F.col(at) > high]
    put = [lambda i=i, part=part: rows.filter(part).write.mode("overwrite").parquet(f"{folder}/in/part={i}") for i, part in enumerate(parts)]
    rows.limit(0).write.parquet(f"{folder}/in/part=-1")  # a stream needs its folder
    return folder, spark.readStream.schema(rows.schema).parquet(f"{folder}/in").drop("part"), put


@query("str05_stream", _SENT)
def throttled_stream(spark, d):
    """STR-05 as a stream that is stopped and started again twice, with what was sent last as state."""
    e = table(spark, d, "events").select("user_id", "event_id", seconds_of("ts").alias("at"), F.col("event_type").alias("phase"), (F.col("event_type") == "purchase").alias("final"))
    folder, stream, put = _in_three(spark, e, "at")
    sent, n = W.throttled_stream(stream, ["user_id"], ["at", "event_id"], "at", "phase", "final", 3600.0), 0
    for more in put:
        more()
        n = W.run_now(sent, folder, n)
    return W.written_so_far(sent, folder).select("user_id", "event_id")


@query("str08_stream", SQL["str08_ended"])
def retries_stream(spark, d):
    """STR-08 as a stream that is stopped and started again twice, with the attempts so far as state."""
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 7).alias("item"), "event_id", seconds_of("ts").alias("at"), F.when(F.col("event_type") == "purchase", "ok").otherwise(F.col("event_type")).alias("outcome"))
    folder, stream, put = _in_three(spark, e, "at")
    ended, n = W.retried_stream(stream, ["user_id", "item"], ["at", "event_id"], "outcome", ["error"]), 0
    for more in put:
        more()
        n = W.run_now(ended, folder, n)
    last = W.written_so_far(ended, folder).groupBy("user_id", "item").agg(F.max_by(F.struct("attempts", "state", "error_kind"), "batch").alias("x"))
    return last.select("user_id", "item", "x.attempts", "x.state", "x.error_kind")


@query("str11_cache", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, event_type = 'view' AS entry, CASE WHEN event_type = 'view' THEN value END AS value FROM events),
p AS (SELECT q.user_id, q.event_id, max((p.sec, p.event_id, p.value)) AS best, max(q.sec) AS sec FROM e AS q LEFT JOIN e AS p ON p.user_id = q.user_id AND p.value IS NOT NULL AND (p.sec, p.event_id) < (q.sec, q.event_id) WHERE q.value IS NULL GROUP BY 1, 2)
SELECT user_id, event_id, CASE WHEN sec - best[1] < 86400 THEN 'hit' ELSE 'miss' END AS kind, CASE WHEN sec - best[1] < 86400 THEN best[3] END AS value FROM p""")
def cache(spark, d):
    """STR-11: every user's last view answers what comes within a day; entries live in a state with expiry."""
    e = table(spark, d, "events").select("user_id", "event_id", seconds_of("ts").alias("at"), F.when(F.col("event_type") == "view", F.col("value")).cast("double").alias("value"))
    folder, stream, put = _in_three(spark, e, "at")
    answers, n = W.cached_stream(stream, ["user_id"], ["at", "event_id"], "at", "value", 86400.0), 0
    for more in put:
        more()
        n = W.run_now(answers, folder, n, once=True)
    return W.written_so_far(answers, folder).filter("kind <> 'expired'").select("user_id", "event_id", "kind", "value")
