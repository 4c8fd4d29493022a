from pyspark.sql import functions as F

from loomspark.streaming import progress as S


def events(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, event_type string, value double").withColumn("more", F.lit(1))


def test_snapshot_and_tail_make_the_state_of_now(spark, tmp_path):
    from datetime import datetime

    at = lambda s: datetime(2020, 1, 1, 0, 0, s)
    rows = [(1, 1, at(5), "view", 1.0), (1, 2, at(5), "click", 2.0), (2, 3, None, None, None), (None, 4, at(1), "view", None), (1, 2, at(5), "click", 2.0)]
    later = [(1, 5, at(4), "error", 3.0), (2, 6, at(2), "signup", None)]
    for n, part in enumerate((rows, later)):
        events(spark, part).write.parquet(str(tmp_path / f"in{n}"))
    kept = S.StateTable(spark, f"file://{tmp_path}/state")
    stream = lambda n: spark.readStream.schema(events(spark, []).schema).parquet(str(tmp_path / f"in{n}"))
    middle = kept.take(stream(0))
    states = lambda df: {r["user_id"]: (r["n"], r["state"], r["value"]) for r in df.collect()}
    assert states(kept.snapshot(middle)) == {1: (3, "click", 2.0), 2: (1, None, None), None: (1, "view", None)}
    end = kept.take(stream(1), middle)
    assert kept.tail(middle).count() == 2 and end > middle
    both = states(S.settled(kept.held(middle).unionByName(S.partial_states(kept.tail(middle), "user_id", "event_id")), "user_id"))
    assert both == states(kept.snapshot(end)) == states(S.job_states(events(spark, rows + later)))


def test_retries_end_at_success_terminal_error_or_the_last_attempt(spark):
    rows = [("a", 1, "other"), ("a", 2, "ok"), ("a", 3, "locked"), ("b", 1, "locked"), ("b", 2, "ok"), ("c", 1, None), ("c", 2, "x"), ("c", 3, "y"), ("c", 4, "ok"), ("d", 1, "x"), (None, 1, "ok")]
    df = spark.createDataFrame(rows, "url string, at int, said string")
    got = {r["url"]: (r["attempts"], r["state"], r["error_kind"]) for r in S.retried(df, ["url"], ["at"], "said", ["locked", "mature"]).collect()}
    assert got == {"a": (2, "done", None), "b": (1, "failed", "locked"), "c": (3, "failed", "other"), "d": (1, "pending", None), None: (1, "done", None)}
    assert S.retried(df.limit(0), ["url"], ["at"], "said", []).count() == 0
