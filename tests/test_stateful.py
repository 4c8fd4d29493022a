"""States over several micro-batches and restarts against the batch operators, and entries that expire by the clock."""

import random
import time


from loomspark.streaming import progress as S
from loomspark.streaming import stateful as W


def fed(spark, tmp_path, rows, schema, make, parts, **how):
    """What a stream gives for rows that come in parts, stopped and started again between them."""
    folder, n = f"file://{tmp_path}", 0
    spark.createDataFrame([], schema).write.parquet(f"{folder}/in/part=-1")
    stream = make(spark.readStream.schema(schema).parquet(f"{folder}/in").drop("part"))
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] if how.get("mixed") else rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], schema).coalesce(1).write.parquet(f"{folder}/in/part={i}")
        n = W.run_now(stream, f"{folder}/run", n)
    return W.written_so_far(stream, f"{folder}/run").collect(), n


def test_throttled_streams_send_what_a_batch_sends(spark, tmp_path):
    rng = random.Random(2)
    schema = "job string, n long, at double, phase string, final boolean"
    rows = [(rng.choice("abc"), n, n * 0.05, rng.choice(["load", "load", "load", "zip", None]), rng.random() < 0.05) for n in range(120)]
    got, batches = fed(spark, tmp_path, rows, schema, lambda s: W.throttled_stream(s, ["job"], ["at", "n"], "at", "phase", "final", 0.15), 3)
    want = S.throttled(spark.createDataFrame([(k, n, at, p, f) for k, n, at, p, f in rows], "job string, event_id long, at double, phase string, final boolean"), "job", "at", "phase", "final", 0.15)
    assert sorted((r["job"], r["n"]) for r in got) == sorted((r["job"], r["event_id"]) for r in want.collect())
    assert batches >= 3 and len({r["batch"] for r in got}) >= 3


def test_retried_streams_end_as_a_batch_does(spark, tmp_path):
    rows = [("a", 1, "other"), ("a", 2, "ok"), ("a", 3, "locked"), ("b", 1, "locked"), ("b", 2, "ok"), ("c", 1, None), ("c", 2, "x"), ("c", 3, "y"), ("c", 4, "ok"), ("d", 1, "x")]
    rows.sort(key=lambda r: r[1])
    schema = "url string, at int, said string"
    got, _ = fed(spark, tmp_path, rows, schema, lambda s: W.retried_stream(s, ["url"], ["at"], "said", ["locked"]), 4)
    last = {}
    for r in sorted(got, key=lambda r: r["batch"]):
        last[r["url"]] = (r["attempts"], r["state"], r["error_kind"])
    want = S.retried(spark.createDataFrame(rows, schema), ["url"], ["at"], "said", ["locked"]).collect()
    assert last == {r["url"]: (r["attempts"], r["state"], r["error_kind"]) for r in want}
    assert {r["outcomes"] for r in got if r["url"] == "c"} >= {"other,x,y"}


def test_entries_expire_by_the_clock_and_say_so(spark, tmp_path):
    schema = "k string, n long, at double, value double"
    folder = f"file://{tmp_path}"
    put = lambda i, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    put(0, [("a", 1, 0.0, 5.0), ("a", 2, 1.0, None), ("b", 3, 0.0, None)])
    stream = W.cached_stream(spark.readStream.schema(schema).parquet(f"{folder}/in").drop("part"), ["k"], ["at", "n"], "at", "value", 4.0)
    seen = []
    query = W.with_store(spark, lambda: stream.writeStream.foreachBatch(lambda df, n: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", f"{folder}/run").trigger(processingTime="500 milliseconds").start())
    try:
        until = time.time() + 90
        while not any(r["kind"] == "expired" for r in seen) and time.time() < until:
            time.sleep(0.5)
        assert {(r["k"], r["n"], r["kind"], r["value"]) for r in seen} == {("a", 2, "hit", 5.0), ("b", 3, "miss", None), ("a", None, "expired", None)}
        # by its own time this question is young enough, but the entry is gone
        put(1, [("a", 4, 1.5, None), ("a", 5, 2.0, 6.0), ("a", 6, 9.0, None)])
        while not any(r["n"] == 6 for r in seen) and time.time() < until:
            time.sleep(0.5)
        assert {(r["n"], r["kind"]) for r in seen if r["n"] in (4, 6)} == {(4, "miss"), (6, "miss")}
    finally:
        query.stop()
