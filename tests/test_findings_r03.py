"""What a reviewer found on larger tables."""

import re

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomspark.functions.pagehtml import import_sanitized, plain_text, sanitized
from loomspark.functions.rows import AT_ONCE
from loomspark.operators import ordered as O


def test_references_without_a_semicolon_stay(spark):
    text = "a &ampp{b} &am &amp;amp; &lt;c&gt; &#233;&#xe9; &copy &copyx; &nosuch; d&nbsp;e"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(plain_text("t").alias("t"))
    assert [r["t"] for r in got.collect()] == ["a &ampp{b} &am &amp; <c> éé &copy &copyx; &nosuch; d e", None]


def test_exact_times_just_below_a_second(spark):
    df = spark.createDataFrame([(1, 0, 71666), (1, 1, 28334)], "k int, i int, chars int").withColumn("seconds", F.lit(60.0))
    got = O.estimated_timeline(df, ["k"], ["i"], "chars", "seconds", exact=True).filter("i = 1").first()["start"]
    told = O.estimated_timeline(df, ["k"], ["i"], "chars", "seconds").filter("i = 1").first()["start"]
    want = (60 - 0.7) * 71666 / 100000 + 0.35
    assert got == want and told == round(want, 3) != want


def test_timeline_query_floors_the_exact_times(spark, tmp_path):
    from loomspark.plans.ordered import timeline

    # (60 - 0.7) * 719218 / 1e6 + 0.35 = 42.99963: to milliseconds it is 43.000
    rows = [(1, 0, "a" * 719218, "user"), (1, 1, "b" * 280782, "user")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string, role string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r["start"] for r in timeline(spark, str(tmp_path)).orderBy("turn").collect()] == [0.0, 42.0]


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)Exchange ", df._jdf.queryExecution().executedPlan().toString()))


def test_runs_are_dealt_twice_only(spark):
    from loomspark.plans.layout import lines

    assert shuffles(lines(spark, "/root/testdata/sf0.001")) == 2  # of lines, and of runs that are drawn once


def test_shared_steps_run_once(spark):
    from loomspark.plans import layout, trees

    for query in (layout.blocks, layout.chapters):
        plan = query(spark, "/root/testdata/sf0.001")
        assert plan._jdf.queryExecution().executedPlan().toString().count("documents.parquet") <= 1
    for query in (trees.missed, trees.unread, trees.pictures, trees.scripts):
        assert "MapInArrow" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_large_batches_are_read_in_slices():
    batch = pa.array(["<p onclick='x'>a</p>", None] * 500)
    for f, want in ((sanitized, "a"), (import_sanitized, "<p>a</p>"), (plain_text, "a")):
        out = list(f.func(iter([batch])))
        assert max(map(len, out)) <= AT_ONCE
        assert [x for part in out for x in part.to_pylist()] == [want, None] * 500


def test_states_take_rows_without_a_table_for_each_key():
    from loomspark.streaming import stateful as W

    assert not hasattr(W, "pd")
    rows = [Row(at=2.0, n=2), Row(at=None, n=9), Row(at=float("nan"), n=1), Row(at=1.0, n=4), Row(at=1.0, n=None)]
    assert [r["n"] for r in W._in_order(iter(rows), ["at", "n"])] == [1, 9, None, 4, 2]


def test_tasks_of_slides_grow_with_their_rows(spark, monkeypatch):
    from loomspark.plans import ordered

    def parts(rows):
        monkeypatch.setattr(ordered, "_TASK_ROWS", rows, raising=False)
        for query in (ordered.slides, ordered.nearest):
            plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            yield {int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan)}

    few, many = [list(parts(rows)) for rows in (10**6, 100)]
    assert all(max(a) <= 4 and min(b) > 20 for a, b in zip(few, many, strict=True))


def test_nearest_intervals_of_points_at_ends_and_of_keys_without_a_name(spark):
    iv = [("a", 3, 5, 9, True), ("a", 2, 5, 5, True), ("a", 1, 12, 12, True), ("a", 0, 12, 13, True), (None, 7, 0, 1, True)]
    points = [("a", at) for at in (4, 5, 9, 10, 11, 12, 20, 10)] + [(None, 0)]
    got = O.nearest_interval(spark.createDataFrame(points, "k string, at int"), spark.createDataFrame(iv, "k string, idx int, lo int, hi int, preferred boolean"), ["k"], "at", [], 3)
    assert sorted((r["at"], r["idx"], r["distance"]) for r in got.collect()) == [(4, 2, 1), (5, 2, 0), (9, 3, 0), (10, 3, 1), (11, 0, 1), (12, 0, 0), (20, 0, 7)]


def test_glyphs_of_a_page_are_dealt_as_text(spark, monkeypatch):
    from loomspark.operators import glyphs as G
    from loomspark.plans import layout

    plans, stored = [], G._stored
    monkeypatch.setattr(G, "_stored", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df))[1])
    layout.glyphs(spark, "/root/testdata/sf0.001")
    assert any("REPARTITION_BY_NUM" in p for p in plans)
    assert not any(re.search(r"Exchange hashpartitioning\(doc#\d+L?, page#\d+L?, \d+\), ENSURE", p) for p in plans)


def test_patterns_meet_words_without_a_row_for_each_letter(spark):
    from loomspark.operators import glyphs as G

    letters = "abcdefghijklmnopqrstuvwxyz"
    patterns = spark.createDataFrame([("d", "f", 1, "xx", "yy", 1), ("d", "f", 1, "", "z" * 80, 2)], "doc string, font string, code int, head string, tail string, uses long")
    free = spark.createDataFrame([("d", "f", 1, "f", 0, c) for c in letters], "doc string, font string, code int, family string, first int, candidate string")
    words = spark.createDataFrame([("d", "xxayy", 3), ("d", "xxbyy", 4), ("d", "xayy", 9), ("e", "xxcyy", 9), ("d", "q" + "z" * 80, 5), ("d", "", 1)], "doc string, word string, found long")
    got = G._tried(patterns, free, words, ["doc", "font", "code"])
    assert sorted((r["candidate"], r["head"], len(r["tail"]), r["found"]) for r in got.collect()) == [("a", "xx", 2, 3), ("b", "xx", 2, 4), ("q", "", 80, 5)]
