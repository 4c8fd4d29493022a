from pyspark.sql import functions as F

from loomspark.operators import library as L


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def chapters(spark, data):
    return spark.createDataFrame(data, "story_id string, order int, url string, title string, status string")


def test_summary_counts_and_state(spark):
    stories = spark.createDataFrame([("a", 0), ("b", 2), ("c", 0)], "story_id string, new_chapters int")
    c = chapters(spark, [("a", 1, "u1", "t", "done"), ("a", 2, "u2", "t", "pending"), ("a", 3, "u3", "t", "error"), ("b", 1, "v1", "t", "done")])
    got = L.with_status(L.summaries(stories, c))
    assert rows(got, "story_id", "total", "done", "errors", "remaining", "state") == [("a", 3, 1, 1, 1, "pending"), ("b", 1, 1, 0, 0, "new"), ("c", 0, 0, 0, 0, "done")]


def test_merge_keeps_what_is_not_pending_and_the_last_of_equal_urls(spark):
    stored = chapters(spark, [("a", 1, "u1", "old", "done"), ("a", 2, "u1", "newer", "error"), ("a", 3, "u2", "x", "pending"), ("a", 4, "gone", "y", "done")])
    toc = spark.createDataFrame([("a", 1, "u2", "T2"), ("a", 2, "u1", None), ("a", 3, "u3", None)], "story_id string, pos int, url string, title string")
    got = L.merge_toc(toc, stored)
    assert rows(got, "order", "url", "title", "status") == [(1, "u2", "T2", "pending"), (2, "u1", "newer", "error"), (3, "u3", None, "pending")]


def test_new_chapters_count_repeats(spark):
    stored = chapters(spark, [("a", 1, "u1", "t", "done")])
    toc = spark.createDataFrame([("a", "u1"), ("a", "u9"), ("a", "u9")], "story_id string, url string")
    assert rows(L.new_chapter_counts(toc, stored), "story_id", "new_chapters") == [("a", 2)]


def test_to_crawl_with_and_without_a_list(spark):
    c = chapters(spark, [("a", 1, "u", "t", "done"), ("a", 2, "u", "t", "pending")])
    assert rows(L.to_crawl(c), "order") == [(2,)]
    assert rows(L.to_crawl(c, []), "order") == [(2,)]
    assert rows(L.to_crawl(c, [1]), "order") == [(1,)]


def test_upsert_keeps_set_columns(spark):
    old = spark.createDataFrame([(1, "a", "c1"), (2, "b", "c2")], "k int, v string, created string")
    new = spark.createDataFrame([(2, "B", "c9"), (3, "C", "c3")], "k int, v string, created string")
    assert rows(L.upsert(old, new, ["k"], ["created"]), "k", "v", "created") == [(1, "a", "c1"), (2, "B", "c2"), (3, "C", "c3")]


def test_insert_absent_takes_the_first(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(1, "z", 1), (2, "late", 3), (2, "early", 2)], "k int, v string, seq int")
    assert rows(L.insert_absent(old, new, ["k"], "seq"), "k", "v") == [(1, "a"), (2, "early")]


def test_patch_sets_clears_and_keeps(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    change = spark.createDataFrame([(1, True, "x"), (2, True, None), (3, False, "no")], "k int, set_v boolean, v string")
    assert rows(L.patched(old, change, ["k"], ["v"]), "k", "v") == [(1, "x"), (2, None), (3, "c")]


def test_failure_does_not_undo_done(spark):
    old = spark.createDataFrame([(1, "done"), (2, "pending"), (3, "done")], "k int, status string")
    new = spark.createDataFrame([(1, "error"), (2, "error")], "k int, status string")
    assert rows(L.guarded(old, new, ["k"]), "k", "status") == [(1, "done"), (2, "error"), (3, "done")]


def test_replace_and_cascade(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "s string, n int")
    assert rows(L.replace_all(old, spark.createDataFrame([("a", 9)], "s string, n int"), "s"), "s", "n") == [("a", 9), ("b", 1)]
    assert rows(L.without(old, spark.createDataFrame([("a",), ("a",)], "s string"), ["s"]), "s", "n") == [("b", 1)]


def test_suffix_join_is_whole_labels(spark):
    hosts = spark.createDataFrame([("x.example.net",), ("badexample.net",), ("example.net",)], "host string")
    rules = spark.createDataFrame([("example.net",)], "domain string")
    assert rows(L.suffix_matches(hosts, "host", rules, "domain"), "host") == [("example.net",), ("x.example.net",)]


def test_merged_list_replaces_in_place_and_appends(spark):
    saved = spark.createDataFrame([("a", "1", 0), ("b", "2", 1)], "k string, v string, pos int")
    incoming = spark.createDataFrame([("b", None, 0), ("c", "3", 1)], "k string, v string, pos int")
    got = L.merged_list(saved, incoming, ["k"], ["v"], "pos").orderBy("appended", "pos")
    assert [tuple(r) for r in got.collect()] == [("a", "1", False, 0), ("b", None, False, 1), ("c", "3", True, 1)]


def test_publishing_state_and_plan(spark):
    c = chapters(spark, [("a", 1, "u", "t1", "done"), ("a", 2, "u", "t2", "done"), ("a", 3, "u", "t3", "pending")])
    audio = spark.createDataFrame([("a", 1, "h1"), ("a", 2, "h2")], "story_id string, order int, audio_hash string")
    video = spark.createDataFrame([("a", 1, "h0", "draft", "kept"), ("a", 2, None, "uploaded", None)], "story_id string, order int, video_hash string, video_status string, video_title string")
    assert rows(L.publishing_state(c, audio, video), "order", "has_audio", "audio_changed") == [(1, True, True), (2, True, False)]
    got = L.publish_plan(c.select("story_id", "order"), c, audio, video)
    assert rows(got, "order", "action", "video_title") == [(1, "prepare", "kept"), (2, "skip", "t2"), (3, "fail", "t3")]


def test_filled_counts(spark):
    local = spark.createDataFrame([(1, None), (2, "l")], "k int, t string")
    remote = spark.createDataFrame([(1, "r"), (2, "r")], "k int, t string")
    assert rows(L.filled(local, remote, ["k"], ["t"]), "k", "t", "filled") == [(1, "r", True), (2, "l", False)]


def test_live_counts(spark):
    c = chapters(spark, [("a", 1, "u1", "t", "pending"), ("a", 2, "u2", "t", "pending"), ("a", 3, "u3", "t", "done")])
    live = spark.createDataFrame([("u1", "done"), ("u2", "error"), ("u3", "done")], "url string, state string")
    assert rows(L.live_counts(c, live), "story_id", "done", "failed", "live") == [("a", 1, 1, 2)]
    assert c.filter(F.col("status") == "x").count() == 0
