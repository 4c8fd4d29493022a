"""Readers' results made safe, bodies under a limit, slices, written times in a zone, and counters."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from loomspark.functions import values as V
from loomspark.operators import library as L
from loomspark.sources.sites import valid_articles, valid_chapters

BLOCKS = "array<struct<type:string,level:int,text:string,src:string,alt:string>>"
TEXT = ("paragraph", None, "x" * 200, None, None)
PICTURE = ("image", None, None, "https://h.org/i.png", None)


def test_chapters_of_readers(spark):
    rows = [
        (1, "https://h.org/1", "  A \n title ", None, [TEXT, ("script", None, "alert()", None, None)]),
        (2, "https://h.org/2", None, False, [("paragraph", None, "x" * 199, None, None)]),
        (3, "https://h.org/3", "t" * 400, True, [TEXT]),
        (4, "https://h.org/4", " ", False, [PICTURE]),
        (5, "https://h.org/5", "", None, None),
        (6, "https://h.org/6", "six", None, []),
    ]
    got = valid_chapters(spark.createDataFrame(rows, f"page_id int, url string, title string, locked boolean, blocks {BLOCKS}")).orderBy("page_id").collect()
    assert [(r["title"], len(r["blocks"]), r["problem"]) for r in got] == [
        ("A title", 1, None),
        ("https://h.org/2", 1, "too short"),
        ("t" * 300, 1, "locked"),
        ("https://h.org/4", 1, None),
        ("https://h.org/5", 0, "too short"),
        ("six", 0, "too short"),
    ]


def test_articles_of_readers(spark):
    rows = [
        (1, "https://www.H.org/a", '<HTML class="x" LANG = \'VI-vn\'>', "", " an  author ", "//h.org/c", None, [("", [TEXT]), ("gone", [("odd", None, "x", None, None)]), (None, [PICTURE]), ("named", [TEXT]), ("none", None)]),
        (2, "https://h.org/b", "<p>", "T", None, "HTTPS://h.org/c", None, None),
        (3, None, None, None, None, None, True, []),
    ]
    kind = f"page_id int, url string, html string, title string, author string, cover_url string, locked boolean, chapters array<struct<title:string,blocks:{BLOCKS}>>"
    df = spark.createDataFrame(rows, kind)
    one, two, three = valid_articles(df).orderBy("page_id").collect()
    assert one[1:5] == ("h.org", "an author", "vi", None) and one["problem"] is None
    assert [c["title"] for c in one["chapters"]] == ["1", "2", "named"]
    assert two[1:5] == ("T", None, None, "HTTPS://h.org/c") and two["chapters"] == [] and two["problem"] == "too short"
    assert three["title"] is None and three["problem"] == "locked"
    assert [len(r["chapters"]) for r in valid_articles(df, 2).orderBy("page_id").collect()] == [1, 0, 0]


def test_slices_and_bodies(spark):
    df = spark.createDataFrame([(list(range(n)) if n >= 0 else None,) for n in (-1, 0, 1, 2, 3, 4, 7)], "a array<int>")
    got = [r[0] for r in df.select(V.chunked(F.col("a"), 3)).collect()]
    assert got == [None, *[[list(range(n))[i : i + 3] for i in range(0, n, 3)] for n in (0, 1, 2, 3, 4, 7)]]
    bodies = spark.createDataFrame([(None, None), ("", 0), ("été", 5), ("été", 6), ("étés", None), ("a", 2), (None, 9)], "b string, n int")
    assert [r[0] for r in bodies.select(V.capped_body(F.col("b"), F.col("n"), 5)).collect()] == ["", "", "été", None, None, "a", None]


@pytest.mark.parametrize("zone", ["Asia/Ho_Chi_Minh", "America/New_York", "Asia/Kolkata", "UTC"])
def test_times_of_a_zone(spark, zone):
    rng = random.Random(zone)
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(366 * 1440)) for _ in range(200)]
    df = spark.createDataFrame([(t, t.isoformat()) for t in at], "t timestamp_ntz, s string")
    local = [t.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)) for t in at]
    got = df.select(
        V.iso_with_offset(F.col("t"), zone),
        V.tomorrow(F.col("t"), zone),
        V.local_input(F.concat("s", F.lit("Z")), zone),
        V.publish_label(F.concat("s", F.lit("-0330")), zone),
        V.local_input(F.col("s"), zone),
    ).collect()
    for r, t, here in zip(got, at, local, strict=True):
        later = (t + dt.timedelta(minutes=210)).replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone))
        assert r[0] == here.isoformat(timespec="seconds") and r[1] == f"{here.date() + dt.timedelta(days=1)}"
        assert r[2] == f"{here:%Y-%m-%dT%H:%M}" and r[3] == f"{later:%H:%M %d/%m/%Y}" and r[4] == f"{t:%Y-%m-%dT%H:%M}"


def test_what_is_no_time(spark):
    df = spark.createDataFrame([(None,), ("",), ("soon",), ("2024-05-06",)], "s string")
    got = [tuple(r) for r in df.select(V.local_input(F.col("s"), "Asia/Tokyo"), V.publish_label(F.col("s"), "Asia/Tokyo")).collect()]
    assert got == [("", ""), ("", ""), ("", "soon"), ("2024-05-06T09:00", "09:00 06/05/2024")]


def test_counters_and_bytes(spark):
    chapters = spark.createDataFrame([("s", "a", "done"), ("s", "b", "pending"), ("s", "c", "pending"), ("s", "d", "error"), ("s", "e", "pending"), ("t", "f", "pending")], "story_id string, url string, status string")
    live = spark.createDataFrame([("a", "error"), ("b", "done"), ("c", "error"), ("e", "fetching"), ("x", "done")], "url string, state string")
    assert [tuple(r) for r in L.counters(chapters, live).orderBy("story_id").collect()] == [("s", 2, 2, 1, 3), ("t", 0, 0, 1, 1)]
    files = spark.createDataFrame([("s", 5), ("s", 7), ("z", 1)], "story_id string, size long")
    assert sorted(map(tuple, L.owned_bytes(chapters, files, ["story_id"], "size").collect())) == [("s", 2, 12), ("t", 0, 0)]
