from pyspark.sql import functions as F

from loomspark.functions import labels as B
from loomspark.sources.sites import cast_problems, dispatch, valid_listing
from loomspark.sources.tables import json_sidecars, settings_record, with_defaults


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_titles_are_decoded_once(spark):
    assert one(spark, " A&nbsp;&amp;lt; &#x1F600;&#233;&bogus; &#0;", B.decoded_title) == "A &lt; 😀é&bogus; &#0;"


def test_labels(spark):
    lit = lambda *v: [F.lit(x).cast("string") for x in v]
    row = spark.range(1).select(B.feed_label(*lit("1", None, " T ")).alias("a"), B.feed_label(*lit(None, "", None)).alias("b"), B.story_tags(*lit("Hoàng Tử – An Toan", None)).alias("c")).first()
    assert tuple(row) == ("Vol. 1 – T", "Oneshot", ["#HoàngTử", "#AnToan"])


def test_title_cascade_and_leading_heading(spark):
    kind = "array<struct<type:string,level:int,text:string,src:string,alt:string>>"
    blocks = [("paragraph", None, "p", None, None), ("heading", 1, "H", None, None), ("paragraph", None, "q", None, None)]
    none = F.lit(None).cast("string")
    assert one(spark, blocks, lambda c: B.page_title(F.lit(" "), c, F.lit("raw"), none), kind) == "H"
    assert one(spark, [], lambda c: B.page_title(none, c, F.lit(""), none), kind) == "Untitled"
    assert [b["text"] for b in one(spark, blocks, B.without_leading_heading, kind)] == ["p", "q"]
    assert [b["text"] for b in one(spark, blocks[:1], B.without_leading_heading, kind)] == ["p"]


def test_readers(spark):
    pages = spark.createDataFrame([(1, "a.e.com"), (2, "e.com"), (3, "bade.com")], "id int, host string")
    got = {r["id"]: r["reader"] for r in dispatch(pages, "host", [("e.com", "any"), ("a.e.com", "own")]).collect()}
    assert got == {1: "own", 2: "any", 3: None}
    rows = spark.createDataFrame([(1, 0, "https://www.h.org/1#x", "h.org"), (1, 1, "https://h.org/1", "h.org"), (1, 2, "ftp://h.org/2", "h.org"), (1, 3, "https://h.org/3", "h.org"), (1, 4, "https://h.org/4", "h.org")], "page_id int, pos int, url string, page_host string")
    assert [r["url"] for r in valid_listing(rows, "page_host", 2).orderBy("pos").collect()] == ["https://www.h.org/1", "https://h.org/1"]
    kind = "array<struct<id:string,name:string,head_y:int>>"
    assert one(spark, [("a", "A", -300), ("a", " ", 5)], cast_problems, kind) == ["repeated", "name", "head"]
    assert one(spark, [], cast_problems, kind) == ["empty"]


def test_tables(spark, tmp_path):
    kv = spark.createDataFrame([("lang", "en"), ("other", "x"), ("proxy", None)], "key string, value string")
    assert settings_record(kv, {"lang": "vi", "proxy": "off"}).first().asDict() == {"lang": "en", "proxy": "off"}
    assert with_defaults(spark.range(1), {"id": ("long", 5), "seen": ("boolean", False)}).first().asDict() == {"id": 0, "seen": False}
    (tmp_path / "a.json").write_text('{"seconds": 1.5, "voice": "v"}')
    (tmp_path / "b.json").write_text("{broken")
    assert [tuple(r) for r in json_sidecars(spark, str(tmp_path), "seconds double, voice string").collect()] == [(1.5, "v")]
