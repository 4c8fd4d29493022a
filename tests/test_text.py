from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.functions import values as V
from loomspark.functions.pagehtml import blocks_to_html, parsed, sanitized
from loomspark.operators import documents as D


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_fold(spark):
    assert one(spark, "Đường Đi Ở", X.fold) == "duong di o"


def test_split_keeps_everything_and_bounds():
    text = "One sentence here. " * 30 + "x" * 600 + ", tail, and more words " * 20
    parts = X.split_at(text)
    assert all(0 < len(p) <= 250 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert X.split_at("short") == ["short"] and X.split_at("") == [""]
    assert X.split_at("One two. Three four five. Six", 10) == ["One two.", "Three", "four", "five. Six"]
    assert X.split_at("abcdefghijkl. m n", 5) == ["abcde", "fghij", "kl.", "m n"]
    assert X.split_at("😀😀😀 😀😀", 4) == ["😀😀", "😀", "😀😀"]  # two units each
    assert X.split_at("... He said (no). Yes!  ", 12) == ["He said", "(no). Yes!"]


def test_titles(spark):
    assert one(spark, "Hoàng Tử Bé – Antoine De", X.title_only) == "Hoàng Tử Bé"
    assert one(spark, "Hoàng Tử Bé – Antoine De", X.title_author) == "Antoine De"
    assert one(spark, "hoàng tử, bé!", X.hashtag) == "HoàngTửBé"
    assert one(spark, "Chương 12: x", X.chapter_number) == 12
    assert one(spark, "no number", X.chapter_number) is None


def test_rewrite_rules(spark):
    def problem(s, t, a=1, b=1):
        df = spark.createDataFrame([(s, t)], "s string, t string")
        return df.select(X.rewrite_problem(F.col("s"), F.col("t"), F.lit(a), F.lit(b)).alias("p")).first()["p"]

    long = "word " * 30
    assert problem(long, long) is None
    assert problem(long, "word " * 10) == "short"
    assert problem(long, "word " * 60) == "long"
    assert problem(long, long + "*") == "symbol"
    assert problem(long, long + "7") == "digits"
    assert problem(long, long, 2, 1) == "merged"
    assert problem(long, long, 1, 0) == "empty"
    names = "Anna met Boris and Clara with Dora near Emil today. "
    assert problem(names, "they met and they met with them near him today. ") == "names"


def test_values(spark):
    assert one(spark, "https://site.com/truyen/abc/chuong-12/?a=1#x", V.normalized_story_url) == "https://site.com/truyen/abc/"
    assert one(spark, 3725, V.clock, "int") == "1:02:05"
    assert one(spark, 65.9, V.clock, "double") == "1:05"
    assert one(spark, 123456, V.bytes_label, "long") == "123 KB"
    assert one(spark, 1500, V.bytes_label, "long") == "1.5 KB"
    assert one(spark, "192.168.1.4", V.private_address) is True
    assert one(spark, "::ffff:10.0.0.1", V.private_address) is True
    assert one(spark, "fe80::1", V.private_address) is True
    assert one(spark, "93.184.216.34", V.private_address) is False
    assert one(spark, "java\nscript:alert(1)", V.safe_scheme) is False
    assert one(spark, "/relative", V.safe_scheme) is True
    assert one(spark, float("nan"), V.importance, "double") == 1
    assert one(spark, ["a", "b", "c"], lambda c: V.chunked(c, 2), "array<string>") == [["a", "b"], ["c"]]
    assert one(spark, 'text {"a": 1} end', lambda c: V.outermost_json(c, "a int"))["a"] == 1
    df = spark.createDataFrame([("1.2.10", "1.2.9"), ("v1.2", "1.2.0"), ("1.0", "1.0.1")], "a string, b string")
    assert [r["o"] for r in df.select(V.version_order(F.col("a"), F.col("b")).alias("o")).collect()] == [1, 0, -1]


def test_page_blocks_links_and_html(spark):
    page = '<html><head><title>T</title></head><body><nav><a href="/x">menu</a></nav><h1>Head</h1><p>One <b>two</b><p>Three &amp; four<div class="ad">Buy</div><img src="i.png" alt="a"><a href="/n">next</a></body></html>'
    df = spark.createDataFrame([(1, "https://e.com/a/", page), (2, None, None)], "id int, url string, html string")
    got = {r["id"]: r for r in parsed(df, "id", "url", "html").withColumn("html", blocks_to_html(F.col("blocks"))).collect()}
    assert got[1]["title"] == "T"
    assert [(b["type"], b["text"]) for b in got[1]["blocks"]] == [("heading", "Head"), ("paragraph", "One two"), ("paragraph", "Three & four"), ("image", None), ("paragraph", "next")]
    assert ("https://e.com/n", "next") in [(x["url"], x["title"]) for x in got[1]["links"]]
    assert got[1]["html"].startswith("<h1>Head</h1>\n<p>One two</p>")
    assert got[2]["blocks"] == []


def test_sanitize(spark):
    dirty = 'a <script>x()</script><b onclick="y">c</b> <a href="javascript:z">d</a> <a href="https://e.com">e</a>'
    assert one(spark, dirty, sanitized) == 'a <b>c</b> <a>d</a> <a href="https://e.com">e</a>'


def test_ocr_paragraphs_and_chapters(spark):
    text = "Chapter 1\nThis is a long line of text that fills the whole width\nand ends.\nNew para-\ngraph here that goes on for the width of the page now\n12\fChapter 2\nSecond text."
    lines = D.page_lines(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    got = [(r["chapter"], r["text"]) for r in D.paragraphs(lines).orderBy("chapter", "paragraph").collect()]
    assert got == [(1, "This is a long line of text that fills the whole width and ends."), (1, "New paragraph here that goes on for the width of the page now"), (2, "Second text.")]


def test_votes_decide_a_symbol(spark):
    words = [("làm", 30), ("nhà", 20), ("v|", 1)] + [("l|m", 15), ("nh|", 10)]
    got = D.symbol_letters(spark.createDataFrame(words, "word string, n long"), "|{}", ["à", "ì"]).collect()
    assert [(r["symbol"], r["letter"], r["seen"]) for r in got] == [("|", "à", 26)]
