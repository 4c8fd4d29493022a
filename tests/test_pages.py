import io
import random
import zipfile

from pyspark.sql import functions as F

from loomspark.operators import pages as P
from loomspark.sources.books import chapters_of, epubs


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_embedded_json(spark):
    page = r'<script>{"title":"A \"b\" é","pages":[[1,2],["]"]],"n":3}</script>'
    assert one(spark, page, lambda c: P.json_text(c, "title")) == 'A "b" é'
    assert one(spark, page, lambda c: P.json_text(c, "none")) is None
    assert one(spark, page, lambda c: P.json_list(c, "pages")) == '[[1, 2], ["]"]]'
    assert one(spark, '"pages":[1,', lambda c: P.json_list(c, "pages")) is None


def test_missed_links(spark):
    links = [(1, "https://e.com/b/", i, f"https://e.com/b/c-{i}", f"C{i}") for i in range(6)] + [(1, "https://e.com/b/", 6, "https://e.com/b/c-5#x", "again"), (1, "https://e.com/b/", 7, "https://other.com/b/c-9", "far"), (1, "https://e.com/b/", 8, "https://e.com/about", "about")]
    df = spark.createDataFrame(links, "page_id int, page_url string, pos int, url string, title string")
    listed = spark.createDataFrame([(1, i, f"https://e.com/b/c-{i}") for i in range(4)] + [(1, 9, "https://e.com/x")], "page_id int, pos int, url string")
    assert sorted((r["url"], r["title"]) for r in P.missed_links(df, listed).collect()) == [("https://e.com/b/c-4", "C4"), ("https://e.com/b/c-5", "C5")]


def test_hardcoded_parts(spark):
    df = spark.createDataFrame([("get('/book/12345')", "https://e.com/book/12345"), ("x=a-b-c", "https://e.com/p?s=a-b-c"), ("none", "https://e.com/book/12345"), ("abc", "https://e.com/abc")], "code string, url string")
    assert [r["y"] for r in df.select(P.hardcoded(F.col("code"), F.col("url")).alias("y")).collect()] == ["12345", "a-b-c", None, None]


def test_media_round_trip(spark):
    stored = 'a <img src="epub-media/s1/ab.png"> b'
    shown = one(spark, stored, lambda c: P.resolved_media(c, "s1"))
    assert shown == 'a <img src="/api/stories/s1/media/ab.png"> b'
    assert one(spark, shown.replace('.png"', '.png?vault=x"'), lambda c: P.restored_media(c, "s1")) == stored


def test_cleaned_blocks(spark):
    kind = "array<struct<type:string,level:int,text:string,src:string,alt:string>>"
    blocks = [("heading", 9, " H ", None, None), ("paragraph", None, " ", None, None), ("list", None, "item", None, None), ("image", None, None, "javascript:x", None), ("image", None, "t", "https://e.com/i", "a"), ("odd", None, "x", None, None), ("paragraph", 3, "p", "s", None)]
    got = [tuple(b) for b in one(spark, blocks, P.cleaned_blocks, kind)]
    assert got == [("heading", 6, "H", None, None), ("paragraph", None, "• item", None, None), ("image", None, None, "https://e.com/i", "a"), ("paragraph", None, "p", None, None)]


def test_rows(spark):
    f = spark.createDataFrame([(1, 50.0, 10.2, 10.0, "world"), (1, 0.0, 10.0, 10.0, "hello"), (1, 0.0, 30.0, 12.0, "next"), (2, 0.0, 5.0, 9.0, "other")], "page int, x double, y double, size double, text string")
    assert sorted(tuple(r) for r in P.text_rows(f).collect()) == [(1, 0, "hello world", 10.0), (1, 1, "next", 12.0), (2, 0, "other", 9.0)]


def test_rows_are_those_of_a_loop(spark):
    rng = random.Random(3)
    rows = [(p, x, rng.randrange(60) / 2, rng.choice([4.0, 6.0, 10.0]), rng.choice(["a", "bb ", " c\n d", "", "eee"])) for p in range(4) for x in rng.sample(range(1000), 60)]
    want, groups = [], {}
    for f in sorted(rows, key=lambda f: (f[0], f[2], f[1])):
        own = groups.setdefault(f[0], [])
        if not own or abs(f[2] - own[-1][0][2]) > own[-1][0][3] * 0.5:
            own.append([])
        own[-1].append(f)
    for page, found in groups.items():
        for n, row in enumerate(found):
            row.sort(key=lambda f: f[1])
            chars = {}
            for f in row:
                chars[f[3]] = chars.get(f[3], 0) + len(f[4])
            want.append((page, n, " ".join(" ".join(f[4] for f in row).split()), max(chars, key=chars.get)))
    df = spark.createDataFrame([(p, float(x), y, s, t) for p, x, y, s, t in rows], "page int, x double, y double, size double, text string")
    assert sorted(map(tuple, P.text_rows(df).collect())) == want


def test_highlights_and_chunks(spark):
    assert one(spark, "hello", lambda c: P.highlight_text(c, F.lit(1), F.lit(3))) == "el"
    assert one(spark, "hello", lambda c: P.highlight_text(c, F.lit(1), F.lit(9))) is None
    texts = ["a b c", "d e", "", "f " * 20, "", "g"]
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)] + [("j", 0, "h")], "k string, i int, text string")
    got = [(r["k"], r["n"], r["text"]) for r in P.paragraph_chunks(rows, "k", ["i"], "text", 5).orderBy("k", "chunk").collect()]
    assert got[:2] == [("j", 1, "h"), ("k", 3, "a b c\nd e\n")] and got[-1] == ("k", 2, "\ng")
    assert [n for _, n, _ in got[2:-1]] == [1] * len(got[2:-1]) and " ".join(t for _, _, t in got[2:-1]).split() == ["f"] * 20


def book(nav=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        items = '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png" properties="cover-image"/>'
        items += '<item id="n" href="n.xhtml" media-type="application/xhtml+xml" properties="nav"/>' if nav else ""
        z.writestr("OPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title></metadata><manifest>{items}</manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="i"/></spine></package>')
        z.writestr("OPS/a.xhtml", "<html><body><h1>From the page</h1><p>x</p></body></html>")
        z.writestr("OPS/b.xhtml", "<html><body><p>y</p></body></html>")
        z.writestr("OPS/i.png", b"x")
        z.writestr("OPS/n.xhtml", '<html><body><nav><a href="b.xhtml#t">Named <b>B</b></a></nav></body></html>')
    return out.getvalue()


def test_epub_files(spark, tmp_path):
    title, cover, chapters = chapters_of(book())
    assert (title, cover, [t for t, _ in chapters]) == ("Book", "OPS/i.png", ["Named B", "From the page"])
    assert [t for t, _ in chapters_of(book(False))[2]] == ["Chapter 1", "From the page"]
    (tmp_path / "one.epub").write_bytes(book())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    got = epubs(spark, str(tmp_path)).orderBy("order").collect()
    assert [(r["order"], r["chapter"]) for r in got] == [(1, "Named B"), (2, "From the page")]
