"""Records, names, repairs, saved images, and page readers on small rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.functions import values as V
from loomspark.functions.pagehtml import Reader, import_sanitized, parsed, plain_text, sanitized
from loomspark.operators import library as L
from loomspark.operators import ordered as O
from loomspark.operators import pages as P
from loomspark.sources.tables import folder_bytes, settings_record


def test_names_are_probed_until_free(spark):
    rows = [(1, 1, "x"), (1, 2, "x"), (1, 3, "x (2)"), (1, 4, "x (2)"), (1, 5, "x"), (2, 1, "x"), (1, 6, None), (1, 7, "y (1) (2)"), (1, 8, "y (1) (2)")]
    got = O.unique_names(spark.createDataFrame(rows, "k int, i int, name string"), ["k"], ["i"], "name", "out")
    assert {(r["k"], r["i"]): r["out"] for r in got.collect()} == {
        (1, 1): "x", (1, 2): "x (2)", (1, 3): "x (2) (2)", (1, 4): "x (2) (3)", (1, 5): "x (3)", (2, 1): "x", (1, 6): None, (1, 7): "y (1) (2)", (1, 8): "y (1) (2) (2)"
    }


def test_places_in_one_order(spark):
    rows = [(i % 7, str(i % 3), i) for i in range(500)]
    got = O.numbered(spark.createDataFrame(rows, "a int, b string, c int").repartition(9), [("b", False), ("a", True), ("c", False)])
    want = {r: n for n, r in enumerate(sorted(sorted(sorted(rows, key=lambda r: -r[2]), key=lambda r: r[0]), key=lambda r: r[1], reverse=True), 1)}
    assert {(r["a"], r["b"], r["c"]): r["place"] for r in got.collect()} == want
    assert O.numbered(spark.createDataFrame([], "a int"), [("a", True)]).count() == 0


def test_the_last_of_several_rows_with_one_key_is_put(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, made string")
    new = spark.createDataFrame([(1, 1, "c", "p"), (1, 2, "d", "q"), (3, 1, "e", "r"), (3, 2, None, "s")], "k int, seq int, v string, made string")
    got = L.upsert(old, new, ["k"], ["made"], seq="seq")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "d", "x"), (2, "b", "y"), (3, None, "s")]


def test_symbols_beside_letters(spark):
    cases = {"nh|n": "nhan", "NH|N": "NHAN", "|n": "an", "a || b": "a || b", "x|| y": "xa| y", "A||": "AA|", "1|2": "1|2", "}x": "}x", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.with_letters(F.col("t"), {"|": "a"}).alias("o"))
    assert {r["t"]: r["o"] for r in df.collect()} == cases


def test_lost_vowels_break_a_text(spark):
    df = spark.createDataFrame([("c ng v n " * 20,), ("c ng " * 10,), ("|a " * 20,), ("plain",)], "t string")
    assert [r[0] for r in df.select(X.looks_broken(F.col("t"))).collect()] == [True, False, True, False]


def test_scan_replies(spark):
    replies = ['x {"twists": [{"order": 2, "what": " a  b ", "importance": 9}]} y', '{"twists": [{"order": 9, "what": "a"}]}', '{"twists": [{"order": 1, "what": " "}]}', "none", None]
    notes = X.scan_notes(F.col("r"))
    got = spark.createDataFrame([(r,) for r in replies], "r string").select(X.scan_problem(notes, F.array(F.lit(1), F.lit(2))).alias("p"), notes.alias("n")).collect()
    assert [r["p"] for r in got] == [None, "order", "what", "list", "list"]
    assert tuple(got[0]["n"][0]) == (2, "", "a b", 5)


def test_saved_images(spark):
    pages = spark.createDataFrame([(1, '<p>a<img alt="q" src="s1" class=x>b<img src="gone"></p><img src=\'s1\'>'), (2, "no images"), (3, None)], "id int, html string")
    got = P.saved_images(pages, spark.createDataFrame([("s1", "/f/1")], "src string, file string"), "id", "html")
    assert {r["id"]: r["html"] for r in got.collect()} == {1: '<p>a<img src="file:///f/1" alt="q" class=x>b</p><img src="file:///f/1">', 2: "no images", 3: None}


def test_embedded_json_with_escapes_and_long_values(spark):
    value = 'a "b" \\ \n é 😀 ' * 5000
    df = spark.createDataFrame([(value,), ("",), (None,)], "v string")
    html = F.concat(F.lit("<script>x="), F.to_json(F.struct(F.struct(F.col("v").alias("key")).alias("o"))), F.lit("</script>"))
    assert [r[0] for r in df.select(P.json_text(html, "key")).collect()] == [value, "", None]


def read(html):
    r = Reader("https://h.org/a/b")
    r.feed(html)
    r.close()
    r.close_whole()
    r.flush()
    return [(b["type"], b["text"] or b["src"]) for b in r.blocks]


def test_only_whole_names_are_chrome():
    assert read('<div class="post-header"><p>a</p></div><div class="x header"><p>b</p></div><div id="Sidebar">c</div><div class="gradient">d</div><form>e</form>') == [
        ("paragraph", "a"), ("paragraph", "d"), ("paragraph", "e")
    ]


def test_tables_media_and_figures_are_blocks():
    html = (
        "<p>a</p><table class=t><tr><td>1 &lt; 2</td></tr></table><pre>x\n  <b>y</b></pre><audio src=/s.mp3></audio><video><source src=v.mp4><source src=w.mp4></video>"
        "<figure><img src=i.png alt=k><figcaption>cap</figcaption></figure><table><tr><td> </td></tr></table><nav><table><tr><td>z</td></tr></table></nav>"
    )
    assert read(html) == [
        ("paragraph", "a"), ("html", "<table class=t><tr><td>1 &lt; 2</td></tr></table>"), ("html", "<pre>x\n  <b>y</b></pre>"), ("audio", "https://h.org/s.mp3"),
        ("video", "https://h.org/a/v.mp4"), ("image", "https://h.org/a/i.png"), ("paragraph", "cap"),
    ]


def test_markup_of_untrusted_texts(spark):
    text = '<p onclick="x()" style=a>t <a href="javascript:x">u</a> <a href="https://h/?a=1>2">v</a></p><script>bad()</script><svg><p>w</p></svg><input name=q>end'
    got = spark.createDataFrame([(text,)], "t string").select(import_sanitized("t"), sanitized("t"), plain_text("t")).first()
    assert got[0] == '<p>t <a>u</a> <a href="https://h/?a=1>2">v</a></p>end'
    assert "onclick" not in got[1] and "javascript" not in got[1] and "bad()" not in got[1]


def test_settings_take_the_last_value(spark):
    kv = spark.createDataFrame([("a", "9", 1), ("a", "1", 2), ("b", None, 1)], "key string, value string, seq int")
    assert settings_record(kv, {"a": "x", "b": "y"}).first().asDict() == {"a": "1", "b": "y"}


def test_canonical_addresses_and_folders(spark, tmp_path):
    rules = [(r"^https?://(?:www\.)?a\.org/s/(\d+).*$", "https://a.org/s/$1")]
    got = spark.createDataFrame([("http://www.a.org/s/12/x?y",), ("http://b.org/s/1",), (None,)], "u string").select(V.canonical(F.col("u"), rules))
    assert [r[0] for r in got.collect()] == ["https://a.org/s/12", "http://b.org/s/1", None]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f").write_bytes(b"12345")
    assert tuple(folder_bytes(spark, str(tmp_path)).first()) == (5, 1)
    assert tuple(folder_bytes(spark, str(tmp_path / "none")).first()) == (0, 0)


@pytest.mark.parametrize(("marks", "want"), [("FFS", (3, "done")), ("FFFS", (3, "failed")), ("F", (1, "retrying")), ("S", (1, "done")), ("FSFF", (2, "done"))])
def test_retry_loops(spark, marks, want):
    df = spark.createDataFrame([(1, i, m == "S") for i, m in enumerate(marks)], "k int, i int, ok boolean")
    r = L.retry_states(df, ["k"], ["i"], F.col("ok"), 3).first()
    assert (r["attempts"], r["state"]) == want


def test_editor_blocks(spark):
    from loomspark.functions.pagehtml import edited_blocks

    cases = {
        "before<p>one<br>two <b>bold</b></p>after": [("paragraph", "before"), ("paragraph", "one"), ("paragraph", "two <b>bold</b>"), ("paragraph", "after")],
        "<div><h2>A <i>head</i></h2><div class='sidebar'>kept &amp; safe</div></div>": [("heading", "A head"), ("paragraph", "kept &amp; safe")],
        "<p>&nbsp;<b> </b></p><script>x<p></script><hr>": [],
        "<table><tr><td>1 &lt; 2</td></tr></table><pre> a\n b</pre><table></table>": [("html", "<table><tr><td>1 &lt; 2</td></tr></table>"), ("html", "<pre> a\n b</pre>")],
        "<figure><img src=' a.png ' alt='x'><figcaption>cap</figcaption></figure><img alt='none'>": [("image", "a.png"), ("paragraph", "cap")],
        "<video><source src='v.mp4'><source src='w.webm'>none</video><audio src='a.mp3'></audio>": [("video", "v.mp4"), ("audio", "a.mp3")],
        "<a href='q'><img src='i.png'></a> text": [("paragraph", "<a href='q'><img src='i.png'></a> text")],
        "<p>open <b>bold</p><p>next</p>": [("paragraph", "open <b>bold"), ("paragraph", "next")],
        "": [],
    }
    df = spark.createDataFrame([*[(k,) for k in cases], (None,)], "h string")
    got = {r["h"]: [(b["type"], b["src"] or b["text"]) for b in r["b"]] for r in df.select("h", edited_blocks("h").alias("b")).collect()}
    assert got.pop(None) == [] and got == cases
    assert spark.createDataFrame([("<b>" * 100_000 + "x",)], "h string").select(edited_blocks("h")[0]["type"]).first()[0] == "paragraph"


def test_places_in_the_order_of_a_language(spark):
    order = "a A à ả ã á ạ ă â b d đ Đ e ê o ô ơ u ư y".split()
    rows = [(w, i) for i in range(20) for w in order]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for up in (True, False):
            got = O.numbered(spark.createDataFrame(rows, "w string, i int").repartition(5), [("w", up, "vi"), ("i", True)]).collect()
            want = sorted(rows, key=lambda r: (order.index(r[0]) * (1 if up else -1), r[1]))
            assert {r["place"]: (r["w"], r["i"]) for r in got} == dict(enumerate(want, 1))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_kinds_keys_and_limits(spark):
    heads = {b"RIFF....WAVE": "wav", b"fLaC........": "flac", b"OggS........": "ogg", b"....ftyp....": "m4a", b"ID3.........": "mp3", b"\xff\xe0..........": "mp3", b"\xff\xd8\xff.........": None, b"ID3": None, None: None, b"RIFF....WEBP": None}
    got = spark.createDataFrame([(bytearray(h) if h else None,) for h in heads], "b binary").select(V.audio_kind(F.col("b")).alias("k")).collect()
    assert [r["k"] for r in got] == list(heads.values())
    row = spark.createDataFrame([(["a", 'b"'], "t", ["x", "y"], "")], "parts array<string>, at string, ids array<string>, lang string")
    got = row.select(V.parts_key(F.col("parts")), V.storyboard_key(F.col("at"), F.col("ids"), F.col("parts")), V.narratable(F.col("lang")), V.narratable(F.lit("en")), V.part_seconds(F.lit("facebook")), V.part_seconds(F.lit(None))).first()
    sha = lambda x: hashlib.sha1(json.dumps(x, separators=(",", ":")).encode()).hexdigest()
    assert tuple(got) == (sha(["a", 'b"']), sha(["t", ["x", "y"], ["a", 'b"']]), True, False, 14100, 39600)


def test_slides_take_the_nearest_scene_with_somebody_in_it(spark):
    scenes = spark.createDataFrame([(1, 0, 0.0, 40.0, False), (1, 1, 40.0, 60.0, True), (1, 2, 60.0, 200.0, True), (2, 0, 0.0, 9.0, False), (2, 1, 9.0, 80.0, False)], "k int, idx int, lo double, hi double, preferred boolean")
    chapters = spark.createDataFrame([(1, 100.0), (2, 89.0), (3, 500.0)], "k int, seconds double")
    got = {(r["k"], r["slide"]): (r["idx"], r["shown"]) for r in O.slides(chapters, scenes, ["k"], "seconds").collect()}
    assert got == {(1, 0): (1, 50.0), (1, 1): (2, 50.0), (2, 0): (1, 89.0)}


def test_intermediate_tables_have_a_folder_of_the_application(spark):
    from loomspark.sources.tables import remembered, shared_folder

    at = shared_folder(spark)
    assert spark.sparkContext.applicationId in at and at != shared_folder(spark)
    assert remembered(spark, "file:///tmp/") == remembered(spark, "file:///tmp")
