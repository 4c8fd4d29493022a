"""Greedy matching in rounds against the sequential one, and repair of glyphs."""

import random

import pytest

from loomspark.operators import glyphs as G

SCORE = "doc string, left string, right string, score double"


def greedy(rows, least):
    left, right, out = set(), set(), set()
    for d, a, b, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if s > least and (d, a) not in left and (d, b) not in right:
            left.add((d, a))
            right.add((d, b))
            out.add((d, a, b, s))
    return out


@pytest.mark.parametrize(("seed", "levels"), [(1, 3), (2, 1), (3, 1000)])
def test_rounds_take_what_one_after_another_takes(spark, seed, levels):
    rng = random.Random(seed)
    pairs = {(d, f"l{rng.randrange(12)}", f"r{rng.randrange(12)}"): float(rng.randrange(levels + 1)) for d in "xyz" for _ in range(60)}
    rows = [(*k, s) for k, s in pairs.items()]
    got = {tuple(r) for r in G.one_to_one(spark.createDataFrame(rows, SCORE)).collect()}
    assert got == greedy(rows, 0.0)


def test_chains_take_a_round_for_each_link_and_nothing_takes_none(spark):
    rows = [("d", f"l{i:02}", f"r{i + k:02}", 100.0 - 2 * i - k) for i in range(8) for k in (0, 1)] + [("d", "n", "m", None)]
    got = {tuple(r) for r in G.one_to_one(spark.createDataFrame(rows, SCORE)).collect()}
    assert got == greedy(rows[:-1], 0.0)
    assert G.one_to_one(spark.createDataFrame([], SCORE)).count() == 0


def page(text, font, worn, at=0):
    """Glyphs of a text; worn: letter -> (unicode, outline)."""
    out = []
    for i, c in enumerate(text):
        unicode, outline = worn.get(c, (c, c if c.strip() else None))
        out.append(("d", at, i, font, font, ord(c), unicode, outline))
    return out


GLYPH = "doc string, page int, offset int, font string, family string, code int, unicode string, outline string"


def test_twins_then_votes_then_the_last_letter_left(spark):
    plain = "làm nhà cũ là mà của cùng vũ trụ lũ " * 2
    rows = page(plain, "good", {}, 1)
    # à has twins in the good font, ũ is blank and drawn as nothing else, x too: it is in no word of the document
    text = "cũ và vũ trụ lũ gỡx axb cxd exf gxh ixk"
    worn = {"à": ("|", "à"), "ũ": (" ", "odd ũ"), "x": (" ", "odd x")}
    rows += page(text, "bad", worn, 2)
    letters = {(r["font"], r["code"]): r["letter"] for r in G.glyph_letters(spark.createDataFrame(rows, GLYPH), "ũx").collect()}
    assert letters == {("bad", ord("à")): "à", ("bad", ord("ũ")): "ũ"}  # x also stands at a word's end
    inside = page(text.replace("gỡx", "gỡ"), "bad", worn, 2)
    df = spark.createDataFrame(page(plain, "good", {}, 1) + inside, GLYPH)
    assert {(r["code"], r["letter"]) for r in G.glyph_letters(df, "ũx").collect()} == {(ord("à"), "à"), (ord("ũ"), "ũ"), (ord("x"), "x")}
    fixes = {r["offset"]: r["letter"] for r in G.glyph_fixes(df, "ũx").collect()}
    assert fixes == {i: c for i, c in enumerate(text.replace("gỡx", "gỡ")) if c in "àũx"}


def test_too_few_words_decide_nothing(spark):
    rows = page("cũ vũ", "good", {}, 1) + page("cũ vũ", "bad", {"ũ": (" ", "odd")}, 2) + [("e", 1, 0, "f", "f", 1, " ", None)]
    assert G.glyph_letters(spark.createDataFrame(rows, GLYPH)).count() == 0


@pytest.mark.parametrize("few", [0, 64, 75, 1000])
def test_long_words_vote_as_short_ones_do(spark, few, monkeypatch):
    monkeypatch.setattr(G, "_FEW_LETTERS", few)
    text = f"{'a' * 70}ũb {'c' * 80}ũd {'e' * 30}ũ vũa"
    rows = page(text, "good", {}, 1) + page(text, "bad", {"ũ": (" ", "odd ũ")}, 2)
    got = G.glyph_letters(spark.createDataFrame(rows, GLYPH), "ũxy").collect()
    assert {(r["font"], r["code"], r["letter"]) for r in got} == {("bad", ord("ũ"), "ũ")}
