"""Typeset books against plain loops over the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.operators import layout as L

RUN = "doc string, page int, seq long, x double, y double, size double, width double, text string, eol boolean"
LINE = "doc string, chapter long, page int, line long, x double, y double, right double, size double, text string"


def plain_lines(runs):
    """Lines of one page's runs, one after another."""
    lines, seen, ended, tall = [], set(), False, 0.0
    for r in sorted(runs, key=lambda r: r["seq"]):
        spot = (int((r["x"] + 0.5) // 1), int((r["y"] + 0.5) // 1), r["text"])
        if r["text"] and spot not in seen:
            seen.add(spot)
            if lines and not ended and abs(lines[-1]["y"] - r["y"]) < max(r["size"], tall) / 2:
                line = lines[-1]
                cap = len(line["text"].strip()) == 1 and line["first"] > 2 * r["size"] and r["text"].strip()
                if cap:
                    line["text"] = line["text"].strip()
                elif r["x"] - line["right"] > 0.15 * r["size"] and not line["text"][-1].isspace() and not r["text"][0].isspace():
                    line["text"] += " "
                line["text"] += r["text"]
            else:
                line = {"line": r["seq"], "x": r["x"], "y": r["y"], "first": r["size"], "text": r["text"], "sizes": {}}
                lines.append(line)
            line["sizes"][r["size"]] = line["sizes"].get(r["size"], 0) + len(r["text"].strip())
            line["right"], tall, ended = r["x"] + r["width"], r["size"], False
        ended = ended or bool(r["eol"])
    out = []
    for i, line in enumerate(lines):
        text = " ".join(line["text"].split())
        if text and not (i in (0, len(lines) - 1) and re.match(r"^[-–—\s]*\d+[-–—\s]*$", text)):
            out.append((line["line"], line["x"], line["y"], line["right"], max(line["sizes"], key=line["sizes"].get), text))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_runs_become_the_lines_of_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for page in range(1, 40):
        x = y = 0.0
        for seq in range(rng.randrange(0, 40)):
            if rng.random() < 0.15 and rows and rows[-1][1] == page:  # drawn again, a little off
                rows.append(rows[-1][:2] + (seq, rows[-1][3] + rng.choice([0.0, 0.1])) + rows[-1][4:])
                continue
            size = rng.choice([10.0, 10.0, 10.0, 12.0, 30.0])
            text = rng.choice(["", " ", "a", "T", "wo ", " rd", "longer", "12", "-"])
            y += rng.choice([0, 0, 0, 1, 4, 6, -14])
            rows.append(("d", page, seq, x, y, size, 5.0 * len(text), text, rng.choice([True, False, False, False, None])))
            x += 5.0 * len(text) + rng.choice([0, 1, 1.4, 1.6, 5])
    df = spark.createDataFrame(rows, RUN)
    got = {}
    for r in L.assembled_lines(df.repartition(7)).orderBy("page", "line").collect():
        got.setdefault(r["page"], []).append((r["line"], r["x"], r["y"], r["right"], r["size"], r["text"]))
    names = [c.split()[0] for c in RUN.split(", ")]
    for page in range(1, 40):
        own = [dict(zip(names, r, strict=True)) for r in rows if r[1] == page]
        assert got.get(page, []) == plain_lines(own), page


def test_a_large_first_letter_joins_its_word_on_and_off_its_line(spark):
    runs = [("d", 1, 0, 0.0, 100.0, 40.0, 20.0, "O ", False), ("d", 1, 1, 30.0, 104.0, 10.0, 50.0, "nce upon", False), ("d", 1, 2, 90.0, 104.0, 10.0, 20.0, "a", True)]
    assert [r["text"] for r in L.assembled_lines(spark.createDataFrame(runs, RUN)).collect()] == ["Once upon a"]
    row = lambda i, size, text, page=1: ("d", 0, page, i, 0.0, 0.0, 0.0, size, text)
    lines = [row(0, 30.0, "O"), row(1, 10.0, "nce upon"), row(2, 30.0, "A"), row(3, 10.0, "Time"), row(4, 90.0, "x"), row(5, 60.0, "y"), row(6, 40.0, "z"), row(7, 10.0, "end"), row(8, 30.0, "B"), row(9, 10.0, "ack", 2)]
    got = L.joined_drop_caps(spark.createDataFrame(lines, LINE)).orderBy("page", "line").collect()
    assert [r["text"] for r in got] == ["Once upon", "A", "Time", "xy", "zend", "B", "ack"]


def plain_blocks(lines, body, gap, margins):
    out, before = [], None
    for r in lines:
        if r["size"] >= body * 1.15 and len(r["text"]) <= 200:
            if before and before["head"] and before["page"] == r["page"] and before["size"] == r["size"]:
                out[-1][1] += " " + r["text"]
            else:
                out.append(["heading", r["text"]])
            before = r | {"head": True}
            continue
        left, right = margins.get(r["page"], (r["x"], None))
        breaks = before is None or before["head"] or r["x"] - left > 0.8 * r["size"] or abs(before["size"] - r["size"]) > 0.5
        if not breaks:
            sentence = out[-1][1][-1] in ".!?…:;\"'”’»)]"
            edge = margins.get(before["page"], (None, before["right"]))[1]
            short = before["right"] < edge - 3 * before["size"]
            breaks = before["y"] - r["y"] > 1.25 * gap or sentence and short if before["page"] == r["page"] else sentence
        if breaks:
            out.append(["paragraph", r["text"]])
        elif re.search("[A-Za-zÀ-ỹ]-$", out[-1][1]) and re.match("[a-zà-ỹ]", r["text"]):
            out[-1][1] = out[-1][1][:-1] + r["text"]
        else:
            out[-1][1] += " " + r["text"]
        before = r | {"head": False}
    return [tuple(b) for b in out]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_those_of_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for chapter in range(3):
        for page in range(chapter * 4, chapter * 4 + 4):
            y = 800.0
            for _ in range(rng.randrange(0, 14)):
                y -= rng.choice([14.0, 14.0, 14.0, 17.5, 18.0, 30.0])
                text = rng.choice(["some words here.", "a line that ends in hy-", "phen", "Upper", "He said:", "x" * 201, "(so)", "é-", "à"])
                rows.append(("d", chapter, page, len(rows), rng.choice([50.0, 50.0, 58.0, 70.0]), y, rng.choice([200.0, 500.0, 540.0]), rng.choice([10.0, 10.0, 10.0, 10.4, 11.0, 12.0, 12.0]), text))
    df = spark.createDataFrame(rows, LINE)
    names = [c.split()[0] for c in LINE.split(", ")]
    lines = [dict(zip(names, r, strict=True)) for r in rows]
    weight = {}
    for r in lines:
        half = int(r["size"] * 2 + 0.5) / 2
        weight[half] = weight.get(half, 0) + len(r["text"])
    body = max(weight, key=weight.get)
    plain = lambda r: abs(r["size"] - body) < 0.5
    steps = sorted(a["y"] - b["y"] for a, b in zip(lines, lines[1:]) if a["page"] == b["page"] and a["y"] > b["y"] and plain(a) and plain(b))
    gap = steps[len(steps) // 2] if steps else body * 1.2
    margins = {}
    for r in lines:
        if plain(r):
            left, right = margins.get(r["page"], (r["x"], r["right"]))
            margins[r["page"]] = min(left, r["x"]), max(right, r["right"])
    margins = {p: (left, max(right, 600 - left)) for p, (left, right) in margins.items()}
    assert [r["body"] for r in L.body_size(df).collect()] == [body]
    got = L.typeset_blocks(df.repartition(5), F.lit(600.0)).orderBy("chapter", "block").collect()
    for chapter in range(3):
        own = [r for r in lines if r["chapter"] == chapter]
        assert [(r["type"], r["text"]) for r in got if r["chapter"] == chapter] == plain_blocks(own, body, gap, margins)


def test_chapters_begin_at_the_outline_or_headings_or_pages(spark):
    rows = [("a", 0, p, p * 10 + i, 0.0, 90.0 - 10 * i, 0.0, 10.0, t) for p in (1, 2) for i, t in enumerate(["intro", "Chapter 1" if p == 1 else "text", "body", "Chapter II" if p == 1 else "more", "end"])]
    rows += [("b", *r[1:]) for r in rows] + [("c", 0, p, p, 0.0, 50.0, 0.0, 10.0, "page") for p in (1, 20, 21, 45)] + [("e", 0, 1, 1, 0.0, 50.0, 0.0, 10.0, "Chapter 9")]
    lines = spark.createDataFrame(rows, LINE)
    outline = spark.createDataFrame([("b", " The  start ", 1, 75.0), ("b", "", 1, 60.0), ("b", "Second page", 2, None), ("b", "Its foot", 2, 60.0)], "doc string, title string, page int, top double")
    books = spark.createDataFrame([("a", "A", 2), ("b", "B", 2), ("c", "C", 45), ("e", "E", 3), ("z", "Z", 0)], "doc string, title string, pages int")
    starts = L.chapter_starts(lines, outline, books)
    got = {}
    for r in starts.orderBy("doc", "idx").collect():
        got.setdefault(r["doc"], []).append((r["title"], r["page"], r["top"]))
    assert got == {
        "a": [("Chapter 1", 1, 80.0), ("Chapter II", 1, 60.0)],
        "b": [("The start", 1, 75.0), ("Second page", 2, None), ("Its foot", 2, 60.0)],
        "c": [("Pages 1–20", 1, None), ("Pages 21–40", 21, None), ("Pages 41–45", 41, None)],
        "e": [("E", 1, None)],
    }
    found = L.in_chapters(lines, starts).collect()
    for r in found:
        own = [(i, p, 1e9 if t is None else t) for i, (_, p, t) in enumerate(got[r["doc"]], 1)]
        assert r["chapter"] == max((i for i, p, t in own if not (r["page"] < p or r["page"] == p and r["y"] > t)), default=0), r
    assert len(found) == len(rows)
    assert L.in_chapters(lines.limit(0), starts).count() == 0
