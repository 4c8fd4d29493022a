"""Typeset books: positioned runs of glyphs to lines, lines to blocks, and lines to chapters.

Whether a run stays on its line depends on what that line began with, so lines are put together in a fold over runs
streamed in order; all else is windows and grouping.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import HEADING, PAGE_NUMBER, SENTENCE_END, SPACE, collapsed, escaped
from .ordered import as_of, page_margins, upper_median, weighted_mode

BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, Window.currentRow)
ALL = (Window.unboundedPreceding, Window.unboundedFollowing)

#: SPACE and $ as Spark's patterns have them: \s is ASCII only, and $ is also before a last line end that is no SPACE.
_BLANK = SPACE.replace("\\s", " \\t-\\r")
_END = r"(?=\x85?\Z)"
#: What collapsed() changes.
_RAGGED = f"{_BLANK.replace(' ', '', 1)}|  |^ | $"


def _changed(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are alike."""
    before, now = column[:-1], column[1:]
    differs = pc.not_equal(before, now)
    if column.null_count:
        differs = pc.coalesce(differs, pc.xor(pc.is_null(before), pc.is_null(now)))
    return differs.to_numpy(zero_copy_only=False)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _put_together(columns: list[pa.Array], starts: np.ndarray) -> list[pa.Array]:
    """Whole lines, which begin at ``starts``, of runs (keys, seq, x, y, size, width, text): keys, seq, x, y, right, size, text."""
    *keys, seq, x, y, size, width, text = columns
    n = len(seq)
    first = np.zeros(n, bool)
    first[starts] = True
    line = np.cumsum(first) - 1
    head, last = starts[line], np.append(starts[1:], n) - 1
    sizes, xs, right = _numbers(size), _numbers(x), pc.add(x, width)

    ink = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    weight = ink.copy()
    blank = pc.match_substring_regex(text, _BLANK).to_numpy(zero_copy_only=False)
    opens, closes, bare = np.zeros(n, bool), np.zeros(n, bool), {}
    for i, t in zip(spaced := np.flatnonzero(blank), text.take(pa.array(spaced)).to_pylist(), strict=True):
        bare[i] = re.sub(_BLANK, "", t)
        ink[i], weight[i] = len(bare[i]), len(re.sub(f"^{_BLANK}+|{_BLANK}+{_END}", "", t))
        opens[i], closes[i] = bool(re.match(_BLANK, t)), bool(re.search(f"{_BLANK}{_END}", t))

    sofar = np.cumsum(ink) - ink
    cap = (sofar - sofar[head] == 1) & (sizes[head] > sizes * 2) & (ink > 0)
    joint = np.full(len(starts), -1)
    joint[line[cap]] = np.flatnonzero(cap)
    lone = np.arange(n) < joint[line]  # before a large first letter's word there is that letter alone
    apart = np.zeros(n, bool)
    apart[1:] = (xs[1:] - _numbers(right)[:-1] > sizes[1:] * 0.15) & ~closes[:-1] & ~opens[1:]
    apart &= ~(first | cap | lone)
    if (lone & blank).any():
        text = pc.replace_with_mask(text, pa.array(lone & blank), pa.array([bare[i] for i in np.flatnonzero(lone & blank)], text.type))
    pieces = pc.binary_join_element_wise(pa.array(["", " "], text.type).take(pa.array(apart.astype(np.int8))), text, pa.scalar("", text.type))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pieces), pa.scalar("", text.type))

    if pc.any(ragged := pc.match_substring_regex(texts, _RAGGED)).as_py():
        texts = pc.if_else(ragged, pc.utf8_trim(pc.replace_substring_regex(texts, f"{_BLANK}+", " "), " "), texts)

    kinds, code = np.unique(sizes, return_inverse=True)
    _, seen, kind = np.unique(line * len(kinds) + code, return_index=True, return_inverse=True)
    order = np.lexsort((seen, -np.bincount(kind, weight), line[seen]))
    most = seen[order[np.searchsorted(line[seen][order], np.arange(len(starts)))]]
    at = pa.array(starts)
    return [*(k.take(at) for k in keys), seq.take(at), x.take(at), y.take(at), right.take(pa.array(last)), size.take(pa.array(most)), texts]


def _assembled(n_keys: int, names: Sequence[str]):
    """Lines of runs that come in order: keys, seq, x, y, size, width, text, and 1 if a run is read, 2 more if it ends its line.

    Held are the runs of the line that is not yet whole. Only where the height changes, within what nothing ends, is
    looked at run by run, up to where a line begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = []  # columns of the open line's runs, by batch
        last, top, ended = None, 0.0, 0

        def whole(parts: list[list[pa.Array]], starts: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(_put_together([pa.concat_arrays(c) for c in zip(*parts, strict=True)], np.array(starts, np.int64)), names=list(names))

        for batch in batches:
            tells = _numbers(batch.column(n_keys + 6)).astype(np.int64)
            read, eol = pa.array(tells % 2 == 1), tells // 2
            stretch = pa.array(ended + np.cumsum(eol) - eol)
            ended += int(eol.sum())
            columns = [c.filter(read) for c in (*batch.columns[:-1], stretch)]
            n = len(columns[-1])
            if n == 0:
                continue
            began = last is None
            needed = [columns[i] for i in (*range(n_keys), -1, n_keys + 2, n_keys + 3)]
            *told, y, size = needed if began else [pa.concat_arrays(c) for c in zip(last, needed, strict=True)]
            last = [c.slice(n - 1) for c in needed]
            ends = np.logical_or.reduce([_changed(c) for c in told])
            y, size = _numbers(y), _numbers(size)
            if began:
                ends, y, size = np.append(True, ends), np.append(y[:1], y), np.append(size[:1], size)
            reach = 0.5 * np.where(size[:-1] > size[1:], size[:-1], size[1:])
            levels = np.flatnonzero(ends | (y[1:] != y[:-1]) | (np.arange(n) == 0))  # where runs of one height begin
            starts = []
            for i, j, end, least, height in zip(levels.tolist(), [*levels[1:].tolist(), n], ends[levels].tolist(), np.minimum.reduceat(reach, levels).tolist(), y[1:][levels].tolist(), strict=True):
                if end:
                    starts.append(i)
                    i, top = i + 1, height
                if abs(top - height) < least:
                    continue
                for k in range(i, j):
                    if abs(top - height) >= reach[k]:
                        starts.append(k)
                        top = height
                        if least > 0:
                            break
            runs = columns[:-1]
            if starts:
                cut = starts[-1]
                before = sum(len(c[0]) for c in held)
                if before + cut:
                    yield whole([*held, [c.slice(0, cut) for c in runs]], [0] * bool(held) + [before + i for i in starts[:-1]])
                held = []
                runs = [c.slice(cut) for c in runs]
            held.append(runs)
        if held:
            yield whole(held, [0])

    return run


def assembled_lines(runs: DataFrame, page_keys: Sequence[str] = ("doc", "page")) -> DataFrame:
    """(page keys, line, x, y, right, size, text) from runs (page keys, seq, x, y, size, width, text, eol).

    A run stays on the line while it is within half a size (the larger of its own and the last run's) of the height where
    the line began, and no run since has ended the line (``eol``). Text drawn again at a spot, to the nearest unit, is
    read once. A gap of over 0.15 of the size is a space. A first letter over twice as large as what follows belongs to
    the next word. A line's size is the one with most characters, of equals the first. Lines are numbered by the seq of
    their first run; those without text, and a bare number at either end of a page, go. Runs without text only end
    lines. Runs are dealt by page and never again: a page's rows are streamed, and leave their task as lines.
    """
    keys = list(page_keys)
    # a page's runs are put in order twice, by spot and by seq; heights come first, as a line's runs are mostly in order
    x = runs.withColumns({"_across": F.floor(F.col("x") + 0.5), "_up": F.floor(F.col("y") + 0.5)})
    by_spot = Window.partitionBy(*keys).orderBy("_up", "_across", "text", "seq")
    again = [F.col(c).eqNullSafe(F.col(f"_was{c}")) for c in ("_up", "_across", "text")]
    x = x.withColumns({f"_was{c}": F.lag(c).over(by_spot) for c in ("_up", "_across", "text")})
    read = F.coalesce(F.col("text") != "", F.lit(False)) & ~(again[0] & again[1] & again[2])
    told = x.withColumn("_tells", (F.when(read, 1).otherwise(0) + F.when(F.col("eol"), 2).otherwise(0)).cast("byte"))
    told = told.select(*runs.columns, "_tells").filter("_tells > 0")
    number = lambda c: F.col(c).cast("double").alias(c)
    fed = told.sortWithinPartitions(*keys, "seq").select(*keys, F.col("seq").cast("long").alias("seq"), *map(number, ("x", "y", "size", "width")), "text", "_tells")
    names = [*keys, "line", "x", "y", "right", "size", "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.select(*keys).schema), "line long", *(f"{c} double" for c in names[-5:-1]), "text string"])
    joined = fed.mapInArrow(_assembled(len(keys), names), schema)
    on_page = Window.partitionBy(*keys)
    edge = (F.col("line") == F.min("line").over(on_page)) | (F.col("line") == F.max("line").over(on_page))
    return joined.withColumn("_edge", edge).filter((F.col("text") != "") & ~(F.col("_edge") & F.col("text").rlike(PAGE_NUMBER))).drop("_edge")


def joined_drop_caps(lines: DataFrame, keys: Sequence[str] = ("doc",), order: Sequence[str] = ("page", "line")) -> DataFrame:
    """A lone letter over 1.3 times as large as the line of small letters behind it, on its page, is put in front of that.

    Where such pairs follow one another, each line serves in one of them: of a run of pairs every other one counts.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.col("text").rlike(r"^\p{L}$") & (F.col("page") == F.lead("page").over(w)) & (F.col("size") > F.lead("size").over(w) * 1.3) & F.lead("text").over(w).rlike("^[a-zà-ỹ]")
    x = lines.withColumn("_first", F.coalesce(first, F.lit(False))).withColumn("_at", F.row_number().over(w))
    run = F.max(F.when(~F.col("_first"), F.col("_at"))).over(w.rowsBetween(*BEFORE))
    x = x.withColumn("_taken", F.col("_first") & ((F.col("_at") - F.coalesce(run, F.lit(0))) % 2 == 1))
    x = x.withColumn("_cap", F.when(F.lag("_taken").over(w), F.lag("text").over(w)))
    text = F.concat(F.coalesce("_cap", F.lit("")), F.col("text"))
    return x.withColumn("text", text).filter(~F.col("_taken")).select(*lines.columns)


def glued(text: Column, following: Column, joins: Column) -> tuple[Column, Column]:
    """(what of a line stays, what stands before the next): a hyphen between a letter and a small letter goes, else a space comes."""
    hyphen = F.coalesce(joins & text.rlike("[A-Za-zÀ-ỹ]-$") & following.rlike("^[a-zà-ỹ]"), F.lit(False))
    return F.when(hyphen, F.substring(text, F.lit(1), F.char_length(text) - 1)).otherwise(text), F.when(hyphen, "").otherwise(" ")


def body_size(lines: DataFrame, keys: Sequence[str] = ("doc",)) -> DataFrame:
    """(keys, body): the size, to the nearest half, of most characters; of equals the first."""
    halves = lines.withColumn("_half", F.floor(F.col("size") * 2 + 0.5) / 2).withColumn("_long", F.char_length("text")).withColumn("_at", F.col("page") * 2**32 + F.col("line"))
    return weighted_mode(halves, keys, "_half", "_long", "_at").withColumnRenamed("mode", "body")


def line_gap(lines: DataFrame, keys: Sequence[str] = ("doc",)) -> DataFrame:
    """(keys, gap) of lines with a body: the upper median of steps down between neighbouring body lines of a page; else 1.2 bodies."""
    w = Window.partitionBy(*keys).orderBy("page", "line")
    plain = F.abs(F.col("size") - F.col("body")) < 0.5
    x = lines.withColumn("_plain", plain).withColumn("_step", F.when((F.lag("page").over(w) == F.col("page")) & F.lag("_plain").over(w) & F.col("_plain"), F.lag("y").over(w) - F.col("y")))
    found = upper_median(x.filter("_step > 0"), keys, "_step")
    bodies = lines.groupBy(*keys).agg(F.first("body").alias("body"))
    return bodies.join(found, list(keys), "left").select(*keys, F.coalesce("median", F.col("body") * 1.2).alias("gap"))


def typeset_blocks(lines: DataFrame, page_width: Column, doc_keys: Sequence[str] = ("doc",), run_keys: Sequence[str] = ("doc", "chapter")) -> DataFrame:
    """(run keys, block, type, text): headings and paragraphs of lines (run keys, page, line, x, y, right, size, text).

    A line of 1.15 times the body's size and at most 200 characters is a heading; a line like it right behind, on the same
    page and in the same size, goes on with it. A paragraph begins behind a heading, with an indent of over 0.8 of the
    size, with a change of size of over 0.5, on the same page behind a step of over 1.25 gaps or a sentence that ends
    over three sizes short of the margin, and on a new page behind the end of a sentence. Body size, gap and margins are
    those of the whole document (each page for margins). block is the place of its first line, by page and line.
    """
    doc, run = list(doc_keys), list(run_keys)
    sized = lines.join(body_size(lines, doc), doc)
    sized = sized.join(line_gap(sized, doc), doc)
    edges = page_margins(sized, [*doc, "page"], F.col("body"), page_width).withColumnsRenamed({"left": "_left", "right": "_edge"})
    sized = sized.join(edges, [*doc, "page"], "left")
    x = joined_drop_caps(sized, run)
    w = Window.partitionBy(*run).orderBy("page", "line")
    before = lambda c: F.lag(c).over(w)
    x = x.withColumn("_heading", (F.col("size") >= F.col("body") * 1.15) & (F.char_length("text") <= 200))
    same_page = before("page") == F.col("page")
    goes_on = before("_heading") & same_page & (before("size") == F.col("size"))
    indented = F.col("x") - F.coalesce("_left", "x") > F.col("size") * 0.8
    sentence = before("text").rlike(SENTENCE_END)
    short = before("right") < F.coalesce(before("_edge"), before("right")) - before("size") * 3
    lower = before("y") - F.col("y") > F.col("gap") * 1.25
    breaks = before("_heading") | indented | (F.abs(before("size") - F.col("size")) > 0.5) | F.when(same_page, lower | (sentence & short)).otherwise(sentence)
    opens = F.when(F.col("_heading"), ~goes_on).otherwise(breaks)
    x = x.withColumn("_opens", F.coalesce(opens, F.lit(True)))
    x = x.withColumn("block", F.last(F.when(F.col("_opens"), F.struct("page", "line")), ignorenulls=True).over(w.rowsBetween(*UPTO)))
    kept, joint = glued(F.col("text"), F.lead("text").over(w), ~F.lead("_opens").over(w) & ~F.col("_heading"))
    x = x.withColumn("_kept", kept).withColumn("_joint", joint)
    piece = F.concat(F.when(F.col("_opens"), "").otherwise(before("_joint")), F.col("_kept"))
    pieces = F.array_sort(F.collect_list(F.struct("page", "line", F.col("_piece").alias("t"))))  # the lines of one block
    found = x.withColumn("_piece", piece).groupBy(*run, "block").agg(F.first("_heading").alias("_heading"), escaped(F.array_join(F.transform(pieces, lambda p: p["t"]), "")).alias("text"))
    return found.select(*run, "block", F.when(F.col("_heading"), "heading").otherwise("paragraph").alias("type"), "text")


def chapter_starts(lines: DataFrame, outline: DataFrame, books: DataFrame, size: int = 20) -> DataFrame:
    """(doc, idx, title, page, top): where chapters begin, idx from 1; heights grow upwards, a null top is the page's head.

    From the outline (doc, title, page, top) where a book has one, else from its lines that are headings, if there are two
    or more, else one each ``size`` pages. books: doc, title, pages (numbered from 1). One of few pages is named as the book.
    """
    heads = lines.filter((F.char_length("text") <= 120) & F.col("text").rlike(HEADING)).select("doc", F.col("text").alias("title"), "page", F.col("y").cast("double").alias("top"), "line")
    outlined = outline.filter(collapsed(F.col("title")) != "").select("doc", collapsed(F.col("title")).alias("title"), "page", F.col("top").cast("double").alias("top"))
    ids = outlined.select("doc").distinct()
    enough = heads.groupBy("doc").agg(F.count("*").alias("n")).filter("n >= 2").select("doc").join(ids, "doc", "left_anti")
    rest = books.join(ids, "doc", "left_anti").join(enough, "doc", "left_anti").filter("pages > 0")
    rest = rest.withColumn("page", F.explode(F.sequence(F.lit(1), F.col("pages"), F.lit(size))))
    upto = F.least(F.col("page") + size - 1, F.col("pages"))
    label = F.when(F.col("pages") <= size, F.col("title")).otherwise(F.concat_ws("–", F.concat(F.lit("Pages "), F.col("page").cast("string")), upto.cast("string")))
    chunks = rest.select("doc", label.alias("title"), "page", F.lit(None).cast("double").alias("top"))
    every = outlined.withColumn("line", F.lit(0).cast("long")).unionByName(heads.join(enough, "doc", "left_semi")).unionByName(chunks.withColumn("line", F.lit(0).cast("long")))
    order = Window.partitionBy("doc").orderBy("page", F.col("top").desc_nulls_first(), "line", "title")
    return every.withColumn("idx", F.row_number().over(order).cast("long")).select("doc", "idx", "title", "page", "top")


def in_chapters(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Lines (doc, page, y, ...) with ``chapter``: the idx of the last start at or before them; 0 before the first.

    An as-of join on the key (page, -y), as heights grow upwards: starts of one page are told apart by their heights.
    """
    place = lambda page, y: F.struct(page.cast("long").alias("page"), (-y).cast("double").alias("down"))
    a = lines.withColumn("_place", place(F.col("page"), F.col("y")))
    b = starts.select("doc", place(F.col("page"), F.coalesce("top", F.lit(float("inf")))).alias("_since"), F.col("idx").alias("chapter"))
    return as_of(a, b, ["doc"], "_place", "_since", "chapter").withColumn("chapter", F.coalesce("chapter", F.lit(0))).drop("_place")
