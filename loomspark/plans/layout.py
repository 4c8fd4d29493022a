"""Queries over documents that are set in type: runs to lines, lines to blocks and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SPACE, collapsed
from ..operators import glyphs as G
from ..operators import layout as L
from ..sources.tables import stored, table
from .registry import query

_WORD = r"[^\x20\x09-\x0D]+"
_BETWEEN = r"[\x20\x09-\x0D]+"


#: So many characters of text go to a task; their runs are some sixty times as many bytes.
_TASK_CHARS = 2_000_000
#: The same where each character is a row.
_TASK_GLYPHS = 1_000_000


def _parts(spark, lines, text, most=_TASK_CHARS) -> int:
    """Over how many tasks lines are dealt, so that a task's share of their runs can be sorted in memory."""
    chars = lines.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    return max(spark.sparkContext.defaultParallelism, chars // most + 1)


def runs(spark, d):
    """The words of ``documents`` where a press would set them: 40 lines a page, every run drawn twice.

    Long words are larger; every tenth line begins with a large letter set a little lower than the rest of its word;
    every other line says that it ends.
    """
    documents = table(spark, d, "documents")
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    lines = lines.select("doc_id", (F.floor(F.col("n") / 40) + 1).alias("page"), F.col("n").cast("long").alias("n"), "raw")
    # pages are dealt while they are short lines; their words, many times as large, are only ever put in order where they are
    dealt = lines.repartition(_parts(spark, documents, "text"), "doc_id", "page")
    pieces = F.when(F.col("raw").rlike(r"[\x09-\x0D]"), F.split("raw", _BETWEEN)).otherwise(F.split("raw", " "))  # a pattern takes longer
    worded = dealt.withColumn("words", F.array_remove(pieces, ""))
    cap = (F.col("n") % 10 == 0) & (F.length(F.get("words", F.lit(0))) > 1)
    words = worded.select("doc_id", "page", "n", cap.alias("cap"), F.size("words").alias("of"), F.posexplode("words").alias("k", "word"))
    upto = Window.partitionBy("doc_id", "page", "n").orderBy("k")
    words = words.withColumn("offset", F.coalesce(F.sum(F.length("word") + 1).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    words = words.withColumn("last", F.col("k") == F.col("of") - 1)
    shape = lambda x, y, size, width, text, eol: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), size.cast("double").alias("size"), width.cast("double").alias("width"), text.alias("text"), eol.alias("eol"))
    y, no = 800 - 18 * (F.col("n") % 40), F.lit(False)
    eol = F.col("last") & (F.col("n") % 2 == 0)
    size = F.when(F.length("word") > 9, 14).otherwise(12)
    plain = shape(50 + 6 * F.col("offset") + F.when(F.col("cap"), 20).otherwise(0), y, size, 6 * F.length("word"), F.col("word"), eol)
    letter = shape(F.lit(50), y, F.lit(30), F.lit(20), F.substring("word", 1, 1), no)
    rest = shape(F.lit(72), y + 3, F.lit(12), 6 * F.length("word") - 6, F.expr("substring(word, 2)"), eol)
    pieces = words.withColumn("runs", F.when(F.col("cap") & (F.col("k") == 0), F.array(letter, rest)).otherwise(F.array(plain)))
    each = pieces.select("doc_id", "page", "n", "k", F.posexplode("runs").alias("part", "r"), F.lit(0).alias("copy"))
    twice = each.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    seq = F.shiftleft("n", 32) + F.col("k") * 4 + F.col("part") * 2 + F.col("copy")
    return twice.select("doc_id", "page", seq.alias("seq"), "r.*")


@query("txt20_lines", rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
w AS (SELECT doc_id, n, regexp_extract_all(raw, '{_WORD}') AS ws FROM l),
k AS (SELECT doc_id, n, n // 40 + 1 AS page, trim(regexp_replace(array_to_string(ws, ' '), '{SPACE}+', ' ', 'g')) AS text, n % 10 = 0 AND length(ws[1]) > 1 AS cap, ws FROM w WHERE len(ws) > 0),
e AS (SELECT *, n = min(n) OVER (PARTITION BY doc_id, page) OR n = max(n) OVER (PARTITION BY doc_id, page) AS edge FROM k),
p AS (SELECT doc_id, n, i, CASE WHEN cap AND i = 1 THEN 12 WHEN length(ws[i]) > 9 THEN 14 ELSE 12 END AS size, CASE WHEN cap AND i = 1 THEN ws[i][2:] ELSE ws[i] END AS word FROM (SELECT doc_id, n, cap, ws, unnest(range(1, len(ws) + 1)) AS i FROM e)
      UNION ALL SELECT doc_id, n, 0, 30, ws[1][1] FROM e WHERE cap),
s AS (SELECT doc_id, n, size, sum(length(regexp_replace(word, '^{SPACE}+|{SPACE}+$', '', 'g'))) AS c, min(i) AS f FROM p GROUP BY ALL),
b AS (SELECT doc_id, n, arg_max(size, (c, -f)) AS size FROM s GROUP BY doc_id, n)
SELECT doc_id, page, n, CAST(50 AS DOUBLE) AS x, CAST(800 - 18 * (n % 40) AS DOUBLE) AS y, CAST(size AS DOUBLE) AS size, text FROM e JOIN b USING (doc_id, n)
WHERE text <> '' AND NOT (edge AND regexp_matches(text, '^[-–—\s]*\d+[-–—\s]*$'))""")
def lines(spark, d):
    """TXT-20, DED-02, WIN-13: the runs of whole documents, drawn twice, come back as their very lines."""
    got = L.assembled_lines(runs(spark, d), ["doc_id", "page"])
    return got.select("doc_id", "page", F.shiftright("line", 32).alias("n"), "x", "y", "size", "text")


def set_lines(spark, d):
    """The lines of ``documents`` on pages of 40 lines, with larger gaps, indents, sizes of headings and odd sizes."""
    x = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    x = x.select("doc", F.col("n").cast("long").alias("n"), collapsed(F.col("raw")).alias("text")).filter("text <> ''")
    size = F.when(F.col("n") % 13 == 4, 16.0).when(F.col("n") % 13 == 5, 16.0).when(F.col("n") % 17 == 6, 13.0).otherwise(12.0)
    slot = F.col("n") % 40
    return x.select(
        "doc", "n", (F.floor(F.col("n") / 40) + 1).alias("page"), (F.col("n") * 2 + 1).alias("line"), F.when(F.col("n") % 5 == 3, 70.0).otherwise(50.0).alias("x"),
        (800 - 18 * slot - 10 * F.floor(slot / 7)).cast("double").alias("y"), (50.0 + 6 * F.length("text")).alias("right"), size.alias("size"), "text",
    )


_SET = r"""l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
t AS (SELECT doc, n, trim(regexp_replace(raw, '{SPACE}+', ' ', 'g')) AS text FROM l),
u AS (SELECT doc, n, n // 40 + 1 AS page, n * 2 + 1 AS line, CASE WHEN n % 5 = 3 THEN 70.0 ELSE 50.0 END AS x, CAST(800 - 18 * (n % 40) - 10 * ((n % 40) // 7) AS DOUBLE) AS y, 50.0 + 6 * length(text) AS "right",
  CAST(CASE WHEN n % 13 IN (4, 5) THEN 16 WHEN n % 17 = 6 THEN 13 ELSE 12 END AS DOUBLE) AS size, text FROM t WHERE text <> '')""".replace("{SPACE}", SPACE)


@query("txt21_blocks", rf"""WITH {_SET},
c AS (SELECT *, n % 19 = 8 AND size = 12 AND regexp_matches(text, '^\p{{L}}[a-zà-ỹ]') AS cap FROM u),
f AS (SELECT doc, n, page, line, x, y, "right", size, CASE WHEN cap THEN text[2:] ELSE text END AS text FROM c UNION ALL SELECT doc, n, page, line - 1, x, y, "right", 30.0, text[1] FROM c WHERE cap),
h AS (SELECT doc, round(size * 2) / 2 AS half, sum(length(text)) AS w, min(page * 4294967296 + line) AS s FROM f GROUP BY ALL),
b AS (SELECT doc, arg_max(half, (w, -s)) AS body FROM h GROUP BY doc),
g AS (SELECT *, lag(y) OVER o - y AS step, lag(page) OVER o = page AND abs(lag(size) OVER o - body) < 0.5 AND abs(size - body) < 0.5 AS plain FROM f JOIN b USING (doc) WINDOW o AS (PARTITION BY doc ORDER BY page, line)),
m AS (SELECT doc, list_sort(list(step)) AS steps FROM g WHERE plain AND step > 0 GROUP BY doc),
e AS (SELECT doc, page, min(x) AS lft, greatest(max("right"), max(600.0) - min(x)) AS rgt FROM f JOIN b USING (doc) WHERE abs(size - body) < 0.5 GROUP BY ALL),
j AS (SELECT u.*, body, coalesce(steps[len(steps) // 2 + 1], body * 1.2) AS gap, lft, rgt, size >= body * 1.15 AND length(text) <= 200 AS head FROM u JOIN b USING (doc) LEFT JOIN m USING (doc) LEFT JOIN e USING (doc, page)),
k AS (SELECT *, lag(text) OVER o AS pt, lag(page) OVER o AS pp, lag(size) OVER o AS ps, lag(y) OVER o AS py, lag("right") OVER o AS pr, lag(rgt) OVER o AS pe, lag(head) OVER o AS ph FROM j WINDOW o AS (PARTITION BY doc ORDER BY line)),
q AS (SELECT *, CASE WHEN head THEN NOT (ph AND pp = page AND ps = size) ELSE ph OR x - coalesce(lft, x) > size * 0.8 OR abs(ps - size) > 0.5 OR
  CASE WHEN pp = page THEN py - y > gap * 1.25 OR regexp_matches(pt, '[.!?…:;"''”’»)\]]$') AND pr < coalesce(pe, pr) - ps * 3 ELSE regexp_matches(pt, '[.!?…:;"''”’»)\]]$') END END AS opens FROM k),
r AS (SELECT *, sum(CAST(coalesce(opens, true) AS INT)) OVER (PARTITION BY doc ORDER BY line) AS block FROM q),
z AS (SELECT doc, min(n) AS first_line, bool_or(head) AS head, CASE WHEN bool_or(head) THEN string_agg(text, ' ' ORDER BY line) ELSE replace(regexp_replace(string_agg(text, chr(1) ORDER BY line), '([A-Za-zÀ-ỹ])-\x01([a-zà-ỹ])', '\1\2', 'g'), chr(1), ' ') END AS text FROM r GROUP BY doc, block)
SELECT doc, first_line, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS type, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM z""")
def blocks(spark, d):
    """TXT-21, AGG-06, AGG-08, AGG-09, AGG-27, WIN-13: headings and paragraphs of typeset lines, some behind a large letter."""
    x = set_lines(spark, d)
    cap = (F.col("n") % 19 == 8) & (F.col("size") == 12) & F.col("text").rlike(r"^\p{L}[a-zà-ỹ]")
    letter = x.filter(cap).withColumns({"line": F.col("line") - 1, "size": F.lit(30.0), "text": F.substring("text", 1, 1)})
    rest = x.withColumn("text", F.when(cap, F.expr("substring(text, 2)")).otherwise(F.col("text")))
    got = L.typeset_blocks(stored(rest.unionByName(letter).drop("n")), F.lit(600.0), ["doc"], ["doc"])
    return got.select("doc", F.floor(F.col("block.line") / 2).alias("first_line"), "type", "text")


@query("txt22_chapters", rf"""WITH {_SET},
k AS (SELECT doc, n, page, line, y, CASE WHEN doc % 3 = 1 AND n % 50 IN (7, 30) THEN 'Chapter ' || n ELSE text END AS text FROM u),
p AS (SELECT doc, max(page) AS pages FROM k GROUP BY doc),
o AS (SELECT doc, 'Part ' || page AS title, page, 621.0 AS top, 0 AS line FROM (SELECT doc, unnest(range(1, pages + 1)) AS page FROM p WHERE doc % 3 = 0) WHERE page % 4 = 1
  UNION ALL SELECT doc, 'End of ' || page, page, 300.0, 0 FROM (SELECT doc, unnest(range(1, pages + 1)) AS page FROM p WHERE doc % 3 = 0) WHERE page % 4 = 1),
h AS (SELECT doc, text AS title, page, y AS top, line FROM k WHERE length(text) <= 120 AND regexp_matches(text, '^(?i:chương|chapter|hồi|quyển|phần|tập|part)\s+([0-9]+|(?i:[ivxlc]+))([^A-Za-z0-9_]|$)') AND doc NOT IN (SELECT doc FROM o)),
hh AS (SELECT * FROM h WHERE doc IN (SELECT doc FROM h GROUP BY doc HAVING count(*) >= 2)),
c AS (SELECT doc, CASE WHEN pages <= 20 THEN 'Book ' || doc ELSE 'Pages ' || page || '–' || least(page + 19, pages) END AS title, page, NULL AS top, 0 AS line FROM (SELECT doc, pages, unnest(range(1, pages + 1, 20)) AS page FROM p WHERE doc NOT IN (SELECT doc FROM o) AND doc NOT IN (SELECT doc FROM hh))),
s AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, coalesce(top, 1e9) DESC, line, title) AS idx FROM (SELECT * FROM o UNION ALL SELECT * FROM hh UNION ALL SELECT * FROM c)),
a AS (SELECT k.doc, k.n, length(k.text) AS c, coalesce(max(s.idx), 0) AS idx FROM k LEFT JOIN s ON s.doc = k.doc AND (s.page < k.page OR s.page = k.page AND coalesce(s.top, 1e9) >= k.y) GROUP BY k.doc, k.n, k.text)
SELECT a.doc, idx AS chapter, title, count(*) AS n_lines, min(n) AS first_line, CAST(sum(c) AS BIGINT) AS chars FROM a LEFT JOIN s USING (doc, idx) GROUP BY ALL""")
def chapters(spark, d):
    """TXT-22, JOIN-16: each line in the last chapter that starts at or before it, by page and height."""
    x = set_lines(spark, d)
    heading = (F.col("doc") % 3 == 1) & (F.col("n") % 50).isin(7, 30)
    x = stored(x.withColumn("text", F.when(heading, F.concat(F.lit("Chapter "), F.col("n").cast("string"))).otherwise(F.col("text"))))
    books = x.groupBy("doc").agg(F.max("page").alias("pages")).withColumn("title", F.concat(F.lit("Book "), F.col("doc").cast("string")))
    parts = books.filter("doc % 3 = 0").withColumn("page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages")))).filter("page % 4 = 1")
    entry = lambda name, top: parts.select("doc", F.concat(F.lit(name), F.col("page").cast("string")).alias("title"), "page", F.lit(top).alias("top"))
    outline = entry("Part ", 621.0).unionByName(entry("End of ", 300.0)).unionByName(parts.select("doc", F.lit(" ").alias("title"), "page", F.lit(10.0).alias("top")))
    starts = L.chapter_starts(x, outline, books)
    got = L.in_chapters(x, starts).groupBy("doc", "chapter").agg(F.count("*").alias("n_lines"), F.min("n").alias("first_line"), F.sum(F.length("text")).alias("chars"))
    return got.join(starts.select("doc", F.col("idx").alias("chapter"), "title"), ["doc", "chapter"], "left").select("doc", "chapter", "title", "n_lines", "first_line", "chars")


@query("txt27_glyphs", """WITH c AS (SELECT conv_id % 10 AS doc, conv_id AS page, turn, unnest(string_split(lower(text), '')) AS c, generate_subscripts(string_split(lower(text), ''), 1) - 1 AS i FROM conversations WHERE role = 'assistant')
SELECT doc, page, turn * 1048576 + i AS "offset", c AS letter FROM c WHERE c IN ('a', 'e')""")
def glyphs(spark, d):
    """TXT-27, AGG-13, AGG-14: two letters that the assistants' font has lost, one with twins elsewhere and one without, come back.

    Ten conversations of a kind are a document, each a page, in small letters. Every a of an assistant says "|" and is drawn as others' a;
    every e is blank and drawn as nobody else's.
    """
    said = table(spark, d, "conversations").select((F.col("conv_id") % 10).alias("doc"), F.col("conv_id").alias("page"), "turn", F.col("role").alias("font"), "text")
    # pages are dealt while they are texts; their glyphs, many times as large, stay where they are
    dealt = said.repartition(_parts(spark, said, "text", _TASK_GLYPHS), "doc", "page")
    c = dealt.select("doc", "page", "turn", "font", F.posexplode(F.split(F.lower("text"), "")).alias("i", "c")).filter("c <> ''")
    worn = F.col("font") == "assistant"
    unicode = F.when(worn & (F.col("c") == "a"), "|").when(worn & (F.col("c") == "e"), " ").otherwise(F.col("c"))
    outline = F.when(worn & (F.col("c") == "e"), "worn e").when(F.trim("c") != "", F.col("c"))
    shaped = c.select("doc", "page", (F.col("turn") * 1048576 + F.col("i")).alias("offset"), "font", F.col("font").alias("family"), F.ascii("c").alias("code"), unicode.alias("unicode"), outline.alias("outline"))
    found = G.glyph_fixes(shaped, "abcdefghijklmnopqrstuvwxyz" + G.LETTERS)
    return found.filter("letter is not null").select("doc", "page", "offset", "letter")
