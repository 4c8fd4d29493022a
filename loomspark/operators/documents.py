"""Lines of scanned or typeset books into paragraphs and chapters, and repair of broken letters by votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import HEADING, PAGE_NUMBER, SENTENCE_END
from .layout import glued


def page_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, page, seq, text, indented): lines of form-feed pages without blank ones and without a page number at either end."""
    pages = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\f")).alias("page", "body"))
    lines = pages.select("id", "page", F.posexplode(F.split("body", "\n")).alias("seq", "raw")).filter(F.trim("raw") != "")
    w = Window.partitionBy("id", "page")
    edge = (F.col("seq") == F.min("seq").over(w)) | (F.col("seq") == F.max("seq").over(w))
    kept = lines.withColumn("edge", edge).filter(~(F.col("edge") & F.trim("raw").rlike(PAGE_NUMBER)))
    return kept.select("id", "page", "seq", F.trim("raw").alias("text"), F.col("raw").rlike(r"^\s").alias("indented"))


def paragraphs(lines: DataFrame, narrow: float = 0.9) -> DataFrame:
    """(id, chapter, paragraph, text) from page lines: chapter headings, then paragraphs by break flags.

    A line begins a paragraph when it is indented, or the line before it ends a sentence and either a page ends there or
    one of the two is shorter than ``narrow`` of the page's widest line. Headings number the chapters (0 before the first).
    """
    wide = Window.partitionBy("id", "page")
    order = Window.partitionBy("id").orderBy("page", "seq")
    x = lines.withColumn("width", F.max(F.length("text")).over(wide)).withColumn("heading", (F.length("text") <= 120) & F.col("text").rlike(HEADING))
    x = x.withColumns({"p_text": F.lag("text").over(order), "p_page": F.lag("page").over(order), "p_width": F.lag("width").over(order), "p_heading": F.lag("heading").over(order)})
    short = (F.length("p_text") < F.col("p_width") * narrow) | (F.length("text") < F.col("p_width") * narrow)
    ends = F.col("p_text").rlike(SENTENCE_END)
    breaks = F.col("p_text").isNull() | F.col("p_heading") | F.col("heading") | F.col("indented") | (ends & ((F.col("p_page") != F.col("page")) | short))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("paragraph", F.sum(breaks.cast("int")).over(upto)).withColumn("chapter", F.sum(F.col("heading").cast("int")).over(upto))
    body = x.filter(~F.col("heading"))
    joins = F.lead("paragraph").over(order) == F.col("paragraph")
    kept, joint = glued(F.col("text"), F.lead("text").over(order), joins)
    body = body.withColumn("kept", kept).withColumn("joint", joint)
    first = F.lag("paragraph").over(order).isNull() | (F.lag("paragraph").over(order) != F.col("paragraph"))
    body = body.withColumn("piece", F.concat(F.when(first, "").otherwise(F.lag("joint").over(order)), F.col("kept")))
    pieces = F.array_sort(F.collect_list(F.struct("page", "seq", "piece")))  # the lines of a paragraph
    joined = F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
    return body.groupBy("id", "chapter", "paragraph").agg(joined.alias("text"))


def symbol_letters(words: DataFrame, symbols: str, letters: Sequence[str], occurrences: int = 20, lead: float = 2.0) -> DataFrame:
    """Which letter each symbol stands for, from (word, n): fractional votes of the distinct broken words.

    A broken word has the symbol once; its vote is split among the letters that make a known word, by how common each
    is. A symbol is decided when it occurs often enough and its best letter has ``lead`` times the votes of the next.
    """
    spark = words.sparkSession
    marks = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    any_mark = f"[{''.join('\\' + s for s in symbols)}]"
    known = words.filter(~F.col("word").rlike(any_mark)).select(F.col("word").alias("candidate"), F.col("n").alias("found"))
    broken = words.filter(F.col("word").rlike(any_mark) & F.col("word").rlike(r"\p{L}"))
    broken = broken.select("word", "n", F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol")).filter(F.size(F.split("word", F.concat(F.lit("\\Q"), F.col("symbol"), F.lit("\\E")), -1)) == 2)
    tried = broken.select("word", "symbol", "n", F.explode(F.array(*[F.lit(c) for c in letters])).alias("letter"))
    tried = tried.withColumn("candidate", F.expr("replace(word, symbol, letter)")).join(known, "candidate")
    share = F.col("found") / F.sum("found").over(Window.partitionBy("symbol", "word"))
    votes = tried.withColumn("vote", share).groupBy("symbol", "letter").agg(F.sum("vote").alias("votes"))
    w = Window.partitionBy("symbol").orderBy(F.desc("votes"), "letter")
    ranked = votes.withColumns({"r": F.row_number().over(w), "next": F.coalesce(F.lead("votes").over(w), F.lit(0.0))}).filter("r = 1")
    often = broken.groupBy("symbol").agg(F.sum("n").alias("seen"))
    return marks.join(ranked, "symbol").join(often, "symbol").filter((F.col("seen") >= occurrences) & (F.col("votes") >= F.col("next") * lead)).select("symbol", "letter", "votes", "seen")
