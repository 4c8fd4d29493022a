"""Site readers: a registry by host, a table function from page to rows, and checks of what readers return.

A reader is a Python class that the caller registers; nothing that a page or a model supplies is ever executed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pagehtml import BLOCKS, Reader
from ..functions.pagetree import Picker, Selector
from ..functions.text import collapsed
from ..functions.values import host_name
from ..operators.library import suffix_matches
from ..operators.pages import cleaned_blocks


class PageBlocks:
    """Table function (html, url) -> (pos, type, level, text, src): the blocks of a page, one row each."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        r = Reader(url or "")
        r.feed(html or "")
        r.close()
        r.flush()
        for i, b in enumerate(r.blocks):
            yield i, b["type"], b["level"], b["text"], b["src"]


def register(spark: SparkSession) -> None:
    """Makes page_blocks(html, url) known to SQL: SELECT ... FROM pages, LATERAL page_blocks(html, url)."""
    spark.udtf.register("page_blocks", F.udtf(PageBlocks, returnType="pos int, type string, level int, text string, src string"))


def dispatch(pages: DataFrame, host: str, registry: list[tuple[str, str]]) -> DataFrame:
    """Each page with the reader whose domain its host equals or is below; the longest domain wins, else null."""
    rules = pages.sparkSession.createDataFrame(registry, "domain string, reader string")
    hosts = pages.select(host).distinct()
    best = suffix_matches(hosts, host, rules, "domain").groupBy(host).agg(F.max_by("reader", F.length("domain")).alias("reader"))
    return pages.join(best, host, "left")


class Site(NamedTuple):
    """Where a site's pages have a chapter: its domain, and selectors of the content, the title, and what a locked page shows."""

    domain: str
    content: str
    title: str = "h1"
    locked: str = ".locked"


def site_chapters(pages: DataFrame, sites: Mapping[str, Site], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, reader, title, locked, blocks) of pages whose host, or a domain above it, has a reader; others have no row.

    A page is parsed once; its reader's selectors are followed while that goes on, and only text within the content is
    kept. Without a title of its own a page has that of its head, or its address. A locked page has content only if some
    is shown. Readers are data: nothing that a page supplies is executed.
    """
    known = {name: (Selector(s.content), Selector(s.title), Selector(s.locked)) for name, s in sites.items()}
    kind = pages.schema[id_col].dataType.simpleString()
    block = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("src", pa.string()), ("alt", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for reader, url, page in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                title, locked, blocks = Picker(url or "", *known[reader]).read(page or "")
                rows.append((title or url or "", locked, blocks))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), block))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "reader", "title", "locked", "blocks"])

    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_name(F.col(url_col)).alias("host"))
    dealt = dispatch(named, "host", [(s.domain, name) for name, s in sites.items()]).filter("reader is not null")
    found = dealt.select("id", "reader", "url", "html").mapInArrow(run, f"id {kind}, reader string, title string, locked boolean, blocks {BLOCKS}")
    return found.withColumnRenamed("id", id_col)


def valid_listing(rows: DataFrame, page_host: str, most: int) -> DataFrame:
    """A reader's chapter list made safe: http addresses of the page's host, no fragments, first of equals, ``most`` at most.

    rows: (page_id, pos, url, title, page_host). The limit is the feature: a list has at most that many chapters.
    """
    from pyspark.sql.window import Window

    clean = rows.withColumn("url", F.regexp_replace("url", "#.*$", "")).filter(F.col("url").rlike("^https?://"))
    clean = clean.filter(F.regexp_replace(F.lower(F.try_parse_url("url", F.lit("HOST"))), "^www\\.", "") == F.regexp_replace(F.lower(F.col(page_host)), "^www\\.", ""))
    first = clean.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))).filter("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("_n") <= most).drop("_n")


#: So many characters a chapter or an article has at least, and so many a title has at most.
LEAST_CHARS, LONGEST_TITLE = 200, 300


def _title(text: Column, default: Column) -> Column:
    """A title on one line, cut to length; an empty one is ``default``."""
    return F.coalesce(F.nullif(F.substring(collapsed(text), 1, LONGEST_TITLE), F.lit("")), default)


def _chars(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0), lambda n, b: n + F.coalesce(F.length(b["text"]), F.lit(0)))


def _pictured(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: b["type"] == "image")


def _problem(locked: Column, chars: Column, pictured: Column) -> Column:
    return F.when(F.coalesce(locked, F.lit(False)), "locked").when((chars < LEAST_CHARS) & ~pictured, "too short")


def valid_chapters(rows: DataFrame) -> DataFrame:
    """What readers returned as chapters made safe: (page_id, title, blocks, problem).

    rows: (page_id, url, title, locked, blocks), blocks as in `cleaned_blocks`. A chapter without a title has its address
    for one. problem: "locked" behind a login, "too short" below `LEAST_CHARS` characters without a picture, else null.
    """
    clean = rows.withColumn("blocks", cleaned_blocks(F.coalesce("blocks", F.array().cast(rows.schema["blocks"].dataType))))
    problem = _problem(F.col("locked"), _chars(F.col("blocks")), _pictured(F.col("blocks")))
    return clean.select("page_id", _title(F.col("title"), F.col("url")).alias("title"), "blocks", problem.alias("problem"))


def valid_articles(rows: DataFrame, most: int = 20_000) -> DataFrame:
    """What readers returned as whole texts made safe: (page_id, title, author, language, cover_url, chapters, problem).

    rows: (page_id, url, html, title, author, cover_url, locked, chapters), chapters an array of (title, blocks). Of at
    most ``most`` chapters (a text has no more: the limit is the feature) those with blocks stay; one without a title has
    its number among them. The title is the host where there is none, the language that of the page's html element, a
    cover a web address. problem as in `valid_chapters`, over all chapters.
    """
    kept = F.transform(F.slice(F.coalesce("chapters", F.array().cast(rows.schema["chapters"].dataType)), 1, most), lambda c: F.struct(c["title"].alias("title"), cleaned_blocks(c["blocks"]).alias("blocks")))
    kept = F.filter(kept, lambda c: F.size(c["blocks"]) > 0)
    named = F.transform(kept, lambda c, i: F.struct(_title(c["title"], (i + 1).cast("string")).alias("title"), c["blocks"].alias("blocks")))
    clean = rows.withColumn("chapters", named)
    chars = F.aggregate("chapters", F.lit(0), lambda n, c: n + _chars(c["blocks"]))
    problem = _problem(F.col("locked"), chars, F.exists("chapters", lambda c: _pictured(c["blocks"])))
    return clean.select(
        "page_id",
        _title(F.col("title"), host_name(F.col("url"))).alias("title"),
        _title(F.col("author"), F.lit(None)).alias("author"),
        F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)), F.lit("")).alias("language"),
        F.when(F.col("cover_url").rlike("(?i)^https?://"), F.col("cover_url")).alias("cover_url"),
        "chapters",
        problem.alias("problem"),
    )


def cast_problems(characters: Column) -> Column:
    """Violated rules of a cast list: empty, too many, bad id, repeated id, no name, head out of range."""
    ids = F.transform(characters, lambda c: c["id"])
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.size(characters), F.lit(0)) <= 0, "empty"),
            F.when(F.size(characters) > 12, "many"),
            F.when(F.exists(ids, lambda i: ~F.coalesce(i.rlike("^[a-z0-9-]{1,30}$"), F.lit(False))), "id"),
            F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated"),
            F.when(F.exists(characters, lambda c: F.trim(F.coalesce(c["name"], F.lit(""))) == ""), "name"),
            F.when(F.exists(characters, lambda c: ~F.coalesce(c["head_y"].between(-600, -200), F.lit(False))), "head"),
        )
    )
