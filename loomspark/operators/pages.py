"""Operators over page sources, links, positioned fragments and media references."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import collapsed, split_text, word_count
from ..functions.values import address_shape, host_name
from .packing import next_fit


def json_text(page: Column, key: str) -> Column:
    """The string value of a key in JSON that is embedded in a page; null if there is none."""
    raw = F.regexp_extract(page, '"' + key + r'":"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)
    found = F.from_json(F.concat(F.lit('{"v":"'), raw, F.lit('"}')), "v string")["v"]
    return F.when(F.instr(page, f'"{key}":"') > 0, found)


def _balanced(text: str, key: str) -> str | None:
    start = text.find(f'"{key}":')
    begin = text.find("[", start) if start >= 0 else -1
    if begin < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(text, begin)
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False) if isinstance(value, list) else None


def json_list(page: Column, key: str) -> Column:
    """The array value of a key in embedded JSON, as JSON text; its brackets may nest. Null if there is no whole one."""

    @F.pandas_udf(T.StringType())
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _balanced(x, key), na_action="ignore")

    return find(page)


def repeated_calls(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, page, blurred, url): each addPage({...}) call with a number and an address."""
    calls = pages.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(html_col, F.lit(r"addPage\(\{([^}]*)\}\)"), F.lit(1))).alias("call"))
    number = F.regexp_extract("call", r"pageNum:\s*(\d+)", 1).try_cast("int")
    url = F.regexp_extract("call", r'contentUrl:\s*"([^"]+)"', 1)
    return calls.select("id", number.alias("page"), F.col("call").rlike(r"blur:\s*true").alias("blurred"), url.alias("url")).filter("page is not null and url <> ''")


def missed_links(links: DataFrame, listed: DataFrame) -> DataFrame:
    """Links of a page with the shape that most listed links have, on the page's host, that the list lacks; each once.

    links: (page_id, page_url, pos, url, title); listed: (page_id, pos, url). Of equally common shapes the first seen.
    """
    shapes = listed.withColumn("shape", address_shape(F.col("url"))).groupBy("page_id", "shape").agg(F.count("*").alias("n"), F.min("pos").alias("s"))
    most = shapes.groupBy("page_id").agg(F.max_by("shape", F.struct("n", (-F.col("s")).alias("s"))).alias("shape"))
    near = links.withColumn("url", F.regexp_replace("url", "#.*$", "")).withColumn("shape", address_shape(F.col("url")))
    near = near.filter(host_name(F.col("url")) == host_name(F.col("page_url"))).join(most, ["page_id", "shape"])
    left = near.join(listed.select("page_id", "url"), ["page_id", "url"], "left_anti")
    return left.groupBy("page_id", "url").agg(F.min_by("title", "pos").alias("title"))


def hardcoded(code: Column, url: Column) -> Column:
    """The first specific-looking part of an address (4 characters, a digit or two hyphens) that a text contains."""
    path = F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/")
    values = F.regexp_extract_all(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), F.lit("=([^&]*)"), F.lit(1))
    parts = F.transform(F.concat(path, values), lambda p: F.try_url_decode(p))
    specific = lambda p: (F.length(p) >= 4) & (p.rlike("\\d") | (F.regexp_count(p, F.lit("-")) >= 2)) & F.contains(code, p)
    return F.get(F.filter(parts, specific), F.lit(0))


def resolved_media(text: Column, story: str) -> Column:
    """Stored media markers of a story as service addresses."""
    return F.regexp_replace(text, rf"epub-media/{story}/([\w.-]+)", f"/api/stories/{story}/media/$1")


def restored_media(text: Column, story: str) -> Column:
    """Service addresses, with any origin and query, as stored markers again."""
    return F.regexp_replace(text, rf"(?:https?://[^/\s\"']+)?/api/stories/{story}/media/([\w.-]+)(?:\?[^\s\"'<>]*)?", f"epub-media/{story}/$1")


def saved_images(pages: DataFrame, saved: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Pages whose images point at their saved files; images without one are taken out. saved: (src, file), a file each.

    Addresses are joined, not looked up row by row; a page's pieces are put together again from its own map.
    """
    tag, src = r"^<img\b[^>]*>", r"\ssrc\s*=\s*[\"']([^\"']*)[\"']"
    named = pages.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(F.regexp_extract_all(html_col, F.lit(r"<img\b[^>]*?" + src), F.lit(1)))).alias("src"))
    found = named.join(saved.select("src", "file"), "src").groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("src", "file"))).alias("_files"))
    joined = pages.join(found, F.col(id_col) == F.col("_id"), "left").withColumn("_files", F.coalesce("_files", F.create_map().cast("map<string,string>")))

    def piece(p):
        own = F.regexp_extract(p, tag, 0)
        file = F.try_element_at(F.col("_files"), F.regexp_extract(own, src, 1))
        put = F.concat(F.lit('<img src="file://'), file, F.lit('"'), F.regexp_replace(F.regexp_replace(own, src, ""), "(?i)^<img", ""))
        rest = F.substring(p, F.length(own) + 1, F.length(p))
        return F.when(own == "", p).otherwise(F.concat(F.coalesce(put, F.lit("")), rest))

    whole = F.array_join(F.transform(F.split(html_col, r"(?=<img\b)"), piece), "")
    return joined.withColumn(html_col, whole).select(*pages.columns)


def earliest_expiry(cookies: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, expires): the least exp, in seconds, among cookies that are signed tokens; null where none carries one."""
    payload = F.get(F.split(value, "\\."), F.lit(1))
    text = F.try_to_binary(F.translate(payload, "-_", "+/"), F.lit("base64")).cast("string")
    return cookies.groupBy(*keys).agg(F.min(F.get_json_object(text, "$.exp").try_cast("long")).alias("expires"))


def too_little_kept(kept: Column, whole: Column) -> Column:
    """Of a page of 8,000 characters or more, less than a quarter was kept."""
    return (whole >= 8000) & (kept < whole * 0.25)


def cleaned_blocks(blocks: Column) -> Column:
    """Untrusted blocks: known kinds with content only, levels from 1 to 6, lists as paragraphs that begin with a bullet."""
    kinds = ("heading", "paragraph", "image", "list")
    ok = lambda b: b["type"].isin(*kinds) & F.when(b["type"] == "image", F.coalesce(b["src"], F.lit("")).rlike("^https?://")).otherwise(F.trim(F.coalesce(b["text"], F.lit(""))) != "")

    def one(b):
        listed = b["type"] == "list"
        return F.struct(
            F.when(listed, "paragraph").otherwise(b["type"]).alias("type"),
            F.when(b["type"] == "heading", F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(b["level"], F.lit(2))))).alias("level"),
            F.when(listed, F.concat(F.lit("• "), F.trim(b["text"]))).when(b["type"] != "image", F.trim(b["text"])).alias("text"),
            F.when(b["type"] == "image", b["src"]).alias("src"),
            F.when(b["type"] == "image", b["alt"]).alias("alt"),
        )

    return F.transform(F.filter(blocks, ok), one)


def _row_numbers(tolerance: float):
    """Adds to fragments (page, y, size and others), in order, the row of their page; only where a row began is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, top, tall, row = object(), 0.0, 0.0, 0
        for batch in batches:
            rows = []
            for page, y, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if page != now:
                    now, top, tall, row = page, y, size, 0
                elif abs(y - top) > tall * tolerance:
                    top, tall, row = y, size, row + 1
                rows.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int32())], names=[*batch.schema.names, "row"])

    return run


def text_rows(fragments: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(page, row, text, size) from positioned fragments (page, x, y, size, text): a row holds what lies within
    ``tolerance`` of the size of the row's first fragment; its size is the one with the most characters, the first of
    equals. Fragments at one x are read by y, at one spot by their text. A page's fragments are sorted and read as a
    stream; what is gathered is a row."""
    f = fragments.select("page", "y", "size", "x", F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([*f.schema.fields, T.StructField("row", T.IntegerType())])
    placed = f.repartition("page").sortWithinPartitions("page", "y", "x").mapInArrow(_row_numbers(tolerance), schema)
    by_size = placed.groupBy("page", "row", "size").agg(F.sum(F.length("text")).alias("chars"), F.min("x").alias("first"), F.collect_list(F.struct("x", "y", "text")).alias("parts"))
    size = F.max_by("size", F.struct("chars", -F.col("first"))).alias("size")
    parts = F.transform(F.array_sort(F.flatten(F.collect_list("parts"))), lambda t: t["text"])
    return by_size.groupBy("page", "row").agg(collapsed(F.array_join(parts, " ")).alias("text"), size).select("page", "row", "text", "size")


def highlight_text(text: Column, start: Column, end: Column) -> Column:
    """The text of [start, end), or null where the range is not within it."""
    ok = (start >= 0) & (end > start) & (end <= F.char_length(text))
    return F.when(ok, F.substring(text, start + 1, end - start))


def paragraph_chunks(paragraphs: DataFrame, key: str, order: list[str], text: str, most: int) -> DataFrame:
    """(key, chunk, n, text): a key's paragraphs, in order, packed to ``most`` words a chunk; n paragraphs, a line each.

    A paragraph of more words is split at 6 characters a word, and each piece is a chunk of its own. Words are packed as a
    stream of rows (next fit); what is gathered is a chunk.
    """
    words = word_count(F.col(text))
    pieces = F.when(words > most, split_text(F.col(text), most * 6)).otherwise(F.array(text))
    each = paragraphs.select(F.col(key).alias("key"), *order, text, words.alias("words"), F.posexplode(pieces).alias("piece", "t"))
    placed = each.select("key", F.struct(*order, F.col(text).alias("_text"), "piece", "t").alias("pos"), F.when(F.col("words") > most, most + 1).otherwise(F.col("words")).alias("words"))
    packed = next_fit(placed, "key", "pos", "words", most, out="chunk")
    lines = F.transform(F.array_sort(F.collect_list("pos")), lambda p: p["t"])
    return packed.groupBy("key", "chunk").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("text")).withColumnRenamed("key", key)


def highlight_scan(highlights: DataFrame, story: str, chapter: str, start: str, end: str, text: str, out: str = "place") -> DataFrame:
    """A story's highlights that lie within their chapter's text, in reading order: by chapter, start, then end, with the
    words and the place from 1 in the story; of highlights of the same range each counts."""
    marked = highlights.withColumn("marked", highlight_text(F.col(text), F.col(start), F.col(end))).filter("marked is not null")
    return marked.withColumn(out, F.row_number().over(Window.partitionBy(story).orderBy(chapter, start, end))).drop(text)


def fresh(cached: DataFrame, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Cache entries that are not too old."""
    return cached.filter(F.unix_seconds(now) - F.unix_seconds(F.col(at)) < ttl_seconds)


def previous_match(plan: DataFrame, rendered: DataFrame) -> DataFrame:
    """Planned parts with the earlier rendering of just the same range and part, if any."""
    return plan.join(rendered.select("from_order", "to_order", "part", F.col("file").alias("previous")), ["from_order", "to_order", "part"], "left")


def best_files(files: DataFrame, ranks: dict[str, int], largest: int) -> DataFrame:
    """Of each item's files that are public, small enough and of a known format the one of the best rank, then the smallest."""
    order = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    ok = files.filter(~F.coalesce("private", F.lit(False)) & (F.col("size") <= largest)).withColumn("rank", order[F.col("format")]).filter("rank is not null")
    return ok.withColumn("_n", F.row_number().over(Window.partitionBy("item").orderBy("rank", "size", "name"))).filter("_n = 1").drop("_n")
