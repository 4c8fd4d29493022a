"""EPUB files as rows: binary files, each unzipped in the task that reads it, with bounds on entries and bytes."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pagehtml import Reader

MOST_ENTRIES, MOST_BYTES = 10_000, 500_000_000
_NAMES = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/", "n": "http://www.daisy.org/z3986/2005/ncx/"}


def entries_of(content: bytes) -> dict[str, bytes]:
    """The entries of a zip; more or larger ones than allowed are an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_BYTES:
            raise ValueError("too large")
        return {i.filename: z.read(i) for i in infos}


def chapters_of(content: bytes) -> tuple[str, str, list[tuple[str, str]]]:
    """(title, cover path, [(chapter title, html)]): the spine's documents in order.

    A chapter's title comes from the navigation document, else the NCX, else its first heading, else its number.
    The cover is the metadata's, else the item with that property, else the guide's.
    """
    files = entries_of(content)
    root = ET.fromstring(files["META-INF/container.xml"]).find(".//c:rootfile", _NAMES).get("full-path")
    base, opf = posixpath.dirname(root), ET.fromstring(files[root])
    path = lambda href, at=base: posixpath.normpath(posixpath.join(at, unquote(href.partition("#")[0])))
    items = {i.get("id"): i for i in opf.iterfind(".//o:manifest/o:item", _NAMES)}
    titles: dict[str, str] = {}
    for item in items.values():
        where = path(item.get("href", ""))
        if "nav" in (item.get("properties") or "").split() and where in files:
            r = Reader()
            r.feed(files[where].decode("utf-8", "replace").replace("<nav", "<div").replace("</nav", "</div"))
            import re

            for href, label in re.findall(r'<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', files[where].decode("utf-8", "replace"), re.S):
                titles.setdefault(path(href, posixpath.dirname(where)), " ".join(re.sub(r"<[^>]*>", "", label).split()))
    for item in items.values():
        where = path(item.get("href", ""))
        if item.get("media-type") == "application/x-dtbncx+xml" and where in files:
            for point in ET.fromstring(files[where]).iterfind(".//n:navPoint", _NAMES):
                label, src = point.findtext("n:navLabel/n:text", "", _NAMES), point.find("n:content", _NAMES)
                if src is not None:
                    titles.setdefault(path(src.get("src", ""), posixpath.dirname(where)), " ".join(label.split()))
    found = []
    for ref in opf.iterfind(".//o:spine/o:itemref", _NAMES):
        item = items.get(ref.get("idref"))
        where = path(item.get("href", "")) if item is not None else None
        if where in files and item.get("media-type") in {"application/xhtml+xml", "text/html"}:
            page = files[where].decode("utf-8", "replace")
            r = Reader()
            r.feed(page)
            r.close()
            r.flush()
            head = next((b["text"] for b in r.blocks if b["type"] == "heading"), "")
            found.append((titles.get(where) or head or f"Chapter {len(found) + 1}", page))
    meta = opf.find(".//o:meta[@name='cover']", _NAMES)
    cover = items.get(meta.get("content")) if meta is not None else None
    cover = cover if cover is not None else next((i for i in items.values() if "cover-image" in (i.get("properties") or "").split()), None)
    guide = opf.find(".//o:guide/o:reference[@type='cover']", _NAMES)
    at = path(cover.get("href", "")) if cover is not None else path(guide.get("href", "")) if guide is not None else None
    return opf.findtext(".//d:title", "", _NAMES).strip(), at if at in files else "", found


def epubs(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, cover, order, chapter, html) of the EPUB files below ``path``; files that can't be read give no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    title, cover, chapters = chapters_of(content)
                except (KeyError, ValueError, AttributeError, ET.ParseError, zipfile.BadZipFile):
                    continue
                rows += [(name, title, cover, i, chapter, html) for i, (chapter, html) in enumerate(chapters, 1)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "title", "cover", "order", "chapter", "html"])

    return files.filter(F.col("length") <= MOST_BYTES).select("path", "content").mapInArrow(run, "file string, title string, cover string, order int, chapter string, html string")
