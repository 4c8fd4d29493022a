"""Test items of any number against documents, by joins on the seeds that both have.

Seeds of items are rows. What is looked for in the documents is told by a table of bits, which has a bound; it lets all
seeds of items through and a few more, which the join then leaves out. Documents are known by their text's SHA-256, so
equal texts are looked at once, however many there are:

1. one pass counts the items' seeds in the documents, and each segment keeps its rarest places;
2. one pass lists where documents have kept seeds; the join with them gives, for a text and a segment, the windows to align;
3. texts with windows are cut into blocks of words, which meet their windows, and these are aligned;
4. results go to all documents with the text.

No pass, and nothing that is sent, depends on the number of items; a block of words meets only segments that share enough
kept places with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .alignment import SEGMENT, align, limits, pair_codes, places_kept, segment_codes, segment_seeds
from .tables import dropped, written
from .textcodes import each_text, texts_in_chunks, word_codes

#: The table of bits has 16 bits for a seed and 2 ** MOST_BITS (128 MB) at most; with more seeds more others pass it.
MOST_BITS = 30
#: It is made in 2 ** PARTS parts.
PARTS = 10
#: Words of a text that are joined as one row.
BLOCK = 512


class Bits:
    """Which seeds may be among those looked for: none of them is ruled out."""

    def __init__(self, codes: DataFrame):
        self.width = min(MOST_BITS, max(2 * PARTS, (16 * codes.count()).bit_length()))
        inside = self.width - PARTS
        spot = F.shiftrightunsigned("code", 64 - self.width)
        spots = codes.select(spot.alias("spot")).distinct().withColumn("part", F.shiftright("spot", inside))

        def packed(rows: pa.Table) -> pa.Table:
            marks = np.zeros(1 << inside, np.uint8)
            marks[rows.column("spot").to_numpy() & ((1 << inside) - 1)] = 1
            return pa.table({"part": rows.column("part").slice(0, 1), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

        table = np.zeros(1 << (self.width - 3), np.uint8)
        size = 1 << (inside - 3)
        for part, marks in spots.groupBy("part").applyInArrow(packed, "part long, marks binary").collect():  # 128 MB at most
            table[part * size : (part + 1) * size] = np.frombuffer(bytes(marks), np.uint8)
        self.sent = codes.sparkSession.sparkContext.broadcast(table.tobytes())

    def met(self, codes: np.ndarray, ends: np.ndarray, gaps: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(position, seed code) of what may be looked for; ``ends``: for each word, where its text ends."""
        table = np.frombuffer(self.sent.value, np.uint8)
        wheres, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for gap in gaps:
            pairs = pair_codes(codes, gap)
            spot = pairs >> np.uint64(64 - self.width)
            at = np.flatnonzero((table[spot >> np.uint64(3)] >> (np.uint64(7) - (spot & np.uint64(7))).astype(np.uint8)) & 1)
            at = at[at + gap < ends[at]]
            wheres.append(at)
            found.append(pairs[at])
        return np.concatenate(wheres), np.concatenate(found)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, parts = [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            for part in segment_codes(text):
                at.append(k)
                parts.append(part.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(parts, pa.list_(pa.int64()))], names=["item", "words"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, segs, places, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for seg, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = words.values.to_numpy().view(np.uint64)
            for found in segment_seeds(own):
                codes.append(found)
                segs.append(np.full(len(found), seg))
                places.append(np.arange(len(found)))
                sizes.append(np.full(len(found), len(own)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes).view(np.int64)), *[pa.array(np.concatenate(x).astype(np.int64)) for x in (segs, places, sizes)]], names=["code", "seg", "place", "size"])


def _counted(bits: Bits, gaps: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in texts_in_chunks(batch.column(0)):
                codes, at = word_codes(data, bounds, loose=True)
                found, n = np.unique(bits.met(codes, np.repeat(at[1:], np.diff(at)), gaps)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    return run


def _hits(bits: Bits, gaps: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, bounds in texts_in_chunks(batch.column(1)):
                codes, at = word_codes(data, bounds, loose=True)
                where, found = bits.met(codes, np.repeat(at[1:], np.diff(at)), gaps)
                doc = np.searchsorted(at, where, side="right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + doc)), pa.array(found.view(np.int64)), pa.array(where - at[doc])], names=["key", "code", "pos"])

    return run


def _windows(least: float):
    """From (key, seg, size, spots) the windows of the text that hold enough kept places within the shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lows, highs = [], [], []
            sizes = batch.column(2).to_numpy()
            _, shifts, met = limits(sizes, least)
            for k, spots in enumerate(batch.column(3)):
                start = np.sort(spots.values.field("start").to_numpy())
                size, shift = int(sizes[k]), int(shifts[k])
                start = start[np.searchsorted(start, start + shift, side="right") - np.arange(len(start)) >= met[k]]
                if len(start):
                    cuts = np.flatnonzero(np.diff(start) > size) + 1
                    first, last = start[np.append(0, cuts)], start[np.append(cuts, len(start)) - 1]
                    at += [k] * len(first)
                    lows += np.maximum(0, first - shift).tolist()
                    highs += (last + size + 2 * shift).tolist()
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(own) for c in range(3)], pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["key", "seg", "size", "low", "high"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, codes in enumerate(each_text(batch.column(1), loose=True)):
            n = -(-len(codes) // BLOCK)
            parts = [codes[i * BLOCK : (i + 1) * BLOCK].view(np.int64) for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * n, pa.int64())), pa.array(range(n), pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["key", "block", "part"])


def _aligned(least: float, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shares = [], []
            for k, (words, window) in enumerate(zip(batch.column(5), batch.column(6), strict=True)):
                item, text = words.values.to_numpy(), window.values.to_numpy()
                score = float(limits(np.array([len(item)]), least)[0][0])
                if np.isin(item, text).sum() >= score:
                    found, _ = align(item, text)
                    if found >= score:
                        at.append(k)
                        shares.append(found / len(item))
            own = pa.array(at, pa.int64())
            columns = [batch.column(c).take(own).cast(arrow.field(c).type) for c in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shares, pa.float64())], schema=arrow)

    return run


def joined(source: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(id, item, score, window, item_words) of source (id, text) and distinct items (item, text)."""
    keyed = source.select("id", F.unhex(F.sha2("text", 256)).alias("key"), "text").filter("text is not null")
    kind = items.schema["item"]
    cut = StructType([kind, StructField("words", ArrayType(LongType()))])
    segments = written(items.orderBy("item", "text").mapInArrow(_segments, cut).withColumn("seg", F.monotonically_increasing_id()), "segments")
    postings = written(segments.select("seg", "words").mapInArrow(_postings, "code long, seg long, place long, size long"), "postings")
    gaps = [g for g in range(3) if g or not postings.filter("size = 1").isEmpty()]

    counts = keyed.select("text").mapInArrow(_counted(Bits(postings), gaps), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    spots = postings.join(counts, "code", "left").groupBy("seg", "place", "size").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    most = [int(n) for n in places_kept(np.arange(1, SEGMENT + 1), least)]  # by size
    rank = F.row_number().over(Window.partitionBy("seg").orderBy("n", "place"))
    rare = spots.withColumn("_rank", rank).filter(F.col("_rank") <= F.get(F.lit(most), F.col("size").cast("int") - 1)).select("seg", "place")
    kept = written(postings.join(rare, ["seg", "place"]), "kept")

    hits = keyed.select("key", "text").mapInArrow(_hits(Bits(kept), gaps), "key binary, code long, pos long").distinct()
    met = hits.join(kept, "code").select("key", "seg", "size", F.struct((F.col("pos") - F.col("place")).alias("start"), "place").alias("spot"))
    shared = met.groupBy("key", "seg", "size").agg(F.collect_set("spot").alias("spots"))  # a text's places in one segment
    windows = written(shared.mapInArrow(_windows(least), "key binary, seg long, size long, low long, high long"), "windows")

    texts = keyed.select("key", "text").join(windows.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    blocks = texts.mapInArrow(_blocks, "key binary, block long, part array<long>")
    first = F.floor(F.col("low") / BLOCK)
    wanted = windows.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("high") - 1) / BLOCK))))
    gathered = wanted.join(blocks, ["key", "block"]).groupBy("key", "seg", "size", "low", "high").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
    whole = F.flatten(F.transform("parts", lambda p: p["part"]))
    window = F.slice(whole, (F.col("low") - first * BLOCK + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    pairs = gathered.join(segments, "seg").select("key", "item", "seg", "size", "low", "words", window.alias("window"))
    found = StructType([*[pairs.schema[c] for c in ("key", "item", "seg", "size", "low")], StructField("score", DoubleType())])
    scored = pairs.mapInArrow(_aligned(least, to_arrow_schema(found)), found)
    first_best = F.struct((-F.col("score")).alias("s"), "seg", "low")
    best = written(scored.groupBy("key", "item").agg(F.min_by(F.struct("score", "low", "size"), first_best).alias("b")), "matches")
    dropped(segments, postings, kept, windows)
    return keyed.select("id", "key").join(best, "key").select("id", "item", "b.score", F.col("b.low").alias("window"), F.col("b.size").cast(IntegerType()).alias("item_words"))
