"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment of words.

Test items are cut into segments of nearly equal length. The seeds at a place of a segment are its word with the next
word, and with the next but one. A best alignment of score t has t - 1 or more matched words whose next matched word is
at most one error away, and each of these shares a seed with the document at its place. So, of a segment with n - 1
places, any n - t + k hold k shared ones, and only as many are kept: those whose seeds are rarest over all documents.
Where k kept places meet a document within the shift that such a score leaves for gaps, that window of the document is
aligned with the segment. No copy of the least score is missed, whatever its edits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .alignment import SEGMENT, align, limits, pair_codes, places_kept, segment_codes, segment_seeds
from .seedjoin import joined
from .tables import dropped, read, written
from .textcodes import texts_in_chunks, word_codes

class Seeds:
    """A block of segments with an index of their word pairs (all, until ``keep`` leaves those of the rarer places)."""

    def __init__(self, items: list[tuple[object, str | None]], least: float):
        self.item, self.words = [], []
        for key, text in items:
            for part in segment_codes(text):
                self.item.append(key)
                self.words.append(part)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.score, self.shift, self.met_least = limits(self.size, least)
        self.kept = places_kept(self.size, least)
        self.gaps = [g for g in range(3) if g or (self.size == 1).any()]
        found = [(k, c) for k, w in enumerate(self.words) for c in segment_seeds(w)]
        codes = np.concatenate([np.zeros(0, np.uint64), *[c for _, c in found]])
        self.codes, where = np.unique(codes, return_inverse=True)
        none = np.zeros(0, np.int64)
        self.index(where, np.concatenate([none, *[np.full(len(c), k) for k, c in found]]), np.concatenate([none, *[np.arange(len(c)) for _, c in found]]))

    def index(self, seed: np.ndarray, segment: np.ndarray, place: np.ndarray) -> None:
        """Postings (segment, place) of each seed, and a table of bits that rules most other codes out."""
        order = np.argsort(seed, kind="stable")
        self.seed, self.segment, self.place = seed[order], segment[order], place[order]
        self.first = np.searchsorted(self.seed, np.arange(len(self.codes) + 1))
        self.likely = np.zeros(1 << 22, dtype=bool)
        self.likely[self.codes[self.first[1:] > self.first[:-1]] >> np.uint64(42)] = True

    def keep(self, counts: np.ndarray) -> None:
        """Leaves, of each segment, the places with the rarest seeds: as many as surely hold ``met_least`` shared ones."""
        spot = self.segment * SEGMENT + self.place
        spots, at = np.unique(spot, return_inverse=True)
        n = np.bincount(at, weights=counts[self.seed], minlength=len(spots))
        segment = spots // SEGMENT
        order = np.lexsort((n, segment))
        rank = np.empty(len(spots), np.int64)
        rank[order] = np.arange(len(spots)) - np.searchsorted(segment, segment[order])
        rare = (rank < self.kept[segment])[at]
        self.index(self.seed[rare], self.segment[rare], self.place[rare])

    def met(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, seed) of every seed in texts laid end to end; ``ends``: for each word, where its text ends."""
        wheres, seeds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for gap in self.gaps:
            pairs = pair_codes(codes, gap)
            at = np.flatnonzero(self.likely[pairs >> np.uint64(42)])
            at = at[at + gap < ends[at]]
            if len(at):
                k = np.minimum(np.searchsorted(self.codes, pairs[at]), len(self.codes) - 1)
                hit = (self.codes[k] == pairs[at]) & (self.first[k + 1] > self.first[k])
                wheres.append(at[hit])
                seeds.append(k[hit])
        return np.concatenate(wheres), np.concatenate(seeds)


def _counted(seeds: Seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(seeds.codes), np.int64)
        for batch in batches:
            for _, _, data, bounds in texts_in_chunks(batch.column(0)):
                codes, at = word_codes(data, bounds, loose=True)
                _, seed = seeds.met(codes, np.repeat(at[1:], np.diff(at)))
                total += np.bincount(seed, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["seed", "n"])

    return run


#: Postings that are looked at together, but for a single text with more.
_POSTINGS = 1 << 22


def _aligned(seeds: Seeds, codes: np.ndarray, at: np.ndarray) -> list[tuple[int, object, float, int, int]]:
    """(text, item, score, where its window begins, words of the segment) for each item that a text repeats.

    ``codes``: the words of texts laid end to end; ``at``: where each text begins, and the end.
    """
    out: list[tuple[int, object, float, int, int]] = []
    where, seed = seeds.met(codes, np.repeat(at[1:], np.diff(at)))
    order = np.argsort(where, kind="stable")
    where, seed = where[order], seed[order]
    each = np.append(0, np.cumsum(seeds.first[seed + 1] - seeds.first[seed]))
    doc_at = np.searchsorted(where, at)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(each[doc_at], each[doc_at[i]] + _POSTINGS, side="right")) - 1)
        out += _aligned_part(seeds, codes, at, where[doc_at[i] : doc_at[j]], seed[doc_at[i] : doc_at[j]])
        i = j
    return out


def _aligned_part(seeds: Seeds, codes: np.ndarray, at: np.ndarray, where: np.ndarray, seed: np.ndarray) -> list[tuple[int, object, float, int, int]]:
    if not len(where):
        return []
    n = seeds.first[seed + 1] - seeds.first[seed]
    post = np.repeat(seeds.first[seed] - np.cumsum(n) + n, n) + np.arange(n.sum())
    segment, place, where = seeds.segment[post], seeds.place[post], np.repeat(where, n)
    doc = np.searchsorted(at, where, side="right") - 1
    start = where - at[doc] - place
    order = np.lexsort((place, start, segment, doc))
    doc, segment, start, place = doc[order], segment[order], start[order], place[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1]) | (start[1:] != start[:-1]) | (place[1:] != place[:-1])
    doc, segment, start = doc[new], segment[new], start[new]
    own = np.ones(len(doc), dtype=bool)
    own[1:] = (doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1])
    line = (np.cumsum(own) - 1) * (len(codes) + 4 * SEGMENT) + start  # further apart than any shift between groups
    dense = np.searchsorted(line, line + seeds.shift[segment], side="right") - np.arange(len(line)) >= seeds.met_least[segment]
    doc, segment, start, line = doc[dense], segment[dense], start[dense], line[dense]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = line[1:] - line[:-1] > seeds.size[segment[1:]]
    edges = np.append(np.flatnonzero(new), len(doc))
    best: dict[tuple[int, object], tuple[float, int, int]] = {}
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        d, k = int(doc[a]), int(segment[a])
        item, size, shift = seeds.words[k], int(seeds.size[k]), int(seeds.shift[k])
        low = max(0, int(start[a]) - shift)
        window = codes[at[d] + low : min(at[d + 1], at[d] + int(start[b - 1]) + size + 2 * shift)]
        if np.isin(item, window).sum() < seeds.score[k]:
            continue
        score, _ = align(item, window)
        share, key = score / size, (d, seeds.item[k])
        if score >= seeds.score[k] and (key not in best or share > best[key][0]):
            best[key] = (share, low, size)
    return [(*key, *what) for key, what in best.items()]


#: Bytes of test items that are sent to the executors at most; more are joined with the documents by their seeds.
SENT_BYTES = 4 << 20


def _sent(source: DataFrame, items: DataFrame, least: float, schema: StructType) -> DataFrame:
    """Matches of few items, all of which every task holds: two passes over the documents, nothing of which is shuffled."""
    spark = source.sparkSession
    arrow = to_arrow_schema(schema)
    rows = items.orderBy("item", "text").collect()  # SENT_BYTES bounds them
    seeds = Seeds([(r["item"], r["text"]) for r in rows], least)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(seeds))

    def count(batches):
        return _counted(pickle.loads(sent.value))(batches)

    counts = np.zeros(len(seeds.codes), np.int64)
    if len(seeds.codes):
        for r in source.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():  # a number for each seed
            counts[r["seed"]] = r["n"]
    seeds.keep(counts)
    kept = spark.sparkContext.broadcast(cloudpickle.dumps(seeds))

    def match(batches):
        own = pickle.loads(kept.value)
        for batch in batches:
            rows = []
            for i, _, data, bounds in texts_in_chunks(batch.column(1)):
                rows += [(i + k, *what) for k, *what in _aligned(own, *word_codes(data, bounds, loose=True))]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())).cast(arrow.field(0).type)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[c] for r in rows], arrow.field(c).type) for c in range(1, 5)]], schema=arrow)

    return source.mapInArrow(match, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = 0.5) -> DataFrame:
    """(id_col, item_col, score, window, item_words): each document with each test item that it repeats.

    score is the best alignment's share of the segment's length (1 for a whole copy); rows have ``least`` or more and at
    least 6 words' worth, or the whole of a shorter segment. window is the word where the aligned window begins. Words
    are compared lower-cased and without ASCII punctuation. Items are cut into equal segments of 128 words at most; a row
    has the best. Items or documents that are null, empty or without words match nothing. Repeated rows give repeated results;
    repeated items count as one. Null ids are kept as they are. Other columns are not read.

    Test items of up to ``SENT_BYTES`` are passed to the tasks; more of them are joined with the documents by their
    seeds (`seedjoin`), with the same results, so the passes over the documents don't grow with the benchmark.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    items = written(benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text")).filter("text is not null").distinct(), "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total > SENT_BYTES:
        out = joined(source, items, least)
    else:
        kinds = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
        schema = StructType([StructField("id", kinds[0]), StructField("item", kinds[1]), StructField("score", DoubleType()), StructField("window", LongType()), StructField("item_words", IntegerType())])
        out = _sent(source, items, least, schema)
    dropped(items)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "window", "item_words")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
