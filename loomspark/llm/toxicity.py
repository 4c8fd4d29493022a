"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of a text is a term, with weight (1 + ln tf) * idf; terms that go with the label in the examples (by their
log-likelihood ratio) weigh more, by as much as they are purer than chance. A text's neighbours are the examples with the
largest cosine, found exactly: the index keeps, for blocks of 64 examples, each term's largest weight, so a text's upper
bound for every block comes first, then the scores of the most promising blocks, then those of just the blocks whose bound
reaches the worst neighbour so far. Neighbours vote with the square of their cosine; votes are mapped to frequencies
that leave-one-out votes of the examples had (isotonic).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import dropped, read, written
from .textcodes import each_text

BLOCK = 64
#: Blocks that are scored before bounds decide about the others.
FIRST = 4


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    n = stop - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Index:
    """Block-max inverted index over examples' vectors, given as (example, term, weight) triples."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, n_terms: int):
        order = np.lexsort((example, term))
        self._laid(example[order].astype(np.int32), weight[order].astype(np.float32), np.bincount(term, minlength=n_terms).astype(np.int32), size)

    def __reduce__(self):
        """What is sent is the postings alone; a task makes their blocks again."""
        return _index, (self.example, self.weight, np.diff(self.start[self.of_term]).astype(np.int32), self.size)

    def _laid(self, example: np.ndarray, weight: np.ndarray, each: np.ndarray, size: int) -> None:
        """Sets the postings, ordered by term and example (``each``: how many a term has), and their blocks."""
        self.example, self.weight, self.size, self.blocks = example, weight, size, -(-size // BLOCK)
        term, n_terms, block = np.repeat(np.arange(len(each)), each), len(each), example // BLOCK
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        #: Of each (term, block): the block, the largest weight, and where its postings begin.
        self.block, self.start = block[first], np.append(first, len(term))
        self.top = np.maximum.reduceat(weight, first) if len(first) else weight
        self.of_term = np.searchsorted(term[first], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and inner products of the k nearest examples with a positive one; ties to the smaller number."""
        low, high = self.of_term[terms], self.of_term[terms + 1]
        cells, own = _ranges(low, high), np.repeat(weights, high - low)
        block = self.block[cells]
        bound = np.bincount(block, weights=own * self.top[cells], minlength=self.blocks)
        scores = np.zeros(self.size)

        def add(chosen: np.ndarray) -> None:
            nonlocal scores
            use = chosen[block]
            a, b = self.start[cells[use]], self.start[cells[use] + 1]
            at = _ranges(a, b)
            scores += np.bincount(self.example[at], weights=np.repeat(own[use], b - a) * self.weight[at], minlength=self.size)
            if skip >= 0:
                scores[skip] = 0

        if not len(cells):
            return np.zeros(0, np.int64), scores[:0]
        chosen = bound >= (np.partition(bound, -FIRST)[-FIRST] if self.blocks > FIRST else 0)
        chosen &= bound > 0
        add(chosen)
        # a margin for rounding, so that a bound never falls below a sum of the same terms
        worst = np.partition(scores, -k)[-k] - 1e-9 if self.size >= k else 0.0
        rest = ~chosen & (bound > 0) & (bound >= worst)
        if rest.any():
            add(rest)
        found = np.flatnonzero(scores > 0)
        if len(found) > k:
            found = found[scores[found] >= np.partition(scores[found], -k)[-k] - 1e-9]
        best = found[np.lexsort((found, -np.round(scores[found], 12)))[:k]]
        return best, scores[best]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y on x (pool adjacent violators), each mean drawn a little to 1/2."""
    x = np.round(x, 9)
    order = np.lexsort((-y, x))  # equal x share a mean, in whatever order they come
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            p = pools.pop()
            pools[-1] = [pools[-1][0] + p[0], pools[-1][1] + p[1], pools[-1][2] + p[2]]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def _index(*laid) -> Index:
    found = Index.__new__(Index)
    found._laid(*laid)
    return found


class Model:
    """Terms, examples and calibration: what a task needs to score texts. Its size is bounded by the sample's."""

    def __init__(self, ids: list, labels: np.ndarray, codes: list[np.ndarray], counts: list[np.ndarray], k: int, boost: float, evidence: float):
        self.k, n = k, len(ids)
        self.labels = labels.astype(np.float64)
        self.ids = ids if 0 < self.labels.sum() < n else []  # labels of one kind tell nothing apart
        own = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in codes])
        self.vocabulary, term = np.unique(np.concatenate([np.zeros(0, np.uint64), *codes]), return_inverse=True)
        term = term.astype(np.int32)
        tf = np.concatenate([np.zeros(0, np.int32), *counts])
        df, hits = np.bincount(term, minlength=len(self.vocabulary)), np.bincount(term, weights=self.labels[own], minlength=len(self.vocabulary))
        self.base = float((self.labels.sum() + 0.5) / (n + 10))
        rate = self.labels.mean() if n else 0.0
        xlogx = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0)
        gain = 2 * (xlogx(hits, df * rate) + xlogx(df - hits, df * (1 - rate)))
        share = hits / np.maximum(df, 1)
        apart = np.where((gain >= evidence) & (share > rate), (share - rate) / max(1e-9, 1 - rate), 0.0)
        self.weight = ((np.log((n + 1) / (df + 1)) + 1) * (1 + boost * apart)).astype(np.float32)
        self.unseen = math.log(n + 1) + 1
        raw = (1 + np.log(tf)) * self.weight[term].astype(np.float64)
        del tf
        norm = np.sqrt(np.bincount(own, weights=raw * raw, minlength=n))
        self.index = Index(own, term, raw / np.maximum(norm[own], 1e-300), n, len(self.vocabulary))

    def unit(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights in the unit vector of a text's words; words that no example has count in its length."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == codes
        raw = (1 + np.log(counts)) * np.where(known, self.weight[at], self.unseen)
        return at[known], raw[known] / math.sqrt(raw @ raw)

    def vote(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        weight = cosines * cosines
        return float((weight @ self.labels[examples] + 0.1 * self.base) / (weight.sum() + 0.1))

    def score(self, words: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        """Probability of the label for a text's words, and the neighbours that it rests on."""
        if len(words) and self.ids:
            near, cosines = self.index.nearest(*self.unit(*np.unique(words, return_counts=True)), self.k)
            if len(near):
                return float(np.interp(self.vote(near, cosines), *knots)), near, cosines
        return self.base, np.zeros(0, np.int64), np.zeros(0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words (codes) and how often it has them."""
    for batch in batches:
        found = [np.unique(w, return_counts=True) for w in each_text(batch.column(0), loose=True)]
        codes = pa.array([c.view(np.int64) for c, _ in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], codes, pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))], names=["id", "label", "codes", "counts"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, examples: int, most_bytes: int, k: int, boost: float, evidence: float) -> Model:
    """The model from at most ``examples`` labelled rows (those with the least hashes of their ids) of ``most_bytes`` text in all.

    Texts over a quarter of ``most_bytes`` are not learned from, so one text can't take the room of all others.
    """
    spark = docs.sparkSession
    named = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    drawn = named.orderBy(F.xxhash64("id"), "id").limit(examples)  # the documented bound
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    alike = texts.filter("text <> ''").filter(F.octet_length("text") <= most_bytes // 4).join(F.broadcast(drawn), "id").groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label"))
    rows = written(alike, "examples")
    upto = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = rows.select("id", F.octet_length("text").alias("n"))  # ``examples`` rows of two numbers
    kept = sizes.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") <= most_bytes).select("id")
    kind = docs.schema[id_col].dataType.simpleString()
    used = rows.join(F.broadcast(kept), "id").select("text", "id", "label")
    got = used.mapInArrow(_vectors, f"id {kind}, label int, codes array<long>, counts array<int>").orderBy("label", "id").toArrow()  # bounded by both
    dropped(rows)
    codes = [np.asarray(c.values).view(np.uint64) for c in got.column(2)]
    counts = [np.asarray(c.values) for c in got.column(3)]
    common = _common_first(codes)
    ids, toxic = got.column(0).to_pylist(), np.array(got.column(1).to_pylist(), dtype=np.int64) > 0
    return Model([ids[i] for i in common], toxic[common], [codes[i] for i in common], [counts[i] for i in common], k, boost, evidence)


def _common_first(codes: list[np.ndarray]) -> np.ndarray:
    """An order in which examples that share the most frequent words (a language, mostly) are together, and so share blocks."""
    if not codes:
        return np.zeros(0, np.int64)
    words, n = np.unique(np.concatenate(codes), return_counts=True)
    often = words[np.argsort(-n, kind="stable")[:24]]
    return np.lexsort(np.array([np.isin(often, c) for c in codes]).T[::-1])


def _calibrated(spark: SparkSession, model: Model, sent) -> tuple[np.ndarray, np.ndarray]:
    """The knots from the votes that each example gets from the others; examples are dealt over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)
        order = np.argsort(m.index.example, kind="stable")
        first = np.searchsorted(m.index.example[order], np.arange(m.index.size + 1))
        terms = np.repeat(np.arange(len(m.vocabulary)), np.diff(m.index.start[m.index.of_term]))
        for batch in batches:
            votes = []
            for e in batch.column(0).to_pylist():
                own = order[first[e] : first[e + 1]]
                votes.append(m.vote(*m.index.nearest(terms[own], m.index.weight[own], m.k, e)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], names=["id", "vote"])

    tasks = max(1, -(-model.index.size // 256))
    got = spark.range(0, model.index.size, 1, tasks).mapInArrow(run, "id long, vote double").toArrow()  # a number for each example
    return isotonic(got.column(1).to_numpy(), model.labels[got.column(0).to_numpy()])


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    examples: int = 4096,
    most_bytes: int = 32 << 20,
    k: int = 16,
    boost: float = 20.0,
    evidence: float = 15.0,
    learn_from: DataFrame | None = None,
) -> DataFrame:
    """(id_col, score, evidence) for every row of ``docs``; score is the probability of label 1.

    ``labels`` holds id_col and label_col; of its rows with a label, at most ``examples`` are learned from, with at most
    ``most_bytes`` of text from ``learn_from`` (else ``docs``; no text over a quarter of that); examples with equal texts are one, with the largest label.
    Words are runs of other than white space and ASCII punctuation, A-Z lower-cased; all are terms. A term whose
    log-likelihood ratio with the label is ``evidence`` or more weighs up to 1 + ``boost`` times its idf. evidence lists
    up to ``k`` neighbours: id, cosine, label. A text that is null, empty or shares no word with any example gets the rate
    of label 1 among the examples and no evidence, as does every text where the examples have labels of one kind only.
    Without labels every score is 0.05. An id with several labels counts
    by the largest. Other columns are not read.
    """
    fitted = fit(docs if learn_from is None else learn_from, labels, id_col, text_col, label_col, examples, most_bytes, k, boost, evidence)
    model = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(fitted))  # bounded by ``examples`` and ``most_bytes``
    knots = _calibrated(docs.sparkSession, fitted, model) if fitted.ids else (np.zeros(0), np.zeros(0))
    kind = docs.schema[id_col].dataType.simpleString()
    near = "array<struct<id:" + kind + ",cosine:double,label:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model.value)
        for batch in batches:
            found = [m.score(words, knots) for words in each_text(batch.column(1), loose=True)]
            at = np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])
            ids = pa.array(m.ids, batch.schema.field(0).type).take(pa.array(at))
            lists = pa.StructArray.from_arrays([ids, pa.array(np.concatenate([np.zeros(0), *[f[2] for f in found]])), pa.array(m.labels[at].astype(np.int32))], names=["id", "cosine", "label"])
            ends = np.cumsum([0] + [len(f[1]) for f in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.ListArray.from_arrays(pa.array(ends), lists)], names=["id", "score", "evidence"])

    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, score double, evidence {near}")
    return found.select(F.col("id").alias(id_col), "score", "evidence")


#: From this score on, a text counts as toxic.
REJECTED_FROM = 0.3


def _remainder(column):
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(4))


def learnable(labels: DataFrame) -> DataFrame:
    """The labels of ids that are not held out."""
    return labels.filter(_remainder(F.col("doc_id")) != 2).select("doc_id", "toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from the labels of three quarters of the ids."""
    docs = read(spark, sf_dir, "documents")
    scored = toxicity(docs, learnable(read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(_remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= REJECTED_FROM).cast("int").alias("predicted"),
        F.transform("evidence", lambda e: e["id"]).alias("neighbours"),
    )
