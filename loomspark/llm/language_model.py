"""Katz backoff scoring: Good-Turing discounted pair counts over additively smoothed word counts.

The lowest level is p1(w) = (c + 1/2) / (N + (V + 1)/2) over all words of the training texts and one unseen word. Above
it are pairs of words, all of them. For a history h

    p(w | h) = d(c(h, w)) c(h, w) / n(h)   where the pair was seen,
             = a(h) p1(w)                  where it was not,

with Good-Turing discounts d for counts up to 5 and a(h) such that the sum over all words is 1. n(h) is c(h), or half a
count more than the discounted counts of h together where these leave less than that for words not seen after h (as
they do where all were seen over 5 times), so every history keeps something for new words. The text's end is a word,
and the history of its first word.

The frequent words have numbers, and their counts and a(h) are sent to every task. Pairs are dealt to shards so that a
shard has all it needs: pairs of two frequent words by the pair, others under their rare word (a pair of two rare words
under both). A rare word's count is then the sum of its pairs, as word or as history; only p1 of rare words seen after
rare histories travels between shards. Texts send each shard their pairs, and get back what these are worth.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import dropped, read, written
from .textcodes import mixed, texts_in_chunks, word_codes

#: The code of a text's end; no word has it but by a collision of 64 bits.
END = int(mixed(np.array([0x454E44], dtype=np.uint64))[0])
#: Discounts are for counts up to this one.
DISCOUNTED = 5
#: Bytes of text for each shard of pairs, so that a shard's counts fit a task.
SHARD_BYTES = 32 << 20
#: Tokens whose pairs are counted together before they are sent.
_TOKENS = 1 << 20


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, codes with an end after each text, text of each code) of runs of texts."""
    for i, j, data, bounds in texts_in_chunks(column):
        codes, at = word_codes(data, bounds)
        owner = np.repeat(np.arange(j - i), np.diff(at))
        places = np.arange(len(codes)) + owner
        out, own = np.full(len(codes) + j - i, END, dtype=np.uint64), np.zeros(len(codes) + j - i, dtype=np.int64)
        out[places], own[places] = codes, owner
        own[at[1:] + np.arange(j - i)] = np.arange(j - i)
        yield i, j, out, own


def _packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, like bytes together, compressed."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _packed64(values: np.ndarray) -> bytes:
    """The same for 64-bit values."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked64(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.uint64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.unique(codes, return_counts=True) for _, _, codes, _ in _tokens(batch.column(0))]
        if parts:
            codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n)], names=["code", "n"])


class Classes:
    """The frequent words' codes (ascending), their counts, and the two numbers that p1 needs."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], counts[order]
        self.below = total + 0.5 * (distinct + 1)
        self.share = (self.counts + 0.5) / self.below
        self.log = np.log10(self.share)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code among the frequent; one past the last for the others."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, len(self.codes))

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """A frequent word's place, another word's code."""
        own = self.of(codes)
        return np.where(own < len(self.codes), own.astype(np.uint64), codes)

    def sides(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(which tokens, key, partner) of pairs of frequent words, under rare words and under rare histories.

        ``codes``: whole texts laid end to end. The key of two frequent words is history * 65536 + word.
        """
        word, many = self.ids(codes), np.uint64(len(self.codes))
        history = np.append(self.ids(np.array([END], dtype=np.uint64)), word[:-1])[: len(word)]
        both = np.flatnonzero((word < many) & (history < many))
        after, before = np.flatnonzero(word >= many), np.flatnonzero(history >= many)
        return [(both, history[both] << np.uint64(16) | word[both], None), (after, word[after], history[after]), (before, history[before], word[before])]


def _shard(side: int, key: np.ndarray, shards: int) -> np.ndarray:
    """Where a pair belongs; ascending with the key under rare words, whose codes are mixed already."""
    if side == 0:
        return mixed(key) % np.uint64(shards)
    return (key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def _changes(*columns: np.ndarray | None) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        if c is not None:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _order(key: np.ndarray, partner: np.ndarray | None) -> np.ndarray:
    return np.argsort(key, kind="stable") if partner is None else np.lexsort((partner, key))


def _laid(side: int, key: np.ndarray, partner: np.ndarray | None) -> list[bytes]:
    """Ascending keys and their partners, packed."""
    steps = np.diff(key, prepend=np.uint64(0))
    return [_packed(steps), b""] if side == 0 else [_packed64(steps), _packed64(partner)]


def _raised(side: int, key: bytes, partner: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    if side == 0:
        return np.cumsum(_unpacked(key).astype(np.uint64), dtype=np.uint64), None
    return np.cumsum(_unpacked64(key), dtype=np.uint64), _unpacked64(partner)


def _by_shard(own: Classes, codes: np.ndarray, text: np.ndarray | None, shards: int) -> dict[int, list[bytes]]:
    """For each shard the distinct pairs (of each text) of the three sides, packed: key, partner, number, text."""
    out: dict[int, list[bytes]] = {}
    for side, (at, key, partner) in enumerate(own.sides(codes)):
        dealt = _shard(side, key, shards)
        order = _order(dealt << np.uint64(32) | key if side == 0 else key, partner)
        key, dealt, partner = key[order], dealt[order], None if partner is None else partner[order]
        owner = None if text is None else text[at][order]
        first = _changes(key, partner, owner)
        n = np.diff(np.append(first, len(key)))
        key, dealt, partner = key[first], dealt[first], None if partner is None else partner[first]
        bounds = [*_changes(dealt).tolist(), len(key)]
        for i, j in zip(bounds, bounds[1:], strict=False):
            rows = out.setdefault(int(dealt[i]), [b""] * 12)
            rows[4 * side : 4 * side + 4] = [*_laid(side, key[i:j], None if partner is None else partner[i:j]), _packed(n[i:j]), b"" if owner is None else _packed(owner[first[i:j]])]
    return out


def _flushes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As `_tokens`, in runs of about ``_TOKENS`` tokens."""
    start, end, parts, size = 0, 0, [], 0
    for i, j, codes, text in _tokens(column):
        parts.append((codes, text + (i - start)))
        size, end = size + len(codes), j
        if size >= _TOKENS:
            yield start, end, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            start, parts, size = j, [], 0
    if parts:
        yield start, end, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _pair_counts(classes: bytes, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(classes.value)
        for batch in batches:
            for _, _, codes, _ in _flushes(batch.column(0)):
                rows = _by_shard(own, codes, None, shards)
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.list_(pa.binary()))], names=["shard", "data"])

    return run


def _merged(many: int):
    """One row for each shard, with the pairs of its three sides in order, from rows sorted by shard."""

    def row(shard, parts):
        data, seen = [], np.zeros(DISCOUNTED + 1, np.int64)
        for side in range(3):
            own = [(*_raised(side, p[4 * side], p[4 * side + 1]), _unpacked(p[4 * side + 2]).astype(np.uint32)) for p in parts if p[4 * side]]
            key, n = (np.concatenate([o[i] for o in own] or [np.zeros(0, t)]) for i, t in ((0, np.uint64), (2, np.uint32)))
            partner = np.concatenate([o[1] for o in own] or [np.zeros(0, np.uint64)]) if side else None
            del own
            order = _order(key, partner)
            key, n, partner = key[order], n[order], None if partner is None else partner[order]
            first = _changes(key, partner)
            n = np.add.reduceat(n, first, dtype=np.int64) if len(first) else n.astype(np.int64)
            key, partner = key[first], None if partner is None else partner[first]
            data += [*_laid(side, key, partner), _packed64(n)]
            once = n if side < 2 else n[partner < many]  # a pair of two rare words is under both
            seen += np.bincount(np.minimum(once, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.list_(pa.binary())), pa.array([seen.tolist()], pa.list_(pa.int64()))], names=["shard", "data", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(0)[i].as_py()
                if shard != now and parts:
                    yield row(now, parts)
                    parts = []
                now = shard
                parts.append(batch.column(1)[i].as_py())
        if parts:
            yield row(now, parts)

    return run


def _table(data: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Key, partner and count of a shard's pairs."""
    return *_raised(side, *data[3 * side : 3 * side + 2]), _unpacked64(data[3 * side + 2]).astype(np.int64)


def discounts(seen: list[int]) -> np.ndarray:
    """d(0..5) from the numbers of pairs seen 1..6 times; where Good-Turing gives no proper fraction, (r - 1/2) / r."""
    out = np.ones(DISCOUNTED + 1)
    last = (DISCOUNTED + 1) * seen[DISCOUNTED] / seen[0] if seen[0] else 1.0
    for r in range(1, DISCOUNTED + 1):
        good = ((r + 1) * seen[r] / (r * seen[r - 1]) - last) / (1 - last) if seen[r - 1] and last < 1 else 0.0
        out[r] = good if 0 < good < 1 else (r - 0.5) / r
    return out


def _kept(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(n <= DISCOUNTED, d[np.minimum(n, DISCOUNTED)], 1.0) * n


def _mass(classes: bytes, d: np.ndarray):
    """What a shard knows of histories under other keys: what discounted counts add up to (frequent ones), p1 of words seen after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(classes.value)
        many = len(own.codes)
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py()
                key, _, n = _table(data, 0)
                history = (key >> np.uint64(16)).astype(np.int64)
                share = own.share[(key & np.uint64(0xFFFF)).astype(np.int64)] if many else np.zeros(0)
                sums = [np.bincount(history, weights=x, minlength=many) for x in (_kept(n, d), share)]
                word, partner, n = _table(data, 1)
                share = _word_shares(word, n, own.below)[2]
                often = partner < many
                at = partner[often].astype(np.int64)
                sums = [s + np.bincount(at, weights=x[often], minlength=many) for s, x in zip(sums, (_kept(n, d), share), strict=True)]
                used = np.flatnonzero(sums[1])
                rare, back = np.unique(partner[~often], return_inverse=True)
                below = np.bincount(back, weights=share[~often], minlength=len(rare))
                columns = [np.append(used, rare.view(np.int64)), np.append(sums[0][used], np.zeros(len(rare))), np.append(sums[1][used], below)]
                yield from pa.Table.from_arrays([pa.array(c) for c in columns], names=["history", "kept", "below"]).to_batches(1 << 16)

    return run


def _word_shares(word: np.ndarray, n: np.ndarray, below: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct of ascending words, their counts, and p1 for every row."""
    first = _changes(word)
    counts = np.add.reduceat(n, first) if len(first) else n
    return word[first], counts, np.repeat((counts + 0.5) / below, np.diff(np.append(first, len(word))))


def _gathered(shards: int):
    """Histories' sums packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            history, below = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(history)
            history, below = history[order], below[order]
            dealt = _shard(1, history, shards)
            bounds = [*_changes(dealt).tolist(), len(history)]
            rows = [(int(dealt[i]), [_packed64(history[i:j]), below[i:j].tobytes()]) for i, j in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], names=["shard", "data"])

    return run


class Model:
    """The frequent words with log10 a(h) and log10 c(h), and the discounts."""

    def __init__(self, own: Classes, d: np.ndarray, kept: np.ndarray, below: np.ndarray):
        self.own, self.d = own, d
        self.log_a, self.log_n = _log_a(own.counts, kept, below), np.log10(_size(own.counts, kept))


#: The part of a count that words not seen after a history share at least.
SPARE = 0.5


def _size(n: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """n(h) of histories with these counts and discounted counts."""
    return np.maximum(n, kept + SPARE)


def _log_a(n: np.ndarray, kept: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.log10((1 - kept / _size(n, kept)) / np.maximum(1 - below, 1e-300))


def _picked(values: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """values[at] where chosen, else 0."""
    out = np.zeros(len(at))
    out[chosen] = values[at[chosen].astype(np.int64)]
    return out


class Shard:
    """A shard's pairs, and the rare words it has, ready to be looked up."""

    def __init__(self, model: Model, data: list[bytes], codes: np.ndarray, below: np.ndarray):
        self.model, own, d = model, model.own, model.d
        many = len(own.codes)
        self.both, _, n = _table(data, 0)
        h, w = (self.both >> np.uint64(16)).astype(np.int64), (self.both & np.uint64(0xFFFF)).astype(np.int64)
        self.gain = np.log10(_kept(n, d)) - model.log_a[h] - model.log_n[h] - own.log[w] if many else np.zeros(0)

        word, partner, n = _table(data, 1)
        self.words, counts, _ = _word_shares(word, n, own.below)
        self.log1 = np.log10((counts + 0.5) / own.below)
        self.after = self._pairs(word, partner, np.where(partner < many, np.log10(_kept(n, d)) - _picked(model.log_n, partner, partner < many), 0.0))

        history, partner, n = _table(data, 2)
        first = _changes(history)
        self.histories, sizes = history[first], np.diff(np.append(first, len(history)))
        sums = [np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (n.astype(np.float64), _kept(n, d), _picked(own.share, partner, partner < many))]
        if len(codes):
            sums[2] = sums[2] + np.bincount(np.searchsorted(self.histories, codes), weights=below, minlength=len(self.histories))
        self.log_a = _log_a(*sums)
        self.before = self._pairs(history, partner, np.log10(_kept(n, d)) - np.repeat(np.log10(_size(*sums[:2])), sizes))

    @staticmethod
    def _keys(key: np.ndarray, partner: np.ndarray) -> np.ndarray:
        return mixed(mixed(key) * np.uint64(0xA0761D6478BD642F) + partner)

    def _pairs(self, key: np.ndarray, partner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self._keys(key, partner)
        order = np.argsort(keys)
        return keys[order], value[order]

    @staticmethod
    def _found(known: np.ndarray, values: np.ndarray, asked: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        """The value of each that is known, else ``other``."""
        if not len(known):
            return np.broadcast_to(other, asked.shape)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return np.where(known[at] == asked, values[at], other)

    def scored(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A run of texts' places, and what their pairs add to known words, base and score."""
        model, own = self.model, self.model.own
        many, parts = len(own.codes), []
        for side in range(3):
            if not data[4 * side]:
                continue
            key, partner = _raised(side, *data[4 * side : 4 * side + 2])
            n, text = _unpacked(data[4 * side + 2]), _unpacked(data[4 * side + 3])
            known = base = np.zeros(len(n))
            if side == 0:
                score = self._found(self.both, self.gain, key, 0.0)
            elif side == 1:
                known = self._found(self.words, np.ones(len(self.words)), key, 0.0)
                base = self._found(self.words, self.log1, key, math.log10(0.5 / own.below))
                score = self._found(*self.after, self._keys(key, partner), base + _picked(model.log_a, partner, partner < many))
            else:
                back = self._found(self.histories, self.log_a, key, 0.0) + _picked(own.log, partner, partner < many)
                score = self._found(*self.before, self._keys(key, partner), back)
            parts.append((text, known * n, base * n, score * n))
        text, *sums = (np.concatenate([p[i] for p in parts]) for i in range(4))
        used, local = np.unique(text, return_inverse=True)
        return used, *[np.bincount(local, weights=x) for x in sums]


def _postings(model: bytes, shards: int):
    """By shard, the distinct pairs of a run of texts with their numbers; and once, the run's ids and marks.

    With these go tokens, frequent ones, their p1, and p1 a of frequent words after frequent ones. A run's key is a hash
    of its ids and marks, so a task that runs again makes the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(model.value)
        own, many = known.own, len(known.own.codes)
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, j, codes, text in _flushes(batch.column(2)):
                word = own.ids(codes)
                log1 = _picked(own.log, word, word < many)
                both = own.sides(codes)[0]
                back = np.zeros(len(codes))
                back[both[0]] = log1[both[0]] + known.log_a[(both[1] >> np.uint64(16)).astype(np.int64)] if many else 0.0
                sums = [np.bincount(text, weights=x, minlength=j - i).tobytes() for x in (np.ones(len(codes)), word < many, log1, back)]
                ids, marks = batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()
                chunk = int.from_bytes(hashlib.blake2b(repr((ids, marks)).encode(), digest_size=8).digest(), "little", signed=True)
                rows = [(s, 2, chunk, data, None, None) for s, data in _by_shard(own, codes, text, shards).items()]
                rows.append((chunk % shards, 3, chunk, sums, ids, marks))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(kind), pa.list_(pa.int64())))], names=["shard", "phase", "chunk", "data", "ids", "marks"])

    return run


def _scored(model: bytes):
    """Each run's sums by text over the pairs of a shard, from rows sorted by shard: histories' sums, pairs, runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(model.value)
        now, codes, below, own = None, [], [], None

        def ready(data):
            code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
            return Shard(known, data, code, np.concatenate(below) if below else np.zeros(0))

        empty = [*_laid(0, np.zeros(0, np.uint64), None), _packed64(np.zeros(0))] + 2 * [_packed64(np.zeros(0))] * 3
        for batch in batches:
            kind = batch.schema.field(4).type
            rows = []
            for i in range(batch.num_rows):
                shard, phase, chunk, data, ids, marks = (batch.column(c)[i].as_py() for c in range(6))
                if shard != now:
                    now, codes, below, own = shard, [], [], None
                if phase == 0:
                    codes.append(_unpacked64(data[0]))
                    below.append(np.frombuffer(data[1]))
                elif phase == 1:
                    own = ready(data)
                elif phase == 3:
                    rows.append((chunk, data, ids, marks))
                else:
                    own = own or ready(empty)
                    used, *sums = own.scored(data)
                    rows.append((chunk, [_packed(np.diff(used, prepend=0)), *[x.tobytes() for x in sums]], None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int64(), pa.list_(pa.binary()), kind, pa.list_(pa.int64())))], names=["chunk", "data", "ids", "marks"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's sums over all shards, from rows sorted by run with its lists of ids first.

    Runs that are alike to the last id and mark share a key; each of them gets its part of their common sums.
    """
    now, lists, totals = None, [], []

    def done():
        for ids, marks in lists:
            counts = [pa.array(np.rint(t / len(lists)).astype(np.int64)) for t in totals[:2]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), *counts, *[pa.array(t / len(lists)) for t in totals[2:]]], names=["id", "tokens", "known", "base", "score"])

    for batch in batches:
        kind = batch.schema.field(2).type.value_type
        for i in range(batch.num_rows):
            chunk, data, ids, marks = (batch.column(c)[i].as_py() for c in range(4))
            if chunk != now:
                yield from done()
                now, lists, totals = chunk, [], [0.0] * 4
            if ids is not None:
                lists.append((ids, marks))
                totals = [t + np.frombuffer(x) for t, x in zip(totals, data, strict=True)]
            else:
                at = np.cumsum(_unpacked(data[0]))
                for t, x in zip(totals[1:], data[1:], strict=True):
                    t[at] += np.frombuffer(x)
    yield from done()


def katz(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = 65_535) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``train``: a boolean column over ``docs``, true on the texts to learn from. A-Z are lower-cased; words are runs of
    other than space and tab to carriage return. score: log10 of the model's probability of the text with its end;
    base_score: the same for p1 alone; n_known: tokens that the training texts have. A null text is empty and has one
    token, its end. ``frequent``: words at most (up to 65,536) that are sent to every task, others
    stay in their shards; results don't depend on it.
    Rows that repeat id and text are scored alike. Null ids are kept; a null ``train`` is true. Without training texts
    everything is unseen. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"), F.col(f"`{text_col}`").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    learnt = source.filter("train").select("text")
    words = written(learnt.mapInArrow(_word_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("c")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # counts by their first 12 binary digits: at most 131,072 rows, whatever the corpus
    low = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("c")) - 11, F.lit(0))).cast("long")
    steps = sorted(((r["least"], r["k"]) for r in words.groupBy((F.col("c") - F.col("c") % low).alias("least")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, room = math.inf, min(frequent, 1 << 16)
    for c, k in steps:
        if k > room:
            break
        least, room = c, room - k
    top = words.filter(F.col("c") >= least).collect() if least < math.inf else []  # ``frequent`` rows
    dropped(words)
    own = Classes(np.array([r["code"] for r in top], dtype=np.int64).view(np.uint64), np.array([r["c"] for r in top], dtype=np.float64), total, distinct)
    classes = spark.sparkContext.broadcast(cloudpickle.dumps(own))

    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(4, -(-size // SHARD_BYTES))
    by_shard = lambda df, *then: df.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", *then)
    counted = learnt.mapInArrow(_pair_counts(classes, shards), "shard int, data array<binary>")
    pairs = written(by_shard(counted).mapInArrow(_merged(len(own.codes)), "shard int, data array<binary>, seen array<long>"), "pairs")
    seen = pairs.agg(*[F.coalesce(F.sum(F.get("seen", F.lit(i))), F.lit(0)) for i in range(DISCOUNTED + 1)]).first()
    d = discounts(list(seen))
    mass = pairs.select("data").mapInArrow(_mass(classes, d), "history long, kept double, below double")
    mass = written(mass.groupBy("history").agg(F.sum("kept").alias("kept"), F.sum("below").alias("below")), "mass")
    often = F.col("history").between(0, len(own.codes) - 1)
    kept, below = np.zeros(len(own.codes)), np.zeros(len(own.codes))
    for r in mass.filter(often).collect():  # ``frequent`` rows
        kept[r["history"]], below[r["history"]] = r["kept"], r["below"]
    model = spark.sparkContext.broadcast(cloudpickle.dumps(Model(own, d, kept, below)))

    kind = docs.schema[id_col].dataType.simpleString()
    laid = source.select("id", "mark", "text").mapInArrow(_postings(model, shards), f"shard int, phase int, chunk long, data array<binary>, ids array<{kind}>, marks array<long>")
    rest = mass.filter(~often).select("history", "below").mapInArrow(_gathered(shards), "shard int, data array<binary>")
    at = lambda df, phase: df.select("shard", F.lit(phase).alias("phase"), F.lit(0).cast("long").alias("chunk"), "data", F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("array<long>").alias("marks"))
    met = by_shard(laid.unionByName(at(rest, 0)).unionByName(at(pairs, 1)), "phase").mapInArrow(_scored(model), f"chunk long, data array<binary>, ids array<{kind}>, marks array<long>")
    found = met.repartition("chunk").sortWithinPartitions("chunk", F.col("ids").isNull()).mapInArrow(_summed, f"id {kind}, tokens long, known long, base double, score double")
    return found.select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those whose crc32(doc_id) mod 5 is not 1."""
    held_out = lambda: F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    scored = katz(read(spark, sf_dir, "documents"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
