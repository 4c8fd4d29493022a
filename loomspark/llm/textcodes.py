"""Hashes of words and shingles of whole texts, a chunk of texts at a time in numpy.

A word's code is a polynomial hash of its lower-cased bytes (only A-Z change), taken from running sums over the
chunk's bytes, so no Python object is made for a word. Codes have 64 mixed bits; equal words have equal codes on
every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_BACK = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For comparison by wording alone: every ASCII byte but letters and digits separates words.
_PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


class _Made(dict):
    """Tables that a process makes when it first needs them; what is sent to another process is empty."""

    def __reduce__(self):
        return _Made, ()


_powers: dict[int, np.ndarray] = _Made()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (constants of the public splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, at least."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base]


def word_codes(data: np.ndarray, bounds: np.ndarray, loose: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of texts laid end to end, and for each text where its words begin (one more at the end).

    ``data``: their UTF-8 bytes; ``bounds``: where each text begins, and the end. ``loose``: punctuation
    separates words too.
    """
    bounds = bounds - bounds[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = _LOWER[data]
    starts, ends = word_spans(low, bounds, loose)
    return span_codes(low, starts, ends), np.searchsorted(starts, bounds)


def word_spans(data: np.ndarray, bounds: np.ndarray, loose: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts laid end to end begin and end; no word crosses from one text to the next."""
    black = ~(_PUNCTUATION if loose else _SPACE)[data]
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = black[inner]
    last[inner - 1] = black[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of spans of bytes; equal bytes have equal codes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data))[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * _power(_BACK, len(data) + 1)[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_codes(words: np.ndarray, n: int) -> np.ndarray:
    """Codes of the runs of n words of one text, in order; of the whole text if it has fewer words."""
    if not len(words):
        return words
    m = min(n, len(words))
    total = np.full(len(words) - m + 1, m, dtype=np.uint64)
    for k in range(m):
        total = mixed(total * np.uint64(0xA0761D6478BD642F) + words[k : len(words) - m + 1 + k])
    return total


def texts_in_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, bounds) of runs of texts of about ``CHUNK`` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK, side="right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1]
        i = j


def each_text(column: pa.Array, loose: bool = False) -> Iterator[np.ndarray]:
    """The word codes of every text in turn."""
    for i, j, data, bounds in texts_in_chunks(column):
        codes, at = word_codes(data, bounds, loose)
        for k in range(j - i):
            yield codes[at[k] : at[k + 1]]
