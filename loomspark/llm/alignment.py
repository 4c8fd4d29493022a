"""Segments of test items, the words that a copy must share with them, and Smith-Waterman alignment of word codes."""

from __future__ import annotations

import numpy as np

from .textcodes import mixed, word_codes

#: Words of a segment at most, so that an alignment is bounded.
SEGMENT = 128
MISMATCH, GAP = 0.5, 0.5


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int]:
    """The best local alignment's score (match 1, mismatch and gap minus 1/2) and the position in ``words`` where it ends."""
    steps = np.arange(1, len(words) + 1) * GAP
    row, best, at = np.zeros(len(words) + 1), 0.0, 0
    for code in item:
        new = np.maximum(row[:-1] + np.where(words == code, 1.0, -MISMATCH), row[1:] - GAP)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + steps) - steps  # gaps along the row
        row = np.concatenate([[0.0], new])
        k = int(new.argmax())
        if new[k] > best:
            best, at = float(new[k]), k
    return best, at


def pair_codes(words: np.ndarray, gap: int) -> np.ndarray:
    """Codes of each word with the one ``gap`` places on, the same for every gap; of the words alone for gap 0."""
    if not gap:
        return words
    n = max(0, len(words) - gap)
    return mixed(words[:n] * np.uint64(0xA0761D6478BD642F) + words[gap:]) if n else words[:0]


def segment_codes(text: str | None) -> list[np.ndarray]:
    """Word codes of an item's segments, of nearly equal length; none of a text without words."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    codes, _ = word_codes(data, np.array([0, len(data)]), loose=True)
    return np.array_split(codes, -(-len(codes) // SEGMENT)) if len(codes) else []


def segment_seeds(words: np.ndarray) -> list[np.ndarray]:
    """Seed codes of a segment by gap, each in order of its places; of a single word the word."""
    return [pair_codes(words, g) for g in ((1, 2) if len(words) > 1 else (0,))]


def limits(size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments by size: the least score, the words by which its gaps may shift it then, the kept places that must be met."""
    score = np.minimum(size, np.maximum(least * size, 6))
    return score, np.floor(2 * (size - score)).astype(np.int64), np.maximum(1, (np.ceil(score).astype(np.int64) + 1) // 3)


def places_kept(size: np.ndarray, least: float) -> np.ndarray:
    """How many places of a segment surely hold as many shared ones as must be met."""
    score, _, met = limits(size, least)
    shared = np.maximum(1, np.ceil(score).astype(np.int64) - 1)
    return np.maximum(1, size - 1) - shared + met
