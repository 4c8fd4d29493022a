"""Content and boilerplate by line: a linear-chain conditional random field, decoded by Viterbi.

Each line with a word is described by 16 measures (shares of kinds of characters and words, repetitions, length), each
in one of a few bins. The field has a weight for every bin, for the label of the first line, and for each pair of labels
of lines that follow each other; the most likely labels of all lines of a text are found together. A text is kept if its
content lines hold enough of its words.

Labels are given for documents, not for lines: in good documents all lines are taken as content, in bad ones all as
boilerplate at first; then the field labels the lines of the bad ones itself, where its least content-like line stays
boilerplate, and is fitted again. The first fit is of single lines, as labels that never change within a document would
teach the chain never to change.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import dropped, read, written
from .textcodes import shingle_codes, span_codes, texts_in_chunks, word_spans

#: Words of the windows whose repetition counts.
RUN = 5


def _kinds(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in characters]] = True
    return out


_UPPER, _SMALL, _DIGIT = _kinds("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kinds("abcdefghijklmnopqrstuvwxyz"), _kinds("0123456789")
_STOP, _COMMA, _CALL = _kinds(".!?"), _kinds(",;:"), _kinds("!")
_SIGN = _kinds("#*$%&|<>")
_MARK = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) not in ".!?,;:'\"()-" for i in range(256)])
_FOREIGN = np.arange(256) >= 0xC0
_TAIL = (np.arange(256) & 0xC0) == 0x80
_BLANK = _kinds(" \t\n\x0b\x0c\r")
_LETTER = _UPPER | _SMALL | _FOREIGN | _TAIL

_SHARES = np.array([1e-9, 0.01, 0.03, 0.08, 0.16, 0.3, 0.5, 0.75])
_LENGTHS = np.array([2.0, 3, 4, 5, 6, 8, 12])
_COUNTS = np.array([2.0, 4, 8, 16, 32, 64, 256])
#: Measures with their bins' edges, in the order of `measures`.
MEASURES = (*[("share", _SHARES)] * 10, ("length", _LENGTHS), ("words", _COUNTS), *[("yes", np.array([0.5]))] * 4)
OFFSETS = np.cumsum([0] + [len(edges) + 1 for _, edges in MEASURES])


class Lines:
    """The lines of a chunk of texts, and what is counted in them and in the texts."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        bounds = bounds - bounds[0]
        n, breaks = len(bounds) - 1, np.flatnonzero(data == 10)
        owner = np.append(np.arange(n), np.searchsorted(bounds, breaks, side="right") - 1)
        start = np.append(bounds[:-1], breaks + 1)
        order = np.lexsort((owner, start))
        #: Of each line: its text, and where it begins and ends (without the line break).
        self.owner, self.start = owner[order], start[order]
        following = np.append(self.start[1:] - 1, bounds[-1])
        last = np.append(self.owner[1:] != self.owner[:-1], True)
        self.end = np.where(last, bounds[self.owner + 1], following)
        self.data = data
        word_start, word_end = word_spans(data, bounds) if len(data) else (np.zeros(0, np.int64),) * 2
        self.words = span_codes(data, word_start, word_end) if len(data) else np.zeros(0, np.uint64)
        #: Which words each line and each text has.
        self.low, self.high = np.searchsorted(word_start, self.start), np.searchsorted(word_start, self.end)
        self.of_text = np.searchsorted(word_start, bounds)
        self.n_words = self.high - self.low
        letters = np.append(0, np.cumsum(_LETTER[data]))
        self.bare = letters[word_end] == letters[word_start]
        self.repeated = np.zeros(len(self.words), dtype=bool)
        for i, j in zip(self.of_text[:-1].tolist(), self.of_text[1:].tolist(), strict=True):
            if j - i > RUN:
                _, back, count = np.unique(shingle_codes(self.words[i:j], RUN), return_inverse=True, return_counts=True)
                twice = np.flatnonzero(count[back] > 1)
                if len(twice):
                    edge = np.bincount(twice, minlength=j - i + 1) - np.bincount(twice + RUN, minlength=j - i + 1)[: j - i + 1]
                    self.repeated[i:j] = np.cumsum(edge)[:-1] > 0
        self.again = self._again()
        first = np.searchsorted(self.owner, np.arange(n + 1))
        self.of_lines = first

    def _again(self) -> np.ndarray:
        """Lines with a word that are equal to an earlier one of their text."""
        full = np.flatnonzero(self.n_words > 0)
        out = np.zeros(len(self.start), dtype=bool)
        if len(full):
            code = span_codes(self.data, self.start[full], self.end[full])
            order = np.lexsort((full, code, self.owner[full]))
            same = (code[order][1:] == code[order][:-1]) & (self.owner[full][order][1:] == self.owner[full][order][:-1])
            out[full[order[1:][same]]] = True
        return out

    def sums(self, kind: np.ndarray) -> np.ndarray:
        """How many bytes of a kind each line has."""
        total = np.append(0, np.cumsum(kind[self.data]))
        return total[self.end] - total[self.start]

    def in_words(self, flags: np.ndarray) -> np.ndarray:
        """How many of its words each line has flagged."""
        total = np.append(0, np.cumsum(flags))
        return total[self.high] - total[self.low]

    def by_text(self, of_lines: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(of_lines))
        return total[self.of_lines[1:]] - total[self.of_lines[:-1]]

    def measured(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the lines that have a word, the bin of each of their measures, and characters of all lines' words."""
        upper, small, marks = self.sums(_UPPER), self.sums(_SMALL), self.sums(_MARK)
        chars = self.sums(~(_TAIL | _BLANK))
        full = np.flatnonzero(self.n_words > 0)
        n, c = self.n_words[full].astype(float), chars[full].astype(float)
        share = lambda x, of: np.minimum(x[full] / np.maximum(of, 1), 1.0)
        twin = np.append(False, self.words[1:] == self.words[:-1])
        head = np.minimum(self.low[full], max(0, len(self.words) - 1))
        twin_first = twin[head].astype(int) if len(self.words) else np.zeros(0, int)
        twins = self.in_words(twin)
        twins[full] -= twin_first  # a line's first word follows none of its own
        begin = np.searchsorted(np.flatnonzero(~_BLANK[self.data]), self.start[full])
        black = np.flatnonzero(~_BLANK[self.data])
        finish = np.searchsorted(black, self.end[full]) - 1
        values = (
            share(upper, (upper + small)[full]),
            share(self.sums(_DIGIT), c),
            share(marks, c),
            share(self.sums(_FOREIGN), c),
            share(self.sums(_STOP), n),
            share(self.sums(_COMMA), n),
            share(self.sums(_CALL), n),
            share(self.in_words(self.bare), n),
            share(self.in_words(self.repeated), n),
            share(twins, n),
            c / np.maximum(n, 1),
            n,
            _UPPER[self.data[black[begin]]] if len(full) else n,
            _STOP[self.data[black[finish]]] if len(full) else n,
            self.again[full],
            np.append(False, self.owner[1:] == self.owner[:-1])[full],
        )
        bins = np.zeros((len(full), len(MEASURES)), dtype=np.uint8)
        for k, (value, (_, edges)) in enumerate(zip(values, MEASURES, strict=True)):
            bins[:, k] = np.digitize(value, edges)
        return full, bins, chars


class Field:
    """A chain over lines with labels 0 (content) and 1 (boilerplate)."""

    def __init__(self):
        self.weight, self.first, self.pair = np.zeros(OFFSETS[-1]), np.zeros(2), np.zeros((2, 2))

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """By how much each line looks more like boilerplate than like content."""
        return self.weight[bins + OFFSETS[:-1]].sum(1)

    def decoded(self, scores: np.ndarray) -> np.ndarray:
        """The most likely labels of one text's lines; equally likely ones are content."""
        a, b = float(self.first[0]), float(self.first[1]) + float(scores[0])
        (stay, fall), (rise, keep) = self.pair.tolist()
        back = []
        for s in scores[1:].tolist():
            x, y, p, q = a + stay, b + rise, a + fall, b + keep
            back.append((y > x, q > p))
            a, b = max(x, y), max(p, q) + s
        out = np.zeros(len(scores), dtype=bool)
        now = b > a
        for t in range(len(scores) - 1, 0, -1):
            out[t] = now
            now = back[t - 1][now]
        out[0] = now
        return out

    def likelihood(self, bins: np.ndarray, labels: np.ndarray, at: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
        """Mean log-likelihood of the lines' labels less the penalty, and its gradient; ``at``: where texts begin, and the end.

        Texts are taken together, line by line; the longest decides how many steps there are.
        """
        lengths = np.diff(at)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = at[:-1][order], lengths[order]
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))]
        s, m, n = self.scores(bins), np.exp(self.pair), len(bins)
        forward = np.zeros((n, 2))
        ratio = np.zeros(n)
        for t, k in enumerate(active):
            here = begin[:k] + t
            local = np.exp(np.stack([np.zeros(k), np.clip(s[here], -500, 500)], 1))
            value = (np.exp(self.first) if t == 0 else forward[here - 1] @ m) * local
            ratio[here] = value.sum(1)
            forward[here] = value / ratio[here][:, None]
        backward = np.ones((n, 2))
        pairs = np.zeros((2, 2))
        for t in range(len(active) - 1, 0, -1):
            here = begin[: active[t]] + t
            local = np.exp(np.stack([np.zeros(len(here)), np.clip(s[here], -500, 500)], 1))
            ahead = local * backward[here] / ratio[here][:, None]
            backward[here - 1] = ahead @ m.T
            pairs += np.einsum("ki,ij,kj->ij", forward[here - 1], m, ahead)
        belief = forward * backward
        belief = belief[:, 1] / belief.sum(1)
        inside = np.ones(n, dtype=bool)
        inside[at[:-1]] = False
        after = np.flatnonzero(inside)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[after - 1], labels[after]), 1)
        heads = labels[at[:-1]]
        value = (s * labels).sum() + (self.pair * seen).sum() + self.first[heads].sum() - np.log(ratio).sum()
        gain = np.bincount((bins + OFFSETS[:-1]).ravel(), weights=np.repeat(labels - belief, bins.shape[1]), minlength=OFFSETS[-1])
        start = belief[at[:-1]].sum()
        first = np.array([(heads == 0).sum() - (len(heads) - start), heads.sum() - start])
        here = np.concatenate([self.weight, self.first, self.pair.ravel()])
        return (value - penalty / 2 * (here**2).sum()) / n, (np.concatenate([gain, first, (seen - pairs).ravel()]) - penalty * here) / n

    def fit(self, bins: np.ndarray, labels: np.ndarray, at: np.ndarray, steps: int, penalty: float, chain: bool = True) -> None:
        """Climbs the likelihood with steps of each parameter's own size (resilient propagation); without ``chain`` of single lines."""
        size, before = np.full(OFFSETS[-1] + 6, 0.1), np.zeros(OFFSETS[-1] + 6)
        for _ in range(steps):
            _, slope = self.likelihood(bins, labels, at, penalty)
            if not chain:
                slope[OFFSETS[-1] :] = 0.0
            turned = slope * before
            size = np.clip(np.where(turned > 0, size * 1.2, np.where(turned < 0, size * 0.5, size)), 1e-6, 1.0)
            slope = np.where(turned < 0, 0.0, slope)
            move, before = np.sign(slope) * size, slope
            self.weight += move[: OFFSETS[-1]]
            self.first += move[OFFSETS[-1] : OFFSETS[-1] + 2]
            self.pair += move[OFFSETS[-1] + 2 :].reshape(2, 2)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bins of each text's lines."""
    for batch in batches:
        out = []
        for _, _, data, bounds in texts_in_chunks(batch.column(0)):
            lines = Lines(data, bounds)
            full, bins, _ = lines.measured()
            cut = np.searchsorted(full, lines.of_lines)
            out += [bins[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], names=["id", "good", "bins"])


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, examples: int, most_bytes: int, rounds: int = 4, steps: int = 60, penalty: float = 0.1) -> Field | None:
    """The field from at most ``examples`` labelled texts (least hashes of ids) of ``most_bytes`` in all.

    Texts over a sixteenth of ``most_bytes`` are not learned from. None where only one label is left.
    """
    named = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    drawn = named.orderBy(F.xxhash64("id"), "id").limit(examples)  # the documented bound
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.octet_length("text") <= most_bytes // 16)
    rows = written(texts.join(F.broadcast(drawn), "id").groupBy("text").agg(F.min("id").alias("id"), F.min("good").alias("good")), "line-examples")
    upto = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.select("id", F.octet_length("text").alias("n")).withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") <= most_bytes).select("id")  # ``examples`` rows of two numbers
    kind = docs.schema[id_col].dataType.simpleString()
    used = rows.join(F.broadcast(kept), "id").select("text", "id", "good").mapInArrow(_collected, f"id {kind}, good int, bins binary")
    got = used.orderBy("good", "id").toArrow()  # bounded by both
    dropped(rows)
    parts = [np.frombuffer(b, np.uint8).reshape(-1, len(MEASURES)) for b in got.column(2).to_pylist()]
    good = [g for g, p in zip(got.column(1).to_pylist(), parts, strict=True) if len(p)]
    parts = [p for p in parts if len(p)]
    if len({g > 0 for g in good}) < 2:
        return None
    at = np.cumsum([0] + [len(p) for p in parts])
    bins, field = np.concatenate(parts), Field()
    bad = np.repeat(np.array(good) <= 0, np.diff(at))
    labels_ = bad.astype(np.int64)
    for turn in range(rounds):
        field.fit(bins, labels_, at, steps, penalty, chain=turn > 0)
        if turn + 1 < rounds:
            scores = field.scores(bins)
            for i in np.flatnonzero(np.array(good) <= 0):
                own = field.decoded(scores[at[i] : at[i + 1]])
                own[np.argmax(scores[at[i] : at[i + 1]])] = True
                labels_[at[i] : at[i + 1]] = own
    return field


_SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_words long, boilerplate array<int>"


def line_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", examples: int = 2048, most_bytes: int = 16 << 20) -> DataFrame:
    """A row for every row of ``docs``: id_col, counts, content_words, and the numbers (from 0) of boilerplate lines.

    Lines end at ``\\n``; words are runs of other than white space, by case. n_words, word_chars (code points in words),
    n_symbols (``#*$%&|<>``), n_dup_lines (lines with a word, equal to an earlier line), n_repeat_words (words inside
    runs of five that come twice or more in the text). content_words are the words of lines that the field takes as
    content; lines without words are neither. A null or empty text has zeros and no lines. ``labels``: id_col and
    label_col (1 good, 0 bad; an id with both is bad); where it has not both, every line is content. Rows that repeat are
    judged each; texts are read whole. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(learned(docs, labels, id_col, text_col, label_col, examples, most_bytes)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = pickle.loads(model.value)
        for batch in batches:
            numbers: list[np.ndarray] = []
            marked: list[list[int]] = []
            for i, j, data, bounds in texts_in_chunks(batch.column(1)):
                lines = Lines(data, bounds)
                full, bins, chars = lines.measured()
                content = np.zeros(len(lines.start), dtype=np.int64)
                content[full] = lines.n_words[full]
                cut = np.searchsorted(full, lines.of_lines)
                scores = field.scores(bins) if field else None
                for k in range(j - i):
                    own: list[int] = []
                    if field and cut[k + 1] > cut[k]:
                        chaff = full[cut[k] : cut[k + 1]][field.decoded(scores[cut[k] : cut[k + 1]])]
                        content[chaff] = 0
                        own = (chaff - lines.of_lines[k]).tolist()
                    marked.append(own)
                per = [lines.n_words, chars, lines.sums(_SIGN), lines.again, lines.in_words(lines.repeated), content]
                numbers.append(np.stack([lines.by_text(x) for x in per]))
            laid = np.concatenate(numbers, 1) if numbers else np.zeros((6, 0), np.int64)
            columns = [batch.column(0), *[pa.array(x.astype(np.int64)) for x in laid], pa.array(marked, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *[x.split()[0] for x in _SCORED.split(", ")]])

    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, {_SCORED}")
    return found.withColumnRenamed("id", id_col)


#: A text is kept if at least this share of its words is content.
CONTENT_SHARE = 0.5


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by given counts and by the share of content, learned from the labels of quality."""
    judged = line_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (F.col("content_words") >= CONTENT_SHARE * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "content_words")
