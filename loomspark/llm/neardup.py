"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

1. Every document's set of word shingles gets 64 minwise tokens and a 128-bit fingerprint. Documents with equal sets
   are one class from here on, so copies cost nothing further.
2. Trees: at a node, the path so far draws which of the 64 coordinates to branch on (1/threshold of them on average,
   at least one); classes that share the token at a drawn coordinate meet in a child. Independent trees raise recall.
   From the third level on a node draws 1.2/threshold, so that a pair at the threshold is not lost in deep trees: by the
   branching process's fixed point, ten trees of any depth lose it with a chance of 0.0003 at 0.85 and 0.0007 at 0.8.
3. A first pass compares each class with one leader of its nodes and joins what passes, so that the bulk of a large
   group of near copies becomes one component in a number of comparisons that is linear in the group.
4. A node whose members are in one component is done. A node with few members outside its main component, and few shingles
   in those, is small: the few are compared with all of it. Other nodes are branched again, until none is left; nothing is capped. Rows whose
   tokens rule the threshold out against all of the few (four standard deviations) go no further.
5. Links are confirmed on the full shingle sets, made again from the whole texts. Only links that join components are
   kept, so no group's pairs are written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import dropped, read, written
from .textcodes import each_text, mixed, shingle_codes

TOKENS = 64
_FACTORS = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minwise(codes: np.ndarray) -> np.ndarray:
    """The 64 minwise tokens (32 bits each, as signed) of a set of shingle codes."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(codes), 2048):
        np.minimum(best, (codes[i : i + 2048, None] * _FACTORS).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, one, two, size = [], [], [], []
            for words in each_text(batch.column(1)):
                codes = np.unique(shingle_codes(words, n))
                size.append(len(codes))
                one.append(int(mixed(codes).sum(dtype=np.uint64).view(np.int64)) if len(codes) else 0)
                two.append(int(mixed(codes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(codes) else 0)
                rows.append(minwise(codes) if len(codes) else None)
            flat = np.concatenate([np.zeros(0, np.int32), *[r for r in rows if r is not None]])
            ends = np.cumsum([0] + [TOKENS * (r is not None) for r in rows]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), tokens.cast(schema.field(5).type)], schema=schema)

    return run


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(id, mark, n_shingles, one, two, tokens) of every row of ``docs`` (id, text); without words, an empty list of them."""
    kind = docs.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("mark", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("one", T.LongType()), T.StructField("two", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    return docs.select("id", "text", F.xxhash64("text").alias("mark")).mapInArrow(_sketches(n, to_arrow_schema(out)), out)


def _drawn(node, threshold: float, level: int):
    """The coordinates that a node branches on: one, a second with the chance that makes 1/threshold, 1.2/threshold from level 2 on."""
    pick = lambda k: F.pmod(F.xxhash64(node, F.lit(k)), F.lit(TOKENS)).cast("int")
    mean = (1.2 if level >= 2 else 1.0) / threshold
    more = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(1 << 20)) < int((mean - 1) * (1 << 20))
    return F.when(more, F.array_distinct(F.array(pick(1), pick(2)))).otherwise(F.array(pick(1)))


def _children(rows: DataFrame, threshold: float, level: int = 0) -> DataFrame:
    """(node, rep) of the next level, from (node, rep, tokens)."""
    deeper = rows.withColumn("at", F.explode(_drawn(F.col("node"), threshold, level)))
    return deeper.select(F.xxhash64("node", "at", F.element_at("tokens", F.col("at") + 1)).alias("node"), "rep")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of equal (node, salt) in batches that are sorted by them; a group may come in several slices."""
    for batch in batches:
        node, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        edges = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (salt[1:] != salt[:-1]))) if batch.num_rows else []
        for i, j in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            yield (int(node[i]), int(salt[i])), batch.slice(i, j - i)


def _promising(least: float):
    """Of each node's rows, sorted by (node, salt, rest), those whose tokens agree often enough with a row of another
    component, one of the two being of the node's few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = None, None
        few: list = []  # rows that are in other components than most

        def closed():
            return [r for r in few if r[3]]

        for key, part in _groups(batches):
            schema = part.schema
            out = []
            if key != now:
                out, now, few = closed(), key, []
                stack = np.zeros((64, TOKENS), np.int32)
            tokens = np.asarray(part.column(5).flatten()).reshape(-1, TOKENS)
            for i, (rest, rep, component) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                look = rest or key[1] == 0
                near = np.flatnonzero((stack[: len(few)] == tokens[i]).sum(axis=1) >= least * TOKENS) if look else []
                hits = [k for k in near if few[k][2] != component]
                for k in hits:
                    few[k][3] = True
                row = [(*key, rest), rep, component, bool(hits)]
                if rest and hits:
                    out.append(row)
                elif not rest:
                    if len(few) == len(stack):
                        stack = np.concatenate([stack, np.zeros_like(stack)])
                    stack[len(few)] = tokens[i]
                    few.append(row)
            if out:
                yield _flat(out, schema)
        if few:
            yield _flat(closed(), schema)

    return run


def _flat(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = [[r[0][0] for r in rows], [r[0][1] for r in rows], [r[0][2] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(columns)], names=["node", "salt", "rest", "rep", "component"])


class _Few:
    """The shingle sets of a node's few, with an index from shingle to sets; finds every link with them."""

    def __init__(self):
        self.reps, self.parts, self.sets, self.index = [], [], [], None

    def add(self, rep, component, codes: np.ndarray) -> None:
        self.reps.append(rep)
        self.parts.append(component)
        self.sets.append(codes)

    def linked(self, codes: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which sets have den * intersection >= num * union with this one."""
        if self.index is None:
            flat = np.concatenate(self.sets)
            owner = np.repeat(np.arange(len(self.sets)), [len(c) for c in self.sets])
            order = np.argsort(flat, kind="stable")
            keys, first = np.unique(flat[order], return_index=True)
            self.index = keys, np.append(first, len(flat)), owner[order], np.array([len(c) for c in self.sets])
        keys, first, owner, sizes = self.index
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        at = at[keys[at] == codes]
        n = first[at + 1] - first[at]
        both = np.bincount(owner[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sizes))
        return np.flatnonzero(den * both >= num * (sizes + len(codes) - both))


def _linked(n: int, num: int, den: int):
    """From the promising rows with their texts, sorted by (node, salt, rest), links that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, few, root, kind = None, _Few(), {}, None
        found: list[tuple] = []

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        def meet(rep, component, codes, upto):
            for k in few.linked(codes, num, den):
                a, b = find(few.parts[k]), find(component)
                if k < upto and a != b:
                    root[a] = b
                    found.append((few.reps[k], rep))

        def inside():  # the few among themselves, in the node's first part
            if now is not None and now[1] == 0 and few.sets:
                for k, codes in enumerate(few.sets):
                    meet(few.reps[k], few.parts[k], codes, k)

        ready = False
        for key, part in _groups(batches):
            kind = part.schema.field(3).type
            if key != now:
                if not ready:
                    inside()
                now, few, root, ready = key, _Few(), {}, False
            for rest, rep, component, words in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), each_text(part.column(5)), strict=True):
                codes = np.unique(shingle_codes(words, n))
                if not rest:
                    few.add(rep, component, codes)
                    continue
                if not ready:
                    inside()
                    ready = True
                if few.sets:
                    meet(rep, component, codes, len(few.sets))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i in range(2)], names=["a", "b"])
                found = []
        if not ready:
            inside()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i in range(2)], names=["a", "b"])

    return run


def _confirm(n: int, num: int, den: int):
    """From rows sorted by (a, salt, member), where the first of a group holds a's text, the pairs that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, salt, member, b = (batch.column(i) for i in range(4))
            kept = []
            for k, words in enumerate(each_text(batch.column(4))):
                codes = np.unique(shingle_codes(words, n))
                now = (a[k].as_py(), salt[k].as_py())
                if not member[k].as_py():
                    key, base = now, codes
                elif now == key and len(codes):
                    small, big = (codes, base) if len(codes) <= len(base) else (base, codes)
                    at = np.searchsorted(big, small)
                    both = int((big[np.minimum(at, len(big) - 1)] == small).sum()) if len(big) else 0
                    if den * both >= num * (len(codes) + len(base) - both):
                        kept.append(k)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(kept, pa.int64())), b.take(pa.array(kept, pa.int64()))], names=["a", "b"])

    return run


#: Rows of a node that are compared with its few in one task.
_TOGETHER = 4096
#: So many rows of a few numbers (some 30 MB) are broadcast to be joined; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Shingles of a node's few at most, if they are more than a handful, so that their sets and index fit a task.
_SHINGLES, _HANDFUL = 1 << 22, 8


def _beside(small: DataFrame, label: str, made: list[DataFrame]) -> DataFrame:
    """``small`` as a table, marked for broadcast where its rows are few, so that a hot key's rows stay where they are."""
    table = written(small, label)
    made.append(table)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _texts(docs: DataFrame, homes: DataFrame, reps: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(rep, text) of these classes, from the one row (id, mark of the text) that each is at home in."""
    wanted = _beside(homes.join(reps.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("id").alias("_id"), "mark"), "wanted", made)
    met = docs.join(wanted, (F.col("id") == F.col("_id")) & (F.xxhash64("text") == F.col("mark")))
    return met.select("rep", "text").dropDuplicates(["rep"])


def confirmed(pairs: DataFrame, docs: DataFrame, homes: DataFrame, n: int, num: int, den: int, made: list[DataFrame], together: int = 64) -> DataFrame:
    """The pairs (a, b) of classes with ``den`` * intersection >= ``num`` * union of their texts' shingle sets.

    A text that is in many pairs is sent once for every ``together`` of them.
    """
    pairs = written(pairs.distinct(), "pairs")
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / together).cast("int").alias("salts"))
    dealt = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    rows = dealt.select("a", "salt", F.lit(True).alias("member"), F.col("b").alias("rep")).unionByName(
        dealt.select("a", "salt").distinct().select("a", "salt", F.lit(False).alias("member"), F.col("a").alias("rep"))
    )
    texts = _texts(docs, homes, rows, made)
    full = rows.join(texts, "rep").select("a", "salt", "member", F.col("rep").alias("b"), "text")
    dealt_out = full.repartition("a", "salt").sortWithinPartitions("a", "salt", "member")
    found = written(dealt_out.mapInArrow(_confirm(n, num, den), "a long, b long"), "confirmed")
    dropped(pairs)
    made.append(found)
    return found


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    num: int = 80,
    den: int = 100,
    trees: int = 10,
    few: int = 2048,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``.

    Words: runs of other than space and tab to carriage return, A-Z lower-cased. A set: distinct shingles of ``n``
    words, or the whole sequence of a shorter text. Two texts are linked when ``den`` * intersection >= ``num`` * union;
    component_id is the least id that links reach, kept is true on the rows with that id. A text that is null or without
    words has an empty set and is linked with nothing. Rows with equal ids are one document to the links: each of their
    texts is compared, and all that any of them reaches is one component. Null ids are never linked; they get a null
    component and are kept. Other columns are not read. A link is missed with a chance below 0.001 at the threshold and
    less above it (``trees`` trees), however deep they go; a group with several links between its parts is missed far
    more rarely. ``few``: a node is compared exhaustively when so many of its members at most are in other components
    than most of them are. Classes of equal sets are told apart by 64 of their 128 bits.
    """
    threshold = num / den
    least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / TOKENS)
    made: list[DataFrame] = []

    def table(df: DataFrame, label: str) -> DataFrame:
        made.append(written(df, label))
        return made[-1]

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    every = written(sketches(source, n), "sketches")
    named = every.filter("n_shingles > 0 and id is not null").withColumn("rep", F.xxhash64("one", "two"))
    classes = table(named.groupBy("rep").agg(F.min(F.struct("id", "mark", "tokens", "n_shingles")).alias("least")).select("rep", "least.*"), "classes")
    homes, base = classes.select("rep", "id", "mark"), classes.select("rep", "tokens")

    root = base.withColumn("node", F.explode(F.array(*[F.xxhash64(F.lit("tree"), F.lit(t)) for t in range(trees)])))
    rows = table(_children(root, threshold), "nodes")

    # a leader for each node: the member whose nodes are the largest, as the middle of a group has most of its tokens
    counts = _beside(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "counts", made)
    shared = table(rows.join(counts, "node"), "shared")
    weight = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    heads = shared.join(weight, "rep").groupBy("node").agg(F.max(F.struct("weight", "rep")).alias("head")).select("node", F.col("head.rep").alias("leader"))
    met = shared.join(_beside(heads, "heads", made), "node").filter("rep != leader").select("rep", "leader").distinct()
    met = met.join(base, "rep").join(base.select(F.col("rep").alias("leader"), F.col("tokens").alias("theirs")), "leader")
    like = F.size(F.filter(F.zip_with("tokens", "theirs", lambda x, y: x == y), lambda x: x))
    met = met.withColumn("like", like).filter(F.col("like") >= least * TOKENS)
    best = met.groupBy("rep").agg(F.max(F.struct("like", "leader")).alias("best")).select(F.col("best.leader").alias("a"), F.col("rep").alias("b"))
    links = confirmed(best, source, homes, n, num, den, made)
    firsts = named.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("id", "a")
    same = table(named.join(firsts, "id").filter("rep > a").select("a", F.col("rep").alias("b")).distinct(), "same")  # texts of one id
    links = links.unionByName(same)
    known = table(components(links), "known").select(F.col("id").alias("rep"), "component")

    # what is left: nodes with more than one component
    level, ready, depth = shared.select("node", "rep"), None, 1
    while True:
        marked = level.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(classes.select("rep", "n_shingles"), "rep")
        parts = marked.groupBy("node", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
        nodes = parts.groupBy("node").agg(F.sum("n").alias("size"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "component", "shingles")).alias("most"), F.count("*").alias("parts"))
        nodes = nodes.filter("parts > 1").select("node", "size", F.col("most.component").alias("main"), (F.col("size") - F.col("most.n")).alias("others"), (F.col("shingles") - F.col("most.shingles")).alias("shingles"))
        opened = table(marked.drop("n_shingles").join(_beside(nodes, "nodes", made), "node"), "open")
        small = (F.col("others") <= few) & ((F.col("shingles") <= _SHINGLES) | (F.col("others") <= _HANDFUL))
        narrow = opened.filter(small).withColumn("rest", F.col("component") == F.col("main"))
        salts = F.ceil(F.col("size") / _TOGETHER).cast("int")
        salt = F.when(F.col("rest"), F.array(F.pmod(F.xxhash64("rep"), salts).cast("int"))).otherwise(F.sequence(F.lit(0), salts - 1))
        narrow = narrow.select("node", F.explode(salt).alias("salt"), "rest", "rep", "component")
        ready = narrow if ready is None else ready.unionByName(narrow)
        wide = opened.filter(~small)
        if wide.isEmpty():
            break
        level = table(_children(wide.join(base, "rep"), threshold, depth), "nodes")
        size = _beside(level.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "counts", made)
        level, depth = level.join(size, "node").select("node", "rep"), depth + 1
    row = "node long, salt int, rest boolean, rep long, component long"
    sorted_ = lambda df: df.repartition("node", "salt").sortWithinPartitions("node", "salt", "rest")
    seen = ready.join(base, "rep").select("node", "salt", "rest", "rep", "component", "tokens")
    hopeful = table(sorted_(seen).mapInArrow(_promising(least), row), "hopeful")
    full = hopeful.join(_texts(source, homes, hopeful, made), "rep").select("node", "salt", "rest", "rep", "component", "text")
    more = sorted_(full).mapInArrow(_linked(n, num, den), "a long, b long")
    last = components(links.unionByName(more)).select(F.col("id").alias("rep"), "component")

    reached = classes.select("rep", "id").join(last, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    leasts = reached.groupBy("component").agg(F.min("id").alias("component_id"))
    reps = written(reached.join(leasts, "component").select("rep", "component_id"), "reps")
    dropped(*made)
    whole = every.select("id", "n_shingles", F.xxhash64("one", "two").alias("rep")).join(reps, "rep", "left")
    whole = whole.withColumn("component_id", F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("id")))
    return whole.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by shingles of three words, linked from 85 in 100."""
    return near_duplicates(read(spark, sf_dir, "documents"), n=3, num=85, den=100)
