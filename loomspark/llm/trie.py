"""Prefix trie of conversations, by adaptive radix trees over fixed-width turn ids.

A turn's id is 16 big-endian bytes (the beginning of the SHA-256 of role and text), a conversation's key its turn ids
laid end to end, cut into segments of 64 turns. A segment hangs under the node that the turns before it lead to, so keys
are short however long a dialogue is. Segments are dealt by ranges of (that node, key, conversation); a task puts those
it gets into radix trees, so what conversations share there becomes one path, and emits a partial row for each path that
ends at a turn's edge, never for bytes inside a turn id. Rows of a node are then added up.

Totals of subtrees need no walk from level to level: the conversation with the smallest id of a node owns it, and with
it all nodes below on its path, so of each conversation the tasks need to know only from which depth on it is an owner
and whether its end is childless. A second pass over the trees adds that up towards the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .art import Tree
from .tables import read, word_count, written

WIDTH = 16
SEGMENT = 64
#: Bytes of keys that a task holds in trees before it emits their nodes.
HELD = 8 << 20
_NEVER = (1 << 31) - 1


def ordered_turns(dialogues: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, id, words): every turn, its place from 0 in its conversation, its id and its number of words.

    Turns are ordered by number, null first, then role, then text; a null role or text is empty; repeated rows are turns
    of their own; rows without a conversation are left out. A place is counted over stretches of 64 turn numbers and
    then within one, so a long dialogue is no single group unless all its turns have one number.
    """
    turns = dialogues.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    turns = turns.withColumn("stretch", F.floor(F.col("turn") / SEGMENT))
    counts = turns.groupBy("conv_id", "stretch").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("conv_id").alias("_conv"), F.col("stretch").alias("_stretch"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    named = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text")), 256)
    placed = turns.withColumn("at", F.row_number().over(own) - 1).select("conv_id", "stretch", "at", F.substring(named, 1, 2 * WIDTH).alias("id"), word_count("text").alias("words"))
    placed = placed.join(before, (F.col("conv_id") == F.col("_conv")) & F.col("stretch").eqNullSafe(F.col("_stretch")))
    return placed.select("conv_id", (F.col("at") + F.col("before")).cast("long").alias("place"), "id", "words")


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that take their beginning over from another.

    Conversation c has the first h turns of c - c % ``family`` (all, if it has fewer; none, if it isn't there), then its
    own after its first h; h = crc32(c in decimals) % ``heads``. Also all conv_ids, as some may have no turn left.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("long")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("head", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    lengths = convs.select(F.col("conv_id").alias("_base"), F.col("n").alias("has"))
    convs = convs.join(lengths, F.col("base") == F.col("_base"), "left").select("conv_id", "base", "head", F.least("head", F.coalesce("has", F.lit(0))).alias("taken"))
    own = turns.join(convs.select(F.col("conv_id").alias("_conv"), "head", "taken"), F.col("conv_id") == F.col("_conv")).filter(F.col("place") >= F.col("head"))
    own = own.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "id", "words")
    # of a conversation at most heads - 1 turns go to family - 1 others
    first = turns.filter((F.col("place") < heads - 1) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "_base")
    lent = first.join(convs.filter("taken > 0"), (F.col("_base") == F.col("base")) & (F.col("place") < F.col("taken")))
    return own.unionByName(lent.select("conv_id", "place", "id", "words")), convs.select("conv_id")


def _segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per conversation and 64 turns: the node above (p, q), the key, each turn's share of node ids, its words.

    A node's id is the XOR of the shares (two of 64 bits) of its path, a share being a hash of place and turn id.
    """
    rows = turns.select("conv_id", F.floor(F.col("place") / SEGMENT).alias("seg"), F.struct("place", "id", F.xxhash64("place", "id").alias("a"), F.xxhash64("id", F.lit("b"), "place").alias("b"), "words").alias("turn"))
    every = rows.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("seg"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn")))
    # at most 64 turns are gathered; nulls aren't
    segs = every.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.coalesce(F.bit_xor("turn.a"), F.lit(0)).alias("a"), F.coalesce(F.bit_xor("turn.b"), F.lit(0)).alias("b"))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(name) for c, name in (("a", "p"), ("b", "q"))]
    part = lambda name: F.transform("turns", lambda t: t[name])
    return segs.select("conv_id", "seg", *above, F.unhex(F.array_join(part("id"), "")).alias("key"), part("a").alias("a"), part("b").alias("b"), part("words").alias("words"))


_PARTIAL = "p long, q long, above_p long, above_q long, depth long, conv_id long, n long, words long, leaves long, saved long"


def _emitted(trees: dict, rows: list) -> pa.RecordBatch:
    """The partial rows of all nodes of a task's trees; ``rows``: (conv_id, a, b, words, owns_from, leaf, later)."""
    out: list[tuple] = []
    for (p, q, seg), tree in trees.items():
        found: dict[int, tuple] = {}
        for node, start, end in tree.upwards():
            below = [found.pop(id(child)) for _, child in node.children()]
            below += [(i, 1, rows[i][5], rows[i][6]) for i in node.ends]
            if not below:  # the root of a tree that holds nothing
                continue
            # of several conversations the one with the smallest id stands for the node
            best = min((x[0] for x in below), key=lambda i: (rows[i][0], i))
            n, leaves, saved = (sum(x[k] for x in below) for k in (1, 2, 3))
            conv, a, b, words, owns_from = rows[best][:5]
            low = start // WIDTH
            for depth in range(end // WIDTH, low, -1):  # the turns whose last byte is on this path
                whole = seg * SEGMENT + depth
                saved += (n - (whole >= owns_from)) * int(words[depth - 1])
                up = (p, q) if depth == 1 else (p ^ int(a[depth - 2]), q ^ int(b[depth - 2]))
                out.append((p ^ int(a[depth - 1]), q ^ int(b[depth - 1]), *up, whole, conv, n, int(words[depth - 1]), leaves, saved))
            if start == 0 and seg == 0 and node is tree.root:
                out.append((0, 0, None, None, 0, conv, n, 0, leaves, saved))
            found[id(node)] = (best, n, leaves, saved)
    columns = list(zip(*out, strict=True)) if out else [()] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _PARTIAL.split(", ")])


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of a task's segments, emitted whenever they hold `HELD` bytes of keys."""
    trees: dict = {}
    rows: list = []
    held = 0
    lists = lambda column: [x.values.to_numpy(zero_copy_only=False) for x in column]
    for batch in batches:
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        a, b = ([np.bitwise_xor.accumulate(x) for x in lists(column[name])] for name in ("a", "b"))
        plain = [column[name].to_pylist() for name in ("conv_id", "seg", "p", "q", "key", "owns_from", "leaf", "later")]
        for i, (conv, seg, p, q, key, owns_from, leaf, later) in enumerate(zip(*plain, strict=True)):
            tree = trees.get((p, q, seg))
            if tree is None:
                tree = trees[p, q, seg] = Tree()
            tree.add(key, len(rows))
            rows.append((conv, a[i], b[i], column["words"][i].values, owns_from, leaf, later))
            held += len(key) + 64
            if held >= HELD:
                yield _emitted(trees, [(*r[:3], r[3].to_numpy(zero_copy_only=False), *r[4:]) for r in rows])
                trees, rows, held = {}, [], 0
    yield _emitted(trees, [(*r[:3], r[3].to_numpy(zero_copy_only=False), *r[4:]) for r in rows])


def _partials(segments: DataFrame) -> DataFrame:
    dealt = segments.repartitionByRange("seg", "p", "q", "key", "conv_id").sortWithinPartitions("seg", "p", "q", "key", "conv_id")
    return dealt.select("conv_id", "seg", "p", "q", "key", "a", "b", "words", "owns_from", "leaf", "later").mapInArrow(_grown, _PARTIAL)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's conv_ids, which come in order and are read once."""
    now, sha, out = None, None, []
    for batch in batches:
        for p, q, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (p, q) != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (p, q), hashlib.sha256(str(conv).encode())
            else:
                sha.update(f",{conv}".encode())
        if len(out) >= 10_000:
            yield _digests(out)
            out = []
    if now is not None:
        out.append((*now, sha.hexdigest()))
    yield _digests(out)


def _digests(out: list) -> pa.RecordBatch:
    kinds = (("p", pa.int64()), ("q", pa.int64()), ("ends_sha256", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """The nodes of the trie of conversations: a row for each distinct sequence of first turns.

    ``turns``: conv_id, place (from 0, without gaps), id (32 hexadecimal digits, equal just for equal turns), words, as
    `ordered_turns` gives; ``convs``: conv_ids that count as members even without turns. Returns conv_id (the smallest
    member: its turn at place depth - 1 is the node's last), depth, parent_conv_id (of the root: null), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, (n_convs - 1) times the words of each node's last turn), n_ends
    and ends_sha256 (of the decimal ids of members that end at the node, ascending, comma-joined). No conversations give
    no nodes. A node where very many conversations end has their ids hashed by one task, which reads them in order and
    holds none.
    """
    spark = turns.sparkSession
    ids = turns.select("conv_id").distinct() if convs is None else convs.select("conv_id").distinct()
    segments = written(_segments(turns, ids), "trie-segments")
    open_ = segments.select("*", F.lit(_NEVER).alias("owns_from"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("later"))
    first = _partials(open_).groupBy("p", "q").agg(
        F.min("above_p").alias("above_p"), F.min("above_q").alias("above_q"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("words").alias("words")
    )
    first = written(first, "trie-nodes")
    children = first.filter("depth > 0").groupBy(F.col("above_p").alias("p"), F.col("above_q").alias("q")).agg(F.count("*").alias("n_children"))
    nodes = first.join(children, ["p", "q"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("owns_from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    known = segments.join(owners, "conv_id", "left").withColumn("owns_from", F.coalesce("owns_from", F.lit(_NEVER))).withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    counted = F.transform("words", lambda w, i: F.when(F.col("seg") * SEGMENT + i + 1 >= F.col("owns_from"), F.lit(0)).otherwise(w))
    behind = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    spare = F.aggregate(counted, F.lit(0).cast("long"), lambda x, y: x + y)
    known = known.withColumn("spare", spare).withColumn("later", F.coalesce(F.sum("spare").over(behind), F.lit(0)))
    totals = _partials(known).groupBy("p", "q").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    last = segments.groupBy("conv_id").agg(F.bit_xor(F.aggregate("a", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))).alias("p"), F.bit_xor(F.aggregate("b", F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))).alias("q"))
    hashed = last.select("p", "q", "conv_id").repartition("p", "q").sortWithinPartitions("p", "q", "conv_id").mapInArrow(_hashed, "p long, q long, ends_sha256 string")
    ended = last.groupBy("p", "q").agg(F.count("*").alias("n_ends")).join(hashed, ["p", "q"])

    parents = first.select(F.col("p").alias("above_p"), F.col("q").alias("above_q"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(parents, ["above_p", "above_q"], "left").join(totals, ["p", "q"]).join(ended, ["p", "q"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("n_ends", F.lit(0)).alias("n_ends"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with a beginning taken over from the first of its twenty."""
    return prefix_trie(*rebuilt(written(ordered_turns(read(spark, sf_dir, "conversations")), "trie-turns")))
