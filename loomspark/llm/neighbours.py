"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

The forest is fitted on a bounded sample: each split is the hyperplane between two sampled vectors, at the median.
Every vector is then routed through every tree. A query searches all trees through one priority queue, always
following the branch whose worst margin so far is least, until the leaves it has visited hold the asked share of the
sample, and more than k of it; the vectors in those leaves, and only those, are scored exactly. Which share is asked is
measured: some sampled vectors search the sample, and the share is taken at which they have found the asked part of their
true neighbours, so clustered vectors are searched in few leaves and evenly spread ones in many.

Vectors lie in blocks in the order of the first tree's leaves. A query goes to the blocks of those of these leaves that
hold a sampled vector it has found, so the rows that are shuffled grow with what it visits.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import read, written

#: Sampled vectors that search the sample to measure how far a search must go.
_MEASURED = 48


class Forest:
    """Complete binary trees of the same depth; nodes in heap order."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        n = len(sample)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf)))) if n > leaf else 0
        self.inner = (1 << self.depth) - 1
        self.planes = np.zeros((trees, self.inner, sample.shape[1]))
        self.cuts = np.zeros((trees, self.inner))
        #: Of each tree and leaf the sampled vectors in it.
        self.members: list[list[np.ndarray]] = []
        self.sampled = n
        #: The first tree's leaf of each sampled vector.
        self.place = np.zeros(n, dtype=np.int32)
        rng = np.random.default_rng(seed)
        for t in range(trees):
            level = [np.arange(n)]
            for d in range(self.depth):
                below = []
                for k, own in enumerate(level):
                    node = (1 << d) - 1 + k
                    plane = rng.normal(size=sample.shape[1])
                    if len(own) > 1:
                        i, j = rng.choice(own, 2, replace=False)
                        if (sample[i] != sample[j]).any():
                            plane = sample[i] - sample[j]
                    plane /= np.linalg.norm(plane)
                    side = sample[own] @ plane
                    cut = np.median(side) if len(own) else 0.0
                    self.planes[t, node], self.cuts[t, node] = plane, cut
                    below += [own[side < cut], own[side >= cut]]
                level = below
            self.members.append([own.astype(np.int32) for own in level])
        for number, own in enumerate(self.members[0]):
            self.place[own] = number

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), len(self.planes)), dtype=np.int64)
        for t in range(len(self.planes)):
            node = out[:, t]
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", vectors, self.planes[t][node]) >= self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - self.inner
        return out

    def walk(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """All leaves as (tree, leaf), those of the least margin first."""
        margins = self.planes @ query - self.cuts
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        while queue:
            worst, t, node = heapq.heappop(queue)
            while node < self.inner:
                m = margins[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(worst, abs(m)), t, far))
                node = near
            yield t, node - self.inner

    def search(self, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Which leaves (trees x leaves, True) a query visits until they hold ``least`` sampled vectors, or all, and which these are."""
        visited = np.zeros((len(self.planes), 1 << self.depth), dtype=bool)
        held, n = np.zeros(self.sampled, dtype=bool), 0
        for t, leaf in self.walk(query):
            if n >= min(least, self.sampled):
                break
            visited[t, leaf] = True
            own = self.members[t][leaf]
            n += len(own) - int(held[own].sum())
            held[own] = True
        return visited, held

    def share_for(self, queries: np.ndarray, near: np.ndarray, recall: float) -> float:
        """The share of the sample that searches hold when they have found ``recall`` of the sampled vectors ``near`` each query."""
        needed = []
        for query, wanted in zip(queries, near, strict=True):
            held, n, left = np.zeros(self.sampled, dtype=bool), 0, set(wanted.tolist())
            for t, leaf in self.walk(query):
                if not left:
                    break
                own = self.members[t][leaf]
                new = own[~held[own]]
                held[new] = True
                n += len(new)
                found = left.intersection(new.tolist())
                left -= found
                needed += [n] * len(found)
        return sorted(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] / self.sampled if needed else 1.0


def _matrix(column: pa.Array) -> np.ndarray:
    """List arrays of equal length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null, every component a finite number, not all zero, id not null."""
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return named.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    trees: int = 12,
    leaf: int = 32,
    recall: float = 0.97,
    sample: int = 20_000,
    block: int = 8192,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, id_col, score): the ``k`` nearest vectors of each whose id is divisible by ``every``.

    Nearness is the inner product in double precision; rank runs from 1; ties go to the smaller id. A query's own row is
    no candidate. Vectors that are null, zero or hold null or non-finite components take no part, nor do those of
    another length than most have (of equally many, the longer). Equal vectors are one entry of the index with their
    k + 1 least ids, which is all that a result can need. Rows that repeat an id and its vector count once. The forest
    is fitted on at most ``sample`` distinct vectors (least hashes) and every vector is indexed; ``recall`` is the part of
    their true neighbours among the sample that sampled queries must find, and decides how many leaves all queries visit.
    Those hold more than ``k`` sampled vectors, if there are so many, so no query gets fewer than ``k`` rows where there
    are ``k`` candidates. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    valid = usable(vectors, id_col, vec_col)
    common = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = f"query_id long, rank int, {id_col} long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    valid = written(valid.filter(F.size("v") == common["n"]).distinct(), "vectors")
    order = Window.partitionBy("v").orderBy("id")
    least = valid.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k + 1)  # cut before the shuffle too
    entries = written(least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    total, widest = entries.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    widest *= 1 + 1e-9

    # one more component makes all lengths equal, so that the largest inner product is the nearest point
    drawn = np.array([r["v"] for r in entries.select("v").orderBy(F.xxhash64("v")).limit(sample).collect()])  # ``sample`` rows
    wide = np.hstack([drawn, np.sqrt(np.maximum(widest**2 - (drawn**2).sum(1), 0))[:, None]])
    forest = Forest(wide, trees, leaf, seed)
    some = np.random.default_rng(seed).permutation(len(drawn))[:_MEASURED]
    closest = drawn[some] @ drawn.T  # _MEASURED x sample
    closest[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-closest, axis=1, kind="stable")[:, : min(k, len(drawn) - 1)]
    least = max(k + 1, int(np.ceil(forest.share_for(np.hstack([drawn[some], np.zeros((len(some), 1))]), near, recall) * len(drawn))))
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(forest))  # about 2 * sample / leaf * trees planes, and the sample's numbers
    blocks, leaves = max(1, -(-total // block)), 1 << forest.depth
    parts_of_leaf = max(1, -(-blocks // leaves))
    block_of = np.arange(leaves) if parts_of_leaf > 1 else np.arange(leaves) * blocks // leaves

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = pickle.loads(sent.value)
        for batch in batches:
            v = _matrix(batch.column(0))
            if len(v):
                routed = forest.leaves(np.hstack([v, np.sqrt(np.maximum(widest**2 - (v**2).sum(1), 0))[:, None]]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(routed.astype(np.int32)), pa.list_(pa.int32()))], names=["v", "ids", "leaves"])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = pickle.loads(sent.value)
        for batch in batches:
            visits = [forest.search(np.append(q, 0.0), least) for q in _matrix(batch.column(1))]
            packed = pa.array([np.packbits(x).tobytes() for x, _ in visits], pa.binary())
            goes = pa.array([block_of[np.unique(forest.place[held])].tolist() for _, held in visits], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, goes], names=["id", "v", "visits", "goes"])

    shape, depth = (trees, leaves), k + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, ready = None, [], None
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            query = batch.column(1).to_numpy(zero_copy_only=False)
            v = _matrix(batch.column(3))
            rows = []
            for i in range(batch.num_rows):
                if at[i] != now:
                    now, parts, ready = at[i], [], None
                if not query[i]:
                    parts.append((v[i], batch.column(5)[i].values.to_numpy(zero_copy_only=False), batch.column(4)[i].values.to_numpy(zero_copy_only=False)))
                    continue
                if ready is None:
                    ready = (np.array([p[0] for p in parts]).reshape(len(parts), v.shape[1]), np.array([p[1] for p in parts]).reshape(len(parts), shape[0]), [p[2] for p in parts])
                    parts = []
                own, leaves, ids = ready
                visits = np.unpackbits(np.frombuffer(batch.column(6)[i].as_py(), np.uint8), count=shape[0] * shape[1]).reshape(shape).astype(bool)
                hit = np.zeros(len(own), dtype=bool)
                for t in range(shape[0]):
                    hit |= visits[t][leaves[:, t]]
                found = np.flatnonzero(hit)
                scores = own[found] @ v[i]
                if len(found) > depth:
                    top = np.partition(scores, len(scores) - depth)[len(scores) - depth]
                    found, scores = found[scores >= top], scores[scores >= top]
                me = batch.column(2)[i].as_py()
                pairs = sorted((-s, int(x)) for f, s in zip(found, scores.tolist(), strict=True) for x in ids[f] if x != me)[:k]
                rows += [(me, x, -s) for s, x in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    laid = entries.select("v", "ids").mapInArrow(index, "v array<double>, ids array<long>, leaves array<int>")
    # blocks follow the first tree's leaves: several leaves make a block, or a leaf several blocks
    own = F.get("leaves", F.lit(0))
    place = own * parts_of_leaf + F.pmod(F.xxhash64("v"), F.lit(parts_of_leaf)) if parts_of_leaf > 1 else F.floor(own * blocks / leaves)
    laid = laid.select(place.cast("int").alias("block"), F.lit(False).alias("query"), F.lit(None).cast("long").alias("id"), "v", "ids", "leaves", F.lit(None).cast("binary").alias("visits"))
    asked = valid.filter(F.pmod("id", F.lit(every)) == 0).select("id", "v")
    parts = max(1, -(-asked.count() // 128))  # a search through the forest takes milliseconds, so few queries make a task
    asked = asked.repartition(parts, "id").mapInArrow(plan, "id long, v array<double>, visits binary, goes array<int>")
    asked = asked.withColumn("block", F.explode(F.array_distinct("goes")))
    if parts_of_leaf > 1:
        asked = asked.withColumn("block", F.explode(F.sequence(F.col("block") * parts_of_leaf, (F.col("block") + 1) * parts_of_leaf - 1)))
    asked = asked.select("block", F.lit(True).alias("query"), "id", "v", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("leaves"), "visits")
    dealt = laid.unionByName(asked).repartition(blocks if parts_of_leaf == 1 else leaves * parts_of_leaf, "block").sortWithinPartitions("block", "query")
    found = dealt.mapInArrow(score, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every embedding whose id is divisible by 20."""
    return nearest(read(spark, sf_dir, "embeddings"))
