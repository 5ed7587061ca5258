"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on at most ``SAMPLE`` vectors (those with the smallest hash of their id); every vector is indexed.
A search keeps nodes in a priority queue by the inner product of the query with their centre and visits the best
leaves.  The number of visits is calibrated: queries from the sample are searched with more and more leaves until they
find ``RECALL`` of their true neighbours in the sample.

A leaf is cut into parts of at most about ``PART`` candidates, and its queries likewise, so no task holds an unbounded
leaf.  Every query has a floor, its k-th best product with the sample's vectors in the leaves that it visits; a task
reports only what reaches it, so few rows travel.  Reported products are taken in double precision from the original vectors, in a fixed order of summation.

Nulls: vectors that are null, zero, hold a null or non-finite component or have another number of dimensions than the
sample's most common one take no part, nor do rows without an id.  Ties go to the smaller id.  A repeated id counts
once, with its best product, and once among the k that a floor stands for; of its equal rows a batch passes on one, so a
row that is repeated however often is no load.  No query is its own neighbour.  Visits go on until the leaves hold
more than k vectors of the sample, so only a table of fewer than k candidates gives fewer, and then all of them.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import numbered_partitions, table, written

SAMPLE = 20_000
BRANCH = 8
LEAF = 64  # sample vectors in a leaf, at most
PROBES = 256  # calibration queries
RECALL = 0.95
PART = 8192


class Tree:
    """Nodes in arrays: centre, children (none: a leaf), leaf number."""

    def __init__(self, vectors: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf_of: dict[int, int] = {}
        rng = np.random.default_rng(seed)
        self._grow(vectors, branch, leaf, rng, 0)
        self.matrix = [np.stack([self.centres[c] for c in x]) if x else None for x in self.children]

    def _grow(self, x: np.ndarray, branch: int, leaf: int, rng, depth: int) -> int:
        node = len(self.centres)
        self.centres.append(x.mean(axis=0))
        self.children.append([])
        groups = [x[k] for k in kmeans(x, branch, rng)] if len(x) > leaf and depth < 12 else []
        if len(groups) < 2:
            self.leaf_of[node] = len(self.leaf_of)
        else:
            self.children[node] = [self._grow(g, branch, leaf, rng, depth + 1) for g in groups]
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector: the nearest centre at every level."""
        out = np.zeros(len(x), np.int64)

        def down(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node in self.leaf_of:
                out[rows] = self.leaf_of[node]
                return
            m = self.matrix[node]
            best = ((m * m).sum(axis=1)[None] - 2 * x[rows] @ m.T).argmin(axis=1)
            for i, child in enumerate(self.children[node]):
                down(child, rows[best == i])

        down(0, np.arange(len(x)))
        return out

    def visit(self, q: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The leaves of a best-bin-first search, in the order of its visits; more of them until they hold ``least``."""
        queue, found, seen = [(0.0, 0)], [], 0 if sizes is not None else least
        while queue and (len(found) < visits or seen < least):
            node = heapq.heappop(queue)[1]
            if node in self.leaf_of:
                found.append(self.leaf_of[node])
                seen += 0 if sizes is None else int(sizes[found[-1]])
            else:
                for s, child in zip((-(self.matrix[node] @ q)).tolist(), self.children[node], strict=True):
                    heapq.heappush(queue, (s, child))
        return found


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> list[np.ndarray]:
    """Row numbers of each group; empty groups are left out."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    best = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = ((centres * centres).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)
        if (new == best).all() and _:
            break
        best = new
        for j in range(len(centres)):
            if (best == j).any():
                centres[j] = x[best == j].mean(axis=0)
    return [r for j in range(len(centres)) if len(r := np.flatnonzero(best == j))]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the same order wherever it stands."""
    return np.add.reduce(np.ascontiguousarray(q * x), axis=1)


class Index:
    """The tree with its calibrated number of visits, and the sample for the floors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, recall: float = RECALL, probes: int = PROBES):
        self.dims, self.k = vectors.shape[1], k
        self.tree = Tree(vectors)
        self.ids, self.vectors = ids, vectors.astype(np.float32)
        self.visits, self.recall = self._calibrate(recall, probes)
        self.sizes = np.bincount(self.leaves, minlength=len(self.tree.leaf_of))

    def _calibrate(self, target: float, probes: int) -> tuple[int, float]:
        x, leaves = self.vectors.astype(np.float64), len(self.tree.leaf_of)
        rows = np.linspace(0, len(x) - 1, min(probes, len(x))).astype(np.int64)
        own = self.leaves = self.tree.assign(x)
        orders, truth = [], []
        for r in rows.tolist():
            s = x @ x[r]
            s[r] = -np.inf
            truth.append(own[np.argsort(-s, kind="stable")[: min(self.k, len(x) - 1)]])
            orders.append({leaf: i for i, leaf in enumerate(self.tree.visit(x[r], leaves))})
        # the visit at which each true neighbour is found
        at = np.array([orders[i][leaf] for i, t in enumerate(truth) for leaf in t.tolist()])
        visits = 1
        if len(x) <= self.k:
            return leaves, 1.0
        while visits < leaves and len(at) and (at < visits).mean() < target:
            visits = min(leaves, visits + max(1, visits // 8))
        return visits, float((at < visits).mean()) if len(at) else 1.0

    def floor(self, qid: int, q: np.ndarray, leaves: list[int]) -> float:
        """A product that the k-th neighbour found in these leaves reaches: they hold the sample's vectors too."""
        s = self.vectors @ q.astype(np.float32)
        s = s[(self.ids != qid) & np.isin(self.leaves, leaves)].astype(np.float64)
        if len(s) < self.k:
            return -np.inf
        low = float(np.partition(s, len(s) - self.k)[len(s) - self.k])
        return low - 1e-4 * (abs(low) + float(np.abs(q).max()))  # single precision is enough for a floor


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))


def build(vectors: DataFrame, k: int, sample: int = SAMPLE) -> Index | None:
    ids = F.broadcast(vectors.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample))  # the bound is ``sample``
    rows = vectors.join(ids, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.xxhash64("vec_id"), "vec_id").toPandas()
    if not len(rows):
        return None
    dims = Counter(map(len, rows["vector"])).most_common()
    dims = min(d for d, n in dims if n == dims[0][1])
    rows = rows[rows["vector"].map(len) == dims]
    return Index(rows["vec_id"].to_numpy(np.int64), np.stack(rows["vector"].to_numpy()), k)


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of one row for each (id, vector), in ascending order."""
    firsts = np.unique(ids, return_index=True)[1]
    if len(firsts) == len(ids):
        return np.arange(len(ids))
    return np.sort(np.unique(np.concatenate([ids[:, None].astype(np.int64), x.view(np.int64)], axis=1), axis=0, return_index=True)[1])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


ROW = "leaf int, part int, block int, kind int, id long, floor double, vector array<double>"
NAMES = ["leaf", "id", "floor", "vector"]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """The k nearest of ``vectors`` (vec_id, embedding) to each of ``queries``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors)
    index = build(rows, k, sample)
    if index is None:
        return spark.createDataFrame([], result)
    shared = spark.sparkContext.broadcast(index)  # its size is set by the sample
    dims = index.dims

    def assign(batches):
        for b in batches:
            own = distinct_rows(b.column(0).to_numpy(), np.ascontiguousarray(_matrix(b.column(1), dims)))
            b = b if len(own) == b.num_rows else b.take(pa.array(own))
            x = _matrix(b.column(1), dims)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.tree.assign(x), pa.int32()), b.column(0), pa.array(np.zeros(len(x))), b.column(1)], names=NAMES)

    def probe(batches):
        index = shared.value
        for b in batches:
            x = _matrix(b.column(1), dims)
            for lo in range(0, len(x), 256):
                part, ids = x[lo : lo + 256], b.column(0).slice(lo, 256).to_pylist()
                leaves = [index.tree.visit(q, index.visits, index.sizes, k + 1) for q in part]
                at = np.repeat(np.arange(len(part)), [len(v) for v in leaves])
                floors = np.array([index.floor(i, q, v) for i, q, v in zip(ids, part, leaves, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(leaves), pa.int32()), pa.array(np.array(ids)[at]), pa.array(floors[at]), b.column(1).slice(lo, 256).take(pa.array(at))], names=NAMES)

    kind = "leaf int, id long, floor double, vector array<double>"
    sized = F.size("vector") == dims
    placed = written(rows.where(sized).mapInArrow(assign, kind), "leaves")
    asked = usable(queries).where(sized).groupBy("vec_id").agg(F.min("vector").alias("vector")).repartition(numbered_partitions(spark))
    probes = written(asked.mapInArrow(probe, kind), "probes")
    # a row for each leaf; the tree has at most a few thousand leaves, set by the sample
    held = {r["leaf"]: -(-r["n"] // PART) for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {r["leaf"]: -(-r["n"] // PART) for r in probes.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = spark.createDataFrame([(leaf, held[leaf], wanted[leaf]) for leaf in sorted(held.keys() & wanted.keys())], "leaf int, parts int, blocks int")
    sizes = F.broadcast(sizes)

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str, what: int) -> DataFrame:
        """A row goes to one of its own divisions and meets all of the other side's."""
        out = df.join(sizes, "leaf").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_n)).cast("int"))
        out = out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
        return out.select("leaf", "part", "block", F.lit(what).alias("kind"), "id", "floor", "vector")

    both = dealt(placed, "part", "parts", "block", "blocks", 0).unionByName(dealt(probes, "block", "blocks", "part", "parts", 1))
    met = both.repartition(numbered_partitions(spark), "leaf", "part", "block").sortWithinPartitions("leaf", "part", "block", "kind")
    found = met.mapInArrow(lambda batches: _compare(batches, dims, k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _compare(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each division's candidates come first; its queries are then compared with them as they come."""
    group, held, ready = None, [], None
    for b in batches:
        keys = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
        ids, floors, x = b.column(4).to_numpy(), b.column(5).to_numpy(), _matrix(b.column(6), dims)
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if tuple(keys[lo][:3]) != group:
                group, held, ready = tuple(keys[lo][:3]), [], None
            if keys[lo][3] == 0:
                held.append((ids[lo:hi], x[lo:hi]))
                continue
            if ready is None and held:
                every, vectors = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                own = distinct_rows(every, vectors)
                ready = every[own], vectors[own]
                firsts = np.unique(ready[0], return_index=True)[1]  # one row for each id
                held = []
            if ready is None:
                continue
            for at in range(lo, hi, 512):
                to = min(hi, at + 512)
                s = x[at:to] @ ready[1].T
                slack = 1e-9 * (1 + np.abs(s).max())
                s[ids[at:to, None] == ready[0][None]] = -np.inf
                low = floors[at:to]
                if len(firsts) > k:
                    low = np.maximum(low, np.partition(s[:, firsts] if len(firsts) < len(ready[0]) else s, -k, axis=1)[:, -k])
                i, j = np.nonzero((s >= (low - slack)[:, None]) & (s > -np.inf))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + i]), pa.array(ready[0][j]), pa.array(products(x[at + i], ready[1][j]))], names=["query_id", "vec_id", "score"])


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
