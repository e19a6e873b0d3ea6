"""Approximate nearest neighbours: a forest of random-projection trees with one queue for all trees.

Trees. Each level of each tree has one random direction; a node splits at the median of its
rows' projections, taken on a bounded sample (``FIT_ROWS``). Vectors are first made equally
long by one more component, so that the largest inner product is the smallest distance.
All rows are filed in one leaf of each tree; copies of a vector are filed once, and come back
with all the ids that can still be among the nearest.

Search. A query walks all trees through one priority queue. A branch that it leaves aside
is queued under the squared distance to all the splits it lies beyond; leaves come off the
queue nearest first, whatever their tree. After ``budget`` leaves it stops. The (query, leaf)
rows meet the leaf's vectors in Spark, where the best of each leaf are scored exactly in
double precision, and the best of all leaves are kept. The first leaves go ahead: their k-th
score is a bound under which later leaves send nothing.

The budget is measured, not guessed: for a bounded sample of queries (``TRIALS``) the true
nearest are found by one pass over all rows, and the budget is the least number of leaves
that finds the share ``RECALL`` of them. Where vectors form groups that is a few leaves;
among vectors without any order (independent random ones) it is most of the forest, as no
index knows where to look.

Leaves of more than ``PIECE`` vectors are cut into pieces by a hash of the id, which every
visit reads, so a task holds a bounded number of vectors.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component, and
rows without id, take no part; repeated rows count once; of rows with one id and unequal
vectors the smallest vector counts; vectors of each length are searched among themselves;
with fewer candidates than k all that the visited leaves hold are returned, and the budget
is then all leaves; ties go to the smaller id. Inner products beyond the range of double are
infinite, undefined ones rank last. Other columns, whatever their names, are not looked at;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_sample, materialize

TREES, LEAF, PIECE = 4, 2_048, 8_192
MOST_DEPTH = 12
FIT_ROWS, TRIALS = 65_536, 256
RECALL = 0.95
STRIP = 256  # queries multiplied with a piece at once

_FOUND = "query long, id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """``id, e``: the vectors that take part, one for each id."""
    e = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(e, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    good = F.coalesce(finite & F.exists(e, lambda c: c != 0), F.lit(False))
    rows = vectors.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), e.alias("e"))
    return rows.groupBy("id").agg(F.min("e").alias("e"))


def _dots(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Inner products, each summed alike whatever rows stand beside it."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = (rows * one).sum(axis=1)
    return np.where(np.isnan(found), -np.inf, found)


def _best(rows: np.ndarray, ids: np.ndarray, one: np.ndarray, rough: np.ndarray, slack: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and exact scores of the k best; ``rough`` scores are off by less than ``slack``."""
    at = np.arange(len(rows))
    if len(rows) > k and np.isfinite(slack):
        at = np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 2 * slack)
    score = _dots(rows[at], one)
    order = np.lexsort((ids[at], -score))[:k]
    return at[order], score[order]


def _rough(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    with np.errstate(over="ignore", invalid="ignore"):
        product = queries @ rows.T
        slack = 1e-15 * rows.shape[1] * np.linalg.norm(queries, axis=1).max(initial=0) * np.linalg.norm(rows, axis=1).max(initial=0)
    return product, slack if np.isfinite(product).all() else np.inf


def _matrix(batch: pa.RecordBatch, dims: int, name: str = "e") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Forest:
    """Directions and split points of all trees: ``TREES * 2 ** depth`` numbers, bounded."""

    def __init__(self, dims: int, depth: int, longest: float, trees: int = TREES, seed: int = 11):
        self.dims, self.depth, self.longest, self.trees = dims, depth, longest, trees
        turn = np.random.default_rng(seed).normal(size=(trees, dims + 1, depth))
        self.turn = turn / np.linalg.norm(turn, axis=1, keepdims=True)
        self.splits = np.zeros((trees, (1 << depth) - 1))

    def project(self, rows: np.ndarray, *, stored: bool) -> np.ndarray:
        """trees x rows x depth projections; only stored rows are made equally long."""
        scaled = rows / self.longest if np.isfinite(self.longest) else np.zeros_like(rows)
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1))) if stored else np.zeros(len(rows))
        return np.einsum("nd,tdl->tnl", np.column_stack([scaled, rest]), self.turn)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf of each row, numbered over all trees."""
        p = self.project(rows, stored=True)
        tree = np.arange(self.trees)[:, None]
        node = np.zeros(p.shape[:2], np.int64)
        for level in range(self.depth):
            node = 2 * node + (p[:, :, level] > self.splits[tree, (1 << level) - 1 + node])
        return (node + (tree << self.depth)).T

    @staticmethod
    def fit(projections: np.ndarray, depth: int) -> np.ndarray:
        """Split points of one tree: medians, level by level."""
        splits, node = np.zeros((1 << depth) - 1), np.zeros(len(projections), np.int64)
        for level in range(depth):
            order = np.lexsort((projections[:, level], node))
            first, last = np.searchsorted(node[order], np.arange(1 << level)), np.searchsorted(node[order], np.arange(1 << level), "right")
            value = projections[order, level]
            filled = last > first
            middle = np.where(filled, (first + last - 1) // 2, 0)
            splits[(1 << level) - 1 : (2 << level) - 1] = np.where(filled, value[middle], 0)
            node = 2 * node + (projections[:, level] > splits[(1 << level) - 1 + node])
        return splits

    def nearest_leaves(self, queries: np.ndarray):
        """For each query, an iterator over all leaves of all trees, nearest first."""
        projections, splits = self.project(queries, stored=False), self.splits.tolist()
        for row in range(len(queries)):
            yield self._walk(projections[:, row, :].tolist(), splits)

    def _walk(self, mine: list, splits: list):
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        while queue:
            far, t, level, node = heapq.heappop(queue)
            for at in range(level, self.depth):
                beyond = mine[t][at] - splits[t][(1 << at) - 1 + node]
                near = beyond > 0
                heapq.heappush(queue, (far + beyond * beyond, t, at + 1, 2 * node + (not near)))
                node = 2 * node + near
            yield (t << self.depth) + node


def plant(vectors: DataFrame, n: int, dims: int, *, leaf: int = LEAF, trees: int = TREES) -> Forest:
    """A forest fitted to a bounded sample of ``id, e``; each tree is fitted by its own task."""
    squares = F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)
    longest = vectors.agg(F.max(F.sqrt(squares))).first()[0] or 1.0
    depth = min(MOST_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / leaf))))))
    forest = Forest(dims, depth, longest, trees)
    if depth:
        sample = bounded_sample(vectors, "id", FIT_ROWS).select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "e")

        def run(batches):
            held = {}
            for batch in batches:
                tree, p = batch.column("tree").to_numpy(), None
                for t in np.unique(tree).tolist():
                    p = forest.project(_matrix(batch, dims)[tree == t], stored=True)[t]
                    held.setdefault(t, []).append(p)
            for t, parts in held.items():
                yield pa.record_batch([pa.array([t], pa.int32()), pa.array([Forest.fit(np.concatenate(parts), depth)], pa.list_(pa.float64()))], names=["tree", "splits"])

        for r in sample.repartition(trees, "tree").mapInArrow(run, "tree int, splits array<double>").collect():
            forest.splits[r["tree"]] = r["splits"]
    return forest


def budget(forest: Forest, vectors: DataFrame, asked: DataFrame, k: int, recall: float = RECALL) -> int:
    """Leaves to visit, so that a sample of the queries finds the share ``recall`` of its true nearest."""
    every = forest.trees << forest.depth
    if not forest.depth:
        return 1
    trial = asked.orderBy(F.xxhash64(F.lit("trial"), "query")).limit(TRIALS).collect()  # bounded
    q, dims = np.array([r["e"] for r in trial], float), forest.dims

    def scan(batches):
        for batch in batches:
            rows, ids = _matrix(batch, dims), batch.column("id").to_numpy()
            rough, slack = _rough(q, rows)
            for at in range(len(q)):
                best, score = _best(rows, ids, q[at], rough[at], slack, k + 1)
                own = (rows[best] == q[at]).all(axis=1)
                best, score = best[~own], score[~own]
                yield pa.record_batch([pa.array(np.full(len(best), at, np.int32)), pa.array(ids[best]), pa.array(score), pa.array(list(forest.leaves(rows[best])), pa.list_(pa.int64()))], names=["trial", "id", "score", "leaves"])

    best = Window.partitionBy("trial").orderBy(F.desc("score"), "id")
    scanned = vectors.mapInArrow(scan, "trial int, id long, score double, leaves array<long>")
    true = scanned.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy("trial").agg(F.flatten(F.collect_list("leaves")).alias("leaves"))

    def first(batches):
        for batch in batches:
            for at, leaves in zip(batch.column("trial").to_pylist(), batch.column("leaves").to_pylist(), strict=True):
                met = {leaf: n for n, leaf in enumerate(next(forest.nearest_leaves(q[at : at + 1])), 1)}
                found = [min(met[x] for x in leaves[i : i + forest.trees]) for i in range(0, len(leaves), forest.trees)]
                yield pa.record_batch([pa.array(found, pa.int64())], names=["visits"])

    need = true.mapInArrow(first, "visits long").agg(F.percentile("visits", recall)).first()[0]
    return every if need is None else min(every, int(np.ceil(need)))


def _scan(rows: DataFrame, dims: int, k: int) -> DataFrame:
    """``_FOUND``: the k best of each piece for every query that visits it, of ``least`` or more; pieces come before their visits."""

    def run(batches):
        name, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, piece, kind = (batch.column(c).to_numpy() for c in ("leaf", "piece", "kind"))
            cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (piece[1:] != piece[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(leaf)], strict=True):
                if name != (leaf[lo], piece[lo]):
                    name, held, block = (leaf[lo], piece[lo]), [], None
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append((part.column("id").to_numpy(), _matrix(part, dims)))
                elif held:
                    if block is None:
                        block = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    queries, number, least = _matrix(part, dims), part.column("id").to_numpy(), part.column("least").to_numpy()
                    for at in range(0, len(queries), STRIP):
                        rough, slack = _rough(queries[at : at + STRIP], block[1])
                        best = [_best(block[1], block[0], q, r, slack, k) for q, r in zip(queries[at : at + STRIP], rough, strict=True)]
                        best = [(x[s >= low], s[s >= low]) for (x, s), low in zip(best, least[at : at + STRIP], strict=True)]
                        found = np.concatenate([x for x, _ in best])
                        asked = np.repeat(number[at : at + STRIP], [len(x) for x, _ in best])
                        yield pa.record_batch([pa.array(asked), pa.array(block[0][found]), pa.array(np.concatenate([x for _, x in best]))], names=["query", "id", "score"])

    return rows.mapInArrow(run, _FOUND)


def _search(vectors: DataFrame, queries: DataFrame, dims: int, k: int, leaf: int, trees: int, recall: float) -> DataFrame:
    """Neighbours among ``id, e`` of one length."""
    at = Window.partitionBy("e").orderBy("id")
    # of equal vectors only the k + 1 smallest ids can be among any query's nearest, its own left out
    copies = vectors.withColumn("at", F.row_number().over(at)).where(F.col("at") <= k + 1).groupBy("e").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = materialize(copies.select(F.col("ids")[0].alias("id"), "ids", "e"), "forest-vectors")
    asked = materialize(queries.groupBy("e").agg(F.min("id").alias("query")), "forest-queries")
    n = distinct.count()
    forest = plant(distinct, n, dims, leaf=leaf, trees=trees)
    visits = budget(forest, distinct, asked, k, recall)

    def filed(pieces: np.ndarray) -> DataFrame:
        def run(batches):
            for batch in batches:
                leaf = forest.leaves(_matrix(batch, dims)).ravel()
                who = np.repeat(np.arange(batch.num_rows), trees)
                spread = (batch.column("id").to_numpy()[who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                piece = (spread % pieces[leaf].astype(np.uint64)).astype(np.int64)
                yield pa.record_batch([pa.array(leaf), pa.array(piece), batch.column("id").take(pa.array(who)), batch.column("e").take(pa.array(who))], names=["leaf", "piece", "id", "e"])

        return distinct.select("id", "e").mapInArrow(run, "leaf long, piece long, id long, e array<double>")

    pieces = np.ones(trees << forest.depth, np.int64)
    for r in filed(pieces).groupBy("leaf").count().collect():  # at most trees * 2 ** depth
        pieces[r["leaf"]] = -(-r["count"] // PIECE)

    def visit(asked: DataFrame, first: int, last: int) -> DataFrame:
        """The visits of ``query, e, least`` to the leaves that come off the queue as ``first`` to ``last``."""

        def run(batches):
            for batch in batches:
                leaf, piece, who = [], [], []
                for row, leaves in enumerate(forest.nearest_leaves(_matrix(batch, dims))):
                    for x in islice(leaves, first, last):
                        for p in range(pieces[x]):
                            leaf.append(x), piece.append(p), who.append(row)
                at = pa.array(who, pa.int64())
                columns = [pa.array(leaf, pa.int64()), pa.array(piece, pa.int64()), *(batch.column(c).take(at) for c in ("query", "e", "least"))]
                yield pa.record_batch(columns, names=["leaf", "piece", "id", "e", "least"])

        return asked.select("query", "e", "least").mapInArrow(run, "leaf long, piece long, id long, e array<double>, least double")

    stored = filed(pieces).select("leaf", "piece", F.lit(0).alias("kind"), "id", "e", F.lit(None).cast("double").alias("least"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")

    def found(visits: DataFrame) -> DataFrame:
        sent = visits.select("leaf", "piece", F.lit(1).alias("kind"), "id", "e", "least")
        rows = stored.union(sent).repartition(parts, "leaf", "piece").sortWithinPartitions("leaf", "piece", "kind", "id")
        once = _scan(rows, dims, k + 1).groupBy("query", "id").agg(F.first("score").alias("score"))  # one vector in leaves of several trees
        return once.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)

    # the first leaves give each query a score that its last neighbour reaches, so the others send what can still count alone
    near = materialize(found(visit(asked.withColumn("least", F.lit(float("-inf"))), 0, min(visits, trees))), "forest-near")
    if visits > trees:
        reached = near.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("least"))
        more = found(visit(asked.join(reached, "query", "left").fillna(float("-inf"), ["least"]), trees, visits))
        near = near.union(more).groupBy("query", "id").agg(F.first("score").alias("score")).withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    several = distinct.where(F.size("ids") > 1).select("id", "ids")
    near = near.join(several, "id", "left").select("query", "score", F.explode(F.coalesce("ids", F.array("id"))).alias("id"))
    near = near.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("near"))
    # every query that shares a vector takes the same list, without itself
    each = queries.join(asked, "e").select(F.col("id").alias("query_id"), "query").join(lists, "query")
    mine = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(mine).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, *, leaf: int = LEAF, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest found among ``vectors``, its own id excepted.

    Both tables have ``vec_id`` and ``embedding``.
    """
    v = materialize(usable(vectors), "forest-usable")
    q = materialize(usable(queries), "forest-asked")
    out = None
    for r in q.groupBy(F.size("e").alias("dims")).count().collect():  # one row a length
        mine = F.size("e") == r["dims"]
        found = _search(v.where(mine), q.where(mine), r["dims"], k, leaf, trees, recall)
        out = found if out is None else out.union(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
