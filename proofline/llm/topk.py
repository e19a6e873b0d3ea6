"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks of bounded size, each of which one task indexes once. A
block's index has, for each component, posting segments of vectors with equal quantised
impact (bits of the component's magnitude). For a query, segments are processed by
descending impact (segment magnitude times the query's component) and scores accumulate in
one array. What a vector may still gain or lose is bounded by the sum, over components, of
the query's magnitude times the largest impact not yet processed. Processing stops only
when that bound proves that few vectors can still be members; those are rescored exactly.

Queries travel to the blocks in packs and pass through one after another; vectors move
once, whatever the number of queries. A block gives k rows a query, and the best k of all
blocks are kept.

Edge cases: vectors that are null, empty or hold a null or non-finite component, and
rows without id, take no part; repeated rows (equal id and vector) count once; rows that
share the query's id are its own; vectors of another length than the query's are no
candidates; ties go to the smaller id; with fewer candidates than k all are returned. Huge
finite components are taken exactly too: where scores may leave the range in which sums of
doubles are exact, every vector of the block is scored with whole numbers of any size. A
score beyond the range of long is shown as the nearest long and ranked as the nearest double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, LEAST_BLOCK, PACK = 65_536, 2_048, 256
SCALE = 1024
RESCORE = 64  # vectors left in doubt at which a proof is good enough to rescore
STEP = 48  # segments processed between two looks at the proof
EXACT = 2.0**52
_MOST = 1.7976931348623157e308


def quantised(embedding: str | Column) -> Column:
    """Components as floor(1024 * x), as doubles, or null where the vector takes no part."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    e = F.transform(e, lambda x: x.cast("double"))
    whole = F.coalesce(F.size(e) > 0, F.lit(False)) & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    # doubles from 2^53 on are whole numbers anyway
    times = lambda x: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), x * SCALE))
    return F.when(whole, F.transform(e, lambda x: F.when(F.abs(x) < 2.0**43, F.floor(x * SCALE).cast("double")).otherwise(times(x))))


class Index:
    """Posting segments of one block: by component and quantised impact."""

    def __init__(self, vectors: np.ndarray):
        self.huge = vectors
        with np.errstate(over="ignore"):
            self.largest = float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        self.vectors = vectors = np.where(np.abs(vectors) < EXACT, vectors, 0).astype(np.int64)
        n, dims = vectors.shape
        size = np.abs(vectors)
        # two levels for each doubling of the magnitude
        level = np.where(size > 0, np.floor(2 * np.log2(np.maximum(size, 1))).astype(np.int64) + 1, 0)
        self.ids, self.dim, self.most, self.at = [], [], [], [0]
        order = np.argsort(-level, axis=0, kind="stable")
        for d in range(dims):
            o = order[:, d]
            cuts = np.flatnonzero(np.diff(level[o, d])) + 1
            for part in np.split(o, cuts):
                if level[part[0], d] == 0:
                    continue  # zeros add nothing
                self.ids.append(part)
                self.dim.append(d)
                self.most.append(size[part, d].max())
                self.at.append(self.at[-1] + len(part))
        self.dim, self.most = np.array(self.dim, int), np.array(self.most, np.int64)
        self.all_ids = np.concatenate(self.ids) if self.ids else np.zeros(0, int)
        self.values = vectors[self.all_ids, np.repeat(self.dim, np.diff(self.at))] if self.ids else np.zeros(0, np.int64)

    def top(self, q: np.ndarray, keys: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows whose key is not ``own``."""
        n = len(self.vectors)
        other = keys != own
        with np.errstate(over="ignore"):
            huge = self.largest * float(np.abs(q).max(initial=0)) >= EXACT
        if huge:
            at = np.flatnonzero(other)
            scores = [sum(int(x) * int(y) for x, y in zip(row, q, strict=True)) for row in self.huge[at].tolist()]
            best = sorted(range(len(at)), key=lambda i: (-scores[i], keys[at[i]]))[:k]
            return at[best], np.array([scores[i] for i in best], object)
        q = q.astype(np.int64)
        impact = self.most * np.abs(q[self.dim])
        order = np.argsort(-impact, kind="stable")
        # bound left in each component after its first s segments: the next segment's impact
        acc = np.zeros(n, np.float64)
        left = np.zeros(len(q))
        np.maximum.at(left, self.dim, impact.astype(float))
        doubt = np.flatnonzero(other)
        if len(doubt) > k:
            for lo in range(0, len(order), STEP):
                part = order[lo : lo + STEP]
                ids = np.concatenate([self.ids[s] for s in part])
                val = np.concatenate([self.values[self.at[s] : self.at[s + 1]] for s in part])
                w = np.repeat(q[self.dim[part]], [len(self.ids[s]) for s in part])
                acc += np.bincount(ids, (val * w).astype(float), n)
                left[:] = 0
                rest = order[lo + STEP :]
                np.maximum.at(left, self.dim[rest], impact[rest].astype(float))
                bound = left.sum()
                mine = acc[doubt]
                least = np.partition(mine, len(mine) - k)[len(mine) - k] - bound
                doubt = doubt[mine + bound >= least]
                if len(doubt) <= max(RESCORE, k):
                    break
        exact = self.vectors[doubt] @ q
        best = np.lexsort((keys[doubt], -exact))[:k]
        return doubt[best], exact[best]


_ROW = "block long, kind int, dims int, id long, pack array<struct<id:long,row:long>>, q array<double>"
_FOUND = "query_id long, query_row long, vec_id long, rank int, high double, score long"


def _search(rows: DataFrame, k: int) -> DataFrame:
    """``_FOUND``: the ``k`` best of each block for every query of the packs sent to it.

    Rows come by block and length, vectors before packs of queries.
    """

    def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
        return batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def answer(index: Index, keys: np.ndarray, batch: pa.RecordBatch, dims: int):
        out = []
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            asks = one.column("pack")[0].as_py()
            for ask, q in zip(asks, matrix(one, dims), strict=True):
                at, score = index.top(q, keys, ask["id"], k)
                if len(at):
                    out.append((np.full(len(at), ask["id"]), np.full(len(at), ask["row"]), keys[at], np.arange(1, len(at) + 1), score))
        if out:
            qid, row, vid, rank, score = (np.concatenate([x[i] for x in out]) for i in range(5))
            shown, high = score, score
            if score.dtype == object:
                shown = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in score], np.int64)
                high = np.array([float(max(-int(_MOST), min(int(_MOST), int(x)))) for x in score])
            yield pa.record_batch(
                [pa.array(qid), pa.array(row), pa.array(vid), pa.array(rank.astype(np.int32)), pa.array(high.astype(float)), pa.array(shown.astype(np.int64))],
                names=["query_id", "query_row", "vec_id", "rank", "high", "score"],
            )

    def run(batches):
        name, held, index, keys = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, dims, kind = (batch.column(c).to_numpy() for c in ("block", "dims", "kind"))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (dims[1:] != dims[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if name != (block[lo], dims[lo]):
                    name, held, index = (block[lo], dims[lo]), [], None
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append((part.column("id").to_numpy(), matrix(part, int(dims[lo]))))
                elif held:
                    if index is None:
                        keys = np.concatenate([x for x, _ in held])
                        index = Index(np.concatenate([x for _, x in held]))
                    yield from answer(index, keys, part, int(dims[lo]))

    return rows.mapInArrow(run, _FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best of ``vectors``, its own id excepted.

    Both tables have ``vec_id`` and ``embedding``.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), quantised("embedding").alias("q")).where("id is not null and q is not null").distinct()
    a = queries.select(F.col("vec_id").cast("long").alias("id"), quantised("embedding").alias("q")).where("id is not null and q is not null").distinct()
    n, asks = v.count(), a.count()
    blocks = max(1, -(-n // block), min(-(-n // LEAST_BLOCK), 4 * spark.sparkContext.defaultParallelism))
    packs = max(1, -(-asks // pack))
    dealt = v.select(F.pmod(F.xxhash64("id", "q"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), F.size("q").alias("dims"), "id", F.lit(None).cast("array<struct<id:long,row:long>>").alias("pack"), "q")
    grouped = (
        a.withColumn("dims", F.size("q"))
        .groupBy(F.pmod(F.xxhash64("id", "q"), F.lit(packs)).alias("p"), "dims")
        .agg(F.collect_list(F.struct("id", F.xxhash64("q").alias("row"), "q")).alias("asks"))
    )  # at most a pack of queries, give or take
    sent = grouped.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), "dims", F.lit(None).cast("long").alias("id"),
        F.transform("asks", lambda x: F.struct(x["id"].alias("id"), x["row"].alias("row"))).alias("pack"), F.flatten(F.transform("asks", lambda x: x["q"])).alias("q"),
    )
    rows = dealt.union(sent).repartition(blocks, "block").sortWithinPartitions("block", "dims", "kind", "id")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("high"), F.desc("score"), "vec_id")
    return _search(rows, k).withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
