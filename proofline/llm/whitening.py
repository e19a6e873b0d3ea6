"""Whitening of embeddings by the leading eigenvectors of their covariance (Jacobi-Davidson).

The covariance is never formed. Spark multiplies it with a thin block of vectors: a task
centres its rows and adds up ``y (y . w)``, and the tasks' blocks, of dimensions x width
numbers each, are summed before the driver sees one. The driver keeps a search space of at
most ``SPACE`` blocks and does, until every residual has reached double precision:

* Rayleigh-Ritz in the search space; pairs that have converged are locked;
* for each open pair, the correction equation ``(I-QQ')(A-tI)(I-QQ') z = -r``, Q the locked
  and wanted Ritz vectors, solved by a few steps of MINRES, all pairs in lock-step, so that
  one pass over the rows serves them all;
* the corrections, made orthogonal to the search space, widen it; a full space restarts
  from its best Ritz vectors.

Rows are centred exactly: ``n * x - S`` is a whole number, divided by n only then.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries are
dropped; so are vectors of another length than the most frequent one (ties: the shorter).
A row without id is kept, under a null id; repeated rows count each. Components beyond the
dimension or of no variance (an eigenvalue below rounding) cannot be whitened and are not
returned; so one row alone, or equal rows, give no rows, as does an empty table. Entries
beyond the range of long are taken as the nearest long; a deviation beyond it is null.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

COMPONENTS = 8
SPACE = 5  # blocks of the search space before a restart
INNER = 8  # most steps of MINRES for one correction
ROUNDS = 200
SCALE, SHIFT = 1024, 100_000
EPS = float(np.finfo(float).eps)

_ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def whole(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: the vectors that take part, as whole numbers of one length."""
    e = F.transform("embedding", lambda c: c.cast("double"))
    good = F.coalesce((F.size(e) > 0) & F.forall(e, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)), F.lit(False))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda c: F.floor(c * SCALE)).alias("x"))
    # the shift, too, must stay within long
    rows = rows.select("vec_id", F.transform("x", lambda c: F.least(c, F.lit(2**63 - 1 - SHIFT)) + SHIFT).alias("x"))
    length = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows if length is None else rows.where(F.size("x") == length["size"])


class Centred:
    """The fit list: its rows in Spark, its size and sums; multiplies its covariance with blocks of vectors."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

        def run(batches):
            n, parts = 0, None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    part = (x >> 32).sum(axis=0), (x & (2**32 - 1)).sum(axis=0), np.abs(x.astype(float)).max(axis=0)
                    n += batch.num_rows
                    parts = part if parts is None else (parts[0] + part[0], parts[1] + part[1], np.maximum(parts[2], part[2]))
            if n:
                high, low, most = (pa.array(v) for v in parts)
                yield pa.record_batch([pa.array(np.arange(len(high), dtype=np.int32)), pa.array(np.full(len(high), n)), high, low, most], names=["d", "n", "high", "low", "most"])

        sums = rows.select("x").mapInArrow(run, "d int, n long, high long, low long, most double").groupBy("d").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")), F.max("most").alias("most"))
        found = sorted(sums.collect(), key=lambda r: r["d"])  # one row a dimension
        self.n = found[0]["n"] if found else 0
        self.sums = [(r["high"] << 32) + r["low"] for r in found]
        # whole numbers of 64 bits hold n * x - S
        self.narrow = self.n * max((r["most"] for r in found), default=0) < 2.0**61

    @property
    def dims(self) -> int:
        return len(self.sums)

    def differences(self):
        """Function: batch -> rows of n * x - S, exact."""
        n, sums, narrow, dims = self.n, self.sums, self.narrow, self.dims

        def of(batch: pa.RecordBatch) -> np.ndarray:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            return n * x - np.array(sums, np.int64) if narrow else n * x.astype(object) - np.array(sums, object)

        return of

    def times(self, block: np.ndarray) -> np.ndarray:
        """Covariance times a block of columns: one pass over the rows."""
        of, n, shape = self.differences(), self.n, block.shape

        def run(batches):
            total = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    y = (of(batch) / n).astype(float)
                    total += y.T @ (y @ block)
            yield pa.record_batch([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part"])

        parts = self.rows.select("x").mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "part"))
        out = np.zeros(block.size)
        for r in parts.groupBy("at").agg(F.sum("part")).collect():  # one row an entry of the block
            out[r[0]] = r[1]
        return out.reshape(shape) / n

    def trace(self) -> float:
        """Sum of the variances."""
        of, n = self.differences(), self.n

        def run(batches):
            yield pa.record_batch([pa.array([float(sum((((of(b) / n).astype(float)) ** 2).sum() for b in batches if b.num_rows))])], names=["part"])

        return self.rows.select("x").mapInArrow(run, "part double").agg(F.sum("part")).first()[0] / n


def minres(times, right: np.ndarray, shift: np.ndarray, away: np.ndarray, steps: int, least: float) -> np.ndarray:
    """Columns z with (I-QQ')(A - shift I)(I-QQ') z close to ``right``: one Lanczos recurrence a column, in lock-step."""

    def project(b: np.ndarray) -> np.ndarray:
        b = b - away @ (away.T @ b)
        return b - away @ (away.T @ b)

    v = project(right)
    beta = np.linalg.norm(v, axis=0)
    start, z = beta.copy(), np.zeros_like(right)
    v_old, w, w_old = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    v = v / np.where(beta > 0, beta, 1)
    left, c, c_old, s, s_old, link = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    open_ = beta > 0
    for _ in range(steps):
        if not open_.any():
            break
        new = np.zeros_like(v)
        new[:, open_] = times(v[:, open_])
        new = project(new - shift * v)
        alpha = (v * new).sum(axis=0)
        new -= alpha * v + link * v_old
        beta = np.linalg.norm(new, axis=0)
        # two rotations of before, then a new one, on the column (link, alpha, beta)
        third, second = s_old * link, c * c_old * link + s * alpha
        first = c * alpha - c_old * s * link
        size = np.hypot(first, beta)
        size = np.where(size > 0, size, 1)
        c_old, s_old, c, s = c, s, first / size, beta / size
        w_old, w = w, (v - second * w - third * w_old) / size
        z = np.where(open_, z + c * left * w, z)
        left = np.where(open_, -s * left, left)
        open_ = open_ & (np.abs(left) > least * start) & (beta > EPS * np.abs(shift))
        v_old, v, link = v, new / np.where(beta > 0, beta, 1), beta
    return z


def leading(times, dims: int, k: int, *, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric operator, their vectors (columns) and residuals' norms."""
    k = min(k, dims)
    most, keep = min(dims, SPACE * 2 * k), min(dims, 2 * k)
    space = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, keep)))[0]
    image = times(space)
    best, stalled = np.inf, 0
    for _ in range(ROUNDS):
        small = space.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        ritz, left = space @ turn[:, :k], image @ turn[:, :k] - (space @ turn[:, :k]) * value[:k]
        norm = np.linalg.norm(left, axis=0)
        worst = norm.max() / max(value[0], np.finfo(float).tiny)
        locked = norm <= 16 * EPS * value[0]
        best, stalled = (worst, 0) if worst < best / 2 else (best, stalled + 1)
        # where rounding in the passes keeps a residual above the bound, it has stopped falling
        if locked.all() or space.shape[1] == dims or (stalled >= 3 and worst < 1e-12):
            fresh = times(ritz)
            value = (ritz * fresh).sum(axis=0)
            order = np.argsort(-value, kind="stable")
            residual = np.linalg.norm(fresh - ritz * value, axis=0)
            return value[order], ritz[:, order], residual[order]
        open_ = np.flatnonzero(~locked)
        # the closer a pair, the more exactly its correction is wanted
        more = minres(times, -left[:, open_], value[open_], ritz, INNER, 0.05)
        if space.shape[1] + len(open_) > most:
            space, image = space @ turn[:, :keep], image @ turn[:, :keep]
        for _ in range(2):
            more -= space @ (space.T @ more)
            more = np.linalg.qr(more)[0]
        more = more[:, : dims - space.shape[1]]
        space, image = np.hstack([space, more]), np.hstack([image, times(more)])
    raise RuntimeError(f"residuals did not reach double precision: {worst:g} of the largest eigenvalue after {ROUNDS} rounds")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, residual`` of each row and component.

    ``vectors`` has ``vec_id`` and ``embedding``; ``residual`` is the eigenpair's, over the
    largest eigenvalue.
    """
    spark = vectors.sparkSession
    fit = Centred(materialize(whole(vectors), "whitening"))
    none = spark.createDataFrame([], _ROW)
    trace = fit.trace() if fit.n else 0.0
    if not trace > 0:
        return none
    value, vector, residual = leading(fit.times, fit.dims, components)
    good = value > fit.dims * EPS * value[0]
    value, vector, residual = value[good], vector[:, good], residual[good] / value[0]
    turn = vector / np.sqrt(value)
    error = float(np.abs(turn.T @ fit.times(turn) - np.eye(len(value))).max())
    of, n, k, share = fit.differences(), fit.n, len(value), value / trace

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            d = of(batch)
            far = np.abs(d).max() >= 2.0**31 / np.sqrt(d.shape[1])
            total = [t if t < 2**63 else None for t in ((d.astype(object) if far else d) ** 2).sum(axis=1).tolist()]
            at = np.repeat(np.arange(len(d)), k)
            columns = {
                "vec_id": batch.column("vec_id").take(pa.array(at)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(d))),
                "n": pa.array(np.full(len(at), n)),
                "deviation": pa.array(total, pa.int64()).take(pa.array(at)),
                "whitened": pa.array(((d / n).astype(float) @ turn).ravel()),
                "explained": pa.array(np.tile(share, len(d))),
                "identity_error": pa.array(np.full(len(at), error)),
                "residual": pa.array(np.tile(residual, len(d))),
            }
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return fit.rows.mapInArrow(run, _ROW)
