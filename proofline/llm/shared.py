"""Small helpers that several operators use: shared storage and held-out splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_dir

__all__ = ["bounded_sample", "fold", "materialize", "shared_dir"]


def fold(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def bounded_sample(df: DataFrame, key: str, rows: int, *, group: Column | None = None) -> DataFrame:
    """About ``rows`` rows of ``df`` (of each ``group``, if given), picked by a hash of ``key``.

    The share kept is ``rows`` over the counted rows, so the expected size is bounded
    however large the input; no shuffle of the rows themselves is needed.
    """
    slot = F.pmod(F.xxhash64(F.lit("bounded sample"), F.col(key)), F.lit(1 << 30))
    if group is None:
        n = df.count()
        return df if n <= rows else df.where(slot < int((1 << 30) * rows / n))
    counts = {r[0]: r[1] for r in df.groupBy(group.alias("g")).count().collect()}
    keep = F.lit(False)
    for g, n in counts.items():
        keep = keep | (group.eqNullSafe(F.lit(g)) & (slot < (1 << 30 if n <= rows else int((1 << 30) * rows / n))))
    return df.where(keep)
