"""Project statistics kept up to date by changes instead of recounts.

A batch names, for each table, rows that now stand (``sign`` 1) and rows that no longer do
(``sign`` -1); an edit is one of each. Its counts, summed by project, are added to the stored
ones, so a batch costs what it holds, whatever the tables' sizes. Batches have names: one
that has been applied before changes nothing, and one that breaks off leaves the state as it
was (see :mod:`..sources.commits`), so a batch may be sent again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources import commits

COUNTS = ("total", *(s.lower() for s in fixed.STATUSES), "documents", "chunks", "findings")
_TABLE = "project_stats"


def changes(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """``columns, sign`` of the rows that an edit takes away and puts in their place."""
    return old.select(*columns, F.lit(-1).alias("sign")).unionByName(new.select(*columns, F.lit(1).alias("sign")))


def delta(batch: dict[str, DataFrame]) -> DataFrame:
    """``project_id`` and what a batch adds to each of ``COUNTS``.

    ``batch`` has any of requirements (project_id, coverage_status, sign), documents, chunks
    and findings (project_id, sign); a chunk's project is its document's.
    """
    n = F.col("sign").cast("long")
    parts = []
    for name, rows in batch.items():
        if name == "requirements":
            counted = {"total": n} | {s.lower(): F.when(F.col("coverage_status") == s, n).otherwise(0) for s in fixed.STATUSES}
        else:
            counted = {name: n}
        parts.append(rows.select("project_id", *[F.coalesce(counted[c], F.lit(0)).cast("long").alias(c) if c in counted else F.lit(0).cast("long").alias(c) for c in COUNTS]))
    return _summed(reduce(DataFrame.unionByName, parts))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def apply_batch(spark: SparkSession, root: str, name: str, batch: dict[str, DataFrame]) -> bool:
    """Add a batch to the stored statistics under ``root``; False if it had been applied before."""
    if commits.manifest(spark, root).where(F.col("run") == name).limit(1).count():
        return False
    stored = commits.read_tables(spark, root).get(_TABLE)
    more = delta(batch)
    commits.commit(spark, root, {_TABLE: more if stored is None else _summed(stored.unionByName(more))}, partition=None, run=name)
    return True


def stored_stats(spark: SparkSession, root: str, projects: DataFrame, version: int | None = None) -> DataFrame:
    """The same table as :func:`.outputs.project_stats`, from the stored counts of a version."""
    stored = commits.read_tables(spark, root, version).get(_TABLE)
    out = projects.select("project_id")
    out = out.join(stored, "project_id", "left") if stored is not None else out.select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    out = out.na.fill(0)
    return out.withColumn("coverage", F.when(F.col("total") > 0, F.bround(100.0 * F.col("supported") / F.col("total"))).otherwise(0.0).cast("int"))
