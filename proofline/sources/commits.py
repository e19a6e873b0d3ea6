"""Several tables replaced at once: a manifest, written last, says which files are the current ones.

Each commit writes its tables into folders of their own and then appends one file to
``<root>/commits``, with a row for each table of the new state: those written and, under
their earlier folders, those that stay. Readers take the rows of one version, so they see
all of a commit or nothing of it, and keep seeing it whatever is committed later. A run that
ends between its tables leaves folders that no manifest names, and the state as it was.

One writer at a time; a commit that finds its number taken by another raises an error. Old
folders stay until :func:`unnamed` lists them for removal.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "version long, name string, path string, run string"


class Conflict(Exception):
    """Another run has committed under the same number."""


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``version, name, path, run``: all commits so far."""
    try:
        return spark.read.schema(_COMMIT).parquet(f"{root}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMIT)


def latest(spark: SparkSession, root: str) -> int:
    """The current version, 0 before the first commit."""
    return manifest(spark, root).agg(F.max("version")).first()[0] or 0


def _named(spark: SparkSession, root: str, version: int) -> dict[str, str]:
    return {r["name"]: r["path"] for r in manifest(spark, root).where(F.col("version") == version).collect()}  # a row a table


def read_tables(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version, the current one if not given."""
    return {name: spark.read.parquet(path) for name, path in _named(spark, root, latest(spark, root) if version is None else version).items()}


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], partition: str | None = "project_id", run: str | None = None) -> int:
    """Replace ``tables`` together, keep the others, and return the new version; ``run`` is the name to be found in the manifest."""
    own, before = uuid.uuid4().hex, latest(spark, root)
    run = run or own
    state = _named(spark, root, before)
    for name, df in tables.items():
        state[name] = f"{root}/tables/{name}/{before + 1}-{own}"
        out = df.write
        (out.partitionBy(partition) if partition and partition in df.columns else out).parquet(state[name])
    rows = [(before + 1, name, path, run) for name, path in state.items()]
    spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    runs = manifest(spark, root).where(F.col("version") == before + 1).agg(F.min("run").alias("first"), F.max("run").alias("last")).first()
    if runs["first"] != runs["last"]:
        raise Conflict(f"version {before + 1} of {root} was committed by several runs")
    return before + 1


def unnamed(spark: SparkSession, root: str, keep: int = 1) -> DataFrame:
    """``path``: folders that none of the last ``keep`` versions names, of this and of broken runs alike."""
    known = manifest(spark, root).where(F.col("version") > latest(spark, root) - keep).select("path").distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/tables").select("path")
    folder = F.regexp_extract("path", "(/tables/[^/]+/[^/]+)/", 1)
    found = files.select(folder.alias("folder"), F.regexp_extract("path", "^(.*/tables/[^/]+/[^/]+)/", 1).alias("path")).distinct()
    return found.join(known.select(F.regexp_extract("path", "(/tables/[^/]+/[^/]+)$", 1).alias("folder")), "folder", "left_anti").select("path")
