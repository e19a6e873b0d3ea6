"""Incremental ingest and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unparsed(documents: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents without chunks yet."""
    return documents.join(chunks.select(key).distinct(), key, "left_anti")


def incremental_chunks(documents: DataFrame, chunks: DataFrame, chunker, key: str = "document_id") -> DataFrame:
    """Existing chunks, and those that ``chunker`` makes of documents without any."""
    return chunks.unionByName(chunker(unparsed(documents, chunks, key)).select(*chunks.columns))


def document_status(documents: DataFrame, chunks: DataFrame, failed: DataFrame | None = None, key: str = "document_id") -> DataFrame:
    """``documents`` with page_count (its number of chunks) and processing_status."""
    counts = chunks.groupBy(key).agg(F.count("*").cast("int").alias("page_count"))
    out = documents.drop("page_count", "processing_status").join(counts, key, "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))
    if failed is not None:
        out = out.join(failed.select(key, F.lit(True).alias("_failed")).distinct(), key, "left")
    else:
        out = out.withColumn("_failed", F.lit(None).cast("boolean"))
    status = F.when(F.col("_failed"), "Error").when(F.col("page_count") > 0, "Indexed").otherwise("Queued")
    return out.withColumn("processing_status", status).drop("_failed")


def replace_projects(df: DataFrame, path: str) -> None:
    """Write ``df`` over the partitions of its own projects; other projects stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the rows of keys that ``new`` has, and ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest_edits(edits: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last edit of each key. Aggregated before the shuffle: no window over hot keys."""
    value = F.struct(*[c for c in edits.columns if c != key])
    return edits.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("_e")).select(key, "_e.*")


def patch(table: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``table`` with the fields that an edit sets. ``has_<field>`` tells set from absent; null can be set."""
    e = edits.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields], *[F.col(f"has_{f}").alias(f"_has_{f}") for f in fields])
    out = table.join(e, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.coalesce(f"_has_{f}", F.lit(False)), F.col(f"_new_{f}")).otherwise(F.col(f)))
    return out.select(*table.columns)


def cascade_delete(parents: DataFrame, children: dict[str, tuple[DataFrame, str, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables without the deleted parents and what hangs on them.

    ``children``: name -> (table, its own key, its column naming the parent's key); each
    table's deleted keys are passed on to the next, so a chain goes from top to bottom.
    """
    out = {"parents": parents.join(gone.select(key), key, "left_anti")}
    lost = gone.select(F.col(key).alias("_gone"))
    for name, (table, own, parent) in children.items():
        out[name] = table.join(lost, table[parent] == lost["_gone"], "left_anti")
        lost = table.join(lost, table[parent] == lost["_gone"], "left_semi").select(F.col(own).alias("_gone"))
    return out


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Null fields filled with their defaults; absent columns added."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(value)) if name in rows.columns else F.lit(value))
    return rows


def audit_id(key: Column, year: Column) -> Column:
    """``TA-{year}-{4 hex digits}``, a function of the key: equal input, equal id."""
    return F.concat(F.lit("TA-"), year.cast("string"), F.lit("-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 4)))


def checked_lengths(rows: DataFrame, limits: dict[str, tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Rows whose text fields keep their length limits, and the rest with the first field at fault."""
    fault = F.coalesce(*[F.when(~F.length(F.coalesce(c, F.lit(""))).between(lo, hi), F.lit(c)) for c, (lo, hi) in limits.items()])
    marked = rows.withColumn("fault", fault)
    return marked.where("fault is null").drop("fault"), marked.where("fault is not null")


def linked_counts(documents: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """``document_id, requirements_linked``: links whose chunk belongs to the document, 0 if none."""
    n = links.join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy("document_id").agg(F.count("*").alias("n"))
    return documents.select("document_id").join(n, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("requirements_linked"))


def newest_first(df: DataFrame, time: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(time), key)


def recent(df: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows: a top-n, not a full sort."""
    return newest_first(df, time, key).limit(n)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
