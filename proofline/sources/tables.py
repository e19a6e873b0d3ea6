"""Sources and sinks of an audit: tables as text chunks, file registration, results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import contains_any
from .shared import materialize

GROUND_TRUTH = {
    "requirements": "requirement_id string, req_code string, title string, description string, category string, severity string, expected_status string, expected_review_state string",
    "evidence_links": "requirement_id string, req_code string, document string, page int, relationship string, quote string",
    "expected_findings": "finding_code string, requirement_id string, req_code string, expected_status string, finding_type string, severity string, category string, "
    "expected_evidence array<struct<document:string,page:int>>",
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; all columns as text, a byte-order mark tolerated."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def row_text(columns: dict[str, Column]) -> Column:
    """``name: value`` of all non-empty cells, joined by ``; ``."""
    cells = [F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{name}: "), F.trim(c.cast("string")))) for name, c in columns.items()]
    return F.concat_ws("; ", *cells)


def linearise_rows(df: DataFrame, order: list[str], columns: list[str] | None = None, document: str | Column = "table") -> DataFrame:
    """One chunk for each row with any text: document_name, chunk_index, row, content.

    ``row`` counts all rows from 2 in the given order (row 1 is the header); ``chunk_index``
    counts those kept from 0. Numbering is per document.
    """
    columns = columns or df.columns
    name = F.lit(document) if isinstance(document, str) else document
    text = df.select(name.alias("document_name"), *order, row_text({c: F.col(f"`{c}`") for c in columns}).alias("content"))
    some = F.col("content") != ""
    counted = running_numbers(text, ["document_name"], order, _row=F.lit(True), _kept=some).where(some)
    return counted.select("document_name", (F.col("_kept") - 1).cast("int").alias("chunk_index"), (F.col("_row") + 1).cast("int").alias("row"), "content")


def linearise_sheets(cells: DataFrame) -> DataFrame:
    """The same for headerless sheets given as ``document_name, sheet_no, sheet, row, cells``.

    Each sheet's row 1 is its header, a blank or missing header is ``Col{i}``, i from 0; chunk numbers run on
    across the sheets of a document.
    """
    header = cells.where("row = 1").select("document_name", "sheet_no", F.col("cells").alias("header"))
    body = cells.where("row > 1").join(header, ["document_name", "sheet_no"], "left")
    head = lambda i: F.coalesce(F.when(F.trim(F.get("header", i)) != "", F.trim(F.get("header", i))), F.concat(F.lit("Col"), i.cast("string")))
    parts = F.transform("cells", lambda x, i: F.when(F.trim(x) != "", F.concat(head(i), F.lit(": "), F.trim(x))))
    text = body.withColumn("content", F.array_join(F.filter(parts, lambda x: x.isNotNull()), "; ")).where("content <> ''")
    counted = running_numbers(text.select("document_name", "sheet_no", "sheet", "row", "content"), ["document_name"], ["sheet_no", "row"], _kept=F.lit(True))
    return counted.select("document_name", (F.col("_kept") - 1).cast("int").alias("chunk_index"), "sheet", "row", "content")


def route_documents(paths: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Supported documents with suffix and default type, and the rejected rest."""
    suffix = F.lower(F.regexp_extract(F.col(path), r"(\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in fixed.DOCUMENT_TYPES.items() for x in kv])
    typed = paths.withColumn("suffix", suffix).withColumn("default_type", F.try_element_at(table, suffix))
    known = typed.where("default_type is not null")
    if "doc_type" in paths.columns:
        known = known.withColumn("doc_type", F.coalesce("doc_type", "default_type")).drop("default_type")
    else:
        known = known.withColumnRenamed("default_type", "doc_type")
    return known, typed.where("default_type is null").drop("default_type").withColumn("error", F.concat(F.lit("Unsupported file type: "), F.col("suffix")))


def register_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file below ``path``: name, size, time, version, status. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("original_filename"), F.col("length").alias("file_size"), F.lit("v1.0").alias("version"),
        F.lit("Queued").alias("processing_status"), F.col("modificationTime").alias("uploaded_at"),
    )


def read_ground_truth(spark: SparkSession, folder: str, lines: bool = False) -> dict[str, DataFrame]:
    """The three tables of ground truth, with their schemas: JSON arrays, or (``lines``, for large ones) JSON lines."""
    return {name: spark.read.schema(schema).json(f"{folder}/{name}.json", multiLine=not lines) for name, schema in GROUND_TRUTH.items()}


def specification_names(name: Column) -> Column:
    """Whether requirements are to be extracted from a document of this name."""
    return contains_any(F.lower(name), ["spec", "requirement", "user_manual"])


def type_by_name(name: Column) -> Column:
    """Specification if the name has SRS or Spec (case counts), else Test Report."""
    return F.when(F.contains(name, F.lit("SRS")) | F.contains(name, F.lit("Spec")), "Specification").otherwise("Test Report")


def running_sums(df: DataFrame, group: list[str], order: list[str], **summed: Column) -> DataFrame:
    """``df`` with the sums of ``summed`` (whole numbers) over the rows of the group up to each row.

    Rows are dealt by ranges of group and order, so a group of any size is summed in
    parallel: each part sums its own rows, and only one total for each part is added up
    in sequence. The parts are written once, so that both sums see the same ones.
    """
    names = [f"_count_{k}" for k in range(len(summed))]
    placed = df.select("*", *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(n) for n, c in zip(names, summed.values(), strict=True)])
    placed = placed.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place"))
    placed = materialize(placed, "numbered")
    within = Window.partitionBy("_part", *group).orderBy("_place")
    before = Window.partitionBy(*[f"_g_{g}" for g in group]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group]).agg(*[F.sum(n).alias(n) for n in names])
    totals = totals.select("_p", *[f"_g_{g}" for g in group], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before{n}") for n in names])
    on = [F.col("_part") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]]
    out = placed.select("*", *[F.sum(n).over(within).alias(f"_own{n}") for n in names]).join(totals, on)
    return out.select(*df.columns, *[(F.col(f"_own{n}") + F.col(f"_before{n}")).alias(name) for n, name in zip(names, summed, strict=True)])


def running_numbers(df: DataFrame, group: list[str], order: list[str], **counted: Column) -> DataFrame:
    """``df`` with a running number for each of ``counted``: how many rows of the group, up to this one, it holds for."""
    return running_sums(df, group, order, **{name: c.cast("boolean") for name, c in counted.items()})


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with numbers from 1, groups in ascending order and rows in ``order`` within."""
    return running_numbers(df, [], [group, *order], **{name: F.lit(True)})


def running_code(prefix: str, n: Column, width: int) -> Column:
    """``prefix`` and a number padded with zeros to ``width`` digits (more, if it needs them)."""
    digits = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def number_chunks(chunks: DataFrame, document: str = "document_name", order: list[str] | None = None) -> DataFrame:
    """Sequential ids ``chunk-0001`` by document name, then chunk order."""
    return numbered(chunks, document, order or ["chunk_index"], "_seq").withColumn("chunk_id", running_code("chunk-", F.col("_seq"), 4)).drop("_seq")


def write_results(tables: dict[str, DataFrame], folder: str, partition: str | None = "project_id", mode: str = "overwrite") -> None:
    """Result tables as Parquet, partitioned where they have that column."""
    for name, df in tables.items():
        out = df.write.mode(mode)
        if partition and partition in df.columns:
            out = out.partitionBy(partition)
        out.parquet(f"{folder}/{name}")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A table of metrics as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A result list as CSV part files with headers; one task for each of its partitions."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
