"""What the runs leave on local disks, and what they move."""

from pathlib import Path

from pyspark.sql import functions as F

from proofline.operators import retrieval
from proofline.sources.shared import materialize


def _shuffles(spark):
    folder = Path(spark.sparkContext.getConf().get("spark.local.dir"))
    return {f.name for f in folder.rglob("shuffle_*.data")}


def test_shuffles_end_with_the_write(spark):
    before = _shuffles(spark)
    rows = spark.range(50_000).withColumn("g", F.col("id") % 997).groupBy("g").agg(F.max("id").alias("m"))
    kept = rows.repartition(3, "m")
    out = materialize(kept.join(rows.withColumnRenamed("m", "n"), "g"), "test-disk")
    assert not _shuffles(spark) - before
    assert out.where("m = n").count() == 997 and kept.count() == 997  # the plan itself can run again


def test_carried_columns_are_those_of_the_chunk(spark):
    chunks = spark.range(60).select(
        (F.col("id") % 3).cast("int").alias("project_id"), F.col("id").alias("chunk_id"), F.concat(F.lit("d"), (F.col("id") % 4).cast("string")).alias("document_name"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("int")).alias("page_number"), F.concat(F.lit("Supply Voltage "), F.col("id").cast("string")).alias("content"),
    )
    reqs = spark.createDataFrame([(p, 10 * p, f"supply voltage {7 + p}") for p in range(3)], "project_id int, req_id long, text string")
    columns = ["req_id", "rank", "chunk_id", "score", "page_number", "content"]
    want = retrieval.retrieve(reqs, chunks, 4, 0.3).join(chunks.select("chunk_id", "page_number", "content"), "chunk_id").select(*columns).collect()
    got = retrieval.retrieve(reqs, chunks, 4, 0.3, carry=("page_number", "content")).select(*columns).collect()
    assert len(got) == 12 and sorted(map(repr, got)) == sorted(map(repr, want))
