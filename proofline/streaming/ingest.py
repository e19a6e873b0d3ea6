"""A landing directory of documents as a stream of chunks or requirements.

Chunking and rule-based extraction work row by row, so the stream needs no state and
each micro-batch is written once; restarts go on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract_requirements
from ..operators.chunking import page_chunks, section_chunks
from ..sources.tables import specification_names

DOCUMENT = "document_id string, document_name string, text string"


def read_documents(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """JSON documents that land in ``folder``, a bounded number of files for each batch."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", max_files).json(folder)


def stream_chunks(docs: DataFrame, by: str = "section") -> DataFrame:
    return section_chunks(docs) if by == "section" else page_chunks(docs)


def stream_requirements(docs: DataFrame) -> DataFrame:
    """Requirements of arriving specifications."""
    specs = docs.where(specification_names(F.col("document_name")))
    return specs.select("document_id", "document_name", F.inline(extract_requirements(F.col("text"))))


def write_stream(df: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, once: bool = True):
    """Append each micro-batch to ``path`` as Parquet; ``once``: work off what is there, then stop."""

    def batch(part: DataFrame, number: int) -> None:
        out = transform(part) if transform else part
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
