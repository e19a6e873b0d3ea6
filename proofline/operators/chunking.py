"""Chunks of documents: pages, sections, and texts put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import lines, strip

SECTION_CHARS = 1500


def page_chunks(docs: DataFrame, delimiter: str = "\f", text: str = "text") -> DataFrame:
    """One stripped chunk for each non-blank page: page_number from 1, chunk_index from 0, gaps stay."""
    keep = [c for c in docs.columns if c != text]
    pages = docs.select(*keep, F.posexplode(F.split(F.col(text), delimiter)).alias("chunk_index", "content"))
    pages = pages.withColumn("content", strip(F.col("content"))).where("content <> ''")
    return pages.select(*keep, (F.col("chunk_index") + 1).alias("page_number"), "chunk_index", "content")


def sections(paragraphs: Column, heading: Column | None = None) -> Column:
    """Chunks of an array of paragraphs: a new one at headings, requirement codes, or length.

    ``heading`` is a parallel array of flags; without it Markdown headings count.
    """
    flagged = F.arrays_zip(F.transform(paragraphs, strip).alias("line"), (heading if heading is not None else F.transform(paragraphs, lambda p: p.rlike(r"^\s*#{1,6}\s"))).alias("head"))
    kept = F.filter(flagged, lambda x: F.length(x["line"]) > 0)

    def step(acc: Column, x: Column) -> Column:
        starts = F.coalesce(x["head"], F.lit(False)) | x["line"].rlike(fixed.SECTION_CODE) | (F.length(acc["cur"]) > SECTION_CHARS)
        cut = (F.length(acc["cur"]) > 0) & starts
        joined = F.when(F.length(acc["cur"]) > 0, F.concat(acc["cur"], F.lit("\n"), x["line"])).otherwise(x["line"])
        return F.struct(
            F.when(cut, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.when(cut, x["line"]).otherwise(joined).alias("cur")
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    return F.aggregate(kept, start, step, lambda acc: F.when(F.length(acc["cur"]) > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


def section_chunks(docs: DataFrame, text: str = "text", heading: str | None = None) -> DataFrame:
    """Section chunks of each document, numbered from 0. One fold per document."""
    keep = [c for c in docs.columns if c not in (text, heading)]
    parts = sections(lines(F.col(text)), F.col(heading) if heading else None)
    return docs.select(*keep, F.posexplode(parts).alias("chunk_index", "content"))


def reassemble(chunks: DataFrame, keys: list[str], separator: str = " ", lead: bool = False) -> DataFrame:
    """Each document's text from its chunks in order, joined by (or, ``lead``, each after) ``separator``."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    text = F.array_join(F.transform(parts, lambda x: x["content"]), separator)
    return chunks.groupBy(*keys).agg((F.concat(F.lit(separator), text) if lead else text).alias("text"))
