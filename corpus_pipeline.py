"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it
kept. All but the last return the columns of ``documents``, further ones included, whatever
their names. Null and empty texts pass all stages (nothing in them is toxic, near another
text, repeated or contaminated) and end as no pieces; rows without doc_id pass too; an empty
table gives an empty table. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofline.llm import decontaminate, minhash, sentencepiece, substrings, toxicity
from proofline.llm.shared import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the model learns from ``labels`` of these documents.

    Without labelled rows of both classes nothing is learned and nothing goes; repeated rows
    score alike.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    Rows without doc_id take no part and stay; repeated rows of the doc_id that stays stay.
    """
    return minhash.drop_near_duplicates(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 bytes that repeat within or across documents are cut out of the texts.

    That is less than fifty words of prose. Rows whose whole text goes stay, with an empty
    text; ``n_chars`` is renewed.
    """
    return substrings.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values, go.

    Rows are told apart by doc_id and text, a null doc_id included.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document's best segmentation: one row for each row, with no ids for an empty text."""
    return sentencepiece.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

# Learned scores, joins of hashed signatures and piece lattices have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}-{name}")
    return docs
