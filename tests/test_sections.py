"""Sections cut by blocks against the fold over all lines."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.operators import chunking, sections


def fold(lines):
    done, cur = [], ""
    for x in (x.strip() for x in lines):
        if not x:
            continue
        if cur and (x.startswith("# ") or x.startswith("REQ-1:") or len(cur) > 1500):
            done.append(cur)
            cur = x
        else:
            cur = f"{cur}\n{x}" if cur else x
    return done + [cur] if cur else done


@pytest.mark.parametrize("block", [3, 50, 10_000])
def test_blocks_equal_the_fold(spark, monkeypatch, block):
    monkeypatch.setattr(sections, "BLOCK", block)
    rng = random.Random(block)
    docs = {}
    for doc in range(12):
        marked = rng.choice([0, 0, 0.01, 0.3])
        some = lambda: "# head" if rng.random() < marked else "REQ-1: x" if rng.random() < marked else "y" * rng.choice([0, 1, 3, 40, 200, 1499, 1501, 4000] if doc % 2 else [1, 9])  # noqa: B023, E731
        docs[doc] = [some() for _ in range(rng.choice([1, 40, 900]))]
    docs[None] = ["a", "b"]
    rows = [(d, k, x) for d, lines in docs.items() for k, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc long, line int, text string").repartition(7).withColumn("_block", F.lit("clash"))
    got = {}
    for r in sections.section_lines(df, ["doc"], "line").orderBy("doc", "chunk_index").collect():
        assert r["chunk_index"] == len(got.setdefault(r["doc"], []))
        got[r["doc"]].append(r["content"])
    assert got == {d: fold(lines) for d, lines in docs.items() if fold(lines)}


def test_one_large_document(spark):
    """A document of 300,000 lines without any heading is cut in many blocks, as the fold cuts it."""
    lines = spark.range(300_000, numPartitions=8).select(F.lit("d").alias("doc"), F.col("id").alias("line"), F.expr("repeat('w', cast(1 + pmod(xxhash64(id), 60) as int))").alias("text"))
    got = sections.section_lines(lines, ["doc"], "line").orderBy("chunk_index")
    want = fold([r["text"] for r in lines.orderBy("line").collect()])
    assert [r["content"] for r in got.collect()] == want and len(want) > 5000


def test_no_lines(spark):
    df = spark.createDataFrame([(1, 0, " "), (2, 1, None)], "doc long, line int, text string")
    assert sections.section_lines(df, ["doc"], "line").collect() == []
    assert chunking.SECTION_CHARS == sections.SECTION_CHARS


def test_blocks_side_by_side():
    """Blocks cut together give what each gives alone."""
    rng = np.random.default_rng(5)
    parts = [(np.cumsum(rng.integers(1, 900, n)), rng.random(n) < 0.1, b) for n, b in ((1, sections._NONE), (40, sections._NONE), (7, 0), (300, -700))]
    alone = [sections.section_begins(at, np.arange(len(at)) == 0, starts, np.full(len(at), b)) for at, starts, b in parts]
    first = np.concatenate([np.arange(len(p[0])) == 0 for p in parts])
    both = sections.section_begins(*[np.concatenate(x) for x in ([p[0] for p in parts], [first], [p[1] for p in parts], [np.full(len(p[0]), p[2]) for p in parts])])
    shift = np.cumsum([0, *[len(a) for a in alone[:-1]]])
    assert both.tolist() == np.concatenate([np.where(a < 0, -1, a + k) for a, k in zip(alone, shift, strict=True)]).tolist()
