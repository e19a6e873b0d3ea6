"""Scores by groups against the plain join of tokens, and what moves for them."""

import random

import pytest
from pyspark.sql import functions as F

from proofline.operators import lexical, retrieval

WORDS = ["supply", "voltage", "the", "of", "latency", "12", "kv", "test", "pump", "REQ-AB-001", "seal", "x"]


@pytest.fixture
def many(spark):
    """Projects of one to 300 chunks, few document names, equal texts, a project without requirements and one without chunks."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    names = ["a_test_report", "b_srs", "c_manual", None]
    chunks = [(p, p * 1000 + k, r.choice(names), say(r.randint(0, 6))) for p, n in enumerate([300, 1, 40, 7, 0, 9]) for k in range(n)]
    reqs = [(p, p * 100 + k, say(r.randint(1, 9))) for p, n in enumerate([25, 3, 2, 40, 2, 0]) for k in range(n)]
    return spark.createDataFrame(reqs, "project_id int, req_id long, text string"), spark.createDataFrame(chunks, "project_id int, chunk_id long, document_name string, content string")


@pytest.mark.parametrize(("chars", "sums", "block"), [(4 << 20, 2_000_000, 8_192), (300, 50, 7)])
def test_groups_of_any_size_give_the_pairs_of_the_join(spark, many, monkeypatch, chars, sums, block):
    for name, value in {"PART_CHARS": chars, "SUMS": sums, "BLOCK": block}.items():
        monkeypatch.setattr(lexical, name, value)
    reqs, chunks = many
    pairs = retrieval.scores(reqs, chunks)
    want = pairs.groupBy("req_id").agg(F.count("*"), F.round(F.max("score"), 6), F.round(F.sum("score"), 3))
    got = retrieval.score_totals(reqs, chunks).select("req_id", "pairs", F.round("best", 6), F.round("total", 3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    columns = ["project_id", "req_id", "rank", "chunk_id", "document_name", "score", "matched"]
    for k, per_document in ((4, 2), (7, 1), (500, 2)):
        want = retrieval.diversified(pairs, k, per_document).select(*columns).collect()
        got = retrieval.retrieve(reqs, chunks, k, 0.3, per_document).select(*columns).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_pairs_are_not_shuffled(spark, many):
    """Every chunk has a token of every requirement: the scan's shuffles hold chunks and tokens, not the pairs."""
    n, m = 4_000, 100
    chunks = spark.range(n).select(F.lit(1).alias("project_id"), F.col("id").alias("chunk_id"), F.lit("a").alias("document_name"), F.concat(F.lit("supply word"), F.col("id").cast("string")).alias("content"))
    reqs = spark.range(m).select(F.lit(1).alias("project_id"), F.col("id").alias("req_id"), F.lit("supply").alias("text"))
    found = retrieval.score_totals(reqs, chunks)
    assert {tuple(r) for r in found.select("req_id", "pairs").collect()} == {(k, n) for k in range(m)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "explode(t" not in plan
