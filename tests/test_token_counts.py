"""Counts of tokens and of their chunks."""

from collections import Counter, defaultdict

from proofline.operators import retrieval


def test_token_counts(spark):
    """Repeats in a chunk, ids that stand twice or are null, empty and null texts, against a plain count."""
    texts = ["pump b pump a", "a", "", None, "pump test-12 PUMP", "a b"]
    rows = [(None if k == 7 else k % 23, texts[k % 6]) for k in range(60)]
    got = {r["token"]: (r["n"], r["chunks"]) for r in retrieval.token_counts(spark.createDataFrame(rows, "chunk_id long, content string")).collect()}
    n, ids = Counter(), defaultdict(set)
    for i, x in rows:
        for t in (x or "").lower().split():
            n[t] += 1
            ids[t] |= {i} - {None}
    assert got == {t: (n[t], len(ids[t])) for t in n}


def test_only_tokens_move(spark):
    """What is shuffled for the counts are partial counts of tokens, not rows of chunks."""
    chunks = spark.range(0, 20_000, 1, 4).selectExpr("id as chunk_id", "'one two three' as content")
    found = retrieval.token_counts(chunks)
    assert sorted(map(tuple, found.collect())) == [("one", 20_000, 20_000), ("three", 20_000, 20_000), ("two", 20_000, 20_000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffleQueryStage" in plan and "Window" not in plan
    ids = [x for x in plan.split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning" in x and "chunk_id" in x]
    assert not ids
