"""Titles that contain each other against comparing all with all, without broadcasts."""

import random

from proofline.operators import metrics


def test_titles_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "ab", "volt", "current", "é", "quiescent current of the long named unit", str(rng.randrange(300))])
    title = lambda: " ".join(word() for _ in range(rng.choice([1, 2, 3, 5]))) + rng.choice(["", "", "!", "xyz"])
    truth = [(f"T-{k}", title() if k % 50 else "", k) for k in range(400)]
    got = [(f"G-{k}" if k % 4 else f"t_{k}", (title() + title())[:rng.choice([3, 9, 200])], k) for k in range(400)]
    frames = [spark.createDataFrame(rows, "req_code string, title string, ord int") for rows in (truth, got)]
    matched, codes = metrics.match_extraction(*frames)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    names, have = [t for _, t, _ in got if t], {c.upper().replace("_", "-") for c, _, _ in got}
    want = {c: c in have or any(t in x or x in t for x in names) for c, t, _ in truth}
    assert {r["code"]: r["matched"] for r in matched.collect()} == want and 0 < sum(want.values()) < 400
    assert codes.count() == 400


def test_one_word_in_all_titles(spark):
    """Rows looked up grow with the titles, not with the pairs of those that share a word."""
    held = spark.range(3000).selectExpr("concat('quiescent current ', id) AS held")
    outer = spark.range(3000).selectExpr("concat('quiescent current ', id, ' A') AS outer")
    found = metrics._standing(held, outer)
    assert found.count() == sum(len([n for n in range(1, len(str(k)) + 1) if str(k)[:n] == str(int(str(k)[:n]))]) for k in range(3000))
