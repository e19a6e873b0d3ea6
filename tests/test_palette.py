from functools import cache

import pytest

from proofline.operators import palette


def brute(low, query):
    """The best product of step factors over every way to place the query's characters."""

    @cache
    def rest(k, last):
        if k == len(query):
            return 1.0 if last == len(low) - 1 else palette.UNFINISHED
        scores = [0.0]
        for i in range(last + 1, len(low)):
            if low[i] == query[k]:
                if i == last + 1:
                    factor = 1.0
                elif low[i - 1] == " ":
                    factor = palette.AFTER_SPACE
                elif low[i - 1] in palette.SIGNS:
                    factor = palette.AFTER_SIGN
                else:
                    factor = palette.INSIDE_WORD * (palette.SKIPPED ** (i - last - 1) if k else 1)
                scores.append(factor * rest(k + 1, i))
        return max(scores)

    return rest(0, -1)


LABELS = ["Missing evidence", "missing_evidence", "Mist in every den", "A.b*c", "Ünder (test)", "", None, "many mean men mend me", "x" * 300 + " me", "Missing evidence"]
QUERIES = ["misev", "me", "M E", "a.*c", "ü(t", "xxme", "zz", "  "]


def test_scores_and_ranks_against_brute_force(spark):
    df = spark.createDataFrame([(f"R-{i}", x, 1) for i, x in enumerate(LABELS)] + [(None, "me", 1)], "code string, name string, score int")
    got = palette.ranked_search({"thing": (df, "code", "name")}, QUERIES, 4).collect()
    for q in QUERIES:
        bare = "".join(q.lower().split())
        want = []
        for i, x in [(f"R-{i}", x) for i, x in enumerate(LABELS)] + [(None, "me")]:
            s = brute(" ".join(y for y in (i, x) if y is not None).lower(), bare) if bare else 1.0
            if s > 0:
                want.append((round(s, 9), i, x))
        want.sort(key=lambda w: (-w[0], w[1] or "", w[2] or ""))
        mine = sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["score"] for r in mine] == pytest.approx([w[0] for w in want[:4]], abs=2e-9), q
        assert [r["id"] for r in mine] == [w[1] for w in want[:4]], q


def test_kinds_are_ranked_apart_and_empty_tables_give_nothing(spark):
    df = spark.createDataFrame([("1", "me"), ("2", "me")], "id string, label string")
    kinds = {"a": (df, "id", "label"), "b": (df.where("id = '1'"), "id", "label"), "c": (df.where("false"), "id", "label")}
    got = {(r["kind"], r["rank"], r["id"]) for r in palette.ranked_search(kinds, ["me"], 5).collect()}
    assert got == {("a", 1, "1"), ("a", 2, "2"), ("b", 1, "1")}
    assert palette.ranked_search(kinds, [], 5).count() == 0
