"""Ranked search over all kinds of entities, as a command palette ranks what its user types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a step from one matched character to the next multiplies the score with.
AFTER_SPACE = 0.9
AFTER_SIGN = 0.8
INSIDE_WORD = 0.17
SKIPPED = 0.999  # for each character jumped over on the way into a word
UNFINISHED = 0.99  # once, if the label goes on behind the last match
SIGNS = "-_/\\#.+&:;,()[]{}@\"'"


def in_order(query: str) -> str:
    """A pattern for texts that hold the characters of ``query`` in their order; it never backtracks."""
    return "^" + "".join(f"[^\\x{{{ord(c):x}}}]*\\x{{{ord(c):x}}}" for c in query)


def _score(query: str) -> Column:
    """The best score over all ways to find ``query`` in ``_chars``.

    One fold over the query: the state holds, for each place of the label, the best score of
    a match that ends there. A step costs 1 to the next place, else the place's gate.
    """
    chars, gates = F.col("_chars"), F.col("_gates")
    best = lambda a: F.coalesce(F.array_max(a), F.lit(0.0))

    def step(state: Column, wanted: Column) -> Column:
        def reach(c: Column, i: Column) -> Column:
            gate, far = F.get(gates, i), F.slice(state, F.lit(1), F.greatest(i - 1, F.lit(0)))
            first = F.when(i == 0, 1.0).otherwise(F.coalesce(gate, F.lit(INSIDE_WORD)))
            inside = best(F.transform(far, lambda s, r: s * F.pow(F.lit(SKIPPED), i - 1 - r))) * INSIDE_WORD
            jump = F.when(gate.isNotNull(), gate * best(far)).otherwise(inside)
            return F.when(c != wanted, 0.0).when(F.size(state) == 0, first).otherwise(F.greatest(F.coalesce(F.get(state, i - 1), F.lit(0.0)), jump))

        return F.transform(chars, reach)

    done = lambda state: F.array_max(F.transform(state, lambda s, i: F.when(i + 1 < F.size(chars), s * UNFINISHED).otherwise(s)))
    return F.aggregate(F.array(*[F.lit(c) for c in query]), F.array().cast("array<double>"), step, done)


def ranked_search(kinds: dict[str, tuple[DataFrame, str, str]], queries: list[str], n: int) -> DataFrame:
    """``query, kind, rank, id, label, score``: the ``n`` best rows of each kind for each query.

    kinds: name -> (table, id, label). A row matches if ``id label``, in lower case, holds the
    characters of the query in order (blanks of the query aside). Matches at once or at the
    begin of words score highest; ties go to the smaller id. A query of blanks gives the first
    rows of each kind with score 1; a null id or label counts as empty; repeated rows repeat;
    an empty table gives nothing.

    All queries are answered in one scan: a constant pattern for each decides which rows are
    scored, and only the ``n`` best of each task are shuffled.
    """
    parts = [df.select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), F.col(label).cast("string").alias("label")) for kind, (df, i, label) in kinds.items()]
    rows = reduce(DataFrame.unionByName, parts).withColumn("_low", F.lower(F.concat_ws(" ", "id", "label")))
    before = lambda i: F.get(F.col("_chars"), i - 1)
    gate = lambda c, i: F.when(before(i) == " ", AFTER_SPACE).when(before(i).isin(*SIGNS), AFTER_SIGN)
    bare = {q: "".join(q.lower().split()) for q in queries}
    rows = rows.where(reduce(Column.__or__, [F.col("_low").rlike(in_order(b)) for b in bare.values()], F.lit(False)))
    rows = rows.withColumn("_chars", F.split("_low", "")).withColumn("_gates", F.transform("_chars", gate))
    hits = [F.when(F.col("_low").rlike(in_order(b)), F.struct(F.lit(q).alias("query"), F.round(_score(b) if b else F.lit(1.0), 9).alias("score"))) for q, b in bare.items()]
    none = F.array().cast("array<struct<query:string,score:double>>")
    found = rows.select("kind", "id", "label", F.explode(F.filter(F.array(*hits) if hits else none, lambda h: h.isNotNull())).alias("h")).select("h.query", "kind", "id", "label", "h.score")
    order = Window.partitionBy("query", "kind").orderBy(F.desc("score"), "id", "label")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("query", "kind", "rank", "id", "label", "score")
