"""Connected components of an edge table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node.

    Alternates two star contractions: each node's larger neighbours are hung on its
    smallest neighbour, then its smaller neighbours on the smallest of them. The number
    of rounds grows with the logarithm of the longest path. Edges are aggregated with
    ``min`` before any shuffle, so a hub node costs one partial row per task; each
    round's edges are written to the shared folder. Joins are merge joins by hint, as Parquet's
    compressed size says little of the rows that a broadcast would bring to the driver.
    """
    e = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(most_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(small.union(low2.select("a", F.col("m").alias("b"))).distinct(), "edges")
        # one node with one parent each, and no parent that has a parent: the forest is flat
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
