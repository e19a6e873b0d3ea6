"""Scores of chunks against requirements, block by block.

Chunks are dealt by project and place into groups of alike size, each with the token counts of
its projects' requirements, by one shuffle of the texts. A group scores its pairs a
few million sums at a time and keeps only what its fold asks for, so pairs are never stored
or shuffled: what moves grows with the texts, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PART_CHARS = 4 << 20  # characters of a group's chunks, on average
REQUIREMENT_CHARS = 1_000  # what a requirement counts for in a group
BLOCK = 8_192  # requirements of a project in one group, on average
SUMS = 2_000_000  # pairs, and common tokens, that are held at a time
DIGITS = 9  # scores are rounded before they are ranked, as sums depend on their order


class Pairs(NamedTuple):
    """Scored pairs of a slice: numbers of the requirement and of the chunk, and the score."""

    req: np.ndarray
    row: np.ndarray
    score: np.ndarray


class Group:
    """The chunks and requirements of one group."""

    def __init__(self, chunks: pa.Table, tokens: pa.Table):
        self.projects, self.words = pc.unique(tokens["project_id"]), pc.unique(tokens["token"])
        mine = pc.index_in(chunks["project_id"], value_set=self.projects)
        # in no order, so that the first slices hold good chunks of every project
        order = np.random.default_rng(0).permutation(np.flatnonzero(np.asarray(pc.is_valid(mine))))
        self.chunks = chunks.take(pa.array(order)).combine_chunks()
        self.project = _codes(self.chunks["project_id"], self.projects)
        self._requirements(tokens)
        self._tokens()

    def _requirements(self, tokens: pa.Table) -> None:
        project, ids = _codes(tokens["project_id"], self.projects), pc.unique(tokens["req_id"])
        named = project * len(ids) + _codes(tokens["req_id"], ids)
        found, at, self.of = np.unique(named, return_index=True, return_inverse=True)  # by project
        self.requirements = tokens.select(["project_id", "req_id"]).take(pa.array(at))
        self.first = np.searchsorted(found // len(ids), np.arange(len(self.projects)))
        self.width = int(np.bincount(found // len(ids)).max())
        key = project * len(self.words) + _codes(tokens["token"], self.words)
        order = np.argsort(key, kind="stable")
        self.keys, self.start, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.of, self.tokens = self.of[order], tokens["token"].take(pa.array(order))
        self.local = self.of - self.first[project[order]]
        self.times, self.boost, self.named = (tokens[c].to_numpy()[order].astype(float) for c in ("qtf", "boost", "named"))

    def _tokens(self) -> None:
        """The chunks' tokens that a requirement of their project has: row, place in the lists, impact."""
        lists = pc.split_pattern(self.chunks["words"], " ")
        row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
        code = _codes(pc.list_flatten(lists), self.words)
        known, times = np.unique((row * len(self.words) + code)[code >= 0], return_counts=True)
        row, code = known // len(self.words), known % len(self.words)
        key = self.project[row] * len(self.words) + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        self.row, self.at, times = row[hit], at[hit], times[hit]
        self.impact = times * self.chunks["gain"].to_numpy()[self.row] / (times + self.chunks["norm"].to_numpy()[self.row])

    def slices(self, min_score: float) -> Iterator[Pairs]:
        """All pairs at ``min_score`` or more, a slice of chunks at a time; the first slices are small."""
        n, a, size = len(self.chunks), 0, max(1, len(self.chunks) // 32)
        boosted = self.chunks["boosted"].to_numpy().astype(float)
        made = np.concatenate([[0], np.cumsum(np.bincount(self.row, weights=self.count[self.at], minlength=n))])
        while a < n:
            fits = int(np.searchsorted(made, made[a] + SUMS, "right")) - 1
            b = max(a + 1, min(a + size, n, fits, a + SUMS // self.width))
            one, end = np.searchsorted(self.row, [a, b])
            at, count = self.at[one:end], self.count[self.at[one:end]]
            p = np.repeat(self.start[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
            slot = np.repeat(self.row[one:end] - a, count) * self.width + self.local[p]
            raw = np.bincount(slot, weights=self.times[p] * np.repeat(self.impact[one:end], count) + self.boost[p], minlength=(b - a) * self.width)
            named = np.bincount(slot, weights=self.named[p], minlength=(b - a) * self.width) > 0
            slot = np.flatnonzero(raw > 0)
            row = slot // self.width + a
            score = np.round(raw[slot] + boosted[row] * named[slot], DIGITS)
            good = score >= min_score
            yield Pairs((self.first[self.project[row]] + slot % self.width)[good], row[good], score[good])
            a, size = b, size * 2

    def common(self, req: np.ndarray, row: np.ndarray) -> list[str]:
        """The distinct common tokens of pairs, joined by blanks."""
        wanted: dict[int, list[str]] = {}
        for of, token in zip(self.of.tolist(), self.tokens.to_pylist(), strict=True):
            wanted.setdefault(of, []).append(token)
        rows = np.unique(row)
        held = {r: set(text.split(" ")) for r, text in zip(rows.tolist(), self.chunks["words"].take(pa.array(rows)).to_pylist(), strict=True)}
        return [" ".join(t for t in wanted[q] if t in held[r]) for q, r in zip(req.tolist(), row.tolist(), strict=True)]


def _codes(values: pa.ChunkedArray | pa.Array, of: pa.Array) -> np.ndarray:
    """Places of ``values`` in ``of``; -1 for others."""
    return np.asarray(pc.fill_null(pc.index_in(values, value_set=of), -1), dtype=np.int64)


def best_rows(group: Group, min_score: float, k: int, per_document: int, carry: tuple[str, ...] = ()) -> pa.Table:
    """The pairs of a group that may stand among the diversified best ``k`` of their requirement, with the columns ``carry`` of the chunk.

    A pair is out as soon as k pairs of the requirement outrank it, of which no more than
    ``per_document`` of a document count: these go before it whatever other groups hold.
    """
    chunks = group.chunks
    place = np.empty(len(chunks), np.int64)
    place[np.asarray(pc.sort_indices(chunks["chunk_id"]))] = np.arange(len(chunks))
    document = _codes(chunks["document_name"], pc.unique(chunks["document_name"]))
    n = len(group.requirements)
    least, after = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
    kept = Pairs(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for new in group.slices(min_score):
        may = (new.score > least[new.req]) | ((new.score == least[new.req]) & (place[new.row] < after[new.req]))
        if not may.any():
            continue
        req, row, score = (np.concatenate([x, y[may]]) for x, y in zip(kept, new, strict=True))
        order = np.lexsort((place[row], -score, req))
        req, row, score = req[order], row[order], score[order]
        rank = pd.DataFrame({"q": req, "d": document[row]}).groupby(["q", "d"], sort=False).cumcount().to_numpy()
        early = rank < per_document
        before = np.cumsum(early) - early
        before -= before[np.searchsorted(req, req)]
        last = early & (before == k - 1)
        least[req[last]], after[req[last]] = score[last], place[row[last]]
        stay = (before < k) & (rank < k)
        kept = Pairs(req[stay], row[stay], score[stay])
    taken = chunks.take(pa.array(kept.row))
    whose = group.requirements.take(pa.array(kept.req))
    return pa.table({
        "project_id": whose["project_id"], "req_id": whose["req_id"], "chunk_id": taken["chunk_id"], "document_name": taken["document_name"], "score": kept.score, "held": pa.array(group.common(kept.req, kept.row), pa.string()),
        **{c: taken[c] for c in carry},
    })


def totals(group: Group, min_score: float) -> pa.Table:
    """``pairs, best, total`` of each requirement over the group's pairs."""
    n = len(group.requirements)
    pairs, best, total = np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n)
    for s in group.slices(min_score):
        pairs += np.bincount(s.req, minlength=n)
        total += np.bincount(s.req, weights=s.score, minlength=n)
        np.maximum.at(best, s.req, s.score)
    some = pairs > 0
    whose = group.requirements.take(pa.array(np.flatnonzero(some)))
    return pa.table({"project_id": whose["project_id"], "req_id": whose["req_id"], "pairs": pairs[some], "best": best[some], "total": total[some]})


def scanned(tokens: DataFrame, chunks: DataFrame, sizes: DataFrame, fold: Callable[[Group], pa.Table], columns: StructType, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fold`` over all groups.

    ``tokens``: project_id, req_id, token, qtf, boost, named. ``chunks``: project_id, chunk_id,
    document_name, content. ``sizes``: project_id, chars, n_requirements, avg_len of each
    project. ``prepare`` adds to ``chunks`` with avg_len, after their shuffle, the columns that
    a group needs: words (tokens joined by blanks), boosted, gain, norm.
    """
    weight = F.col("chars") + F.col("n_requirements") * REQUIREMENT_CHARS
    n = max(1, -(-(sizes.agg(F.sum(weight)).first()[0] or 0) // PART_CHARS))
    dealt = sizes.select("project_id", "avg_len", F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(F.col("chars") / PART_CHARS))).alias("_parts"), F.greatest(F.lit(1), F.ceil(F.col("n_requirements") / BLOCK)).alias("_blocks"))
    group = lambda part: F.pmod(F.pmod(F.xxhash64("project_id"), F.lit(n)) + part, F.lit(n))
    left = chunks.join(dealt, "project_id").withColumn("_group", group(F.pmod(F.xxhash64("chunk_id"), "_parts")))
    left = left.select(*chunks.columns, "avg_len", "_group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    left = prepare(left.repartition("_group", "_block"))
    right = tokens.join(dealt, "project_id").withColumn("_block", F.pmod(F.xxhash64("req_id"), "_blocks"))
    right = right.select(*tokens.columns, "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    right = right.select(*tokens.columns, group(F.col("_part")).alias("_group"), "_block")
    schema = to_arrow_schema(columns)

    def folded(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return schema.empty_table()
        return fold(Group(a, b)).cast(schema)

    return left.groupBy("_group", "_block").cogroup(right.groupBy("_group", "_block")).applyInArrow(folded, columns)
