"""Sections of documents of any length, cut in parallel.

Where a section begins depends on where the one before it began, line after line. But all
that a block of lines needs to know of the lines before it is the begin of the section that
is open there, and it can say beforehand which section each such begin leaves open at its
end. So each block states that as a short step function, the functions of a document's blocks
are applied one after another (a few numbers a block), and every block then cuts its own
lines, many blocks side by side. Only documents of several blocks need the functions.

A document is measured in characters: a line at ``at`` begins after ``at`` characters, line
breaks counted. A section that began at ``s`` ends before the first line that starts a
section by itself, or lies at more than ``s + SECTION_CHARS + 1``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import strip
from ..sources.shared import materialize
from ..sources.tables import running_numbers, running_sums
from .chunking import SECTION_CHARS

BLOCK = 10_000  # lines
_NONE = -(1 << 60)  # no section is open


def _followers(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each line, the line at which a section that begins there ends; the number of lines if it stays open."""
    full = np.searchsorted(at, at + SECTION_CHARS + 1, "right")
    marked = np.append(np.flatnonzero(starts), len(at))
    return np.minimum(full, marked[np.searchsorted(marked, np.arange(len(at)), "right")])


def block_function(at: np.ndarray, starts: np.ndarray) -> tuple[list[int], list[int]]:
    """``below, line``: an open section that began below ``below[i]`` (the first such i) leaves open the one that begins at ``line[i]``.

    A section that began later than all of them stays open through the block.
    """
    n, after = len(at), _followers(at, starts)
    last = np.arange(n)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i] = last[after[i]]
    first_mark = int(np.argmax(starts)) if starts.any() else n
    below, line = [], []
    for j in range(min(int(np.searchsorted(at, at[0] + SECTION_CHARS + 1, "right")), first_mark, n - 1) + 1):
        limit = int(at[0]) if j == first_mark else int(at[j]) - SECTION_CHARS - 1
        if line and line[-1] == last[j]:
            below[-1] = limit
        else:
            below.append(limit), line.append(int(last[j]))
    return below, line


def whole_blocks(batches: Iterator[pa.RecordBatch], number: str, block: int) -> Iterator[pa.Table]:
    """Rows sorted by group and ``number`` (from 0 in each group) as tables of whole blocks of ``block`` rows; at most one is held back."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part])
        begins = np.flatnonzero(part[number].to_numpy() % block == 0)
        cut = int(begins[-1]) if len(begins) else 0
        if cut:
            yield part.slice(0, cut)
        rest = part.slice(cut)
    if rest is not None and len(rest):
        yield rest


def section_begins(at: np.ndarray, first: np.ndarray, starts: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """For each line, the line at which its section begins, or -1 for the one open before its block.

    ``first`` marks the first lines of the blocks, which are cut side by side; ``begun`` holds
    on each line of a block where the section open before it began.
    """
    begins, n = np.flatnonzero(first), len(at)
    ends, block = np.append(begins[1:], n), np.cumsum(first) - 1
    within = at - at[begins][block]
    flat = within + block * (int(within.max()) + 2 * SECTION_CHARS)  # blocks too far apart to meet
    after = np.minimum(_followers(flat, starts), ends[block])
    left = np.maximum(begun[begins] - at[begins], -SECTION_CHARS - 2)  # of the open section; none is open: the first line begins one
    marked = np.append(np.flatnonzero(starts), n)
    here = np.minimum(np.searchsorted(flat, flat[begins] + left + SECTION_CHARS + 1, "right"), marked[np.searchsorted(marked, begins)])
    own, stop = np.full(n, -1), ends
    while len(here):
        more = here < stop
        here, stop = here[more], stop[more]
        own[here] = here
        here = after[here]
    own = np.maximum.accumulate(own)
    return np.where(own >= begins[block], own, -1)


def section_lines(lines: DataFrame, group: list[str], order: str, text: str = "text", heading: Column | None = None) -> DataFrame:
    """``*group, chunk_index, content``: the sections of each document given as rows of lines, in ``order``.

    The rule is that of :func:`.chunking.sections`. Without ``heading`` Markdown headings count.
    """
    head = heading if heading is not None else F.col(text).rlike(r"^\s*#{1,6}\s")
    rows = lines.select(*group, order, strip(F.col(text)).alias("_line"), F.coalesce(head, F.lit(False)).alias("_head")).where(F.length("_line") > 0)
    rows = rows.withColumn("_starts", F.col("_head") | F.col("_line").rlike(fixed.SECTION_CODE)).drop("_head")
    rows = running_sums(rows, group, [order], _n=F.lit(1), _end=F.length("_line") + 1)
    rows = rows.select(*group, "_line", "_starts", (F.col("_n") - 1).alias("_n"), (F.col("_end") - F.length("_line") - 1).alias("_at"))
    rows = materialize(rows.withColumn("_block", F.floor(F.col("_n") / BLOCK)), "section-lines")
    bare = rows.drop("_line")
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bare.select(*group).schema)

    def described(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_n")
        at, number = part["_at"].to_numpy(), part["_n"].to_numpy()
        below, line = block_function(at, part["_starts"].to_numpy(bool))
        return pd.DataFrame([[*key, below, at[line].tolist(), number[line].tolist()]], columns=[*group, "_block", "below", "at", "n"])

    def opened(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        found, begun, number = [], _NONE, -1
        for b in blocks.sort_values("_block").itertuples():
            found.append([*key, b[len(group) + 1], begun, number])
            i = next((i for i, limit in enumerate(b.below) if begun < limit), None)
            if i is not None:
                begun, number = int(b.at[i]), int(b.n[i])
        return pd.DataFrame(found, columns=[*group, "_block", "begun", "number"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_blocks(batches, "_n", BLOCK):
            at, number, starts, begun, open_ = (part[c].to_numpy() for c in ("_at", "_n", "_starts", "begun", "number"))
            own = section_begins(at, number % BLOCK == 0, starts.astype(bool), begun)
            section = pa.array(np.where(own < 0, open_, number[own]), pa.int64())
            yield from part.select([*group, "_n"]).append_column("section", section).to_batches()

    same = lambda a, b, *more: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, *more)]
    many = rows.where("_block > 0").select(*group).distinct()  # documents of one block start with no section open
    several = bare.alias("a").join(many.alias("b"), same("a", "b"), "left_semi")
    functions = several.groupBy(*group, "_block").applyInPandas(described, f"{named}, _block long, below array<long>, at array<long>, n array<long>")
    entries = functions.groupBy(*group).applyInPandas(opened, f"{named}, _block long, begun long, number long")
    begun = [F.coalesce("begun", F.lit(_NONE)).alias("begun"), F.coalesce("number", F.lit(-1).cast("long")).alias("number")]
    joined = bare.alias("a").join(entries.alias("b"), same("a", "b", "_block"), "left").select("a.*", *begun)
    marks = joined.repartition(*group, "_block").sortWithinPartitions(*group, "_n").mapInArrow(cut, f"{named}, _n long, section long")
    whole = rows.alias("a").join(marks.alias("b"), same("a", "b", "_n")).select("a.*", "section")
    parts = F.array_sort(F.collect_list(F.struct("_n", "_line")))  # a section's lines are few
    chunks = whole.groupBy(*group, "section").agg(F.array_join(F.transform(parts, lambda p: p["_line"]), "\n").alias("content"))
    counted = running_numbers(chunks, group, ["section"], _k=F.lit(True))
    return counted.select(*group, (F.col("_k") - 1).cast("int").alias("chunk_index"), "content")
