"""Requirements of documents of any length, given as rows of lines.

Whether a line with a modal phrase completes the requirement before it or starts one of its
own depends on that requirement, and so on the lines before. All that counts of it is
whether it takes another line and how long its title is, up to ``FULL`` characters: ``STATES``
states. So each block of lines says in which state it ends for each state it may begin in,
a document's blocks are put one after another (a few numbers a block), and every block then
tells of its own lines which requirement they belong to, all blocks of a task in one call. What a requirement gathers from its
lines comes from an aggregation that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import contains_any, extract_parameters, group, infer_category, or_null, severity_of, strip
from ..sources.shared import materialize
from ..sources.tables import running_code, running_numbers
from .sections import whole_blocks

BLOCK = 10_000  # lines that matter
SHORTEST, TITLE, SHORT = 15, 120, 80  # a line that counts, a title cut from one, a description that takes another line
FULL = SHORT - SHORTEST - 2  # a title of that length or more is full after one further line
STATES = FULL + 2  # 0: nothing takes a line; 1 + t: a requirement with a title of t characters does


def _after(state: np.ndarray, coded: bool, length: int, title: int, open_: bool) -> np.ndarray:
    """The states behind a line; ``title`` and ``open_`` are those of the requirement it would start."""
    own = 1 + min(title, FULL) if open_ else 0
    if coded:
        return np.full_like(state, own)
    return np.where(state == 0, own, np.where(state - 1 + 2 + length < SHORT, state, 0))


def block_function(coded: np.ndarray, length: np.ndarray, title: np.ndarray, open_: np.ndarray, number: np.ndarray) -> tuple[list[int], list[int]]:
    """For each state before the block: the state behind it, and the line of the requirement then last (-1: the one before the block)."""
    state, head = np.arange(STATES), np.full(STATES, -1)
    for c, n, t, o, k in zip(coded.tolist(), length.tolist(), title.tolist(), open_.tolist(), number.tolist(), strict=True):
        head = np.where(c | (state == 0), k, head)
        state = _after(state, c, n, t, o)
    return state.tolist(), head.tolist()


def line_heads(coded: list[bool], length: list[int], title: list[int], open_: list[bool], number: list[int], state: list[int], head: list[int], block: int) -> list[int]:
    """The line of the requirement each line belongs to, for blocks in sequence; ``state`` and ``head`` are those before a line's block."""
    heads, now, at = [], 0, -1
    for c, n, t, o, k, begin, before in zip(coded, length, title, open_, number, state, head, strict=True):
        if k % block == 0:
            now, at = begin, before
        if c or now == 0:
            now, at = 1 + min(t, FULL) if o else 0, k
        elif now + 1 + n >= SHORT:
            now = 0
        heads.append(at)
    return heads


def requirement_lines(lines: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """``*keys, ord, req_code, title, description, category, severity, parameters``: the requirements of each document.

    ``lines`` holds one row a line, told apart by ``order``. The rule is that of
    :func:`..functions.text.extract_requirements`; ``ord`` counts from 0. Null and short lines
    are passed over; a document without requirements gives no rows.
    """
    row = lines.select(*keys, order, strip(F.col(text)).alias("_line")).where(F.length("_line") >= SHORTEST)
    code = group(F.col("_line"), fixed.LINE_CODE, 1)
    named = F.coalesce(or_null(strip(F.regexp_extract("_line", fixed.LINE_CODE, 2))), F.col("_line"))
    row = row.withColumn("_code", F.replace(F.upper(code), F.lit("_"), F.lit("-"))).where(F.col("_code").isNotNull() | contains_any(F.lower("_line"), fixed.MODALS))
    row = row.withColumn("_title", F.when(F.col("_code").isNotNull(), named).otherwise(F.substring("_line", 1, TITLE)))
    row = running_numbers(row, keys, [order], _n=F.lit(True)).withColumn("_n", F.col("_n") - 1)
    row = materialize(row.withColumn("_block", F.floor(F.col("_n") / BLOCK)), "requirement-lines")
    open_ = (F.col("_title") == F.col("_line")) | (F.length("_line") < SHORT)
    bare = row.select(*keys, "_block", "_n", F.col("_code").isNotNull().alias("_coded"), F.length("_line").alias("_length"), F.length("_title").alias("_title"), open_.alias("_open"))
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bare.select(*keys).schema)
    facts = ["_coded", "_length", "_title", "_open", "_n"]

    def described(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_n")
        state, head = block_function(*[part[c].to_numpy() for c in facts])
        return pd.DataFrame([[*key, state, head]], columns=[*keys, "_block", "state", "head"])

    def entered(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        found, state, head = [], 0, -1
        for b in blocks.sort_values("_block").itertuples(index=False):
            found.append([*key, b[len(keys)], state, head])
            head = head if b.head[state] < 0 else int(b.head[state])
            state = int(b.state[state])
        return pd.DataFrame(found, columns=[*keys, "_block", "state", "head"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_blocks(batches, "_n", BLOCK):
            heads = pa.array(line_heads(*[part[c].to_pylist() for c in (*facts, "state", "head")], BLOCK), pa.int64())
            yield from part.select([*keys, "_n"]).append_column("head", heads).to_batches()

    same = lambda a, b, *more: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, *more)]
    many = row.where("_block > 0").select(*keys).distinct()  # documents of one block begin in state 0
    several = bare.alias("a").join(many.alias("b"), same("a", "b"), "left_semi")
    functions = several.groupBy(*keys, "_block").applyInPandas(described, f"{typed}, _block long, state array<long>, head array<long>")
    entries = functions.groupBy(*keys).applyInPandas(entered, f"{typed}, _block long, state long, head long")
    entry = [F.coalesce("state", F.lit(0).cast("long")).alias("state"), F.coalesce("head", F.lit(-1).cast("long")).alias("head")]
    begun = bare.alias("a").join(entries.alias("b"), same("a", "b", "_block"), "left").select("a.*", *entry)
    heads = begun.repartition(*keys, "_block").sortWithinPartitions(*keys, "_n").mapInArrow(told, f"{typed}, _n long, head long")
    whole = row.alias("a").join(heads.alias("b"), same("a", "b", "_n")).select("a.*", "head")
    return _gathered(whole, keys)


def _gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One requirement for each head: its own line, the last line that completes it, the first parameters found."""
    own = F.col("_n") == F.col("head")
    basis = F.when(own & F.col("_code").isNotNull(), F.col("_title")).otherwise(F.col("_line"))
    rows = rows.withColumn("_parameters", extract_parameters(basis)).withColumn("_basis", basis)
    only = lambda c, condition: F.when(condition, F.col(c))
    found = F.size("_parameters") > 0
    reqs = rows.groupBy(*keys, "head").agg(
        *[F.max(only(c, own)).alias(c) for c in ("_code", "_title", "_line", "_basis")],
        F.max_by(only("_line", ~own), only("_n", ~own)).alias("_more"),
        F.min_by(only("_parameters", found), only("_n", found)).alias("_found"),
    )
    numbered = running_numbers(reqs, keys, ["head"], _ord=F.lit(True), _running=F.col("_code").isNull())
    category = infer_category(F.col("_basis"))
    none = F.array().cast(rows.schema["_parameters"].dataType)
    described = F.coalesce(F.concat("_title", F.lit(". "), "_more"), F.col("_line"))
    return numbered.select(
        *keys, (F.col("_ord") - 1).cast("int").alias("ord"), F.coalesce("_code", running_code("REQ-", F.col("_running"), 3)).alias("req_code"), F.col("_title").alias("title"), described.alias("description"),
        category.alias("category"), severity_of(category).alias("severity"), F.coalesce("_found", none).alias("parameters"),
    )


def document_lines(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``*keys, line, text``: the lines of whole texts, for documents that fit in a row."""
    return documents.select(*keys, F.posexplode(F.split(F.col(text), fixed.LINE_BREAKS)).alias("line", "text"))
