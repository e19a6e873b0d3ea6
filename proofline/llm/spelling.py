"""Spelling variants: words one edit apart, found with a bit-sliced position index.

A block of words is indexed by bitsets, one for each (position, letter): bit ``w`` says that
word ``w`` has the letter there. All words of the block run through it at once, one letter a
step. For each, ``exact`` is the set of words equal so far; ``replaced`` are those with one
other letter so far, and ``inserted`` those with one letter more, which are read one position
further on. A step costs a few operations on machine words, each of which serves 64
candidates. At the end the words' lengths pick the ones that are used up; a deletion is an
insertion seen from the other word.

Not all words meet: of two words one edit apart, the shorter of L letters, one half is
untouched: the first ``L // 2`` letters of both, or the last ``L - L // 2``. So words are filed
by both halves (for L their own length and, as the longer one, their length less one), and
the groups of equal halves are packed into blocks. A pair counts in the first of its two
possible groups alone. A group of more than ``GROUP`` words is dealt into slices and each
pair of slices is a group of its own, so no block grows with the data.

Edge cases: null, empty and letterless texts have no words; a null doc_id counts as the
empty text in the checksum; repeated rows count each; runs and words may be of any length;
other columns, whatever their names, are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, ODDS = 7, 2, 10
DELETES = 31  # one run in so many, by its checksum, loses a letter
BLOCK = GROUP = 1024
BLOCK_BYTES = 1 << 26  # of a block's bitsets before packing

_PAIR = "word string, n long, near string, near_n long"


def words(documents: DataFrame) -> DataFrame:
    """``word, n``: the words of all texts and how often each occurs."""
    low = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LETTERS).withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETES == 0, less).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _filed(vocabulary: DataFrame) -> DataFrame:
    """``size, half, key, slice, tile, word, n``: the words under both of their halves; ``tile`` names a pair of slices."""
    n = F.length("word")
    sizes = F.filter(F.array(n, n - 1), lambda size: size >= LEAST_LETTERS)
    rows = vocabulary.select("word", "n", F.explode(sizes).alias("size"))
    first, last = (F.col("size") / 2).cast("int"), F.col("size") - (F.col("size") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.left("word", first).alias("key")),
        F.struct(F.lit(1).alias("half"), F.right("word", last).alias("key")),
    )
    rows = rows.select("word", "n", "size", F.inline(halves))
    large = rows.groupBy("size", "half", "key").count().where(F.col("count") > GROUP)
    rows = rows.join(large, ["size", "half", "key"], "left")
    slices = F.coalesce(F.ceil(F.col("count") / (GROUP // 2)), F.lit(1)).cast("int")
    rows = rows.withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other")
    rows = rows.select("size", "half", "key", "slice", other, "word", "n")
    return rows.withColumn("tile", F.array(F.least("slice", "other"), F.greatest("slice", "other"))).drop("other")


def one_edit(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs ``(i, j)`` of words one edit apart: each pair once, the shorter word first."""
    n = len(texts)
    size = np.array([len(t) for t in texts])
    most = int(size.max(initial=0))
    letters = np.zeros((n, most), np.int64)
    letters[np.arange(most) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    alphabet, code = np.unique(letters, return_inverse=True)
    code = code.reshape(n, most)
    slot = np.arange(most) * len(alphabet) + code  # (position, letter)
    present = np.unique(slot[letters > 0])
    # bit w of row r: word w has the position and letter of slot r; the last row is empty
    member = np.zeros((len(present) + 1, -(-n // 64) * 64), bool)
    who, where = np.nonzero(letters)
    member[np.searchsorted(present, slot[who, where]), who] = True
    index = np.packbits(member, axis=1, bitorder="little").view(np.uint64)

    def having(position: int, shift: int) -> np.ndarray:
        """For each word, the set of words with its letter at ``position`` ``shift`` places on."""
        wanted = slot[:, position] + shift * len(alphabet)
        row = np.searchsorted(present, wanted)
        row = np.where((row < len(present)) & (present[np.minimum(row, len(present) - 1)] == wanted), row, len(present))
        return index[row]

    def of_size(sizes: np.ndarray) -> np.ndarray:
        return np.packbits(np.pad(size == sizes[:, None], ((0, 0), (0, -n % 64))), axis=1, bitorder="little").view(np.uint64)

    exact = np.full((n, index.shape[1]), np.uint64(2**64 - 1))
    replaced, inserted = np.zeros_like(exact), np.zeros_like(exact)
    for position in range(most):
        live = (size > position)[:, None]  # words that have ended keep their sets
        here, further = having(position, 0), having(position, 1)
        replaced = np.where(live, (replaced & here) | (exact & ~here), replaced)
        inserted = np.where(live, (inserted | exact) & further, inserted)
        exact = np.where(live, exact & here, exact)
    found = (replaced & of_size(size)) | ((inserted | exact) & of_size(size + 1))
    i, cell = np.nonzero(found)
    bits = np.unpackbits(found[i, cell].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    hit, bit = np.nonzero(bits)
    i, j = i[hit], cell[hit] * 64 + bit
    once = (size[i] < size[j]) | (i < j)
    return i[once], j[once]


def _pairs(filed: DataFrame) -> DataFrame:
    """``_PAIR``: words one edit apart, each pair in both directions."""

    def answer(groups: list[tuple]):
        name = [g[:4] for g in groups]
        texts, half, kept, size, n = [g[4] for g in groups], np.array([g[1] for g in groups]), np.array([g[5] for g in groups]), np.array([g[0] for g in groups]), np.array([g[6] for g in groups])
        group = np.cumsum([0] + [a != b for a, b in zip(name, name[1:], strict=False)])
        i, j = one_edit(texts)
        same = group[i] == group[j]
        i, j = i[same], j[same]
        # the shorter word has the group's length; two slices meet in their tile, words of one slice in its own
        across = np.array([g[3][0] != g[3][1] for g in groups])
        good = (np.array([len(texts[a]) for a in i], int) == size[i]) & (~across[i] | (kept[i] != kept[j]))
        good &= np.array([h == 0 or texts[a][: s // 2] != texts[b][: s // 2] for a, b, h, s in zip(i, j, half[i], size[i], strict=True)], bool)
        i, j = i[good], j[good]
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        if len(a):
            word = pa.array(texts, pa.string())
            yield pa.record_batch([word.take(pa.array(a)), pa.array(n[a]), word.take(pa.array(b)), pa.array(n[b])], names=["word", "n", "near", "near_n"])

    def run(batches):
        block, letters, group, name = [], 0, [], None

        def full(more: list) -> bool:
            added = sum(len(x[4]) for x in more)
            return len(block) + len(more) > BLOCK or (letters + added) * (len(block) + len(more)) > BLOCK_BYTES

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("size", "half", "key", "tile", "word", "slice", "n")), strict=True):
                if row[:4] != name:
                    if len(group) > 1:  # a word alone in its group has no partner there
                        if block and full(group):
                            yield from answer(block)
                            block, letters = [], 0
                        block += group
                        letters += sum(len(x[4]) for x in group)
                    group, name = [], row[:4]
                group.append(row)
        if len(group) > 1:
            block += group
        if block:
            yield from answer(block)

    return filed.mapInArrow(run, _PAIR)


def variants(vocabulary: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each ``word, n`` (distinct words of at least ``LEAST_LETTERS`` letters)."""
    vocabulary = materialize(vocabulary.select("word", "n"), "spelling-words")
    filed = _filed(vocabulary).repartition("size", "half", "key", "tile").sortWithinPartitions("size", "half", "key", "tile", "word")
    near = _pairs(filed).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = vocabulary.join(near, "word", "left")
    form_n = -F.col("best.less")
    takes = form_n >= ODDS * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, form_n).alias("form_n"))
    rows = materialize(rows, "spelling-forms")
    # each step multiplies the count, so a chain has few steps; every round doubles what is followed
    follow = rows.where("form is not null").select("word", F.col("form").alias("root"))
    most = rows.agg(F.max("n")).first()[0] or 1
    steps = int(math.log(most, ODDS)) + 1
    for _ in range(math.ceil(math.log2(steps + 1))):
        onward = follow.select(F.col("word").alias("root"), F.col("root").alias("next"))
        follow = materialize(follow.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    done = rows.join(follow, "word", "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """Near words, form and root of every word of all texts of ``documents`` (``doc_id``, ``text``)."""
    return variants(words(documents))
