"""Language-model scoring with a weighted backoff automaton over all counts of the corpus.

Tokens are words without white space, lower-cased A-Z, then one end token a text. Training
counts every token, pair and triple of every training text; none is dropped. Unigrams are
smoothed by adding one half (with one unseen type). Histories of one and two words are the
automaton's states. Behind a history of count n, a token seen c times has the probability
``(c + m * p) / (n + m)``, where p is its probability behind the next shorter history and m
is ``PRIOR``: arcs of a state are the tokens with c > 0, its failure arc leads to the
shorter history with the weight ``m / (n + m)``. Each history is a proper distribution. A
text's score is the sum of log10 probabilities along its path.

The automaton of a large corpus fits no task, so each block of texts gets the part of it
that its own n-grams name:

1. Texts are dealt into blocks by a hash of the whole row. A block asks for the counts of
   its distinct tokens and pairs: a sorted list of 64-bit keys for each range of keys, with
   the block's own counts. A frequent key costs each block one entry, however often it
   stands there, so no key is hot.
2. Lists of one range meet in one task, which adds the counts up and answers each list in
   its own order, mostly with one byte a key.
3. A triple can stand twice only if both of its pairs do. Blocks ask for those triples in
   the same way; for all others the block's own count is the corpus's.
4. With all answers a block builds its states and arcs and takes every text through them,
   left to right. The state before a token depends on the last two tokens alone, so the
   states of all tokens are found at once.

Number and size of blocks and ranges follow the input: neither grows with it. Nothing but
two totals comes to the driver.

Edge cases: null and empty texts are one end token; without training text N and V are 0
and an unseen token has probability one; repeated rows are scored each on its own;
further columns are ignored; n-grams are told apart by a 64-bit hash of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import NOT_SPACE, Texts, mix, sums_by, texts_of, word_hashes, words_of
from .shared import fold, materialize

PRIOR = {2: 1000.0, 3: 10.0}  # the weight of the shorter history, in tokens
BLOCK_BYTES = 2_000_000
RANGE_BYTES = 6_000_000  # bytes of text for each range of keys

_END = mix(np.array([0x0E4D], np.uint64))[0]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' hashes, end tokens included, and where each text's begin."""
    w = words_of(t, NOT_SPACE)
    ids = np.full(w.n + t.n, _END)
    ids[np.arange(w.n) + w.doc] = word_hashes(t, w)
    return ids, w.first + np.arange(t.n + 1)


def ngram_keys(ids: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
    """For n of 1 to 3, the key of the n-gram that ends at each token; 0 where the text begins later."""
    at = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    keys = {1: np.maximum(mix(ids), np.uint64(1))}
    for n in (2, 3):
        k = np.zeros(len(ids), np.uint64)
        k[1:] = np.maximum(mix(keys[n - 1][:-1] * _STEP + ids[1:] + np.uint64(n)), np.uint64(1))
        k[at < n - 1] = 0
        keys[n] = k
    return keys


def packed(values: np.ndarray) -> bytes:
    """Counts in one byte each; those of 255 or more follow in eight."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<i8").tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<i8", offset=n)
    return out


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps of as many bytes as the largest needs, lowest bytes first: the highest are mostly zeros."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(gaps[1:].max() if len(gaps) > 1 else 1).bit_length() // 8))
    return keys[:1].astype("<u8").tobytes() + gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked_keys(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n > 1:
        out[1:, : (len(blob) - 8) // (n - 1)] = np.frombuffer(blob, np.uint8, offset=8).reshape(-1, n - 1).T
    out = out.view("<u8").ravel()
    out[0] = np.frombuffer(blob, "<u8", 1)[0]
    return np.cumsum(out, dtype=np.uint64)


@dataclass
class Block:
    """The n-grams of some texts: distinct keys, each token's place among them, own counts, and answers."""

    first: np.ndarray
    distinct: dict[int, np.ndarray]
    place: dict[int, np.ndarray]
    train: dict[int, np.ndarray]  # by distinct key: how often it stands in training texts
    all: dict[int, np.ndarray]
    count: dict[int, np.ndarray]  # by distinct key: its count in all training texts
    twice: dict[int, np.ndarray]  # whether it stands twice or more in all texts

    @classmethod
    def of(cls, t: Texts, train: np.ndarray) -> Block:
        ids, first = tokens(t)
        b = cls(first, {}, {}, {}, {}, {}, {})
        weight = np.repeat(train, np.diff(first))
        for n, keys in ngram_keys(ids, first).items():
            b.distinct[n], place = np.unique(keys, return_inverse=True)
            b.place[n] = place.ravel()
            b.train[n] = np.bincount(b.place[n], weight, len(b.distinct[n])).astype(np.int64)
            b.all[n] = np.bincount(b.place[n], minlength=len(b.distinct[n]))
        return b

    def asked(self, n: int) -> np.ndarray:
        """The distinct n-grams whose counts the block cannot know: for triples, those with two pairs that stand twice."""
        ask = self.distinct[n] != 0
        if n == 3:
            pair = self.twice[2][self.place[2]]
            both = np.zeros(len(pair), bool)
            both[1:] = pair[1:] & pair[:-1]
            can = np.zeros(len(ask), bool)
            can[self.place[3][both]] = True
            ask &= can
        return np.flatnonzero(ask)

    def answer(self, n: int, count: np.ndarray, twice: np.ndarray) -> None:
        at = self.asked(n)
        self.count[n], self.twice[n] = self.train[n].copy(), np.zeros(len(self.distinct[n]), bool)
        self.count[n][at], self.twice[n][at] = count, twice
        self.count[n][self.distinct[n] == 0] = 0

    def walk(self, total: int, types: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of all tokens, alone and along the path through the automaton."""
        c = {n: self.count[n][self.place[n]] for n in (1, 2, 3)}
        with np.errstate(divide="ignore"):
            base = np.log10((c[1] + 0.5) / (total + 0.5 * (types + 1)))
        path = base
        for n in (2, 3):
            state = np.zeros(len(base), np.int64)  # the count of the history before each token
            state[1:] = np.where(self.distinct[n][self.place[n][1:]] != 0, c[n - 1][:-1], 0)
            arc = np.log10((c[n] + PRIOR[n] * 10.0**path) / (state + PRIOR[n]))
            failure = np.log10(PRIOR[n] / (state + PRIOR[n])) + path
            path = np.where(c[n] > 0, arc, failure)
        return base, path


def _dealt(docs: DataFrame, held_out_fold: int | None) -> tuple[DataFrame, int]:
    """``doc_id, text, train, block`` of all rows, and the number of key ranges."""
    held = (fold("doc_id") == held_out_fold) if held_out_fold is not None else F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("train", ~held)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(8)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, size // BLOCK_BYTES)
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))), max(1, size // RANGE_BYTES)


_ANSWER = "block long, part int, n int, piece int, k int, counts binary, twice binary"


def _blocks(dealt: DataFrame, answers: DataFrame | None, known: tuple[int, ...], schema: str, emit) -> DataFrame:
    """``emit(block, piece, doc_ids, Block)`` for every block, with the answers to it for n in ``known``.

    Texts of one block come in one order always; a block that is too large (repeated rows
    share one) is taken in pieces of bounded size.
    """
    texts = dealt.selectExpr("block", "1 AS kind", "0 AS part", "0 AS n", "0 AS piece", "0 AS k", "CAST(NULL AS BINARY) AS counts", "CAST(NULL AS BINARY) AS twice", "doc_id", "text", "train")
    if answers is not None:
        texts = texts.union(answers.selectExpr("block", "0 AS kind", "part", "n", "piece", "k", "counts", "twice", "CAST(NULL AS BIGINT)", "CAST(NULL AS STRING)", "CAST(NULL AS BOOLEAN)"))
    rows = texts.repartition("block").sortWithinPartitions("block", "kind", "n", "piece", "part", "doc_id", F.xxhash64("text"))

    def pieces(batches: Iterator[pa.RecordBatch]):
        """(block, piece number, answers, text rows), block by block."""
        block, number, told, held, size = None, 0, {}, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            of, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if block is not None and of[lo] != block:
                    if held:
                        yield block, number, told, pa.concat_batches(held)
                    number, told, held, size = 0, {}, [], 0
                block = int(of[lo])
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    for n, piece, k, counts, twice in zip(*(part.column(x).to_pylist() for x in ("n", "piece", "k", "counts", "twice")), strict=True):
                        told.setdefault((piece, n), []).append((unpacked(counts, k), np.unpackbits(np.frombuffer(twice, np.uint8), count=k).astype(bool)))
                    continue
                bounds = texts_of(part.column("text")).at
                at = 0
                while at < part.num_rows:
                    room = bounds[at] + 2 * BLOCK_BYTES - size
                    end = max(int(np.searchsorted(bounds, room, "right")) - 1, at + (not held))
                    if end > at:
                        held.append(part.slice(at, end - at))
                        size += int(bounds[end] - bounds[at])
                        at = end
                    if at < part.num_rows:
                        yield block, number, told, pa.concat_batches(held)
                        number, held, size = number + 1, [], 0
        if held:
            yield block, number, told, pa.concat_batches(held)

    def run(batches):
        for block, piece, told, some in pieces(batches):
            b = Block.of(texts_of(some.column("text")), some.column("train").to_numpy(zero_copy_only=False).astype(float))
            none = np.zeros(0, np.int64)
            for n in known:
                parts = told.get((piece, n), [])
                b.answer(n, np.concatenate([c for c, _ in parts] or [none]), np.concatenate([x for _, x in parts] or [none.astype(bool)]))
            yield from emit(block, piece, some.column("doc_id"), b)

    return rows.mapInArrow(run, schema)


_REQUEST = "part int, block long, n int, piece int, k int, keys binary, train binary, held_out binary"


def _requests(dealt: DataFrame, answers: DataFrame | None, orders: tuple[int, ...], ranges: int) -> DataFrame:
    """The sorted keys that each block asks for, cut by key range, with the block's counts."""

    def emit(block, piece, doc_ids, b: Block):
        out = []
        for n in orders:
            at = b.asked(n)
            keys = b.distinct[n][at]
            part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cut = np.append(np.flatnonzero(np.diff(part, prepend=np.uint64(2**40))), len(keys))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                out.append((int(part[lo]), block, n, piece, hi - lo, packed_keys(keys[lo:hi]), packed(b.train[n][at[lo:hi]]), packed((b.all[n] - b.train[n])[at[lo:hi]])))
        cols = list(zip(*out, strict=True)) if out else [()] * 8
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "block", "n", "piece", "k", "keys", "train", "held_out"])

    return _blocks(dealt, answers, () if answers is None else (1, 2), _REQUEST, emit)


def _answers(requests: DataFrame) -> DataFrame:
    """As in ``_ANSWER``, for each list of ``requests``; and for each range, with a null block, its training types (k) and tokens (counts) by n."""

    def reply(lists: list[tuple]):
        keys = np.concatenate([unpacked_keys(x[5], x[4]) for x in lists])
        distinct, place = np.unique(keys, return_inverse=True)
        place = place.ravel()
        train = np.bincount(place, np.concatenate([unpacked(x[6], x[4]) for x in lists]), len(distinct)).astype(np.int64)
        twice = train + np.bincount(place, np.concatenate([unpacked(x[7], x[4]) for x in lists]), len(distinct)) > 1
        order = np.zeros(len(distinct), np.int64)
        order[place] = np.repeat([x[2] for x in lists], [x[4] for x in lists])
        end = np.cumsum([x[4] for x in lists])
        out = [(x[1], x[0], x[2], x[3], x[4], packed(train[place[e - x[4] : e]]), np.packbits(twice[place[e - x[4] : e]]).tobytes()) for x, e in zip(lists, end, strict=True)]
        for n in np.unique(order):
            seen = train[(order == n) & (train > 0)]
            out.append((None, lists[0][0], int(n), 0, len(seen), int(seen.sum()).to_bytes(8, "big"), b""))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "part", "n", "piece", "k", "counts", "twice"])

    def run(batches):
        lists: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lists and row[0] != lists[0][0]:
                    yield reply(lists)
                    lists = []
                lists.append(row)
        if lists:
            yield reply(lists)

    return requests.repartition("part").sortWithinPartitions("part").mapInArrow(run, _ANSWER)


def score(docs: DataFrame, held_out_fold: int | None = 1) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trains on the rows outside ``held_out_fold`` (of 5; None: on all rows).
    """
    dealt, ranges = _dealt(docs, held_out_fold)
    told = materialize(_answers(_requests(dealt, None, (1, 2), ranges)), "lm-counts")
    size = told.where("block is null and n = 1").selectExpr("coalesce(sum(k), 0) AS v", "coalesce(sum(cast(conv(hex(counts), 16, 10) as bigint)), 0) AS n").first()
    total, types = int(size["n"]), int(size["v"])
    told = told.where("block is not null")
    told = told.union(materialize(_answers(_requests(dealt, told, (3,), ranges)), "lm-triples").where("block is not null"))

    def emit(block, piece, doc_ids, b: Block):
        base, path = b.walk(total, types)
        known = b.count[1][b.place[1]] > 0
        sums = [sums_by(x.astype(float), b.first) for x in (known, base, path)]
        yield pa.record_batch([doc_ids, pa.array(np.diff(b.first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    done = _blocks(dealt, told, (1, 2, 3), "doc_id long, n_tokens long, n_known long, base_score double, score double", emit)
    held = (fold("doc_id") == held_out_fold) if held_out_fold is not None else F.lit(False)
    return done.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
