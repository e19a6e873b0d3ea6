"""SentencePiece encoding and decoding, with exact N-best segmentation.

The pieces come from a public model file, read once on the driver; their table (fixed
size) is broadcast. A piece's score is its Zipf log probability, by its place in the
vocabulary; characters without a piece fall back to their UTF-8 byte pieces. Blanks
belong to the word behind them and no piece crosses a word, so the lattice of a text is
a chain of word lattices.

Within a word, forward Viterbi scores of all prefixes are computed first. They are exact
heuristics for an A-star search backwards from the word's end, which pops complete
segmentations in descending order of score; its agenda never holds more hypotheses
than answers are wanted. The best segmentations of a text combine
those of its words with a heap over which word deviates. Words recur, so each task keeps
the answers for words in a two-generation cache of bounded size.

Edge cases: null and empty texts have no pieces and score 0; all other texts decode to
themselves exactly (a literal U+2581 goes through byte pieces); a text with one
segmentation only has no second score (null); ties go to the first path found, which
depends on the text alone; repeated rows get equal answers; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from bisect import insort
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 2
CACHE_WORDS = 300_000
LONGEST_CACHED = 64

MARK = "▁"
#: Stretches that no piece crosses: by blanks alone, or also between letters and other signs.
_BY_BLANK = " *[^ \n▁]+| +|\n|▁"
_BY_KIND = r" *(?:[^\W\d_²³¹]+|(?:(?![ \n▁])[\W\d_²³¹])+)| +|\n|▁"


@dataclass
class Pieces:
    """``score[piece] = (id, log probability)``; ``raw[id]``: the bytes a piece stands for."""

    score: dict[str, tuple[int, float]]
    raw: list[bytes]
    byte: list[int]
    byte_score: float
    root: dict | None = field(default=None, repr=False)
    unit: re.Pattern = field(default_factory=lambda: re.compile(_BY_BLANK))


@lru_cache(maxsize=4)
def load(path: str = MODEL_PATH) -> Pieces:
    """The vocabulary of a SentencePiece model with byte pieces."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    score, raw, byte = {}, [], [0] * 256
    total = sum(1 / k for k in range(1, n + 1))
    for i in range(n):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i):
            raw.append(b"")
        else:
            score[piece] = (i, -log((i + 1) * total))
            raw.append(piece.replace(MARK, " ").encode())
    kind = re.compile(_BY_KIND)
    whole = all(len(kind.findall(piece.replace(MARK, " "))) == 1 for piece in score if piece != MARK)
    return Pieces(score, raw, byte, -log((n + 1) * total) - 10.0, unit=kind if whole else re.compile(_BY_BLANK))


def trie(p: Pieces) -> dict:
    """The pieces as nested dictionaries by character; "" holds a piece's (id, score)."""
    if p.root is None:
        p.root = {}
        for piece, entry in p.score.items():
            node = p.root
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = entry
    return p.root


def word_nbest(p: Pieces, unit: str, n: int) -> list[tuple[tuple[int, ...], float]]:
    """The ``n`` best segmentations of one unit as (piece ids, score), best first."""
    if unit == MARK:
        ids = tuple(p.byte[b] for b in unit.encode())
        return [(ids, p.byte_score * len(ids))]
    s = unit.replace(" ", MARK)
    size, root = len(s), p.root or trie(p)
    best: list = [None] * (size + 1)
    best[0] = 0.0
    arcs: list[list] = [[] for _ in range(size + 1)]
    for i in range(size):
        here, node, j, alone = best[i], root, i, False
        while j < size:
            node = node.get(s[j])
            if node is None:
                break
            j += 1
            hit = node.get("")
            if hit is not None:
                arcs[j].append((i, hit[1], hit[0]))
                f = here + hit[1]
                if best[j] is None or f > best[j]:
                    best[j] = f
                alone |= j == i + 1
        if not alone:  # no piece for this character alone
            raw = (" " if s[i] == MARK else s[i]).encode("utf-8", "surrogatepass")
            cost = p.byte_score * len(raw)
            arcs[i + 1].append((i, cost, tuple(p.byte[b] for b in raw)))
            if best[i + 1] is None or here + cost > best[i + 1]:
                best[i + 1] = here + cost
    # the agenda: at most as many hypotheses as answers are still wanted, best first. Each
    # score is that of a whole segmentation, so what falls off can never be an answer.
    agenda: list = [(-best[size], 0, size, 0.0, None)]
    found: list = []
    turn = 0
    while agenda and len(found) < n:
        f, _, j, g, link = agenda.pop(0)
        if j == 0:
            ids: list[int] = []
            while link is not None:
                ids.extend(link[0]) if type(link[0]) is tuple else ids.append(link[0])
                link = link[1]
            found.append((tuple(ids), -f))
            continue
        room = n - len(found)
        for i, sc, name in arcs[j]:
            f = -(best[i] + sc + g)
            if len(agenda) < room or f < agenda[-1][0]:
                turn += 1
                insort(agenda, (f, turn, i, sc + g, (name, link)))
                if len(agenda) > room:
                    agenda.pop()
    return found


def units(p: Pieces, text: str) -> list[str]:
    """The text, with a blank before it, cut where no piece can cross."""
    return p.unit.findall(" " + text) if text else []


def text_nbest(p: Pieces, text: str, n: int) -> list[tuple[list[int], float]]:
    """The ``n`` best segmentations of a whole text as (ids, score), best first."""
    words = [word_nbest(p, u, n) for u in units(p, text)]
    if not words:
        return [([], 0.0)]
    best = [((), 0.0)]
    picked: list[tuple[tuple, float]] = best
    for options in words:  # k-best sums, one word after another
        heap = [(-(s + options[0][1]), i, 0) for i, (_, s) in enumerate(picked)]
        heapq.heapify(heap)
        fresh = []
        while heap and len(fresh) < n:
            f, i, k = heapq.heappop(heap)
            fresh.append(((picked[i][0], options[k][0]), -f))
            if k + 1 < len(options):
                heapq.heappush(heap, (-(picked[i][1] + options[k + 1][1]), i, k + 1))
        picked = fresh
    out = []
    for link, s in picked:
        parts = []
        while link:
            parts.append(link[1])
            link = link[0]
        out.append(([i for part in reversed(parts) for i in part], s))
    return out


def decode(p: Pieces, ids) -> str:
    """The text of a sequence of ids; the blank put before the text is taken off."""
    raw = b"".join(map(p.raw.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class Encoder:
    """Best ids, score and distance to the second best of texts, with a bounded cache of words."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.young, self.old = pieces, {}, {}

    def _miss(self, unit: str) -> tuple[bytes, float, float]:
        entry = self.young.get(unit) or self.old.get(unit)
        if entry is None:
            found = word_nbest(self.pieces, unit, 2)
            gap = found[0][1] - found[1][1] if len(found) > 1 else float("inf")
            entry = (array("I", found[0][0]).tobytes(), found[0][1], gap)
        if len(unit) <= LONGEST_CACHED:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[unit] = entry
        return entry

    def encode(self, text: str | None) -> tuple[array, float, float]:
        known, miss = self.young.get, self._miss
        entries = [known(u) or miss(u) for u in units(self.pieces, text or "")]
        ids = array("I")
        ids.frombytes(b"".join([e[0] for e in entries]))
        return ids, sum([e[1] for e in entries]), min([e[2] for e in entries], default=float("inf"))


def encode(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, ids, score, second_score``: the best segmentation, and the second's score."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches):
        e = Encoder(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(texts), 500):
                rows = [e.encode(t) for t in texts[lo : lo + 500]]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(lo, 500),
                        pa.ListArray.from_arrays(np.cumsum([0, *(len(r[0]) for r in rows)], dtype=np.int32), pa.array(np.concatenate([np.asarray(r[0]) for r in rows]).astype(np.int32))),
                        pa.array([r[1] for r in rows], pa.float64()),
                        pa.array([r[1] - r[2] if r[2] != float("inf") else None for r in rows], pa.float64()),
                    ],
                    names=["doc_id", "ids", "score", "second_score"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, score double, second_score double")


def decode_ids(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches):
        p = shared.value
        for batch in batches:
            texts = [decode(p, ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def nbest(docs: DataFrame, n: int, model_path: str = MODEL_PATH) -> DataFrame:
    """``doc_id, rank, ids, score``: the ``n`` best segmentations of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches):
        p = shared.value
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = text_nbest(p, text or "", n)
                yield pa.record_batch(
                    [pa.array([doc_id] * len(found), pa.int64()), pa.array(range(1, len(found) + 1), pa.int32()), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.float64())],
                    names=["doc_id", "rank", "ids", "score"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, rank int, ids array<int>, score double")


def summary(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """Per row: doc_id, n_pieces, score, second_score, ids_sha256, restored.

    The digest is over the ids as 32-bit little-endian numbers.

    ``restored`` tells whether decoding the ids gives the text (null: empty) back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches):
        e = Encoder(shared.value)
        for batch in batches:
            n, best, second, digest, same = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids, score, gap = e.encode(text)
                n.append(len(ids))
                best.append(score)
                second.append(score - gap if gap != float("inf") else None)
                digest.append(hashlib.sha256(ids.tobytes()).hexdigest())
                same.append(decode(e.pieces, ids) == (text or ""))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(second, pa.float64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_pieces", "score", "second_score", "ids_sha256", "restored"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_pieces long, score double, second_score double, ids_sha256 string, restored boolean")
