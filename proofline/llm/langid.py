"""Language identification of mixed-language text.

Each word gets a score in each language from hashed character n-grams (naive Bayes
counts of the training rows). The word's script, from ranges of its first letter, first
narrows the candidates to languages seen in that script. Viterbi with a fixed switching
penalty then labels the words, so a text is cut into spans of one language; the
prediction is the language that covers most letters, whatever their size in bytes.

The model is fitted on a bounded sample: about ``TRAIN_ROWS`` labelled rows of each
language. All texts, those of the sample too, are read whole.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; ties go to
the first language in alphabetical order; without training rows all is ``und``; repeated
rows get equal answers; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LETTER, LOWER, Texts, Words, mix, prefix_sums, slices, span_hash, sums_by, words_of
from .shared import bounded_sample, fold

BUCKETS = 1 << 17
GRAMS = (1, 2, 3, 4)
TRAIN_ROWS = 600
SWITCH = 8.0  # nats a change of language costs
ALPHA = 0.5
UNKNOWN = "und"

#: Script ranges (first code point, last code point); anything else is "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_NAMES = [*SCRIPTS, "other"]
_EDGES = np.array(sorted((lo, hi, _NAMES.index(k)) for k, spans in SCRIPTS.items() for lo, hi in spans))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages, log probabilities
    scripts: np.ndarray  # scripts x languages, whether seen


def scripts_of(t: Texts, w: Words) -> np.ndarray:
    """The script number of each word's first character."""
    pad = np.concatenate([t.buf, np.zeros(4, np.uint8)]).astype(np.int64)
    b0, b1, b2, b3 = (pad[w.start + i] for i in range(4))
    code = np.select(
        [b0 < 0x80, b0 < 0xE0, b0 < 0xF0],
        [b0, ((b0 & 31) << 6) | (b1 & 63), ((b0 & 15) << 12) | ((b1 & 63) << 6) | (b2 & 63)],
        ((b0 & 7) << 18) | ((b1 & 63) << 12) | ((b2 & 63) << 6) | (b3 & 63),
    )
    k = np.searchsorted(_EDGES[:, 0], code, "right") - 1
    inside = (k >= 0) & (code <= _EDGES[np.maximum(k, 0), 1])
    return np.where(inside, _EDGES[np.maximum(k, 0), 2], len(_NAMES) - 1)


def grams(t: Texts, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each word with its two edges, and each word's first."""
    # words laid out one after another with a space before and after each
    length = w.end - w.start
    room = length + 2
    first = np.zeros(w.n + 1, np.int64)
    np.cumsum(room, out=first[1:])
    flat = np.full(first[-1], 0x20, np.uint8)
    source = np.arange(length.sum()) + np.repeat(w.start - (np.cumsum(length) - length), length)
    target = np.arange(length.sum()) + np.repeat(first[:-1] + 1 - (np.cumsum(length) - length), length)
    flat[target] = LOWER[t.buf[source]]
    sums = prefix_sums(flat)
    left = np.repeat(first[1:], room) - np.arange(first[-1])  # bytes from here to the word's end
    out = np.full((first[-1], len(GRAMS)), -1, np.int32)
    for j, k in enumerate(GRAMS):
        ok = np.flatnonzero(left >= k)
        out[ok, j] = (mix(span_hash(sums, ok, ok + k) + np.uint64(k)) >> np.uint64(47)).astype(np.int32)
    return out, first


def word_scores(m: Model, t: Texts, w: Words) -> np.ndarray:
    """Log scores (words x languages); each distinct word is scored once."""
    h = span_hash(prefix_sums(LOWER[t.buf]), w.start, w.end)
    _, sample, back = np.unique(h, return_index=True, return_inverse=True)
    some = Words(w.start[sample], w.end[sample], w.doc[sample], w.first)
    g, first = grams(t, some)
    padded = np.vstack([m.table, np.zeros((1, len(m.langs)), m.table.dtype)])
    per_byte = padded[g[:, 0]]
    for j in range(1, g.shape[1]):
        per_byte = per_byte + padded[g[:, j]]
    s = sums_by(per_byte, first)
    seen = m.scripts[scripts_of(t, some)]
    seen = seen | ~seen.any(axis=1, keepdims=True)  # a script never seen narrows nothing
    return np.where(seen, s, s - 1000.0)[back.ravel()]


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; all texts advance together, word by word."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    longest = int(n[order[0]]) if len(n) else 0
    k = scores.shape[1]
    came = np.zeros(scores.shape, np.int32 if k > 127 else np.int8)
    best = np.zeros((len(n), k))
    alive = np.searchsorted(-n[order], -np.arange(1, longest + 1), "right")  # texts with a word t
    at = first[:-1][order]
    own = np.arange(k, dtype=came.dtype)
    for step in range(longest):
        a = alive[step]
        v = best[:a]
        rows = at[:a] + step
        if step:
            top = v.argmax(axis=1)
            jump = v[np.arange(a), top] - switch
            stay = v >= jump[:, None]
            came[rows] = np.where(stay, own, top[:, None].astype(came.dtype))
            v = np.where(stay, v, jump[:, None])
        v = v + scores[rows]
        best[:a] = v - v.max(axis=1, keepdims=True)
    path = np.zeros(len(scores), came.dtype)
    state = best.argmax(axis=1).astype(came.dtype)
    for step in range(longest - 1, -1, -1):
        a = alive[step]
        rows = at[:a] + step
        path[rows] = state[:a]
        state[:a] = came[rows, state[:a]]
    return path


def letters(t: Texts, w: Words) -> np.ndarray:
    """The number of characters of each word."""
    begun = np.zeros(len(t.buf) + 1, np.int64)
    np.cumsum((t.buf & 0xC0) != 0x80, out=begun[1:])
    return begun[w.end] - begun[w.start]


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def train(docs: DataFrame, *, held_out_fold: int | None = 0) -> Model:
    """Counts of n-grams by language over a bounded sample outside ``held_out_fold`` (of 5)."""
    known = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where("lang is not null and text is not null")
    if held_out_fold is not None:
        known = known.where(fold("id") != held_out_fold)
    sample = bounded_sample(known, "id", TRAIN_ROWS, group=F.col("lang"))

    def run(batches):
        for rows, t in slices(batches):
            w = words_of(t, LETTER)
            g, first = grams(t, w)
            script = scripts_of(t, w)
            lang = np.array(rows.column("lang").to_pylist(), object)
            word_lang = lang[w.doc]
            for name in sorted(set(lang)):
                mine = word_lang == name
                b = g[np.repeat(mine, np.diff(first))].ravel()
                ids, n = np.unique(b[b >= 0], return_counts=True)
                s, k = np.unique(script[mine], return_counts=True)
                ids, n = np.concatenate([ids, -1 - s]), np.concatenate([n, k])
                yield pa.record_batch([pa.array([name] * len(ids)), pa.array(ids.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "bucket", "n"])

    counts = sample.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.toArrow().to_pydict()  # at most (languages x buckets) rows
    langs = sorted(set(rows["lang"]))
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in rows["lang"]], int)
    bucket, n = np.array(rows["bucket"], int), np.array(rows["n"], float)
    table = np.full((BUCKETS, len(langs)), ALPHA)
    gram = bucket >= 0
    table[bucket[gram], lang[gram]] += n[gram]
    table = np.log(table / table.sum(axis=0, keepdims=True)) if langs else table
    if langs:  # only differences matter; buckets nobody has seen then say nothing
        table -= table.mean(axis=1, keepdims=True)
    scripts = np.zeros((len(_NAMES), len(langs)))
    scripts[-1 - bucket[~gram], lang[~gram]] = n[~gram]
    total = scripts.sum(axis=0, keepdims=True)
    return Model(langs, table.astype(np.float32), scripts > 0.001 * total)


def _label(m: Model, t: Texts) -> tuple[Words, np.ndarray]:
    w = words_of(t, LETTER)
    if not m.langs or not w.n:
        return w, np.zeros(w.n, np.int8)
    return w, viterbi(word_scores(m, t, w), w.first)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, n_spans``; score is the share of letters in that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for rows, t in slices(batches):
            w, path = _label(m, t)
            size = letters(t, w).astype(float)
            cover = np.stack([sums_by(np.where(path == k, size, 0.0), w.first) for k in range(len(m.langs))] or [np.zeros(t.n)], axis=1)
            total = cover.sum(axis=1)
            top = cover.argmax(axis=1) if m.langs else np.zeros(t.n, int)
            some = (w.per_text() > 0) & bool(m.langs)
            ascii_word = sums_by((t.buf[w.start] < 0x80).astype(float), w.first) > 0 if w.n else np.zeros(t.n, bool)
            for i in np.flatnonzero(some & ~ascii_word):
                some[i] = _has_letter(t.buf[t.at[i] : t.at[i + 1]].tobytes())
            new = np.ones(w.n, float)
            new[1:] = (path[1:] != path[:-1]) | (w.doc[1:] != w.doc[:-1])
            spans = sums_by(new, w.first)
            yield pa.record_batch(
                [
                    rows.column("doc_id"),
                    pa.array(names[np.where(some, top, len(m.langs))], pa.string()),
                    pa.array(np.where(some, cover[np.arange(t.n), top] / np.maximum(total, 1), 0.0)),
                    pa.array(np.where(some, spans, 0).astype(np.int64)),
                ],
                names=["doc_id", "lang_pred", "score", "n_spans"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, n_spans long")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang, start, end, text``: the stretches of one language (UTF-8 byte offsets)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for rows, t in slices(batches):
            w, path = _label(m, t)
            path = path if m.langs else np.full(w.n, 0)
            new = np.ones(w.n, bool)
            new[1:] = (path[1:] != path[:-1]) | (w.doc[1:] != w.doc[:-1])
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], w.n) - 1
            base = t.at[w.doc[lo]]
            raw = t.buf.tobytes()
            yield pa.record_batch(
                [
                    rows.column("doc_id").take(pa.array(w.doc[lo])),
                    pa.array(names[path[lo]], pa.string()),
                    pa.array(w.start[lo] - base),
                    pa.array(w.end[hi] - base),
                    pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[lo], w.end[hi], strict=True)], pa.string()),
                ],
                names=["doc_id", "lang", "start", "end", "text"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang string, start long, end long, text string")


def language_id(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, n_spans."""
    found = predict(docs, train(docs))
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "n_spans")
