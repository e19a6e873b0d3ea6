"""Toxicity by multiple-instance learning: a leaky noisy-or over sentence scores.

A document is a bag of sentences (stretches between ``.``, ``!``, ``?`` and line breaks)
and is toxic if at least one of them is. A sentence's score is the logistic of a linear
model over its hashed words and word beginnings; the document's is
``1 - (1 - leak) * prod(1 - p_s)``. Weights, bias and leak are fitted together by
gradient descent on document labels alone, and the same sentence scores then locate the
offending sentences.

The model is fitted on a bounded sample: about ``TRAIN_ROWS`` labelled rows of each
class, fewer where their texts would come to more than ``TRAIN_BYTES`` bytes in all. Rows are
picked by a hash of their id, whatever their length. Everything reads whole texts.

Edge cases: null and empty texts have no sentence and score the leak; without labelled
rows of both classes nothing is learned and every score is the prior leak; a doc_id
labelled twice counts as its largest label; repeated rows score alike; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, LOWER, Texts, Words, byte_class, mix, prefix_sums, slices, span_hash, sums_by, words_of
from .shared import fold, materialize

BUCKETS = 1 << 20
BEGINNINGS = (3, 4, 5, 6, 7, 8)  # bytes of a longer word that are features of their own
TRAIN_ROWS = {0: 3000, 1: 1500}
TRAIN_BYTES = {0: 9_000_000, 1: 6_000_000}
LEAST_ROWS = 3  # features of fewer sampled documents are left out
LEAST_EVIDENCE = 10.0  # and those whose documents' labels look like chance
EPOCHS, STEP, DECAY = 150, 0.25, 2e-4
PRIOR_BIAS = -4.0

_STOP = byte_class((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float


def word_features(t: Texts, w: Words) -> np.ndarray:
    """A row of feature buckets for each word: itself and its beginnings (-1: too short)."""
    sums = prefix_sums(LOWER[t.buf])
    out = np.full((w.n, 1 + len(BEGINNINGS)), -1, np.int32)
    length = w.end - w.start
    out[:, 0] = (span_hash(sums, w.start, w.end) >> np.uint64(44)).astype(np.int32)
    for j, k in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(length >= k)
        h = span_hash(sums, w.start[long], w.start[long] + k)
        out[long, j] = (mix(h + np.uint64(k)) >> np.uint64(44)).astype(np.int32)
    return out


def sentences(t: Texts, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence that has words (with the total), and its text's number."""
    stops = np.zeros(len(t.buf) + 1, np.int64)
    np.cumsum(_STOP[t.buf], out=stops[1:])
    at = stops[w.start]
    new = np.ones(w.n, bool)
    new[1:] = (at[1:] != at[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(new)
    return np.append(first, w.n), w.doc[first]


def sentence_logits(model: Model, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    padded = np.append(model.weights, np.float32(0))  # bucket -1: the zero at the end
    return sums_by(padded[features].sum(axis=1), first) + model.bias


def noisy_or(logits: np.ndarray, first: np.ndarray, leak: float) -> np.ndarray:
    """Document scores from sentence logits; ``first`` has each document's first sentence."""
    miss = sums_by(np.logaddexp(0, logits), first) + np.logaddexp(0, leak)
    return -np.expm1(-miss)


def loss(theta: np.ndarray, label: np.ndarray, first: np.ndarray, s: np.ndarray, k: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the bags' labels with its penalty, and the gradient.

    ``theta``: feature weights, then bias and leak.
    """
    n, width = int(first[-1]), len(theta) - 2
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    z = np.bincount(s, theta[k], n) + theta[-2]
    p = np.clip(noisy_or(z, first, theta[-1]), 1e-12, 1)
    miss = sums_by(np.logaddexp(0, z), first) + np.logaddexp(0, theta[-1])  # -log(1 - p)
    value = np.where(label > 0, -np.log(p), miss).mean() + DECAY / 2 * (theta[:-2] ** 2).sum()
    pull = np.where(label > 0, -(1 - p) / p, 1.0)
    dz = sigmoid(z) * np.repeat(pull, np.diff(first))
    g = np.empty_like(theta)
    g[:-2] = np.bincount(k, dz[s], width)
    g[-2], g[-1] = dz.sum(), sigmoid(theta[-1]) * pull.sum()
    return float(value), g / len(label) + DECAY * theta * np.append(np.ones(width), [0, 0])


def fit(label: np.ndarray, first: np.ndarray, s: np.ndarray, k: np.ndarray, names: np.ndarray) -> Model:
    """Gradient descent (Adam) on bags of sentences.

    ``first`` has each bag's first sentence (with the total), ``s`` and ``k`` the sentence
    and the feature (as a place in ``names``) of every entry.
    """
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), PRIOR_BIAS, PRIOR_BIAS)
    theta = np.zeros(len(names) + 2)
    theta[-2:] = PRIOR_BIAS
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        g = loss(theta, label, first, s, k)[1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - step / (EPOCHS + 1))
    weights = np.zeros(BUCKETS, np.float32)
    weights[names] = theta[:-2]
    return Model(weights, float(theta[-2]), float(theta[-1]))


def training_sample(docs: DataFrame, labels: DataFrame, held_out_fold: int | None) -> DataFrame:
    """``toxic, text``: about ``TRAIN_ROWS`` rows of each label, outside ``held_out_fold`` (of 5)."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic in (0, 1)")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    if held_out_fold is not None:
        known = known.where(fold("id") != held_out_fold)
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    some = F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 30))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, rows in TRAIN_ROWS.items() for x in (k, min(1.0, rows / max(1, counts.get(k, 0))))])
    picked = known.where(some < F.element_at(share, F.col("toxic")) * (1 << 30))
    found = materialize(text.join(F.broadcast(picked), "id"), "toxic-sample")  # at most some thousand ids
    sizes = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, rows in TRAIN_ROWS.items() for x in (k, min(1.0, rows / max(1, counts.get(k, 0))) * min(1.0, TRAIN_BYTES[k] / max(1, sizes.get(k) or 0)))])
    return found.where(some < F.element_at(share, F.col("toxic")) * (1 << 30)).where("text is not null").select("toxic", "text")


def telling_features(sample: DataFrame) -> np.ndarray:
    """Buckets whose documents' labels differ from the sample's by more than chance, sorted.

    Documents are counted by feature in Spark; only the chosen few come to the driver.
    """

    def run(batches):
        for rows, t in slices(batches):
            w = words_of(t, ALNUM)
            f = word_features(t, w)
            # a document's distinct buckets, and -1 for the document itself
            doc = np.concatenate([np.repeat(w.doc, f.shape[1]), np.arange(t.n)])
            both = np.unique(doc.astype(np.int64) * (BUCKETS + 1) + np.concatenate([f.ravel(), np.full(t.n, -1)]) + 1)
            doc, bucket = both // (BUCKETS + 1), both % (BUCKETS + 1) - 1
            toxic = rows.column("toxic").to_numpy()[doc]
            names, back = np.unique(bucket, return_inverse=True)
            yield pa.record_batch([pa.array(names), pa.array(np.bincount(back.ravel())), pa.array(np.bincount(back.ravel(), toxic))], names=["bucket", "rows", "toxic"])

    counted = materialize(sample.mapInArrow(run, "bucket long, rows long, toxic double").groupBy("bucket").agg(F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic")), "toxic-features")
    whole = counted.where("bucket = -1").first()
    share = whole["toxic"] / whole["rows"] if whole else 0.0
    if not 0 < share < 1:
        return np.zeros(0, np.int64)
    part = lambda n, at: F.when(n > 0, n * F.log(n / (F.col("rows") * at))).otherwise(0.0)
    evidence = 2 * (part(F.col("toxic"), share) + part(F.col("rows") - F.col("toxic"), 1 - share))
    kept = counted.where((F.col("bucket") >= 0) & (F.col("rows") >= LEAST_ROWS) & (evidence >= LEAST_EVIDENCE))
    return np.sort(np.array([r["bucket"] for r in kept.select("bucket").collect()], np.int64))


def train(docs: DataFrame, labels: DataFrame, *, held_out_fold: int | None = 0) -> Model:
    """Choose features and fit the model on the bounded sample."""
    sample = training_sample(docs, labels, held_out_fold)
    names = telling_features(sample)

    def run(batches):
        for rows, t in slices(batches):
            w = words_of(t, ALNUM)
            f = word_features(t, w).ravel()
            first, doc = sentences(t, w)
            at = np.searchsorted(doc, np.arange(t.n + 1))
            k = np.minimum(np.searchsorted(names, f), max(0, len(names) - 1))
            hit = np.flatnonzero(names[k] == f) if len(names) else np.zeros(0, int)
            word = hit // (1 + len(BEGINNINGS))
            s = np.searchsorted(first, word, "right") - 1
            lo = np.searchsorted(s, at)
            parts = [((s[lo[i] : lo[i + 1]] - at[i]).astype(np.int32).tobytes(), k[hit[lo[i] : lo[i + 1]]].astype(np.int32).tobytes()) for i in range(t.n)]
            yield pa.record_batch([rows.column("toxic"), pa.array(np.diff(at).astype(np.int32)), pa.array([x for x, _ in parts], pa.binary()), pa.array([y for _, y in parts], pa.binary())], names=["toxic", "n", "s", "k"])

    bags = sample.mapInArrow(run, "toxic int, n int, s binary, k binary").orderBy("toxic", "n", "s", "k").collect()
    first = np.cumsum([0] + [r["n"] for r in bags])
    s = np.concatenate([np.zeros(0, np.int32)] + [np.frombuffer(r["s"], np.int32) + np.int32(at) for r, at in zip(bags, first)])
    k = np.concatenate([np.zeros(0, np.int32)] + [np.frombuffer(r["k"], np.int32) for r in bags])
    return fit(np.array([r["toxic"] for r in bags], float), first, s, k, names)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, n_sentences, n_offending`` of every row; offending: p_s >= 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for rows, t in slices(batches):
            w = words_of(t, ALNUM)
            first, doc = sentences(t, w)
            z = sentence_logits(m, word_features(t, w), first)
            at = np.searchsorted(doc, np.arange(t.n + 1))
            yield pa.record_batch(
                [rows.column("doc_id"), pa.array(noisy_or(z, at, m.leak)), pa.array(np.diff(at).astype(np.int64)), pa.array(sums_by((z >= 0).astype(float), at).astype(np.int64))],
                names=["doc_id", "score", "n_sentences", "n_offending"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, n_sentences long, n_offending long")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id, sentence, score, text``: each sentence (numbered from 0) of score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for rows, t in slices(batches):
            w = words_of(t, ALNUM)
            first, doc = sentences(t, w)
            p = 1 / (1 + np.exp(-np.clip(sentence_logits(m, word_features(t, w), first), -40, 40)))
            at = np.searchsorted(doc, np.arange(t.n + 1))
            hit = np.flatnonzero(p >= least)
            raw = t.buf.tobytes()
            span = [raw[w.start[first[i]] : w.end[first[i + 1] - 1]].decode("utf-8", "replace") for i in hit]
            yield pa.record_batch(
                [rows.column("doc_id").take(pa.array(doc[hit])), pa.array((hit - at[doc[hit]]).astype(np.int64)), pa.array(p[hit]), pa.array(span, pa.string())],
                names=["doc_id", "sentence", "score", "text"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, sentence long, score double, text string")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, n_sentences, n_offending."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``, with all their columns.

    Works row by row, so rows without doc_id and repeated rows are judged on their own.
    """
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            flat = pa.record_batch([batch.column(at).cast(pa.large_string())], names=["text"])
            done = 0
            for rows, t in slices(iter([flat])):
                w = words_of(t, ALNUM)
                first, doc = sentences(t, w)
                z = sentence_logits(m, word_features(t, w), first)
                p = noisy_or(z, np.searchsorted(doc, np.arange(t.n + 1)), m.leak)
                yield batch.slice(done, t.n).filter(pa.array(p < least))
                done += t.n

    return docs.mapInArrow(run, docs.schema)
