"""Vectorised work on Arrow text columns: words, word hashes and word windows.

A batch of texts is one byte buffer with offsets; every step below is a numpy pass
over that buffer, never a Python loop over rows. Batches are cut into slices of a
bounded number of bytes first, so memory does not follow the batch size; one text
longer than the bound forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans that holds for the bytes in the given closed spans."""
    table = np.zeros(256, bool)
    for lo, hi in spans:
        table[lo : hi + 1] = True
    return table


SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = ~SPACE
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        p = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        p[0] = 1
        _powers[kind] = have = np.multiply.accumulate(p)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Texts:
    """Texts in one buffer: ``buf`` holds all bytes, text i is buf[at[i]:at[i+1]]."""

    buf: np.ndarray
    at: np.ndarray

    @property
    def n(self) -> int:
        return len(self.at) - 1

    def starts_mask(self) -> np.ndarray:
        m = np.zeros(len(self.buf) + 1, bool)
        m[self.at] = True
        return m


def texts_of(column: pa.Array) -> Texts:
    """The column's bytes without a copy; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(buf[at[0] : at[-1]], at - at[0])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batches cut into runs of rows of at most ``most`` bytes of ``column`` (or one row)."""
    for batch in batches:
        whole = texts_of(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < whole.n:
            hi = int(np.searchsorted(whole.at, whole.at[lo] + most, "right")) - 1
            hi = min(max(hi, lo + 1), whole.n)
            yield batch.slice(lo, hi - lo), Texts(whole.buf[whole.at[lo] : whole.at[hi]], whole.at[lo : hi + 1] - whole.at[lo])
            lo = hi


@dataclass
class Words:
    """Words of some texts: byte spans, the text each stands in, and first word of each text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # word number of each text's first word, with the total at the end

    @property
    def n(self) -> int:
        return len(self.start)

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(t: Texts, member: np.ndarray) -> Words:
    """Maximal runs of bytes of the class ``member``; a run never crosses texts."""
    m = np.zeros(len(t.buf) + 2, bool)
    m[1:-1] = member[t.buf]
    cut = t.starts_mask()
    start = np.flatnonzero(m[1:-1] & (~m[:-2] | cut[:-1]))
    end = np.flatnonzero(m[1:-1] & (~m[2:] | cut[1:])) + 1
    first = np.searchsorted(start, t.at)
    doc = np.repeat(np.arange(t.n), np.diff(first))
    return Words(start, end, doc, first)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """For ``span_hash``."""
    n = len(buf)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power("up", n)[:n], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from the buffer's prefix sums.

    For features alone: modulo 2^64 some long spans of two letters collide by construction.
    """
    return mix((sums[end] - sums[start]) * _power("down", len(sums))[start])


def rank_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """A quick hash of every ``width`` bytes in the buffer of ``prefix_sums``; its high bits are mixed best."""
    x = (sums[width:] - sums[:-width]) * _power("down", len(sums))[: len(sums) - width]
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


_PRIME = np.uint64(2**31 - 1)
_BASES = (0x2F0B4C47, 0x5D1A7E93)
_low: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """A number below 2^33 or so that equals ``x`` modulo 2^31 - 1."""
    return (x & _PRIME) + (x >> np.uint64(31))


def _powers_below(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^31 - 1."""
    have = _low.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 2)
        both = []
        for b in (base, pow(base, -1, int(_PRIME))):
            p = np.ones(size, np.uint32)
            done = 1
            while done < size:
                more = min(done, size - done)
                p[done : done + more] = p[:more] * np.uint64(pow(b, done, int(_PRIME))) % _PRIME
                done += more
            both.append(p)
        _low[base] = have = (both[0], both[1])
    return have


def identity_sums(buf: np.ndarray) -> list[np.ndarray]:
    """For ``identity_hash``."""
    n = len(buf)
    plain = buf.astype(np.uint64) + np.uint64(1)
    out = []
    for base in _BASES:
        s = np.zeros(n + 1, np.uint64)
        part = plain * _powers_below(base, n)[0][:n]
        np.cumsum(part if n < 1 << 24 else _fold(part), out=s[1:])
        out.append(s)
    return out


def identity_hash(sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62 bits of byte spans, scrambled to 64: two polynomials modulo the prime 2^31 - 1.

    Two different spans of n bytes agree for at most (n / 2^31)^2 of all pairs of bases.
    """
    parts = []
    for base, s in zip(_BASES, sums, strict=True):
        x = _fold(_fold(s[end] - s[start]))
        x = _fold(_fold(_fold(x) * _powers_below(base, len(s))[1][start]))
        x = _fold(x)
        parts.append(np.where(x == _PRIME, np.uint64(0), x))
    return mix((parts[0] << np.uint64(31)) | parts[1])


def word_hashes(t: Texts, w: Words, lower: bool = True) -> np.ndarray:
    return identity_hash(identity_sums(LOWER[t.buf] if lower else t.buf), w.start, w.end)


def windows(h: np.ndarray, w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of one text, and the first word of each window."""
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[: len(h) - width + 1] == w.doc[width - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        total = total * np.uint64(_BASE) + h[at + j]
    return mix(total), at


def shingle_sets(t: Texts, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Word-window hashes of each text and where each text's begin.

    Words are runs without white space, lower-cased A-Z. A text of fewer than ``width``
    words (and at least one) has one window, its whole sequence.
    """
    w = words_of(t, NOT_SPACE)
    h = word_hashes(t, w)
    full, at = windows(h, w, width)
    doc = w.doc[at]
    n = w.per_text()
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        total = np.zeros(len(few), np.uint64)
        for j in range(width - 1):
            has = n[few] > j
            total[has] = total[has] * np.uint64(_BASE) + h[w.first[few[has]] + j]
        short = mix(total ^ mix(n[few].astype(np.uint64)))
        full, doc = np.concatenate([full, short]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        full, doc = full[order], doc[order]
    return full, np.searchsorted(doc, np.arange(t.n + 1))


def distinct_per_text(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each text's stretch, and where each text's begin."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(first)))


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the stretches [first[i], first[i+1]); an empty stretch gives 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
