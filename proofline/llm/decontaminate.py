"""Benchmark decontamination by template windows.

Words are runs of letters and digits, lower-cased A-Z (digits and letters part company,
``3.5`` and ``1,000`` stay whole). In a template, numbers, units behind a number, and
names (capitalised words that do not open a sentence) are replaced by typed
placeholders, capitals being those of any script. Windows of five template words are hash-joined between documents and
benchmark items; a window with fewer than two plain words is compared verbatim instead.
A capitalised word that opens a sentence may be a name or not: windows that hold one are
joined in a second form too, where it is a name.

Along each alignment (document position minus item position) the slots should agree: an
item's value stands for one document value. Where an item's value stands for several, the
one in most slots holds (of equally many, the item's own, else none), and windows with one
of its other slots do not count; the rest of the alignment does. A document is
contaminated by an item if at least three quarters of the item's distinct windows are
found; it is ``verbatim`` if all slots are equal, else ``reparameterised``.

The items' window hashes go to the mappers as a filter while there are at most
``FILTER_WINDOWS`` of them; beyond that all windows go through the hash join.

Edge cases: null and empty texts match nothing; an item of fewer than five words is one
window of its own length; an item without words matches nothing; rows are told apart by
doc_id and text, so repeated rows give one result; null ids are kept as null; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import ALNUM, LOWER, Texts, Words, byte_class, identity_hash, identity_sums, mix, slices

WIDTH = 5
SIMILARITY = 0.75
LEAST_PLAIN = 2
FILTER_WINDOWS = 2_000_000

UNITS = (
    "mm cm dm m km inch inches in ft foot feet yard yards yd mile miles mi mg g kg t ton tons tonne tonnes lb lbs oz pound pounds "
    "ml cl l liter liters litre litres gallon gallons ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day "
    "days week weeks month months year years mph kmh kph v kv mv a ma w kw mw hz khz mhz ghz j kj n pa kpa bar k c f degrees degree "
    "percent usd eur dollar dollars cent cents euro euros byte bytes kb mb gb tb"
).split()

_DIGIT = byte_class((0x30, 0x39))
_POINT = byte_class((0x2C, 0x2C), (0x2E, 0x2E))
_STOP = byte_class((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3A), (0x3F, 0x3F))
PLAIN, NUMBER, NAME, UNIT = range(4)
_PLACEHOLDER = mix(np.arange(101, 105, dtype=np.uint64))


def _one(raw: bytes) -> np.ndarray:
    buf = np.frombuffer(raw, np.uint8)
    return identity_hash(identity_sums(buf), np.array([0]), np.array([len(buf)]))


_UNIT_HASHES = np.sort(np.concatenate([_one(u.encode()) for u in UNITS]))


@dataclass
class Tokens:
    words: Words
    kind: np.ndarray
    value: np.ndarray  # hash of each word
    opens: np.ndarray  # a capitalised word that opens a sentence


@cache
def _capitals() -> np.ndarray:
    """Whether each code point below 2^16 is a capital letter, of any script."""
    return np.array([chr(c).isupper() or chr(c).istitle() for c in range(1 << 16)])


def _capital(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    pad = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int64)
    b0, b1, b2 = (pad[at + i] for i in range(3))
    code = np.select([b0 < 0x80, b0 < 0xE0, b0 < 0xF0], [b0, ((b0 & 31) << 6) | (b1 & 63), ((b0 & 15) << 12) | ((b1 & 63) << 6) | (b2 & 63)], 0)
    return _capitals()[code]


def tokens(t: Texts) -> Tokens:
    b, n = t.buf, len(t.buf)
    cut = t.starts_mask()
    digit = np.zeros(n + 2, bool)
    digit[1:-1] = _DIGIT[b]
    same_next = ~cut[1:]  # the next byte belongs to the same text
    same_prev = ~cut[:-1]
    point = _POINT[b] & digit[:-2] & digit[2:] & same_next & same_prev
    digit[1:-1] |= point
    member = np.zeros(n + 2, bool)
    member[1:-1] = ALNUM[b] | point
    turn = digit[1:-1] != digit[:-2]  # digits and letters part company
    start_mask = member[1:-1] & (~member[:-2] | cut[:-1] | turn)
    start = np.flatnonzero(start_mask)
    last = np.append(start_mask[1:], True) | ~member[2:] | cut[1:]
    end = np.flatnonzero(member[1:-1] & last) + 1
    first = np.searchsorted(start, t.at)
    doc = np.repeat(np.arange(t.n), np.diff(first))
    w = Words(start, end, doc, first)
    value = identity_hash(identity_sums(LOWER[b]), start, end)
    kind = np.zeros(w.n, np.int8)
    opens = np.zeros(w.n, bool)
    if w.n:
        upper = _capital(b, start)
        stops = np.zeros(n + 1, np.int64)
        np.cumsum(_STOP[b] & ~point, out=stops[1:])
        inside = np.zeros(w.n, bool)
        inside[1:] = (doc[1:] == doc[:-1]) & (stops[start[1:]] == stops[end[:-1]])
        number = digit[1:-1][start]
        kind[upper & inside] = NAME
        opens = upper & ~inside
        kind[number] = NUMBER
        after = np.zeros(w.n, bool)
        after[1:] = number[:-1] & inside[1:]
        k = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
        kind[after & (_UNIT_HASHES[k] == value)] = UNIT
    return Tokens(w, kind, value, opens)


def template_windows(x: Tokens, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, hash of the first form, first word, and slots, of every window of ``width`` words.

    Then the second form of the windows that hold a word that opens a sentence.
    """
    w = x.words
    if w.n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, width), bool)
    at = np.flatnonzero(w.doc[: w.n - width + 1] == w.doc[width - 1 :])
    h, use = _form(x, x.kind, at, width)
    named = np.where(x.opens, np.int8(NAME), x.kind)
    opening = np.flatnonzero(np.any([x.opens[at + j] for j in range(width)], axis=0))
    h2, use2 = _form(x, named, at[opening], width)
    opening, h2 = opening[use2], h2[use2]
    steps = at[:, None] + np.arange(width)
    slots = np.concatenate([(x.kind[steps] != PLAIN) & use[:, None], named[steps[opening]] != PLAIN])
    return np.concatenate([h, h2]), np.concatenate([h, h[opening]]), np.concatenate([at, at[opening]]), slots


def _form(x: Tokens, kind: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash, and whether templated, of the windows at ``at`` for the given kinds of words."""
    form = np.where(kind == PLAIN, x.value, _PLACEHOLDER[kind])
    plain = np.zeros(len(at), np.int8)
    templated, verbatim = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for j in range(width):
        plain += kind[at + j] == PLAIN
        templated = templated * base + form[at + j]
        verbatim = verbatim * base + x.value[at + j]
    use = plain >= min(LEAST_PLAIN, width)
    return mix(np.where(use, templated, mix(verbatim)) + np.uint64(width)), use


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _lists(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.ravel()))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, item_row, width, pos, hash, window, values, slots`` of each item's windows.

    ``window`` is the hash of the first form, also where ``hash`` is that of the second.
    """

    def run(batches):
        for rows, t in slices(batches):
            x = tokens(t)
            n = x.words.per_text()
            for width in range(1, WIDTH + 1):
                h, window, at, slot = template_windows(x, width)
                doc = x.words.doc[at] if len(at) else np.zeros(0, int)
                right = (n[doc] >= WIDTH) if width == WIDTH else (n[doc] == width)
                h, window, at, doc, slot = h[right], window[right], at[right], doc[right], slot[right]
                if not len(at):
                    continue
                steps = at[:, None] + np.arange(width)
                yield pa.record_batch(
                    [
                        rows.column("item_id").take(pa.array(doc)),
                        rows.column("item_row").take(pa.array(doc)),
                        pa.array(np.full(len(at), width, np.int32)),
                        pa.array(at - x.words.first[doc]),
                        pa.array(_signed(h)),
                        pa.array(_signed(window)),
                        _lists(_signed(x.value[steps]), width),
                        _lists(slot, width),
                    ],
                    names=["item_id", "item_row", "width", "pos", "hash", "window", "values", "slots"],
                )

    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).withColumn("item_row", F.xxhash64("text"))
    return source.distinct().mapInArrow(run, "item_id long, item_row long, width int, pos long, hash long, window long, values array<long>, slots array<boolean>")


def document_windows(docs: DataFrame, widths: list[int], wanted: np.ndarray | None) -> DataFrame:
    """``doc_id, doc_row, pos, hash, doc_values`` of the documents' windows that ``wanted`` holds."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        want = shared.value
        if want is not None:
            light = np.zeros(1 << 20, bool)
            light[(want.view(np.uint64) >> np.uint64(44)).astype(np.int64)] = True
        for rows, t in slices(batches):
            x = tokens(t)
            for width in widths:
                h, _, at, _ = template_windows(x, width)
                if want is not None:
                    hit = np.flatnonzero(light[(h >> np.uint64(44)).astype(np.int64)])
                    k = np.minimum(np.searchsorted(want, _signed(h[hit])), len(want) - 1)
                    hit = hit[want[k] == _signed(h[hit])]
                    h, at = h[hit], at[hit]
                if not len(at):
                    continue
                doc = x.words.doc[at]
                steps = at[:, None] + np.arange(width)
                yield pa.record_batch(
                    [rows.column("doc_id").take(pa.array(doc)), rows.column("doc_row").take(pa.array(doc)), pa.array(at - x.words.first[doc]), pa.array(_signed(h)), _lists(_signed(x.value[steps]), width)],
                    names=["doc_id", "doc_row", "pos", "hash", "doc_values"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("doc_row", F.xxhash64("text"))
    return source.mapInArrow(run, "doc_id long, doc_row long, pos long, hash long, doc_values array<long>")


def _agreeing() -> Column:
    """Of an alignment's windows ``w``, those without a slot at odds with its value's other slots ``s``."""
    counted = F.transform("means", lambda m: F.struct(m["i"], m["d"], F.size(F.filter("s", lambda s: (s["i"] == m["i"]) & (s["d"] == m["d"]))).alias("n")))
    beats = lambda a, b: (a["i"] == b["i"]) & (a["d"] != b["d"]) & ((a["n"] > b["n"]) | ((a["n"] == b["n"]) & (b["d"] != b["i"])))
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  value is worked out once, not in each step of f
    held = once(counted, lambda c: F.filter(c, lambda m: ~F.exists(c, lambda other: beats(other, m))))
    return once(held, lambda h: F.filter("w", lambda w: F.forall(w["z"], lambda z: F.exists(h, lambda m: (m["i"] == z["i"]) & (m["d"] == z["d"])))))


def contaminations(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, doc_row, item_id, n_windows, n_found, similarity, kind`` of each contaminated pair."""
    items = item_windows(benchmark).withColumnRenamed("pos", "item_pos")
    size = items.agg(F.countDistinct("hash").alias("n"), F.collect_set("width").alias("w")).first()
    if not size["n"]:
        widths, wanted = [WIDTH], np.zeros(1, np.int64)
    else:
        widths, wanted = sorted(size["w"]), None
        if size["n"] <= FILTER_WINDOWS:
            wanted = np.sort(np.array(items.select("hash").distinct().toArrow().column(0).to_numpy(), np.int64))
    total = items.groupBy("item_id", "item_row").agg(F.countDistinct("window").alias("n_windows"))
    hits = document_windows(docs, widths, wanted)
    zipped = F.transform(F.arrays_zip("values", "doc_values", "slots"), lambda z, k: F.struct((F.col("item_pos") + k).alias("at"), z["values"].alias("i"), z["doc_values"].alias("d"), z["slots"].alias("slot")))
    pairs = hits.join(items, "hash").select(
        "doc_id", "doc_row", "item_id", "item_row", "window", (F.col("pos") - F.col("item_pos")).alias("shift"),
        F.transform(F.filter(zipped, lambda z: z["slot"]), lambda z: F.struct(z["at"], z["i"], z["d"])).alias("z"),
    )
    key = ["doc_id", "doc_row", "item_id", "item_row"]
    along = pairs.groupBy(*key, "shift").agg(F.collect_set(F.struct("window", "z")).alias("w"))
    along = along.withColumn("s", F.array_distinct(F.flatten(F.col("w.z")))).withColumn("means", F.array_distinct(F.transform("s", lambda s: F.struct(s["i"], s["d"]))))
    along = along.withColumn("w", F.when(F.size(F.array_distinct(F.col("means.i"))) == F.size("means"), F.col("w")).otherwise(_agreeing()))
    along = along.select(*key, F.explode(F.array_distinct(F.col("w.window"))).alias("window"), F.forall("s", lambda s: s["i"] == s["d"]).alias("same"))
    found = along.groupBy(*key, "window").agg(F.max("same").alias("same")).groupBy(*key).agg(F.count("*").alias("n_found"), F.min("same").alias("same"))
    on = found["item_id"].eqNullSafe(total["item_id"]) & (found["item_row"] == total["item_row"])
    out = found.join(F.broadcast(total) if size["n"] <= FILTER_WINDOWS else total, on).select(found["*"], "n_windows")
    return out.where(F.col("n_found") >= F.lit(similarity) * F.col("n_windows")).select(
        "doc_id", "doc_row", "item_id", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("similarity"),
        F.when(F.col("same"), "verbatim").otherwise("reparameterised").alias("kind"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with all their columns."""
    bad = contaminations(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("doc_row").alias("_row")).distinct()
    on = docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_row"])
    return docs.join(bad, on, "left_anti")
