"""Exact removal of repeated byte strings with suffix arrays.

Every byte covered by a string of a :class:`Reach`'s length that also starts anywhere else,
in the same or another text, is removed. Strings are judged on the input and never cross
texts.

1. Each string of ``length`` bytes is filed under a ``gram``-byte substring, the one with the
   smallest hash of its first bytes (the leftmost, if equal): its anchor. Equal strings have equal anchors at
   equal offsets. Consecutive strings with one anchor form an occurrence, a short row.
   Anchors are a small, content-given share of all positions. Several reaches share their
   places: the first bytes of a longer string are a shorter one, whose anchor's place is
   taken for both. Only occurrences whose shortest anchor stands at two places or more go
   on: these are counted first, with partial sums before the shuffle.
2. Occurrences equal in all their bytes settle each other and go on as one variant of
   their anchor. What is left to decide is which strings the variants of one anchor share:
   where copies begin, end or were edited.
3. For those, the distinct surroundings are cut from the texts, the anchor's own bytes
   become one symbol, and suffix arrays of blocks of whole anchors (see :mod:`.gsaca`)
   bring equal strings side by side; neighbours are compared symbol by symbol. A block
   holds at most ``BLOCK_VARIANTS`` variants. An anchor of more (a passage that many
   texts share) is cut by the bytes its strings must have in common: a string that starts
   between lo and hi bytes left of the anchor holds lo known bytes on one side and
   ``length - gram - hi`` on the other. Variants with those bytes in common form smaller
   groups, and the range of starts is halved until every group fits a block; once lo
   equals hi all members of a group are equal.
4. Repeated starts become byte spans, are merged per text, and cut out.

Texts are told apart by a 64-bit hash and their length; occurrences by a 62-bit hash with
the offsets. A task passes on the anchors of equal texts once, and equal occurrences of one
slice of texts as one row: a passage or period that fills a text does not become as many
rows of one key.

Edge cases: null and empty texts, and those shorter than the length, lose nothing; repeated
rows are copies of each other and lose everything (if long enough); further columns are
kept or ignored as the function says.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Texts, identity_hash, identity_sums, mix, prefix_sums, rank_hash, slices
from .gsaca import suffix_array
from .shared import materialize


@dataclass(frozen=True)
class Reach:
    """Strings of ``length`` bytes, filed under anchors of ``gram`` bytes."""

    length: int
    gram: int

    @property
    def free(self) -> int:
        """Bytes of a string besides its anchor."""
        return self.length - self.gram


CONTRACT = Reach(400, 300)
PASSAGE = Reach(200, 100)  # fifty words of prose are longer than this
BLOCK_VARIANTS = 256
BLOCK_SYMBOLS = 60_000
_PARTS = 10  # into which a group's offsets are cut, to pass over those without a partner before they are sorted
_SEEN = 500_000
_NEAR = 200_000  # bytes worked on at once: arrays of this length stay in the processor's cache

_LOW = np.uint64((1 << 24) - 1)
_STRETCH = 1 << 23  # starts looked at together; with a string's length more they stay within _LOW

# pos packs the reach (2 bits), the first start (32), anchor - start and last - first start (12 each);
# it is negative for settled runs, whose end stands in around and whose anchor is their own.
# Rows of the scan serve all reaches: 2 bits for each tell how many occurrences of it a row stands for (0, 1, 2)
_PLACE, _SHORT = (1 << 56) - 1, (1 << 12) - 1


def _shortest(reaches: tuple[Reach, ...]) -> int:
    """The number of the shortest reach, whose anchors stand for those of all: their first bytes are the same."""
    assert len({r.free for r in reaches}) == 1, "reaches of one call leave as many bytes besides the anchor"
    return min(range(len(reaches)), key=lambda k: reaches[k].length)


def _hash_names(reaches: tuple[Reach, ...]) -> list[str]:
    """Columns of the hashes that ``occurrences`` gives."""
    gate = _shortest(reaches)
    return [name for k in range(len(reaches)) for name in ("anchor" if k == gate else f"anchor{k}", f"around{k}")]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours, from those of 1, 2, 4, ... neighbours."""
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - w + n], x[w - n :])


def occurrences(t: Texts, reaches: tuple[Reach, ...], bytes_too: bool = True) -> tuple[np.ndarray, ...]:
    """Text number, p (anchor), a and b (first and last start) for the shortest reach, then for
    each reach the hashes of the anchor and of all bytes; without ``bytes_too``, only the hash of
    the shortest one's anchor."""
    found = []
    lo = 0
    while lo < t.n:
        hi = max(lo + 1, int(np.searchsorted(t.at, t.at[lo] + _NEAR, "right")) - 1)
        part = Texts(t.buf[t.at[lo] : t.at[hi]], t.at[lo : hi + 1] - t.at[lo])
        if len(part.buf) >= reaches[_shortest(reaches)].length:
            doc, *rest = _occurrences_near(part, reaches, bytes_too)
            found.append((doc + lo, *rest))
        lo = hi
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * (2 * len(reaches) if bytes_too else 1)
    return tuple(np.concatenate(c) for c in zip(none, *found, strict=True))


def _occurrences_near(t: Texts, reaches: tuple[Reach, ...], bytes_too: bool) -> tuple[np.ndarray, ...]:
    least = reaches[_shortest(reaches)]
    free, length = least.free, least.length
    size = len(t.buf) - length + 1
    # a quick hash ranks the places, as equal bytes get equal ranks in any case
    rank = rank_hash(prefix_sums(t.buf), least.gram)
    cuts, anchors = [], []
    # the leftmost of equal ranks: places count from the stretch's begin, so that no window meets two turns of the low bits
    for lo in range(0, size, _STRETCH):
        hi = min(lo + _STRETCH, size)
        ranked = (rank[lo : hi + free] & ~_LOW) | np.arange(hi - lo + free, dtype=np.uint64)
        best = _sliding_min(ranked, free + 1)
        cut = np.append(0, np.flatnonzero(best[1:] != best[:-1]) + 1)
        cuts.append(lo + cut)
        anchors.append(lo + (best[cut] & _LOW).astype(np.int64))
    change, place = np.concatenate(cuts), np.concatenate(anchors)
    # runs end where the anchor changes and where a text has no further start
    a = np.sort(np.concatenate([change, t.at[:-1]]), kind="stable")
    a = a[np.append(True, a[1:] > a[:-1])]
    p, doc = place[np.searchsorted(change, a, "right") - 1], np.searchsorted(t.at, a, "right") - 1
    end = t.at[doc + 1]
    b = np.minimum(np.append(a[1:], size), end - length + 1) - 1
    real = np.flatnonzero(b >= a)
    doc, p, a, b, end = (x[real] for x in (doc, p, a, b, end))
    strong = identity_sums(t.buf)
    hashes = []
    for reach in reaches if bytes_too else (least,):
        # a start without room for the longer string stands for none of it
        last = np.minimum(b, end - reach.length)
        hashes.append(mix(identity_hash(strong, p, np.minimum(p + reach.gram, end)) + np.uint64(reach.length)))
        if bytes_too:
            hashes.append(mix(identity_hash(strong, a, last + reach.length) + (p - a).astype(np.uint64) * np.uint64(1_000_003) + (last - a).astype(np.uint64)))
    return doc, p - t.at[doc], a - t.at[doc], b - t.at[doc], *hashes


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("text").withColumn("_key", F.xxhash64(text)).withColumn("_size", F.octet_length(text).cast("long"))


def _settled_runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the spans [lo, hi), which are sorted by text and lo."""
    if not len(doc):
        return doc, lo, hi
    reach = np.maximum.accumulate(hi + doc * (1 << 40)) - doc * (1 << 40)
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])
    first = np.flatnonzero(head)
    return doc[first], lo[first], reach[np.append(first[1:], len(doc)) - 1]


def _slice_rows(t: Texts, keys: np.ndarray, fresh: np.ndarray, reaches: tuple[Reach, ...]) -> dict[str, np.ndarray]:
    """Columns of one slice's occurrences, then of the runs settled within it."""
    sizes, gate, names = np.diff(t.at), _shortest(reaches), _hash_names(reaches)
    found = occurrences(t, reaches)
    mine = np.flatnonzero(fresh[found[0]])
    doc, p, a, b, *hashes = (x[mine] for x in found)
    hashed = dict(zip(names, hashes, strict=True))
    pos = (a << 24) | ((p - a) << 12) | (b - a)
    runs = []
    for k, reach in enumerate(reaches):
        # equal occurrences within the slice settle each other here: one row stands for all
        # of them, with weight 2, and their bytes go on as settled runs
        able = np.flatnonzero(a <= sizes[doc] - reach.length)
        _, one, back, times = np.unique((mix(hashes[2 * k]) ^ hashes[2 * k + 1])[able], return_index=True, return_inverse=True, return_counts=True)
        settled = able[times[back.ravel()] > 1]
        run = _settled_runs(doc[settled], a[settled], np.minimum(b[settled] + reach.length, sizes[doc[settled]]))
        copy = np.flatnonzero((sizes >= reach.length) & ~fresh)
        rd, lo, hi = (np.concatenate([x, y]) for x, y in zip(run, (copy, np.zeros(len(copy), int), sizes[copy]), strict=True))
        own = mix(keys[rd].view(np.uint64) + (lo.astype(np.uint64) << np.uint64(2)) + np.uint64(k))
        runs.append({"text": rd, "anchor": own, f"around{gate}": hi.astype(np.uint64), "pos": (k << 56) | (lo << 24) | (1 << 63) - (1 << 64)})
        pos[able[one]] |= np.minimum(times, 2) << (56 + 2 * k)
    kept = np.flatnonzero(pos > _PLACE)
    rows = {"text": doc, "pos": pos} | hashed
    none = [np.zeros(len(run["text"]), np.uint64) for run in runs]
    return {c: np.concatenate([x[kept], *(run.get(c, zero) for run, zero in zip(runs, none, strict=True))]) for c, x in rows.items()}


def _scan(docs: DataFrame, reaches: tuple[Reach, ...], emit, schema: str) -> DataFrame:
    """``emit(t, keys, fresh)`` for every slice of the texts; copies of a text seen before in the task are not fresh."""
    least = min(r.length for r in reaches)

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for some, t in slices(batches):
            keys, sizes = some.column("key").to_numpy(), np.diff(t.at)
            fresh = np.zeros(t.n, bool)
            for i in np.flatnonzero(sizes >= least):
                name = (int(keys[i]), int(sizes[i]))
                if name not in seen:
                    fresh[i] = True
                    if len(seen) < _SEEN:
                        seen.add(name)
            yield emit(t, keys, fresh)

    source = _keyed(docs).where(F.col("_size") >= least).select(F.col("_key").alias("key"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def _anchor_counts(docs: DataFrame, reaches: tuple[Reach, ...]) -> DataFrame:
    """``anchor``: those of the shortest reach that stand at two places or more."""

    def emit(t, keys, fresh):
        doc, *_, anchor = occurrences(t, reaches, bytes_too=False)
        anchor, n = np.unique(anchor[fresh[doc]], return_counts=True)
        return pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    return _scan(docs, reaches, emit, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def _occurrence_rows(docs: DataFrame, anchors: DataFrame, reaches: tuple[Reach, ...]) -> DataFrame:
    """``anchor, around, key, size, pos, n`` of the occurrences of ``anchors``, by reach, and of settled runs.

    A longer string repeats only if its first bytes do, so its occurrences go by the shortest reach's anchor first.
    """
    names = _hash_names(reaches)

    def emit(t, keys, fresh):
        rows, sizes = _slice_rows(t, keys, fresh, reaches), np.diff(t.at)
        text = rows["text"]
        hashed = [pa.array(rows[c].view(np.int64)) for c in names]
        return pa.record_batch([pa.array(keys[text]), pa.array(sizes[text]), pa.array(rows["pos"]), *hashed], names=["key", "size", "pos", *names])

    scanned = _scan(docs, reaches, emit, "key long, size long, pos long, " + ", ".join(f"{c} long" for c in names))
    wanted = scanned.join(anchors.withColumn("again", F.lit(True)), "anchor", "left").where("pos < 0 OR again")
    parts = [f"named_struct('anchor', anchor, 'around', around{_shortest(reaches)}, 'pos', pos, 'n', if(pos < 0, 1L, 0L))"]
    for k, reach in enumerate(reaches):
        place = f"{k << 56}L + (pos & {_PLACE - _SHORT}L) + least(pos & {_SHORT}L, size - {reach.length} - {_FIRST})"
        parts.append(f"named_struct('anchor', {names[2 * k]}, 'around', around{k}, 'pos', {place}, 'n', if(pos < 0, 0L, shiftright(pos, {56 + 2 * k}) & 3L))")
    return wanted.select("key", "size", F.inline(F.expr(f"array({', '.join(parts)})"))).where("n > 0").select("anchor", "around", "key", "size", "pos", "n")


# the parts of pos: the reach, the first start, the anchor behind it, the last start behind it
_KIND, _FIRST, _BEFORE, _SPREAD = "(shiftright(pos, 56) & 3)", "(shiftright(pos, 24) & 4294967295)", "(shiftright(pos, 12) & 4095)", "(pos & 4095)"


def _surroundings(docs: DataFrame, wanted: DataFrame, reaches: tuple[Reach, ...]) -> DataFrame:
    """``anchor, around, kind, left, right``: the bytes before and behind each wanted anchor."""
    least = min(r.length for r in reaches)
    lists = wanted.groupBy("key", "size").agg(F.collect_list(F.struct("anchor", "around", "pos")).alias("want")).select("key", "size", "want.anchor", "want.around", "want.pos")
    source = _keyed(docs).where(F.col("_size") >= least).select(F.col("_key").alias("key"), F.col("_size").alias("size"), F.col("text").cast("string").alias("text"))
    gram, length = np.array([r.gram for r in reaches]), np.array([r.length for r in reaches])

    def run(batches):
        for batch in batches:
            pos = batch.column("pos").flatten().to_numpy()
            kind, a = (pos >> 56) & 3, (pos >> 24) & 0xFFFFFFFF
            p, b = a + ((pos >> 12) & 0xFFF), a + (pos & 0xFFF)
            ends = batch.column("pos").offsets.to_numpy()
            cuts = zip(a.tolist(), p.tolist(), (p + gram[kind]).tolist(), (b + length[kind]).tolist(), strict=True)
            left, right = [], []
            for text, n in zip(batch.column("text"), np.diff(ends).tolist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for _ in range(n):
                    lo, mid, end, hi = next(cuts)
                    left.append(raw[lo:mid])
                    right.append(raw[end:hi])
            yield pa.record_batch(
                [batch.column("anchor").flatten(), batch.column("around").flatten(), pa.array(kind.astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=["anchor", "around", "kind", "left", "right"],
            )

    cut = source.join(lists, ["key", "size"]).select("text", "anchor", "around", "pos").mapInArrow(run, "anchor long, around long, kind int, left binary, right binary")
    return cut.dropDuplicates(["anchor", "around"])  # copies of a text give the same


def _shared_bytes(x: bytes, y: bytes) -> int:
    """How many first bytes of ``x`` and ``y`` agree."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def repeated_starts(groups: list[list[tuple[bytes, bytes]]], frees: list[int]) -> list[list[list[int]]]:
    """For each group of distinct (left, right) surroundings, the offsets left of the anchor
    at which a member has a string that another member has too. ``frees``: each group's
    string length without the anchor's. Where two members are left, comparing them is all
    that sorting would do."""
    out: list[list[list[int]]] = [[[] for _ in group] for group in groups]
    parts, member, offset, spans = [], [], [], []
    for g, group in enumerate(groups):
        free = frees[g]
        # a string whose start is in the q-th part has the bytes of q parts before the anchor and those
        # of the parts after the q-th behind it, at least: no partner there, no string in common
        cut = [q * free // _PARTS for q in range(_PARTS)] + [free]
        ends = list(zip(cut, (free - hi for hi in cut[1:]), strict=False))
        names = [[(q, left[len(left) - x :], right[:y]) for q, (x, y) in enumerate(ends) if len(left) >= x and len(right) >= y] for left, right in group]
        often = Counter(name for own in names for name in own)
        left_over = []
        for v, (left, right) in enumerate(group):
            able = [name[0] for name in names[v] if often[name] > 1]
            if able:
                left_over.append((v, left[max(0, len(left) - cut[able[-1] + 1]) :], right[: free - cut[able[0]]]))
        if len(left_over) == 2:
            (v, l1, r1), (w, l2, r2) = left_over
            both = range(max(0, free - _shared_bytes(r1, r2)), _shared_bytes(l1[::-1], l2[::-1]) + 1)
            out[g][v], out[g][w] = list(both), list(both)
            continue
        for v, left, right in left_over:
            s = np.empty(len(left) + len(right) + 2, np.int64)
            s[: len(left)] = np.frombuffer(left, np.uint8)
            s[len(left)] = 256 + g
            s[len(left) + 1 : -1] = np.frombuffer(right, np.uint8)
            s[:-1] += 1
            s[-1] = 0
            parts.append(s)
            member.append((g, v))
            offset.append(len(left))
            spans.append(free + 1)
    if not parts:
        return out
    text = np.concatenate(parts)
    begin = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(s) for s in parts], out=begin[1:])
    sa = suffix_array(text)
    part = np.searchsorted(begin, sa, "right") - 1
    o = np.array(offset)[part] - (sa - begin[part])  # bytes from the start to the anchor
    span = np.array(spans)[part]
    whole = (o >= 0) & (sa + span < begin[part + 1])
    x, y = sa[:-1], sa[1:]
    near = np.flatnonzero(whole[:-1] & whole[1:] & (o[:-1] == o[1:]) & (span[:-1] == span[1:]))
    same = np.zeros(len(near), bool)
    for width in np.unique(span[near]):
        of = near[span[near] == width]
        steps = np.arange(width)
        for lo in range(0, len(of), 20_000):
            k = of[lo : lo + 20_000]
            same[np.searchsorted(near, k)] = (text[x[k][:, None] + steps] == text[y[k][:, None] + steps]).all(axis=1)
    hit = np.zeros(len(sa), bool)
    hit[near[same]] = True
    hit[near[same] + 1] = True
    for j in np.flatnonzero(hit):
        g, v = member[part[j]]
        out[g][v].append(int(o[j]))
    return out


def _ranges(offsets: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as closed ranges."""
    runs: list[tuple[int, int]] = []
    for o in sorted(offsets):
        if runs and o == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], o)
        else:
            runs.append((o, o))
    return runs


def _by_suffix_arrays(members: DataFrame, reaches: tuple[Reach, ...]) -> DataFrame:
    """``unit, l, r, least, most``: ranges of repeated offsets of the ``members(unit, kind, lo, hi, l, r, m)`` of small units."""

    def run(batches):
        units: list[list[tuple]] = []
        symbols, last = 0, None

        def flush():
            out = []
            groups = [[(x[4], x[5]) for x in u] if len(u) > 1 else [] for u in units]
            for unit, found in zip(units, repeated_starts(groups, [reaches[u[0][1]].free for u in units]), strict=True):
                for k, (name, kind, lo, hi, left, right, m) in enumerate(unit):
                    free = reaches[kind].free
                    least, most = max(lo, free - len(right)), min(hi, len(left))
                    if m > 1:  # several variants agree in all these bytes
                        out += [(name, left, right, least, most)] if least <= most else []
                    elif found:
                        out += [(name, left, right, x, y) for x, y in _ranges([o for o in found[k] if least <= o <= most])]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["unit", "l", "r", "least", "most"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("unit", "kind", "lo", "hi", "l", "r", "m")), strict=True):
                if last is None or row[0] != last:
                    if symbols > BLOCK_SYMBOLS:
                        yield flush()
                        units, symbols = [], 0
                    units.append([])
                last = row[0]
                units[-1].append(row)
                symbols += len(row[4]) + len(row[5]) + 2
        if units:
            yield flush()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("unit", "kind", "lo", "hi", "l", "r", "m").repartition(parts, "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(run, "unit binary, l binary, r binary, least int, most int")


def _shared_strings(cells: DataFrame, reaches: tuple[Reach, ...]) -> DataFrame:
    """``anchor, around, least, most``: ranges of offsets at which a variant has a string that another variant has.

    ``cells``: anchor, around, kind, left, right. Groups too large for a block are halved
    by their range of offsets; groups whose members agree need no array.
    """
    free = F.element_at(F.array(*[F.lit(r.free) for r in reaches]), F.col("kind") + 1)
    n_left, n_right = F.octet_length("left"), F.octet_length("right")
    common = F.concat(F.expr("substring(left, octet_length(left) - lo + 1, lo)"), F.substring("right", F.lit(1), free - F.col("hi")))
    unit = F.concat(F.encode(F.concat_ws(",", "anchor", "lo", "hi"), "utf-8"), F.encode(F.lit(":"), "utf-8"), common)
    l = F.expr("substring(left, greatest(octet_length(left) - hi, 0) + 1, hi)")  # noqa: E741
    r = F.substring("right", F.lit(1), free - F.col("lo"))
    now, found = cells.withColumn("lo", F.lit(0)).withColumn("hi", free), []
    while True:
        able = materialize(now.where((n_left >= F.col("lo")) & (n_right >= free - F.col("hi"))), "cells")
        keyed = able.select("*", unit.alias("unit"), l.alias("l"), r.alias("r"))
        members = keyed.groupBy("unit", "l", "r").agg(F.count("*").alias("m"), F.first("kind").alias("kind"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        members = materialize(members, "members")
        large = materialize(members.groupBy("unit").agg(F.count("*").alias("v")).where(F.col("v") > BLOCK_VARIANTS).select("unit"), "large")
        # merge joins, which adaptive execution splits where one unit or member has many rows
        small = members if large.isEmpty() else members.join(large.hint("merge"), "unit", "left_anti")
        ranges = materialize(_by_suffix_arrays(small, reaches), "ranges")
        found.append(materialize(keyed.join(ranges.hint("merge"), ["unit", "l", "r"]).select("anchor", "around", "least", "most"), "found"))
        if large.isEmpty():
            break
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi"))))
        halved = keyed.join(large.hint("merge"), "unit", "left_semi").select("anchor", "around", "kind", "left", "right", halves.alias("half"))
        now = halved.select("anchor", "around", "kind", "left", "right", "half.lo", "half.hi")
    return reduce(DataFrame.union, found)


def repeated_spans(docs: DataFrame, reaches: tuple[Reach, ...] = (CONTRACT,)) -> DataFrame:
    """``_key, _size, spans``: per distinct text with repeats, its byte spans, unmerged, packed as kind (2 bits), lo and hi (31 each); kind numbers ``reaches``."""
    length = f"element_at(array({', '.join(str(r.length) for r in reaches)}), cast({_KIND} as int) + 1)"
    anchors = materialize(_anchor_counts(docs, reaches), "anchors")
    rows = materialize(_occurrence_rows(docs, anchors, reaches), "occurrences")

    near = rows.where("pos >= 0")
    variants = near.groupBy("anchor", "around").agg(F.sum("n").alias("n"), *[F.first(x).alias(x) for x in ("key", "size", "pos")])
    variants = materialize(variants, "variants")
    settled = near.join(variants.where("n > 1").select("anchor", "around"), ["anchor", "around"], "left_semi")
    whole = settled.selectExpr("key", "size", f"{_KIND} AS kind", f"{_FIRST} AS lo", f"{_FIRST} + {_SPREAD} + {length} AS hi")
    whole = whole.union(rows.where("pos < 0").selectExpr("key", "size", f"{_KIND} AS kind", f"{_FIRST} AS lo", "around AS hi"))

    several = materialize(variants.groupBy("anchor").agg(F.count("*").alias("v")).where("v > 1").select("anchor"), "several")
    mixed = materialize(variants.join(several.hint("merge"), "anchor", "left_semi"), "mixed")
    cells = _surroundings(docs, mixed, reaches)
    found = _shared_strings(cells, reaches)
    at = f"{_FIRST} + {_BEFORE}"
    part = mixed.where("n = 1").join(found, ["anchor", "around"]).selectExpr("key", "size", f"{_KIND} AS kind", f"{at} - most AS lo", f"{at} - least + {length} AS hi")
    packed = F.shiftleft(F.col("kind"), 62) + F.shiftleft(F.col("lo"), 31) + F.col("hi")
    spans = whole.union(part).groupBy("key", "size").agg(F.collect_list(packed).alias("spans"))
    return spans.select(F.col("key").alias("_key"), F.col("size").alias("_size"), "spans")


def merged(spans: np.ndarray, kind: int = 0) -> list[tuple[int, int]]:
    """Maximal runs of the packed byte spans of one kind, in order."""
    own = np.unique(spans[spans >> 62 == kind]) if len(spans) else spans
    if not len(own):
        return []
    lo, hi = (own >> 31) & 0x7FFFFFFF, np.maximum.accumulate(own & 0x7FFFFFFF)
    first = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    return list(zip(lo[first].tolist(), hi[np.append(first[1:], len(own))[: len(first)] - 1].tolist(), strict=True))


def _spans_of(column: pa.Array):
    """The packed spans of each row."""
    flat, ends = column.flatten().to_numpy(), column.fill_null([]).offsets.to_numpy()
    return (flat[lo - ends[0] : hi - ends[0]] for lo, hi in zip(ends[:-1], ends[1:], strict=True))


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in runs:
        out.append(raw[at:lo])
        at = hi
    out.append(raw[at:])
    return b"".join(out)


def _with_spans(docs: DataFrame, reaches: tuple[Reach, ...]) -> DataFrame:
    """``docs`` with its columns renamed by position, and ``_spans`` behind them."""
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    text = F.coalesce(F.col(f"_c{at}").cast("string"), F.lit(""))
    keyed = plain.withColumn("_key", F.xxhash64(text)).withColumn("_size", F.octet_length(text).cast("long"))
    return keyed.join(repeated_spans(docs, reaches), ["_key", "_size"], "left").select(*plain.columns, F.col("spans").alias("_spans"))


def summary(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and n_passage and n_passages.

    The first are of strings of 400 bytes, as the contract has it. n_passage and n_passages
    are the bytes and maximal runs covered by repeated strings of 200 bytes: passages of
    some fifty words, which are shorter than 400 bytes as a rule.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), _spans_of(batch.column("_spans")), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                runs, short = merged(spans, 0), merged(spans, 1)
                rows.append((len(raw), sum(hi - lo for lo, hi in runs), len(runs), hashlib.sha256(_kept(raw, runs) if runs else raw).hexdigest(), sum(hi - lo for lo, hi in short), len(short)))
            n_bytes, n_removed, n_spans, sha, n_passage, n_passages = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.record_batch(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(sha, pa.string()), pa.array(n_passage, pa.int64()), pa.array(n_passages, pa.int64())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage", "n_passages"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long, n_passages long"
    return _with_spans(source, (CONTRACT, PASSAGE)).mapInArrow(run, kinds)


def cut_text(raw: bytes, runs: list[tuple[int, int]]) -> str:
    """The text without its removed runs; a character goes only if all its bytes do."""
    safe = []
    for lo, hi in runs:
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while lo < hi and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            safe.append((lo, hi))
    return _kept(raw, safe).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, reach: Reach = PASSAGE) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (null stays null) and ``n_chars`` renewed.

    Strings are those of ``reach``, 200 bytes if not told otherwise: some fifty words make a
    passage. Rows whose whole text goes stay, with an empty text.
    """
    joined = _with_spans(docs, (reach,))
    at = docs.columns.index("text")
    names, has_count = docs.columns, "n_chars" in docs.columns

    def run(batches):
        for batch in batches:
            texts = [
                None if not t.is_valid else cut_text(t.as_buffer().to_pybytes(), merged(s)) if len(s) else t.as_py()
                for t, s in zip(batch.column(at), _spans_of(batch.column("_spans")), strict=True)
            ]
            cols = [c for c in batch.columns][:-1]
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.record_batch(cols, names=names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if has_count else out
