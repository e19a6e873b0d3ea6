"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures.

A signature is ``CHUNKS * CHUNK`` components of 16 bits, one MinHash each. The distance
of two signatures is the number of components in which they differ; for sets of Jaccard
similarity J it is binomial with mean (1 - J) * 80. Cut into 20 chunks of 4, two
signatures within distance 39 have, by the pigeonhole principle, a chunk with at most one
differing component. So each chunk is indexed under its allowed errors: four keys, each
leaving one component out. Every pair within distance 39 shares a key; a pair at
J = 0.75 lies beyond it with probability near one in a million.

Documents with equal shingle sets form one class and take part once. Within a key,
members are compared with one central member, not with each other, so a key of many members
costs no pairs of all with all. What a key still holds apart is closed by an exact prefix
filter: documents in another component than some key-mate give the rarest part of their
whole shingle sets, by counts over all such documents, and every pair across components
that can be similar meets there. Links are confirmed on the full shingle sets of the whole
texts: each pair moves one of its texts, the other (which may have thousands of partners)
moves once for each pack of them.

Joins of tables that grow with the documents are merge joins by hint: Spark sizes the 80
keys of a class, exploded, as one row, and Parquet by its compressed bytes, so up to some
size it would send millions of rows through the driver.

Edge cases: a null or word-free text has an empty set and no links; rows without doc_id
take no part (component null, kept true); repeated rows share class and component; the
input's other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import distinct_per_text, mix, shingle_sets, slices
from .components import components
from .shared import materialize

WIDTH, CHUNKS, CHUNK = 5, 20, 4
MOST_DISTANCE = CHUNKS * 2 - 1
COUNTERS = 1 << 20  # shingles are counted in so many counters, to put rare ones first
PACKS = 64  # at most so many copies of a text meet its partners

_SEEDS = mix(np.arange(1, 2 * CHUNKS * CHUNK + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def set_ids(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 128-bit name of each text's set of shingle hashes (sorted and distinct)."""
    n = np.diff(first).astype(np.uint64)
    parts = []
    for salt in (np.uint64(1), np.uint64(2)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h * np.uint64(3) + salt), out=total[1:])
        parts.append(mix(total[first[1:]] - total[first[:-1]] + n))
    both = np.stack(parts, axis=1).astype("<u8")
    return [row.tobytes() for row in both]


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of 16-bit MinHash components for each text (zeros for an empty set)."""
    m = CHUNKS * CHUNK
    out = np.zeros((len(first) - 1, m), np.int32)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    at = first[full]
    for k in range(m):
        low = np.minimum.reduceat((h ^ _SEEDS[k]) * (_SEEDS[m + k] | np.uint64(1)), at)
        out[full, k] = (mix(low) >> np.uint64(48)).astype(np.int32)
    return out


def signature_table(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_id, signature`` of each row, in one pass over the texts."""

    def run(batches):
        for rows, t in slices(batches):
            h, first = distinct_per_text(*shingle_sets(t, WIDTH))
            sig = signatures(h, first)
            yield pa.record_batch(
                [
                    rows.column(0),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(set_ids(h, first), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, sig.shape[1], dtype=np.int32)), pa.array(sig.ravel())),
                ],
                names=["doc_id", "n_shingles", "set_id", "signature"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, signature array<int>")


def _keys(classes: DataFrame) -> DataFrame:
    """One row for each chunk and left-out component: the key and its class."""
    keys = []
    for c in range(CHUNKS):
        for out in range(CHUNK):
            kept = [F.col("signature")[c * CHUNK + i] for i in range(CHUNK) if i != out]
            keys.append(F.xxhash64(F.lit(c * CHUNK + out), *kept))
    return classes.select("id", F.explode(F.array(*keys)).alias("key"))


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` (b has many partners, if one has) whose full shingle sets have Jaccard similarity >= 3/4.

    Pairs beyond the guaranteed signature distance, or whose set sizes alone rule the
    similarity out, are dropped before any text is fetched.
    """
    c = classes.select("id", "n_shingles", "signature", "set_id")

    def side(x: str) -> DataFrame:
        found = c.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"), F.col("set_id").alias(f"set_{x}"))
        return found.hint("merge")

    differing = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    likely = (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
        .where(differing <= MOST_DISTANCE)
        .select("a", "b", "set_a", "set_b")
    )
    likely = materialize(likely.withColumn("pack", F.pmod(F.xxhash64("a"), F.lit(PACKS)).cast("int")), "likely")
    one = likely.select(F.col("a").alias("id"), F.col("b").alias("hub"), "pack", F.lit(1).alias("kind"), F.col("set_a").alias("want"))
    other = likely.select(F.col("b").alias("id"), F.col("b").alias("hub"), "pack", F.lit(0).alias("kind"), F.col("set_b").alias("want")).distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = text.join(one.union(other).hint("merge"), "id").repartition("hub", "pack").sortWithinPartitions("hub", "pack", "kind", "id")

    def run(batches):
        group, held = None, None
        for some, t in slices(batches):
            h, first = distinct_per_text(*shingle_sets(t, WIDTH))
            named, want = set_ids(h, first), some.column("want").to_pylist()
            columns = [some.column(x).to_pylist() for x in ("hub", "pack", "kind", "id")]
            a, b = [], []
            for i, (hub, pack, kind, node) in enumerate(zip(*columns, strict=True)):
                if (hub, pack) != group:
                    group, held = (hub, pack), None
                if named[i] != want[i]:
                    continue  # another row of that doc_id
                mine = h[first[i] : first[i + 1]]
                if kind == 0:
                    held = mine
                elif held is not None:
                    common = len(np.intersect1d(mine, held, assume_unique=True))
                    if 100 * common >= 75 * (len(mine) + len(held) - common):
                        a.append(node)
                        b.append(hub)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """``key, id, component`` of the keys that hold more than one component."""
    found = comp.select(F.col("node").alias("id"), "component")
    now = members.select("key", "id").join(found.hint("merge"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = now.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("key")
    return now.join(mixed.hint("merge"), "key")


def _grow(pairs: DataFrame, tried: DataFrame | None, links: DataFrame | None, classes: DataFrame, docs: DataFrame):
    """Confirm new ``pairs(id, c)``; the components, pairs tried and links after that."""
    pairs = pairs.select(F.col("id").alias("a"), F.col("c").alias("b")).distinct()
    if tried is not None:
        both = tried.union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = pairs.join(both.hint("merge"), ["a", "b"], "left_anti")
    pairs = materialize(pairs, "pairs")
    fresh = materialize(_confirm(pairs, classes, docs), "links")
    links = fresh if links is None else links.union(fresh)
    return materialize(components(links), "components"), pairs if tried is None else tried.union(pairs), links


def _prefix_pairs(left: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, c``: pairs across components that may be similar, by an exact prefix filter.

    Shingles are put in one order, the frequent ones last. If 7 * |x & y| >= 3 * (|x| + |y|),
    the first quarter of the larger set (plus one) and the first seventh of the smaller
    meet, and at their first common shingle enough of both is left. Shingles of all these
    documents are counted, in a fixed number of counters; two that share one are both taken
    for more frequent than they are, which bears on cost alone.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = materialize(text.join(left.hint("merge"), "id"), "open-texts")

    def sets(batches):
        counter = np.zeros(COUNTERS, np.int64)
        for _, t in slices(batches):
            h, _ = distinct_per_text(*shingle_sets(t, WIDTH))
            counter += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        k = np.flatnonzero(counter)
        yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(counter[k])], names=["k", "n"])

    counted = rows.select("text").mapInArrow(sets, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "shingle-counts")
    # up to twice the mean a count may come from sharing a counter: such shingles all count as rare
    mean = (counted.agg(F.sum("n").alias("n")).first()["n"] or 0) / COUNTERS
    counted = counted.where(F.col("n") > 2 * mean).where("n > 1").toArrow()  # at most half of COUNTERS
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted.column("k").to_numpy()] = counted.column("n").to_numpy()
    table = docs.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches):
        for some, t in slices(batches):
            h, first = distinct_per_text(*shingle_sets(t, WIDTH))
            doc = np.repeat(np.arange(t.n), np.diff(first))
            weight = table.value[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
            by_weight = np.lexsort((h, weight, doc))
            h, doc = h[by_weight], doc[by_weight]
            size = np.diff(first)[doc]
            at = np.arange(len(h)) - first[doc]
            probe = at < size - -(-3 * size // 4) + 1
            h, doc, size, at = h[probe], doc[probe], size[probe], at[probe]
            take = pa.array(doc)
            yield pa.record_batch(
                [some.column("id").take(take), some.column("component").take(take), pa.array(h.view(np.int64)), pa.array(size.astype(np.int64)), pa.array(at.astype(np.int64)), pa.array(at < size - -(-6 * size // 7) + 1)],
                names=["id", "component", "h", "size", "at", "index"],
            )

    entries = materialize(rows.select("id", "component", "text").mapInArrow(prefixes, "id long, component long, h long, size long, at long, index boolean"), "prefixes")
    small = entries.where("index").select("h", F.col("id").alias("c"), F.col("component").alias("cc"), F.col("size").alias("n"), F.col("at").alias("ca"))
    return entries.join(small.hint("merge"), "h").where("component <> cc and size >= n and 75 * size <= 100 * n and 7 * least(size - at, n - ca) >= 3 * (size + n)").select("id", "c")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sig = materialize(signature_table(docs), "signatures")
    classes = materialize(
        sig.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")),
        "classes",
    )
    keys = _keys(classes)
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    members = materialize(keys.join(shared.hint("merge"), "key"), "members")  # of keys with two classes or more
    shares = members.groupBy("id").agg(F.count("*").alias("shares"))  # high for members that others resemble most

    rank = F.struct((-F.col("shares")).alias("s"), F.xxhash64("id").alias("h"), "id")
    centre = members.join(shares.hint("merge"), "id").groupBy("key").agg(F.min(rank)["id"].alias("c"))
    comp, tried, links = _grow(members.join(centre.hint("merge"), "key").where("id <> c"), None, None, classes, docs)
    left = materialize(_open(members, comp).select("id", "component").distinct(), "open")
    if not left.isEmpty():
        comp, tried, links = _grow(_prefix_pairs(left, docs, classes), tried, links, classes, docs)
    by_set = classes.join(comp.withColumnRenamed("node", "id").hint("merge"), "id", "left").select("set_id", F.coalesce("component", "id").alias("found"))
    out = sig.join(by_set.hint("merge"), "set_id", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, with all its columns.

    Of repeated rows (one doc_id, several rows) all stay if that doc_id stays.
    """
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
