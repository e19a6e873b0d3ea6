"""Evidence retrieval: a lexical score by common tokens, and a diversified top-k."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions.text import contains_any, first_code, tokenize
from ..sources.shared import materialize
from . import lexical

K1, B = 1.5, 0.75


def average_length(chunks: DataFrame) -> DataFrame:
    """``project_id, avg_len``: tokens per chunk over each project."""
    return chunks.groupBy("project_id").agg((F.sum(F.size(tokenize(F.col("content")))) / F.greatest(F.count("*"), F.lit(1))).alias("avg_len"))


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """``project_id, chunk_id, token, tf, dl``: one row for each distinct token of a chunk."""
    lists = chunks.select("project_id", "chunk_id", tokenize(F.col("content")).alias("t"))
    rows = lists.select("project_id", "chunk_id", F.size("t").alias("dl"), F.explode("t").alias("token"))
    return rows.groupBy("project_id", "chunk_id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def token_counts(chunks: DataFrame) -> DataFrame:
    """``token, n, chunks``: how often each token stands, and in how many different chunk ids.

    A row's sorted tokens tell by their neighbours which are its first of a kind, so both counts
    combine before the shuffle and only tokens move. That counts an id once for each of its
    rows; ids of several rows are looked for beforehand, and what they add is taken off.
    """
    rows = chunks.select("chunk_id", F.sort_array(tokenize(F.col("content"))).alias("t"))
    beside = F.arrays_zip(F.col("t").alias("token"), F.concat(F.array(F.lit(None).cast("string")), "t").alias("before"))
    pairs = rows.select("chunk_id", F.explode(beside).alias("p")).where("p.token is not null").select("chunk_id", "p.token", "p.before")
    first = F.col("chunk_id").isNotNull() & ~F.col("token").eqNullSafe(F.col("before"))
    counted = pairs.groupBy("token").agg(F.count("*").alias("n"), F.count_if(first).alias("chunks"))
    again = materialize(chunks.groupBy("chunk_id").agg(F.count("*").alias("k")).where("k > 1 and chunk_id is not null").select("chunk_id"), "repeated-chunks")
    twice = rows.join(again, "chunk_id").select("chunk_id", F.explode(F.array_distinct("t")).alias("token")).groupBy("token", "chunk_id").agg((1 - F.count("*")).alias("less"))
    less = twice.groupBy("token").agg(F.lit(0).cast("long").alias("n"), F.sum("less").alias("chunks"))
    return counted.unionByName(less).groupBy("token").agg(F.sum("n").alias("n"), F.sum("chunks").alias("chunks"))


def query_tokens(requirements: DataFrame) -> DataFrame:
    """``project_id, req_id, token, qtf, at, is_code, has_digit, is_core`` of each requirement's text; ``at``: the token's places."""
    stop = fixed.RETRIEVAL_STOP_WORDS
    lists = requirements.select("project_id", "req_id", tokenize(F.col("text")).alias("t"), F.lower(first_code(F.col("text"))).alias("code"))
    words = lists.select("project_id", "req_id", "code", F.posexplode("t").alias("at", "token")).groupBy("project_id", "req_id", "code", "token").agg(F.count("*").alias("qtf"), F.array_sort(F.collect_list("at")).alias("at"))
    # a code written with other characters than its token never equals one; then no row has is_code
    return words.select(
        "project_id", "req_id", "token", "qtf", "at", F.coalesce(F.col("token") == F.col("code"), F.lit(False)).alias("is_code"), F.col("token").rlike("[0-9]").alias("has_digit"),
        ((F.length("token") > 3) & ~F.col("token").isin(stop)).alias("is_core"),
    )


def with_impact(tokens: DataFrame, avg: DataFrame) -> DataFrame:
    """Adds ``impact``: what a chunk's token adds to a score for each time a requirement has it, before boosts."""
    tf = F.col("tf")
    return tokens.join(avg, "project_id").withColumn("impact", tf * (K1 + 1) / (tf + K1 * (1 - B + B * (F.col("dl") / F.greatest("avg_len", F.lit(1.0)))))).drop("avg_len")


def _gain(impact: str = "impact") -> Column:
    """What one common token adds to a pair's score."""
    return F.col("qtf") * F.col(impact) + F.when(F.col("is_code"), 5.0).otherwise(0.0) + F.when(F.col("has_digit"), 2.0 * F.col("qtf")).otherwise(0.0) + F.when(F.col("is_core"), 1.5).otherwise(0.0)


def _total(raw: Column) -> Column:
    """A pair's score from the sum of its gains, rounded."""
    boosted = contains_any(F.lower("document_name"), fixed.BOOSTED_NAMES) & F.col("named")
    return F.round(raw + F.when(boosted, 1.0).otherwise(0.0), lexical.DIGITS)


_NAMED = "is_core or is_code"  # tokens that let a document's name count


def _matched(pairs: DataFrame, *more: Column) -> DataFrame:
    """``matched`` of each pair of ``project_id, req_id, chunk_id``, and ``more`` aggregates of it."""
    found = F.collect_list(F.when(F.length("token") > 2, F.struct("at", "token"))).alias("found")
    places = F.flatten(F.transform("found", lambda m: F.transform(m["at"], lambda at: F.struct(at.alias("at"), m["token"].alias("token")))))
    matched = F.transform(F.array_sort(places), lambda m: m["token"])
    return pairs.groupBy("project_id", "req_id", "chunk_id").agg(*more, found).withColumn("matched", matched).drop("found")


def _scored(pairs: DataFrame, chunks: DataFrame, min_score: float) -> DataFrame:
    """Scores of pairs from all their common tokens."""
    summed = _matched(pairs, F.sum(_gain()).alias("score"), F.bool_or(F.expr(_NAMED)).alias("named"))
    named = chunks.select("project_id", "chunk_id", "document_name")
    scored = summed.join(named, ["project_id", "chunk_id"]).select("project_id", "req_id", "chunk_id", "document_name", _total(F.col("score")).alias("score"), "matched")
    return scored.where(F.col("score") >= min_score)


def scores(requirements: DataFrame, chunks: DataFrame, min_score: float = 0.3) -> DataFrame:
    """``project_id, req_id, chunk_id, document_name, score, matched`` of pairs at ``min_score`` or more.

    Tokens meet by equality only, both sides with counts instead of repeats, and partial
    sums are combined before the shuffle. A pair without a common token scores 0.
    ``matched``: the requirement's tokens over two characters that the chunk has too, in the
    order of its text, repeats kept.
    """
    d = with_impact(chunk_tokens(chunks), average_length(chunks))
    return _scored(query_tokens(requirements).join(d, ["project_id", "token"]), chunks, min_score)


def diversified(scored: DataFrame, k: int, per_document: int = 2) -> DataFrame:
    """The best ``k`` per requirement, at most ``per_document`` of a document first, ``rank`` from 1.

    If fewer than ``k`` candidates exist there is no limit per document; free places go to
    the best of those put off. Ties go to the smaller chunk id. Only candidates that can
    still be chosen are ranked by requirement: in a document, those within its best k.
    """
    key = ["project_id", "req_id"]
    by_doc = Window.partitionBy(*key, "document_name").orderBy(F.desc("score"), "chunk_id")
    best = scored.withColumn("_d", F.row_number().over(by_doc)).where(F.col("_d") <= k)
    pool = F.count("*").over(Window.partitionBy(*key))
    tiered = best.withColumn("_tier", F.when((F.col("_d") <= per_document) | (pool < k), 0).otherwise(1))
    order = Window.partitionBy(*key).orderBy("_tier", F.desc("score"), "chunk_id")
    return tiered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_d", "_tier")


def _prepared(requirements: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requirements' tokens and sizes of projects, as :func:`.lexical.scanned` takes them."""
    q = query_tokens(requirements)
    extra = F.when(F.col("is_code"), 5.0).otherwise(0.0) + F.when(F.col("has_digit"), 2.0 * F.col("qtf")).otherwise(0.0) + F.when(F.col("is_core"), 1.5).otherwise(0.0)
    tokens = q.select("project_id", "req_id", "token", "qtf", extra.alias("boost"), F.expr(_NAMED).alias("named"))
    lists = chunks.select("project_id", tokenize(F.col("content")).alias("t"))
    dl, chars = F.greatest(F.size("t"), F.lit(0)), F.length(F.array_join("t", " ")) + 50
    sizes = lists.groupBy("project_id").agg((F.sum(dl) / F.greatest(F.count("*"), F.lit(1))).alias("avg_len"), F.sum(chars).alias("chars"))
    sizes = materialize(sizes.join(requirements.groupBy("project_id").agg(F.count("*").alias("n_requirements")), "project_id"), "project-sizes")
    return tokens, sizes


def _words(carry: tuple[str, ...], dealt: DataFrame) -> DataFrame:
    """Dealt chunks with what a group needs of their texts: only the texts are shuffled, and each is split by the task that scores it."""
    lists = dealt.withColumn("t", tokenize(F.col("content"))).where(F.size("t") > 0)
    boosted = F.coalesce(contains_any(F.lower("document_name"), fixed.BOOSTED_NAMES), F.lit(False))
    norm = K1 * (1 - B + B * (F.size("t") / F.greatest("avg_len", F.lit(1.0))))
    return lists.select(
        "project_id", "chunk_id", "document_name", *carry, "_group", "_block", F.array_join("t", " ").alias("words"), boosted.alias("boosted"), F.lit(K1 + 1).alias("gain"), norm.alias("norm")
    )


def score_totals(requirements: DataFrame, chunks: DataFrame, min_score: float = 0.3) -> DataFrame:
    """``project_id, req_id, pairs, best, total`` of the pairs that :func:`scores` gives."""
    tokens, sizes = _prepared(requirements, chunks)
    ids, rows = requirements.select("project_id", "req_id"), chunks.select("project_id", "chunk_id", "document_name", "content")
    columns = StructType([*ids.schema, *StructType.fromDDL("pairs long, best double, total double")])
    found = lexical.scanned(tokens, rows, sizes, partial(lexical.totals, min_score=min_score), columns, partial(_words, ()))
    return found.groupBy("project_id", "req_id").agg(F.sum("pairs").alias("pairs"), F.max("best").alias("best"), F.sum("total").alias("total"))


def retrieve(requirements: DataFrame, chunks: DataFrame, k: int = 5, min_score: float = 0.3, per_document: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Top-k evidence of each requirement, with ``matched`` as in :func:`scores`.

    ``requirements``: project_id, req_id, text. ``chunks``: project_id, chunk_id,
    document_name, content. Every pair of a project is scored, by groups (see
    :mod:`.lexical`); only those that may be among the best are ranked by Spark, after one
    shuffle by requirement. ``carry``: further columns of the chunks to give with their rows,
    which saves a join of all chunks.
    """
    key, own = ["project_id", "req_id"], ["chunk_id", "document_name"]
    tokens, sizes = _prepared(requirements, chunks)
    rows = chunks.select("project_id", *own, *dict.fromkeys(["content", *carry]))
    columns = StructType([*requirements.select(*key).schema, *chunks.select(*own).schema, *StructType.fromDDL("score double, held string"), *chunks.select(*carry).schema])
    fold = partial(lexical.best_rows, min_score=min_score, k=k, per_document=per_document, carry=carry)
    found = lexical.scanned(tokens, rows, sizes, fold, columns, partial(_words, carry))
    top = materialize(diversified(found.repartition(*key), k, per_document), "retrieved")
    words = F.filter("_words", lambda t: (F.length(t) > 2) & F.array_contains(F.split("held", " "), t))
    asked = requirements.select(*key, tokenize(F.col("text")).alias("_words"))
    return top.join(asked.hint("merge"), key).withColumn("matched", words).drop("held", "_words")
