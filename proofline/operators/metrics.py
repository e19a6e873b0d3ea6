"""Evaluation against ground truth: extraction, retrieval, classification, failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import normalize_code, normalize_status
from ..sources.tables import running_code, running_numbers

POINTS = 2


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def _percent(c: Column, scale: int = POINTS) -> Column:
    return F.bround(100.0 * c, scale)


def _last_by_code(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("code", normalize_code(F.col("req_code"))).groupBy("code").agg(F.lower(F.coalesce(F.max_by("title", order), F.lit(""))).alias("title"))


WIDEST = 32  # characters of a title by which it is looked up, at most


def _standing(held: DataFrame, outer: DataFrame) -> DataFrame:
    """``held, outer``: the titles of ``held(held)`` that stand in those of ``outer(outer)``.

    A title is filed under its first characters: as many as the greatest power of two up to
    ``WIDEST`` that it has. Where such characters stand in another title, the pieces of the
    filed lengths that begin there are looked up whole. So what a title gives depends on its
    own length, not on how many titles share words with it.
    """
    n, widths = F.length("held"), [2**k for k in range(WIDEST.bit_length())]
    width = F.coalesce(*[F.when(n >= w, F.lit(w)) for w in reversed(widths)])
    filed = held.select(F.xxhash64(F.substring(F.col("held"), F.lit(1), width)).alias("key"), width.alias("width"), n.alias("n"))
    filed = filed.groupBy("key", "width").agg(F.collect_set("n").alias("lengths"))
    used = filed.agg(F.collect_set("width").alias("widths"))  # a row
    size, c = F.length("outer"), F.col("outer")
    at = lambda w: F.transform(F.sequence(F.lit(1), size - w + 1), lambda i: F.struct(i.alias("at"), w.alias("width"), F.xxhash64(F.substring(c, i, w)).alias("key")))
    places = F.flatten(F.transform(F.filter("widths", lambda w: w <= size), at))
    looked = outer.crossJoin(F.broadcast(used)).select("outer", F.inline(places)).join(filed.hint("merge"), ["key", "width"])
    looked = looked.select("outer", "at", F.explode("lengths").alias("n")).where(F.col("at") + F.col("n") - 1 <= size)
    pieces = looked.select("outer", F.substring(c, F.col("at"), F.col("n")).alias("held"))
    return pieces.join(held.hint("merge"), "held")


def _containing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``title`` of those rows of ``a(title)`` that contain a row of ``b(other)`` or stand in one."""
    up = _standing(a.select(F.col("title").alias("held")), b.select(F.col("other").alias("outer"))).select(F.col("held").alias("title"))
    down = _standing(b.select(F.col("other").alias("held")), a.select(F.col("title").alias("outer"))).select(F.col("outer").alias("title"))
    return up.union(down).distinct()


def match_extraction(truth: DataFrame, extracted: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """``code, matched`` of the distinct true codes, and the distinct extracted codes.

    Equal codes match first. Only true codes left over are compared by title, with
    containment either way (:func:`_standing`). Codes and titles grow with the data, so their
    joins are never by broadcast.
    """
    t = _last_by_code(truth, order)
    e = _last_by_code(extracted, order).where("code <> ''")
    by_code = t.join(e.select("code").hint("merge"), "code", "left_semi").select("code")
    rest = t.join(e.select("code").hint("merge"), "code", "left_anti")
    titles = e.where("title <> ''").select(F.col("title").alias("other")).distinct()
    mine = rest.where("title <> ''").select("code", "title")
    pairs = _containing(mine.select("title").distinct(), titles)
    near = mine.join(pairs.hint("merge"), "title", "left_semi").select("code").union(rest.where("title = ''").join(titles.limit(1), F.lit(True), "left_semi").select("code")).distinct()
    matched = by_code.union(near).withColumn("matched", F.lit(True))
    return t.join(matched.hint("merge"), "code", "left").select("code", F.coalesce("matched", F.lit(False)).alias("matched")), e.select("code")


def extraction_scores(truth: DataFrame, extracted: DataFrame, order: str = "ord") -> DataFrame:
    """One row: total_truth, total_extracted, tp, fp, fn, precision, recall, f1 (percent)."""
    t, e = match_extraction(truth, extracted, order)
    counts = t.agg(F.count("*").alias("total_truth"), F.count_if("matched").alias("tp")).crossJoin(e.agg(F.count("*").alias("total_extracted")))  # a row each
    c = counts.withColumn("fn", F.col("total_truth") - F.col("tp")).withColumn("fp", F.greatest(F.lit(0), F.col("total_extracted") - F.col("tp")))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("total_truth", "total_extracted", "tp", "fp", "fn", _percent(p).alias("precision"), _percent(r).alias("recall"), _percent(_f1(p, r)).alias("f1"))


def evidence_hit(expected_doc: Column, expected_page: Column, expected_quote: Column, doc: Column, page: Column, content: Column, strict: bool = False) -> Column:
    """Whether a retrieved chunk is the expected source: by document and page, or by half of the quote's long words.

    An empty chunk name matches any document, unless ``strict``.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    want, have, text, quote = low(expected_doc), low(doc), low(content), low(expected_quote)
    named = ((want != "") & F.contains(have, want)) | (F.contains(want, have) & ((have != "") if strict else F.lit(True)))
    paged = expected_page.isNull() | page.isNull() | (expected_page == page)
    words = F.filter(F.regexp_extract_all(quote, F.lit(fixed.WORD), F.lit(0)), lambda w: F.length(w) > 4)
    found = F.size(F.filter(words, lambda w: F.contains(text, w)))
    quoted = (F.length(quote) > 15) & (F.size(words) > 0) & (found >= 0.5 * F.size(words))
    return (named & paged) | quoted


def first_hits(links: DataFrame, retrieved: DataFrame, cut: int = 5) -> DataFrame:
    """``code, first_hit`` (rank or null) of every query that has expected links.

    ``links``: req_code, document, page, quote. ``retrieved``: req_code, rank,
    document_name, page_number, content. Both meet within a requirement only, and grow with
    the data, so their joins are never by broadcast.
    """
    want = links.select(normalize_code(F.col("req_code")).alias("code"), "document", "page", "quote")
    got = retrieved.where(F.col("rank") <= cut).select(normalize_code(F.col("req_code")).alias("code"), "rank", "document_name", "page_number", "content")
    hit = evidence_hit(F.col("document"), F.col("page"), F.col("quote"), F.col("document_name"), F.col("page_number"), F.col("content"))
    first = want.join(got.hint("merge"), "code").where(hit).groupBy("code").agg(F.min("rank").alias("first_hit"))
    return want.select("code").distinct().join(first.hint("merge"), "code", "left")


def retrieval_scores(links: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One row: total_queries, recall_at_1, recall_at_3, recall_at_5 (percent), mrr."""
    h = first_hits(links, retrieved)
    n = F.count("*")
    at = lambda k: _percent(_ratio(F.count_if(F.col("first_hit") <= k), n)).alias(f"recall_at_{k}")
    return h.agg(n.alias("total_queries"), at(1), at(3), at(5), F.bround(_ratio(F.sum(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))), n), 4).alias("mrr"))


def expected_actual(truth: DataFrame, predicted: DataFrame, key: str | None = None) -> DataFrame:
    """``code, expected, actual`` of every true requirement; no prediction counts as Missing.

    Both meet by code, or by ``key``, a column of both, where codes repeat.
    """
    own = normalize_code(F.col("req_code")) if key is None else F.col(key)
    t = truth.select(own.alias("_own"), normalize_code(F.col("req_code")).alias("code"), normalize_status(F.col("expected_status")).alias("expected"))
    p = predicted.select(own.alias("_own"), F.col("status"))
    return t.join(p, "_own", "left").select("code", "expected", normalize_status(F.col("status")).alias("actual"))


def confusion(pairs: DataFrame) -> DataFrame:
    """``expected, actual, n``: all sixteen cells."""
    s = pairs.sparkSession
    axis = lambda name: s.createDataFrame([(x,) for x in fixed.STATUSES], f"{name} string")
    cells = axis("expected").crossJoin(axis("actual"))  # four by four names
    counts = pairs.groupBy("expected", "actual").agg(F.count("*").alias("n"))
    return F.broadcast(cells).join(counts, ["expected", "actual"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_scores(pairs: DataFrame) -> DataFrame:
    """``status, support, precision, recall, f1`` (percent) of each status."""
    rows = confusion(pairs)
    sums = [F.sum(F.when((F.col("expected") == s) & (F.col("actual") == s), F.col("n")).otherwise(0)).alias(f"tp_{s}") for s in fixed.STATUSES]
    sums += [F.sum(F.when(F.col("expected") == s, F.col("n")).otherwise(0)).alias(f"real_{s}") for s in fixed.STATUSES]
    sums += [F.sum(F.when(F.col("actual") == s, F.col("n")).otherwise(0)).alias(f"said_{s}") for s in fixed.STATUSES]
    wide = rows.agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"tp_{s}").alias("tp"), F.col(f"real_{s}").alias("support"), F.col(f"said_{s}").alias("said")) for s in fixed.STATUSES])).alias("c")
    c = wide.select(each).select("c.*").withColumn("_p", _ratio(F.col("tp"), F.col("said"))).withColumn("_r", _ratio(F.col("tp"), F.col("support"))).withColumn("_f", _f1(F.col("_p"), F.col("_r")))
    return c.select("status", "support", "tp", _percent(F.col("_p")).alias("precision"), _percent(F.col("_r")).alias("recall"), _percent(F.col("_f")).alias("f1"), "_f", "_p", "_r")


def classification_scores(pairs: DataFrame) -> DataFrame:
    """One row: total, accuracy, macro and weighted precision, recall and F1 (percent)."""
    c = class_scores(pairs)
    n = F.sum("support")
    weighted = lambda x: _percent(_ratio(F.sum(F.col(x) * F.col("support")), n))
    return c.agg(
        n.alias("total"), _percent(_ratio(F.sum("tp"), n)).alias("accuracy"), _percent(F.avg("_p")).alias("macro_precision"), _percent(F.avg("_r")).alias("macro_recall"), _percent(F.avg("_f")).alias("macro_f1"),
        weighted("_p").alias("weighted_precision"), weighted("_r").alias("weighted_recall"), weighted("_f").alias("weighted_f1"),
    )


def specialty_scores(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """One row: conflict and missing precision, recall and F1, and the unsupported-claim rate.

    A Missing requirement called Supported is unsupported and, unless ``strict``, no
    false negative of Missing.
    """
    e, a = F.col("expected"), F.col("actual")
    fn = (e == "Missing") & (a != "Missing") & (F.lit(True) if strict else a != "Supported")
    s = pairs.agg(
        F.count_if((e == "Conflict") & (a == "Conflict")).alias("ct"), F.count_if((e != "Conflict") & (a == "Conflict")).alias("cp"), F.count_if((e == "Conflict") & (a != "Conflict")).alias("cn"),
        F.count_if((e == "Missing") & (a == "Missing")).alias("mt"), F.count_if((e != "Missing") & (a == "Missing")).alias("mp"), F.count_if(fn).alias("mn"),
        F.count_if(e == "Missing").alias("total_missing"), F.count_if((e == "Missing") & (a == "Supported")).alias("unsupported"),
    )
    out = []
    for name, k in (("conflict", "c"), ("missing", "m")):
        p, r = _ratio(F.col(f"{k}t"), F.col(f"{k}t") + F.col(f"{k}p")), _ratio(F.col(f"{k}t"), F.col(f"{k}t") + F.col(f"{k}n"))
        out += [_percent(p).alias(f"{name}_precision"), _percent(r).alias(f"{name}_recall"), _percent(_f1(p, r)).alias(f"{name}_f1")]
    return s.select(*out, _percent(_ratio(F.col("unsupported"), F.col("total_missing"))).alias("unsupported_claim_rate"), "total_missing", "unsupported")


def failures(pairs: DataFrame, links: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``code, expected, actual, error_type`` of every wrong prediction."""
    hits = first_hits(links, retrieved, cut=2_000_000_000)
    e, a = F.col("expected"), F.col("actual")
    kind = (
        F.when((e == "Missing") & (a == "Supported"), "unsupported_claim")
        .when(e == "Conflict", "conflict_detection_error")
        .when(F.col("linked") & F.col("first_hit").isNull(), "retrieval_error")
        .otherwise("verification_error")
    )
    rows = pairs.where("expected <> actual").join(hits.withColumn("linked", F.lit(True)), "code", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    return rows.select("code", "expected", "actual", kind.alias("error_type"))


def result_table(pairs: DataFrame, links: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per requirement: expected and actual status, correct, expected and retrieved sources, first hit."""
    n_links = links.groupBy(normalize_code(F.col("req_code")).alias("code")).agg(F.count("*").alias("n_expected"))
    n_got = retrieved.groupBy(normalize_code(F.col("req_code")).alias("code")).agg(F.count("*").alias("n_retrieved"))
    out = pairs.join(n_links, "code", "left").join(n_got, "code", "left").join(first_hits(links, retrieved), "code", "left")
    return out.select("code", "expected", "actual", (F.col("expected") == F.col("actual")).alias("correct"), F.coalesce("n_expected", F.lit(0)).alias("n_expected"), F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"), "first_hit")


def dataset_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("total"), *[F.count_if(F.col("expected") == s).alias(s.lower()) for s in fixed.STATUSES])


def truth_links(requirements: DataFrame) -> DataFrame:
    """Evidence links of requirements that hold ``sources``: an array of (document, page, relationship, quote)."""
    return requirements.select("req_code", F.inline("sources"))


def truth_findings(requirements: DataFrame, project: str) -> DataFrame:
    """Expected findings of requirements that are not Supported, with running codes per project."""
    rows = requirements.where(normalize_status(F.col("expected_status")) != "Supported")
    rows = running_numbers(rows, [project], ["req_code"], _n=F.lit(True))
    table = F.create_map(*[F.lit(x) for kv in fixed.FINDING_TYPES.items() for x in kv])
    evidence = F.transform("sources", lambda s: F.struct(s["document"].alias("document"), s["page"].alias("page")))
    return rows.select(project, running_code("F-", F.col("_n"), 3).alias("finding_code"), "req_code", "expected_status", F.try_element_at(table, normalize_status(F.col("expected_status"))).alias("finding_type"), evidence.alias("expected_evidence"))


def quality_gate(metrics: DataFrame) -> DataFrame:
    """``metric, value, target, verdict`` of ``metric, value`` rows: PASS, REVIEW, or FAIL for any unsupported claim."""
    targets = metrics.sparkSession.createDataFrame(list(fixed.QUALITY_TARGETS.items()), "metric string, target double")
    rate = F.col("metric") == "unsupported_claim_rate"
    verdict = F.when(rate, F.when(F.col("value") == 0, "PASS").otherwise("FAIL")).when(F.col("value") >= F.col("target"), "PASS").otherwise("REVIEW")
    return metrics.join(F.broadcast(targets), "metric").withColumn("verdict", verdict)


def unpivot(one_row: DataFrame, names: dict[str, str]) -> DataFrame:
    """``metric, value`` rows of the named columns of a one-row table."""
    parts = [one_row.select(F.lit(metric).alias("metric"), F.col(c).cast("double").alias("value")) for c, metric in names.items()]
    return reduce(DataFrame.unionByName, parts)
