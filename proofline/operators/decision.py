"""The coverage decision: gates, contradictions, verdicts, typed checks, semantic check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.contracts import parse_contract
from ..sources.shared import materialize
from ..functions.text import contains_any
from . import validators as v
from .claims import extract_claims
from .contradiction import contract_check, pair_contradictions


def with_contracts(requirements: DataFrame) -> DataFrame:
    """``requirements`` (req_id, req_code, title, description) with their contract."""
    return requirements.withColumn("contract", parse_contract(F.col("title"), F.col("description")))


def independent(name: Column) -> Column:
    """Whether a document of this name is evidence of its own, not a specification."""
    return ~contains_any(F.lower(name), fixed.SPEC_NAMES_DECISION)


def gates(requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """``req_id, n_candidates, n_independent`` of every requirement."""
    counts = candidates.groupBy("req_id").agg(F.count("*").alias("n"), F.count(F.when(independent(F.col("document_name")), 1)).alias("m"))
    return requirements.select("req_id").join(counts, "req_id", "left").select("req_id", F.coalesce("n", F.lit(0)).alias("n_candidates"), F.coalesce("m", F.lit(0)).alias("n_independent"))


def _assessment(status: Column, confidence: Column, review: Column, analysis: Column, advice: Column, path: str, highlight: Column) -> Column:
    return F.struct(
        status.alias("coverage_status"), confidence.cast("double").alias("confidence"), review.alias("review_state"), analysis.alias("analysis"), advice.alias("recommendation"), F.lit(path).alias("path"), highlight.cast("string").alias("highlight")
    )


_COVERAGE = {"SUPPORTED": "Supported", "PARTIAL": "Partial", "CONFLICT": "Conflict", "MISSING": "Missing", "UNKNOWN": "Partial"}


def coverage_of(status: Column) -> Column:
    """A check's status as a coverage status; UNKNOWN counts as Partial."""
    table = F.create_map(*[F.lit(x) for kv in _COVERAGE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, status), F.lit("Partial"))


def review_of(coverage: Column) -> Column:
    return F.when(coverage == "Supported", "Reviewed").when(coverage == "Missing", "Open").otherwise("Needs review")


def recommendation_of(coverage: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.RECOMMENDATIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, coverage), F.lit(fixed.OTHER_ADVICE))


def assess(requirements: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assessments of all requirements and their evidence links.

    ``requirements``: req_id, req_code, title, description. ``candidates``: req_id, rank,
    chunk_id, document_name, doc_type, page_number, content.
    """
    reqs = with_contracts(requirements)
    coded = candidates.join(reqs.select("req_id", "req_code"), "req_id")
    rows = materialize(v.facts(reqs, extract_claims(coded, contents=candidates.select("content"))), "facts")  # read twice: by the checks and for pairs
    kind = F.col("contract")["requirement_type"]
    typed = [v.range_check(kind == "numeric_range"), v.duration_check(kind == "duration"), v.threshold_check(kind == "threshold"), v.flag_check(kind.isin("boolean", "enumeration"))]
    verdict_, semantic, denied = v.verdict_check(), v.semantic_check(), contract_check()
    checks = [verdict_, *typed, semantic, denied]
    # one aggregation by requirement gathers what the gates and all checks need
    seen = v.marked(rows, checks).withColumn("_independent", F.lit(None).cast("boolean"))
    events = seen.unionByName(candidates.select("req_id", F.coalesce(independent(F.col("document_name")), F.lit(False)).alias("_independent")), allowMissingColumns=True)
    counts = [F.count("_independent").alias("n_candidates"), F.count_if("_independent").alias("n_independent")]
    found = events.groupBy("req_id").agg(*counts, *[g for c in checks for g in c.gathered])
    found = found.withColumns({name: text for c in checks for name, text in c.texts.items()})
    pairs = pair_contradictions(rows).withColumnRenamed("finding", "_pair")
    all_ = reqs.join(found, "req_id", "left").join(pairs, "req_id", "left").fillna(0, ["n_candidates", "n_independent"])
    all_ = all_.withColumns({"finding": F.coalesce(denied.outcome, "_pair"), "verdict": verdict_.outcome, "last": F.coalesce(*[t.outcome for t in typed], semantic.outcome)})
    lit, none = F.lit, F.lit(None)
    verdict, last = F.col("verdict"), F.col("last")
    verdict_cover, last_cover = coverage_of(verdict["status"]), coverage_of(last["status"])
    advice = F.when(verdict_cover == "Conflict", fixed.FAILURE_ADVICE).otherwise(fixed.SCHEDULE_ADVICE)
    result = (
        F.when(F.col("n_candidates") == 0, _assessment(lit("Missing"), lit(95.0), lit("Open"), lit(fixed.NO_EVIDENCE), lit(fixed.UPLOAD), "gate", none))
        .when(F.col("n_independent") == 0, _assessment(lit("Missing"), lit(95.0), lit("Open"), lit(fixed.NO_INDEPENDENT), lit(fixed.UPLOAD), "gate", none))
        .when(F.col("finding").isNotNull(), _assessment(lit("Conflict"), lit(92.0), lit("Needs review"), F.col("finding")["description"], lit(fixed.CONFLICT_ADVICE), "contradiction", F.col("finding")["highlight"]))
        .when(verdict.isNotNull(), _assessment(verdict_cover, verdict["confidence"], F.when(verdict_cover == "Missing", "Open").otherwise("Needs review"), verdict["reason"], advice, "verdict", none))
        .otherwise(_assessment(last_cover, last["confidence"], review_of(last_cover), last["reason"], recommendation_of(last_cover), "check", last["highlight"]))
    )
    assessed = all_.withColumn("_a", result).select("req_id", "req_code", "title", "contract", "_a.*")
    return assessed, evidence_links(assessed, candidates)


def evidence_links(assessed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links of each assessment: all candidates of a contradiction, independent ones of a check, else none."""
    name = F.col("document_name")
    rows = candidates.join(assessed.select("req_id", "coverage_status", "path", F.col("highlight").alias("_h")), "req_id")
    rows = rows.where((F.col("path") == "contradiction") | ((F.col("path") == "check") & independent(name)))
    shown = F.coalesce(F.contains(F.lower("content"), F.lower("_h")) & (F.col("_h") != ""), F.lit(False))
    conflict = F.col("path") == "contradiction"
    status = F.when(shown, "Potential conflict").when(conflict | (F.col("coverage_status") == "Supported"), "Supports requirement").otherwise("Supporting evidence")
    bare = F.when(conflict, F.replace(F.replace(name, F.lit(".pdf"), F.lit("")), F.lit(".docx"), F.lit(""))).otherwise(name)
    label = F.when(F.col("doc_type") != "Document", F.col("doc_type")).otherwise(bare)
    return rows.select("req_id", "chunk_id", "rank", "document_name", "page_number", F.col("content").alias("quote"), status.alias("status"), label.alias("label"), F.when(shown, F.col("_h")).alias("highlight"))
