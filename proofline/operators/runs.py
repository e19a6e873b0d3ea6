"""The two runs a user starts: an audit from documents to findings, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_requirements, normalize_code
from ..sources.shared import materialize
from ..sources.tables import specification_names
from . import decision, maintenance, metrics, outputs, retrieval
from .chunking import page_chunks, reassemble, section_chunks

PASSAGES = {"page": page_chunks, "page_lines": lambda docs: page_chunks(docs, "\n"), "section": section_chunks}

SHOWN = ("doc_type", "page_number", "content")  # what the decision and its links take from a chunk besides its name


def chunked(documents: DataFrame, chunks: DataFrame | None = None, by: str = "section") -> DataFrame:
    """Chunks of all ``documents``: those given are used again, only documents without any are parsed.

    A chunk's id is a hash of its document and place, so a second run gives the same ids.
    """
    fields = ["project_id", "document_id", "document_name", "doc_type"]
    new = documents if chunks is None else maintenance.unparsed(documents, chunks)
    made = PASSAGES[by](new.select(*fields, "text"))
    page = F.col("page_number") if "page_number" in made.columns else F.lit(None).cast("int")
    made = made.select(*fields, F.xxhash64("document_id", "chunk_index").alias("chunk_id"), "chunk_index", page.alias("page_number"), "content")
    return made if chunks is None else chunks.select(*made.columns).unionByName(made)


def found_requirements(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Requirements read from the specifications of projects that have none yet."""
    open_ = chunks.join(known.select("project_id").distinct(), "project_id", "left_anti").where(specification_names(F.col("document_name")))
    texts = reassemble(open_, ["project_id", "document_id", "document_name"], "\n")
    rows = texts.select("project_id", "document_id", F.col("document_name").alias("source_document"), F.posexplode(extract_requirements(F.col("text"))).alias("ord", "r"))
    return rows.select("project_id", F.xxhash64("document_id", "ord").alias("req_id"), "r.req_code", "r.title", "r.description", "r.category", "r.severity", "source_document")


def audit(documents: DataFrame, requirements: DataFrame, chunks: DataFrame | None = None, *, k: int = 4, min_score: float = 0.3, by: str = "section") -> dict[str, DataFrame]:
    """A whole audit of all projects; the result tables by name.

    ``documents``: project_id, document_id, document_name, doc_type, text. ``requirements``:
    project_id, req_id, req_code, title, description, category, severity, source_document;
    projects without any get those of their specifications. Gives chunks, requirements
    (with coverage and number of sources), links, findings, documents (with status and
    linked requirements) and summary (a row for each project). Nothing of an earlier run is
    read, so a second run replaces the first and gives the same rows.
    """
    pieces = materialize(chunked(documents, chunks, by), "audit-chunks")
    fields = ["project_id", "req_id", "req_code", "title", "description", "category", "severity", "source_document"]
    reqs = materialize(requirements.select(*fields).unionByName(found_requirements(pieces, requirements)), "audit-requirements")
    asked = reqs.select("project_id", "req_id", F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))).alias("text"))
    top = retrieval.retrieve(asked, pieces, k, min_score, carry=SHOWN)
    candidates = top.select("req_id", "rank", "chunk_id", "document_name", *SHOWN)
    assessed, links = decision.assess(reqs, materialize(candidates, "audit-candidates"))
    assessed, links = materialize(assessed.drop("contract"), "audit-assessed"), materialize(links, "audit-links")
    updated = materialize(outputs.updated_requirements(reqs, assessed, links), "audit-updated")
    found = outputs.findings(updated.withColumn("description", F.col("analysis")).drop("analysis"))
    status = maintenance.document_status(documents.drop("text"), pieces)
    linked = status.join(maintenance.linked_counts(documents, pieces, links), "document_id", "left")
    counts = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
    summary = counts(documents, "documents_indexed").join(counts(updated, "requirements_analyzed"), "project_id", "left").join(counts(found, "findings_generated"), "project_id", "left")
    summary = summary.na.fill(0, ["requirements_analyzed", "findings_generated"]).withColumn("status", F.lit("Analysis complete"))
    return {"chunks": pieces, "requirements": updated, "links": links, "findings": found, "documents": linked, "summary": summary}


def evaluation(documents: DataFrame, truth: DataFrame, truth_links: DataFrame, *, k: int = 7, min_score: float = 0.2, by: str = "section") -> dict[str, DataFrame]:
    """The audit's parts against ground truth; tables by name.

    ``truth``: project_id, req_code, title, description, expected_status. ``truth_links``:
    req_code, document, page, quote. Every true requirement is assessed, whatever extraction
    finds: by itself, also where a project's rows share a code, and rows of one text once.
    Gives extraction, retrieval, classification, specialty, confusion, classes,
    failures, results and counts.
    """
    # a null is left out of a hash: the flag says which of the two texts there is
    truth = truth.withColumn("req_id", F.xxhash64("project_id", "req_code", F.col("title").isNull(), "title", "description"))
    pieces = materialize(chunked(documents, None, by), "evaluation-chunks")
    extracted = found_requirements(pieces, truth.limit(0)).withColumn("ord", F.col("req_id"))
    reqs = truth.select("project_id", "req_id", normalize_code(F.col("req_code")).alias("req_code"), "title", "description")
    reqs = materialize(reqs.dropDuplicates(["req_id"]), "evaluation-requirements")
    asked = reqs.select("project_id", "req_id", F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))).alias("text"))
    top = retrieval.retrieve(asked, pieces, k, min_score, carry=SHOWN).select("req_id", "rank", "chunk_id", "score", "document_name", *SHOWN)
    got = top.join(reqs.select("req_id", "req_code"), "req_id")
    got = materialize(got, "evaluation-retrieved")
    assessed, _ = decision.assess(reqs, got.drop("req_code", "score"))
    pairs = materialize(metrics.expected_actual(truth, assessed.select("req_id", F.col("coverage_status").alias("status")), "req_id"), "evaluation-pairs")
    return {
        "extraction": metrics.extraction_scores(truth.withColumn("ord", F.col("req_code")), extracted),
        "retrieval": metrics.retrieval_scores(truth_links, got),
        "classification": metrics.classification_scores(pairs),
        "specialty": metrics.specialty_scores(pairs),
        "confusion": metrics.confusion(pairs),
        "classes": metrics.class_scores(pairs),
        "failures": metrics.failures(pairs, truth_links, got),
        "results": metrics.result_table(pairs, truth_links, got),
        "counts": metrics.dataset_counts(pairs),
    }
