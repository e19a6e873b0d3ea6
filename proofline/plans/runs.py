"""Queries of the composed runs, and of ground truth, result tables and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, runs
from ..sources import tables
from ..sources.shared import shared_dir
from .views import duck, shared, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PARTS = 20  # parts of a project
_PROJECT = f"CAST(req_id AS BIGINT) DIV {PARTS}"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each project and document name: its evidence line by line; every fifth project has a specification too."""
    e = shared(spark, sf_dir, "part_evidence").withColumn("project_id", F.expr(_PROJECT))
    code = F.concat(F.lit("REQ-PRT-"), F.lpad(F.col("req_id").cast("string"), 6, "0"))
    line = F.when(F.col("chunk_id") % 3 == 0, F.concat(code, F.lit(": "), "content")).otherwise(F.col("content"))
    texts = e.groupBy("project_id", "document_name").agg(F.sort_array(F.collect_list(F.struct("chunk_id", line.alias("line")))).alias("l"))
    r = shared(spark, sf_dir, "part_requirements").withColumn("project_id", F.expr(_PROJECT)).where(f"project_id % 5 = 4")
    head = F.concat("req_code", F.lit(": "), "title", F.lit("\n"), "description")
    spec = r.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct(F.col("req_id").alias("chunk_id"), head.alias("line")))).alias("l")).withColumn("document_name", F.lit("requirement_spec"))
    rows = texts.unionByName(spec.select(texts.columns))
    kind = F.when(tables.specification_names(F.col("document_name")), "Specification").otherwise("Document")
    return rows.select("project_id", F.xxhash64("project_id", "document_name").alias("document_id"), "document_name", kind.alias("doc_type"), F.array_join(F.col("l.line"), "\n").alias("text"))


def _requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = shared(spark, sf_dir, "part_requirements").withColumn("project_id", F.expr(_PROJECT))
    return r.select("project_id", F.col("req_id").cast("long").alias("req_id"), "req_code", "title", "description", F.lit("General").alias("category"), F.lit("Medium").alias("severity"), F.lit("table").alias("source_document"))


@query()
def audit_run(spark, sf_dir):
    """The whole audit: status, confidence, sources and finding of each requirement."""
    out = runs.audit(_documents(spark, sf_dir), _requirements(spark, sf_dir).where("project_id % 5 <> 4"), by="page_lines")
    found = out["findings"].select("req_id", "finding_code", "finding_type")
    return out["requirements"].join(found, "req_id", "left").select("project_id", "req_code", "coverage_status", "confidence", "review_state", "sources_count", "finding_code", "finding_type")


@query()
def evaluation_run(spark, sf_dir):
    """The whole evaluation, as metric and value."""
    truth = _requirements(spark, sf_dir).withColumn("expected_status", F.element_at(F.array(*[F.lit(x) for x in ("Supported", "Conflict", "Missing", "Partial")]), (F.col("req_id") % 4 + 1).cast("int")))
    links = truth.select("req_code", F.lit("test_report").alias("document"), F.lit(None).cast("int").alias("page"), F.col("title").alias("quote"))
    out = runs.evaluation(_documents(spark, sf_dir), truth, links, by="page_lines")
    parts = {"extraction": ["precision", "recall", "f1"], "retrieval": ["recall_at_1", "recall_at_3", "recall_at_5", "mrr"], "classification": ["accuracy", "macro_f1"], "specialty": ["conflict_f1", "missing_f1", "unsupported_claim_rate"]}
    found = [metrics.unpivot(out[name], {c: f"{name}_{c}" for c in columns}) for name, columns in parts.items()]
    return tables.union_all(found)


@query(f"""WITH {duck('requirements')} SELECT req_code, title, coverage_status AS expected_status, concat('doc', req_id % 7) AS document FROM requirements""")
def o_a7_ground_truth(spark, sf_dir):
    """Ground truth written as JSON and read with its schemas."""
    r = shared(spark, sf_dir, "requirements")
    folder = f"{shared_dir(spark)}/proofline/truth-{uuid.uuid4().hex}"
    r.select("req_code", "title", F.col("coverage_status").alias("expected_status")).write.json(f"{folder}/requirements.json")
    r.select("req_code", F.concat(F.lit("doc"), (F.col("req_id") % 7).cast("string")).alias("document"), F.lit(1).alias("page")).write.json(f"{folder}/evidence_links.json")
    r.limit(0).select("req_code").write.json(f"{folder}/expected_findings.json")
    found = tables.read_ground_truth(spark, folder, lines=True)
    return found["requirements"].select("req_code", "title", "expected_status").join(found["evidence_links"].select("req_code", "document"), "req_code")


@query(f"WITH {duck('findings')} SELECT project_id, count(*) AS n, count(DISTINCT finding_code) AS codes FROM findings GROUP BY 1")
def o_a8_persisted_results(spark, sf_dir):
    """Findings written by project and read again."""
    folder = f"{shared_dir(spark)}/proofline/results-{uuid.uuid4().hex}"
    tables.write_results({"findings": shared(spark, sf_dir, "findings")}, folder)
    return spark.read.parquet(f"{folder}/findings").groupBy(F.col("project_id").cast("int").alias("project_id")).agg(F.count("*").alias("n"), F.countDistinct("finding_code").alias("codes"))


@query(f"""WITH {duck('findings')} SELECT CAST(finding_id AS VARCHAR) AS finding_id, finding_code, finding_type, severity, assigned_to FROM findings""")
def o_a9_exported_csv(spark, sf_dir):
    """The finding list exported as CSV and read as text."""
    path = f"{shared_dir(spark)}/proofline/export-{uuid.uuid4().hex}"
    columns = ["finding_id", "finding_code", "finding_type", "severity", "assigned_to"]
    tables.export_csv(shared(spark, sf_dir, "findings").select(*columns), path)
    return spark.read.csv(path, header=True).select(*columns)
