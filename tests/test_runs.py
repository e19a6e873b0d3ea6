"""The composed runs: an audit from texts to findings, a second run over it, and its evaluation."""

import pytest

from proofline.operators import metrics, runs

DOCUMENT = "project_id long, document_id long, document_name string, doc_type string, text string"
REQUIREMENT = "project_id long, req_id long, req_code string, title string, description string, category string, severity string, source_document string"
REPORT = "Supply voltage tested from 8 V to 40 V in the lab.\nREQ-002: Sleep current measured as 90 uA in sleep mode.\nREQ-003: Enclosure ingress protection IP67 immersion check: NOT TESTED"
SPEC = "REQ-101: Supply voltage window\nThe unit shall operate from 9 V to 36 V DC.\nREQ-102: Sleep current\nCurrent draw shall not exceed 50 uA in sleep mode."
REQS = [
    (1, 1, "REQ-001", "Supply voltage window", "The unit shall operate from 9 V to 36 V DC.", "Electrical", "High", "srs"),
    (1, 2, "REQ-002", "Sleep current", "Current draw shall not exceed 50 uA in sleep mode.", "Electrical", "High", "srs"),
    (1, 3, "REQ-003", "Enclosure sealing", "Enclosure ingress protection shall be IP67 or better.", "Mechanical", "Medium", "srs"),
    (1, 4, "REQ-004", "Zebra crossing", "Qwertz uiopasd fghjkl shall be archived.", "Documentation", "Low", "srs"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(1, 10, "unit_test_report", "Document", REPORT), (2, 20, "unit_spec", "Specification", SPEC), (2, 21, "unit_test_report", "Document", REPORT.replace("REQ-002", "REQ-102")), (3, 30, "empty_manual", "Document", "")]
    return spark.createDataFrame(docs, DOCUMENT), spark.createDataFrame(REQS, REQUIREMENT)


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_audit(spark, tables):
    docs, reqs = tables
    out = runs.audit(docs, reqs, by="page_lines")
    got = {(r["project_id"], r["req_code"]): r for r in out["requirements"].collect()}
    assert {k: r["coverage_status"] for k, r in got.items() if k[0] == 1} == {(1, "REQ-001"): "Supported", (1, "REQ-002"): "Conflict", (1, "REQ-003"): "Missing", (1, "REQ-004"): "Missing"}
    assert {k for k in got if k[0] == 2} == {(2, "REQ-101"), (2, "REQ-102")}  # from the specification, as the project had none
    # the specification's own line is the best evidence of the limit, and comes before the report's
    assert got[2, "REQ-102"]["coverage_status"] == "Supported" and got[2, "REQ-102"]["source_document"] == "unit_spec"
    codes = {(r["project_id"], r["req_code"]): r["finding_code"] for r in out["findings"].collect()}
    assert {k: v for k, v in codes.items() if k[0] == 1} == {(1, "REQ-002"): "F-001", (1, "REQ-003"): "F-002", (1, "REQ-004"): "F-003"}
    documents = {r["document_id"]: r for r in out["documents"].collect()}
    assert documents[30]["processing_status"] == "Queued" and documents[10]["processing_status"] == "Indexed" and documents[10]["page_count"] == 3
    links = out["links"].collect()
    assert documents[10]["requirements_linked"] == sum(r["document_name"] == "unit_test_report" and r["req_id"] < 10 for r in links)
    assert {k: r["sources_count"] for k, r in got.items()} == {k: sum(x["req_id"] == r["req_id"] for x in links) for k, r in got.items()}
    summary = {r["project_id"]: (r["documents_indexed"], r["requirements_analyzed"], r["findings_generated"]) for r in out["summary"].collect()}
    assert summary[1] == (1, 4, 3) and summary[3] == (1, 0, 0)

    again = runs.audit(docs, reqs, out["chunks"], by="page_lines")  # chunks are used again; all results are the same
    for name in out:
        assert rows(again[name].select(out[name].columns)) == rows(out[name]), name
    assert runs.audit(docs.limit(0), reqs.limit(0))["summary"].count() == 0


def test_evaluation(spark, tables):
    docs, _ = tables
    truth = spark.createDataFrame(
        [(2, "req_101", "Supply voltage window", "The unit shall operate from 9 V to 36 V DC.", "verified"), (2, "REQ-102", "Sleep current", "Current draw shall not exceed 50 uA in sleep mode.", "Missing")],
        "project_id long, req_code string, title string, description string, expected_status string",
    )
    links = spark.createDataFrame([("REQ-101", "unit_test_report", None, "short"), ("REQ-102", "nowhere", None, "short")], "req_code string, document string, page int, quote string")
    out = {k: v.collect() for k, v in runs.evaluation(docs, truth, links, by="page_lines").items()}
    e = out["extraction"][0]
    assert (e["tp"], e["fp"], e["fn"], e["f1"]) == (2, 0, 0, 100.0)
    assert out["classification"][0]["accuracy"] == 50.0 and out["retrieval"][0]["recall_at_5"] == 50.0
    assert [(r["code"], r["expected"], r["actual"], r["error_type"]) for r in out["failures"]] == [("REQ-102", "Missing", "Supported", "unsupported_claim")]
    assert {r["code"]: (r["expected"], r["actual"], r["correct"]) for r in out["results"]} == {"REQ-101": ("Supported", "Supported", True), "REQ-102": ("Missing", "Supported", False)}


def test_evaluation_of_requirements_that_share_a_code(spark, tables, monkeypatch):
    """Each is assessed by itself and once, and meets its own assessment, in its project and in others."""
    docs, _ = tables
    texts = [("Supply voltage window", "The unit shall operate from 9 V to 36 V DC."), ("Sleep current", "Current draw shall not exceed 50 uA in sleep mode."), ("Zebra crossing", "Qwertz uiopasd fghjkl shall be archived."), (None, "Qwertz"), ("Qwertz", None)]
    truth = [(p, "REQ-900", *t, "Missing") for p in (1, 3) for t in [*texts, texts[2]]]
    columns = "project_id long, req_code string, title string, description string, expected_status string"
    links = spark.createDataFrame([("REQ-900", "unit_test_report", None, "short")], "req_code string, document string, page int, quote string")
    seen = {}

    def kept(df, name, whole=runs.materialize):
        seen[name] = whole(df, name)
        return seen[name]

    monkeypatch.setattr(runs, "materialize", kept)
    out = runs.evaluation(docs, spark.createDataFrame(truth, columns), links, by="page_lines")
    assert seen["evaluation-requirements"].count() == 2 * len(texts)
    got = seen["evaluation-retrieved"].select("req_id", "chunk_id")
    assert got.count() == got.distinct().count() > 0
    assert out["counts"].first()["total"] == len(truth) == out["results"].count()
    apart = [(p, f"REQ-{900 + k}", *t, "Missing") for k, (p, _, *t, _) in enumerate(truth)]  # the same under codes of their own
    alone = runs.evaluation(docs, spark.createDataFrame(apart, columns), links, by="page_lines")["results"].collect()
    assert sorted(r["actual"] for r in out["results"].collect()) == sorted(r["actual"] for r in alone) and len({r["actual"] for r in alone}) > 1


def test_first_hits_broadcast_nothing(spark):
    """Links and retrieved chunks grow with the requirements, however small Spark takes them to be."""
    links = spark.range(1, 2).selectExpr("concat('REQ-', id) AS req_code", "'report' AS document", "CAST(NULL AS INT) AS page", "'short' AS quote")
    got = spark.range(1, 2).selectExpr("concat('REQ-', id) AS req_code", "2 AS rank", "'a_report' AS document_name", "1 AS page_number", "'text' AS content")
    found = metrics.first_hits(links, got)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("REQ-1", 2)]
