import json

from pyspark.sql import functions as F

from proofline.operators import chunking, maintenance, metrics, outputs
from proofline.sources import tables
from proofline.streaming import ingest


def test_rows_and_sheets(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, "", ""), (3, "b", "x")], "k int, name string, note string")
    got = tables.linearise_rows(df, ["k"], ["name", "note"], "t.csv").orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["row"], r["content"]) for r in got] == [(0, 2, "name: a"), (1, 4, "name: b; note: x")]
    cells = spark.createDataFrame([("d", 1, "s", 1, ["h", ""]), ("d", 1, "s", 2, ["1", "2"]), ("d", 2, "t", 1, ["g"]), ("d", 2, "t", 2, ["3"])], "document_name string, sheet_no int, sheet string, row long, cells array<string>")
    got = tables.linearise_sheets(cells).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["content"]) for r in got] == [(0, "h: 1; Col1: 2"), (1, "g: 3")]


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,v\n1,x\n".encode())
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "v"] and df.first()["id"] == "1"


def test_pages_and_sections(spark):
    d = spark.createDataFrame([(1, "one\f \f two ")], "document_id int, text string")
    assert [(r["page_number"], r["chunk_index"], r["content"]) for r in chunking.page_chunks(d).orderBy("chunk_index").collect()] == [(1, 0, "one"), (3, 2, "two")]
    long = "x" * 1501
    d = spark.createDataFrame([(1, f"# A\nb\n\nREQ-1: c\n{long}\nd"), (2, "")], "document_id int, text string")
    assert [r["content"] for r in chunking.section_chunks(d).orderBy("chunk_index").collect()] == ["# A\nb", f"REQ-1: c\n{long}", "d"]


def test_reassemble(spark):
    c = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "document_id int, chunk_index int, content string")
    assert chunking.reassemble(c, ["document_id"]).first()["text"] == "a b"
    assert chunking.reassemble(c, ["document_id"], "\n", lead=True).first()["text"] == "\na\nb"


def test_routing_and_numbers(spark):
    p = spark.createDataFrame([("a/B.PDF",), ("c.exe",)], "path string")
    known, bad = tables.route_documents(p)
    assert known.first()["doc_type"] == "Specification" and bad.first()["suffix"] == ".exe"
    c = spark.createDataFrame([("b", 0), ("a", 1), ("a", 0)], "document_name string, chunk_index int")
    got = {(r["document_name"], r["chunk_index"]): r["chunk_id"] for r in tables.number_chunks(c).collect()}
    assert got == {("a", 0): "chunk-0001", ("a", 1): "chunk-0002", ("b", 0): "chunk-0003"}


def test_files_truth_and_sinks(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello")
    r = tables.register_files(spark, str(tmp_path)).first()
    assert (r["original_filename"], r["file_size"], r["processing_status"]) == ("x.txt", 5, "Queued")
    for name in tables.GROUND_TRUTH:
        (tmp_path / f"{name}.json").write_text(json.dumps([{"req_code": "REQ-1"}]))
    assert all(df.first()["req_code"] == "REQ-1" for df in tables.read_ground_truth(spark, str(tmp_path)).values())
    df = spark.createDataFrame([(1, "a", [1])], "project_id int, x string, l array<int>")
    tables.write_results({"t": df}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/t")).count() == 1
    tables.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["l"] == "[1]"


def test_maintenance(spark, tmp_path):
    docs = spark.createDataFrame([(1,), (2,)], "document_id int")
    chunks = spark.createDataFrame([(1, "c")], "document_id int, content string")
    assert [r[0] for r in maintenance.unparsed(docs, chunks).collect()] == [2]
    made = maintenance.incremental_chunks(docs, chunks, lambda d: d.withColumn("content", F.lit("new")))
    assert {(r[0], r[1]) for r in made.collect()} == {(1, "c"), (2, "new")}
    t = spark.createDataFrame([(1, "old", 5)], "k int, a string, b int")
    e = spark.createDataFrame([(1, None, 7, True, False)], "k int, a string, b int, has_a boolean, has_b boolean")
    assert maintenance.patch(t, e, "k", ["a", "b"]).first() == (1, None, 5)
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "project_id int, x string")
    maintenance.replace_projects(rows, path)
    maintenance.replace_projects(spark.createDataFrame([(2, "c")], "project_id int, x string"), path)
    assert {(r["project_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_traces(spark):
    e = spark.createDataFrame([("requirement", "1", "document", "d"), ("document", "d", "evidence", "c")], "source_type string, source string, target_type string, target string")
    assert {(r[0], r[1]) for r in outputs.neighbours(e, "document", "d").collect()} == {("requirement", "1"), ("evidence", "c")}
    assert outputs.visible_edges(e, ["requirement", "document"]).count() == 1


PAIRS = [("Supported", [7, 2, 0, 1]), ("Partial", [3, 5, 0, 0]), ("Missing", [0, 1, 6, 0]), ("Conflict", [0, 2, 0, 3])]


def golden_pairs(spark):
    names = [n for n, _ in PAIRS]
    rows = [(f"REQ-{e}-{a}-{k}", e, names[a]) for e, ns in PAIRS for a, n in enumerate(ns) for k in range(n)]
    return spark.createDataFrame(rows, "code string, expected string, actual string")


def test_published_scores(spark):
    p = golden_pairs(spark)
    s = metrics.classification_scores(p).first()
    assert (s["total"], s["accuracy"], s["macro_f1"]) == (30, 70.0, 71.13)
    by = {r["status"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.class_scores(p).collect()}
    assert by == {"Supported": (70.0, 70.0, 70.0), "Partial": (50.0, 62.5, 55.56), "Missing": (100.0, 85.71, 92.31), "Conflict": (75.0, 60.0, 66.67)}
    x = metrics.specialty_scores(p).first()
    assert (x["unsupported_claim_rate"], x["conflict_f1"], x["missing_f1"]) == (0.0, 66.67, 92.31)
    assert sum(r["n"] for r in metrics.confusion(p).collect()) == 30


def test_extraction_scores(spark):
    truth = spark.createDataFrame([(f"REQ-00{k}", f"title number {k}", k) for k in range(1, 5)], "req_code string, title string, ord int")
    got = spark.createDataFrame([("REQ-001", "x y z", 1), ("req_002", "u v w", 2), ("REQ-999", "unrelated", 3)], "req_code string, title string, ord int")
    s = metrics.extraction_scores(truth, got).first()
    assert (s["precision"], s["recall"], s["f1"]) == (66.67, 50.0, 57.14)


def test_retrieval_scores(spark):
    links = spark.createDataFrame([(f"REQ-{k}", "a.pdf", 1, "q") for k in range(3)], "req_code string, document string, page int, quote string")
    got = spark.createDataFrame([("REQ-0", 1, "a.pdf", 1, ""), ("REQ-1", 3, "A.PDF", None, ""), ("REQ-2", 1, "b", 1, ""), ("REQ-2", 2, "a.pdf", 2, "")], "req_code string, rank int, document_name string, page_number int, content string")
    s = metrics.retrieval_scores(links, got).first()
    assert (s["recall_at_1"], s["recall_at_3"], s["mrr"]) == (33.33, 66.67, 0.4444)


def test_failures_and_unsupported(spark):
    p = spark.createDataFrame([("R1", "Missing", "Supported"), ("R2", "Conflict", "Supported"), ("R3", "Supported", "Partial"), ("R4", "Missing", "Missing")], "code string, expected string, actual string")
    links = spark.createDataFrame([("R3", "a.pdf", 1, "q")], "req_code string, document string, page int, quote string")
    got = spark.createDataFrame([("R3", 1, "b.pdf", 1, "")], "req_code string, rank int, document_name string, page_number int, content string")
    assert {r["code"]: r["error_type"] for r in metrics.failures(p, links, got).collect()} == {"R1": "unsupported_claim", "R2": "conflict_detection_error", "R3": "retrieval_error"}
    assert metrics.specialty_scores(p).first()["unsupported_claim_rate"] == 50.0


def test_evidence_hit_by_quote(spark):
    hit = lambda quote, content, doc="z": spark.range(1).select(metrics.evidence_hit(F.lit("a.pdf"), F.lit(1), F.lit(quote), F.lit(doc), F.lit(1), F.lit(content))).first()[0]
    assert hit("supply voltage measured twice", "the SUPPLY voltage") and not hit("supply voltage measured twice", "supply only")
    assert hit("x", "y", doc="")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"document_id": "1", "document_name": "spec.txt", "text": "REQ-TST-001: Supply Voltage Range\nThe unit shall work from 1 V to 2 V."}) + "\n")
    docs = ingest.read_documents(spark, str(tmp_path / "in"))
    q = ingest.write_stream(docs, str(tmp_path / "out"), str(tmp_path / "cp"), ingest.stream_requirements)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r["req_code"] for r in got] == ["REQ-TST-001"]


def test_trace_edges_of_shared_codes(spark):
    """A code of several requirements, a null one and repeated rows give each edge once; pairs of other codes are not shuffled again."""
    reqs = spark.createDataFrame([(1,), (2,), (3,)], "req_id long")
    links = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (2, 11), (9, 11)], "req_id long, chunk_id long")
    chunks = spark.createDataFrame([(10, 5), (11, 5)], "chunk_id long, document_id long")
    found = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (2, "B"), (3, "C"), (1, None), (2, None)], "req_id long, finding_code string")
    edges = outputs.trace_edges(reqs, links, chunks, found)
    want = {("requirement", "1", "document", "5"), ("requirement", "2", "document", "5"), ("document", "5", "evidence", "10"), ("document", "5", "evidence", "11")}
    want |= {("evidence", c, "finding", f) for c in ("10", "11") for f in ("A", "B", None)}
    rows = [tuple(r) for r in edges.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "min(req_id" in plan
