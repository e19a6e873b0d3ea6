"""Golden cases of claims, checks and decisions."""

import pytest
from pyspark.sql import functions as F

from proofline.operators import contradiction, coverage_check, decision, retrieval, validators
from proofline.operators.claims import CLAIM, extract_claims

REQ = "req_id int, req_code string, title string, description string"
CAND = "req_id int, rank int, chunk_id string, document_name string, doc_type string, page_number int, content string"


def assess(spark, title, description, *evidence, code="REQ-TST-001"):
    reqs = spark.createDataFrame([(1, code, title, description)], REQ)
    cands = spark.createDataFrame([(1, k, f"c{k}", name, "Document", 1, body) for k, (name, body) in enumerate(evidence)], CAND)
    assessed, links = decision.assess(reqs, cands)
    return assessed.first(), links.collect()


def check(spark, f, title, description, *claims, code="REQ-X-1"):
    names = [x.split(":")[0] for x in CLAIM.split(",")]
    schema = "req_id int, claim_ord long, chunk_id string, document_name string, page_number int, " + ", ".join(x.replace(":", " ") for x in CLAIM.split(","))
    rows = [(1, k, f"c{k}", c.get("document_name", "report.pdf"), 1, *[c.get(n) for n in names]) for k, c in enumerate(claims)]
    reqs = decision.with_contracts(spark.createDataFrame([(1, code, title, description)], REQ))
    got = f(validators.facts(reqs, spark.createDataFrame(rows, schema))).first()
    return got and got["outcome"]


def test_range_covered_by_sweep(spark):
    got = check(spark, validators.numeric_range, "High voltage bus", "from 400 V DC to 800 V DC", dict(claim_type="discrete_sweep", discrete_points=[400.0, 600.0, 800.0], unit="V DC", quote="voltage tested"))
    assert (got["status"], got["confidence"]) == ("SUPPORTED", 95.0)
    assert got["reason"] == "Tested points (400 to 800 V DC) fully span required range (400 to 800 V DC)."


def test_range_partial_and_outside(spark):
    part = check(spark, validators.numeric_range, "Ambient temperature", "-40 °C to 85 °C", dict(claim_type="numeric_range", min_value=-20.0, max_value=70.0, unit="°C", quote="ambient temperature"))
    assert (part["status"], part["confidence"], part["highlight"]) == ("PARTIAL", 90.0, "+70°C")
    out = check(spark, validators.numeric_range, "Supply voltage", "18 V DC to 32 V DC", dict(claim_type="numeric_range", min_value=10.0, max_value=15.0, unit="V", quote="supply voltage"))
    assert (out["status"], out["confidence"]) == ("CONFLICT", 92.0)


@pytest.mark.parametrize("value,status", [(112.4, "SUPPORTED"), (195.0, "CONFLICT")])
def test_threshold(spark, value, status):
    got = check(spark, validators.threshold, "Quiescent current", "shall not exceed 150 uA", dict(claim_type="threshold", value_num=value, unit="uA", quote="quiescent current"))
    assert got["status"] == status


def test_duration(spark):
    got = check(spark, validators.duration, "Wakeup latency", "limited to 10 ms", dict(claim_type="threshold", value_num=6.4, unit="ms", quote="wakeup 6.40 ms"))
    assert got["status"] == "SUPPORTED" and got["observed_value"] == "6.4 ms"


def test_first_decides_and_topic_gate(spark):
    off = dict(claim_type="threshold", value_num=1.0, unit="uA", quote="something else")
    on = dict(claim_type="threshold", value_num=200.0, unit="uA", quote="quiescent")
    later = dict(claim_type="threshold", value_num=1.0, unit="uA", quote="quiescent")
    assert check(spark, validators.threshold, "Quiescent current", "shall not exceed 150 uA", off, on, later)["status"] == "CONFLICT"


def test_verdict_roll_up(spark):
    say = lambda r: dict(claim_type="test_verdict", test_result=r, quote="q")
    f = lambda *r: check(spark, validators.test_verdict, "t", "d", *[say(x) for x in r])
    assert f("NOT STARTED")["status"] == "MISSING" and f("IN PROGRESS")["status"] == "PARTIAL" and f("FAIL")["status"] == "CONFLICT"
    assert f("MISSING", "PASS") is None


def test_claims_of_a_report(spark):
    text = "Supply voltage (REQ-TST-001): tested at 18.0 V, 24.0 V and 32.0 V DC. Verdict PASSED. REQ-TST-002: other 5 ms"
    cands = spark.createDataFrame([(1, 0, "c", "r.txt", "Document", 2, text)], CAND).withColumn("req_code", F.lit("REQ-TST-001"))
    got = extract_claims(cands).orderBy("claim_ord").collect()
    assert [(c["claim_type"], c["test_result"]) for c in got[:1]] == [("test_verdict", "PASS")]
    sweep = [c for c in got if c["claim_type"] == "discrete_sweep"][0]
    assert sweep["discrete_points"] == [18.0, 24.0, 32.0] and sweep["unit"] == "V"
    assert not any(c["unit"] == "ms" for c in got)
    other = extract_claims(cands.withColumn("req_code", F.lit("REQ-ZZZ-9")))
    assert other.count() == 0


def test_decisions(spark):
    a, links = assess(spark, "Supply Voltage Range", "The unit shall operate from 18.0 V to 32.0 V DC.", ("04_test_report.txt", "Supply voltage (REQ-TST-001): tested at 18.0 V, 24.0 V and 32.0 V in the lab."))
    assert a["requirement_type"] if "requirement_type" in a else a["contract"]["requirement_type"] == "numeric_range"
    a, _ = assess(spark, "Supply Voltage Range", "from 18.0 V to 32.0 V DC.", ("03_supplier_datasheet.txt", "Supply voltage range 18.0 V to 28.0 V"))
    assert (a["coverage_status"], a["confidence"], a["review_state"], a["path"]) == ("Conflict", 92.0, "Needs review", "contradiction")
    a, links = assess(spark, "Matrix", "record", ("07_matrix", "Requirement ID: REQ-TST-001; Test Status: Not Started; Verdict: MISSING"))
    assert (a["coverage_status"], a["review_state"], links) == ("Missing", "Open", [])
    a, links = assess(spark, "Service access", "Diagnostic port access requires authentication", ("02_manual.txt", "Connect to the diagnostic port; no login required."))
    assert a["coverage_status"] == "Conflict" and links[0]["status"] == "Potential conflict" and links[0]["highlight"] == "no login"
    a, links = assess(spark, "Wording", "general", ("notes.txt", "Qualitative text."))
    assert (a["coverage_status"], a["confidence"]) == ("Partial", 75.0) and links[0]["status"] == "Supporting evidence"
    a, _ = assess(spark, "Wording", "general", ("01_srs.txt", "Qualitative text."))
    assert (a["coverage_status"], a["confidence"], a["path"]) == ("Missing", 95.0, "gate")


def test_no_candidates(spark):
    reqs = spark.createDataFrame([(1, "REQ-1", "t", None)], REQ)
    assessed, links = decision.assess(reqs, spark.createDataFrame([], CAND))
    assert assessed.first()["coverage_status"] == "Missing" and links.count() == 0


def test_pair_contradiction(spark):
    schema = "req_id int, claim_ord long, document_name string, quote string"
    rows = [(1, 0, "a.txt", "The service port asks for a password."), (1, 1, "b.txt", "Service port with open access."), (2, 0, "a.txt", "service port password"), (2, 1, "a.txt", "service port open access")]
    got = contradiction.pair_contradictions(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and got[0]["finding"]["highlight"] == "open access" and got[0]["finding"]["source_b_doc"] == "b.txt"


def test_retrieval_against_a_loop(spark):
    reqs = [(1, 1, "supply voltage of REQ-7 at 18 v and 18 v"), (1, 2, "ambient temperature"), (1, 3, "nothing here matches")]
    chunks = [(1, k, f"d{k % 3}_report" if k % 2 else f"d{k % 3}", t) for k, t in enumerate(["supply voltage REQ-7", "supply 18 v", "voltage supply supply", "ambient humidity", "temperature", "supply again", "supply ambient 18", "unrelated"])]
    got = retrieval.retrieve(spark.createDataFrame(reqs, "project_id int, req_id int, text string"), spark.createDataFrame(chunks, "project_id int, chunk_id int, document_name string, content string"), 3)
    rows = got.orderBy("req_id", "rank").collect()
    assert {r["req_id"] for r in rows} == {1, 2}
    first = [r for r in rows if r["req_id"] == 1]
    assert first[0]["chunk_id"] == 0 and len(first) == 3 and [r["rank"] for r in first] == [1, 2, 3]

    def score(q, c, avg):
        import re

        qt, ct = re.findall(r"\b[a-zA-Z0-9_-]+\b", q.lower()), re.findall(r"\b[a-zA-Z0-9_-]+\b", c[3].lower())
        s = sum(ct.count(t) * 2.5 / (ct.count(t) + 1.5 * (0.25 + 0.75 * len(ct) / max(avg, 1))) for t in qt if t in ct)
        s += 5.0 * ("req-7" in qt and "req-7" in ct) + 2.0 * sum(t in ct for t in qt if any(x.isdigit() for x in t))
        core = [t for t in set(qt) if len(t) > 3 and t in ct]
        return s + 1.5 * len(core) + (1.0 if "report" in c[2] and (core or ("req-7" in qt and "req-7" in ct)) else 0)

    avg = sum(len(c[3].replace("-", "x").split()) for c in chunks) / len(chunks)
    for r in rows:
        q = [x[2] for x in reqs if x[1] == r["req_id"]][0]
        assert abs(score(q, chunks[r["chunk_id"]], avg) - r["score"]) < 1e-6


def test_range_check(spark):
    f = lambda req, *ev: spark.range(1).select(coverage_check.range_coverage(F.lit(req), F.array(*[F.lit(e) for e in ev])).alias("c")).first()["c"]
    assert f("none", "x")["status"] == "Unknown"
    assert f("18 V to 32 V", "tested 18 V", "and 32 V")["status"] == "Supported"
    part = f("-20 °C to 60 °C", "tested from -10 °C to 50 °C")
    assert (part["status"], part["is_valid"], part["highlight"]) == ("Partial", False, "+50°C")
