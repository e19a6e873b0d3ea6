"""Frequent texts are read once, with the claims that reading row by row gives."""

import pytest

from proofline.operators import claims

TEXTS = ["Supply 3 V to 5 V, tested at 4 V, 6 V.", "REQ-AA-001: latency was 5 ms, PASSED. REQ-BB-002 failed.", "plain words", "", None, "Immersion check for IP67 was PASS.", "9 kV " + "long " * 300]


@pytest.mark.parametrize("kinds", [claims.KINDS, ("range", "point")])
def test_known_texts_give_the_same_claims(spark, monkeypatch, kinds):
    rows = [(q, code, n, q * 100 + n, "d", 1, TEXTS[n % len(TEXTS)]) for q, code in ((1, "REQ-AA-001"), (2, "REQ-BB-002"), (3, None)) for n in range(21)]
    candidates = spark.createDataFrame(rows, "req_id int, req_code string, rank int, chunk_id long, document_name string, page_number int, content string")
    known = {r["known"] for r in claims.known_claims(candidates.select("content"), kinds).collect()}
    assert known == {TEXTS[0], TEXTS[2], "", TEXTS[5]}
    got = sorted(map(repr, claims.extract_claims(candidates, kinds).collect()))
    monkeypatch.setattr(claims, "KNOWN", 0)
    assert got == sorted(map(repr, claims.extract_claims(candidates, kinds).collect()))
