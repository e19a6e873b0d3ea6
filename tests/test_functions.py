import pytest
from pyspark.sql import functions as F

from proofline.functions import contracts, text, units


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value,a,b,want",
    [(2500.0, "v", "kv", 2.5), (150.0, "ua", "ma", 0.15), (1000.0, "ms", "s", 1.0), (5000.0, "us", "ms", 5.0), (100.0, "v", "a", None), (50.0, "c", "s", None), (1.0, "V", "", None), (3.0, "µs", "us", 3.0), (20.0, "°C", "c", 20.0)],
)
def test_convert(spark, value, a, b, want):
    got = one(spark, units.convert(F.lit(value), F.lit(a), F.lit(b)))
    assert got == want if want is None else abs(got - want) < 1e-12


@pytest.mark.parametrize("a,b,want", [("v", "a", False), ("v", "kv", True), ("ua", "a", True), ("parsec", "parsec", True), ("", "v", False), (None, "v", False), ("(V)", "v.", True)])
def test_compatible(spark, a, b, want):
    assert one(spark, units.compatible(F.lit(a).cast("string"), F.lit(b))) is want


@pytest.mark.parametrize("raw,want", [("REQ_BCU_001", "REQ-BCU-001"), ("req-bcu-001", "REQ-BCU-001"), ("  REQ BCU 002  ", "REQ-BCU-002"), (None, "")])
def test_normalize_code(spark, raw, want):
    assert one(spark, text.normalize_code(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("Verified", "Supported"), ("PASS", "Supported"), ("contradiction", "Conflict"), (None, "Missing"), ("odd", "Missing"), (" partial ", "Partial")])
def test_normalize_status(spark, raw, want):
    assert one(spark, text.normalize_status(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("x,want", [(800.0, "800"), (0.15, "0.15"), (6.4, "6.4"), (0.0, "0"), (1e-3, "0.001"), (112.4, "112.4"), (-40.0, "-40")])
def test_show_number(spark, x, want):
    assert one(spark, text.show_number(F.lit(x))) == want


@pytest.mark.parametrize(
    "title,description,kind,op,least,most,unit",
    [
        ("Supply", "operates from 400.0 V DC to 800.0 V DC", "numeric_range", "between", 400.0, 800.0, "V DC"),
        ("Ambient", "from -40 °C to +85 °C", "numeric_range", "between", -40.0, 85.0, "°C"),
        ("Quiescent current", "shall not exceed 150 uA", "threshold", "<=", None, 150.0, "uA"),
        ("Latency", "limited to 10 ms", "duration", "<=", None, 10.0, "ms"),
        ("Isolation", "at least 2.5 kV", "threshold", ">=", 2.5, None, "kV"),
        ("Sealing", "enclosure rated IP67", "enumeration", "==", None, None, "IP"),
        ("Boot", "uses secure boot", "boolean", "==", None, None, None),
        ("Manual", None, "semantic", None, None, None, None),
    ],
)
def test_contract(spark, title, description, kind, op, least, most, unit):
    c = one(spark, contracts.parse_contract(F.lit(title), F.lit(description).cast("string")))
    assert (c["requirement_type"], c["operator"], c["min_value"], c["max_value"], c["unit"]) == (kind, op, least, most, unit)


def test_categories(spark):
    assert one(spark, text.infer_category(F.lit("Power support"))) == "Electrical"
    assert one(spark, text.infer_category(F.lit("the support page"))) == "Cybersecurity"
    assert one(spark, text.infer_category(F.lit("nothing"))) == "Documentation"


def test_parameters(spark):
    got = one(spark, text.extract_parameters(F.lit("18–32 V and ip54")))
    assert [(p["name"], p["min_val"], p["max_val"], p["unit"]) for p in got] == [("operating_range", 18.0, 32.0, "V"), ("ingress_protection", None, None, "IP")]


def test_extract_requirements(spark):
    body = "short\nREQ_TST_001: Supply Voltage Range\nThe unit shall operate from 18.0 V to 32.0 V DC at any load.\nThe second unit must also be able to withstand the vibration profile of the standard for a long while.\nplain line without anything\n"
    got = one(spark, text.extract_requirements(F.lit(body)))
    assert [r["req_code"] for r in got] == ["REQ-TST-001", "REQ-001"]
    assert got[0]["title"] == "Supply Voltage Range"
    assert got[0]["description"] == "Supply Voltage Range. The unit shall operate from 18.0 V to 32.0 V DC at any load."
    assert got[0]["parameters"][0]["max_val"] == 32.0 and got[1]["category"] == "Environmental"


def test_response_and_fallback(spark):
    fenced = '```json\n{"requirements": [{"req_code": "REQ-1", "title": "t"}]}\n```'
    assert one(spark, text.parse_response(F.lit(fenced)))["requirements"][0]["req_code"] == "REQ-1"
    assert one(spark, text.parse_response(F.lit("not json"))) is None


def test_tokens_and_codes(spark):
    assert one(spark, text.tokenize(F.lit("REQ-1: Café a_b 5V"))) == ["req-1", "a_b", "5v"]
    assert one(spark, text.requirement_codes(F.lit("see req_a1, REQ-B-2."))) == ["req_a1", "REQ-B-2"]
