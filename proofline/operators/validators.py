"""Rule-based checks of claims against contracts.

Every check takes ``facts``: one row for each claim with its requirement's contract
(columns req_id, req_code, title, contract, claim_ord, document_name and the claim's
fields) and gives ``req_id, outcome`` for the requirements it can judge. The first
claim in order that decides wins: ``min_by`` over the claim order, combined before the
shuffle. A check is kept as a ``Check``, so any number of them share one aggregation;
texts are worded once for each requirement, after it.
"""

from __future__ import annotations

from itertools import zip_longest
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.contracts import on_topic, topic_terms
from ..functions.text import contains_any, fill, show_number
from ..functions.units import normalize_unit, unit_table

OUTCOME = "status:string,confidence:double,reason:string,highlight:string,expected_value:string,observed_value:string"


def outcome(status: str, confidence: float, wording: str, highlight: Column | str | None = None, **values: Column) -> Column:
    """An outcome struct in the fixed wording of that name, filled with ``values``."""
    reason, expected, observed = (fill(t, **values) for t in fixed.OUTCOMES[wording])
    tip = highlight if isinstance(highlight, Column) else F.lit(highlight)
    return F.struct(
        F.lit(status).alias("status"), F.lit(confidence).alias("confidence"), reason.alias("reason"), tip.alias("highlight"), F.trim(expected).alias("expected_value"), F.trim(observed).alias("observed_value")
    ).cast(f"struct<{OUTCOME}>")


def facts(contracts: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims with their requirement's contract, topic words, and both units resolved.

    The unit table (fixed size) is broadcast; claim and contract each meet it once, so the
    checks work on plain columns: ``cu, cd, cf`` and ``ru, rd, rf`` are normal form,
    dimension and factor of the claim's and the contract's unit.
    """
    units = F.broadcast(unit_table(contracts.sparkSession))
    side = lambda x: units.select(F.col("unit").alias(f"{x}u"), F.col("dimension").alias(f"{x}d"), F.col("factor").alias(f"{x}f"))
    terms = [topic_terms(F.col("req_code"), F.col("title"), name).alias(f"terms_{name}") for name in fixed.TOPIC_STOP_WORDS]
    reqs = contracts.select("req_id", "req_code", "title", "contract", normalize_unit(F.col("contract")["unit"]).alias("ru"), *terms).join(side("r"), "ru", "left")
    return claims.withColumn("cu", normalize_unit(F.col("unit"))).join(side("c"), "cu", "left").join(reqs, "req_id")


COMPATIBLE = "cu <> '' and ru <> '' and (cu = ru or cd = rd)"


def in_contract_unit(value: Column) -> Column:
    """A claim's value in the contract's unit; null if that is not possible."""
    return F.when(F.col("cu") == F.col("ru"), value).when(F.col("cd") == F.col("rd"), value * F.col("cf") / F.col("rf"))


class Check(NamedTuple):
    """A check in four steps: columns of each claim (in layers), aggregates of a requirement, texts made of them, its outcome."""

    layers: list[dict[str, Column]]
    gathered: list[Column]
    outcome: Column
    texts: dict[str, Column] = {}


def marked(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """``rows`` with the columns that the checks need of each claim."""
    for layer in zip_longest(*[c.layers for c in checks], fillvalue={}):
        rows = rows.withColumns({name: column for part in layer for name, column in part.items()})
    return rows


def judged(rows: DataFrame, check: Check) -> DataFrame:
    """``req_id, outcome`` of one check alone."""
    found = marked(rows, [check]).groupBy("req_id").agg(*check.gathered).withColumns(check.texts)
    return found.select("req_id", check.outcome.alias("outcome")).where("outcome is not null")


def earliest(name: str, hit: Column, order: Column | None = None) -> Column:
    """The first ``hit`` in claim order that is not null."""
    return F.min_by(hit, F.when(hit.isNotNull(), F.col("claim_ord") if order is None else order)).alias(name)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _worded(word: Column, **outcomes: Column) -> Column:
    """The outcome that the decisive claim's ``word`` names, else null."""
    return F.coalesce(*[F.when(word == name, made) for name, made in outcomes.items()])


def verdict_check() -> Check:
    said = F.col("_said")
    any_of = lambda name, *words: F.bool_or(said.isin(*words)).alias(f"verdict_{name}")
    missing, passed, partial, failed = (F.col(f"verdict_{x}") for x in ("missing", "passed", "partial", "failed"))
    result = (
        F.when(missing & ~passed, outcome("MISSING", 95.0, "verdict_missing"))
        .when(partial & ~passed, outcome("PARTIAL", 90.0, "verdict_partial"))
        .when(failed, outcome("CONFLICT", 95.0, "verdict_failed", "FAIL"))
    )
    gathered = [any_of("missing", "NOT TESTED", "NOT STARTED", "MISSING"), any_of("passed", "PASS"), any_of("partial", "IN PROGRESS", "PARTIAL"), any_of("failed", "FAIL")]
    return Check([{"_said": F.when(F.col("claim_type") == "test_verdict", F.col("test_result"))}], gathered, result)


def test_verdict(rows: DataFrame) -> DataFrame:
    """Roll-up of verdicts: missing, then in progress (both unless something passed), then failed."""
    return judged(rows, verdict_check())


def range_check(only: Column | None = None) -> Check:
    """``only``: which claims take part (all, if None)."""
    c, able = F.col("contract"), F.col("_range_able")
    fit = c["min_value"].isNotNull() & c["max_value"].isNotNull() & F.col("claim_type").isin("discrete_sweep", "numeric_range") & F.expr(COMPATIBLE)
    fit = (F.lit(True) if only is None else only) & fit & on_topic(F.col("terms_numeric_range"), F.col("quote"))
    points = F.filter(F.transform("discrete_points", in_contract_unit), lambda p: p.isNotNull())
    a, b, lo, hi, sweep = F.col("_range_a"), F.col("_range_b"), c["min_value"], c["max_value"], F.col("claim_type") == "discrete_sweep"
    covers = (a <= lo) & (b >= hi)
    partial = ((a > lo) & (a < hi)) | ((b < hi) & (b > lo)) | ((a >= lo) & (b <= hi))
    word = F.when(sweep, F.when(covers, "range_points")).when(covers, "range_covered").when(partial, "range_partial").when((b < lo) | (a > hi), "range_outside")
    layers = [
        {"_range_able": F.coalesce(fit, F.lit(False))},
        {"_range_points": F.when(able, points)},
        {"_range_a": F.when(able, F.coalesce(F.array_min("_range_points"), in_contract_unit(F.col("min_value")))), "_range_b": F.when(able, F.coalesce(F.array_max("_range_points"), in_contract_unit(F.col("max_value"))))},
        {"_range_word": F.when(able, word)},
    ]
    hit = F.struct(
        F.col("_range_word").alias("word"), lo.alias("lo"), hi.alias("hi"), F.coalesce(c["unit"], F.lit("")).alias("u"), a.alias("a"), b.alias("b"), F.col("_range_points").alias("points")
    )
    order = F.struct((~sweep).alias("phase"), "claim_ord")
    r, g = F.col("range_hit"), show_number
    u, top = r["u"], g(r["b"])
    tip = F.trim(_text(top, " ", u))
    warm = F.when(F.contains(F.lower(u), F.lit("c")), _text("+", top, "°C")).otherwise(tip)
    texts = {
        "range_need": _text(g(r["lo"]), " to ", g(r["hi"]), " ", u), "range_got": _text(g(r["a"]), " to ", top, " ", u), "range_tip": tip, "range_warm": warm,
        "range_points": F.array_join(F.transform(r["points"], g), ", "),
    }
    values = {"need": F.col("range_need"), "got": F.col("range_got")}
    result = _worded(
        r["word"], range_points=outcome("SUPPORTED", 95.0, "range_points", points=F.col("range_points"), **values), range_covered=outcome("SUPPORTED", 95.0, "range_covered", **values),
        range_partial=outcome("PARTIAL", 90.0, "range_partial", F.col("range_warm"), **values), range_outside=outcome("CONFLICT", 92.0, "range_outside", F.col("range_tip"), **values),
    )
    return Check(layers, [earliest("range_hit", F.when(F.col("_range_word").isNotNull(), hit), order)], result, texts)


def numeric_range(rows: DataFrame) -> DataFrame:
    """Ranges: a sweep that spans the bounds, else the first comparable range decides."""
    return judged(rows, range_check())


def _measured(topic: str, fit: Column, limit: Column, raw: Column, unit: Column, word: Column, outcomes: dict[str, tuple]) -> Check:
    """The first claim that gives a value comparable with ``limit``; ``word`` is made of ``_{topic}_v`` and ``_{topic}_limit``."""
    able = limit.isNotNull() & raw.isNotNull() & F.col("claim_type").isin("threshold", "numeric_range") & F.expr(COMPATIBLE)
    able = fit & able & on_topic(F.col(f"terms_{topic}"), F.col("quote"))
    v = F.col(f"_{topic}_v")
    layers = [{f"_{topic}_v": F.when(able, in_contract_unit(raw)), f"_{topic}_limit": limit}, {f"_{topic}_word": F.when(v.isNotNull(), word)}]
    hit = F.struct(F.col(f"_{topic}_word").alias("word"), F.col(f"_{topic}_limit").alias("limit"), unit.alias("u"), v.alias("v"))
    r = F.col(f"{topic}_hit")
    texts = {f"{topic}_bound": _text(show_number(r["limit"]), " ", r["u"]), f"{topic}_got": _text(show_number(r["v"]), " ", r["u"])}
    values = {"bound": F.col(f"{topic}_bound"), "got": F.col(f"{topic}_got")}
    tips = {"got": values["got"], "trimmed": F.trim(values["got"]), None: None}
    made = {name: outcome(status, confidence, name, tips[tip], **values) for name, (status, confidence, tip) in outcomes.items()}
    return Check(layers, [earliest(f"{topic}_hit", F.when(F.col(f"_{topic}_word").isNotNull(), hit))], _worded(r["word"], **made), texts)


def threshold_check(only: Column | None = None) -> Check:
    """``only``: which claims take part (all, if None)."""
    c = F.col("contract")
    upper, v, limit = c["operator"].isin("<=", "<"), F.col("_threshold_v"), F.col("_threshold_limit")
    raw = F.coalesce("value_num", F.when(upper, F.col("max_value")).otherwise(F.col("min_value")))
    word = F.when(upper & (v <= limit), "limit_kept").when(upper, "limit_exceeded").when(v >= limit, "minimum_kept").otherwise("minimum_missed")
    fit = (F.lit(True) if only is None else only) & c["operator"].isin("<=", "<", ">=", ">")
    outcomes = {"limit_kept": ("SUPPORTED", 95.0, None), "limit_exceeded": ("CONFLICT", 90.0, "trimmed"), "minimum_kept": ("SUPPORTED", 95.0, None), "minimum_missed": ("CONFLICT", 90.0, "trimmed")}
    return _measured("threshold", fit, F.when(upper, c["max_value"]).otherwise(c["min_value"]), raw, F.coalesce(c["unit"], F.lit("")), word, outcomes)


def threshold(rows: DataFrame) -> DataFrame:
    """Upper and lower limits: the first comparable value decides."""
    return judged(rows, threshold_check())


def duration_check(only: Column | None = None) -> Check:
    """``only``: which claims take part (all, if None)."""
    c = F.col("contract")
    timed = (c["requirement_type"] == "duration") | c["unit"].isin("ms", "us", "µs", "s", "sec", "hours", "h", "min")
    fit = (F.lit(True) if only is None else only) & timed & (c["operator"].isNull() | c["operator"].isin("<=", "<"))
    word = F.when(F.col("_duration_v") <= F.col("_duration_limit"), "deadline_kept").otherwise("deadline_missed")
    outcomes = {"deadline_kept": ("SUPPORTED", 95.0, None), "deadline_missed": ("CONFLICT", 92.0, "got")}
    return _measured("duration", fit, F.coalesce(c["max_value"], c["min_value"]), F.coalesce("value_num", "max_value"), F.coalesce(c["unit"], F.lit("ms")), word, outcomes)


def duration(rows: DataFrame) -> DataFrame:
    """Deadlines: as upper limits, for contracts of a duration or in a unit of time."""
    return judged(rows, duration_check())


def flag_check(only: Column | None = None) -> Check:
    """``only``: which claims take part (all, if None)."""
    c = F.col("contract")
    take = F.lit(True) if only is None else only
    need, q = F.lower(c["raw_text"]), F.lower("quote")
    has = lambda text, word: F.contains(text, F.lit(word))
    asks_ip = F.coalesce((c["parameter"] == "ingress_protection") | (c["unit"] == "IP"), F.lit(False)) | has(need, "ip6")
    on_ip = take & asks_ip & contains_any(q, ["ip67", "ip65", "immersion"])
    ip = F.when(on_ip & contains_any(q, ["pass", "zero water", "completed"]), "ip_passed").when(on_ip & contains_any(q, ["not tested", "missing"]), "ip_untested")
    bus = F.when(take & has(need, "can-fd") & has(need, "5.0 mbps") & has(q, "5.0 mbps") & has(q, "zero frame errors"), "bus_rate")
    secure = F.when(take, contains_any(need, ["secure boot", "root-of-trust", "ecdsa"]))
    proof = F.when(take, ~contains_any(F.lower("document_name"), fixed.SPEC_NAMES) & contains_any(q, ["ecdsa", "root-of-trust", "secure boot"]) & contains_any(q, ["pass", "verified"]))
    hit = F.when(F.col("_flag_ip").isNotNull(), F.struct(F.col("_flag_ip").alias("word"), F.upper(F.coalesce(c["expected_value"], F.lit("IP67"))).alias("target")))
    target = F.col("flag_ip")["target"]
    result = F.coalesce(
        _worded(F.col("flag_ip")["word"], ip_passed=outcome("SUPPORTED", 95.0, "ip_passed", target=target), ip_untested=outcome("MISSING", 95.0, "ip_untested", target=target)),
        F.when(F.col("flag_bus").isNotNull(), outcome("SUPPORTED", 95.0, "bus_rate")), F.when(F.col("flag_secure") & ~F.col("flag_proof"), outcome("MISSING", 95.0, "secure_boot")),
    )
    gathered = [earliest("flag_ip", hit), earliest("flag_bus", F.col("_flag_bus")), F.bool_or("_flag_secure").alias("flag_secure"), F.bool_or("_flag_proof").alias("flag_proof")]
    return Check([{"_flag_ip": ip, "_flag_bus": bus, "_flag_secure": secure, "_flag_proof": proof}], gathered, result)


def boolean_flag(rows: DataFrame) -> DataFrame:
    """Protection codes, the bus data rate, and secure boot; the first rule that decides wins."""
    return judged(rows, flag_check())


def semantic_check() -> Check:
    q, need = F.lower("quote"), F.lower(F.col("contract")["raw_text"])
    said = ~contains_any(F.lower("document_name"), fixed.SPEC_NAMES) & F.col("quote").isNotNull()
    both = lambda asked, found: contains_any(need, asked) & contains_any(q, found)
    hits = {
        "access": both(["credential", "authentication", "login", "password", "seed-key"], ["no login", "no authentication", "unauthenticated", "open access", "no password"]),
        "ground": both(["galvanic isolation", "isolated"], ["non-isolated", "common ground", "shared ground"]),
        "burst": both(["simulation", "burst", "venting", "calculation"], ["simulation"]) & contains_any(q, ["pending"]),
        "acoustic": both(["acoustic", "leakage"], ["calibration requires", "installation test"]),
    }
    seen = F.struct(F.col("document_name").alias("name"), F.substring("quote", 1, 150).alias("head"))
    of = lambda key: {x: F.col(f"semantic_{key}")[x] for x in ("name", "head")}
    results = {
        "access": outcome("CONFLICT", 95.0, "open_access", "open access with no login required", **of("access")), "ground": outcome("CONFLICT", 95.0, "shared_ground", "non-isolated shared ground", **of("ground")),
        "burst": outcome("PARTIAL", 90.0, "burst_pending"), "acoustic": outcome("PARTIAL", 88.0, "acoustic"),
    }
    n = F.coalesce("semantic_n", F.lit(0))
    result = F.when(n == 0, outcome("MISSING", 92.0, "no_independent")).otherwise(
        F.coalesce(*[F.when(F.col(f"semantic_{key}").isNotNull(), made) for key, made in results.items()], outcome("UNKNOWN", 75.0, "unproven"))
    )
    layers = [{"_semantic_said": said}, {f"_semantic_{key}": F.col("_semantic_said") & hit for key, hit in hits.items()}]
    gathered = [F.count_if("_semantic_said").alias("semantic_n"), *[earliest(f"semantic_{key}", F.when(F.col(f"_semantic_{key}"), seen)) for key in hits]]
    return Check(layers, gathered, result)


def semantic(contracts: DataFrame, claims: DataFrame) -> DataFrame:
    """Qualitative requirements; every requirement gets an outcome, UNKNOWN at least."""
    rows = contracts.select("req_id", "contract").join(claims.select("req_id", "claim_ord", "document_name", "quote"), "req_id", "left")
    return judged(rows, semantic_check())
