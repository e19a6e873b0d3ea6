"""Queries of retrieval, claims, checks, contradictions and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import contradiction, coverage_check, decision, retrieval, validators
from ..operators.claims import KINDS, extract_claims
from .views import BENCHMARK_REQUIREMENTS, LINE_CHUNKS, benchmark_requirements, duck, duck_tokens, line_chunks, placed_evidence, shared

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_STOP = ", ".join(f"'{w}'" for w in fixed.RETRIEVAL_STOP_WORDS)
_BOOST = " OR ".join(f"contains(lower(document_name), '{w}')" for w in fixed.BOOSTED_NAMES)
_SCORED = f"""{LINE_CHUNKS}, {BENCHMARK_REQUIREMENTS},
lt AS (SELECT chunk_id, {duck_tokens('content')} AS t FROM line_chunks),
dt AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS token FROM lt),
d AS (SELECT chunk_id, token, count(*) AS tf, any_value(dl) AS dl FROM dt GROUP BY 1, 2),
a AS (SELECT sum(len(t)) / greatest(count(*), 1) AS avg_len FROM lt),
qt AS (SELECT req_id, lower(req_code) AS code, unnest({duck_tokens('text')}) AS token FROM bench_reqs),
q AS (SELECT req_id, code, token, count(*) AS qtf FROM qt GROUP BY 1, 2, 3),
s AS (SELECT req_id, chunk_id, sum(qtf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (dl / greatest(avg_len, 1))))
   + CASE WHEN token = code THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(token, '[0-9]') THEN 2.0::DOUBLE * qtf ELSE 0 END
   + CASE WHEN length(token) > 3 AND token NOT IN ({_STOP}) THEN 1.5::DOUBLE ELSE 0 END) AS raw,
   bool_or(token = code OR (length(token) > 3 AND token NOT IN ({_STOP}))) AS named FROM q JOIN d USING (token), a GROUP BY 1, 2),
scored AS (SELECT req_id, chunk_id, document_name, round(raw + CASE WHEN named AND ({_BOOST}) THEN 1 ELSE 0 END, 9) AS score FROM s JOIN line_chunks USING (chunk_id) WHERE raw >= 0.3)"""


def _reqs(spark, sf_dir):
    return benchmark_requirements(spark, sf_dir).select("project_id", "req_id", "text")


@query(f"""WITH {_SCORED},
b AS (SELECT *, row_number() OVER (PARTITION BY req_id, document_name ORDER BY score DESC, chunk_id) AS dr, count(*) OVER (PARTITION BY req_id) AS pool FROM scored),
o AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY CASE WHEN dr <= 2 OR pool < 5 THEN 0 ELSE 1 END, score DESC, chunk_id) AS rank FROM b)
SELECT req_id, CAST(rank AS INT) AS rank, chunk_id, document_name, round(score, 6) AS score FROM o WHERE rank <= 5""")
def retrieve_evidence(spark, sf_dir):
    """The flagship: top-k evidence of each requirement (O-G2 to O-G8)."""
    top = retrieval.retrieve(_reqs(spark, sf_dir), line_chunks(spark, sf_dir), 5, 0.3)
    return top.select("req_id", "rank", "chunk_id", "document_name", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED} SELECT avg_len FROM a")
def o_g1_average_length(spark, sf_dir):
    return retrieval.average_length(line_chunks(spark, sf_dir)).select("avg_len")


@query(f"WITH {_SCORED} SELECT req_id, count(*) AS pairs, round(max(score), 6) AS best, round(sum(score), 3) AS total FROM scored GROUP BY 1")
def o_g2_g7_score_totals(spark, sf_dir):
    s = retrieval.score_totals(_reqs(spark, sf_dir), line_chunks(spark, sf_dir))
    return s.select("req_id", "pairs", F.round("best", 6).alias("best"), F.round("total", 3).alias("total"))


def _requirements(spark, sf_dir):
    return shared(spark, sf_dir, "part_requirements").select("req_id", "req_code", "title", "description", "kind")


def _candidates(spark, sf_dir):
    """Evidence of each requirement by chunk id; of equal ids, the row that stands first in its table goes first, files by name."""
    e = placed_evidence(spark, sf_dir)
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("req_id").orderBy("chunk_id", "file", "place"))).drop("file", "place")


def _claims(spark, sf_dir, kinds=KINDS):
    reqs = _requirements(spark, sf_dir)
    contents = shared(spark, sf_dir, "part_evidence").select("content")
    return extract_claims(_candidates(spark, sf_dir).join(reqs.select("req_id", "req_code"), "req_id"), kinds, contents)


def _facts(spark, sf_dir, kinds=KINDS):
    return validators.facts(decision.with_contracts(_requirements(spark, sf_dir)), _claims(spark, sf_dir, kinds))


_EV = duck("part_requirements", "part_evidence")
_NUM = "CAST(regexp_extract(content, '([0-9]+) (?:V|uA|ms|kV)', 1) AS DOUBLE)"


@query(f"""WITH {_EV}, e AS (SELECT *, req_id % 8 AS kind, regexp_extract(content, '[0-9]+ (?:V|uA|ms|kV|was)') AS hit FROM part_evidence WHERE req_id IN (SELECT req_id FROM part_requirements)),
h AS (SELECT *, instr(content, hit) - 1 AS st, instr(content, hit) - 1 + length(hit) AS en FROM e WHERE hit <> '' AND kind < 5)
SELECT req_id, chunk_id, CASE WHEN kind = 0 AND page_number % 2 = 0 THEN 'discrete_sweep' WHEN kind = 0 THEN 'numeric_range' ELSE 'threshold' END AS claim_type,
 CASE WHEN kind = 0 THEN NULL ELSE CAST(regexp_extract(hit, '[0-9]+') AS DOUBLE) END AS value_num, CASE WHEN kind = 0 AND page_number % 2 = 1 THEN CAST(regexp_extract(hit, '[0-9]+') AS DOUBLE) END AS min_value,
 CASE WHEN kind = 0 AND page_number % 2 = 0 THEN concat(content, ' ', content) WHEN kind = 0 THEN content ELSE substr(content, CAST(greatest(0, st - 60) AS INT) + 1, CAST(least(length(content), en + 60) - greatest(0, st - 60) AS INT)) END AS quote FROM h""")
def o_f3_f5_numeric_claims(spark, sf_dir):
    c = _claims(spark, sf_dir, ("range", "point")).where("claim_type in ('discrete_sweep', 'numeric_range', 'threshold')")
    return c.select("req_id", "chunk_id", "claim_type", "value_num", "min_value", "quote")


@query(f"""WITH {_EV}, v AS (SELECT req_id, chunk_id, lower(content) AS low FROM part_evidence WHERE req_id IN (SELECT req_id FROM part_requirements))
SELECT req_id, chunk_id, CASE WHEN contains(low, 'in progress') THEN 'IN PROGRESS' WHEN contains(low, 'not tested') THEN 'NOT TESTED' WHEN contains(low, 'failed') THEN 'FAIL' ELSE 'PASS' END AS test_result
FROM v WHERE contains(low, 'in progress') OR contains(low, 'not tested') OR contains(low, 'failed') OR contains(low, 'was pass')""")
def o_f2_verdict_claims(spark, sf_dir):
    return _claims(spark, sf_dir, ("verdict",)).where("claim_type = 'test_verdict'").select("req_id", "chunk_id", "test_result")


@query(f"""WITH {_EV} SELECT req_id, chunk_id, 'IP67' AS value_str, CASE WHEN contains(lower(content), 'pass') THEN 'PASS' ELSE 'UNKNOWN' END AS test_result FROM part_evidence WHERE req_id % 8 = 4 AND req_id IN (SELECT req_id FROM part_requirements)""")
def o_f6_protection_claims(spark, sf_dir):
    return _claims(spark, sf_dir, ("protection",)).where("claim_type = 'boolean'").select("req_id", "chunk_id", "value_str", "test_result")


@query(f"""WITH {_EV} SELECT req_id, chunk_id, content AS quote FROM part_evidence WHERE req_id IN (SELECT req_id FROM part_requirements) AND (req_id % 8 = 5 OR (req_id % 8 = 6 AND NOT contains(content, 'in progress')) OR (req_id % 8 = 7 AND NOT contains(content, 'FAILED')))""")
def o_f7_semantic_claims(spark, sf_dir):
    return _claims(spark, sf_dir).where("claim_type = 'semantic'").select("req_id", "chunk_id", "quote")


_SPEC = "regexp_matches(document_name, 'srs|product_requirements|requirements_specification')"


@query(f"""WITH {_EV}, n AS (SELECT req_id, count(*) AS a, count_if(NOT {_SPEC}) AS b FROM part_evidence GROUP BY 1) SELECT req_id, coalesce(a, 0) AS n_candidates, coalesce(b, 0) AS n_independent FROM part_requirements LEFT JOIN n USING (req_id)""")
def o_h1_h2_gates(spark, sf_dir):
    return decision.gates(_requirements(spark, sf_dir), _candidates(spark, sf_dir))


_DESCRIBED = "TRY_CAST(regexp_extract(description, '([0-9]+)', 1) AS INT)"


@query(f"""WITH {_EV}, c AS (SELECT r.req_id, kind, {_DESCRIBED} AS lo, title, description, chunk_id, page_number, document_name, content, TRY_CAST(regexp_extract(content, '([0-9]+) V to', 1) AS INT) AS a
 FROM (SELECT * FROM part_requirements WHERE kind IN (0, 5)) r JOIN (SELECT * FROM part_evidence WHERE NOT contains(document_name, 'srs') AND (contains(content, ' V to ') OR contains(content, 'no login'))) e USING (req_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY chunk_id) AS n FROM c WHERE (kind = 0 AND contains(document_name, 'datasheet') AND a + 25 < lo + 30 - 0.5) OR kind = 5)
SELECT req_id, 'Product Specification' AS source_a_doc, document_name AS source_b_doc, content AS source_b_quote, CASE kind WHEN 0 THEN concat(a + 25, ' V') ELSE 'no login' END AS highlight FROM k WHERE n = 1""")
def o_h3_contract_contradictions(spark, sf_dir):
    found = contradiction.contract_contradictions(_facts(spark, sf_dir)).select("req_id", "finding.*")
    return found.select("req_id", "source_a_doc", "source_b_doc", "source_b_quote", "highlight")


@query(f"""WITH {_EV}, c AS (SELECT req_id, chunk_id AS ord, document_name, content, lower(content) AS q FROM part_evidence WHERE req_id % 8 = 5 AND req_id IN (SELECT req_id FROM part_requirements)),
t AS (SELECT *, contains(q, 'login') OR contains(q, 'password') AS pos, contains(q, 'no login') AS neg FROM c),
p AS (SELECT a.req_id, a.document_name AS p_doc, b.document_name AS n_doc, a.content AS p_quote, b.content AS n_quote, least(a.ord, b.ord) AS i, greatest(a.ord, b.ord) AS j, a.ord > b.ord AS turned
  FROM t a JOIN t b ON a.req_id = b.req_id AND a.pos AND b.neg AND a.ord <> b.ord AND a.document_name <> b.document_name),
r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY i, j, turned) AS k FROM p)
SELECT req_id, p_doc AS source_a_doc, n_doc AS source_b_doc, p_quote AS source_a_quote, n_quote AS source_b_quote, 'no login' AS highlight FROM r WHERE k = 1""")
def o_h4_pair_contradictions(spark, sf_dir):
    out = contradiction.pair_contradictions(_claims(spark, sf_dir)).select("req_id", "finding.*")
    return out.select("req_id", "source_a_doc", "source_b_doc", "source_a_quote", "source_b_quote", "highlight")


@query(f"""WITH {_EV}, v AS (SELECT req_id, bool_or(contains(lower(content), 'not tested')) AS m, bool_or(contains(lower(content), 'was pass')) AS p, bool_or(contains(lower(content), 'in progress')) AS g, bool_or(contains(lower(content), 'failed')) AS f
 FROM part_evidence WHERE req_id IN (SELECT req_id FROM part_requirements) GROUP BY 1)
SELECT req_id, CASE WHEN m AND NOT p THEN 'MISSING' WHEN g AND NOT p THEN 'PARTIAL' ELSE 'CONFLICT' END AS status, CAST(CASE WHEN m AND NOT p THEN 95 WHEN g AND NOT p THEN 90 ELSE 95 END AS DOUBLE) AS confidence FROM v WHERE (m AND NOT p) OR (g AND NOT p) OR f""")
def o_h5_test_verdicts(spark, sf_dir):
    return validators.test_verdict(_facts(spark, sf_dir, ("verdict",))).select("req_id", "outcome.status", "outcome.confidence")


_LIMIT = "CAST(regexp_extract(description, '([0-9]+)', 1) AS DOUBLE)"


@query(f"""WITH {_EV}, c AS (SELECT r.req_id, {_LIMIT} AS lo, {_LIMIT} + 30 AS hi, page_number AS pg, chunk_id, CAST(regexp_extract(content, '([0-9]+) V', 1) AS DOUBLE) AS a FROM part_requirements r JOIN part_evidence e ON r.req_id = e.req_id WHERE kind = 0),
d AS (SELECT req_id, chunk_id AS pg, CASE WHEN pg % 2 = 0 THEN 0 ELSE 1 END AS phase, CASE WHEN pg % 2 = 0 THEN CASE WHEN a <= lo AND a + 60 >= hi THEN 'SUPPORTED' END
   WHEN a <= lo AND a + 25 >= hi THEN 'SUPPORTED' WHEN (a > lo AND a < hi) OR (a + 25 < hi AND a + 25 > lo) OR (a >= lo AND a + 25 <= hi) THEN 'PARTIAL' WHEN a + 25 < lo OR a > hi THEN 'CONFLICT' END AS status FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY phase, pg) AS n FROM d WHERE status IS NOT NULL) SELECT req_id, status FROM k WHERE n = 1""")
def o_h6_numeric_ranges(spark, sf_dir):
    return validators.numeric_range(_facts(spark, sf_dir, ("range", "point"))).select("req_id", "outcome.status")


@query(f"""WITH {_EV}, c AS (SELECT r.req_id, kind, {_LIMIT} AS lim, chunk_id AS pg, {_NUM} AS v FROM part_requirements r JOIN part_evidence e ON r.req_id = e.req_id WHERE kind IN (1, 2, 3) AND NOT contains(content, 'Fan housing')),
k AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY pg) AS n FROM c) SELECT req_id, CASE WHEN kind < 3 THEN CASE WHEN v <= lim THEN 'SUPPORTED' ELSE 'CONFLICT' END WHEN v >= lim THEN 'SUPPORTED' ELSE 'CONFLICT' END AS status FROM k WHERE n = 1""")
def o_h7_thresholds(spark, sf_dir):
    return validators.threshold(_facts(spark, sf_dir, ("range", "point"))).select("req_id", "outcome.status")


@query(f"""WITH {_EV}, c AS (SELECT r.req_id, {_LIMIT} AS lim, chunk_id AS pg, {_NUM} AS v FROM part_requirements r JOIN part_evidence e ON r.req_id = e.req_id WHERE kind = 2),
k AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY pg) AS n FROM c) SELECT req_id, CASE WHEN v <= lim THEN 'SUPPORTED' ELSE 'CONFLICT' END AS status, CAST(CASE WHEN v <= lim THEN 95 ELSE 92 END AS DOUBLE) AS confidence FROM k WHERE n = 1""")
def o_h8_durations(spark, sf_dir):
    return validators.duration(_facts(spark, sf_dir, ("range", "point"))).select("req_id", "outcome.status", "outcome.confidence")


@query(f"""WITH {_EV}, c AS (SELECT req_id, chunk_id AS pg, lower(content) AS q, document_name FROM part_evidence WHERE req_id % 8 IN (4, 6) AND req_id IN (SELECT req_id FROM part_requirements)),
i AS (SELECT req_id, CASE WHEN contains(q, 'pass') THEN 'SUPPORTED' ELSE 'MISSING' END AS status, row_number() OVER (PARTITION BY req_id ORDER BY pg) AS n FROM c WHERE req_id % 8 = 4),
s AS (SELECT req_id, bool_or(contains(q, 'verified') AND NOT contains(document_name, 'srs')) AS proof FROM c WHERE req_id % 8 = 6 GROUP BY 1)
SELECT req_id, status FROM i WHERE n = 1 UNION ALL SELECT req_id, 'MISSING' FROM s WHERE NOT proof""")
def o_h9_flags(spark, sf_dir):
    return validators.boolean_flag(_facts(spark, sf_dir)).select("req_id", "outcome.status")


@query(f"""WITH {_EV}, c AS (SELECT r.req_id, kind, count_if(e.req_id IS NOT NULL AND NOT contains(document_name, 'srs')) AS n, coalesce(bool_or(NOT contains(document_name, 'srs') AND contains(content, 'no login')), FALSE) AS opened
 FROM part_requirements r LEFT JOIN part_evidence e ON r.req_id = e.req_id GROUP BY 1, 2) SELECT req_id, CASE WHEN n = 0 THEN 'MISSING' WHEN kind = 5 AND opened THEN 'CONFLICT' ELSE 'UNKNOWN' END AS status FROM c""")
def o_h10_semantic(spark, sf_dir):
    return validators.semantic(decision.with_contracts(_requirements(spark, sf_dir)), _claims(spark, sf_dir)).select("req_id", "outcome.status")


@query()
def o_h11_h13_assessments(spark, sf_dir):
    assessed, _ = decision.assess(_requirements(spark, sf_dir), _candidates(spark, sf_dir))
    return assessed.select("req_id", "req_code", "coverage_status", "confidence", "review_state", "analysis", "recommendation", "path")


_STATUS = "CASE {0} WHEN 'SUPPORTED' THEN 'Supported' WHEN 'CONFLICT' THEN 'Conflict' WHEN 'MISSING' THEN 'Missing' ELSE 'Partial' END"


@query(f"""WITH g AS ({ORACLES['o_h1_h2_gates']}), c AS (SELECT req_id FROM ({ORACLES['o_h3_contract_contradictions']}) UNION SELECT req_id FROM ({ORACLES['o_h4_pair_contradictions']})),
v AS (SELECT req_id, status AS verdict FROM ({ORACLES['o_h5_test_verdicts']})),
t AS (SELECT req_id, status FROM ({ORACLES['o_h6_numeric_ranges']}) UNION ALL SELECT req_id, status FROM ({ORACLES['o_h8_durations']}) UNION ALL SELECT req_id, status FROM ({ORACLES['o_h7_thresholds']}) WHERE req_id % 8 <> 2
      UNION ALL SELECT req_id, status FROM ({ORACLES['o_h9_flags']})),
s AS (SELECT req_id, status AS semantic FROM ({ORACLES['o_h10_semantic']})),
j AS (SELECT g.*, c.req_id IS NOT NULL AS denied, verdict, coalesce(t.status, semantic) AS last FROM g LEFT JOIN c USING (req_id) LEFT JOIN v USING (req_id) LEFT JOIN t USING (req_id) LEFT JOIN s USING (req_id)),
p AS (SELECT *, CASE WHEN n_candidates = 0 OR n_independent = 0 THEN 'gate' WHEN denied THEN 'contradiction' WHEN verdict IS NOT NULL THEN 'verdict' ELSE 'check' END AS path FROM j),
d AS (SELECT req_id, path, CASE path WHEN 'gate' THEN 'Missing' WHEN 'contradiction' THEN 'Conflict' WHEN 'verdict' THEN {_STATUS.format('verdict')} ELSE {_STATUS.format('last')} END AS coverage_status FROM p)
SELECT req_id, path, coverage_status, CASE WHEN coverage_status = 'Missing' THEN 'Open' WHEN path = 'check' AND coverage_status = 'Supported' THEN 'Reviewed' ELSE 'Needs review' END AS review_state FROM d""")
def o_h12_h13_statuses(spark, sf_dir):
    """Which rule decides, and the status and review state that follow."""
    assessed, _ = decision.assess(_requirements(spark, sf_dir), _candidates(spark, sf_dir))
    return assessed.select("req_id", "path", "coverage_status", "review_state")


@query()
def o_h14_evidence_links(spark, sf_dir):
    _, links = decision.assess(_requirements(spark, sf_dir), _candidates(spark, sf_dir))
    return links.select("req_id", "chunk_id", "status", "label", "highlight")


@query(f"""WITH {_EV}, c AS (SELECT r.req_id, TRY_{_LIMIT} AS lo, TRY_{_LIMIT} + 30 AS hi, kind = 0 AS ranged, string_agg(content, ' ' ORDER BY chunk_id) AS t FROM part_requirements r JOIN part_evidence e ON r.req_id = e.req_id GROUP BY 1, 2, 3, 4),
x AS (SELECT *, list_transform(regexp_extract_all(t, '([0-9]+) V\\b', 1), lambda y: CAST(y AS DOUBLE)) AS p FROM c)
SELECT req_id, CASE WHEN ranged THEN 'Supported' ELSE 'Unknown' END AS status, TRUE AS is_valid, CASE WHEN ranged THEN list_min(p) <= lo AND list_max(p) >= hi END AS spanned FROM x""")
def o_h15_range_coverage(spark, sf_dir):
    e = _candidates(spark, sf_dir).groupBy("req_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda x: x["content"]).alias("evidence"))
    rows = _requirements(spark, sf_dir).join(e, "req_id").withColumnRenamed("description", "text")
    lo = F.regexp_extract("text", "([0-9]+)", 1).cast("double")
    points = F.transform(F.regexp_extract_all(F.array_join("evidence", " "), F.lit(r"([0-9]+) V\b"), F.lit(1)), lambda x: x.cast("double"))
    return coverage_check.check_ranges(rows).select("req_id", "status", "is_valid", F.when(F.col("kind") == 0, (F.array_min(points) <= lo) & (F.array_max(points) >= lo + 30)).alias("spanned"))
