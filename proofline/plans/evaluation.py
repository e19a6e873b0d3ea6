"""Queries of the evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, retrieval
from .audit import _SCORED
from .views import benchmark_requirements, duck, line_chunks, shared, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# truth: coded parts; extracted: two thirds of their codes, another third by title only, and strangers
_EXTRACTION = f"""{duck('part_requirements')},
truth AS (SELECT req_code, concat(title, ' ', req_id) AS title FROM part_requirements),
got AS (SELECT CASE req_id % 3 WHEN 0 THEN replace(lower(req_code), '-', '_') WHEN 1 THEN req_code ELSE concat('X-', req_id) END AS req_code, CASE req_id % 9 WHEN 2 THEN upper(concat(title, ' ', req_id)) ELSE concat('other ', req_id, '!') END AS title FROM part_requirements)"""


@query(f"""WITH {_EXTRACTION}, t AS (SELECT req_code AS code, lower(title) AS title FROM truth), g AS (SELECT regexp_replace(upper(trim(req_code)), '[_\\s]+', '-', 'g') AS code, lower(title) AS title FROM got),
m AS (SELECT t.code, EXISTS (SELECT 1 FROM g WHERE g.code = t.code) OR EXISTS (SELECT 1 FROM g WHERE contains(g.title, t.title) OR contains(t.title, g.title)) AS hit FROM t),
c AS (SELECT count(*) AS tt, count_if(hit) AS tp, (SELECT count(DISTINCT code) FROM g) AS te FROM m),
s AS (SELECT *, tt - tp AS fn, greatest(0, te - tp) AS fp, tp / (tp + greatest(0, te - tp)) AS p, tp / tt AS r FROM c)
SELECT tt AS total_truth, te AS total_extracted, tp, fp, fn, round_even(100 * p, 2) AS precision, round_even(100 * r, 2) AS recall, round_even(100 * 2 * p * r / (p + r), 2) AS f1 FROM s""")
def o_j1_extraction_scores(spark, sf_dir):
    r = shared(spark, sf_dir, "part_requirements")
    name = F.concat("title", F.lit(" "), F.col("req_id").cast("string"))
    truth = r.select("req_code", name.alias("title"), F.col("req_id").alias("ord"))
    k = F.col("req_id")
    code = F.when(k % 3 == 0, F.replace(F.lower("req_code"), F.lit("-"), F.lit("_"))).when(k % 3 == 1, F.col("req_code")).otherwise(F.concat(F.lit("X-"), k.cast("string")))
    got = r.select(code.alias("req_code"), F.when(k % 9 == 2, F.upper(name)).otherwise(F.concat(F.lit("other "), k.cast("string"), F.lit("!"))).alias("title"), k.alias("ord"))
    return metrics.extraction_scores(truth, got)


_TOP = f"""{_SCORED},
b AS (SELECT *, row_number() OVER (PARTITION BY req_id, document_name ORDER BY score DESC, chunk_id) AS dr, count(*) OVER (PARTITION BY req_id) AS pool FROM scored),
top AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY CASE WHEN dr <= 2 OR pool < 5 THEN 0 ELSE 1 END, score DESC, chunk_id) AS rank FROM b),
got AS (SELECT req_id, rank, document_name, lower(content) AS content FROM top JOIN line_chunks USING (chunk_id, document_name) WHERE rank <= 5),
want AS (SELECT req_id, lower(text) AS quote, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+'), lambda w: length(w) > 4) AS words FROM bench_reqs),
hits AS (SELECT w.req_id, min(rank) AS first_hit FROM want w LEFT JOIN got g ON w.req_id = g.req_id AND length(quote) > 15 AND len(words) > 0 AND len(list_filter(words, lambda x: contains(content, x))) >= 0.5 * len(words) GROUP BY 1)"""


def _retrieval(spark, sf_dir):
    b = benchmark_requirements(spark, sf_dir)
    links = b.select("req_code", F.lit("nowhere").alias("document"), F.lit(None).cast("int").alias("page"), F.col("text").alias("quote"))
    chunks = line_chunks(spark, sf_dir)
    top = retrieval.retrieve(b.select("project_id", "req_id", "text"), chunks, 5, 0.3)
    got = top.join(b.select("req_id", "req_code"), "req_id").join(chunks.select("chunk_id", "content"), "chunk_id").withColumn("page_number", F.lit(None).cast("int"))
    return links, got


@query(f"WITH {_TOP} SELECT concat('REQ-BEN-', lpad(CAST(req_id AS VARCHAR), 5, '0')) AS code, CAST(first_hit AS INT) AS first_hit FROM hits")
def o_j2_first_hits(spark, sf_dir):
    return metrics.first_hits(*_retrieval(spark, sf_dir))


@query(f"""WITH {_TOP} SELECT count(*) AS total_queries, round_even(100.0 * count_if(first_hit <= 1) / count(*), 2) AS recall_at_1, round_even(100.0 * count_if(first_hit <= 3) / count(*), 2) AS recall_at_3,
 round_even(100.0 * count_if(first_hit <= 5) / count(*), 2) AS recall_at_5, round_even(sum(coalesce(1.0 / first_hit, 0)) / count(*), 4) AS mrr FROM hits""")
def o_j3_retrieval_scores(spark, sf_dir):
    return metrics.retrieval_scores(*_retrieval(spark, sf_dir))


_PAIRS = """st(k, name) AS (VALUES (0, 'Supported'), (1, 'Partial'), (2, 'Missing'), (3, 'Conflict')),
pairs AS (SELECT concat('REQ-', doc_id) AS code, e.name AS expected, a.name AS actual FROM labels JOIN st e ON e.k = (quality * 2 + doc_id) % 4 JOIN st a ON a.k = CASE WHEN toxic = 1 THEN doc_id % 3 ELSE (quality * 2 + doc_id) % 4 END)"""


def _labels(spark, sf_dir):
    """Truth and predictions from labels; a third of the true spellings are aliases."""
    names = F.array(*[F.lit(s) for s in ("verified", "partial evidence", "Missing", "Contradiction")])
    code = F.concat(F.lit("REQ-"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "labels").withColumn("code", code)
    right = ((F.col("quality") * 2 + F.col("doc_id")) % 4).cast("int")
    truth = d.select(F.col("code").alias("req_code"), F.element_at(names, right + 1).alias("expected_status"))
    said = F.when(F.col("toxic") == 1, (F.col("doc_id") % 3).cast("int")).otherwise(right)
    return truth, d.select(F.lower("code").alias("req_code"), F.element_at(names, said + 1).alias("status"))


def _pairs(spark, sf_dir):
    return metrics.expected_actual(*_labels(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT e.name AS expected, a.name AS actual, count(p.code) AS n FROM st e CROSS JOIN st a LEFT JOIN pairs p ON p.expected = e.name AND p.actual = a.name GROUP BY 1, 2")
def o_j4_confusion(spark, sf_dir):
    return metrics.confusion(_pairs(spark, sf_dir))


_CLASSES = f"""{_PAIRS}, c AS (SELECT name AS status, (SELECT count(*) FROM pairs WHERE expected = name AND actual = name) AS tp, (SELECT count(*) FROM pairs WHERE expected = name) AS support, (SELECT count(*) FROM pairs WHERE actual = name) AS said FROM st),
k AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM k)"""


@query(f"WITH {_CLASSES} SELECT status, support, round_even(100 * p, 2) AS precision, round_even(100 * r, 2) AS recall, round_even(100 * f, 2) AS f1 FROM f")
def o_j5_class_scores(spark, sf_dir):
    return metrics.class_scores(_pairs(spark, sf_dir)).select("status", "support", "precision", "recall", "f1")


@query(f"""WITH {_CLASSES} SELECT CAST(sum(support) AS BIGINT) AS total, round_even(100 * sum(tp) / sum(support), 2) AS accuracy, round_even(100 * avg(p), 2) AS macro_precision, round_even(100 * avg(r), 2) AS macro_recall, round_even(100 * avg(f), 2) AS macro_f1,
 round_even(100 * sum(p * support) / sum(support), 2) AS weighted_precision, round_even(100 * sum(r * support) / sum(support), 2) AS weighted_recall, round_even(100 * sum(f * support) / sum(support), 2) AS weighted_f1 FROM f""")
def o_j5_classification_scores(spark, sf_dir):
    return metrics.classification_scores(_pairs(spark, sf_dir))


@query(f"""WITH {_PAIRS}, s AS (SELECT count_if(expected = 'Conflict' AND actual = 'Conflict') AS ct, count_if(expected <> 'Conflict' AND actual = 'Conflict') AS cp, count_if(expected = 'Conflict' AND actual <> 'Conflict') AS cn,
 count_if(expected = 'Missing' AND actual = 'Missing') AS mt, count_if(expected <> 'Missing' AND actual = 'Missing') AS mp, count_if(expected = 'Missing' AND actual NOT IN ('Missing', 'Supported')) AS mn,
 count_if(expected = 'Missing') AS total_missing, count_if(expected = 'Missing' AND actual = 'Supported') AS unsupported FROM pairs),
r AS (SELECT *, coalesce(ct / nullif(ct + cp, 0), 0) AS p1, coalesce(ct / nullif(ct + cn, 0), 0) AS r1, coalesce(mt / nullif(mt + mp, 0), 0) AS p2, coalesce(mt / nullif(mt + mn, 0), 0) AS r2 FROM s)
SELECT round_even(100 * p1, 2) AS conflict_precision, round_even(100 * r1, 2) AS conflict_recall, round_even(100 * coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0), 2) AS conflict_f1,
 round_even(100 * p2, 2) AS missing_precision, round_even(100 * r2, 2) AS missing_recall, round_even(100 * coalesce(2 * p2 * r2 / nullif(p2 + r2, 0), 0), 2) AS missing_f1,
 round_even(coalesce(100 * unsupported / nullif(total_missing, 0), 0), 2) AS unsupported_claim_rate, total_missing, unsupported FROM r""")
def o_j6_specialty_scores(spark, sf_dir):
    return metrics.specialty_scores(_pairs(spark, sf_dir))


def _sources(spark, sf_dir):
    """Expected and retrieved sources of the ids that pages have too; a fifth find the wrong one."""
    d = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("REQ-"), F.col("page_id").cast("string")).alias("req_code"))
    links = d.select("req_code", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("x")).alias("document"), F.lit(1).alias("page"), F.lit("short").alias("quote"))
    name = F.when(F.col("doc_id") % 5 == 1, "elsewhere").otherwise(F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit("X.pdf")))
    got = d.select("req_code", F.lit(2).alias("rank"), name.alias("document_name"), F.lit(1).alias("page_number"), F.lit("text").alias("content"))
    return links, got


@query(f"""WITH {_PAIRS} SELECT code, expected, actual, CASE WHEN expected = 'Missing' AND actual = 'Supported' THEN 'unsupported_claim' WHEN expected = 'Conflict' THEN 'conflict_detection_error'
 WHEN CAST(code[5:] AS BIGINT) % 5 = 1 AND CAST(code[5:] AS BIGINT) IN (SELECT page_id FROM pages) THEN 'retrieval_error' ELSE 'verification_error' END AS error_type FROM pairs WHERE expected <> actual""")
def o_j7_failures(spark, sf_dir):
    return metrics.failures(_pairs(spark, sf_dir), *_sources(spark, sf_dir))


@query(f"""WITH {_PAIRS}, n AS (SELECT pairs.*, CAST(code[5:] AS BIGINT) % 5 AS m, page_id IS NOT NULL AS linked FROM pairs LEFT JOIN pages ON CAST(code[5:] AS BIGINT) = page_id)
SELECT code, expected, actual, expected = actual AS correct, CAST(linked AS BIGINT) AS n_expected, CAST(linked AS BIGINT) AS n_retrieved, CASE WHEN linked AND m <> 1 THEN 2 END AS first_hit FROM n""")
def o_j8_result_table(spark, sf_dir):
    return metrics.result_table(_pairs(spark, sf_dir), *_sources(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT count(*) AS total, count_if(expected = 'Supported') AS supported, count_if(expected = 'Partial') AS partial, count_if(expected = 'Missing') AS missing, count_if(expected = 'Conflict') AS conflict FROM pairs")
def o_j8_dataset_counts(spark, sf_dir):
    return metrics.dataset_counts(_pairs(spark, sf_dir))


def _truth(spark, sf_dir):
    r = shared(spark, sf_dir, "requirements")
    one = lambda k: F.struct(F.concat(F.lit("doc"), (F.col("req_id") % 7 + k).cast("string")).alias("document"), F.lit(k).alias("page"), F.lit("supports").alias("relationship"), F.col("title").alias("quote"))
    return r.select("req_code", "project_id", F.col("coverage_status").alias("expected_status"), F.when(F.col("req_id") % 2 == 0, F.array(one(1), one(2))).otherwise(F.array(one(3))).alias("sources"))


@query(f"""WITH {duck('requirements')} SELECT req_code, concat('doc', req_id % 7 + k) AS document, k AS page, 'supports' AS relationship, title AS quote FROM requirements JOIN (VALUES (1), (2), (3)) v(k) ON (req_id % 2 = 0 AND k < 3) OR (req_id % 2 = 1 AND k = 3)""")
def o_j9_truth_links(spark, sf_dir):
    return metrics.truth_links(_truth(spark, sf_dir))


@query(f"""WITH {duck('requirements')}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY req_code) AS k FROM requirements WHERE coverage_status <> 'Supported')
SELECT project_id, concat('F-', CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END) AS finding_code, req_code, CASE coverage_status WHEN 'Partial' THEN 'Partial evidence' WHEN 'Missing' THEN 'Missing evidence' ELSE 'Potential conflict' END AS finding_type,
 CASE WHEN req_id % 2 = 0 THEN 2 ELSE 1 END AS n_sources FROM n""")
def o_j9_truth_findings(spark, sf_dir):
    return metrics.truth_findings(_truth(spark, sf_dir), "project_id").select("project_id", "finding_code", "req_code", "finding_type", F.size("expected_evidence").alias("n_sources"))


@query(f"""WITH {_CLASSES}, a AS (SELECT round_even(100 * sum(tp) / sum(support), 2) AS accuracy, round_even(100 * avg(f), 2) AS macro_f1 FROM f)
SELECT 'accuracy' AS metric, accuracy AS value, CAST(80 AS DOUBLE) AS target, CASE WHEN accuracy >= 80 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM a
UNION ALL SELECT 'macro_f1', macro_f1, 80, CASE WHEN macro_f1 >= 80 THEN 'PASS' ELSE 'REVIEW' END FROM a""")
def o_j10_quality_gate(spark, sf_dir):
    scores = metrics.classification_scores(_pairs(spark, sf_dir))
    return metrics.quality_gate(metrics.unpivot(scores, {"accuracy": "accuracy", "macro_f1": "macro_f1"}))
