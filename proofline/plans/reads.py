"""Queries of findings, read lists, statistics and traceability."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import increments, maintenance, outputs, palette
from ..sources.shared import shared_dir
from .views import duck, shared

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TYPES = "CASE coverage_status WHEN 'Partial' THEN 'Partial evidence' WHEN 'Missing' THEN 'Missing evidence' ELSE 'Potential conflict' END"


@query(f"""WITH {duck('requirements')}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY req_code) AS k FROM requirements WHERE coverage_status <> 'Supported')
SELECT req_id, project_id, concat('F-', CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END) AS finding_code, {_TYPES} AS finding_type FROM n""")
def o_i1_generated_findings(spark, sf_dir):
    return outputs.findings(shared(spark, sf_dir, "requirements")).select("req_id", "project_id", "finding_code", "finding_type")


@query(f"""WITH {duck('requirements', 'links')}, n AS (SELECT req_id, count(*) AS k FROM links GROUP BY 1)
SELECT req_id, req_code, coverage_status, review_state, CAST(coalesce(k, 0) AS INT) AS sources_count FROM requirements LEFT JOIN n USING (req_id)""")
def o_i2_updated_requirements(spark, sf_dir):
    r = shared(spark, sf_dir, "requirements")
    run = r.select("req_id", "coverage_status", F.lit(90.0).alias("confidence"), "review_state", F.lit("a").alias("analysis"), F.lit("r").alias("recommendation"))
    out = outputs.updated_requirements(r.select("req_id", "req_code", F.lit("old").alias("coverage_status")), run, shared(spark, sf_dir, "links"))
    return out.select("req_id", "req_code", "coverage_status", "review_state", "sources_count")


@query(f"""WITH {duck('requirements', 'findings', 'links')} SELECT (SELECT count(*) FROM requirements) AS requirements, (SELECT count(*) FROM findings) AS findings, (SELECT count(*) FROM links) AS links""")
def o_i3_run_summary(spark, sf_dir):
    return outputs.run_summary(*[shared(spark, sf_dir, n) for n in ("requirements", "findings", "links")])


@query(f"""WITH {duck('projects', 'requirements', 'docs', 'chunks', 'findings')},
r AS (SELECT project_id, count(*) AS total, count_if(coverage_status = 'Supported') AS supported, count_if(coverage_status = 'Partial') AS partial, count_if(coverage_status = 'Missing') AS missing, count_if(coverage_status = 'Conflict') AS conflict FROM requirements GROUP BY 1),
d AS (SELECT project_id, count(*) AS documents FROM docs GROUP BY 1), c AS (SELECT project_id, count(*) AS chunks FROM chunks JOIN docs USING (document_id) GROUP BY 1), f AS (SELECT project_id, count(*) AS findings FROM findings GROUP BY 1)
SELECT project_id, coalesce(total, 0) AS total, coalesce(supported, 0) AS supported, coalesce(partial, 0) AS partial, coalesce(missing, 0) AS missing, coalesce(conflict, 0) AS conflict, coalesce(documents, 0) AS documents, coalesce(chunks, 0) AS chunks, coalesce(findings, 0) AS findings,
 CAST(CASE WHEN coalesce(total, 0) > 0 THEN round_even(100.0 * supported / total, 0) ELSE 0 END AS INT) AS coverage
FROM projects LEFT JOIN r USING (project_id) LEFT JOIN d USING (project_id) LEFT JOIN c USING (project_id) LEFT JOIN f USING (project_id)""")
def o_i4_project_stats(spark, sf_dir):
    return outputs.project_stats(*[shared(spark, sf_dir, n) for n in ("projects", "requirements", "docs", "chunks", "findings")])


@query(ORACLES["o_i4_project_stats"].replace("r AS (SELECT", "moved AS (SELECT * REPLACE (CASE coverage_status WHEN 'Missing' THEN 'Partial' ELSE coverage_status END AS coverage_status) FROM requirements), r AS (SELECT").replace("AS conflict FROM requirements", "AS conflict FROM moved"))
def o_i4_incremental_stats(spark, sf_dir):
    """The same counts from two batches: all rows, then every missing requirement becomes a partial one; the second is sent twice."""
    projects, reqs, docs, chunks, findings = (shared(spark, sf_dir, n) for n in ("projects", "requirements", "docs", "chunks", "findings"))
    root, columns = f"{shared_dir(spark)}/proofline/stats-{uuid.uuid4().hex}", ["project_id", "coverage_status"]
    plus = lambda df: df.select("project_id", F.lit(1).alias("sign"))
    placed = chunks.join(docs.select("document_id", "project_id"), "document_id")
    increments.apply_batch(spark, root, "all", {"requirements": reqs.select(*columns, F.lit(1).alias("sign")), "documents": plus(docs), "chunks": plus(placed), "findings": plus(findings)})
    missing = reqs.where("coverage_status = 'Missing'")
    for _ in range(2):
        increments.apply_batch(spark, root, "moved", {"requirements": increments.changes(missing, missing.withColumn("coverage_status", F.lit("Partial")), columns)})
    return increments.stored_stats(spark, root, projects)


@query(f"""WITH {duck('requirements', 'links', 'chunks', 'docs')},
e AS (SELECT req_id, count(*) AS k, string_agg(concat(chunk_id, ':', document_name, ':', page_number, ':', status), ';' ORDER BY chunk_id, document_name, page_number, status) AS evidence FROM links JOIN chunks USING (chunk_id) JOIN docs USING (document_id) GROUP BY 1)
SELECT req_id, req_code, coalesce(k, 0) AS n_evidence, coalesce(evidence, '') AS evidence FROM requirements LEFT JOIN e USING (req_id) WHERE severity = 'High' AND coverage_status = 'Partial'""")
def o_i5_requirement_list(spark, sf_dir):
    out = outputs.requirement_list(*[shared(spark, sf_dir, n) for n in ("requirements", "links", "chunks", "docs")], severity="High", coverage_status="Partial", review_state=None)
    flat = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["chunk_id"].cast("string"), e["document_name"], e["page_number"].cast("string"), e["status"])), ";")
    return out.select("req_id", "req_code", F.size("evidence").cast("long").alias("n_evidence"), flat.alias("evidence"))


@query(f"WITH {duck('requirements')} SELECT req_id, req_code, title FROM requirements WHERE project_id = 7 AND req_code = (SELECT min(req_code) FROM requirements WHERE project_id = 7)")
def o_i6_lookup(spark, sf_dir):
    r = outputs.lookup(shared(spark, sf_dir, "requirements"), project_id=7)
    first = r.agg(F.min("req_code").alias("req_code"))
    return r.join(first, "req_code", "left_semi").select("req_id", "req_code", "title")


@query(f"""WITH {duck('requirements', 'findings')} SELECT finding_id, finding_code, title AS requirement_title, created_at FROM findings LEFT JOIN requirements USING (req_id) WHERE findings.severity = 'Critical' AND finding_type = 'Missing evidence'""")
def o_i7_finding_list(spark, sf_dir):
    out = outputs.finding_list(shared(spark, sf_dir, "findings"), shared(spark, sf_dir, "requirements"), severity="Critical", finding_type="Missing evidence", assigned_to=None)
    return out.select("finding_id", "finding_code", "requirement_title", "created_at")


@query(f"WITH {duck('docs')} SELECT document_id, document_name FROM docs WHERE project_id = 5")
def o_i8_document_list(spark, sf_dir):
    d = outputs.optional_filters(shared(spark, sf_dir, "docs"), project_id=5)
    return maintenance.newest_first(d, "balance", "document_id").select("document_id", "document_name")


@query(f"WITH {duck('requirements')} SELECT req_id, req_code, title FROM requirements WHERE review_state = 'Needs review' AND source_document = 'doc3' AND contains(lower(concat(req_code, ' ', title)), '00')")
def o_i9_requirement_table(spark, sf_dir):
    return outputs.requirement_table(shared(spark, sf_dir, "requirements"), tab="Needs review", document="doc3", query="00", ascending=False).select("req_id", "req_code", "title")


@query(f"WITH {duck('requirements', 'findings')} SELECT finding_id, finding_code, title AS requirement_title FROM findings LEFT JOIN requirements USING (req_id) WHERE assigned_to = 'Grace' AND contains(lower(concat_ws(' ', finding_code, title)), 'customer#0000001')")
def o_i10_finding_table(spark, sf_dir):
    f = outputs.finding_list(shared(spark, sf_dir, "findings"), shared(spark, sf_dir, "requirements"))
    return outputs.finding_table(f, reviewer="Grace", query="Customer#0000001").select("finding_id", "finding_code", "requirement_title")


@query(f"""WITH {duck('findings')}, b(severity) AS (VALUES ('Critical'), ('High'), ('Medium'), ('Low')), n AS (SELECT severity, count(*) AS n FROM findings GROUP BY 1)
SELECT severity, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER () AS BIGINT) AS total FROM b LEFT JOIN n USING (severity)""")
def o_i11_severity_counts(spark, sf_dir):
    return outputs.severity_counts(shared(spark, sf_dir, "findings"))


@query(f"WITH {duck('findings')} SELECT DISTINCT assigned_to FROM findings WHERE assigned_to IS NOT NULL")
def o_i12_reviewers(spark, sf_dir):
    return outputs.reviewers(shared(spark, sf_dir, "findings"))


@query(f"WITH {duck('findings')} SELECT finding_id, created_at FROM findings ORDER BY created_at DESC, finding_id LIMIT 6")
def o_i13_recent_findings(spark, sf_dir):
    return maintenance.recent(shared(spark, sf_dir, "findings"), "created_at", "finding_id", 6).select("finding_id", "created_at")


@query(f"""WITH {duck('requirements')}, n AS (SELECT coverage_status, count(*) AS n FROM requirements GROUP BY 1)
SELECT coverage_status, n, n / sum(n) OVER () AS share, CAST(floor(100.0 * n / sum(n) OVER () + 0.5) AS BIGINT) AS percent FROM n""")
def o_i14_coverage_shares(spark, sf_dir):
    return outputs.coverage_shares(shared(spark, sf_dir, "requirements"))


_EDGES = f"""{duck('requirements', 'links', 'chunks', 'findings')},
held AS (SELECT links.req_id, chunk_id, document_id FROM links JOIN chunks USING (chunk_id) WHERE links.req_id IN (SELECT req_id FROM requirements)),
edges AS (SELECT DISTINCT 'requirement' AS source_type, CAST(req_id AS VARCHAR) AS source, 'document' AS target_type, CAST(document_id AS VARCHAR) AS target FROM held
 UNION ALL SELECT DISTINCT 'document', CAST(document_id AS VARCHAR), 'evidence', CAST(chunk_id AS VARCHAR) FROM held
 UNION ALL SELECT DISTINCT 'evidence', CAST(chunk_id AS VARCHAR), 'finding', finding_code FROM held JOIN findings USING (req_id))"""


def _edges(spark, sf_dir):
    return outputs.trace_edges(*[shared(spark, sf_dir, n) for n in ("requirements", "links", "chunks", "findings")])


@query(f"WITH {_EDGES} SELECT * FROM edges")
def o_i15_trace_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {_EDGES} SELECT DISTINCT source_type AS node_type, source AS node FROM edges WHERE target_type = 'document' AND target = '1' UNION SELECT DISTINCT target_type, target FROM edges WHERE source_type = 'document' AND source = '1'")
def o_i16_neighbours(spark, sf_dir):
    return outputs.neighbours(_edges(spark, sf_dir), "document", "1")


@query(f"WITH {_EDGES}, b AS (SELECT source_type AS node_type, source AS node FROM edges WHERE target_type <> 'finding' UNION ALL SELECT target_type, target FROM edges WHERE target_type <> 'finding') SELECT node_type, node, count(*) AS degree FROM b GROUP BY 1, 2")
def o_i16_visible_degrees(spark, sf_dir):
    return outputs.degrees(outputs.visible_edges(_edges(spark, sf_dir), ["requirement", "document", "evidence"]))


@query(f"""WITH {duck('projects', 'requirements', 'docs', 'findings')}, k AS (SELECT 'project' AS kind, CAST(project_id AS VARCHAR) AS id, name AS label FROM projects UNION ALL SELECT 'requirement', req_code, title FROM requirements
 UNION ALL SELECT 'document', CAST(document_id AS VARCHAR), document_name FROM docs UNION ALL SELECT 'finding', finding_code, finding_type FROM findings) SELECT * FROM k WHERE contains(lower(concat_ws(' ', id, label)), '17')""")
def o_i17_global_search(spark, sf_dir):
    t = {n: shared(spark, sf_dir, n) for n in ("projects", "requirements", "docs", "findings")}
    kinds = {"project": (t["projects"], "project_id", "name"), "requirement": (t["requirements"], "req_code", "title"), "document": (t["docs"], "document_id", "document_name"), "finding": (t["findings"], "finding_code", "finding_type")}
    return outputs.global_search(kinds, "17")


_TYPED = ["cus17", "mis ev", "f-9pe", "pot123", "sup spec", "united"]


def _typed_sql(k: int, query: str) -> str:
    """The best placing of ``query``, one join by place for each of its characters."""
    chars, signs = "".join(query.split()), ", ".join("'" + c.replace("'", "''") + "'" for c in palette.SIGNS)
    inside = lambda gap: f"{palette.INSIDE_WORD}::DOUBLE * pow({palette.SKIPPED}::DOUBLE, {gap})"
    gate = f"WHEN prev = ' ' THEN {palette.AFTER_SPACE}::DOUBLE WHEN prev IN ({signs}) THEN {palette.AFTER_SIGN}::DOUBLE"
    parts = [
        f"l{k} AS (SELECT kind, id, label, length(low) AS n, p, substr(low, p, 1) AS ch, substr(low, p - 1, 1) AS prev FROM (SELECT *, unnest(range(1, length(low) + 1)) AS p FROM k WHERE low LIKE '%{'%'.join(chars)}%'))",
        f"s{k}_0 AS (SELECT kind, id, label, n, p, CASE WHEN p = 1 THEN 1::DOUBLE {gate} ELSE {inside('0')} END AS s FROM l{k} WHERE ch = '{chars[0]}')",
    ]
    for j, c in enumerate(chars[1:]):
        factor = f"CASE WHEN b.p = a.p + 1 THEN 1::DOUBLE {gate} ELSE {inside('b.p - a.p - 1')} END"
        parts.append(f"s{k}_{j + 1} AS (SELECT b.kind, b.id, b.label, b.n, b.p, max(a.s * {factor}) AS s FROM s{k}_{j} a JOIN l{k} b ON a.kind = b.kind AND a.id = b.id AND b.p > a.p AND b.ch = '{c}' GROUP BY ALL)")
    parts.append(f"t{k} AS (SELECT '{query}' AS query, kind, id, label, round(max(CASE WHEN p < n THEN s * {palette.UNFINISHED}::DOUBLE ELSE s END), 9) AS score FROM s{k}_{len(chars) - 1} GROUP BY ALL)")
    return ",\n".join(parts)


@query(f"""WITH {duck('projects', 'requirements', 'docs', 'findings')}, e AS (SELECT 'project' AS kind, CAST(project_id AS VARCHAR) AS id, name AS label FROM projects UNION ALL SELECT 'requirement', req_code, title FROM requirements
 UNION ALL SELECT 'document', CAST(document_id AS VARCHAR), document_name FROM docs UNION ALL SELECT 'finding', finding_code, finding_type FROM findings), k AS (SELECT *, lower(concat_ws(' ', id, label)) AS low FROM e),
{', '.join(_typed_sql(k, q) for k, q in enumerate(_TYPED))}, f AS ({' UNION ALL '.join(f'SELECT * FROM t{k}' for k in range(len(_TYPED)))}),
r AS (SELECT query, kind, CAST(row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, id, label) AS INT) AS rank, id, label, score FROM f) SELECT * FROM r WHERE rank <= 8""")
def o_i17_ranked_palette(spark, sf_dir):
    """The eight best rows of each kind for each of six typed queries."""
    t = {n: shared(spark, sf_dir, n) for n in ("projects", "requirements", "docs", "findings")}
    kinds = {"project": (t["projects"], "project_id", "name"), "requirement": (t["requirements"], "req_code", "title"), "document": (t["docs"], "document_id", "document_name"), "finding": (t["findings"], "finding_code", "finding_type")}
    return palette.ranked_search(kinds, _TYPED, 8)


@query(f"""WITH {duck('requirements', 'findings')} SELECT 'coverage' AS section, coverage_status AS name, count(*) AS n FROM requirements GROUP BY ALL UNION ALL SELECT 'review', review_state, count(*) FROM requirements GROUP BY ALL
 UNION ALL SELECT 'category', category, count(*) FROM requirements GROUP BY ALL UNION ALL SELECT 'finding', finding_type, count(*) FROM findings GROUP BY ALL""")
def o_i18_report_sections(spark, sf_dir):
    return outputs.report_sections(shared(spark, sf_dir, "requirements"), shared(spark, sf_dir, "findings"))
