"""Queries of sources, chunking, maintenance and text scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed, text, units
from ..functions.contracts import parse_contract
from ..operators import chunking, maintenance, requirement_lines, retrieval, sections
from ..sources import commits, tables
from ..sources.shared import shared_dir
from .views import LINE_CHUNKS, duck, duck_tokens, line_chunks, shared, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with its DuckDB SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
WITH t AS (SELECT p_partkey, concat_ws('; ', CASE WHEN trim(p_name) <> '' THEN 'p_name: ' || trim(p_name) END, CASE WHEN trim(p_brand) <> '' THEN 'p_brand: ' || trim(p_brand) END, 'p_size: ' || p_size) AS content FROM part)
SELECT 'part.csv' AS document_name, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INT) AS chunk_index, CAST(row_number() OVER (ORDER BY p_partkey) + 1 AS INT) AS row, content FROM t""")
def o_a1_row_chunks(spark, sf_dir):
    return tables.linearise_rows(table(spark, sf_dir, "part"), ["p_partkey"], ["p_name", "p_brand", "p_size"], "part.csv")


@query("""
WITH t AS (SELECT p_brand AS sheet, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, p_name, p_type, p_size FROM part),
u AS (SELECT sheet, r + 1 AS row, concat_ws('; ', 'name: ' || p_name, 'Col1: ' || p_type, 'size: ' || p_size) AS content FROM t)
SELECT 'parts.xlsx' AS document_name, CAST(row_number() OVER (ORDER BY sheet, row) - 1 AS INT) AS chunk_index, sheet, row, content FROM u""")
def o_a2_sheet_chunks(spark, sf_dir):
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part")
    rows = p.select(F.lit("parts.xlsx").alias("document_name"), F.col("p_brand").alias("sheet"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1).cast("long").alias("row"), F.array("p_name", "p_type", F.col("p_size").cast("string")).alias("cells"))
    heads = p.select(F.lit("parts.xlsx").alias("document_name"), F.col("p_brand").alias("sheet")).distinct().select("*", F.lit(1).cast("long").alias("row"), F.array(F.lit("name"), F.lit(" "), F.lit("size")).alias("cells"))
    return tables.linearise_sheets(rows.unionByName(heads).withColumn("sheet_no", F.col("sheet")))


@query(r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id, CAST(i + 1 AS INT) AS page_number, CAST(i AS INT) AS chunk_index, md5(regexp_replace(c, '^\s+|\s+$', '', 'g')) AS digest FROM p WHERE regexp_replace(c, '^\s+|\s+$', '', 'g') <> ''""")
def o_a3_page_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.page_chunks(d, "\n").select("doc_id", "page_number", "chunk_index", F.md5("content").alias("digest"))


@query(r"""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
f(doc_id, l, i, cur, done) AS (SELECT doc_id, l, 0, '', CAST([] AS VARCHAR[]) FROM p
 UNION ALL SELECT doc_id, l, i + 1,
   CASE WHEN cur = '' OR (length(cur) > 1500 OR regexp_matches(l[i + 1], '^\s*#{1,6}\s') OR regexp_matches(l[i + 1], '(?i)^(REQ[-_]?[A-Za-z0-9_-]*\d+|R[-_]?[A-Za-z0-9_-]*\d+)\s*[:\-–]')) THEN l[i + 1] ELSE cur || chr(10) || l[i + 1] END,
   CASE WHEN cur <> '' AND (length(cur) > 1500 OR regexp_matches(l[i + 1], '^\s*#{1,6}\s') OR regexp_matches(l[i + 1], '(?i)^(REQ[-_]?[A-Za-z0-9_-]*\d+|R[-_]?[A-Za-z0-9_-]*\d+)\s*[:\-–]')) THEN list_append(done, cur) ELSE done END
 FROM f WHERE i < len(l)),
g AS (SELECT doc_id, list_append(done, cur) AS parts FROM f WHERE i = len(l) AND cur <> ''),
h AS (SELECT doc_id, unnest(parts) AS c, unnest(range(len(parts))) AS i FROM g)
SELECT doc_id, CAST(i AS INT) AS chunk_index, md5(c) AS digest FROM h""")
def o_a4_section_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.section_chunks(d).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query(ORACLES["o_a4_section_chunks"])
def o_a4_line_sections(spark, sf_dir):
    """The same for documents that come as rows of lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return sections.section_lines(lines, ["doc_id"], "line").select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query(f"WITH {duck('docs')} SELECT document_id, document_name, lower(regexp_extract(document_name, '(\\.[^./]+)$', 1)) AS suffix, CASE lower(regexp_extract(document_name, '(\\.[^./]+)$', 1)) WHEN '.pdf' THEN 'Specification' ELSE 'Test Report' END AS doc_type FROM docs WHERE document_name NOT LIKE '%.txt'")
def o_a5_route_documents(spark, sf_dir):
    known, _ = tables.route_documents(shared(spark, sf_dir, "docs"), "document_name")
    return known.select("document_id", "document_name", "suffix", "doc_type")


@query(f"WITH {duck('docs')} SELECT document_id, '.txt' AS suffix, 'Unsupported file type: .txt' AS error FROM docs WHERE document_name LIKE '%.txt'")
def o_a5_rejected_documents(spark, sf_dir):
    _, rejected = tables.route_documents(shared(spark, sf_dir, "docs"), "document_name")
    return rejected.select("document_id", "suffix", "error")


@query()
def o_a6_registered_files(spark, sf_dir):
    return tables.register_files(spark, sf_dir).select("original_filename", "file_size", "version", "processing_status")


@query(f"WITH {duck('docs')} SELECT document_id FROM docs WHERE regexp_matches(lower(document_name), 'spec|requirement|user_manual')")
def o_a10_specification_names(spark, sf_dir):
    return shared(spark, sf_dir, "docs").where(tables.specification_names(F.col("document_name"))).select("document_id")


@query(f"WITH {LINE_CHUNKS} SELECT document_id, md5(string_agg(content, ' ' ORDER BY chunk_index)) AS digest FROM line_chunks GROUP BY 1")
def o_a11_reassembled_texts(spark, sf_dir):
    return chunking.reassemble(line_chunks(spark, sf_dir), ["document_id"]).select("document_id", F.md5("text").alias("digest"))


@query(f"""WITH {LINE_CHUNKS}, n AS (SELECT chunk_id, document_name, row_number() OVER (ORDER BY document_name, document_id, chunk_index) AS k FROM line_chunks)
SELECT chunk_id AS source_chunk, concat('chunk-', CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END) AS chunk_id,
CASE WHEN document_name LIKE '%SRS%' OR document_name LIKE '%Spec%' THEN 'Specification' ELSE 'Test Report' END AS doc_type FROM n""")
def o_a12_numbered_chunks(spark, sf_dir):
    c = line_chunks(spark, sf_dir).withColumnRenamed("chunk_id", "source_chunk")
    return tables.number_chunks(c, "document_name", ["document_id", "chunk_index"]).select("source_chunk", "chunk_id", tables.type_by_name(F.col("document_name")).alias("doc_type"))


@query(f"WITH {duck('docs')} SELECT document_id FROM docs WHERE document_id NOT IN (SELECT c_nationkey FROM customer)")
def o_b1_unparsed_documents(spark, sf_dir):
    """Chunks take their documents from the customers' nations, which are fewer."""
    chunks = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("document_id"))
    return maintenance.unparsed(shared(spark, sf_dir, "docs"), chunks).select("document_id")


@query(f"""WITH {duck('docs', 'chunks')}, n AS (SELECT document_id, count(*) AS k FROM chunks GROUP BY 1)
SELECT document_id, CAST(coalesce(k, 0) AS INT) AS page_count, CASE WHEN document_id % 10 = 3 THEN 'Error' WHEN k > 0 THEN 'Indexed' ELSE 'Queued' END AS processing_status FROM docs LEFT JOIN n USING (document_id)""")
def o_b2_document_status(spark, sf_dir):
    d = shared(spark, sf_dir, "docs")
    out = maintenance.document_status(d, shared(spark, sf_dir, "chunks"), d.where("document_id % 10 = 3"))
    return out.select("document_id", "page_count", "processing_status")


@query(f"""WITH {duck('findings')} SELECT finding_id, project_id, finding_code FROM findings WHERE project_id NOT IN (3, 4)
UNION ALL SELECT finding_id, project_id, concat(finding_code, '-2') FROM findings WHERE project_id IN (3, 4) AND severity = 'Critical' AND EXISTS (SELECT 1 FROM findings g WHERE g.project_id = findings.project_id)""")
def o_b3_replaced_findings(spark, sf_dir):
    f = shared(spark, sf_dir, "findings").select("finding_id", "project_id", "finding_code", "severity")
    new = f.where("project_id in (3, 4) and severity = 'Critical'").withColumn("finding_code", F.concat("finding_code", F.lit("-2")))
    return maintenance.replaced(f, new, ["project_id"]).select("finding_id", "project_id", "finding_code")


@query(f"""WITH {duck('findings', 'links')} SELECT 'findings' AS name, 2 AS version, count(*) AS n, count(DISTINCT req_id) AS reqs FROM findings WHERE severity = 'Critical'
UNION ALL SELECT 'links', 2, count(*), count(DISTINCT req_id) FROM links""")
def o_b3_committed_results(spark, sf_dir):
    """Two commits: findings and links together, then the findings of a second run alone."""
    root = f"{shared_dir(spark)}/proofline/commits-{uuid.uuid4().hex}"
    f = shared(spark, sf_dir, "findings").select("finding_id", "req_id", "project_id", "severity")
    commits.commit(spark, root, {"findings": f, "links": shared(spark, sf_dir, "links").select("req_id", "chunk_id")})
    version = commits.commit(spark, root, {"findings": f.where("severity = 'Critical'")})
    counts = [df.agg(F.lit(name).alias("name"), F.lit(version).alias("version"), F.count("*").alias("n"), F.count_distinct("req_id").alias("reqs")) for name, df in commits.read_tables(spark, root).items()]
    return tables.union_all(counts)


@query("""
WITH e AS (SELECT user_id AS req_id, arg_max(event_type, (ts, event_id)) AS review_state, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id),
r AS (SELECT c_custkey AS req_id, c_mktsegment AS review_state, c_acctbal AS balance FROM customer)
SELECT r.req_id, CASE WHEN e.req_id IS NOT NULL AND e.value >= 10 THEN e.review_state ELSE r.review_state END AS review_state,
CASE WHEN e.req_id IS NOT NULL AND e.value < 10 THEN NULL ELSE r.balance END AS balance FROM r LEFT JOIN e USING (req_id)""")
def o_b4_patched_requirements(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("req_id"), "event_id", "ts", "value", F.col("event_type").alias("review_state"))
    last = maintenance.latest_edits(events, "req_id", [F.col("ts"), F.col("event_id")])
    edits = last.select("req_id", "review_state", F.lit(None).cast("double").alias("balance"), (F.col("value") >= 10).alias("has_review_state"), (F.col("value") < 10).alias("has_balance"))
    reqs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("req_id"), F.col("c_mktsegment").alias("review_state"), F.col("c_acctbal").alias("balance"))
    return maintenance.patch(reqs, edits, "req_id", ["review_state", "balance"])


@query(f"WITH {duck('docs', 'chunks')} SELECT chunk_id, document_id FROM chunks WHERE document_id IN (SELECT document_id FROM docs WHERE project_id % 5 <> 0)")
def o_b5_cascaded_chunks(spark, sf_dir):
    p = shared(spark, sf_dir, "projects")
    kept = maintenance.cascade_delete(
        p, {"documents": (shared(spark, sf_dir, "docs"), "document_id", "project_id"), "chunks": (shared(spark, sf_dir, "chunks"), "chunk_id", "document_id")}, p.where("project_id % 5 = 0"), "project_id"
    )
    return kept["chunks"].select("chunk_id", "document_id")


@query("SELECT n_nationkey AS project_id, concat('TA-2026-', upper(substr(sha256(CAST(n_nationkey AS VARCHAR)), 1, 4))) AS audit_id, 'Draft' AS status, n_name AS name FROM nation WHERE length(n_name) <= 8")
def o_b6_inserted_projects(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    rows = maintenance.with_defaults(rows, {"status": "Draft"}).withColumn("audit_id", maintenance.audit_id(F.col("project_id"), F.lit(2026)))
    good, _ = maintenance.checked_lengths(rows, {"name": (1, 8)})
    return good.select("project_id", "audit_id", "status", "name")


@query(f"""WITH {duck('docs', 'chunks', 'links')}, n AS (SELECT document_id, count(*) AS k FROM links JOIN chunks USING (chunk_id) GROUP BY 1)
SELECT document_id, coalesce(k, 0) AS requirements_linked FROM docs LEFT JOIN n USING (document_id)""")
def o_b7_linked_counts(spark, sf_dir):
    return maintenance.linked_counts(shared(spark, sf_dir, "docs"), shared(spark, sf_dir, "chunks"), shared(spark, sf_dir, "links"))


@query(f"""WITH {LINE_CHUNKS}, t AS (SELECT chunk_id, unnest({duck_tokens('content')}) AS token FROM line_chunks) SELECT token, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM t GROUP BY 1""")
def o_t1_tokens(spark, sf_dir):
    return retrieval.token_counts(line_chunks(spark, sf_dir))


_CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in fixed.CATEGORY_KEYWORDS.items()) + " ELSE 'Documentation' END"


@query(f"""WITH {duck('part_requirements')}, r AS (SELECT req_id, lower(concat(title, '. ', description)) AS low FROM part_requirements), c AS (SELECT req_id, {_CATEGORY} AS category FROM r)
SELECT req_id, category, CASE WHEN category IN ('Safety', 'Electrical') THEN 'High' ELSE 'Medium' END AS severity FROM c""")
def o_t2_t4_categories(spark, sf_dir):
    r = shared(spark, sf_dir, "part_requirements").withColumn("category", text.infer_category(F.concat("title", F.lit(". "), "description")))
    return r.select("req_id", "category", text.severity_of(F.col("category")).alias("severity"))


@query(rf"""WITH {duck('part_requirements')}, m AS (SELECT req_id, unnest(regexp_extract_all(description, '(?i)([+-]?\d+(?:\.\d+)?)\s*([°\w/]+)?\s*(?:–|-|to)\s*([+-]?\d+(?:\.\d+)?)\s*([°\w/]+)?')) AS value FROM part_requirements),
a AS (SELECT req_id, 'operating_range' AS name, value, CAST(regexp_extract(value, '([+-]?\d+(?:\.\d+)?)', 1) AS DOUBLE) AS min_val,
 CAST(regexp_extract(value, '(?i)(?:–|-|to)\s*([+-]?\d+(?:\.\d+)?)', 1) AS DOUBLE) AS max_val, 'V' AS unit FROM m)
SELECT * FROM a UNION ALL SELECT req_id, 'ingress_protection', upper(regexp_extract(description, '(?i)IP\d{{2}}')), NULL, NULL, 'IP' FROM part_requirements WHERE regexp_matches(description, '(?i)IP\d{{2}}')""")
def o_t3_parameters(spark, sf_dir):
    return shared(spark, sf_dir, "part_requirements").select("req_id", F.inline(text.extract_parameters(F.col("description"))))


def _spec_text(spark, sf_dir):
    """A specification text for each run of 50 parts: coded, modal and other lines in turn."""
    r = shared(spark, sf_dir, "part_requirements").withColumn("grp", F.floor(F.col("req_id") / 50))
    line = F.when(F.col("req_id") % 3 == 0, F.concat(F.lower("req_code"), F.lit(": "), "title")).otherwise(F.col("description"))
    return r.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("req_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


_LINE_CODE = fixed.LINE_CODE.replace("(?iU)", "(?i)")
_DUCK_RANGE = fixed.PLAIN_RANGE.replace("(?iU)", "(?i)")
_MODAL = " OR ".join(f"contains(lower(line), '{m}')" for m in fixed.MODALS)
_N_PARAMETERS = rf"len(regexp_extract_all({{0}}, '{_DUCK_RANGE}')) + CAST(regexp_matches({{0}}, '(?i)IP\d{{{{2}}}}') AS INT)"
_EXTRACTED = rf"""
WITH RECURSIVE {duck('part_requirements')},
raw AS (SELECT CAST(req_id // 50 AS BIGINT) AS grp, req_id, CASE WHEN req_id % 3 = 0 THEN concat(lower(req_code), ': ', title) ELSE description END AS line FROM part_requirements),
marked AS (SELECT grp, req_id, line, nullif(regexp_extract(line, '{_LINE_CODE}', 1), '') AS code, coalesce(nullif(trim(regexp_extract(line, '{_LINE_CODE}', 2)), ''), line) AS named FROM raw WHERE length(line) >= 15),
l AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY req_id) AS n, line, upper(replace(code, '_', '-')) AS code, CASE WHEN code IS NULL THEN substr(line, 1, 120) ELSE named END AS title FROM marked WHERE code IS NOT NULL OR {_MODAL}),
f(grp, n, head, title, description) AS (
 SELECT grp, n, n, title, line FROM l WHERE n = 1
 UNION ALL SELECT f.grp, l.n, CASE WHEN l.code IS NULL AND (f.description = f.title OR length(f.description) < 80) THEN f.head ELSE l.n END,
   CASE WHEN l.code IS NULL AND (f.description = f.title OR length(f.description) < 80) THEN f.title ELSE l.title END,
   CASE WHEN l.code IS NULL AND (f.description = f.title OR length(f.description) < 80) THEN concat(f.title, '. ', l.line) ELSE l.line END
 FROM f JOIN l ON l.grp = f.grp AND l.n = f.n + 1),
c AS (SELECT l.*, f.head, f.description, CASE WHEN l.n = f.head AND l.code IS NOT NULL THEN l.title ELSE l.line END AS basis FROM f JOIN l USING (grp, n)),
k AS (SELECT *, {_N_PARAMETERS.format('basis')} AS found FROM c),
r AS (SELECT grp, head, max(code) FILTER (WHERE n = head) AS code, max(title) FILTER (WHERE n = head) AS title, arg_max(description, n) AS description, lower(max(basis) FILTER (WHERE n = head)) AS low,
  coalesce(arg_min(found, n) FILTER (WHERE found > 0), 0) AS n_parameters FROM k GROUP BY 1, 2),
s AS (SELECT grp, CAST(row_number() OVER w - 1 AS INT) AS ord, coalesce(code, concat('REQ-', lpad(CAST(count(*) FILTER (WHERE code IS NULL) OVER w AS VARCHAR), 3, '0'))) AS req_code, title, description, {_CATEGORY} AS category, CAST(n_parameters AS INT) AS n_parameters
  FROM r WINDOW w AS (PARTITION BY grp ORDER BY head ROWS UNBOUNDED PRECEDING))
SELECT grp, ord, req_code, title, description, category, CASE WHEN category IN ('Safety', 'Electrical') THEN 'High' ELSE 'Medium' END AS severity, n_parameters FROM s"""


@query(_EXTRACTED)
def o_t5_line_requirements(spark, sf_dir):
    """The same for documents that come as rows of lines."""
    lines = requirement_lines.document_lines(_spec_text(spark, sf_dir), ["grp"])
    reqs = requirement_lines.requirement_lines(lines, ["grp"], "line")
    return reqs.select("grp", "ord", "req_code", "title", "description", "category", "severity", F.size("parameters").alias("n_parameters"))


@query(_EXTRACTED)
def o_t5_extracted_requirements(spark, sf_dir):
    rows = _spec_text(spark, sf_dir).select("grp", F.posexplode(text.extract_requirements(F.col("text"))).alias("ord", "r"))
    return rows.select("grp", "ord", "r.req_code", "r.title", "r.description", "r.category", "r.severity", F.size("r.parameters").alias("n_parameters"))


@query(r"SELECT p_partkey AS req_id, regexp_replace(upper(trim(concat('  req_', p_brand, ' ', p_partkey, ' '))), '[_\s]+', '-', 'g') AS code FROM part")
def o_t6_normalized_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("req_id"), text.normalize_code(F.concat(F.lit("  req_"), "p_brand", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(" "))).alias("code"))


@query("""SELECT doc_id, CASE toxic + 2 * quality WHEN 0 THEN 'Missing' WHEN 1 THEN 'Conflict' WHEN 2 THEN 'Supported' ELSE 'Missing' END AS status FROM labels""")
def o_t7_normalized_statuses(spark, sf_dir):
    raw = F.element_at(F.array(F.lit(None).cast("string"), F.lit(" Contradiction"), F.lit("PASS"), F.lit("unheard of")), F.col("toxic") + 2 * F.col("quality") + 1)
    return table(spark, sf_dir, "labels").select("doc_id", text.normalize_status(raw).alias("status"))


@query("""SELECT p_partkey AS req_id, CASE p_partkey % 3 WHEN 0 THEN 'rules' ELSE 'model' END AS origin, CASE p_partkey % 3 WHEN 0 THEN concat('REQ-RUL-', p_partkey) ELSE concat('REQ-MOD-', p_partkey) END AS req_code FROM part""")
def o_t8_t9_model_or_rules(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("req_id"))
    key = F.col("req_id").cast("string")
    answer = F.when(F.col("req_id") % 3 == 0, F.concat(F.lit("```json\n{broken "), key, F.lit("\n```"))).otherwise(
        F.concat(F.lit('```json\n{"requirements": [{"req_code": "REQ-MOD-'), key, F.lit('", "title": "t"}]}\n```'))
    )
    rules = F.array(F.struct(F.concat(F.lit("REQ-RUL-"), key).alias("req_code"), *[F.lit(None).cast(t).alias(n) for n, t in (("title", "string"), ("description", "string"), ("category", "string"), ("severity", "string"), ("parameters", text.PARAMETERS))]))
    chosen = p.withColumn("r", text.model_or_rules(text.parse_response(answer), rules))
    code = F.get("r", F.lit(0))["req_code"]
    return chosen.select("req_id", F.when(F.contains(code, F.lit("MOD")), "model").otherwise("rules").alias("origin"), code.alias("req_code"))


@query(rf"""WITH {duck('part_requirements')} SELECT req_id, upper(regexp_extract(concat('see ', lower(req_code), ' and REQ_X9.'), '(?i)\b(REQ[-_]?[A-Za-z0-9_-]*\d+)\b', 1)) AS first_code, 2 AS n_codes FROM part_requirements""")
def o_t10_code_scan(spark, sf_dir):
    r = shared(spark, sf_dir, "part_requirements").withColumn("t", F.concat(F.lit("see "), F.lower("req_code"), F.lit(" and REQ_X9.")))
    return r.select("req_id", F.upper(text.first_code(F.col("t"))).alias("first_code"), F.size(text.requirement_codes(F.col("t"))).alias("n_codes"))


_UNIT_LIST = ["V", "kV", "mV", "uA", "mA", "ms", "s", "Hz", "bar", "parsec"]
_UNIT_ROWS = ", ".join(f"('{u}', '{d}', {f!r})" for u, (d, f) in fixed.UNITS.items())


@query(f"""WITH u(unit, dimension, factor) AS (VALUES {_UNIT_ROWS}), p AS (SELECT p_partkey, p_retailprice AS v, {_UNIT_LIST!r}[p_partkey % 10 + 1] AS a, {_UNIT_LIST!r}[p_size % 10 + 1] AS b FROM part)
SELECT p_partkey, lower(p.a) AS unit, (lower(p.a) = lower(p.b) OR coalesce(x.dimension = y.dimension, FALSE)) AS compatible,
 CASE WHEN lower(p.a) = lower(p.b) THEN v WHEN x.dimension = y.dimension THEN v * x.factor / y.factor END AS converted
FROM p LEFT JOIN u x ON x.unit = lower(p.a) LEFT JOIN u y ON y.unit = lower(p.b)""")
def o_u1_u4_units(spark, sf_dir):
    pick = lambda c: F.element_at(F.array(*[F.lit(u) for u in _UNIT_LIST]), (F.col(c) % 10 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("v"), pick("p_partkey").alias("a"), pick("p_size").alias("b"))
    return p.select("p_partkey", units.normalize_unit(F.col("a")).alias("unit"), units.compatible(F.col("a"), F.col("b")).alias("compatible"), units.convert(F.col("v"), F.col("a"), F.col("b")).alias("converted"))


@query(rf"""WITH {duck('part_requirements')}, n AS (SELECT req_id, kind, CAST(coalesce(nullif(regexp_extract(description, '(\d+)', 1), ''), '0') AS DOUBLE) AS v FROM part_requirements)
SELECT req_id, CASE kind WHEN 0 THEN 'numeric_range' WHEN 1 THEN 'threshold' WHEN 2 THEN 'duration' WHEN 3 THEN 'threshold' WHEN 4 THEN 'enumeration' WHEN 5 THEN 'boolean' WHEN 6 THEN 'boolean' ELSE 'semantic' END AS requirement_type,
 CASE kind WHEN 0 THEN 'between' WHEN 1 THEN '<=' WHEN 2 THEN '<=' WHEN 3 THEN '>=' WHEN 7 THEN NULL ELSE '==' END AS operator,
 CASE kind WHEN 4 THEN 'IP67' WHEN 5 THEN 'true' WHEN 6 THEN 'true' END AS expected_value,
 CASE WHEN kind IN (0, 3) THEN v END AS min_value, CASE kind WHEN 0 THEN v + 30 WHEN 1 THEN v WHEN 2 THEN v END AS max_value,
 CASE kind WHEN 0 THEN 'V DC' WHEN 1 THEN 'uA' WHEN 2 THEN 'ms' WHEN 3 THEN 'kV' WHEN 4 THEN 'IP' END AS unit FROM n""")
def o_e1_e7_contracts(spark, sf_dir):
    r = shared(spark, sf_dir, "part_requirements").withColumn("c", parse_contract(F.col("title"), F.col("description")))
    return r.select("req_id", *[F.col("c")[x].alias(x) for x in ("requirement_type", "operator", "expected_value", "min_value", "max_value", "unit")])
