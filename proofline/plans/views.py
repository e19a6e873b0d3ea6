"""Views of the test tables in the shapes the operators take.

Views whose SQL both engines share are kept as text with ``{table}`` marks: Spark fills in
DataFrames, DuckDB the names of its views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = {
    "projects": "SELECT n_nationkey AS project_id, n_name AS name, n_regionkey AS region FROM {nation}",
    "requirements": """
SELECT c_custkey AS req_id, c_nationkey AS project_id, concat('REQ-CUS-', lpad(CAST(c_custkey AS STRING), 6, '0')) AS req_code, c_name AS title,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Supported' WHEN 'MACHINERY' THEN 'Partial' WHEN 'FURNITURE' THEN 'Missing' WHEN 'HOUSEHOLD' THEN 'Conflict' ELSE 'Supported' END AS coverage_status,
       CASE c_custkey % 5 WHEN 0 THEN 'Needs review' WHEN 1 THEN 'Open' WHEN 2 THEN 'Approved' ELSE 'Reviewed' END AS review_state,
       CASE c_custkey % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS severity,
       c_mktsegment AS category, concat('doc', CAST(c_custkey % 7 AS STRING)) AS source_document, c_acctbal AS balance
FROM {customer}""",
    "docs": "SELECT s_suppkey AS document_id, s_nationkey AS project_id, concat(s_name, CASE s_suppkey % 3 WHEN 0 THEN '_Spec.pdf' WHEN 1 THEN '_report.csv' ELSE '_manual.txt' END) AS document_name, s_acctbal AS balance FROM {supplier}",
    "chunks": """
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS chunk_id, l_suppkey AS document_id, l_linenumber AS page_number, concat('line ', CAST(l_partkey AS STRING)) AS content
FROM {lineitem}""",
    "links": """
SELECT o_custkey AS req_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS chunk_id, CASE l_returnflag WHEN 'R' THEN 'Potential conflict' WHEN 'A' THEN 'Supports requirement' ELSE 'Supporting evidence' END AS status
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "findings": """
SELECT CAST(o_orderkey AS BIGINT) AS finding_id, o_custkey AS req_id, c_nationkey AS project_id, concat('F-', CAST(o_orderkey AS STRING)) AS finding_code,
       CASE o_orderstatus WHEN 'F' THEN 'Missing evidence' WHEN 'O' THEN 'Partial evidence' ELSE 'Potential conflict' END AS finding_type,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' ELSE 'Low' END AS severity,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Ada' WHEN 2 THEN 'Grace' ELSE 'Edsger' END AS assigned_to, o_orderdate AS created_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # requirement texts of seven kinds, with values from the part
    "part_requirements": """
SELECT p_partkey AS req_id, concat('REQ-PRT-', lpad(CAST(p_partkey AS STRING), 6, '0')) AS req_code, p_partkey % 8 AS kind,
       CASE p_partkey % 8 WHEN 0 THEN 'Supply voltage window' WHEN 1 THEN 'Quiescent current' WHEN 2 THEN 'Pyro latency' WHEN 3 THEN 'Dielectric strength' WHEN 4 THEN 'Enclosure sealing'
                          WHEN 5 THEN 'Diagnostic service access' WHEN 6 THEN 'Secure boot chain' ELSE 'Operator manual wording' END AS title,
       CASE p_partkey % 8 WHEN 0 THEN concat('The unit shall operate from ', CAST(p_size AS STRING), ' V to ', CAST(p_size + 30 AS STRING), ' V DC.')
                          WHEN 1 THEN concat('Current draw shall not exceed ', CAST(p_size AS STRING), ' uA in sleep mode.')
                          WHEN 2 THEN concat('Reaction latency limited to ', CAST(p_size AS STRING), ' ms after the trigger.')
                          WHEN 3 THEN concat('Withstand strength of at least ', CAST(p_size AS STRING), ' kV.')
                          WHEN 4 THEN 'Enclosure ingress protection shall be IP67 or better.'
                          WHEN 5 THEN 'Access over the diagnostic port requires authentication by credential.'
                          WHEN 6 THEN 'The firmware must use secure boot with ECDSA keys.'
                          ELSE 'The operator manual shall be archived.' END AS description
FROM {part}""",
    "part_evidence": """
SELECT l_partkey AS req_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS chunk_id, l_linenumber AS page_number, 'Document' AS doc_type,
       concat('s', CAST(l_suppkey % 50 AS STRING), CASE l_suppkey % 4 WHEN 0 THEN '_test_report' WHEN 1 THEN '_datasheet' WHEN 2 THEN '_srs' ELSE '_manual' END) AS document_name,
       CASE l_partkey % 8 WHEN 0 THEN CASE l_linenumber % 2 WHEN 0 THEN concat('Supply voltage tested at ', CAST(CAST(l_quantity AS INT) AS STRING), ' V, ', CAST(CAST(l_quantity AS INT) + 60 AS STRING), ' V in the lab.')
                                               ELSE concat('Supply voltage window ', CAST(CAST(l_quantity AS INT) AS STRING), ' V to ', CAST(CAST(l_quantity AS INT) + 25 AS STRING), ' V') END
                          WHEN 1 THEN CASE WHEN l_linenumber % 4 = 3 THEN concat('Fan housing draft measured as ', CAST(CAST(l_quantity AS INT) AS STRING), ' uA near the door.') ELSE concat('Climate chamber log of the second shift, unit on the usual load, doors shut: quiescent current measured as ', CAST(CAST(l_quantity AS INT) AS STRING), ' uA at room level.') END
                          WHEN 2 THEN concat('Pyro latency measured as ', CAST(CAST(l_quantity AS INT) AS STRING), ' ms in run ', CAST(l_linenumber AS STRING), '.')
                          WHEN 3 THEN concat('Dielectric strength verified with ', CAST(CAST(l_quantity AS INT) AS STRING), ' kV applied.')
                          WHEN 4 THEN CASE l_linestatus WHEN 'O' THEN 'Immersion check for IP67 was PASS.' ELSE 'Immersion check IP67: NOT TESTED' END
                          WHEN 5 THEN CASE l_returnflag WHEN 'R' THEN 'Connect to the diagnostic port; no login required.' ELSE 'The service port asks for a password.' END
                          WHEN 6 THEN CASE l_returnflag WHEN 'R' THEN 'Secure boot verified by the lab.' ELSE 'Secure boot chain: record in progress.' END
                          ELSE CASE l_returnflag WHEN 'N' THEN 'Manual archived; verdict FAILED.' ELSE 'Manual wording under study.' END END AS content
FROM {lineitem}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared view over the tables in ``sf_dir``."""
    text = SHARED[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def placed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view ``part_evidence`` with ``file`` and ``place``: which file of its table a row stands in, and its number there."""
    text = SHARED["part_evidence"].replace("SELECT", "SELECT file, place,", 1)
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))


def duck(*names: str) -> str:
    """``WITH`` clauses of shared views for DuckDB, without the leading keyword."""
    return ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', SHARED[n])})" for n in names)


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all lines that are not blank: project_id, chunk_id, document_id, document_name, chunk_index, content.

    Every ninth line names the code of a requirement.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("_test_report", "_datasheet", "_srs", "_manual")]), (F.col("doc_id") % 4 + 1).cast("int"))
    named = F.concat("line", F.lit(" (see REQ-BEN-"), F.lpad((F.col("doc_id") % 40).cast("string"), 5, "0"), F.lit(")"))
    rows = d.where(F.trim("line") != "").withColumn("content", F.when((F.col("doc_id") + F.col("chunk_index")) % 9 == 0, named).otherwise(F.col("line")))
    return rows.select(
        F.lit(1).alias("project_id"), (F.col("doc_id") * 100000 + F.col("chunk_index")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.concat("source", suffix).alias("document_name"), "chunk_index", "content"
    )


LINE_CHUNKS = r"""
line_parts AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS chunk_index FROM documents),
line_chunks AS (SELECT 1 AS project_id, doc_id * 100000 + chunk_index AS chunk_id, doc_id AS document_id,
       concat(source, CASE doc_id % 4 WHEN 0 THEN '_test_report' WHEN 1 THEN '_datasheet' WHEN 2 THEN '_srs' ELSE '_manual' END) AS document_name, chunk_index,
       CASE WHEN (doc_id + chunk_index) % 9 = 0 THEN concat(line, ' (see REQ-BEN-', lpad(CAST(doc_id % 40 AS VARCHAR), 5, '0'), ')') ELSE line END AS content
  FROM line_parts WHERE trim(line) <> '')"""


def benchmark_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements from whole benchmark texts, behind their codes: project_id, req_id, req_code, text."""
    b = table(spark, sf_dir, "benchmark")
    code = F.concat(F.lit("REQ-BEN-"), F.lpad(F.col("item_id").cast("string"), 5, "0"))
    return b.select(F.lit(1).alias("project_id"), F.col("item_id").alias("req_id"), code.alias("req_code"), F.concat(code, F.lit(": "), "text").alias("text"))


BENCHMARK_REQUIREMENTS = r"""
bench_reqs AS (SELECT 1 AS project_id, item_id AS req_id, concat('REQ-BEN-', lpad(CAST(item_id AS VARCHAR), 5, '0')) AS req_code,
       concat('REQ-BEN-', lpad(CAST(item_id AS VARCHAR), 5, '0'), ': ', text) AS text FROM benchmark)"""


def duck_tokens(text: str) -> str:
    """DuckDB SQL for the tokens of ``text``: runs of ASCII letters, digits, _ and - between word boundaries of any script.

    DuckDB's own boundaries know ASCII alone. So signs outside it that belong to no word
    become blanks, words with a letter outside it become one mark, and runs are cut at the
    marks. A hyphen begins or ends a token only next to such a word.
    """
    plain = rf"regexp_replace(lower({text}), '[^\x00-\x7F\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]', ' ', 'g')"
    marked = rf"regexp_replace({plain}, '[a-zA-Z0-9_]*[^\x00-\x7F](?:[^\x00-\x7F]|[a-zA-Z0-9_])*', 'é', 'g')"
    piece = "CASE WHEN i = 1 THEN ltrim(x, '-') ELSE x END"
    pieces = f"list_transform(string_split(r, 'é'), lambda x, i: CASE WHEN i = len(string_split(r, 'é')) THEN rtrim({piece}, '-') ELSE {piece} END)"
    return f"list_filter(flatten(list_transform(regexp_extract_all({marked}, '[a-zA-Z0-9_é-]+'), lambda r: {pieces})), lambda x: x <> '')"
