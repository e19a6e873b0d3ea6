"""What an audit run writes, and the read queries over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.tables import numbered, running_code, running_numbers


def findings(assessed: DataFrame, project: str = "project_id", order: str = "req_code") -> DataFrame:
    """A finding for each Partial, Missing or Conflict requirement, coded in requirement order per project."""
    table = F.create_map(*[F.lit(x) for kv in fixed.FINDING_TYPES.items() for x in kv])
    rows = assessed.withColumn("finding_type", F.try_element_at(table, F.col("coverage_status"))).where("finding_type is not null")
    counted = running_numbers(rows, [project], [order], _n=F.lit(True))
    return counted.withColumn("finding_code", running_code("F-", F.col("_n"), 3)).drop("_n")


def updated_requirements(requirements: DataFrame, assessed: DataFrame, links: DataFrame) -> DataFrame:
    """Requirements with the run's coverage, confidence, review state, texts and number of links."""
    n = links.groupBy("req_id").agg(F.count("*").cast("int").alias("sources_count"))
    fresh = ["coverage_status", "confidence", "review_state", "analysis", "recommendation"]
    base = requirements.drop(*fresh, "sources_count")
    return base.join(assessed.select("req_id", *fresh), "req_id", "left").join(n, "req_id", "left").withColumn("sources_count", F.coalesce("sources_count", F.lit(0)))


def run_summary(assessed: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts of a run."""
    counts = [(assessed, "requirements"), (found, "findings"), (links, "links")]
    rows = [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)) for df, name in counts]
    return reduce(DataFrame.unionByName, rows).groupBy().pivot("name", [name for _, name in counts]).agg(F.first("n"))


def project_stats(projects: DataFrame, requirements: DataFrame, documents: DataFrame, chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Counts and coverage percentage of each project: one aggregation for each table."""
    by_status = requirements.groupBy("project_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("coverage_status") == s).alias(s.lower()) for s in fixed.STATUSES]
    )
    n_docs = documents.groupBy("project_id").agg(F.count("*").alias("documents"))
    n_chunks = chunks.join(documents.select("document_id", "project_id"), "document_id").groupBy("project_id").agg(F.count("*").alias("chunks"))
    n_found = found.groupBy("project_id").agg(F.count("*").alias("findings"))
    out = projects.select("project_id")
    for part in (by_status, n_docs, n_chunks, n_found):
        out = out.join(part, "project_id", "left")
    out = out.na.fill(0)
    return out.withColumn("coverage", F.when(F.col("total") > 0, F.bround(100.0 * F.col("supported") / F.col("total"))).otherwise(0.0).cast("int"))


def optional_filters(df: DataFrame, **equal: object) -> DataFrame:
    """``df`` filtered by those of the given columns whose value is not None."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def requirement_list(requirements: DataFrame, links: DataFrame, chunks: DataFrame, documents: DataFrame, **equal: object) -> DataFrame:
    """Requirements by code, each with its evidence (link, chunk, document) as an array of structs."""
    chosen = optional_filters(requirements, **equal)
    rows = (
        links.join(chosen.select("req_id"), "req_id", "left_semi").join(chunks.select("chunk_id", "document_id", "page_number", "content"), "chunk_id").join(documents.select("document_id", "document_name"), "document_id")
    )
    nested = rows.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "document_name", "page_number", "status", "content"))).alias("evidence"))
    empty = F.array().cast(nested.schema["evidence"].dataType)
    return chosen.join(nested, "req_id", "left").withColumn("evidence", F.coalesce("evidence", empty)).orderBy("req_code")


def lookup(df: DataFrame, **key: object) -> DataFrame:
    """The row of a key; empty if there is none."""
    return optional_filters(df, **key)


def finding_list(found: DataFrame, requirements: DataFrame, **equal: object) -> DataFrame:
    """Findings, newest first, with their requirement's title (null without one)."""
    titles = requirements.select("req_id", F.col("title").alias("requirement_title"))
    return optional_filters(found, **equal).join(titles, "req_id", "left").orderBy(F.desc("created_at"), "finding_code")


def search_text(df: DataFrame, query: str | None, *columns: str) -> DataFrame:
    """Rows whose columns, joined by blanks, hold ``query`` in any case."""
    if not query:
        return df
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def requirement_table(requirements: DataFrame, *, tab: str | None = None, document: str | None = None, query: str | None = None, ascending: bool = True) -> DataFrame:
    """The requirement table: tab (a review state or coverage), document and text filters, order by code."""
    out = requirements
    if tab == "Needs review":
        out = out.where(F.col("review_state") == tab)
    elif tab and tab != "All":
        out = out.where(F.col("coverage_status") == tab)
    out = search_text(optional_filters(out, source_document=document), query, "req_code", "title")
    return out.orderBy(F.col("req_code").asc() if ascending else F.col("req_code").desc())


def finding_table(found: DataFrame, *, reviewer: str | None = None, query: str | None = None) -> DataFrame:
    return search_text(optional_filters(found, assigned_to=reviewer), query, "finding_code", "requirement_title").orderBy("finding_code")


def severity_counts(found: DataFrame) -> DataFrame:
    """``severity, n, total``: the four fixed buckets, empty ones with 0."""
    buckets = found.sparkSession.createDataFrame([(s, i) for i, s in enumerate(fixed.SEVERITIES)], "severity string, position int")
    counts = found.groupBy("severity").agg(F.count("*").alias("n"))
    out = F.broadcast(buckets).join(counts, "severity", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("total", F.sum("n").over(Window.partitionBy())).orderBy("position").drop("position")


def reviewers(found: DataFrame) -> DataFrame:
    return found.select("assigned_to").where("assigned_to is not null").distinct()


def coverage_shares(requirements: DataFrame) -> DataFrame:
    """``coverage_status, n, share, percent``: exact share, and half-up whole percent."""
    counts = requirements.groupBy("coverage_status").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", share).withColumn("percent", F.floor(100 * F.col("share") + 0.5))


def trace_edges(requirements: DataFrame, links: DataFrame, chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct typed edges: requirement to document, document to evidence, evidence to finding."""
    held = links.select("req_id", "chunk_id").join(chunks.select("chunk_id", "document_id"), "chunk_id").join(requirements.select("req_id"), "req_id", "left_semi")

    def edges(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
        s, t = kind.split("-")
        return df.select(F.lit(s).alias("source_type"), F.col(a).cast("string").alias("source"), F.lit(t).alias("target_type"), F.col(b).cast("string").alias("target"))

    # a code of one requirement gives no edge twice, once its links are distinct; only codes of several need another look
    linked, codes = held.select("req_id", "chunk_id").distinct(), found.groupBy("finding_code").agg(F.min("req_id").alias("req_id"), F.max("req_id").alias("_last"))
    one = codes.where("req_id = _last").select("req_id", "finding_code")
    several = codes.where("req_id <> _last").select(F.col("finding_code").alias("_code"))
    more = found.select("req_id", "finding_code").join(several, F.col("finding_code").eqNullSafe(F.col("_code")), "left_semi")
    pairs = lambda f: linked.join(f, "req_id").select("chunk_id", "finding_code")
    parts = [
        edges(held.select("req_id", "document_id").distinct(), "req_id", "document_id", "requirement-document"), edges(held.select("document_id", "chunk_id").distinct(), "document_id", "chunk_id", "document-evidence"),
        edges(pairs(one), "chunk_id", "finding_code", "evidence-finding"), edges(pairs(more).distinct(), "chunk_id", "finding_code", "evidence-finding"),
    ]
    return reduce(DataFrame.unionByName, parts)


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("target_type").alias("source_type"), F.col("target").alias("source"), F.col("source_type").alias("target_type"), F.col("source").alias("target"))
    return edges.unionByName(back)


def neighbours(edges: DataFrame, node_type: str, node: str) -> DataFrame:
    """Nodes one edge away, in either direction."""
    here = both_ways(edges).where((F.col("source_type") == node_type) & (F.col("source") == node))
    return here.select(F.col("target_type").alias("node_type"), F.col("target").alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``node_type, node, degree`` of every node that has an edge."""
    return both_ways(edges).groupBy(F.col("source_type").alias("node_type"), F.col("source").alias("node")).agg(F.count("*").alias("degree"))


def visible_edges(edges: DataFrame, types: list[str]) -> DataFrame:
    """Edges whose both ends are of a visible type."""
    return edges.where(F.col("source_type").isin(types) & F.col("target_type").isin(types))


def global_search(kinds: dict[str, tuple[DataFrame, str, str]], query: str) -> DataFrame:
    """``kind, id, label`` of all rows whose id or label holds ``query``; kinds: name -> (table, id, label)."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), F.col(label).alias("label")) for kind, (df, i, label) in kinds.items()]
    return search_text(reduce(DataFrame.unionByName, parts), query, "id", "label")


def report_sections(requirements: DataFrame, found: DataFrame) -> DataFrame:
    """``section, name, n``: counts by coverage, review state, category and finding type."""
    count = lambda df, c, s: df.groupBy(F.coalesce(F.col(c), F.lit("(none)")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(s).alias("section"), "name", "n")
    return reduce(
        DataFrame.unionByName,
        [count(requirements, "coverage_status", "coverage"), count(requirements, "review_state", "review"), count(requirements, "category", "category"), count(found, "finding_type", "finding")],
    )


def numbered_by(df: DataFrame, group: str, order: list[str], prefix: str, width: int, name: str) -> DataFrame:
    """``df`` with running codes over the whole table, groups in order."""
    return numbered(df, group, order, "_n").withColumn(name, running_code(prefix, F.col("_n"), width)).drop("_n")


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))
