"""Contradictions: of a contract by one document, and between two documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.contracts import on_topic
from ..functions.text import contains_any, fill, first_contained, show_number
from .validators import COMPATIBLE, Check, earliest, in_contract_unit, judged

FINDING = "source_a_doc:string,source_a_quote:string,source_b_doc:string,source_b_quote:string,highlight:string,description:string"


def _finding(a_doc: Column, a_quote: Column, b_doc: Column, b_quote: Column, highlight: Column, description: Column) -> Column:
    return F.struct(a_doc.alias("source_a_doc"), a_quote.alias("source_a_quote"), b_doc.alias("source_b_doc"), b_quote.alias("source_b_quote"), highlight.alias("highlight"), description.alias("description")).cast(f"struct<{FINDING}>")


def contract_check() -> Check:
    """The first claim (specifications aside) that limits or denies the contract."""
    c, low = F.col("contract"), F.lower("document_name")
    open_ = ~contains_any(low, fixed.SPEC_NAMES)
    limits = (
        open_ & c["requirement_type"].isin("numeric_range", "threshold") & (F.col("claim_type") == "numeric_range") & F.expr(COMPATIBLE)
        & (in_contract_unit(F.col("max_value")) < c["max_value"] - fixed.CONTRADICTION_MARGIN) & contains_any(low, fixed.LIMITING_NAMES)
        & on_topic(F.col("terms_contradiction"), F.col("quote"))
    )
    q, need = F.lower("quote"), F.lower(c["raw_text"])
    denied = [(F.when(open_ & contains_any(need, p["topic"]) & contains_any(q, p["topic"]) & contains_any(need, p["positive"]), first_contained(q, p["negative"])), p) for p in fixed.CONFLICT_PAIRS]
    hit = F.struct(
        F.substring(c["raw_text"], 1, 200).alias("raw"), "title", F.col("document_name").alias("name"), "quote", F.col("max_value").alias("shown"), F.coalesce("unit", F.lit("")).alias("unit"),
        in_contract_unit(F.col("max_value")).alias("most"), c["max_value"].alias("bound"), F.coalesce(c["unit"], F.lit("")).alias("need_unit"), F.col("_contract_rule").alias("rule"), F.col("_contract_word").alias("word"),
    )
    layers = [
        {"_contract_limits": F.coalesce(limits, F.lit(False)), **{f"_contract_{k}": word for k, (word, _) in enumerate(denied)}},
        {
            "_contract_rule": F.when(F.col("_contract_limits"), -1).otherwise(F.coalesce(*[F.when(F.col(f"_contract_{k}").isNotNull(), k) for k in range(len(denied))])),
            "_contract_word": F.coalesce(*[F.col(f"_contract_{k}") for k in range(len(denied))]),
        },
    ]
    r, g = F.col("contract_hit"), show_number
    spec = F.lit("Product Specification")
    texts = {f"contract_{x}": F.concat(g(r[x]), F.lit(" "), r["unit" if x == "shown" else "need_unit"]) for x in ("shown", "bound", "most")}
    limited = _finding(
        spec, r["raw"], r["name"], r["quote"], F.trim("contract_shown"), fill(fixed.LIMITED, title=r["title"], name=r["name"], most=F.col("contract_bound"), least=F.col("contract_most"))
    )
    text = F.element_at(F.array(*[F.lit(p["text"]) for p in fixed.CONFLICT_PAIRS]), F.greatest(r["rule"], F.lit(0)) + 1)
    against = _finding(spec, r["raw"], r["name"], r["quote"], r["word"], fill(fixed.DENIED_BY_DOCUMENT, text=text, name=r["name"], word=r["word"]))
    return Check(layers, [earliest("contract_hit", F.when(F.col("_contract_rule").isNotNull(), hit))], F.when(r["rule"] < 0, limited).when(r["rule"] >= 0, against), texts)


def contract_contradictions(rows: DataFrame) -> DataFrame:
    """``req_id, finding``: the first claim (specifications aside) that limits or denies the contract."""
    return judged(rows, contract_check()).withColumnRenamed("outcome", "finding")


def pair_contradictions(claims: DataFrame) -> DataFrame:
    """``req_id, finding``: the first pair of claims of two documents that deny each other.

    Claims are flagged per rule first. Of the positive ones, and of the negative ones, only the
    first claim of each document and only the two first documents can belong to the first
    pair, as an earlier claim would make an earlier pair; so at most four pairs are joined
    for each requirement and rule.
    """
    q = F.lower("quote")
    rules = [F.when(contains_any(q, p["topic"]), F.struct(F.lit(k).alias("rule"), contains_any(q, p["positive"]).alias("pos"), first_contained(q, p["negative"]).alias("word"))) for k, p in enumerate(fixed.CONFLICT_PAIRS)]
    flagged = F.filter(F.array(*rules), lambda r: r["pos"] | r["word"].isNotNull())
    rows = claims.select("req_id", "claim_ord", "document_name", "quote", F.explode(flagged).alias("_r")).select("req_id", "claim_ord", "document_name", "quote", "_r.*")
    both = F.explode(F.array(F.when(F.col("pos"), "pos"), F.when(F.col("word").isNotNull(), "neg"))).alias("side")
    sided = rows.select("req_id", "rule", "claim_ord", "document_name", "quote", "word", both).where("side is not null")
    key = ["req_id", "rule", "side"]
    first = sided.groupBy(*key, "document_name").agg(F.min_by(F.struct("claim_ord", "quote", "word"), "claim_ord").alias("c")).select(*key, "document_name", "c.*")
    early = first.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("claim_ord"))).where("n <= 2")
    pos, neg = early.where("side = 'pos'"), early.where("side = 'neg'")
    pos = pos.select("req_id", "rule", F.col("claim_ord").alias("p_ord"), F.col("document_name").alias("p_doc"), F.col("quote").alias("p_quote"))
    neg = neg.select("req_id", "rule", F.col("claim_ord").alias("n_ord"), F.col("document_name").alias("n_doc"), F.col("quote").alias("n_quote"), "word")
    pairs = pos.join(neg, ["req_id", "rule"]).where("p_doc <> n_doc and p_ord <> n_ord")
    texts = F.element_at(F.array(*[F.lit(p["text"]) for p in fixed.CONFLICT_PAIRS]), F.col("rule") + 1)
    finding = _finding(
        F.col("p_doc"), F.col("p_quote"), F.col("n_doc"), F.col("n_quote"), F.col("word"),
        fill(fixed.DENIED_BY_PAIR, text=texts, name=F.col("n_doc"), word=F.col("word")),
    )
    order = F.struct(F.least("p_ord", "n_ord").alias("i"), F.greatest("p_ord", "n_ord").alias("j"), "rule", (F.col("p_ord") > F.col("n_ord")).alias("turned"))
    return pairs.groupBy("req_id").agg(F.min_by(finding, order).alias("finding"))
