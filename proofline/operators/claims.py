"""Typed claims of evidence chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import contains_any, group, number, or_null, requirement_codes, strip
from ..sources.shared import materialize

CLAIM = (
    "claim_type:string,parameter:string,value_num:double,value_str:string,min_value:double,max_value:double,discrete_points:array<double>,unit:string,test_result:string,quote:string"
)
_LIST = f"array<struct<{CLAIM}>>"


def _claim(kind: str, quote: Column, **given: Column) -> Column:
    names = [x.split(":")[0] for x in CLAIM.split(",")]
    given |= {"claim_type": F.lit(kind), "quote": quote}
    return F.struct(*[given.get(n, F.lit(None)).alias(n) for n in names]).cast(f"struct<{CLAIM}>")


def _when(condition: Column, claims: Column) -> Column:
    return F.when(condition, claims).otherwise(F.array().cast(_LIST))


def scope(text: Column, code: Column) -> Column:
    """The part of a chunk about one requirement; null if the chunk names others only."""
    codes = F.transform(requirement_codes(text), F.upper)
    at = F.greatest(F.instr(F.upper(text), F.upper(code)), F.lit(1)) - 1
    rest = F.substring(text, at + F.length(code) + 1, F.length(text))
    following = F.regexp_instr(rest, F.lit(fixed.CODE))
    start = F.greatest(F.lit(0), at - 50)
    end = F.when(following > 0, at + F.length(code) + following - 1).otherwise(F.least(F.length(text), at + 600))
    cut = F.substring(text, start + 1, end - start)
    return F.when((F.coalesce(code, F.lit("")) == "") | (F.size(codes) == 0), text).when(F.array_contains(codes, F.upper(code)), cut)


def matches(text: Column, pattern: str) -> Column:
    """All matches with their offsets, as structs (m, start, end), end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, m: Column) -> Column:
        at = F.call_function("locate", m, text, acc["at"])
        hit = F.struct(m.alias("m"), (at - 1).alias("start"), (at - 1 + F.length(m)).alias("end"))
        return F.struct((at + F.length(m)).alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<m:string,start:int,end:int>>").alias("out"))
    return F.aggregate(found, start, step, lambda acc: acc["out"])


def _around(text: Column, hit: Column, margin: int) -> Column:
    start = F.greatest(F.lit(0), hit["start"] - margin)
    return F.substring(text, start + 1, F.least(F.length(text), hit["end"] + margin) - start)


KINDS = ("verdict", "range", "point", "protection", "semantic")


def claims_of(text: Column, scoped: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """The claims of one chunk in order: verdict, ranges, points by unit, protection, fallback.

    Quotes of ranges are cut from the whole text at offsets of the scoped part. ``kinds``
    names those wanted; the work for others is left out. The fallback needs all of them.
    """
    low = F.lower(scoped)
    word = group(scoped, fixed.VERDICT, 1)
    missing, running = contains_any(low, fixed.MISSING_MARKERS), F.contains(low, F.lit("in progress"))
    said = F.upper(word)
    verdict = (
        F.when(missing, "MISSING").when(running, "IN PROGRESS").when(said.isin("PASSED", "COMPLETED"), "PASS").when(said == "FAILED", "FAIL").otherwise(said)
    )
    verdicts = _when(word.isNotNull() | missing | running, F.array(_claim("test_verdict", scoped, test_result=verdict)))

    ranges = F.transform(
        matches(scoped, fixed.RANGE),
        lambda h: _claim(
            "numeric_range", _around(text, h, 40), min_value=number(group(h["m"], fixed.RANGE, 1)), max_value=number(group(h["m"], fixed.RANGE, 3)),
            unit=or_null(strip(F.coalesce(group(h["m"], fixed.RANGE, 4), group(h["m"], fixed.RANGE, 2), F.lit("")))),
        ),
    )

    points = F.transform(
        matches(scoped, fixed.NUMBER_UNIT),
        lambda h: F.struct(number(group(h["m"], fixed.NUMBER_UNIT, 1)).alias("v"), strip(F.regexp_extract(h["m"], fixed.NUMBER_UNIT, 2)).alias("u"), _around(scoped, h, 60).alias("q")),
    )
    points = F.filter(points, lambda p: (p["u"] != "") & (F.length(p["u"]) <= 8) & ~p["u"].rlike(r"(?U)\d"))
    tested = contains_any(low, fixed.TEST_WORDS)

    def by_unit(p: Column) -> Column:
        def one(u: Column) -> Column:
            own = F.filter(p, lambda x: x["u"] == u)
            sweep = _claim("discrete_sweep", F.array_join(own["q"], " "), discrete_points=own["v"], unit=u)
            single = _claim("threshold", F.get(own, 0)["q"], value_num=F.get(own, 0)["v"], unit=u)
            return F.when(tested & (F.size(own) >= 2), sweep).when(F.size(own) == 1, single)

        return F.filter(F.transform(F.array_distinct(p["u"]), one), lambda c: c.isNotNull())

    groups = F.flatten(F.transform(F.array(points), by_unit)).cast(_LIST)
    ip = group(scoped, fixed.PROTECTION, 1)
    passed = F.contains(low, F.lit("pass")) | F.contains(low, F.lit("zero water"))
    protection = _when(
        ip.isNotNull(),
        F.array(_claim("boolean", scoped, parameter=F.lit("ingress_protection"), value_str=F.upper(ip), unit=F.lit("IP"), test_result=F.when(passed, "PASS").otherwise("UNKNOWN"))),
    )
    made = {"verdict": verdicts, "range": ranges.cast(_LIST), "point": groups, "protection": protection}
    if "semantic" not in kinds:
        return F.concat(*[made[k] for k in KINDS if k in kinds])
    typed = F.concat(*made.values())
    return F.transform(F.array(typed), lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(_claim("semantic", text))))[0]


OFTEN, KNOWN, KNOWN_CHARS = 8, 10_000, 1_000  # a text of that many rows is read once; at most so many texts, none longer


def known_claims(contents: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``known, found``: the claims of the most frequent ``content`` values.

    Only texts that name no requirement, as their claims are the same for all. Their number and
    length are bounded, so they can be broadcast; any other text is read row by row.
    """
    text = F.coalesce("content", F.lit(""))
    counts = contents.select(text.alias("known")).where(F.length("known") <= KNOWN_CHARS).groupBy("known").agg(F.count("*").alias("n"))
    often = counts.where((F.col("n") >= OFTEN) & ~F.col("known").rlike(fixed.CODE)).orderBy(F.desc("n"), "known").limit(KNOWN).select("known")
    return materialize(often.select("known", claims_of(F.col("known"), F.col("known"), kinds).alias("found")), "known-claims")


def extract_claims(candidates: DataFrame, kinds: tuple[str, ...] = KINDS, contents: DataFrame | None = None) -> DataFrame:
    """Claims of each requirement's candidates, in order.

    ``candidates``: req_id, req_code, rank, chunk_id, document_name, page_number, content.
    Adds ``claim_ord``, which orders all claims of a requirement: candidate rank, then
    position in the chunk (among those of ``kinds``). ``contents``: where to look for frequent
    texts, if a plainer table than ``candidates`` has them; it decides nothing but the time.
    """
    text = F.coalesce("content", F.lit(""))
    known = known_claims(candidates if contents is None else contents, kinds)
    read = F.transform(F.array(F.struct(text.alias("t"), scope(text, F.col("req_code")).alias("s"))), lambda x: F.when(x["s"].isNotNull(), claims_of(x["t"], x["s"], kinds)))[0]
    rows = candidates.withColumn("_text", text).join(F.broadcast(known), F.col("_text") == F.col("known"), "left").withColumn("_claims", F.coalesce("found", read))
    rows = rows.select("req_id", "rank", "chunk_id", "document_name", "page_number", F.posexplode("_claims").alias("_pos", "c"))
    return rows.select("req_id", (F.col("rank") * F.lit(1_000_000).cast("long") + F.col("_pos")).alias("claim_ord"), "chunk_id", "document_name", "page_number", "c.*")
