"""The stand-alone range check: a requirement's first range against joined evidence texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import group, number, show_number, strip


def range_coverage(requirement: Column, evidence: Column) -> Column:
    """Struct (status, is_valid, highlight) of a requirement text and an array of evidence texts."""
    text = F.array_join(evidence, " ")
    lo, hi = number(group(requirement, fixed.PLAIN_RANGE, 1)), number(group(requirement, fixed.PLAIN_RANGE, 3))
    unit = strip(F.coalesce(group(requirement, fixed.PLAIN_RANGE, 4), group(requirement, fixed.PLAIN_RANGE, 2), F.lit("")))
    points = F.filter(F.transform(F.regexp_extract_all(text, F.lit(fixed.TESTED_NUMBER), F.lit(1)), number), lambda x: x.isNotNull())
    a, b = number(group(text, fixed.TESTED_RANGE, 1)), number(group(text, fixed.TESTED_RANGE, 3))
    other = strip(F.coalesce(group(text, fixed.TESTED_RANGE, 4), group(text, fixed.TESTED_RANGE, 2), unit))
    warm = F.contains(unit, F.lit("°")) | F.contains(F.lower(unit), F.lit("c"))
    tip = F.when(warm, F.concat(F.lit("+"), show_number(b), F.lit("°C"))).otherwise(strip(F.concat(show_number(b), F.lit(" "), other)))
    result = lambda status, valid, highlight=F.lit(None): F.struct(F.lit(status).alias("status"), F.lit(valid).alias("is_valid"), highlight.cast("string").alias("highlight"))
    return (
        F.when(lo.isNull(), result("Unknown", True))
        .when((F.array_min(points) <= lo) & (F.array_max(points) >= hi), result("Supported", True))
        .when(a.isNotNull() & ((b < hi) | (a > lo)), result("Partial", False, tip))
        .otherwise(result("Supported", True))
    )


def check_ranges(rows: DataFrame, requirement: str = "text", evidence: str = "evidence") -> DataFrame:
    """``rows`` with the check's status, is_valid and highlight."""
    return rows.withColumn("_c", range_coverage(F.col(requirement), F.col(evidence))).select("*", "_c.*").drop("_c")
