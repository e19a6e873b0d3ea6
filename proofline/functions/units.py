"""Unit algebra: normal forms, compatibility and conversion, as expressions over a literal table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed


def unit_table(spark: SparkSession) -> DataFrame:
    """``unit, dimension, factor``: the table as a small DataFrame, for joins."""
    return spark.createDataFrame([(u, d, f) for u, (d, f) in fixed.UNITS.items()], "unit string, dimension string, factor double")


def normalize_unit(c: Column) -> Column:
    """Trimmed and lower-cased; degrees Celsius as c, the micro sign as u; null as ''."""
    c = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    c = F.replace(F.replace(F.replace(c, F.lit("°c"), F.lit("c")), F.lit("degrees c"), F.lit("c")), F.lit("µ"), F.lit("u"))
    return F.coalesce(F.regexp_replace(c, r"^[.()\[\]]+|[.()\[\]]+$", ""), F.lit(""))


def _info(unit: Column) -> Column:
    table = F.create_map(*[x for u, (d, f) in fixed.UNITS.items() for x in (F.lit(u), F.struct(F.lit(d).alias("dimension"), F.lit(f).alias("factor")))])
    return F.try_element_at(table, unit)


def compatible(a: Column, b: Column) -> Column:
    """Equal names, or known units of one dimension; never if either is missing."""
    ua, ub = normalize_unit(a), normalize_unit(b)
    same = (ua == ub) | F.coalesce(_info(ua)["dimension"] == _info(ub)["dimension"], F.lit(False))
    return (ua != "") & (ub != "") & same


def convert(value: Column, a: Column, b: Column) -> Column:
    """``value`` of unit ``a`` in unit ``b``; null where that cannot be done safely."""
    ua, ub = normalize_unit(a), normalize_unit(b)
    ia, ib = _info(ua), _info(ub)
    given = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.when(~given, None).when(ua == ub, value).when(ia["dimension"] == ib["dimension"], value * ia["factor"] / ib["factor"])
