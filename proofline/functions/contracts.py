"""Typed contracts of requirement texts: one struct by ordered rules, first fit wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import contains_any, group, number, or_null, strip

CONTRACT = (
    "requirement_type:string,parameter:string,operator:string,expected_value:string,min_value:double,max_value:double,tolerance:double,unit:string,raw_text:string"
)


def parse_contract(title: Column, description: Column) -> Column:
    """The contract of ``title. description``.

    Rules in order: ingress protection, numeric range, duration limit, upper limit, lower
    limit, flag; else semantic.
    """
    whole = strip(F.concat(title, F.lit(". "), F.coalesce(description, F.lit(""))))
    return F.transform(F.array(whole), _contract)[0]  # a lambda: evaluated once, whatever fields are read


def _contract(text: Column) -> Column:
    low = F.lower(text)
    none = F.lit(None)

    def contract(kind: str, *, parameter=none, operator=none, expected=none, least=none, most=none, tolerance=none, unit=none) -> Column:
        return F.struct(
            F.lit(kind).alias("requirement_type"), parameter.alias("parameter"), operator.alias("operator"), expected.alias("expected_value"), least.alias("min_value"), most.alias("max_value"),
            tolerance.alias("tolerance"), unit.alias("unit"), text.alias("raw_text"),
        ).cast(f"struct<{CONTRACT}>")

    ip = group(text, fixed.PROTECTION, 1)
    span = group(text, fixed.RANGE, 0)
    most, most_unit = number(group(text, fixed.AT_MOST, 1)), F.coalesce(group(text, fixed.AT_MOST, 2), F.lit(""))
    least, least_unit = number(group(text, fixed.AT_LEAST, 1)), F.coalesce(group(text, fixed.AT_LEAST, 2), F.lit(""))
    span_unit = or_null(strip(F.coalesce(group(text, fixed.RANGE, 4), group(text, fixed.RANGE, 2), F.lit(""))))
    return (
        F.when(
            ip.isNotNull() & contains_any(low, ["ingress", "enclosure", "protection"]),
            contract("enumeration", parameter=F.lit("ingress_protection"), operator=F.lit("=="), expected=F.upper(ip), unit=F.lit("IP")),
        )
        .when(
            span.isNotNull(),
            contract("numeric_range", operator=F.lit("between"), least=number(group(text, fixed.RANGE, 1)), most=number(group(text, fixed.RANGE, 3)), tolerance=number(group(text, fixed.TOLERANCE, 1)), unit=span_unit),
        )
        .when(
            contains_any(low, fixed.TIMING_WORDS) & most.isNotNull() & F.lower(most_unit).isin(fixed.DURATION_UNITS),
            contract("duration", operator=F.lit("<="), most=most, unit=most_unit),
        )
        .when(most.isNotNull(), contract("threshold", operator=F.lit("<="), most=most, unit=or_null(most_unit)))
        .when(least.isNotNull(), contract("threshold", operator=F.lit(">="), least=least, unit=or_null(least_unit)))
        .when(contains_any(low, fixed.FLAG_WORDS), contract("boolean", operator=F.lit("=="), expected=F.lit("true")))
        .otherwise(contract("semantic"))
    )


def topic_terms(code: Column, title: Column, stop_list: str) -> Column:
    """Lower-cased words over three characters of code and title, without a stop list."""
    words = F.regexp_extract_all(F.concat(code, F.lit(" "), title), F.lit(fixed.WORD), F.lit(0))
    stop = F.array(*[F.lit(w) for w in fixed.TOPIC_STOP_WORDS[stop_list]])
    return F.filter(F.transform(words, F.lower), lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w))


def on_topic(terms: Column, quote: Column) -> Column:
    """Whether any term is in the quote; no terms: any quote is on topic."""
    low = F.lower(quote)
    return (F.size(terms) == 0) | F.exists(terms, lambda w: F.contains(low, w))
