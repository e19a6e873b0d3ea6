"""Text scalars and line-based requirement extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

PARAMETERS = "array<struct<name:string,value:string,min_val:double,max_val:double,unit:string>>"
REQUIREMENT = f"req_code:string,title:string,description:string,category:string,severity:string,parameters:{PARAMETERS}"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_null(c: Column) -> Column:
    """Null in place of the empty string."""
    return F.when(c != "", c)


def group(c: Column, pattern: str, k: int) -> Column:
    """Group ``k`` of the first match; null if there is none or the group is empty."""
    return or_null(F.regexp_extract(c, pattern, k))


def number(c: Column) -> Column:
    return c.try_cast("double")


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether any of ``words`` is a substring (no pattern: cheap, and safe for any word)."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def first_contained(c: Column, words: list[str]) -> Column:
    """The first of ``words`` that is a substring, else null."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words])


def tokenize(c: Column) -> Column:
    """All lower-cased tokens, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(fixed.TOKEN), F.lit(0))


def infer_category(c: Column) -> Column:
    """The first category with a keyword in the text; else Documentation."""
    low, out = F.lower(c), None
    for name, words in fixed.CATEGORY_KEYWORDS.items():
        hit = contains_any(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Documentation")


def severity_of(category: Column) -> Column:
    return F.when(category.isin("Safety", "Electrical"), "High").otherwise("Medium")


def extract_parameters(c: Column) -> Column:
    """Every numeric range, then the first ingress-protection code, as structs."""
    span = lambda m: F.struct(
        F.lit("operating_range").alias("name"), m.alias("value"), number(group(m, fixed.PLAIN_RANGE, 1)).alias("min_val"), number(group(m, fixed.PLAIN_RANGE, 3)).alias("max_val"),
        or_null(strip(F.coalesce(group(m, fixed.PLAIN_RANGE, 4), group(m, fixed.PLAIN_RANGE, 2), F.lit("")))).alias("unit"),
    )
    ranges = F.transform(F.regexp_extract_all(c, F.lit(fixed.PLAIN_RANGE), F.lit(0)), span).cast(PARAMETERS)
    ip = group(c, r"(?iU)IP\d{2}", 0)
    one = F.array(F.struct(F.lit("ingress_protection").alias("name"), F.upper(ip).alias("value"), F.lit(None).cast("double").alias("min_val"), F.lit(None).cast("double").alias("max_val"), F.lit("IP").alias("unit"))).cast(PARAMETERS)
    return F.concat(ranges, F.when(ip.isNotNull(), one).otherwise(F.array().cast(PARAMETERS)))


def normalize_code(c: Column) -> Column:
    """Trimmed, upper-cased, runs of blanks and underscores as one hyphen; null as ''."""
    return F.coalesce(F.regexp_replace(F.upper(strip(c)), r"(?U)[_\s]+", "-"), F.lit(""))


def normalize_status(c: Column) -> Column:
    """The standard name of a status alias; anything else, and null, is Missing."""
    table = F.create_map(*[F.lit(x) for kv in fixed.STATUS_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(strip(c))), F.lit("Missing"))


def requirement_codes(c: Column) -> Column:
    """All requirement codes in the text, in order."""
    return F.regexp_extract_all(c, F.lit(fixed.CODE), F.lit(1))


def first_code(c: Column) -> Column:
    return group(c, fixed.CODE, 1)


def lines(c: Column) -> Column:
    return F.split(c, fixed.LINE_BREAKS)


def extract_requirements(c: Column) -> Column:
    """Requirements of a text, line by line, as an array of structs.

    A line with a code starts a requirement. A line with a modal phrase completes the
    previous one while that is bare or short, or else starts one with a running code.
    One fold per text; nothing leaves the row.
    """
    kept = F.filter(F.transform(lines(c), strip), lambda x: F.length(x) >= 15)
    last = lambda acc: F.element_at(acc["reqs"], -1)

    def made(code: Column, title: Column, whole: Column, basis: Column) -> Column:
        category = infer_category(basis)
        return F.struct(code.alias("req_code"), title.alias("title"), whole.alias("description"), category.alias("category"), severity_of(category).alias("severity"), extract_parameters(basis).alias("parameters"))

    def step(acc: Column, line: Column) -> Column:
        code = group(line, fixed.LINE_CODE, 1)
        title = F.coalesce(or_null(strip(F.regexp_extract(line, fixed.LINE_CODE, 2))), line)
        explicit = made(F.replace(F.upper(code), F.lit("_"), F.lit("-")), title, line, title)
        running = made(F.format_string("REQ-%03d", acc["counter"]), F.substring(line, 1, 120), line, line)
        prev = F.try_element_at(acc["reqs"], F.lit(-1))
        open_ = F.coalesce((prev["description"] == prev["title"]) | (F.length(prev["description"]) < 80), F.lit(False))
        merged = F.struct(
            prev["req_code"].alias("req_code"), prev["title"].alias("title"), F.concat(prev["title"], F.lit(". "), line).alias("description"), prev["category"].alias("category"), prev["severity"].alias("severity"),
            F.when(F.size(prev["parameters"]) > 0, prev["parameters"]).otherwise(extract_parameters(line)).alias("parameters"),
        )
        put = lambda reqs, counter: F.struct(reqs.alias("reqs"), counter.alias("counter"))
        modal = contains_any(F.lower(line), fixed.MODALS)
        return (
            F.when(code.isNotNull(), put(F.concat(acc["reqs"], F.array(explicit)), acc["counter"]))
            .when(modal & open_, put(F.concat(F.slice(acc["reqs"], 1, F.greatest(F.size(acc["reqs"]) - 1, F.lit(0))), F.array(merged)), acc["counter"]))
            .when(modal, put(F.concat(acc["reqs"], F.array(running)), acc["counter"] + 1))
            .otherwise(acc)
        )

    start = F.struct(F.array().cast(f"array<struct<{REQUIREMENT}>>").alias("reqs"), F.lit(1).alias("counter"))
    return F.aggregate(kept, start, step, lambda acc: acc["reqs"])


def parse_response(c: Column) -> Column:
    """A model's raw answer as a struct of requirements: fences off, JSON parsed, bad JSON null."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-zA-Z]*[ \t]*\r?\n?", ""), r"\r?\n?```$", ""))
    parsed = F.from_json(bare, f"requirements array<struct<{REQUIREMENT}>>")
    return F.when(parsed["requirements"].isNotNull(), parsed)


def model_or_rules(answer: Column, rules: Column) -> Column:
    """The model's requirements if it found any; else those of the rules."""
    return F.when(F.coalesce(F.size(answer["requirements"]), F.lit(0)) > 0, answer["requirements"]).otherwise(rules)


def fill(template: str, **values: Column) -> Column:
    """A template with its names in braces replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(parts) if k % 2 or x])


def show_number(c: Column) -> Column:
    """A number in its shortest form of at most six digits (``800``, ``0.15``)."""
    fixed_form = F.format_string("%.6g", c.cast("double"))
    plain = F.when(F.contains(fixed_form, F.lit("e")), fixed_form).otherwise(F.regexp_replace(F.regexp_replace(fixed_form, r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    return F.when(c.isNotNull(), F.when(c == 0, F.lit("0")).otherwise(plain))
