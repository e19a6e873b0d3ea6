"""License scans with ordered signature rules, in SQL expressions only.

A text is read as words (A-Z lower-cased, runs of ASCII digits and letters and of all
non-ASCII characters), written one after another as `` word ``. A rule is a regular
expression over that form, with a keyword that must occur before it is tried, a label
and a priority. Most rules are clauses written by hand (:mod:`.license_clauses`): grants,
conditions, disclaimers, notices. A table of license names in a few phrase shapes and some
headers come beside them; see :func:`rules`. Each keyword is looked for once in a text, and
only its own rules are tried then.

All detections of a text are ordered by position. A detection inside another one of the
same or a higher priority is suppressed (of equal ones the first in rule order stays).
Everything is row by row: no shuffle, no Python on the executors.

Edge cases: null and empty texts have no words and no detections (counts 0, positions
null, labels empty, score 0); repeated rows get equal answers; further columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_clauses import clauses

#: label, name as words ("a/b": either, "a?": may lack, "#": a number), SPDX words, address words
LICENSES = [
    ("apache-2.0", "apache license/licence version? 2 0?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache-1.1", "apache software? license/licence version? 1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache", "apache software? license/licence", "apache", "apache org licenses"),
    ("mit", "mit license/licence", "mit", "opensource org licenses mit"),
    ("mit-0", "mit no attribution license/licence?", "mit 0", "opensource org licenses mit 0"),
    ("isc", "isc license/licence", "isc", "opensource org licenses isc"),
    ("bsd-2-clause", "bsd 2 clause license/licence?", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause license/licence?", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause license/licence?", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("0bsd", "zero clause bsd license/licence?", "0bsd", "opensource org licenses 0bsd"),
    ("bsd", "bsd style? license/licence", "bsd", "opensource org licenses bsd license"),
    ("gpl-1", "gnu general public license/licence v/version 1 0?", "gpl 1 0", "gnu org licenses gpl 1 0"),
    ("gpl-2", "gnu general public license/licence v/version 2 0?", "gpl 2 0", "gnu org licenses gpl 2 0"),
    ("gpl-3", "gnu general public license/licence v/version 3 0?", "gpl 3 0", "gnu org licenses gpl 3 0"),
    ("gpl-2", "gplv2", "gpl 2 0 only", "gnu org licenses old licenses gpl 2 0"),
    ("gpl-3", "gplv3", "gpl 3 0 only", "gnu org licenses gpl html"),
    ("gpl-2+", "gnu gpl v/version? 2 or later", "gpl 2 0 or later", "gnu org licenses gpl 2 0 or later"),
    ("gpl-3+", "gnu gpl v/version? 3 or later", "gpl 3 0 or later", "gnu org licenses gpl 3 0 or later"),
    ("lgpl-2.1", "gnu lesser general public license/licence v/version 2 1", "lgpl 2 1", "gnu org licenses lgpl 2 1"),
    ("lgpl-3", "gnu lesser general public license/licence v/version 3 0?", "lgpl 3 0", "gnu org licenses lgpl 3 0"),
    ("lgpl", "lesser/library general public license/licence", "lgpl", "gnu org licenses lgpl"),
    ("agpl-3", "gnu affero general public license/licence v/version 3 0?", "agpl 3 0", "gnu org licenses agpl 3 0"),
    ("agpl", "affero general public license/licence", "agpl", "gnu org licenses agpl"),
    ("gfdl-1.3", "gnu free documentation license/licence v/version 1 3", "gfdl 1 3", "gnu org licenses fdl 1 3"),
    ("gfdl", "gnu? free documentation license/licence", "gfdl", "gnu org licenses fdl"),
    ("mpl-1.1", "mozilla public license/licence v/version? 1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla public license/licence v/version? 2 0", "mpl 2 0", "mozilla org mpl 2 0"),
    ("mpl", "mozilla public license/licence", "mpl", "mozilla org mpl"),
    ("epl-1.0", "eclipse public license/licence v/version? 1 0", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse public license/licence v/version? 2 0", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl", "common development and distribution license/licence", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cpl", "common public license/licence", "cpl 1 0", "opensource org licenses cpl 1 0"),
    ("eupl", "european union public license/licence", "eupl 1 2", "joinup ec europa eu eupl"),
    ("artistic-2.0", "artistic license/licence v/version? 2 0", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("artistic", "artistic license/licence", "artistic 1 0", "opensource org licenses artistic license"),
    ("bsl-1.0", "boost software license/licence", "bsl 1 0", "boost org license 1 0"),
    ("zlib", "zlib license/licence", "zlib", "opensource org licenses zlib"),
    ("unlicense", "the unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "do what the fuck you want to public license/licence", "wtfpl", "wtfpl net"),
    ("cc0", "cc0", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creative commons attribution", "cc by", "creativecommons org licenses by"),
    ("cc-by-sa", "creative commons attribution share/sharealike alike?", "cc by sa", "creativecommons org licenses by sa"),
    ("cc-by-nc", "creative commons attribution non/noncommercial commercial?", "cc by nc", "creativecommons org licenses by nc"),
    ("cc-by-nd", "creative commons attribution no/noderivs/noderivatives derivatives/derivs?", "cc by nd", "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike", "cc by nc sa", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivs/noderivatives", "cc by nc nd", "creativecommons org licenses by nc nd"),
    ("creative-commons", "creative commons license/licence", "cc", "creativecommons org licenses"),
    ("odbl", "open database license/licence", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by", "open data commons attribution license/licence", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl", "public domain dedication and license/licence", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("ogl-uk", "open government license/licence", "ogl uk 3 0", "nationalarchives gov uk doc open government licence"),
    ("ofl-1.1", "sil open font license/licence", "ofl 1 1", "scripts sil org ofl"),
    ("psf-2.0", "python software foundation license/licence", "psf 2 0", "docs python org license"),
    ("php-3.01", "php license/licence", "php 3 01", "php net license"),
    ("postgresql", "postgresql license/licence", "postgresql", "opensource org licenses postgresql"),
    ("openssl", "openssl license/licence", "openssl", "openssl org source license"),
    ("ms-pl", "microsoft public license/licence", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft reciprocal license/licence", "ms rl", "opensource org licenses ms rl"),
    ("bigscience-rail", "responsible ai license/licence", "bigscience rail", "huggingface co spaces bigscience license"),
    ("busl-1.1", "business source license/licence", "busl 1 1", "mariadb com bsl11"),
    ("sspl-1.0", "server side public license/licence", "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic license/licence", "elastic 2 0", "elastic co licensing elastic license"),
    ("ncsa", "university of illinois ncsa open source license/licence", "ncsa", "opensource org licenses ncsa"),
    ("afl-3.0", "academic free license/licence", "afl 3 0", "opensource org licenses afl 3 0"),
    ("osl-3.0", "open software license/licence", "osl 3 0", "opensource org licenses osl 3 0"),
    ("upl-1.0", "universal permissive license/licence", "upl 1 0", "opensource org licenses upl"),
]

#: label, wording, priority: headers and notices that name no license table entry
HEADERS = [
    ("apache-2.0", "you may not use this file except in compliance with the license", 60),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 60),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 60),
    ("bsd", "redistribution and use in source and binary forms", 60),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors", 60),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", 60),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license", 65),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", 60),
    ("unlicense", "this is free and unencumbered software released into the public domain", 60),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 65),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", 60),
    ("public-domain", "released/dedicated into/to the public domain", 40),
    ("public-domain", "public domain license/licence", 30),
    ("proprietary", "proprietary and confidential license/rights", 40),
    ("proprietary", "license agreement", 25),
    ("no-warranty", "license without warranty", 25),
    ("copyright", "copyright c? #", 30),
    ("copyright", "copyright by/c/notice", 25),
    ("reserved", "some rights reserved", 30),
    ("reserved", "no rights reserved", 30),
    ("unknown-license", "licensed/released/distributed/published under the? license/licence", 20),
    ("unknown-license", "licensed under", 15),
]

#: The fixed base phrases: label, words.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Most rules hold one of these stems.
STEMS = ("licen", "copyright", "rights", "spdx", "permission", "redistribut", "public", "damages", "warrant", "liab", "patent", "trademark", "software")


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    wording: str
    pattern: str
    gate: str
    priority: int
    base: bool = False


def _pattern(wording: str) -> str:
    """The regular expression of a wording over words written as `` word ``."""
    out = []
    for token in wording.split():
        lacking = token.endswith("?")
        either = [re.escape(x).replace("\\#", "[0-9]+") if x != "#" else "[0-9]+" for x in token.rstrip("?").split("/")]
        one = f" {either[0]} " if len(either) == 1 else f" (?:{'|'.join(either)}) "
        out.append(f"(?:{one})?" if lacking else one)
    return "".join(out)


def _gate(wording: str) -> str:
    """The longest word that every match holds."""
    sure = [x for x in wording.split() if not x.endswith("?") and "/" not in x and "#" not in x]
    if not sure:
        stem = wording.split()[0].split("/")
        return " " + (stem[0] if len(stem) == 1 else stem[0][:5])
    return f" {max(sure, key=len)} "


def rules() -> list[Rule]:
    """All rules in order: base phrases, then each license in each phrase shape, then headers."""
    made: list[tuple[str, str, int, bool]] = [(label, words, 10, True) for label, words in BASE]
    for label, name, spdx, address in LICENSES:
        made.append((label, f"spdx license identifier {spdx}", 90 + len(spdx.split()), False))
        made.append((label, f"{address}", 80, False))
        made.append((label, f"licensed/released/distributed/available/published/provided under the? terms? of? the? {name} version? #? #?", 70, False))
        shown = name if re.search("licen|gpl|cc0", name) else f"{name} license/licence"
        made.append((label, f"{shown} #? #?", 50, False))
        if spdx.startswith("cc "):
            made.append((label, f"{spdx} #? #?", 45 + len(spdx.split()), False))
    made += [(label, words, priority, False) for label, words, priority in [*HEADERS, *clauses()]]
    kept, seen = [], set()
    for label, words, priority, base in made:
        if (words, base) not in seen:
            seen.add((words, base))
            kept.append(Rule(len(kept), label, words, _pattern(words), _gate(words), priority, base))
    return kept


def anchors() -> list[str]:
    """The stems, and the keywords of the rules that need not hold one; a text with none of them is not scanned."""
    found = list(STEMS)
    for r in RULES:
        sure = [x.split("/") for x in r.wording.split() if not x.endswith("?")]
        if not any(all(a in x for x in either) for either in sure for a in found):
            found.append(r.gate.strip())
    return found


RULES = rules()
ANCHORS = anchors()
LEVELS = sorted({r.priority for r in RULES})
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(c: Column) -> Column:
    """How many words a stretch of `` word `` holds."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("int")


def _matches(s: Column, pattern: Column) -> Column:
    """All matches of one rule as structs (start and end in words)."""
    hits = F.regexp_extract_all(s, pattern, F.lit(0))
    gaps = F.split(s, pattern)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda acc, i: F.struct(
        (acc["at"] + _words(F.get(gaps, i)) + _words(F.get(hits, i))).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + _words(F.get(gaps, i))).alias("start"), (acc["at"] + _words(F.get(gaps, i)) + _words(F.get(hits, i))).alias("end")))).alias("out"),
    )
    return F.when(
        F.regexp_like(s, pattern),
        F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"]),
    ).otherwise(empty)


def detections(s: Column) -> Column:
    """All detections in the word form ``s``, ordered by start, longest first, priority, rule."""
    by_gate: dict[str, list[Rule]] = {}
    for r in RULES:
        by_gate.setdefault(r.gate, []).append(r)
    rule = lambda r: F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.number).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"))
    table = F.array(*[F.struct(F.lit(gate).alias("gate"), F.array(*[rule(r) for r in own]).alias("rules")) for gate, own in by_gate.items()])
    tried = F.flatten(F.transform(F.filter(table, lambda g: F.contains(s, g["gate"])), lambda g: g["rules"]))
    found = F.transform(
        tried,
        lambda r: F.transform(
            _matches(s, r["pattern"]),
            lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("_end"), (-r["priority"]).alias("_priority"), r["rule"].alias("rule"), d["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label")),
        ),
    )
    return F.array_sort(F.flatten(found))


def suppressed(found: Column) -> Column:
    """``found`` without detections that lie inside one of the same or a higher priority."""
    kind = "array<struct<start:int,_end:int,_priority:int,rule:int,end:int,priority:int,label:string>>"
    reach = F.array(*[F.struct(F.lit(p).alias("level"), F.lit(-1).alias("end")) for p in LEVELS])
    inside = lambda acc, d: F.exists(acc["reach"], lambda x: (x["level"] >= d["priority"]) & (x["end"] >= d["end"]))
    return F.aggregate(
        found,
        F.struct(reach.alias("reach"), F.array().cast(kind).alias("kept")),
        lambda acc, d: F.struct(
            F.transform(acc["reach"], lambda x: F.struct(x["level"].alias("level"), F.when(x["level"] == d["priority"], F.greatest(x["end"], d["end"])).otherwise(x["end"]).alias("end"))).alias("reach"),
            F.when(inside(acc, d), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"),
        ),
        lambda acc: acc["kept"],
    )


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, found, kept``: detections (start and end in words, rule, label, priority)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    low = F.lower("text")
    gate = F.lit(False)
    for anchor in ANCHORS:
        gate = gate | F.contains(low, F.lit(anchor))
    plain = F.trim(F.regexp_replace(F.translate("text", _UPPER, _LOWER), NOT_WORD, "  "))
    form = F.when(gate, F.when(plain == "", "").otherwise(F.concat(F.lit(" "), plain, F.lit(" "))))
    n = F.regexp_count("text", F.lit(WORD)).cast("long")
    rows = rows.select("doc_id", n.alias("n_words"), form.alias("s"))
    rows = rows.select("doc_id", "n_words", F.when(F.col("s").isNotNull(), detections(F.col("s"))).alias("found"))
    return rows.select("doc_id", "n_words", "found", F.when(F.size("found") > 0, suppressed(F.col("found"))).alias("kept"))


def summary(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("found", lambda d: d["rule"] < len(BASE))
    rows = scan(docs).select("doc_id", "n_words", base.alias("base"), "kept")
    labels = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    ours = F.concat(F.coalesce(F.col("base.label"), F.array().cast("array<string>")), F.coalesce(F.col("kept.label"), F.array().cast("array<string>")))
    return rows.select(
        "doc_id", "n_words",
        F.coalesce(F.greatest(F.size("base"), F.lit(0)), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"), F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(labels(F.col("base.label")), ",").alias("base_labels"), F.array_join(labels(ours), ",").alias("labels"),
        (F.least(F.coalesce(F.array_max("kept.priority"), F.lit(0)), F.lit(100)) / 100.0).cast("double").alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for :func:`summary` over the view ``documents``."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({r.number}, {quote(r.pattern)}, {quote(r.gate)}, {quote(r.label)}, {r.priority})" for r in RULES)
    nb = len(BASE)
    return f"""
WITH rules(rule, pattern, gate, label, priority) AS (VALUES {table}),
t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
n AS (SELECT rid, doc_id, len(w) AS n_words, array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') AS s FROM t),
h AS (SELECT rid, rule, label, priority, regexp_extract_all(s, pattern) AS hits, regexp_split_to_array(s, pattern) AS gaps
      FROM n JOIN rules ON contains(s, gate) AND regexp_matches(s, pattern)),
u AS (SELECT rid, rule, label, priority, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM h),
d AS (SELECT rid, rule, label, priority,
        CAST(list_sum(list_transform(gaps[1:i], lambda x: (length(x) - length(replace(x, ' ', ''))) / 2)) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: (length(x) - length(replace(x, ' ', ''))) / 2)), 0) AS BIGINT) AS a,
        CAST((length(hits[i]) - length(replace(hits[i], ' ', ''))) / 2 AS BIGINT) AS k FROM u),
e AS (SELECT rid, rule, label, priority, a, a + k AS z FROM d),
kept AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.rid = e.rid AND f.a <= e.a AND f.z >= e.z AND f.priority >= e.priority
        AND (f.a < e.a OR f.z > e.z OR f.priority > e.priority OR f.rule < e.rule))),
b AS (SELECT rid, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM e WHERE rule < {nb} GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM e WHERE rule < {nb} UNION ALL SELECT rid, label FROM kept) GROUP BY rid),
p AS (SELECT rid, least(max(priority), 100) / 100.0 AS score FROM kept GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM n LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN p USING (rid)"""
