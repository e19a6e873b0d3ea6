"""Registered audit queries take all of their input: brute force on small tables."""

import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from proofline.plans import audit, evaluation, ingest
from proofline.plans.views import duck_tokens

LINES = ["Die Prüfung der Pumpe dauert 5 Tage", "plain words about a pump test", "  ", "Größe: 12 mm, café", "le délai est de 3 jours", "日本語 only here"]
BENCH = ["Wie lange dauert die Prüfung der Pumpe, 5 Tage?", "le délai est de 3 jours"]
TOKEN = r"\b[a-zA-Z0-9_-]+\b"


@pytest.fixture
def text_dir(spark, tmp_path):
    docs = [(1, "\n".join(LINES[:3]), "web"), (2, "\n".join(LINES[3:]), "mail")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_lines_that_are_not_ascii_count(spark, text_dir):
    kept = [x for x in LINES if x.strip()]
    tokens = [re.findall(TOKEN, x.lower()) for x in kept]
    got = {r["token"]: (r["n"], r["chunks"]) for r in ingest.o_t1_tokens(spark, text_dir).collect()}
    n, chunks = Counter(t for x in tokens for t in x), Counter(t for x in tokens for t in set(x))
    assert got == {t: (n[t], chunks[t]) for t in n}
    assert abs(audit.o_g1_average_length(spark, text_dir).first()[0] - sum(map(len, tokens)) / len(kept)) < 1e-9
    assert ingest.o_a12_numbered_chunks(spark, text_dir).count() == len(kept)
    # a line is evidence of a text if they share a token; no other rule keeps a pair out here
    want = {(q, k) for q, b in enumerate(BENCH) for k, x in enumerate(tokens) if set(x) & set(re.findall(TOKEN, b.lower()))}
    ids = {r["chunk_id"]: r["content"] for r in audit.line_chunks(spark, text_dir).collect()}
    assert sorted(ids.values()) == sorted(kept)
    assert {(r["req_id"], kept.index(ids[r["chunk_id"]])) for r in audit.retrieve_evidence(spark, text_dir).collect()} == want
    assert {r["code"]: r["first_hit"] for r in evaluation.o_j2_first_hits(spark, text_dir).collect()} == {"REQ-BEN-00000": 1, "REQ-BEN-00001": 1}


def test_specification_texts_do_not_grow_with_the_table(spark, tmp_path):
    spark.range(1, 3001).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    lines = [len(r["text"].split("\n")) for r in ingest._spec_text(spark, str(tmp_path)).collect()]
    assert sum(lines) == 3000 and max(lines) <= 50
    assert {r["grp"] for r in ingest.o_t5_extracted_requirements(spark, str(tmp_path)).collect()} == set(range(61))


DIR = "/root/testdata/sf0.001"
BY_KIND = ["o_f3_f5_numeric_claims", "o_h4_pair_contradictions", "o_h6_numeric_ranges", "o_h7_thresholds", "o_h8_durations", "o_h9_flags"]


def rows_of(df, shift=0):
    return Counter((r["req_id"] - shift, *r[1:]) for r in df.collect())


@pytest.fixture(scope="module")
def judged(spark):
    return {"_claims": audit._claims(spark, DIR).cache(), "_facts": audit._facts(spark, DIR).cache()}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", BY_KIND)
def test_no_requirement_is_left_out_by_its_id(spark, judged, monkeypatch, name):
    whole = rows_of(audit.QUERIES[name](spark, DIR))
    for shift in range(1, 8):  # the same claims under other ids give the same rows
        for part, df in judged.items():
            monkeypatch.setattr(audit, part, lambda *_, df=df, shift=shift, **__: df.withColumn("req_id", F.col("req_id") + shift))
        assert rows_of(audit.QUERIES[name](spark, DIR), shift) == whole


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", BY_KIND)
def test_sql_states_all_kinds(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(audit.ORACLES[name])
    names = want.columns
    assert Counter(want.fetchall()) == Counter(tuple(r[n] for n in names) for r in audit.QUERIES[name](spark, DIR).collect())


def test_tokens_mean_the_same_in_sql():
    """DuckDB's form of the tokens against the pattern itself, around hyphens, marks and letters of other scripts."""
    rng = random.Random(17)
    texts = ["".join(rng.choice(["a", "Z", "7", "_", "-", "--", "é", "ß", "漢", " ", ".", "–", "x-é-y", "é-"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    got = dict(con.execute(f"SELECT i, {duck_tokens('x')} FROM t").fetchall())
    assert all(got[i] == re.findall(TOKEN, x.lower()) for i, x in enumerate(texts))
