import os
import re

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def test_registered():
    names = list(entry.queries())
    for n in range(1, 14):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
def test_pipeline(spark):
    import corpus_pipeline
    from proofline.llm.shared import materialize

    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_array_dedup", "decontamination", "sentencepiece"]
    rows = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, n = rows.columns, rows.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = materialize(stage(spark, rows, DIR), name)
        assert rows.columns == columns and 0 < rows.count() <= n
        n = rows.count()
    assert corpus_pipeline.run(spark, DIR).count() == n


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns and an empty table."""
    import random

    import corpus_pipeline
    from pyspark.sql import functions as F

    rng = random.Random(40)
    text = lambda n: " ".join("".join(rng.choice(["la", "mo", "ti", "ru", "se"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    item, passage, near = text(30), text(70), text(120)
    rows = [(k, text(60) + (" so vileo it is. " if k % 4 == 0 else ". ") + text(40)) for k in range(80)]
    rows += [(100, near), (101, near + " end"), (102, f"{text(40)} {passage} {text(40)}"), (103, f"{text(40)} {passage} {text(40)}"), (104, f"{text(20)} {item} {text(20)}")]
    rows += [(105, text(9000)), (106, None), (107, ""), (108, " \n"), (None, text(50)), (None, None), (109, "x"), (109, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], schema)
    for name in ("key", "id", "spans", "_key", "block", "hub", "component_id", "score", "doc_row", "item_id"):
        docs = docs.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(80)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for name, df in {"documents": docs, "labels": labels, "benchmark": spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string")}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    seen = {}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{name}.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen[name] = [(r["doc_id"], r["text"]) for r in now.collect()]
    ids = {name: [i for i, _ in kept] for name, kept in seen.items()}
    assert sum(i is not None and i < 80 and i % 4 == 0 for i in ids["toxicity"]) <= 2 and sum(i is not None and i < 80 and i % 4 > 0 for i in ids["toxicity"]) >= 58
    assert 100 in ids["near_dedup"] and 101 not in ids["near_dedup"] and ids["near_dedup"].count(109) == 2 and ids["near_dedup"].count(None) == 2
    cut = dict(seen["suffix_array_dedup"])
    assert passage not in cut[102] and passage not in cut[103] and cut[106] is None and cut[107] == "" and len(cut[105]) > 20_000
    assert set(ids["near_dedup"]) - set(ids["decontamination"]) == {104}
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert last.count() == now.count() == corpus_pipeline.run(spark, str(tmp_path)).count()
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
