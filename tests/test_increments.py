"""Counts kept by changes against recounts."""

import random

import pytest
from pyspark.sql import functions as F

from proofline.functions import fixed
from proofline.operators import increments, outputs


def test_ten_batches_equal_the_recount(spark, tmp_path):
    root, rng = f"file://{tmp_path}/stats", random.Random(10)
    projects = spark.createDataFrame([(p,) for p in range(5)], "project_id int")
    reqs, docs, chunks, found = {}, {}, {}, {}
    signed = lambda rows: spark.createDataFrame(rows, "project_id int, coverage_status string, sign int")
    assert {r["total"] for r in increments.stored_stats(spark, root, projects).collect()} == {0}
    for step in range(10):
        batch = {"requirements": [], "documents": [], "chunks": [], "findings": []}
        for _ in range(12):
            k, p = rng.randrange(60), rng.randrange(4)
            if k in reqs:
                batch["requirements"].append((*reqs.pop(k), -1))
            if rng.random() < 0.8:
                reqs[k] = (p, rng.choice([*fixed.STATUSES, None]))
                batch["requirements"].append((*reqs[k], 1))
            if k not in docs:
                docs[k] = p
                batch["documents"].append((p, None, 1))
            chunks[len(chunks)] = k
            batch["chunks"].append((docs[k], None, 1))
            if k in found:
                batch["findings"].append((found.pop(k), None, -1))
            else:
                found[k] = p
                batch["findings"].append((p, None, 1))
        rows = {name: signed(rows) for name, rows in batch.items()}
        assert increments.apply_batch(spark, root, f"batch-{step}", rows)
        assert not increments.apply_batch(spark, root, f"batch-{step}", rows)  # replayed
    again = outputs.project_stats(
        projects,
        spark.createDataFrame(list(reqs.values()), "project_id int, coverage_status string"),
        spark.createDataFrame(list(docs.items()), "document_id int, project_id int"),
        spark.createDataFrame(list(chunks.items()), "chunk_id int, document_id int"),
        spark.createDataFrame([(p,) for p in found.values()], "project_id int"),
    )
    got = increments.stored_stats(spark, root, projects).select(*again.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(Exception, match="lost"):
        increments.apply_batch(spark, root, "broken", {"findings": spark.range(1).select(F.lit(1).alias("project_id"), F.raise_error(F.lit("lost")).cast("int").alias("sign"))})
    assert sorted(map(tuple, increments.stored_stats(spark, root, projects).select(*again.columns).collect())) == sorted(map(tuple, again.collect()))
