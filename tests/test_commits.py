"""Tables replaced together, also when a run breaks off between them."""

import pytest
from pyspark.sql import functions as F

from proofline.sources import commits


def state(spark, root, version=None):
    return {name: sorted(tuple(r) for r in df.select("id", "v").collect()) for name, df in commits.read_tables(spark, root, version).items()}


def test_commits(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    df = lambda *rows: spark.createDataFrame(list(rows), "id int, v string").withColumn("project_id", F.col("id") % 2)
    assert commits.read_tables(spark, root) == {} and commits.latest(spark, root) == 0
    assert commits.commit(spark, root, {"requirements": df((1, "a")), "findings": df((1, "x"), (2, "y"))}) == 1
    first = {"requirements": [(1, "a")], "findings": [(1, "x"), (2, "y")]}
    assert state(spark, root) == first
    pinned = commits.read_tables(spark, root)
    # a run that fails on its second table leaves the old result
    broken = df((3, "c")).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        commits.commit(spark, root, {"requirements": df((9, "z")), "findings": broken})
    assert state(spark, root) == first
    # tables that a commit does not name stay
    assert commits.commit(spark, root, {"findings": df((5, "n"))}) == 2
    assert state(spark, root) == {"requirements": [(1, "a")], "findings": [(5, "n")]} and state(spark, root, 1) == first
    assert sorted(r["id"] for r in pinned["findings"].collect()) == [1, 2]
    gone = {r["path"].split("/tables/")[1].split("-")[0] for r in commits.unnamed(spark, root).collect()}
    assert gone == {"findings/1", "requirements/2"}


def test_two_runs_of_one_number(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/state"
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    commits.commit(spark, root, {"t": df})
    monkeypatch.setattr(commits, "latest", lambda *_: 0)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, {"t": df})
