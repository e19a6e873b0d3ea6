"""Rows that an order leaves open."""

import datetime
import os

import duckdb

from proofline.plans import audit


def test_of_equal_chunks_the_first_of_the_table_decides(spark, tmp_path):
    """Two lines of one part, order and number: the value in the earlier row decides, whichever task brings it."""
    day = datetime.datetime(2020, 1, 1)
    spark.createDataFrame([(k, "n", "b", "t", 20, 1.0) for k in (1, 2, 3, 9)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    values = {1: (10.0, 30.0), 2: (30.0, 10.0), 3: (30.0, 10.0), 9: (30.0, 10.0)}
    rows = [(5, k, 1, 1, v[n], 1.0, 0.0, 0.0, "N", "O", day) for n in range(2) for k, v in values.items()]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = audit.o_h7_thresholds(spark, str(tmp_path))
    assert {r["req_id"]: r["status"] for r in found.collect()} == {1: "SUPPORTED", 2: "CONFLICT", 3: "SUPPORTED", 9: "CONFLICT"}
    candidates = audit._candidates(spark, str(tmp_path))
    plan = candidates._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(req_id" in plan and "ASC NULLS FIRST, place" in plan and "place" not in candidates.columns


def test_of_equal_chunks_the_first_file_decides(spark, tmp_path):
    """A table of two files: rows of the first go before those of the second, wherever they stand in them."""
    con = duckdb.connect()
    con.execute("SET threads=1")
    con.execute(f"COPY (SELECT k AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, 20::INT AS p_size, 1.0::DOUBLE AS p_retailprice FROM range(1, 4) AS r(k)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    os.mkdir(f"{tmp_path}/lineitem.parquet")
    for n in range(2):  # the deciding rows stand last in the first file and first in the second
        line = f"SELECT 5 + o AS l_orderkey, k AS l_partkey, 1::BIGINT AS l_suppkey, 1::INT AS l_linenumber, CASE WHEN k % 2 = {n} THEN 10.0 ELSE 30.0 END::DOUBLE AS l_quantity, 'N' AS l_returnflag, 'O' AS l_linestatus"
        con.execute(f"COPY ({line} FROM range(1, 4) AS r(k), range(100) AS s(o) ORDER BY o {('DESC', '')[n]}, k) TO '{tmp_path}/lineitem.parquet/part-{n}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("o_h7_thresholds", "o_h12_h13_statuses"):
        found = audit.QUERIES[name](spark, str(tmp_path))
        want = con.execute(audit.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(want.fetchall()) == sorted(tuple(r[c] for c in columns) for r in found.collect()), name
