"""The sweep over candidates on odd rows: null keys, lengths, coordinates and lines, cases without room; against its SQL, the order ended by draw."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from caselake import plans
from caselake.operators import casewise, sweep
from caselake.plans import designs

SF = "/root/testdata/sf0.001"
R = plans.RELATIONS
SEG = "case_id long, seg_idx long, x double, y double, dx double, dy double, length double, maxlength double, group_id string"
SOME = f"SELECT * FROM '{SF}/lineitem.parquet' WHERE l_orderkey < 32"
THIRD = "l_partkey % 3 = 0"


@pytest.mark.parametrize("odd", [
    "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey",
    f"CASE WHEN {THIRD} THEN NULL ELSE l_quantity END AS l_quantity",
    f"CASE WHEN {THIRD} THEN NULL ELSE l_quantity END AS l_quantity, 'A' AS l_returnflag, l_linenumber % 2 AS l_linenumber",
    f"CASE WHEN {THIRD} THEN NULL ELSE l_partkey END AS l_partkey",
    f"CASE WHEN {THIRD} THEN NULL ELSE l_suppkey END AS l_suppkey",
    f"CASE WHEN {THIRD} THEN NULL ELSE l_linenumber END AS l_linenumber",
    "-l_quantity AS l_quantity",
], ids=["keys", "lengths", "lengths in groups", "x or y", "y or x", "lines", "no length"])
def test_candidates_of_odd_rows_equal_their_sql(spark, tmp_path, odd):
    duckdb.sql(f"COPY (SELECT * REPLACE ({odd}) FROM ({SOME})) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    order = "ORDER BY round(cost, 6), case_id LIMIT"
    text = plans.ORACLE_SQL["sm13_candidates"]
    assert text.count(order) == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(text.replace(order, order.replace("case_id", "case_id, draw"))).fetchall()
    assert [tuple(r) for r in plans.QUERIES["sm13_candidates"](spark, str(tmp_path)).collect()] == want and 0 < len(want) < 100


def test_segments_without_length_or_area(spark):
    # Case 1: a bar of 20 x 80 and a segment without length, which has no axis and resets nothing. Case 2: one of length 0, so no column.
    # Case 3: a group of two, one without maximum. A null case isn't one.
    rows = [
        (1, 0, 0.0, 10.0, 1.0, 0.0, 80.0, 90.0, "a"), (1, 1, 10.0, 0.0, 0.0, 1.0, None, 90.0, "b"), (2, 0, 0.0, 10.0, 1.0, 0.0, 0.0, 0.0, None),
        (3, 0, 0.0, 10.0, 1.0, 0.0, 40.0, 60.0, "a"), (3, 1, 300.0, 10.0, 1.0, 0.0, 40.0, None, "a"), (None, 0, 0.0, 10.0, 1.0, 0.0, 80.0, 90.0, "a"),
    ]
    seg, walls = spark.createDataFrame(rows, SEG), R.frame(spark, SF, "walls")
    cases = {r["case_id"]: r for r in sweep.grouped_cases(seg).collect()}
    assert cases[1]["lower"] == [80.0, None] and not cases[1]["pairs"] and (cases[3]["lower"], cases[3]["upper"]) == ([40.0], [60.0])
    got = sweep.sweep(seg, walls, designs.STEEL, n=2).collect()
    assert sorted((r["case_id"], r["draw"]) for r in got) == [(1, 0), (1, 1), (3, 0), (3, 1)]
    table = {r["case_id"]: r for r in casewise.case_table(seg.where(F.col("case_id") < 3), walls).collect()}
    assert (table[1]["columns_count"], table[2]["columns_count"], table[2]["columns_min_area_cm2"], table[2]["concrete_m3"]) == (1, 0, None, 6.0192)
