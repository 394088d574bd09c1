"""Numbers on the edge of a digit are rounded as the SQL of the check rounds them."""

from __future__ import annotations

import duckdb

from caselake import plans

R = plans.RELATIONS


def test_residuals_on_the_edge_of_a_cent(spark):
    # The first is 3534.945 in decimals and 3534.9449999999997 in doubles; halves go away from zero.
    rows = [(12594, 35349.45, 900), (2, 35349.45, 0), (3, -35349.45, 900), (4, 0.25, 0), (5, None, 7), (6, float("inf"), 1)]
    orders = spark.createDataFrame([(i, y, c, "1-URGENT") for i, y, c in rows], "o_orderkey long, o_totalprice double, o_custkey long, o_orderpriority string")
    got = {r["idx"]: r["e"] for r in R.over(spark, orders=orders)("resid").collect()}
    assert got[12594] == 3534.95 and got[3] == -3534.95 and got[5] is None and got[6] != got[6]
    con = duckdb.connect()
    con.register("orders", orders.toPandas())
    want = dict(con.execute(R.duckdb("resid", final="SELECT idx, e FROM {resid}")).fetchall())
    assert {i: got[i] for i in (12594, 2, 3, 4)} == {i: want[i] for i in (12594, 2, 3, 4)}
    assert "round(y - yhat, 2)" in R.duckdb("resid")


def test_quantiles_equal_their_sql_to_the_last_digit(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW orders AS SELECT * FROM read_parquet('/root/testdata/sf0.01/orders.parquet')")
    made = plans.QUERIES["dg5_qq"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(tuple(r) for r in made) == sorted(con.execute(plans.ORACLE_SQL["dg5_qq"]).fetchall())
