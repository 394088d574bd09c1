from __future__ import annotations

from caselake.plans import RELATIONS as R


def test_a_mean_adds_costs_in_the_order_of_iterations(spark):
    log = spark.createDataFrame([(1, 3, 1.0), (1, 2, -1e16), (1, 1, 1e16), (2, 1, None), (3, 2, None), (3, 1, 4.0)], "run_id long, iteration long, cost double").coalesce(1)
    got = {r["run_id"]: r["mean_cost"] for r in R.over(spark, log=log)("ag15_fold_summary").collect()}
    assert got == {1: 0.333333, 2: None, 3: 4.0}
