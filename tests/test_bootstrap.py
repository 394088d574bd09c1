from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from caselake.operators import bootstrap
from caselake.plans import RELATIONS as R


def test_draws_are_those_of_md5(spark):
    import hashlib

    for replicates, keys in ((range(1, 10), [b"0", b"7"]), (range(98, 100), [b"-123456789012", b"012345678901x"[:13]]), ([1000], [b"x" * 60, b"y" * 60])):
        want = [[int(hashlib.md5(b"71:%d:%s" % (g, k)).hexdigest()[:13], 16) for k in keys] for g in replicates]
        assert bootstrap.draws("71", list(replicates), keys).tolist() == want


def test_replicates_in_one_pass_without_copies_of_rows(spark):
    reg = spark.range(0, 1300, 13).selectExpr("id AS idx", "100D + id % 7 AS y", "IF(id = 26, NULL, IF(id = 39, double('NaN'), 101D + id % 5)) AS yhat")
    part = reg.select("idx", F.when(F.col("idx") % 3 == 0, "train").otherwise("test").alias("part"))
    df = R.made_by["replicates"](reg, part)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    wanted = {r["replicate"]: r for r in R.over(spark, reg=reg, sp1_split_regression=part)("replicates").collect()}
    got = {r["replicate"]: r for r in df.collect()}
    assert got.keys() == wanted.keys()
    for k, r in got.items():
        np.testing.assert_allclose(list(r), list(wanted[k]), rtol=1e-9)
    assert R.whole["replicates"] == ("reg", "sp1_split_regression")


def test_paired_bootstrap_makes_no_copies_of_rows(spark):
    from caselake.plans import QUERIES

    plan = QUERIES["ev9_paired_bootstrap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan
