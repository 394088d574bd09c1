"""Hand-computed values, and every relation's SQL against DuckDB on a few tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from caselake import plans
from caselake.operators import models

SF = "/root/testdata/sf0.001"
R = plans.RELATIONS


def rects(spark, rows):
    return spark.createDataFrame(rows, "case_id long, seg_idx long, group_key string, length double, maxlength double, rx0 double, rx1 double, ry0 double, ry1 double")


def columns_of(spark, rows):
    r = rects(spark, rows)
    edges = R.operator("jn1_touching_pairs")(fn4_rectangles=r)
    comp = R.operator("ag1_components")(fn4_rectangles=r, jn1_touching_pairs=edges)
    made = R.operator("comp_rects")(fn4_rectangles=r, ag1_components=comp)
    cells = R.operator("cells")(comp_rects=made, x_cuts=R.operator("x_cuts")(comp_rects=made), y_cuts=R.operator("y_cuts")(comp_rects=made))
    return R.operator("ag2_rect_union")(cell_edges=R.operator("cell_edges")(cells=cells))


def test_union_of_overlapping_rectangles(spark):
    # An L of two 20 x 80 bars that overlap in 20 x 20: area 2800, perimeter 320.
    got = columns_of(spark, [(1, 0, "a", 0.0, 0.0, 0.0, 80.0, 0.0, 20.0), (1, 1, "b", 0.0, 0.0, 0.0, 20.0, 0.0, 80.0)]).collect()
    assert [(r["area"], r["perimeter"]) for r in got] == [(2800.0, 320.0)]


def test_touching_connects_and_apart_does_not(spark):
    got = columns_of(spark, [(1, 0, "a", 0.0, 0.0, 0.0, 10.0, 0.0, 10.0), (1, 1, "b", 0.0, 0.0, 10.0, 20.0, 0.0, 10.0), (1, 2, "c", 0.0, 0.0, 50.0, 60.0, 0.0, 10.0)])
    assert sorted(r["area"] for r in got.collect()) == [100.0, 200.0]


def test_column_quantities(spark):
    u = spark.createDataFrame([(1, 0, 1000.0, 140.0)], "case_id long, component long, area double, perimeter double")
    assert tuple(R.operator("ag4_column_quantities")(ag2_rect_union=u).first()) == (1, 0.3, 4.2)


def test_regression_metrics(spark):
    reg = spark.createDataFrame([(0, 100.0, 90.0), (1, 200.0, 220.0), (2, 300.0, 270.0), (3, 400.0, 450.0)], "idx long, y double, yhat double")
    assert R.operator("ev1_regression_metrics")(reg=reg).first()["mae"] == 27.5
    assert R.over(spark, reg=reg)("ev4_under_prediction").first()["low_mae"] == 10.0


def test_no_rows(spark):
    assert columns_of(spark, []).count() == 0


@pytest.mark.parametrize("name", ["fn4_rectangles", "jn2_conflict_pairs", "ag8_group_bounds", "sp1_split_regression", "ev12_roc", "ev13_auc", "wn4_best_so_far", "sm5_latin_hypercube", "fn10_parse_locale_number", "ev10_paired_folds", "jn10_permute", "dg4_residual_histogram", "rv3_report_breakdown", "fn7_ring_inertia", "fd21_span_p95", "fe_gate", "dg7_matrix", "jn9_nearest", "sm7_nearest_train", "dg10_coverage", "src1_segments", "src3_grid", "snk5_section", "ss6_ledger"])
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "orders", "events", "part", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    norm = lambda rows: sorted(repr(tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r)) for r in rows)
    assert norm(map(tuple, df.select(*cols).collect())) == norm(c.sql(f"select {', '.join(cols)} from ({plans.ORACLE_SQL[name]})").fetchall())


def test_nearest_in_many_blocks(spark):
    from caselake.operators.nearest import nearest

    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, (90, 3)).astype(float)
    rows = lambda ids: spark.createDataFrame([(i, v[i].tolist()) for i in ids] + [(None, [0.0] * 3), (900, None)], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["rank"]): (r["near_id"], r["distance"]) for r in nearest(rows(range(20)), rows(range(10, 90)), block=7).collect()}
    for i in range(20):
        want = sorted((float(np.sqrt(((v[i] - v[j]) ** 2).sum())), j) for j in range(10, 90))[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, d) for d, j in want]
    assert len(got) == 100
    assert nearest(rows(range(20)), rows([])).count() == 0
    assert nearest(rows([3]), rows([3, 4])).count() == 1


def test_components_of_vectors(spark):
    v = np.random.default_rng(2).normal(size=(200, 4)) * [9, 3, 1, 0.1] + 5
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = models.principal_components(df, df).orderBy("vec_id").collect()
    _, s, axes = np.linalg.svd(v - v.mean(axis=0), full_matrices=False)
    for j in range(2):
        axis = axes[j] * np.sign(axes[j][np.abs(axes[j]).argmax()])
        assert np.allclose([r[f"pc{j + 1}"] for r in got], v @ axis - v.mean(axis=0) @ axis, atol=1e-6)
    assert np.allclose(got[0]["explained"], (s**2 / (s**2).sum())[:2])


def test_cross_validation_and_ablation(spark):
    x = np.random.default_rng(3).normal(size=(120, 3))
    df = spark.createDataFrame([(*map(float, r), float(5 * r[0] + r[1]), i % 3) for i, r in enumerate(x)], "a double, b double, c double, y double, fold int")
    ranked = models.ranked_candidates(models.cross_validate(df, "y", {"all": ("linear", ["a", "b", "c"], {}), "one": ("linear", ["b"], {})})).orderBy("mae_rank").collect()
    assert [r["candidate"] for r in ranked] == ["all", "one"] and ranked[0]["mean_mae"] < 1e-6
    rise = {r["left_out"]: r for r in models.ablation(df, "y", {"a": ["a"], "b": ["b"], "c": ["c"]}).collect()}
    assert rise["a"]["mean"] > rise["b"]["lowest"] > 0.1 and rise["a"]["positive_share"] == 1 and abs(rise["c"]["mean"]) < 1e-6
    with pytest.raises(ValueError, match="two folds"):
        models.cross_validate(df.where("fold = 0"), "y", {"all": ("linear", ["a"], {})})


def boxes(rng, n, cases, side):
    x, y, w, h = rng.uniform(0, side, n), rng.uniform(0, side, n), rng.uniform(20, 300, n), rng.uniform(20, 300, n)
    return [(int(i % cases), int(i // cases), f"g{i // cases % 7}", 0.0, 0.0, float(x[i]), float(x[i] + w[i]), float(y[i]), float(y[i] + h[i])) for i in range(n)]


def test_grid_finds_the_pairs_of_the_theta_join(spark, monkeypatch):
    from caselake.operators import graph

    rows = rects(spark, [*boxes(np.random.default_rng(7), 240, 3, 1500), (9, 0, "a", 0.0, 0.0, 0.0, 200.0, 0.0, 20.0), (9, 1, "b", 0.0, 0.0, 200.0, 400.0, 20.0, 40.0)]).cache()
    axis = rows.selectExpr("case_id", "group_key", "if(coalesce(try_cast(substring(group_key, 2) AS INT), 0) % 2 = 0, 'x', 'y') AS axis").distinct()
    found = {}
    for most in (10**9, 1):  # no grid, then the grid for every case
        monkeypatch.setattr(graph, "AS_ARRAY", most)
        found[most] = [sorted(map(tuple, df.collect())) for df in (graph.touching_pairs(rows), graph.conflict_pairs(rows, axis))]
    assert found[1] == found[10**9] and len(found[1][0]) > 300 and (9, 0, 1) in found[1][0] and len(found[1][1]) > 10


def test_one_huge_case_takes_seconds(spark):
    import time

    from caselake.operators import graph

    n = 100_000
    rng = np.random.default_rng(8)
    x, y = rng.uniform(0, 120_000, n), rng.uniform(0, 120_000, n)
    df = spark.createDataFrame([(1, i, "g", 0.0, 0.0, float(a), float(a + 80), float(b), float(b + 20)) for i, (a, b) in enumerate(zip(x, y, strict=True))], rects(spark, []).schema).repartition(8)
    began = time.time()
    assert graph.touching_pairs(df).count() > 1000
    assert time.time() - began < 60


def test_nulls_constants_and_one_class(spark):
    reg = spark.createDataFrame([(1, None, 1.0, "a"), (2, 5.0, 1.0, "a"), (3, 4.0, 1.0, "b")], "idx long, y double, yhat double, band string")
    assert [(r["idx"], r["rk"], r["total"]) for r in R.operator("wn9_global_rank")(reg=reg).orderBy("rk").collect()] == [(3, 1, 3), (2, 2, 3), (1, 3, 3)]
    flat = spark.createDataFrame([(i, 7.0, 7.0 + i) for i in range(4)], "idx long, y double, yhat double")
    assert [tuple(r) for r in R.operator("ag13_histogram")(reg=flat).collect()] == [(15, 4)]
    assert R.operator("ev1_regression_metrics")(reg=flat).first()["r2"] == 0.0
    q = R.operator("reg_quantiles")(reg=flat.withColumn("y", flat.idx.cast("double"))).first()
    assert (q["med"], q["q25"]) == (1.5, 0.75) and R.operator("reg_quantiles")(reg=flat.limit(0)).first()["med"] is None
    clf = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.7)], "idx long, valid int, p_invalid double")
    of = R.over(spark, clf=clf)
    assert of("ev13_auc").first()["auc"] is None and {r["tpr"] for r in of("ev12_roc").where("thr is not null").collect()} == {None}
    got = of("ev11_confusion").first()
    assert (got["tp"], got["fn"], got["recall_invalid"], got["invalid_as_valid_rate"]) == (1, 1, 0.0, None)
    cases = spark.createDataFrame([(1, 0, 0.2, 0.0, 1.0, 0.0, 5.0, 9.0, "a"), (2, 0, 0.7, 0.0, 1.0, 0.0, 5.0, 9.0, "a"), (3, 0, 0.2, 0.0, 1.0, 0.0, 5.0, 9.0, "a")], "case_id long, seg_idx long, x double, y double, dx double, dy double, length double, maxlength double, group_id string")
    assert sorted(r["case_id"] for r in R.over(spark, seg=cases)("st1_dedup_cases").collect()) == [1, 2]


@pytest.mark.parametrize(("n", "change", "message"), [(260, {}, "not enough new samples"), (2, {}, "At least three"), (400, {7: float("inf")}, "NaN or infinite"), (400, {9: None}, "NaN or infinite")])
def test_split_guards(spark, n, change, message):
    reg = spark.createDataFrame([(i, change.get(i, float(i)), 1.0, "a") for i in range(n)], "idx long, y double, yhat double, band string")
    with pytest.raises(Exception, match=message):
        R.over(spark, reg=reg)("sp1_split_regression").collect()


def test_split_sizes(spark):
    reg = spark.createDataFrame([(i, float(i * 37 % 101), 1.0, "a") for i in range(2500)], "idx long, y double, yhat double, band string")
    rows = R.over(spark, reg=reg)("sp1_split_regression").collect()
    sizes = {p: sum(r["part"] == p for r in rows) for p in ("train", "validation", "test")}
    assert sizes == {"train": 1700, "validation": 425, "test": 375} and min(r["idx"] for r in rows if r["part"] == "test") >= 230


def test_leakage_and_groups(spark):
    from caselake.operators import contracts

    df = spark.createDataFrame([("train", 1.0, 2.0), ("train", 3.0, 4.0), ("train", 3.0, 4.0), ("test", 4.0, 3.0), ("test", None, 4.0)], "part string, a double, b double")
    assert contracts.require_isolation(df, "part", ["a", "b"]).count() == 5
    with pytest.raises(Exception, match="split leakage: feature rows in several parts: 1"):
        contracts.require_isolation(df.union(spark.createDataFrame([("test", 3.0, 4.0)], df.schema)), "part", ["a", "b"]).collect()
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    groups = spark.createDataFrame([("g", "a"), ("h", "a"), ("h", "b"), ("h", "z")], "grp string, name string")
    got = sorted(map(tuple, R.operator("sp9_group_coverage")(feature_names=names, feature_groups=groups).collect()))
    assert got == [("a", "in several groups", 2), ("c", "ungrouped", 0), ("z", "unknown", 1)]


def test_pruned_nearest_are_the_nearest(spark):
    from caselake.operators.nearest import _first_visits, nearest, nearest_pruned

    rng = np.random.default_rng(9)
    rows = lambda v, base=0: spark.createDataFrame([(base + i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (10**6 + base, None)], "vec_id long, embedding array<double>")
    for v in (rng.integers(0, 3, (150, 4)).astype(float), rng.normal(size=(400, 3)) + 40 * rng.integers(0, 4, (400, 1))):
        test, train = rows(v[:60]), rows(v[30:], 30)
        got = lambda df: sorted(map(tuple, df.collect()))
        assert got(nearest_pruned(test, train, pivots=8, block=20)) == got(nearest(test, train))
    assert got(nearest_pruned(rows(v[:3]), rows(v[:5]))) == got(nearest(rows(v[:3]), rows(v[:5])))
    assert nearest_pruned(rows(v[:3]), rows(v[:1]).where("vec_id IS NULL")).count() == 0 and nearest_pruned(rows(v[:1]).limit(0), rows(v)).count() == 0
    # In clusters far apart a test row visits a small part of the rows, and a smaller one as there are more clusters.
    share = []
    for clusters in (5, 40):
        v = rng.normal(size=(30 * clusters, 3)) + 100 * np.arange(clusters).repeat(30)[:, None]
        filed, visits, k = _first_visits(rows(v[::10]), rows(v), 5, "vec_id", "embedding", 64)
        sizes = filed.groupBy("cell").count()
        far = visits.where("low > 30").join(sizes, "cell").agg({"count": "sum"}).first()[0]
        share.append(1 - far / (len(v) * len(v[::10])))
    assert k == 5 and share[1] < share[0] / 2 < 0.3
