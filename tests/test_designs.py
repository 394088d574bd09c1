"""Whole designs: geometry as arrays against the relations, prediction, contracts, sweeps, populations, robust choice, importance, labels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselake import plans
from caselake.operators import casewise, contracts, evolve, importance, labelling, models, ranks, sweep
from caselake.plans import designs

SF = "/root/testdata/sf0.001"
R = plans.RELATIONS
SEG = "case_id long, seg_idx long, x double, y double, dx double, dy double, length double, maxlength double, group_id string"
WALLS = "wall_id int, wx0 double, wy0 double, wx1 double, wy1 double"


def seg(spark, rows):
    return spark.createDataFrame(rows, SEG)


def walls(spark):
    return R.frame(spark, SF, "walls")


def test_arrays_and_relations_agree_on_large_and_small_cases(spark, monkeypatch):
    rows = R.frame(spark, SF, "seg").where("case_id < 900")
    got = {r["case_id"]: r for r in designs.case_rows(R, rows, walls(spark)).collect()}
    monkeypatch.setattr(casewise, "AS_ARRAY", 5)  # now cases of 6 and 7 segments go through the relations
    want = {r["case_id"]: r for r in designs.case_rows(R, rows, walls(spark)).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        for c in ("columns_count", "concrete_m3", "formwork_m2", *casewise.FEATURES):
            assert r[c] == pytest.approx(want[i][c], rel=1e-5, abs=1e-5), (i, c)


def test_one_shuffle(spark):
    plan = casewise.case_table(seg(spark, []), walls(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_hand_made_cases(spark):
    # Case 1: an L of 20 x 80 bars, area 2800, perimeter 320. Case 2: a skew segment alone. Case 3: no rectangle of any length but a null.
    rows = [(1, 0, 0.0, 10.0, 1.0, 0.0, 80.0, 90.0, "a"), (1, 1, 10.0, 0.0, 0.0, 1.0, 80.0, 90.0, "b"), (2, 0, 0.0, 0.0, 1.0, 1.0, 50.0, 60.0, None), (3, 0, None, 0.0, 1.0, 0.0, 5.0, 9.0, "")]
    got = {r["case_id"]: r for r in casewise.case_table(seg(spark, rows), walls(spark)).collect()}
    assert (got[1]["columns_count"], got[1]["columns_total_area_cm2"], got[1]["formwork_m2"]) == (1, 2800.0, pytest.approx(9.6))
    assert got[1]["concrete_m3"] == pytest.approx(0.84 + 6.0192)
    assert [got[k]["columns_count"] for k in (2, 3)] == [0, 0] and got[2]["columns_total_area_cm2"] is None and got[2]["concrete_m3"] == 6.0192
    assert casewise.case_table(seg(spark, []), walls(spark)).count() == 0


def test_predict_cases_with_fitted_models(spark):
    rows = R.frame(spark, SF, "seg").where("case_id < 600")
    table = casewise.case_table(rows, walls(spark)).withColumn("y", F.col("columns_total_area_cm2") * 0.1 + 7).withColumn("valid", (F.col("columns_max_area_cm2") < 2000).cast("int"))
    some = ["columns_total_area_cm2", "columns_max_area_cm2", "beams_max_clear_span_x_cm"]
    scaling = models.fit_scaler(table, some)
    fitted = models.fit_regressor(models.scale(table, scaling), "y", some, "linear")
    judge = models.fit_validity(models.scale(table, scaling), "valid", some)
    invalid = lambda df: models.p_invalid(judge, df).withColumnRenamed("p_invalid", "prediction")
    asked = rows.unionByName(seg(spark, [(-1, 0, 0.0, 0.0, 1.0, 1.0, 50.0, 60.0, None)]))
    got = {r["case_id"]: r for r in designs.predict_cases(R, asked, walls(spark), designs.Models(fitted, invalid, scaling)).collect()}
    assert tuple(got[-1]) == (-1, None, None, None, None, "no columns")
    for r in table.collect():
        g = got[r["case_id"]]
        assert g["reason"] is None and g["steel"] == pytest.approx(r["y"], rel=1e-6) and 0 <= g["p_invalid"] <= 1 and g["concrete_m3"] == r["concrete_m3"]


def artifact(spark, **change):
    row = designs.CONTRACT | change
    kinds = {"artifact_format_version": "int", "feature_schema_version": "int", "feature_names": "array<string>", "target_names": "array<string>", "target_units": "array<string>", "input_size": "int", "output_size": "int"}
    return spark.createDataFrame([tuple(row[k] for k in kinds)], ", ".join(f"{k} {v}" for k, v in kinds.items()))


def test_contracts(spark):
    df = spark.range(3)
    assert contracts.require_contract(df, artifact(spark), designs.CONTRACT).count() == 3
    swapped = [casewise.FEATURES[1], casewise.FEATURES[0], *casewise.FEATURES[2:]]
    with pytest.raises(Exception, match="contract is incompatible: feature_schema_version: artifact 1 expected 11"):
        contracts.require_contract(df, artifact(spark, feature_schema_version=1), designs.CONTRACT).collect()
    with pytest.raises(Exception, match="contract is incompatible: feature_names"):
        contracts.require_contract(df, artifact(spark, feature_names=swapped), designs.CONTRACT).collect()
    with pytest.raises(Exception, match="missing required contract fields: input_size"):
        contracts.require_contract(df, artifact(spark).drop("input_size"), designs.CONTRACT).collect()
    with pytest.raises(Exception, match="no artifact"):
        contracts.require_contract(df, artifact(spark).limit(0), designs.CONTRACT).collect()
    assert contracts.require_contract(df, artifact(spark, target_units=["t"]), designs.CONTRACT, soft=["target_units"]).count() == 3
    found = contracts.contract_problems(artifact(spark, target_units=["t"], input_size=None).withColumn("id", F.lit(4)), designs.CONTRACT, "id", soft=["target_units"]).orderBy("field").collect()
    assert [tuple(r) for r in found] == [(4, "input_size", "missing", None, "23", True), (4, "target_units", "mismatch", '["t"]', '["kgf"]', False)]
    ledger = spark.createDataFrame([("h", 11, ["a", "b"])] * 2, "seed_hash string, schema_version int, feature_names array<string>")
    assert contracts.resume_guard(df, ledger, "h", 11, ["a", "b"]).count() == 3
    for bad in (("other", 11, ["a", "b"]), ("h", 10, ["a", "b"]), ("h", 11, ["b", "a"])):
        with pytest.raises(Exception, match="ledger contract is incompatible"):
            contracts.resume_guard(df, ledger, *bad).collect()


def test_constraint_in_order(spark):
    # Three groups in a chain: x0 grows 5, y1 grows 8, x2 grows 6; pairs (x0, y1), (x2, y1). In order, y1 wins over x0, then over x2.
    # With growths 5, 4, 6 the first pair resets y1, so the second finds it at 0 and resets it again; by the raw draw it is the same.
    # With x0 9, y1 8, x2 6: raw growths reset y1 and x2, but in order y1 is at 0 when x2 is compared, and x2 stays.
    cases = spark.createDataFrame([(1, [5.0, 8.0, 6.0]), (2, [5.0, 4.0, 6.0]), (3, [9.0, 8.0, 6.0]), (4, [3.0, 3.0, 0.0])], "case_id long, value array<double>")
    cases = cases.withColumns({"lower": F.expr("array(0D, 0D, 0D)"), "pairs": F.expr("array(struct(0 AS x, 1 AS y), struct(2 AS x, 1 AS y))")})
    got = cases.select("case_id", F.array_sort(sweep.sequential_resets()).alias("s"), F.array_sort(sweep.independent_resets()).alias("i")).orderBy("case_id").collect()
    assert [(r["s"], r["i"]) for r in got] == [([0, 2], [0, 2]), ([1], [1]), ([1], [1, 2]), ([1], [1, 2])]


def test_realized_lengths_and_bounds(spark):
    rows = [(1, 0, 0.0, 0.0, 1.0, 0.0, 40.0, 80.0, "a"), (1, 1, 200.0, 0.0, 1.0, 0.0, 30.0, 80.0, "a"), (1, 2, 10.0, -20.0, 0.0, 1.0, 40.0, 80.0, "b")]
    cases = sweep.grouped_cases(seg(spark, rows))
    row = cases.first()
    assert (row["groups"], row["lower"], row["upper"], [tuple(p) for p in row["pairs"]]) == (["a", "b"], [40.0, 40.0], [80.0, 80.0], [(0, 1)])
    made = lambda value: sweep.realized(cases.withColumn("value", F.expr(f"cast({value} AS array<double>)")).withColumn("resets", sweep.sequential_resets()))
    assert [(q["x1"] - q["x0"], q["y1"] - q["y0"]) for q in made("array(60, 55)").first()["r"]] == [(60.0, 20.0), (60.0, 20.0), (20.0, 40.0)]
    assert [(q["x1"] - q["x0"], q["y1"] - q["y0"]) for q in made("array(50, 55)").first()["r"]] == [(40.0, 20.0), (30.0, 20.0), (20.0, 55.0)]
    for bad in ("array(60)", "array(60, 85)", "array(60, null)"):
        with pytest.raises(Exception, match="missing or outside"):
            sweep.realized(cases.withColumn("value", F.expr(f"cast({bad} AS array<double>)")).withColumn("resets", F.expr("cast(array() AS array<int>)"))).collect()


def test_cost_of_failures(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 0.4), (1.0, 2.0, 3.0, 0.5), (1.0, 2.0, 3.0, None), (-1.0, 2.0, 3.0, 0.1), (None, 2.0, 3.0, 0.1), (float("nan"), 2.0, 3.0, 0.9)], "steel double, concrete_m3 double, formwork_m2 double, p_invalid double")
    assert [r["cost"] for r in sweep.cost(rows).collect()] == [1122.0, 1001122.0, 1122.0, 1001098.0, float("inf"), float("inf")]
    assert sweep.cost(rows, threshold=0.3).first()["cost"] == 1001122.0


def test_pruned_sweep_is_the_whole_sweep(spark):
    rows = R.frame(spark, SF, "seg").where("case_id < 1200")
    key = lambda df: [(r["case_id"], r["draw"], round(r["cost"], 6)) for r in df.collect()]
    whole = key(sweep.sweep(rows, walls(spark), designs.STEEL, designs.INVALID, n=4, k=30, steel_floor=None))
    assert len(whole) == 30 and whole == key(sweep.sweep(rows, walls(spark), designs.STEEL, designs.INVALID, n=4, k=30, steel_floor=20.0))
    draws = sweep.realized(sweep.drawn_lengths(sweep.grouped_cases(rows), 4).withColumn("resets", sweep.independent_resets())).withColumn("bound", sweep.cheapest_cost(steel_floor=20.0))
    found = sweep.priced(draws.select("case_id", "draw", "r"), walls(spark), designs.STEEL, designs.INVALID, None, sweep.PRICES)
    both = {(r["case_id"], r["draw"]): r["bound"] for r in draws.select("case_id", "draw", "bound").collect()}
    costs = {(r["case_id"], r["draw"]): r["cost"] for r in found.collect()}
    assert all(both[k] <= c + 1e-9 for k, c in costs.items())
    limit = whole[-1][2]
    assert sum(b <= limit + 1e-6 for b in both.values()) < len(both) / 2  # most candidates never meet the geometry
    assert key(sweep.sweep(rows.where("case_id < 3"), walls(spark), designs.STEEL, n=2, k=1000)) and not key(sweep.sweep(rows.limit(0), walls(spark), designs.STEEL))


def test_population_search(spark):
    n, d = 3, 4
    bounds = spark.createDataFrame([(s, [-5.0] * d, [5.0] * d, [4.0] * d) for s in range(n)], "search long, lower array<double>, upper array<double>, start array<double>")
    sphere = lambda people: people.withColumn("cost", F.expr("aggregate(genes, 0D, (s, g) -> s + (g - 1) * (g - 1))"))
    best, history = evolve.evolve(bounds, sphere, population=30, generations=12, patience=12, seed=3)
    rows = history.orderBy("search", "generation").collect()
    assert len(rows) == n * 13
    for s in range(n):
        costs = [r["best"] for r in rows if r["search"] == s]
        assert costs == sorted(costs, reverse=True) and costs[0] <= 36.0
    ends = {r["search"]: r for r in best.collect()}
    random = ((np.random.default_rng(1).uniform(-5, 5, (n, 30 * 13, d)) - 1) ** 2).sum(axis=2).min(axis=1)
    assert sorted(ends) == list(range(n)) and all(r["reason"] == "generations" and -5 <= min(r["genes"]) and max(r["genes"]) <= 5 for r in ends.values())
    assert np.mean([r["cost"] for r in ends.values()]) < random.mean() / 2
    again, _ = evolve.evolve(bounds.repartition(3), sphere, population=30, generations=12, patience=12, seed=3)
    assert {r["search"]: r["genes"] for r in again.collect()} == {s: r["genes"] for s, r in ends.items()}


def test_population_stops(spark):
    bounds = spark.createDataFrame([(1, [0.0], [1.0], [0.5]), (2, [0.0], [9.0], [9.0]), (None, [2.0], [2.0], [2.0])], "search long, lower array<double>, upper array<double>, start array<double>")
    flat = lambda people: people.withColumn("cost", F.expr("if(genes[0] > 8.5 AND search = 2, cast(null AS double), if(search = 2, genes[0], 1D))"))
    best, history = evolve.evolve(bounds, flat, population=5, generations=6, patience=2, goal="search = 2 AND cost < 9")
    got = {r["search"]: (r["generation"], r["reason"]) for r in best.collect()}
    assert got[1] == got[None] == (2, "patience") and got[2][1] == "goal"
    assert {r["generation"] for r in history.where("search = 1").collect()} == {0, 1, 2}
    assert [r["reason"] for r in evolve.evolve(bounds, flat, population=1, generations=9, max_seconds=0)[0].collect()] == ["time"] * 3
    assert evolve.evolve(bounds.limit(0), flat)[0].count() == 0


def test_robust_choice_groups_equal_designs(spark):
    found = spark.createDataFrame([("s", 1, "geometry-a", 100.0, 0.10), ("s", 2, "geometry-a", 100.0, 0.10), ("s", 3, "geometry-b", 101.0, 0.30), ("s", 4, "geometry-c", 103.0, 0.40), ("t", 1, "z", 5.0, None), ("t", 2, "y", None, 0.9)], "search string, seed int, print string, cost double, margin double")
    got = [tuple(r) for r in evolve.choose_robust(found).orderBy("search", "place").collect()]
    assert got == [
        ("s", 1, "geometry-a", 100.0, 0.10, 2, [1, 2], ["lowest_predicted_cost", "modal_design"]), ("s", 2, "geometry-b", 101.0, 0.30, 1, [3], ["largest_classifier_margin_within_2pct_of_best"]),
        ("s", 3, "geometry-c", 103.0, 0.40, 1, [4], ["next_lowest_cost_distinct_design"]), ("t", 1, "z", 5.0, None, 1, [1], ["lowest_predicted_cost", "modal_design", "largest_classifier_margin_within_2pct_of_best"])]


def importance_rows(spark, n=80):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, (n, 3)).astype(float)
    y = 3 * x[:, 0] + x[:, 1] + rng.integers(0, 4, n)
    return x, y, spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double").repartition(3)


def donors(spark, n, repeats, seed=61):
    got = spark.range(n).select("id", F.explode(F.array(*map(F.lit, range(repeats)))).alias("r")).withColumn("u", importance.drawn(str(seed), F.col("r"), F.col("id"))).collect()
    return [[r["id"] for r in sorted((g for g in got if g["r"] == k), key=lambda g: (g["u"], g["id"]))] for k in range(repeats)]


@pytest.mark.parametrize("metric", ["mae", "mse", "pandas"])
def test_permutation_importance_against_a_loop(spark, metric):
    x, y, df = importance_rows(spark)
    if metric == "pandas":
        from pyspark.sql.functions import PandasUDFType, pandas_udf

        worst = pandas_udf(lambda t, p: float((t - p).abs().max()), "double", PandasUDFType.GROUPED_AGG)

        measure, how = worst, lambda p: np.abs(y - p).max()
    else:
        measure, how = metric, (lambda p: np.abs(y - p).mean()) if metric == "mae" else (lambda p: ((y - p) ** 2).mean())
    score = lambda x: 3 * x[:, 0] + x[:, 1]
    got = {r["feature"]: r for r in importance.permutation_importance(df, "id", "y", ["a", "b", "c"], "3 * a + b", measure, repeats=4).collect()}
    rises = {}
    for j, f in enumerate("abc"):
        out = []
        for order in donors(spark, len(x), 4):
            z = x.copy()
            z[:, j] = x[order, j]
            out.append(how(score(z)) - how(score(x)))
        rises[f] = np.array(out)
    rank = sorted("abc", key=lambda f: (-rises[f].mean(), f))
    for f, v in rises.items():
        assert [got[f][k] for k in ("mean", "std", "p05", "p95", "positive_share", "rank")] == pytest.approx([v.mean(), v.std(), np.quantile(v, 0.05), np.quantile(v, 0.95), (v > 0).mean(), rank.index(f) + 1])


def test_importance_of_a_fitted_pipeline(spark):
    _, _, df = importance_rows(spark)
    model = models.fit_regressor(df, "y", ["a", "b", "c"], "linear")
    got = importance.permutation_importance(df, "id", "y", ["a", "b", "c"], model, repeats=2).orderBy("rank").collect()
    assert [r["feature"] for r in got][:2] == ["a", "b"]


def test_stability_against_a_loop(spark):
    x, y, df = importance_rows(spark)
    runs, repeats, top = 6, 2, 1
    weights = [[r["w"] for r in spark.range(len(x)).select("id", importance.poisson("boot61", F.lit(b), F.col("id")).alias("w")).orderBy("id").collect()] for b in range(runs)]
    assert 0.7 < np.mean(weights) < 1.3
    score = lambda x: 3 * x[:, 0] + x[:, 1]
    delta = np.zeros((3, runs))
    for j in range(3):
        for order in donors(spark, len(x), repeats):
            z = x.copy()
            z[:, j] = x[order, j]
            for b, w in enumerate(weights):
                delta[j, b] += (np.average(np.abs(y - score(z)), weights=w) - np.average(np.abs(y - score(x)), weights=w)) / repeats
    got = {r["feature"]: r for r in importance.importance_stability(df, "id", "y", ["a", "b", "c"], "3 * a + b", runs=runs, repeats=repeats, top=top).collect()}
    for j, f in enumerate("abc"):
        v = delta[j]
        assert [got[f][k] for k in ("mean", "std", "p05", "positive_share", "top_share")] == pytest.approx([v.mean(), v.std(), np.quantile(v, 0.05), (v > 0).mean(), (delta.argmax(axis=0) == j).mean()])


def test_labels_once_and_failures_as_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    cases = spark.createDataFrame([(i, float(i)) for i in range(20)] + [(3, 3.0), (None, 1.0)], "case_id long, v double")

    def backend(row):
        if row["case_id"] % 5 == 0:
            raise RuntimeError("no")
        return row["v"] if row["case_id"] != 7 else float("nan"), 1.0, row["v"] > 9

    first = {r["case_id"]: r for r in labelling.collect_labels(cases, backend, path, attempts=2).collect()}
    assert sorted(first) == list(range(20)) and {i for i, r in first.items() if r["status"] == "failed"} == {0, 5, 7, 10, 15}
    assert (first[5]["attempts"], first[5]["error"], first[5]["steel"], first[6]["attempts"], first[12]["valid"]) == (2, "RuntimeError: no", None, 1, 1)
    labelling.collect_labels(cases, backend, path)
    assert spark.read.parquet(path).count() == 20
    again = {r["case_id"]: r["status"] for r in labelling.collect_labels(cases, lambda row: (1.0, 1.0, True), path, retry_failed=True).collect()}
    assert set(again.values()) == {"completed"} and spark.read.parquet(path).count() == 25


def test_ranks_over_the_whole_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 9 == 0 else float(v), int(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 5, 200), rng.integers(0, 9, 200), strict=True))]
    got = ranks.in_order(spark.createDataFrame(rows, "id long, v double, w long").repartition(7), [F.col("v").asc_nulls_last(), F.col("id")], {"before": "w"}).collect()
    order, total = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])), 0
    found = {r["_rank"]: r for r in got}
    for k, r in enumerate(order):
        assert (found[k]["id"], found[k]["before"]) == (r[0], total)
        total += r[2]
    assert ranks.in_order(spark.createDataFrame([], "v double"), [F.col("v")]).count() == 0


def test_searching_cases(spark):
    rows = R.frame(spark, SF, "seg").where("case_id < 60")
    best, history = designs.search_cases(rows, walls(spark), population=5, generations=2, patience=5)
    start = {r["case_id"]: r["cost"] for r in sweep.priced(sweep.realized(sweep.grouped_cases(rows).withColumns({"draw": F.lit(0), "value": F.col("lower"), "resets": F.expr("cast(array() AS array<int>)")})).select("case_id", "draw", "r"), walls(spark), designs.STEEL, designs.INVALID, None, sweep.PRICES).collect()}
    got = {r["case_id"]: r for r in best.collect()}
    assert set(got) == set(start) and all(r["cost"] <= start[i] + 1e-9 and len(r["print"]) == 64 and r["generation"] == 2 for i, r in got.items())
    assert history.count() == 3 * len(start)
    many, _ = designs.search_cases(rows, walls(spark), seeds=2, population=3, generations=1)
    chosen = evolve.choose_robust(many, ("case_id",)).collect()
    assert {r["case_id"] for r in chosen} == set(start) and all(set(r["seeds"]) <= {1, 2} for r in chosen)
