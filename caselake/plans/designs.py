"""Whole designs: prediction for user cases, sweeps and population searches over generated candidates, labelling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.operators import casewise, contracts, evolve, importance, labelling, sweep
from caselake.operators.graph import written
from caselake.operators.importance import Scorer, scored
from caselake.plans.relation import Relations


@dataclass(frozen=True)
class Models:
    """What predicts: scorers of steel and of p_invalid over the features, the scaling of the features, and the artifact whose contract must hold."""

    steel: Scorer
    p_invalid: Scorer | None = None
    scaling: dict[str, tuple[float, float]] | None = None
    artifact: DataFrame | None = None


#: What a model of these features must say of itself.
CONTRACT: contracts.Contract = {
    "artifact_format_version": 2, "feature_schema_version": 11, "feature_names": list(casewise.FEATURES), "target_names": ["column_steel_weight"], "target_units": ["kgf"],
    "input_size": len(casewise.FEATURES), "output_size": 1,
}


def case_rows(relations: Relations, seg: DataFrame, walls: DataFrame) -> DataFrame:
    """``casewise.case_table`` for cases of any size: those of over ``AS_ARRAY`` segments go through the relations, if there are any, which one small job tells."""
    large = casewise.large_cases(seg)
    if large.isEmpty():
        return casewise.case_table(seg, walls)
    large = written(large)
    of = relations.over(seg.sparkSession, seg=seg.join(large, "case_id", "left_semi"), walls=walls)
    spread = of("fe_entropy").groupBy("case_id").agg(*[F.coalesce(F.max(F.when(F.col("axis") == d, F.col("span_entropy"))), F.lit(0.0)).alias(f"beams_span_entropy_{d}") for d in "xy"])
    rows = of("ag6_concrete_total").join(of("fd_columns").select("case_id", "columns_count"), "case_id", "left").join(of("fe_columns"), "case_id", "left").join(of("fe_spans"), "case_id", "left").join(spread, "case_id", "left")
    zero = [c for c in casewise.FEATURES if c.startswith("beams_")]
    spans = of("wn3_clear_spans").groupBy("case_id").agg(F.count("*").alias("clear_spans"))
    rows = rows.join(spans, "case_id", "left").withColumn("clear_spans", F.coalesce("clear_spans", F.lit(0)).cast("int"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero} | {"columns_count": F.coalesce("columns_count", F.lit(0).cast("long"))})
    few = casewise.case_table(seg.join(large.withColumnRenamed("case_id", "_case"), F.col("case_id").eqNullSafe(F.col("_case")), "left_anti"), walls)
    return few.unionByName(rows.select(*few.columns))


def column_rows(relations: Relations, seg: DataFrame, walls: DataFrame) -> DataFrame:
    """The part of ``case_rows`` that columns alone decide."""
    if casewise.large_cases(seg).isEmpty():
        return casewise.column_features(casewise.columns(casewise.rectangles(seg)))
    return case_rows(relations, seg, walls)


def refusal(features: tuple[str, ...] = casewise.FEATURES) -> Column:
    """Why a case can't be scored: no columns, or features that are null or not finite; null if it can."""
    odd = F.concat_ws(", ", *[F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(c)) for c in features])
    return F.when(F.coalesce(F.col("columns_count"), F.lit(0)) == 0, "no columns").when(odd != "", F.concat(F.lit("not finite: "), odd))


def predict_cases(relations: Relations, seg: DataFrame, walls: DataFrame, models: Models, contract: contracts.Contract = CONTRACT) -> DataFrame:
    """(case_id, steel, concrete_m3, formwork_m2, p_invalid, reason) of every case of ``seg``, as one lazy plan.

    Geometry, features, their scaling and both scorers follow each other row by row after the one shuffle by case. A case that the gate
    refuses has a reason and nulls for all else. If ``models.artifact`` breaks ``contract``, the plan fails when it is run, with both values.
    """
    rows = case_rows(relations, seg, walls).withColumn("reason", refusal())
    if models.artifact is not None:
        rows = contracts.require_contract(rows, models.artifact, contract, "model")
    scaling = models.scaling or {}
    rows = rows.withColumns({c: F.when(F.col("reason").isNotNull(), 0.0).otherwise((F.col(c) - scaling[c][0]) / scaling[c][1] if c in scaling else F.col(c)) for c in casewise.FEATURES})
    rows = scored(rows, models.steel, "steel")
    rows = scored(rows, models.p_invalid, "p_invalid") if models.p_invalid is not None else rows.withColumn("p_invalid", F.lit(None).cast("double"))
    return rows.select("case_id", *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("steel", "concrete_m3", "formwork_m2", "p_invalid")], "reason")


#: Scorers of the registered queries, as SQL over the features.
STEEL = "20 + 0.05D * columns_total_area_cm2 + 0.01D * columns_max_area_cm2"
INVALID = "least(1D, columns_max_area_cm2 / 8000)"
DRAWS, SEARCH = 3, {"population": 6, "generations": 3, "patience": 2}


def priced_genes(walls: DataFrame, step: float = sweep.STEP) -> Callable[[DataFrame], DataFrame]:
    """The cost of ``evolve`` for group lengths: genes are cut to steps above the seed length, constrained, measured and priced.

    What a design costs hangs on its rectangles alone, which its print tells; designs of one print, in this generation or an earlier one, are measured once.
    """
    seen: list[DataFrame] = []

    def cost(people: DataFrame) -> DataFrame:
        value = F.expr(f"transform(genes, (g, i) -> least(lower[i] + {step} * floor((g - lower[i]) / {step}), upper[i]))")
        rows = sweep.realized(people.withColumn("value", value).withColumn("resets", sweep.independent_resets()))
        print_ = F.sha2(F.array_join(F.expr("transform(r, q -> concat_ws(',', q.x0, q.x1, q.y0, q.y1))"), "|"), 256)
        rows = written(rows.select(*people.columns, casewise.once("r", "r").alias("r")).withColumn("print", print_))
        new = rows.groupBy("print").agg(F.first("r").alias("r"))
        for known in seen:
            new = new.join(known.select("print"), "print", "left_anti")
        found = sweep.priced(new, walls, STEEL, INVALID, None, sweep.PRICES, ("print",))
        seen.append(written(found.select(F.col("print").alias("_print"), "cost", (0.5 - F.col("p_invalid")).alias("margin"))).withColumnRenamed("_print", "print"))
        every = seen[0]
        for more in seen[1:]:
            every = every.unionByName(more)
        return rows.drop("r").join(every, "print", "left").select(*people.columns, "print", "cost", "margin")

    return cost


def search_cases(seg: DataFrame, walls: DataFrame, seeds: int = 1, **how) -> tuple[DataFrame, DataFrame]:
    """``evolve`` of the group lengths of every case, under each of ``seeds`` seeds: a search for each (case_id, seed), all at once."""
    cases = written(sweep.grouped_cases(seg.where("case_id IS NOT NULL"))).withColumn("start", F.col("lower"))
    if seeds == 1:
        return evolve.evolve(cases, priced_genes(walls), ("case_id",), **how)
    many = cases.withColumnRenamed("case_id", "case").withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds)))).withColumn("case_id", F.struct("case", "seed"))
    best, history = evolve.evolve(many.drop("case", "seed"), priced_genes(walls), ("case_id",), **how)
    return tuple(d.select("case_id.*", *[c for c in d.columns if c != "case_id"]).withColumnRenamed("case", "case_id") for d in (best, history))


def backend(row: dict) -> tuple[float, float, bool]:
    """A stand-in for an analysis: the formula of the scorers; it fails for one case in 97."""
    if row["case_id"] % 97 == 0:
        raise RuntimeError("no convergence")
    return 20 + 0.05 * row["columns_total_area_cm2"], row["concrete_m3"], row["columns_max_area_cm2"] < 4000


def _unrounded(text: str) -> str:
    """SQL without its ``round(what, digits)``."""
    while (at := text.find("round(")) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}({text[at + 6 : end - 1].rpartition(',')[0]}){text[end:]}"
    return text


def make(r: Relations) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries of this module over the given tables, and their SQL."""
    base = lambda spark, sf_dir: (r.frame(spark, sf_dir, "seg"), r.frame(spark, sf_dir, "walls"))
    # These are made in one pass over the cases; the relations of the same names are what larger cases and the check go by.
    named = [c for c in casewise.FEATURES if not c.startswith("beams_")]
    exact_ = lambda c: F.col(c) if c in ("columns_min_area_cm2", "columns_max_area_cm2") else F.round(c, 8) if c.endswith("cm2") or c.startswith("inertia_sum") else F.round(c, 9 if c.endswith('balance') else 12) + 0.0
    r.at_once("ag6_concrete_total", ("seg", "walls"), lambda seg, walls: case_rows(r, seg, walls).select("case_id", F.round("concrete_m3", 6).alias("concrete_m3"), F.round("formwork_m2", 6).alias("formwork_m2")))
    r.at_once("fe_columns", ("seg", "walls"), lambda seg, walls: column_rows(r, seg, walls).where("columns_count > 0").select("case_id", *[exact_(c).alias(c) for c in named]))
    beam = {c: f"round({c}, 9)" if "_std_" in c else c for c in casewise.FEATURES if c.startswith("beams_") and "entropy" not in c}
    r.at_once("fe_spans", ("seg", "walls"), lambda seg, walls: case_rows(r, seg, walls).where("clear_spans > 0").selectExpr("case_id", *[f"{e} AS {c}" for c, e in beam.items()]))
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}

    def ml9(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = predict_cases(r, *base(spark, sf_dir), Models(STEEL, INVALID))
        return got.select("case_id", *[F.round(c, 4).alias(c) for c in ("steel", "concrete_m3", "formwork_m2", "p_invalid")], "reason")

    q["ml9_predict_cases"] = ml9
    sql["ml9_predict_cases"] = r.duckdb("ag6_concrete_total", final=f"""SELECT t.case_id, round({STEEL.replace('D', 'E0')}, 4) AS steel, round(concrete_m3, 4) AS concrete_m3, round(formwork_m2, 4) AS formwork_m2, round({INVALID.replace('1D', '1E0')}, 4) AS p_invalid,
  CASE WHEN columns_total_area_cm2 IS NULL THEN 'no columns' END AS reason FROM {{ag6_concrete_total}} t LEFT JOIN {{fe_columns}} f ON t.case_id = f.case_id""")

    def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = case_rows(r, *base(spark, sf_dir)).withColumn("refused", refusal())
        return rows.select("case_id", *[(F.round(c, 9 if c.endswith('balance') else 12) + 0.0).alias(c) for c in casewise.FEATURES], "refused")

    q["fe_vector"] = vector
    exact = Relations()
    exact.text = dict(r.text) | {n: _unrounded(r.text[n]) for n in ("ag2_rect_union", "ag3_inertia", "fe_columns", "fe_spans", "fe_entropy")}
    entropy = "(SELECT case_id, " + ", ".join(f"max(CASE WHEN axis = '{d}' THEN span_entropy END) AS beams_span_entropy_{d}" for d in "xy") + " FROM {fe_entropy} GROUP BY case_id)"
    made = ", ".join(f"round({f'coalesce({c}, 0)' if c.startswith('beams_') else c}, {9 if c.endswith('balance') else 12}) + 0.0E0 AS {c}" for c in casewise.FEATURES)
    finite = " AND ".join(f"{c} - {c} = 0" for c in casewise.FEATURES if c.startswith(("columns_", "inertia_", "column_")))
    sql["fe_vector"] = exact.duckdb("fe_columns", final=f"""SELECT t.case_id, {made}, CASE WHEN columns_total_area_cm2 IS NULL THEN 'no columns' WHEN NOT ({finite}) THEN 'not finite' END AS refused
FROM (SELECT DISTINCT case_id FROM {{seg}}) t LEFT JOIN {{fe_columns}} f ON t.case_id = f.case_id LEFT JOIN {{fe_spans}} s ON t.case_id = s.case_id LEFT JOIN {entropy} e ON t.case_id = e.case_id""")

    q["sm13_candidates"] = lambda spark, sf_dir: sweep.sweep(*base(spark, sf_dir), STEEL, INVALID, n=DRAWS, steel_floor=20.0).select("case_id", "draw", *[F.round(c, 4).alias(c) for c in ("cost", "steel", "concrete_m3", "formwork_m2", "p_invalid")])
    values = ", ".join(f"({k})" for k in range(DRAWS))
    u = lambda k: f"@u('{k}:' || CAST(case_id AS STRING) || ':' || group_key || ':' || CAST(draw AS STRING))"
    vectors = f"""SELECT case_id, group_key, draw, lower, CASE WHEN upper - lower >= 5 AND {u(51)} < 0.7 THEN lower + 5 * (1 + floor({u(52)} * floor((upper - lower) / 5))) ELSE lower END AS value FROM {{ag8_group_bounds}} CROSS JOIN (SELECT * FROM (VALUES {values}) AS v(draw)) n"""
    resets = f"""SELECT DISTINCT p.case_id, x.draw, CASE WHEN x.value - x.lower >= y.value - y.lower THEN p.y_group ELSE p.x_group END AS reset_group FROM {{jn2_conflict_pairs}} p JOIN ({vectors}) x ON p.case_id = x.case_id AND p.x_group = x.group_key JOIN ({vectors}) y ON p.case_id = y.case_id AND p.y_group = y.group_key AND x.draw = y.draw"""
    seg = f"""SELECT s.case_id * {DRAWS} + v.draw AS case_id, s.seg_idx, s.x, s.y, s.dx, s.dy, CASE WHEN z.reset_group IS NULL THEN v.value ELSE s.length END AS length, s.maxlength, s.group_id
FROM {{seg}} s JOIN {{fn3_group_key}} k ON s.case_id = k.case_id AND s.seg_idx = k.seg_idx JOIN ({vectors}) v ON k.case_id = v.case_id AND k.group_key = v.group_key
LEFT JOIN ({resets}) z ON z.case_id = k.case_id AND z.draw = v.draw AND z.reset_group = k.group_key"""
    sql["sm13_candidates"] = r.duckdb("ag6_concrete_total", {"seg": seg}, f"""
SELECT case_id // {DRAWS} AS case_id, CAST(case_id % {DRAWS} AS INTEGER) AS draw, round(cost, 4) AS cost, round(steel, 4) AS steel, round(concrete_m3, 4) AS concrete_m3, round(formwork_m2, 4) AS formwork_m2, round(p_invalid, 4) AS p_invalid FROM (
  SELECT *, 12 * steel + 450 * concrete_m3 + 70 * formwork_m2 + CASE WHEN p_invalid >= 0.5 THEN 1e6 ELSE 0 END AS cost FROM (
    SELECT t.case_id, concrete_m3, formwork_m2, {STEEL.replace('D', 'E0')} AS steel, {INVALID.replace('1D', '1E0')} AS p_invalid FROM {{ag6_concrete_total_c}} t JOIN {{fe_columns_c}} f ON t.case_id = f.case_id))
ORDER BY round(cost, 6), case_id LIMIT 100""")

    def sm14(spark: SparkSession, sf_dir: str) -> DataFrame:
        best, _ = search_cases(*base(spark, sf_dir), **SEARCH)
        return best.select("case_id", "generation", "reason", F.round("cost", 4).alias("cost"), "genes", "print")

    q["sm14_population"] = sm14

    def sm15(spark: SparkSession, sf_dir: str) -> DataFrame:
        best, _ = search_cases(*base(spark, sf_dir), seeds=3, **SEARCH | {"generations": 1})
        return evolve.choose_robust(best, ("case_id",)).withColumn("cost", F.round("cost", 4))

    q["sm15_many_seeds"] = sm15

    found = "SELECT o_custkey AS search, CAST(o_orderkey % 5 AS BIGINT) AS seed, o_orderstatus || CAST(o_orderkey % 3 AS STRING) AS print, CAST(floor(o_totalprice / 1000) AS BIGINT) AS cost, o_orderkey % 11 AS margin FROM {orders}"
    r.add("found_designs", found)
    q["tk6_robust_choice"] = lambda spark, sf_dir: evolve.choose_robust(r.frame(spark, sf_dir, "found_designs")).select("search", "place", "print", "cost", "margin", "frequency", F.array_join("seeds", ",").alias("seeds"), F.array_join("roles", ",").alias("roles"))
    role = " || ".join(f"CASE WHEN r{k} THEN '{n},' ELSE '' END" for k, n in enumerate(evolve.ROLES))
    sql["tk6_robust_choice"] = r.duckdb("found_designs", final=f"""
SELECT search, CAST(row_number() OVER (PARTITION BY search ORDER BY CASE WHEN r0 THEN 0 WHEN r1 THEN 1 WHEN r2 THEN 2 ELSE 3 END) AS INTEGER) AS place, print, cost, margin, frequency, seeds, rtrim({role}, ',') AS roles FROM (
  SELECT *, NOT (r0 OR r1 OR r2) AND row_number() OVER (PARTITION BY search ORDER BY r0 OR r1 OR r2, cost, print) = 1 AS r3 FROM (
    SELECT *, row_number() OVER (PARTITION BY search ORDER BY cost, print) = 1 AS r0, row_number() OVER (PARTITION BY search ORDER BY frequency DESC, cost, print) = 1 AS r1,
      row_number() OVER (PARTITION BY search ORDER BY cost <= low + 0.02 * abs(low) DESC, margin DESC, cost, print) = 1 AS r2 FROM (
      SELECT search, print, min(cost) AS cost, arg_min(margin, cost * 1e6 + seed * 1e3 + margin) AS margin, count(*) AS frequency, string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds, min(min(cost)) OVER (PARTITION BY search) AS low FROM {{found_designs}} GROUP BY search, print)))
WHERE r0 OR r1 OR r2 OR r3""")

    def ud4(spark: SparkSession, sf_dir: str) -> DataFrame:
        return labelling.label_cases(case_rows(r, *base(spark, sf_dir)).where("columns_count > 0"), backend, attempts=2).select("case_id", "status", "attempts", F.round("steel", 4).alias("steel"), F.round("concrete", 4).alias("concrete"), "valid", "error")

    q["ud4_label_cases"] = ud4
    fails = "t.case_id % 97 = 0"
    sql["ud4_label_cases"] = r.duckdb("ag6_concrete_total", final=f"""
SELECT t.case_id, CASE WHEN {fails} THEN 'failed' ELSE 'completed' END AS status, CASE WHEN {fails} THEN 2 ELSE 1 END AS attempts, CASE WHEN NOT {fails} THEN round(20 + 0.05E0 * columns_total_area_cm2, 4) END AS steel,
  CASE WHEN NOT {fails} THEN round(concrete_m3, 4) END AS concrete, CASE WHEN NOT {fails} THEN CASE WHEN columns_max_area_cm2 < 4000 THEN 1 ELSE 0 END END AS valid, CASE WHEN {fails} THEN 'RuntimeError: no convergence' END AS error
FROM {{ag6_concrete_total}} t JOIN {{fe_columns}} f ON t.case_id = f.case_id""")

    # The sequential constraint, and what it makes of a draw.
    def sm3a(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sweep.drawn_lengths(sweep.grouped_cases(base(spark, sf_dir)[0]), 1).withColumn("resets", sweep.sequential_resets())
        return rows.select("case_id", F.explode(F.expr("arrays_zip(groups, transform(value, (v, i) -> if(array_contains(resets, i), lower[i], v)))")).alias("z")).select("case_id", F.col("z.groups").alias("group_key"), F.col("z.1").alias("value"))

    q["sm3a_sequential_constraint"] = sm3a
    first = "(SELECT case_id, group_key, min(seg_idx) AS f FROM {fn3_group_key} GROUP BY case_id, group_key)"
    u1 = lambda k: f"@u('{k}:' || CAST(case_id AS STRING) || ':' || group_key || ':0')"
    r.add("sm3a_vectors", f"SELECT case_id, group_key, lower, CASE WHEN upper - lower >= 5 AND {u1(51)} < 0.7 THEN lower + 5 * (1 + floor({u1(52)} * floor((upper - lower) / 5))) ELSE lower END AS value FROM {{ag8_group_bounds}}")
    r.add("sm3a_pairs", f"SELECT p.case_id, x_group, y_group, row_number() OVER (PARTITION BY p.case_id ORDER BY a.f, b.f) AS k FROM {{jn2_conflict_pairs}} p JOIN {first} a ON p.case_id = a.case_id AND p.x_group = a.group_key JOIN {first} b ON p.case_id = b.case_id AND p.y_group = b.group_key")
    r.add("sm3a_fold", """
WITH RECURSIVE fold(case_id, k, v) AS (
  SELECT case_id, CAST(0 AS BIGINT), map_from_entries(list(row(group_key, value - lower))) FROM {sm3a_vectors} GROUP BY case_id
  UNION ALL SELECT f.case_id, f.k + 1, map_concat(f.v, map([CASE WHEN f.v[p.x_group] >= f.v[p.y_group] THEN p.y_group ELSE p.x_group END], [CAST(0 AS DOUBLE)])) FROM fold f JOIN {sm3a_pairs} p ON p.case_id = f.case_id AND p.k = f.k + 1
) SELECT case_id, arg_max(v, k) AS v FROM fold GROUP BY case_id""")
    sql["sm3a_sequential_constraint"] = r.duckdb("sm3a_fold", final="SELECT v.case_id, v.group_key, v.lower + f.v[v.group_key] AS value FROM {sm3a_vectors} v JOIN {sm3a_fold} f ON v.case_id = f.case_id")

    # Contracts of artifacts, as a table of orders has them.
    r.add("artifacts", """
SELECT o_orderkey AS artifact_id, CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 2 END AS format_version, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS INT) END AS schema_version,
  CASE WHEN o_custkey % 4 = 0 THEN '["b","a"]' ELSE '["a","b"]' END AS names_json, o_orderstatus AS unit FROM {orders}""")
    contract = {"format_version": 2, "schema_version": 1, "names": ["a", "b"], "unit": "F", "input_size": 2}

    def sp7(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = r.frame(spark, sf_dir, "artifacts").withColumn("names", F.from_json("names_json", "array<string>"))
        return contracts.contract_problems(rows, contract, "artifact_id", soft=["unit"])

    q["sp7_contract"] = sp7
    field = lambda name, found, expected, hard: f"SELECT artifact_id, '{name}' AS field, {found} AS found, '{expected}' AS expected, {hard} AS hard FROM {{artifacts}}"
    sql["sp7_contract"] = r.duckdb("artifacts", final="SELECT artifact_id, field, CASE WHEN found IS NULL THEN 'missing' ELSE 'mismatch' END AS problem, found, expected, hard FROM (" + " UNION ALL ".join([
        field("format_version", "CAST(format_version AS STRING)", "2", "true"), field("schema_version", "CAST(schema_version AS STRING)", "1", "true"), field("names", "names_json", '["a","b"]', "true"),
        field("unit", "'\"' || unit || '\"'", '"F"', "false"), field("input_size", "CAST(NULL AS STRING)", "2", "true")]) + ") WHERE found IS DISTINCT FROM expected")

    # Importance of four whole-number features under a linear scorer; sums of whole numbers are exact in any order.
    r.add("importance_rows", "SELECT o_orderkey AS id, CAST(o_custkey % 50 AS DOUBLE) AS a, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS b, CAST(length(o_orderpriority) AS DOUBLE) AS c, CAST(o_orderkey % 9 AS DOUBLE) AS d, CAST(2 * (o_custkey % 50) + floor(o_totalprice / 1000) + o_orderkey % 4 AS DOUBLE) AS y FROM {orders}")
    names, score = ("a", "b", "c", "d"), "2 * a + b + 3 * c - d"
    q["ml11_importance"] = lambda spark, sf_dir: importance.permutation_importance(r.frame(spark, sf_dir, "importance_rows"), "id", "y", names, score, "mae", repeats=3).select("feature", "rank", "positive_share", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "p05", "p95")])
    copy = lambda f: ", ".join(f"d.{c}" if c == f else f"o.{c}" for c in names)
    swap = lambda f: score if not f else " ".join({"a": "2 * {}.a", "b": "+ {}.b", "c": "+ 3 * {}.c", "d": "- {}.d"}[c].format("w" if c == f else "o") for c in names)
    r.add("importance_own", "SELECT *, row_number() OVER (ORDER BY id) AS k FROM {importance_rows}")
    r.add("importance_drawn", "SELECT *, row_number() OVER (PARTITION BY rep ORDER BY @u('61:' || CAST(rep AS STRING) || ':' || CAST(id AS STRING)), id) AS k FROM {importance_rows} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS v(rep)) r")
    met = " UNION ALL ".join(f"SELECT '{f}' AS feature, rep, avg(abs({swap(f)} - o.y)) AS m FROM {{importance_own}} o JOIN {{importance_drawn}} w ON o.k = w.k GROUP BY rep" for f in names)
    sql["ml11_importance"] = r.duckdb("importance_own", final=f"""
SELECT feature, CAST(row_number() OVER (ORDER BY mean DESC, feature) AS INTEGER) AS rank, positive_share, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(p05, 6) AS p05, round(p95, 6) AS p95 FROM (
  SELECT feature, avg(d) AS mean, stddev_pop(d) AS std, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.05) AS p05, quantile_cont(d, 0.95) AS p95, avg(CASE WHEN d > 0 THEN 1.0E0 ELSE 0.0E0 END) AS positive_share FROM (
    SELECT feature, m - (SELECT avg(abs({score} - y)) FROM {{importance_rows}}) AS d FROM ({met})) GROUP BY feature)""")
    q["ml13_stability"] = lambda spark, sf_dir: importance.importance_stability(r.frame(spark, sf_dir, "importance_rows"), "id", "y", names, score, "abs", runs=10, repeats=2, top=2).select("feature", "rank", "top_share", "positive_share", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "p05", "p95")])
    return q, sql
