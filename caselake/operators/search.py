"""Candidate generation, constraint, cost and choice; draws are keyed uniforms, the same in any engine and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.operators.ranks import in_order
from caselake.plans.relation import Relations

#: Valid rows that a collection is after.
TARGET = 2000


def _ledger(attempts: DataFrame, usable: str) -> DataFrame:
    rows = attempts.withColumns({"valid": F.expr(f"CASE WHEN {usable} AND status = 'completed' THEN 1 ELSE 0 END"), "usable": F.expr(f"CASE WHEN {usable} THEN 1 ELSE 0 END")})
    return in_order(rows, [F.col("sequence"), F.col("candidate_id")], {"valid_before": "valid"}).withColumn("attempt", F.col("_rank") + 1).drop("_rank")


def define(r: Relations) -> None:
    r.add("vectors", """
SELECT b.case_id, b.group_key, b.lower, b.upper, CASE WHEN upper - lower >= 5 AND @u('11:' || CAST(b.case_id AS STRING) || ':' || b.group_key) < 0.7
  THEN lower + 5 * (1 + floor(@u('12:' || CAST(b.case_id AS STRING) || ':' || b.group_key) * floor((upper - lower) / 5))) ELSE lower END AS value FROM {ag8_group_bounds} b""")
    r.add("sm1_variations", "SELECT case_id, group_key, value, value - lower AS deviation FROM {vectors}")
    r.add("sm2_upper_biased", """
SELECT case_id, group_key, CASE WHEN steps >= 1 THEN lower + 5 * (greatest(1, ceil(steps / 2)) + floor(@u('13:' || CAST(case_id AS STRING) || ':' || group_key) * (steps - greatest(1, ceil(steps / 2)) + 1))) ELSE lower END AS value
FROM (SELECT *, floor((upper - lower) / 5) AS steps FROM {ag8_group_bounds})""")
    r.add("sm3_rectangular_constraint", """
SELECT v.case_id, v.group_key, CASE WHEN max(CASE WHEN c.reset_group = v.group_key THEN 1 ELSE 0 END) = 1 THEN min(v.lower) ELSE min(v.value) END AS value FROM {vectors} v
LEFT JOIN (SELECT p.case_id, CASE WHEN x.value - x.lower < y.value - y.lower THEN p.x_group ELSE p.y_group END AS reset_group FROM {jn2_conflict_pairs} p
  JOIN {vectors} x ON p.case_id = x.case_id AND p.x_group = x.group_key JOIN {vectors} y ON p.case_id = y.case_id AND p.y_group = y.group_key) c
ON v.case_id = c.case_id AND v.group_key = c.reset_group GROUP BY v.case_id, v.group_key""")
    r.add("sm3_resets", """
SELECT DISTINCT p.case_id, CASE WHEN x.value - x.lower < y.value - y.lower THEN p.x_group ELSE p.y_group END AS reset_group FROM {jn2_conflict_pairs} p
JOIN {vectors} x ON p.case_id = x.case_id AND p.x_group = x.group_key JOIN {vectors} y ON p.case_id = y.case_id AND p.y_group = y.group_key""")
    # A group that is reset has its segments' own lengths again.
    r.add("jn5_apply_vectors", """
SELECT s.case_id, s.seg_idx, s.group_key, CASE WHEN z.reset_group IS NULL THEN v.value ELSE s.length END AS length FROM {fn3_group_key} s JOIN {vectors} v ON s.case_id = v.case_id AND s.group_key = v.group_key
LEFT JOIN {sm3_resets} z ON s.case_id = z.case_id AND s.group_key = z.reset_group""")
    r.add("sm11_realize", "SELECT s.case_id, s.seg_idx, s.x, s.y, s.x + s.dx * v.length AS x1, s.y + s.dy * v.length AS y1 FROM {seg} s JOIN {jn5_apply_vectors} v ON s.case_id = v.case_id AND s.seg_idx = v.seg_idx")
    r.add("fn8_discretize", "SELECT idx, least(greatest(@rint((y / 1000) / 5) * 5, 12), 401) AS stepped FROM {reg}")
    r.add("sm4_pilot_plan", "SELECT case_id, group_key, lower AS minimum, lower + floor((upper - lower) / 2 / 5) * 5 AS midpoint, upper AS maximum FROM {ag8_group_bounds}")
    r.add("sm5_latin_hypercube", """
SELECT case_id, group_key, draw, lower + floor((stratum + @u('21:' || CAST(case_id AS STRING) || ':' || group_key || ':' || CAST(draw AS STRING))) / 4 * (upper - lower) / 5) * 5 AS value FROM (
  SELECT b.*, n.draw, row_number() OVER (PARTITION BY case_id, group_key ORDER BY @u('20:' || CAST(case_id AS STRING) || ':' || group_key || ':' || CAST(draw AS STRING)), draw) - 1 AS stratum
  FROM {ag8_group_bounds} b CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(draw)) n)""")
    r.add("sm10_flip_flags", "SELECT idx, valid, CASE WHEN @u('31:' || CAST(idx AS STRING)) < 0.05 THEN 1 - valid ELSE valid END AS flag FROM {clf}")
    r.add("sm12_cost", """
SELECT case_id, CASE WHEN steel IS NULL OR concrete_m3 IS NULL OR formwork_m2 IS NULL THEN CAST('Infinity' AS DOUBLE) ELSE round(12 * steel + 450 * concrete_m3 + 70 * formwork_m2
  + CASE WHEN p_invalid >= 0.5 THEN 1e6 ELSE 0 END + CASE WHEN least(steel, concrete_m3, formwork_m2) < 0 THEN 1e6 ELSE 0 END, 4) END AS cost FROM (
  SELECT t.case_id, concrete_m3, formwork_m2, 20 + 0.05E0 * columns_total_area_cm2 + 0.01E0 * columns_max_area_cm2 AS steel, least(1E0, columns_max_area_cm2 / 8000) AS p_invalid FROM {ag6_concrete_total} t LEFT JOIN {fe_columns} f ON t.case_id = f.case_id)""")
    r.add("sm13_sweep", "SELECT case_id, cost FROM {sm12_cost} ORDER BY cost, case_id LIMIT 100")
    r.add("tk4_cheapest", "SELECT min(cost) AS cost, min_by(case_id, @pair(cost, case_id)) AS case_id FROM {sm12_cost}")
    r.add("tk3_top_n", "SELECT idx, abs(yhat - y) AS err FROM {reg} ORDER BY abs(yhat - y) DESC, idx LIMIT 20")
    r.add("attempts", "SELECT o_orderkey AS candidate_id, o_orderkey AS sequence, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'protected' ELSE 'development' END AS role, o_totalprice AS steel FROM {orders}")
    r.add("jn6_pending", "SELECT c.candidate_id, c.sequence FROM {attempts} c LEFT ANTI JOIN (SELECT candidate_id FROM {attempts} WHERE status IN ('completed', 'failed')) d ON c.candidate_id = d.candidate_id WHERE role <> 'protected'".replace("LEFT ANTI JOIN", "ANTI JOIN"))
    r.add("ag11_role_summary", "SELECT role, count(*) AS n, count(CASE WHEN status <> 'pending' THEN 1 END) AS processed, count(CASE WHEN status = 'completed' THEN 1 END) AS valid, count(CASE WHEN status = 'failed' THEN 1 END) AS invalid FROM {attempts} GROUP BY role")
    r.add("sm9_assign_roles", "SELECT candidate_id, CASE WHEN row_number() OVER (PARTITION BY status, candidate_id % 100 ORDER BY candidate_id) % 5 = 1 THEN 'protected' ELSE 'development' END AS role FROM {attempts}")
    # A collection goes on until it has TARGET valid rows, and for five times as many attempts at most; valid rows feed the regression, all usable ones the classifier.
    usable = "status IN ('completed', 'failed') AND steel > 0"
    r.add("ledger_rows", f"""SELECT *, coalesce(sum(valid) OVER (ORDER BY sequence, candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS valid_before, row_number() OVER (ORDER BY sequence, candidate_id) AS attempt FROM (
  SELECT *, CASE WHEN {usable} AND status = 'completed' THEN 1 ELSE 0 END AS valid, CASE WHEN {usable} THEN 1 ELSE 0 END AS usable FROM {{attempts}})""", lambda attempts: _ledger(attempts, usable))
    r.add("sm16_ledger", f"SELECT CAST(sum(valid) AS BIGINT) AS regression_rows, CAST(sum(usable) AS BIGINT) AS classifier_rows, count(*) AS attempts FROM {{ledger_rows}} WHERE valid_before < {TARGET} AND attempt <= 5 * {TARGET}")
    r.add("jn11_leakage", "SELECT count(*) AS shared FROM (SELECT q, p, d, t FROM {mat} JOIN {sp1_split_regression} s ON k1 = s.idx WHERE part = 'train' INTERSECT SELECT q, p, d, t FROM {mat} JOIN {sp1_split_regression} s ON k1 = s.idx WHERE part = 'test')")
    # Stored features against the same ones made again: here every tenth row was stored with an error of a billionth, the others with less than the tolerance.
    r.add("stored_rows", "SELECT k1, score AS made, CASE WHEN k1 % 10 = 0 THEN score * (1 + 1E-9) ELSE score + 1E-9 END AS stored FROM {mat}")
    r.add("jn12_all_close", "SELECT count(*) AS n, count(CASE WHEN abs(stored - made) <= 1E-8 + 1E-10 * abs(made) THEN 1 END) AS close, max(abs(stored - made)) <= 1E-5 AS near FROM {stored_rows}")
    # Every feature belongs to one of the named groups, and groups name features alone.
    r.add("feature_names", "SELECT DISTINCT p_brand AS name FROM {part} WHERE p_size > 2")
    r.add("feature_groups", "SELECT DISTINCT p_type AS grp, p_brand AS name FROM {part} WHERE p_size < 6")
    r.add("sp9_group_coverage", """
SELECT coalesce(f.name, g.name) AS name, CASE WHEN g.name IS NULL THEN 'ungrouped' WHEN f.name IS NULL THEN 'unknown' ELSE 'in several groups' END AS problem, coalesce(g.n, 0) AS n_groups
FROM {feature_names} f FULL OUTER JOIN (SELECT name, count(*) AS n FROM {feature_groups} GROUP BY name) g ON f.name = g.name WHERE g.name IS NULL OR f.name IS NULL OR g.n > 1""")
