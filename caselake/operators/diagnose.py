"""Ranks over whole tables, bootstraps, diagnostics and paired comparisons.

A rank over a whole table is a rank inside a bucket plus the rows of all buckets before it, so no task holds the
table. A bootstrap draws Poisson(1) weights for each row and replicate, keyed by both: it needs no join, and
what it weighs is summed by the task that draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from caselake.operators.bootstrap import weighted_sums
from caselake.operators.evaluate import add_rank
from caselake.operators.splits import choose_by_bins
from caselake.plans.relation import Relations

#: Cumulative Poisson(1) up to 7; the rest counts as 8.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)

#: Coefficients of a published rational approximation of the normal quantile (relative error 1e-9).
CENTRE = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0), (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
TAIL = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343773e0, 4.374664141464968e0, 2.938163982698783e0), (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0)

#: Fixed value: 0.975 quantile of chi-square with two degrees of freedom.
CHI2_975_2 = 7.377758908227871


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]:.16E}"
    for c in coefficients[1:]:
        out = f"(({out}) * {x} + {c:.16E})"
    return out


def normal_quantile(p: str) -> str:
    """SQL of the normal quantile of a probability strictly between 0 and 1."""
    q, r = f"({p} - 0.5E0)", f"(({p} - 0.5E0) * ({p} - 0.5E0))"
    tail = lambda v: f"{_poly(TAIL[0], v)} / {_poly(TAIL[1], v)}"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"CASE WHEN {p} < 0.02425E0 THEN {tail(low)} WHEN {p} > 0.97575E0 THEN -({tail(high)}) ELSE {_poly(CENTRE[0], r)} * {q} / {_poly(CENTRE[1], r)} END"


def weight(u: str) -> str:
    return "CASE " + " ".join(f"WHEN {u} < {c}E0 THEN {k}" for k, c in enumerate(POISSON)) + " ELSE 8 END"


def replicates(reg: DataFrame, sp1_split_regression: DataFrame) -> DataFrame:
    """The relation of this name, its weights drawn and summed in one pass over the test rows."""
    test = reg.join(sp1_split_regression.where("part = 'test'").select("idx"), "idx")
    values = {"e": "abs(yhat - y)", "ee": "(yhat - y) * (yhat - y)", "yy": "y * y", "ys": "y", "c": "abs(yhat * 0.98E0 - y) - abs(yhat - y)"}
    sums = weighted_sums(test.selectExpr("idx", *[f"{e} AS {n}" for n, e in values.items()]), "idx", list(values), 1000, "71", POISSON)
    return sums.selectExpr("replicate", "e / w AS mae", "sqrt(ee / w) AS rmse", "1 - ee / (yy - ys * ys / w) AS r2", "c / w AS challenge")


def define(r: Relations) -> None:
    r.add("resid", "SELECT idx, y, yhat, @round2(y - yhat) AS e FROM {reg}")
    add_rank(r, "wn9_global_rank", "reg", "y, idx", "idx, y")
    add_rank(r, "resid_rank", "resid", "e, idx", "idx, e")
    add_rank(r, "by_idx", "mat_rows", "k1, k2, k3, k4, p", "k1, k2, k3, k4, q, p, score")
    r.add("mat_rows", "SELECT *, @u('61:' || CAST(k1 AS STRING) || ':' || CAST(k2 AS STRING) || ':' || CAST(k3 AS STRING) || ':' || CAST(k4 AS STRING) || ':' || CAST(CAST(round(p * 100) AS BIGINT) AS STRING)) AS u FROM {mat}")
    add_rank(r, "by_draw", "mat_rows", "u, k1, k2, k3, k4, p", "q")
    r.add("wn8_rank_strata", "SELECT idx, y, CAST(floor((rk - 1) * 10 / total) AS BIGINT) AS stratum FROM {wn9_global_rank}")
    r.add("wn10_ecdf", "SELECT y, round(upto / CAST(total AS DOUBLE), 9) AS share FROM (SELECT y, max(rk) AS upto, max(total) AS total FROM {wn9_global_rank} GROUP BY y)")
    r.add("wn12_interleave", "SELECT o_orderkey AS case_id, repeat, CAST((repeat - 1) * (SELECT count(*) FROM {orders}) AS BIGINT) + rk AS sequence FROM (SELECT idx AS o_orderkey, rk FROM {wn9_global_rank}) c CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3)) AS v(repeat)) s")
    r.add("tk2_spaced_order_stats", """
SELECT idx, y, CAST(rk AS BIGINT) AS rk FROM {wn9_global_rank} JOIN (SELECT DISTINCT CAST(floor(1 + g * (total - 1) / 9.0E0) AS BIGINT) AS pick FROM (SELECT max(total) AS total FROM {wn9_global_rank}) t CROSS JOIN (SELECT @series(0, 9) AS g) s) w ON rk = pick""")
    r.add("jn10_permute", "SELECT a.k1, a.k2, a.k3, a.k4, a.p, a.q, b.q AS permuted_q, a.score FROM {by_idx} a JOIN {by_draw} b ON a.rk = b.rk")
    r.add("ml11_permutation_importance", "SELECT round(avg(abs(3 * (permuted_q - q))), 4) AS mae_rise, round(avg(9 * (permuted_q - q) * (permuted_q - q)), 2) AS mse_rise FROM {jn10_permute}")
    r.add("ml16_pick_weight", """
SELECT min_by(w, @pair(targeted, w)) AS weight FROM (SELECT w, avg(abs(yhat * (1 + 0.001E0 * w) - y)) AS mae, avg(CASE WHEN band = '1-URGENT' THEN abs(yhat * (1 + 0.002E0 * w) - y) END) AS targeted, avg(abs(yhat - y)) AS base
  FROM {reg} CROSS JOIN (SELECT * FROM (VALUES (-3), (-2), (-1), (0), (1), (2), (3)) AS v(w)) s GROUP BY w) WHERE mae <= base * 1.0000001E0""")
    # Bootstraps on the test part, 1000 replicates.
    r.add("sp12_bootstrap_weights", f"""
SELECT idx, y, yhat, replicate, w FROM (SELECT t.idx, t.y, t.yhat, g AS replicate, {weight("@u('71:' || CAST(g AS STRING) || ':' || CAST(t.idx AS STRING))")} AS w
  FROM (SELECT r.idx, r.y, r.yhat FROM {{reg}} r JOIN {{sp1_split_regression}} s ON r.idx = s.idx WHERE part = 'test') t CROSS JOIN (SELECT @series(1, 1000) AS g) s) WHERE w > 0""")
    r.add("replicates", """
SELECT replicate, sum(w * abs(yhat - y)) / sum(w) AS mae, sqrt(sum(w * (yhat - y) * (yhat - y)) / sum(w)) AS rmse, 1 - sum(w * (yhat - y) * (yhat - y)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)) AS r2,
  sum(w * (abs(yhat * 0.98E0 - y) - abs(yhat - y))) / sum(w) AS challenge FROM {sp12_bootstrap_weights} GROUP BY replicate""")
    r.at_once("replicates", ("reg", "sp1_split_regression"), replicates)
    both = lambda c, k: f"round(@pctl({c}, 0.025), {k}) AS {c}_low, round(@pctl({c}, 0.975), {k}) AS {c}_high"
    r.add("ev8_bootstrap_ci", f"SELECT {both('mae', 2)}, {both('rmse', 2)}, {both('r2', 5)} FROM {{replicates}}")
    r.add("ev9_paired_bootstrap", f"SELECT {both('challenge', 2)}, round(avg(CASE WHEN challenge < 0 THEN 1.0E0 ELSE 0.0E0 END), 3) AS p_lower FROM {{replicates}}")
    r.add("jn8_pair_folds", """
SELECT rep, fold, round(avg(abs(yhat - y)), 4) AS reference, round(avg(abs(yhat * 0.98E0 - y)), 4) AS challenger FROM {sp5_folds} f JOIN {reg} r ON f.idx = r.idx GROUP BY rep, fold""")
    r.add("ev10_paired_folds", """
SELECT mean_gain, std_gain, win_share, round(@pctl(m, 0.025), 3) AS gain_low, round(@pctl(m, 0.975), 3) AS gain_high FROM (
  SELECT g, avg(gain) AS m FROM (SELECT d.g, f.gain FROM (SELECT b.g, 1 + CAST(floor(@u('72:' || CAST(b.g AS STRING) || ':' || CAST(j.j AS STRING)) * n) AS BIGINT) AS pick
      FROM (SELECT @series(1, 10000) AS g) b CROSS JOIN (SELECT row_number() OVER (ORDER BY rep, fold) AS j, count(*) OVER () AS n FROM {jn8_pair_folds}) j) d
    JOIN (SELECT reference - challenger AS gain, row_number() OVER (ORDER BY rep, fold) AS rk FROM {jn8_pair_folds}) f ON d.pick = f.rk) GROUP BY g) t
CROSS JOIN (SELECT round(avg(reference - challenger), 3) AS mean_gain, round(stddev_samp(reference - challenger), 3) AS std_gain, round(avg(CASE WHEN challenger < reference THEN 1.0E0 ELSE 0.0E0 END), 4) AS win_share FROM {jn8_pair_folds}) s
GROUP BY mean_gain, std_gain, win_share""")
    r.add("ev19_seed_rows", "SELECT seed, round(avg(abs(p - y)), 3) AS mae, round(sqrt(avg((p - y) * (p - y))), 3) AS rmse, round(100 * avg(p - y) / avg(y), 5) AS bias_percent FROM (SELECT y, seed, yhat * (1 + 0.01E0 * (seed - 1)) AS p FROM {reg} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS t(seed)) s) GROUP BY seed")
    r.add("ev20_compare_parts", """
SELECT metric, round(max(CASE WHEN part = 'train' THEN v END), 4) AS train, round(max(CASE WHEN part = 'validation' THEN v END), 4) AS validation, round(max(CASE WHEN part = 'test' THEN v END), 4) AS test FROM (
  SELECT part, metric, CASE metric WHEN 'mae' THEN mae WHEN 'rmse' THEN rmse ELSE bias END AS v FROM (SELECT part, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, avg(yhat - y) AS bias FROM {reg} r JOIN {sp1_split_regression} s ON r.idx = s.idx GROUP BY part) m
  CROSS JOIN (SELECT * FROM (VALUES ('mae'), ('rmse'), ('bias')) AS v(metric)) n) GROUP BY metric""")
    r.add("dg1_learning_curve", "SELECT run_id, iteration, cost AS loss, best, 0.001E0 * power(0.5E0, floor((iteration - 1) / 10)) AS rate FROM {wn4_best_so_far}")
    r.add("dg4_residual_histogram", """
SELECT CAST(least(floor((e - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin, count(*) AS n, max(CASE WHEN abs(mean) > 1.96E0 * std / sqrt(CAST(total AS DOUBLE)) THEN 1 ELSE 0 END) AS mean_off_zero FROM {resid}
CROSS JOIN (SELECT min(e) AS lo, max(e) AS hi, avg(e) AS mean, stddev_samp(e) AS std, count(*) AS total, greatest(20, least(60, floor(sqrt(CAST(count(*) AS DOUBLE))))) AS bins FROM {resid}) b
WHERE hi > lo GROUP BY CAST(least(floor((e - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT)""")
    position = "(CASE WHEN rk = total THEN power(0.5E0, 1.0E0 / total) WHEN rk = 1 THEN 1 - power(0.5E0, 1.0E0 / total) ELSE (rk - 0.3175E0) / (total + 0.365E0) END)"
    r.add("dg5_qq", f"SELECT idx, e, @round10({normal_quantile('p')}) AS quantile FROM (SELECT idx, e, {position} AS p FROM {{resid_rank}})")
    r.add("dg5_line", "SELECT round(regr_slope(e, quantile), 2) AS slope, round(regr_intercept(e, quantile), 2) AS intercept FROM {dg5_qq}")
    r.add("dg9_mahalanobis", f"""
SELECT round(avg(CASE WHEN d2 > {CHI2_975_2}E0 THEN 1.0E0 ELSE 0.0E0 END), 6) AS beyond, round(avg(sqrt(d2)), 4) AS mean_distance FROM (
  SELECT ((q - mq) * (q - mq) * vp - 2 * (q - mq) * (p - mp) * c + (p - mp) * (p - mp) * vq) / (vq * vp - c * c) AS d2 FROM {{mat}}
  CROSS JOIN (SELECT avg(q) AS mq, avg(p) AS mp, var_samp(q) + 1e-6 AS vq, var_samp(p) + 1e-6 AS vp, covar_samp(q, p) AS c FROM {{mat}}) s)""")
    r.add("dg11_speedup", "SELECT run_id, round(sum(cost) / max(cost), 6) AS speedup FROM {log} WHERE cost > 0 GROUP BY run_id")
    # Choice among runs and pools.
    r.add("tk6_robust_candidates", "SELECT run_id, best_cost FROM {tk5_best_epoch} CROSS JOIN (SELECT min(best_cost) AS lowest FROM {tk5_best_epoch}) m WHERE best_cost <= lowest + 0.02E0 * abs(lowest)")
    r.add("st3_unique_pool", "SELECT case_id, group_key, value, min(kind) AS kind FROM (SELECT case_id, group_key, minimum AS value, 0 AS kind FROM {sm4_pilot_plan} UNION ALL SELECT case_id, group_key, midpoint, 1 FROM {sm4_pilot_plan} UNION ALL SELECT case_id, group_key, maximum, 2 FROM {sm4_pilot_plan} UNION ALL SELECT case_id, group_key, value, 3 FROM {sm5_latin_hypercube}) GROUP BY case_id, group_key, value")
    r.add("st5_append_train", "SELECT idx, part FROM {sp1_split_regression} WHERE part <> 'train' UNION ALL SELECT idx, 'train' FROM (SELECT idx FROM {sp1_split_regression} WHERE part = 'train' UNION SELECT r.idx FROM {reg} r ANTI JOIN (SELECT idx FROM {sp1_split_regression} WHERE part <> 'train') h ON r.idx = h.idx WHERE r.y > 100000)")
    r.add("st6_name_diff", "SELECT coalesce(a.k, b.k) AS name, CASE WHEN a.k IS NULL THEN 'added' ELSE 'removed' END AS change FROM (SELECT DISTINCT element AS k FROM {errs} WHERE header = 'error') a FULL OUTER JOIN (SELECT DISTINCT element AS k FROM {errs} WHERE header <> 'error') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
    r.add("sp4_development", "SELECT r.idx, r.y FROM {reg} r JOIN {sp1_split_regression} s ON r.idx = s.idx WHERE part <> 'test'")
    r.add("sp11_check_resume", "SELECT count(*) AS rows_kept, count(DISTINCT candidate_id) AS cases, count(CASE WHEN status = 'completed' AND (steel IS NULL OR steel <= 0) THEN 1 END) AS broken, max(sequence) AS resume_after FROM {attempts} WHERE status <> 'pending'")
    r.add("sm6_targeted_pool", """
SELECT case_id, group_key, draw, CASE WHEN draw = 0 THEN lower ELSE least(upper, greatest(lower, lower + 5 * floor(@u('81:' || CAST(case_id AS STRING) || ':' || group_key || ':' || CAST(draw AS STRING)) * (1 + floor((upper - lower) / 5) / 2)))) END AS value
FROM {ag8_group_bounds} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS v(draw)) n""")
    r.add("sm8_stratified_pick", """
SELECT idx, bin, near_threshold FROM (SELECT idx, bin, near_threshold, row_number() OVER (PARTITION BY bin ORDER BY near_threshold DESC, draw, idx) AS rk FROM (
  SELECT idx, CAST(floor(p_invalid * 10) AS BIGINT) AS bin, CASE WHEN abs(p_invalid - 0.5E0) <= 0.1E0 THEN 1 ELSE 0 END AS near_threshold, @u('82:' || CAST(idx AS STRING)) AS draw FROM {clf})) WHERE rk <= 50""")
    # 50 rows from each quarter of the scores, those near the threshold first; one in five is protected. It fails where a quarter has too few.
    u = lambda k: f"@u('{k}:' || CAST(idx AS STRING))"
    r.add("sm8_choice", f"""
SELECT idx, CAST(bin AS INTEGER) AS bin, near, place, CASE WHEN row_number() OVER (PARTITION BY bin ORDER BY {u(83)}, idx) <= 10 THEN 'protected_evaluation' ELSE 'development' END AS role FROM (
  SELECT *, row_number() OVER (PARTITION BY bin ORDER BY near DESC, {u(82)}, idx) - 1 AS place FROM (
    SELECT idx, least(floor(p_invalid * 4), 3) AS bin, CASE WHEN abs(p_invalid - 0.5E0) <= 0.1E0 THEN 1 ELSE 0 END AS near FROM {{clf}} WHERE p_invalid BETWEEN 0 AND 1)) WHERE place < 50""",
          lambda clf: choose_by_bins(clf, "idx", "p_invalid", "p_invalid", (0.0, 0.25, 0.5, 0.75, 1.0), 200, 0.5, 0.1, 0.2))
    # Final verification: orders as reports, their lines as elements.
    r.add("breakdown", "SELECT o_orderkey AS case_id, o_totalprice AS predicted, 12 * q AS steel_cost, 450 * d AS concrete_cost, q AS steel, CASE WHEN o_orderstatus = 'F' THEN 1000000 ELSE 0 END AS penalty, verified FROM {orders} JOIN (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_discount) AS d, sum(l_extendedprice) AS verified FROM {lineitem} GROUP BY l_orderkey) l ON o_orderkey = l_orderkey")
    r.add("rv7_verification", "SELECT case_id, round(CASE WHEN steel > 0 THEN steel_cost / steel END, 6) AS implied_price, round(verified - predicted, 2) AS signed, round(abs(verified - predicted), 2) AS absolute, CASE WHEN predicted <> 0 THEN round(100 * (verified - predicted) / predicted, 5) END AS relative, CASE WHEN penalty > 0 THEN 'failed' ELSE 'verified' END AS status FROM {breakdown}")
    r.add("rv8_separate_penalty", "SELECT case_id, penalty, round(predicted, 2) AS real_cost, CASE WHEN penalty = 0 AND predicted > 0 THEN round(100 * (predicted - verified) / predicted, 5) END AS reduction FROM {breakdown}")
    r.add("rv9_cost_table", "SELECT case_id, item, round(CASE item WHEN 'steel' THEN steel_cost WHEN 'concrete' THEN concrete_cost ELSE predicted END, 2) AS cost FROM {breakdown} CROSS JOIN (SELECT * FROM (VALUES ('steel'), ('concrete'), ('total')) AS v(item)) i")
    r.add("rv10_label_geometry_delta", "SELECT case_id, round(0.001E0 * o_totalprice - concrete_m3, 6) AS delta FROM {ag6_concrete_total} JOIN {orders} ON case_id = o_orderkey")
