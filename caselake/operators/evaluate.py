"""Splits, metrics and diagnostics: conditional aggregates and windows inside strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselake.operators.ranks import in_order, quantile
from caselake.operators.splits import split_classes
from caselake.plans.relation import Relations


#: Rows that were used before and so never enter a test part.
PREFIX = 230
CLASS_PREFIX = 253
#: Relations that many others build on; each is written once for an input.
SHARED = ("by_position", "test_strata", "validation_strata", "sp1_split_regression", "roc_points")
#: The most rank strata of a draw.
STRATA = 10


def add_rank(r: Relations, name: str, source: str, order: str, keep: str) -> None:
    """Add ``name``: ``keep`` of ``source`` with rk, its rank from 1 in ``order`` (nulls last), and total. Spark ranks by a range sort, so no task holds the table."""

    def ranked(**given):
        rows = in_order(given[source], [F.expr(c).asc_nulls_last() for c in order.split(", ")], total="total")
        return rows.select(*keep.split(", "), (F.col("_rank") + 1).alias("rk"), "total")

    r.add(name, f"SELECT {keep}, row_number() OVER (ORDER BY {order}) AS rk, count(*) OVER () AS total FROM {{{source}}}", ranked)


def stratified_draw(r: Relations, name: str, seed: int) -> None:
    """Add ``name``_drawn (idx): ``take`` rows of ``name``_source (idx, y, take), spread over rank strata of y by largest remainders and drawn in each by the keyed uniform."""
    r.add(f"{name}_pool", f"SELECT idx, y, take, @u('{seed}:' || CAST(idx AS STRING)) AS u FROM {{{name}_source}}")
    add_rank(r, f"{name}_ranked", f"{name}_pool", "y, idx", "idx, u, take")
    r.add(f"{name}_strata", f"""
SELECT idx, u, take, total, CAST(floor((rk - 1) * bins / total) AS BIGINT) AS stratum, CAST(floor(u * (1 + floor(total / 40960))) AS BIGINT) AS b FROM (
  SELECT *, CAST(greatest(1, least({STRATA}, floor(total / 2), take, total - take)) AS BIGINT) AS bins FROM {{{name}_ranked}})""")
    r.add(f"{name}_quota", f"""
SELECT stratum, whole + CASE WHEN row_number() OVER (ORDER BY part DESC, stratum) <= take - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM (
  SELECT stratum, max(take) AS take, CAST(floor(max(take) * count(*) / max(total)) AS BIGINT) AS whole, (max(take) * count(*)) % max(total) AS part FROM {{{name}_strata}} GROUP BY stratum)""")
    r.add(f"{name}_before", f"SELECT stratum, b, sum(c) OVER (PARTITION BY stratum ORDER BY b) - c AS base FROM (SELECT stratum, b, count(*) AS c FROM {{{name}_strata}} GROUP BY stratum, b)")
    r.add(f"{name}_drawn", f"""
SELECT s.idx FROM (SELECT idx, stratum, b, row_number() OVER (PARTITION BY stratum, b ORDER BY u, idx) AS k FROM {{{name}_strata}}) s
JOIN {{{name}_before}} e ON s.stratum = e.stratum AND s.b = e.b JOIN {{{name}_quota}} q ON s.stratum = q.stratum WHERE base + k <= quota""")


def define(r: Relations) -> None:
    r.add("reg", "SELECT o_orderkey AS idx, o_totalprice AS y, o_totalprice * (0.9E0 + 0.2E0 * ((o_custkey * 37) % 100) / 100.0E0) AS yhat, o_orderpriority AS band FROM {orders}")
    r.add("clf", "SELECT event_id AS idx, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS valid, least(1.0E0, value / 100.0E0) AS p_invalid FROM {events}")
    r.add("mat", "SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t, 100 + 3 * l_quantity + 0.01E0 * l_extendedprice - 50 * l_discount + 20 * l_tax AS score FROM {lineitem}")
    r.add("fn14_label", "SELECT idx, valid, p_invalid, CASE WHEN p_invalid >= 0.5 THEN 0 ELSE 1 END AS predicted FROM {clf} WHERE p_invalid BETWEEN 0 AND 1")
    r.add("fn15_outcome", """
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN valid = 0 AND predicted = 0 THEN 'true_infeasible' WHEN valid = 0 THEN 'infeasible_as_feasible' WHEN predicted = 0 THEN 'feasible_as_infeasible' ELSE 'true_feasible' END AS outcome FROM {fn14_label}) GROUP BY outcome""")
    r.add("fn17_usable", "SELECT idx, y, yhat FROM {reg} WHERE NOT isnan(y) AND y > 0 AND abs(y) < 1e300 AND NOT isnan(yhat) AND yhat > 0 AND y <= 400000")
    r.add("ag10_class_balance", "SELECT valid, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM {clf}) AS DOUBLE), 6) AS share FROM {clf} GROUP BY valid")
    r.add("ag13_distribution", "SELECT count(*) AS n, min(y) AS y_min, max(y) AS y_max, round(max(y) - min(y), 6) AS y_range, round(avg(y), 4) AS y_mean, round(stddev_pop(y), 4) AS y_std FROM {reg}")
    r.add("ag13_histogram", """
SELECT bin, count(*) AS n FROM (SELECT CAST(CASE WHEN hi > lo THEN least(floor((y - lo) / ((hi - lo) / 30)), 29) ELSE 15 END AS BIGINT) AS bin FROM {reg} CROSS JOIN (SELECT min(y) AS lo, max(y) AS hi FROM {reg}) b WHERE y IS NOT NULL) GROUP BY bin""")
    # Order of rows doesn't count; their values do, and so do names, types and number of columns: two words of each row's digest are summed as whole numbers.
    row = "md5('reg(idx bigint, y double):' || coalesce(CAST(idx AS STRING), 'null') || ':' || coalesce(CAST(CAST(round(y * 1000000) AS BIGINT) AS STRING), 'null'))"
    r.add("ag14_dataset_fingerprint", f"SELECT count(*) AS n, CAST(sum(@word({row}, 1)) AS STRING) || '-' || CAST(sum(@word({row}, 13)) AS STRING) AS digest FROM {{reg}}")
    # Folds inside bands, for the breakdowns below.
    r.add("strata", "SELECT idx, y, yhat, band, @u('7:' || CAST(idx AS STRING)) AS u, CAST(row_number() OVER (PARTITION BY band ORDER BY @u('7:' || CAST(idx AS STRING)), idx) AS BIGINT) AS rk, count(*) OVER (PARTITION BY band) AS n FROM {reg}")
    # The split: test rows come from rows after the protected prefix alone, both draws by rank strata of y.
    add_rank(r, "by_position", "reg", "idx", "idx, y, band")
    r.add("test_source", f"SELECT idx, y, CAST(ceil(total * 0.15E0) AS BIGINT) AS take FROM {{by_position}} WHERE rk > {PREFIX}")
    stratified_draw(r, "test", 7)
    # Too few rows, or targets that aren't finite, stop the split when it is run.
    guard = f"""CASE WHEN total < 3 THEN @fail('At least three targets are required for a three-way split.') WHEN y IS NULL OR isnan(y) OR abs(y) = CAST('Infinity' AS DOUBLE) THEN @fail('Regression targets contain NaN or infinite values.')
  WHEN total - {PREFIX} <= ceil(total * 0.15E0) THEN @fail('There are not enough new samples to create a final test set after protecting the preused samples.') ELSE true END"""
    r.add("guarded", f"SELECT idx, y, band FROM {{by_position}} WHERE {guard}")
    r.add("development", "SELECT p.idx, p.y FROM {guarded} p ANTI JOIN {test_drawn} t ON p.idx = t.idx")
    r.add("validation_source", "SELECT idx, y, (SELECT CAST(ceil(count(*) * 0.2E0) AS BIGINT) FROM {development}) AS take FROM {development}")
    stratified_draw(r, "validation", 8)
    r.add("sp1_split_regression", """
SELECT p.idx, p.band, CASE WHEN t.idx IS NOT NULL THEN 'test' WHEN v.idx IS NOT NULL THEN 'validation' ELSE 'train' END AS part
FROM {guarded} p LEFT JOIN {test_drawn} t ON p.idx = t.idx LEFT JOIN {validation_drawn} v ON p.idx = v.idx""")
    # Quotas of classes by largest remainders; the SQL draws them by windows, Spark by range sorts.
    draw = lambda source, take, u: f"""SELECT idx, valid, rk <= whole + extra AS taken FROM (SELECT *, row_number() OVER (PARTITION BY valid ORDER BY @u('{u}:' || CAST(idx AS STRING)), idx) AS rk FROM {source}) JOIN (
  SELECT valid AS c_valid, whole, CASE WHEN row_number() OVER (ORDER BY part DESC, valid) <= take - sum(whole) OVER () THEN 1 ELSE 0 END AS extra FROM (
    SELECT valid, take, (take * count(*)) // nn AS whole, (take * count(*)) % nn AS part FROM {source} CROSS JOIN (SELECT count(*) AS nn, {take} AS take FROM {source}) t GROUP BY valid, take, nn)) ON valid = c_valid"""  # noqa: E731
    r.add("class_positions", "SELECT idx, valid, row_number() OVER (ORDER BY idx) AS rk FROM {clf}")
    r.add("class_new", f"SELECT idx, valid FROM {{class_positions}} WHERE rk > {CLASS_PREFIX}")
    r.add("class_test", draw("{class_new}", "(SELECT CAST(ceil(count(*) * 0.2E0) AS BIGINT) FROM {clf})", 3))
    r.add("class_rest", f"SELECT idx, valid FROM {{class_test}} WHERE NOT taken UNION ALL SELECT idx, valid FROM {{class_positions}} WHERE rk <= {CLASS_PREFIX}")
    r.add("sp2_split_classes", "SELECT idx, valid, CASE WHEN taken THEN 'validation' ELSE 'train' END AS part FROM (" + draw("{class_rest}", "CAST(ceil(count(*) * 0.25E0) AS BIGINT)", 4) + ") UNION ALL SELECT idx, valid, 'test' FROM {class_test} WHERE taken")
    r.at_once("sp2_split_classes", ("clf",), lambda clf: split_classes(clf, "idx", "valid", prefix=CLASS_PREFIX))
    r.add("sp3_manifest", "SELECT part, count(*) AS n, min(y) AS y_min, max(y) AS y_max, round(avg(y), 4) AS y_mean, round(stddev_pop(y), 4) AS y_std, max(CASE WHEN r.rk <= 230 AND part = 'test' THEN 1 ELSE 0 END) AS leaks FROM {sp1_split_regression} s JOIN {by_position} r ON s.idx = r.idx GROUP BY part")
    r.add("sp5_folds", "SELECT t.idx, r.rep, CAST((row_number() OVER (PARTITION BY band, rep ORDER BY @u(CAST(rep AS STRING) || ':' || CAST(idx AS STRING)), idx) - 1) % 5 AS BIGINT) AS fold FROM {reg} t CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS v(rep)) r")
    r.add("sp6_stratified_folds", "SELECT band, CAST(rk % 5 AS BIGINT) AS fold, count(*) AS n FROM {strata} GROUP BY band, CAST(rk % 5 AS BIGINT)")
    r.add("sp8_check_matrix", "SELECT count(*) AS n, count(CASE WHEN q IS NULL OR isnan(q) THEN 1 END) AS bad_q, count(CASE WHEN p IS NULL OR p <= 0 THEN 1 END) AS bad_p, count(CASE WHEN d < 0 OR d > 1 THEN 1 END) AS bad_d, CASE WHEN count(*) >= 2 THEN 1 ELSE 0 END AS enough FROM {mat}")
    r.add("sp10_replicate", "SELECT idx, y, copy FROM {reg} CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3)) AS v(copy)) w WHERE copy = 1 OR (band = '1-URGENT' AND copy <= 3)")
    r.add("st4_check_partition", "SELECT count(*) AS n, count(DISTINCT s.idx) AS distinct_n, count(CASE WHEN r.idx IS NULL THEN 1 END) AS strangers, count(CASE WHEN s.idx IS NULL THEN 1 END) AS missing FROM {sp1_split_regression} s FULL OUTER JOIN {reg} r ON s.idx = r.idx")
    r.add("ml1_scaler", "SELECT round(avg(q), 6) AS q_mean, round(CASE WHEN stddev_pop(q) = 0 THEN 1 ELSE stddev_pop(q) END, 6) AS q_scale, round(avg(p), 4) AS p_mean, round(CASE WHEN stddev_pop(p) = 0 THEN 1 ELSE stddev_pop(p) END, 4) AS p_scale, round(avg(d), 8) AS d_mean, round(stddev_pop(d), 8) AS d_scale, round(avg(t), 8) AS t_mean, round(stddev_pop(t), 8) AS t_scale FROM {mat}")
    r.add("ml2_scale", "SELECT k1, k2, k3, k4, p AS raw_p, round((q - q_mean) / q_scale, 5) + 0.0E0 AS zq, round((p - p_mean) / p_scale, 5) + 0.0E0 AS zp FROM {mat} CROSS JOIN {ml1_scaler}")
    r.add("ml6_class_weights", "SELECT valid, round(n / (2.0E0 * c), 6) AS weight FROM (SELECT valid, count(*) AS c FROM {clf} GROUP BY valid) g CROSS JOIN (SELECT count(*) AS n FROM {clf}) t")
    r.add("ml14_attribution", "SELECT round(avg(abs(3 * (q - q_mean))), 4) AS q, round(avg(abs(0.01E0 * (p - p_mean))), 4) AS p, round(avg(abs(50 * (d - d_mean))), 4) AS d, round(avg(abs(20 * (t - t_mean))), 4) AS t FROM {mat} CROSS JOIN {ml1_scaler}")
    r.add("ml15_partial_dependence", """
SELECT g AS step, round(lo + (hi - lo) * g / 59.0E0, 6) AS q, round(avg(score - 3 * m.q) + 3 * (lo + (hi - lo) * g / 59.0E0), 4) AS mean_score, round(stddev_pop(score - 3 * m.q), 4) AS std_score
FROM {mat} m CROSS JOIN (SELECT min(q) AS lo, max(q) AS hi FROM {mat}) b CROSS JOIN (SELECT @series(0, 59) AS g) s GROUP BY g, lo, hi""")
    err = "yhat - y"
    r.add("ev1_regression_metrics", f"""
SELECT round(avg(abs({err})), 4) AS mae, round(sqrt(avg(power({err}, 2))), 4) AS rmse, round(CASE WHEN max(y) > min(y) THEN 1 - sum(power({err}, 2)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0) WHEN sum(power({err}, 2)) = 0 THEN 1 ELSE 0 END, 6) AS r2, round(max(abs({err})), 4) AS max_abs, round(stddev_pop(abs({err})), 4) AS std_abs FROM {{reg}}""")
    r.add("ev2_mape", "SELECT round(100 * avg(CASE WHEN abs(y) > 1e-6 THEN abs((yhat - y) / y) END), 6) AS mape, count(CASE WHEN abs(y) <= 1e-6 THEN 1 END) AS skipped FROM {reg}")
    wanted = {"p90_abs": ("abs(yhat - y)", 0.9), "under_p90": ("greatest(y - yhat, 0)", 0.9), "q25": ("y", 0.25), "med": ("y", 0.5)}

    def quantiles(reg):
        out = None
        for name, (what, q) in wanted.items():
            one = quantile(reg.select(F.expr(what).alias("v")), "v", q, name)
            out = one if out is None else out.join(F.broadcast(one))  # one row each
        return out

    r.add("reg_quantiles", "SELECT " + ", ".join(f"quantile_cont({what}, {q}) AS {name}" for name, (what, q) in wanted.items()) + " FROM {reg}", quantiles)
    r.add("ev3_p90", "SELECT round(p90_abs, 4) AS p90_abs FROM {reg_quantiles}")
    r.add("ev4_under_prediction", """
SELECT round(avg(CASE WHEN y > yhat THEN 1.0E0 ELSE 0.0E0 END), 6) AS under_rate, round(avg(greatest(y - yhat, 0)), 4) AS under_mean, round(max(q.under_p90), 4) AS under_p90,
  round(avg(CASE WHEN y <= q25 THEN abs(yhat - y) END), 4) AS low_mae FROM {reg} CROSS JOIN {reg_quantiles} q""")
    r.add("ev5_bias", "SELECT round(avg(yhat - y), 4) AS bias FROM {reg}")
    r.add("ev6_by_band", "SELECT CAST(floor(y / 100000) AS BIGINT) AS band_no, count(*) AS n, round(avg(abs(yhat - y)), 4) AS mae, round(avg(yhat - y), 4) AS bias FROM {reg} GROUP BY CAST(floor(y / 100000) AS BIGINT)")
    r.add("ev7_metric_deltas", "SELECT b.band_no, round(b.mae - a.mae, 3) AS mae_delta FROM {ev6_by_band} b CROSS JOIN {ev1_regression_metrics} a")
    r.add("ev11_confusion", """
SELECT tn, fp, fn, tp, round((tn + tp) / nullif(CAST(tn + fp + fn + tp AS DOUBLE), 0), 6) AS accuracy,
  round(coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0), 6) AS recall_invalid, round(coalesce(tn / nullif(CAST(tn + fn AS DOUBLE), 0), 0), 6) AS precision_invalid, round(coalesce(2 * tn / nullif(CAST(2 * tn + fp + fn AS DOUBLE), 0), 0), 6) AS f1_invalid,
  round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall_valid, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision_valid, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1_valid,
  fp AS invalid_as_valid, round(fp / nullif(CAST(tn + fp AS DOUBLE), 0), 6) AS invalid_as_valid_rate FROM (
  SELECT count(CASE WHEN valid = 0 AND predicted = 0 THEN 1 END) AS tn, count(CASE WHEN valid = 0 AND predicted = 1 THEN 1 END) AS fp, count(CASE WHEN valid = 1 AND predicted = 0 THEN 1 END) AS fn, count(CASE WHEN valid = 1 AND predicted = 1 THEN 1 END) AS tp FROM {fn14_label})""")
    # The curve has a point for each distinct score; sums run inside buckets of scores, and those of higher buckets are added.
    r.add("roc_scores", "SELECT p_invalid AS thr, floor(p_invalid * 4096) AS b, CAST(sum(1 - valid) AS BIGINT) AS pos, CAST(sum(valid) AS BIGINT) AS neg FROM {clf} WHERE p_invalid IS NOT NULL GROUP BY p_invalid")
    r.add("roc_base", """
SELECT b, (sum(p) OVER w) - p AS tp0, (sum(q) OVER w) - q AS fp0, sum(p) OVER () AS all_pos, sum(q) OVER () AS all_neg, lead(top_pos) OVER w AS later_pos, lead(top_neg) OVER w AS later_neg FROM (
  SELECT b, sum(pos) AS p, sum(neg) AS q, max_by(pos, thr) AS top_pos, max_by(neg, thr) AS top_neg FROM {roc_scores} GROUP BY b) WINDOW w AS (ORDER BY b DESC)""")
    r.add("roc_points", """
SELECT thr, pos, neg, CAST(tp0 + (sum(pos) OVER w) AS BIGINT) AS tp, CAST(fp0 + (sum(neg) OVER w) AS BIGINT) AS fp, all_pos, all_neg, coalesce(lead(pos) OVER w, later_pos) AS next_pos, coalesce(lead(neg) OVER w, later_neg) AS next_neg
FROM {roc_scores} s JOIN {roc_base} t ON s.b = t.b WINDOW w AS (PARTITION BY s.b ORDER BY thr DESC)""")
    r.add("ev12_roc", """
SELECT thr, round(tp / nullif(CAST(all_pos AS DOUBLE), 0), 6) AS tpr, round(fp / nullif(CAST(all_neg AS DOUBLE), 0), 6) AS fpr FROM {roc_points}
WHERE next_pos IS NULL OR next_pos <> pos OR next_neg <> neg OR (tp = pos AND fp = neg)
UNION ALL SELECT CAST(NULL AS DOUBLE), 0.0E0, 0.0E0 FROM (SELECT count(*) AS n FROM {roc_scores}) c WHERE n > 0""")
    r.add("ev13_auc", "SELECT round(CAST(sum(CAST(neg * (2 * tp - pos) AS DOUBLE)) AS DOUBLE) / nullif(2.0E0 * sum(pos) * sum(neg), 0), 6) AS auc FROM {roc_points}")
    r.add("ev14_youden", "SELECT coalesce(max_by(thr, @pair(round(tpr - fpr, 6), thr)), 0.5) AS threshold FROM {ev12_roc} WHERE thr BETWEEN 0 AND 1")
    r.add("ev15_evaluate_rule", "SELECT threshold, count(*) AS n, round(avg(CASE WHEN (CASE WHEN p_invalid >= threshold THEN 0 ELSE 1 END) = valid THEN 1.0E0 ELSE 0.0E0 END), 6) AS accuracy FROM {clf} CROSS JOIN {ev14_youden} GROUP BY threshold")
    r.add("ev16_threshold_sweep", """
SELECT thr, round(avg(CASE WHEN valid = 0 THEN CASE WHEN p_invalid < thr THEN 1.0E0 ELSE 0.0E0 END END), 6) AS miss_rate, round(avg(CASE WHEN valid = 1 THEN CASE WHEN p_invalid >= thr THEN 1.0E0 ELSE 0.0E0 END END), 6) AS rejection_rate
FROM {clf} CROSS JOIN (SELECT * FROM (VALUES (0.1E0), (0.25E0), (0.5E0), (0.75E0), (0.9E0)) AS v(thr)) s GROUP BY thr""")
    r.add("ev17_gates", "SELECT CASE WHEN mae <= 0.1 * med THEN 1 ELSE 0 END AS mae_ok, CASE WHEN r2 >= 0.8 THEN 1 ELSE 0 END AS r2_ok, CASE WHEN rmse <= 0.12 * med THEN 1 ELSE 0 END AS rmse_ok, CASE WHEN auc >= 0.8 THEN 1 ELSE 0 END AS auc_ok, CASE WHEN recall_invalid >= 0.8 THEN 1 ELSE 0 END AS recall_ok, CASE WHEN precision_invalid >= 0.6 THEN 1 ELSE 0 END AS precision_ok FROM {ev1_regression_metrics} CROSS JOIN (SELECT med FROM {reg_quantiles}) m CROSS JOIN {ev13_auc} CROSS JOIN {ev11_confusion}")
    r.add("ev18_bias_variance", """
SELECT round(avg(power(m - y, 2)), 2) AS mean_sq_bias, round(avg(v), 2) AS mean_variance, round(avg(e), 2) AS expected_mse, round(abs(avg(e) - avg(power(m - y, 2)) - avg(v)), 2) + 0.0E0 AS identity_error FROM (
  SELECT idx, y, avg(p) AS m, var_pop(p) AS v, avg(power(p - y, 2)) AS e FROM (SELECT idx, y, seed, yhat * (1 + 0.01E0 * (seed - 1)) AS p FROM {reg} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2)) AS t(seed)) s) GROUP BY idx, y)""")
    r.add("dg3_residual_bands", "SELECT round(avg(CASE WHEN abs(yhat - y) <= 0.1E0 * y THEN 1.0E0 ELSE 0.0E0 END), 6) AS within_10, round(avg(CASE WHEN abs(yhat - y) <= 0.05E0 * y THEN 1.0E0 ELSE 0.0E0 END), 6) AS within_5, round(avg(CASE WHEN yhat < y THEN 1.0E0 ELSE 0.0E0 END), 6) AS share_negative FROM {reg}")
    r.add("dg6_confusion_percent", "SELECT valid, predicted, round(100.0E0 * n / sum(n) OVER (PARTITION BY valid), 4) AS percent FROM (SELECT valid, predicted, count(*) AS n FROM {fn14_label} GROUP BY valid, predicted)")
    names = ("q", "p", "d", "t", "score")
    both = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    r.add("dg7_matrix", "SELECT a, b, round(r, 4) AS r, CASE WHEN abs(r) > 0.9E0 THEN 1 ELSE 0 END AS strong FROM (SELECT a, b, CASE a || ' ' || b " + " ".join(f"WHEN '{a} {b}' THEN {a}_{b}" for a, b in both)
          + " END AS r FROM (SELECT " + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for a, b in both) + " FROM {mat}) m CROSS JOIN (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in both) + ") AS v(a, b)) n)")
    r.add("dg7_correlation", "SELECT round(corr(q, p), 4) AS q_p, round(corr(q, score), 4) AS q_score, round(corr(p, score), 4) AS p_score, CASE WHEN abs(corr(p, score)) > 0.9 THEN 1 ELSE 0 END AS p_score_flag FROM {mat}")
    r.add("tk1_extremes", "SELECT min_by(idx, @pair(y, idx)) AS low_idx, max_by(idx, @pair(y, -idx)) AS high_idx, min(idx) AS first_idx FROM {reg}")
