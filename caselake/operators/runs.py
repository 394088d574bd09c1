"""Run logs, telemetry, errors and reports: windows inside a run or worker, and text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.operators.evaluate import add_rank
from caselake.plans.relation import Relations


def fold_summary(log: DataFrame) -> DataFrame:
    """The relation ``ag15_fold_summary`` with costs added in the order of their iterations, so a mean halfway between two millionths is rounded alike in every run."""
    so_far = Window.partitionBy("run_id").orderBy("iteration").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {"mean_cost": "max_by(_sum, iteration) / nullif(count(cost), 0)", "std_cost": "stddev_samp(cost)", "median_cost": "percentile(cost, 0.5)"}
    return log.withColumn("_sum", F.sum("cost").over(so_far)).groupBy("run_id").agg(*[F.expr(f"round({e}, 6)").alias(n) for n, e in made.items()])


def define(r: Relations) -> None:
    r.add("health", "SELECT event_id, user_id AS worker, ts, least(1.0E0, value / 100.0E0) AS disk, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed FROM {events}")
    r.add("errs", "SELECT event_id, event_type AS header, @json_k(props) AS element, user_id AS run_id, ts FROM {events}")
    r.add("log", "SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS iteration, value AS cost, event_id FROM {events}")
    r.add("wn4_best_so_far", """
SELECT run_id, iteration, cost, best, improved, CAST(row_number() OVER (PARTITION BY run_id, island ORDER BY iteration) - CASE WHEN island > 0 THEN 1 ELSE 0 END AS BIGINT) AS stale FROM (
  SELECT *, sum(improved) OVER (PARTITION BY run_id ORDER BY iteration) AS island FROM (
    SELECT run_id, iteration, cost, min(cost) OVER w AS best, CASE WHEN iteration = 1 OR cost < min(cost) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS improved
    FROM {log} WINDOW w AS (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))""")
    r.add("wn5_delta_prev", "SELECT run_id, iteration, CASE WHEN prev IS NULL THEN NULL WHEN cost < prev THEN 'better' WHEN cost = prev THEN 'equal' ELSE 'worse' END AS verdict FROM (SELECT *, lag(cost) OVER (PARTITION BY run_id ORDER BY iteration) AS prev FROM {log})")
    r.add("wn6_failure_streak", """
SELECT worker, event_id, CAST(sum(failed) OVER (PARTITION BY worker, island ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS streak FROM (
  SELECT *, sum(1 - failed) OVER (PARTITION BY worker ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {health})""")
    r.add("ss4_circuit_breaker", "SELECT worker, min(event_id) AS tripped_at FROM {wn6_failure_streak} WHERE streak >= 3 GROUP BY worker")
    r.add("wn7_early_stop", "SELECT run_id, min(CASE WHEN stale >= 10 THEN iteration END) AS stop_iteration, min_by(iteration, @pair(cost, iteration)) AS best_iteration FROM {wn4_best_so_far} GROUP BY run_id")
    r.add("tk5_best_epoch", "SELECT run_id, min(cost) AS best_cost, min_by(iteration, @pair(cost, iteration)) AS best_epoch, count(*) AS epochs FROM {log} GROUP BY run_id")
    r.add("dg12_convergence", "SELECT run_id, count(CASE WHEN improved = 1 THEN 1 END) AS improvements, min(best) AS final_best, max(stale) AS longest_stale FROM {wn4_best_so_far} GROUP BY run_id")
    r.add("ag12_error_frequency", "SELECT header, element, count(*) AS n FROM {errs} GROUP BY header, element")
    r.add("ag16_error_rollup", "SELECT run_id, header, count(*) AS n FROM {errs} GROUP BY ROLLUP (run_id, header)")
    r.add("st2_keep_last", "SELECT element, max_by(header, event_id) AS header, max(event_id) AS event_id FROM {errs} GROUP BY element")
    r.add("ag15_fold_summary", "SELECT run_id, round(avg(cost), 6) AS mean_cost, round(stddev_samp(cost), 6) AS std_cost, round(@pctl(cost, 0.5), 6) AS median_cost FROM {log} GROUP BY run_id", fold_summary)
    add_rank(r, "wn11_rank", "ag15_fold_summary", "mean_cost, run_id", "run_id, mean_cost")
    # Norms of a step by layer, one row for each entry of its map; the steps of a run stand for its layers here.
    r.add("dg2_gradient_norms", "SELECT run_id, iteration, 'cost' AS layer, abs(cost) AS norm FROM {log} UNION ALL SELECT run_id, iteration, 'best', abs(best) FROM {wn4_best_so_far}",
          lambda log, wn4_best_so_far: wn4_best_so_far.select("run_id", "iteration", F.explode(F.create_map(F.lit("cost"), F.abs("cost"), F.lit("best"), F.abs("best"))).alias("layer", "norm")))
    r.add("ss1_health_windows", "SELECT worker, @hour(ts) AS hour_start, round(avg(disk), 6) AS mean_disk, max(disk) AS max_disk, count(*) AS n FROM {health} GROUP BY worker, @hour(ts)")
    r.add("ss2_alerts", "SELECT event_id, worker, CASE WHEN disk >= 0.9 THEN 'stop' ELSE 'warn' END AS level FROM {health} WHERE disk >= 0.8")
    r.add("ss3_stuck", "SELECT worker, event_id, round(gap_us / 1000000.0E0, 3) AS gap_s FROM (SELECT worker, event_id, @gap(before, ts) AS gap_us FROM (SELECT *, lag(ts) OVER (PARTITION BY worker ORDER BY ts, event_id) AS before FROM {health})) WHERE gap_us >= 5400000000")
    r.add("ss5_dedup", "SELECT worker, disk, min(event_id) AS event_id FROM {health} GROUP BY worker, disk")
    r.add("ss7_live_best", "SELECT run_id, min(cost) AS best, count(*) AS n FROM {log} GROUP BY run_id")
    r.add("src6_ndjson", "SELECT event_id, @json_k(props) AS k FROM {events} WHERE @json_k(props) IS NOT NULL")
    r.add("snk2_vectors_text", "SELECT case_id, seg_idx, CAST(CAST(x AS BIGINT) AS STRING) || ';' || CAST(CAST(y AS BIGINT) AS STRING) || ';' || CAST(CAST(length AS BIGINT) AS STRING) AS line FROM {seg}")
    r.add("fn10_parse_locale_number", """
SELECT p_partkey, @double(CASE WHEN position(',' IN s) > 0 AND position('.' IN s) > 0 THEN replace(replace(s, '.', ''), ',', '.') WHEN position(',' IN s) > 0 THEN replace(s, ',', '.') ELSE s END) AS number FROM (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1.' || CAST(100 + p_size AS STRING) || ',5' WHEN 1 THEN CAST(p_size AS STRING) || ',25' WHEN 2 THEN '-' ELSE CAST(p_size AS STRING) END AS s FROM {part})""")
    r.add("fn11_parse_simple_number", "SELECT p_partkey, @double(replace(CASE p_partkey % 3 WHEN 0 THEN '1.234,5' WHEN 1 THEN CAST(p_size AS STRING) || ',5' ELSE CAST(p_size AS STRING) END, ',', '.')) AS number FROM {part}")
    r.add("fn12_safe_float", "SELECT p_partkey, coalesce(@double(CASE WHEN p_partkey % 2 = 0 THEN 'N/A' ELSE CAST(p_size AS STRING) END), 0.0E0) AS number FROM {part}")
    r.add("fn13_unit_price", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity > 0 THEN round(l_extendedprice / l_quantity, 6) END AS unit_price FROM {lineitem}")
    r.add("fn9_fold_label", "SELECT p_partkey, @fold('  Resumo  de  ' || CASE p_partkey % 3 WHEN 0 THEN 'Aço' WHEN 1 THEN 'CONCRETO' ELSE 'Fôrma' END || ' ' || p_name) AS label FROM {part}")
    r.add("pairs", "SELECT l_orderkey AS case_id, max(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END) AS base, max(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END) AS variant FROM {lineitem} GROUP BY l_orderkey")
    r.add("jn7_compare_runs", "SELECT case_id, CASE WHEN base IS NULL OR variant IS NULL THEN 'incomplete' WHEN abs(base - variant) <= 0.05E0 * base THEN 'pass' ELSE 'fail' END AS verdict FROM {pairs}")
    r.add("rv4_repeatability", "SELECT l_orderkey AS case_id, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(max(l_extendedprice) - min(l_extendedprice), 4) AS spread, round(stddev_samp(l_extendedprice), 4) AS std FROM {lineitem} GROUP BY l_orderkey")
    r.add("rv6_scope_ab", "SELECT case_id, round(variant - base, 4) AS difference, round(variant / base, 6) AS ratio, CASE WHEN abs(variant - base) / base <= 0.1 THEN 1 ELSE 0 END AS passes FROM {pairs} WHERE base > 0 AND variant IS NOT NULL")
    r.add("rv5_verdict", "SELECT verdict, count(*) AS n FROM {jn7_compare_runs} GROUP BY verdict")
    r.add("dg13_percent_change", "SELECT case_id, CASE WHEN base = 0 OR base IS NULL THEN NULL ELSE round(100 * (variant - base) / base, 4) END AS change FROM {pairs}")
