"""Registered queries of the design-analytics operators, and their SQL for the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselake.operators import diagnose, evaluate, geometry, nearest, reports, runs, search
from caselake.plans import designs, tables
from caselake.plans.relation import Relations

RELATIONS = Relations()
for _module in (geometry, evaluate, search, runs, diagnose, reports, nearest):
    _module.define(RELATIONS)
RELATIONS.share(*geometry.SHARED, *evaluate.SHARED)

#: Inputs and helpers of other relations; everything else is a query.
HELPERS = {"seg", "walls", "group_axis", "comp_rects", "x_cuts", "y_cuts", "cells", "cell_edges", "wall_order", "col_shape", "reg", "clf", "mat", "errs", "log", "health", "cand", "attempts", "strata", "vectors", "report_html", "report_rows", "pairs", "roc_points", "reg_quantiles", "class_positions", "class_new", "class_test", "class_rest", "guarded", "sm3_resets", "ledger_rows", "stored_rows", "feature_names", "feature_groups", "hits", "vec", "vec_train", "vec_test"} | {
    "resid", "resid_rank", "wn9_global_rank_base", "resid_rank_base", "by_idx", "by_idx_base", "by_draw", "by_draw_base", "mat_rows", "replicates", "breakdown", "report_labels", "report_heads", "breakdown_cells", "breakdown_rows", "ring_points", "ring_edges", "roc_scores", "roc_base", "by_position", "by_position_base", "development"} | {
    f"{d}_{x}" for d in ("test", "validation") for x in ("source", "pool", "ranked", "ranked_base", "strata", "quota", "before", "drawn")}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: RELATIONS.frame(spark, sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(n) for n in RELATIONS.text if n not in HELPERS}
ORACLE_SQL: dict[str, str] = {n: RELATIONS.duckdb(n) for n in QUERIES}

for _source in (tables, designs):
    _made, _made_sql = _source.make(RELATIONS)
    QUERIES |= _made
    ORACLE_SQL |= _made_sql
