"""Segments to rectangles, columns, beams and quantities. Cases are group keys; nothing crosses a case."""

from __future__ import annotations

from caselake.operators.graph import conflict_pairs, touching_components, touching_pairs
from caselake.plans.relation import Relations


#: Relations that many others build on; each is written once for an input.
SHARED = ("fn4_rectangles", "comp_rects", "cells", "cell_edges", "ag2_rect_union", "wall_order", "wn1_wall_beams", "jn4_beam_cover", "wn3_clear_spans", "col_shape")


def define(r: Relations) -> None:
    r.add("seg", """
SELECT l_orderkey AS case_id, seg_idx,
  CAST(CASE WHEN seg_idx % 2 = 0 THEN 10 * (l_partkey % 72) ELSE 10 + 350 * (l_suppkey % 3) END AS DOUBLE) AS x,
  CAST(CASE WHEN seg_idx % 2 = 0 THEN 10 + 400 * (l_suppkey % 3) ELSE 10 * (l_partkey % 82) END AS DOUBLE) AS y,
  CAST(CASE WHEN seg_idx % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS dx, CAST(CASE WHEN seg_idx % 2 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS dy,
  CAST(20 + 5 * (CAST(l_quantity AS INT) % 10) AS DOUBLE) AS length,
  CAST(20 + 5 * (CAST(l_quantity AS INT) % 10) + 15 * l_linenumber AS DOUBLE) AS maxlength,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_linenumber AS STRING) END AS group_id
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY @last(l_linenumber), @last(l_partkey), @last(l_suppkey), @last(l_extendedprice), @last(l_shipdate)) - 1 AS BIGINT) AS seg_idx FROM {lineitem})""")
    r.add("walls", """
SELECT * FROM (VALUES (0, 0.0D0, 10.0D0, 720.0D0, 10.0D0), (1, 0.0D0, 410.0D0, 720.0D0, 410.0D0), (2, 0.0D0, 810.0D0, 720.0D0, 810.0D0),
  (3, 10.0D0, 0.0D0, 10.0D0, 820.0D0), (4, 360.0D0, 0.0D0, 360.0D0, 820.0D0), (5, 710.0D0, 0.0D0, 710.0D0, 820.0D0)) AS t(wall_id, wx0, wy0, wx1, wy1)""".replace("D0", "E0"))
    r.add("fn1_endpoints", "SELECT case_id, seg_idx, x, y, x + dx * length AS x1, y + dy * length AS y1, length, maxlength, group_id FROM {seg}")
    r.add("fn2_relength", """
SELECT case_id, seg_idx, x, y, maxlength AS length, round(x + dx / sqrt(dx * dx + dy * dy) * maxlength, 6) AS x1, round(y + dy / sqrt(dx * dx + dy * dy) * maxlength, 6) AS y1
FROM {seg} WHERE dx * dx + dy * dy > 0""")
    r.add("fn3_group_key", """
SELECT case_id, seg_idx, CASE WHEN group_id IS NULL OR trim(group_id) = '' THEN '__solo_' || CAST(seg_idx AS STRING) ELSE group_id END AS group_key, x, y, x1, y1, length, maxlength FROM {fn1_endpoints}""")
    r.add("fn4_rectangles", """
SELECT case_id, seg_idx, group_key, length, maxlength,
  CASE WHEN abs(y1 - y) < 1e-6 THEN least(x, x1) ELSE x - 10 END AS rx0, CASE WHEN abs(y1 - y) < 1e-6 THEN greatest(x, x1) ELSE x + 10 END AS rx1,
  CASE WHEN abs(y1 - y) < 1e-6 THEN y - 10 ELSE least(y, y1) END AS ry0, CASE WHEN abs(y1 - y) < 1e-6 THEN y + 10 ELSE greatest(y, y1) END AS ry1
FROM {fn3_group_key} WHERE abs(y1 - y) < 1e-6 OR abs(x1 - x) < 1e-6""")
    r.add("fn5_axis_class", "SELECT case_id, seg_idx, CASE WHEN abs(y1 - y) < 1e-9 THEN 'x' WHEN abs(x1 - x) < 1e-9 THEN 'y' ELSE 'mixed' END AS axis FROM {fn1_endpoints}")
    r.add("jn1_touching_pairs", """
SELECT a.case_id, a.seg_idx AS a, b.seg_idx AS b FROM {fn4_rectangles} a JOIN {fn4_rectangles} b
ON a.case_id = b.case_id AND a.seg_idx < b.seg_idx AND a.rx0 <= b.rx1 AND b.rx0 <= a.rx1 AND a.ry0 <= b.ry1 AND b.ry0 <= a.ry1""", touching_pairs)
    r.add("group_axis", """
SELECT r.case_id, r.group_key, min(a.axis) AS axis, min(rx0) AS gx0, max(rx1) AS gx1, min(ry0) AS gy0, max(ry1) AS gy1
FROM {fn4_rectangles} r JOIN {fn5_axis_class} a ON r.case_id = a.case_id AND r.seg_idx = a.seg_idx
GROUP BY r.case_id, r.group_key HAVING min(a.axis) = max(a.axis) AND min(a.axis) <> 'mixed'""")
    r.add("jn2_conflict_pairs", """
SELECT DISTINCT p.case_id, p.group_key AS x_group, q.group_key AS y_group
FROM (SELECT r.*, g.axis FROM {fn4_rectangles} r JOIN {group_axis} g ON r.case_id = g.case_id AND r.group_key = g.group_key) p
JOIN (SELECT r.*, g.axis FROM {fn4_rectangles} r JOIN {group_axis} g ON r.case_id = g.case_id AND r.group_key = g.group_key) q
ON p.case_id = q.case_id AND p.axis = 'x' AND q.axis = 'y' AND least(p.rx1, q.rx1) - greatest(p.rx0, q.rx0) > 0 AND least(p.ry1, q.ry1) - greatest(p.ry0, q.ry0) > 0
AND (least(p.rx1, q.rx1) - greatest(p.rx0, q.rx0)) * (least(p.ry1, q.ry1) - greatest(p.ry0, q.ry0)) > 1e-9""", conflict_pairs)
    r.add("ag1_components", """
WITH RECURSIVE reach(case_id, seg_idx, root) AS (
  SELECT case_id, seg_idx, seg_idx FROM {fn4_rectangles}
  UNION
  SELECT e.case_id, e.b, p.root FROM reach p JOIN (SELECT case_id, a, b FROM {jn1_touching_pairs} UNION ALL SELECT case_id, b, a FROM {jn1_touching_pairs}) e ON p.case_id = e.case_id AND p.seg_idx = e.a
) SELECT case_id, seg_idx, min(root) AS component FROM reach GROUP BY case_id, seg_idx""", lambda fn4_rectangles, jn1_touching_pairs: touching_components(fn4_rectangles, jn1_touching_pairs))
    r.add("comp_rects", "SELECT r.*, c.component FROM {fn4_rectangles} r JOIN {ag1_components} c ON r.case_id = c.case_id AND r.seg_idx = c.seg_idx")
    cuts = """
SELECT case_id, component, v AS {0}a, lead(v) OVER (PARTITION BY case_id, component ORDER BY v) AS {0}b, CAST(row_number() OVER (PARTITION BY case_id, component ORDER BY v) AS BIGINT) AS {0}i
FROM (SELECT case_id, component, r{0}0 AS v FROM {{comp_rects}} UNION SELECT case_id, component, r{0}1 AS v FROM {{comp_rects}})"""
    r.add("x_cuts", cuts.format("x"))
    r.add("y_cuts", cuts.format("y"))
    r.add("cells", """
SELECT DISTINCT r.case_id, r.component, x.xa, x.xb, x.xi, y.ya, y.yb, y.yi FROM {comp_rects} r
JOIN {x_cuts} x ON r.case_id = x.case_id AND r.component = x.component AND x.xb IS NOT NULL AND x.xa >= r.rx0 AND x.xb <= r.rx1
JOIN {y_cuts} y ON r.case_id = y.case_id AND r.component = y.component AND y.yb IS NOT NULL AND y.ya >= r.ry0 AND y.yb <= r.ry1""")
    r.add("cell_edges", """
SELECT *, xb - xa AS w, yb - ya AS h,
  CASE WHEN lag(xi) OVER (PARTITION BY case_id, component, yi ORDER BY xi) = xi - 1 THEN 0 ELSE 1 END AS open_left,
  CASE WHEN lead(xi) OVER (PARTITION BY case_id, component, yi ORDER BY xi) = xi + 1 THEN 0 ELSE 1 END AS open_right,
  CASE WHEN lag(yi) OVER (PARTITION BY case_id, component, xi ORDER BY yi) = yi - 1 THEN 0 ELSE 1 END AS open_low,
  CASE WHEN lead(yi) OVER (PARTITION BY case_id, component, xi ORDER BY yi) = yi + 1 THEN 0 ELSE 1 END AS open_high FROM {cells}""")
    r.add("ag2_rect_union", """
SELECT case_id, component, sum(w * h) AS area, sum(h * (open_left + open_right) + w * (open_low + open_high)) AS perimeter, min(xa) AS bx0, max(xb) AS bx1, min(ya) AS by0, max(yb) AS by1,
  round(sum(w * h * (xa + xb) / 2) / sum(w * h), 9) AS cx, round(sum(w * h * (ya + yb) / 2) / sum(w * h), 9) AS cy FROM {cell_edges} GROUP BY case_id, component""")
    r.add("ag3_inertia", """
SELECT case_id, component, round(sum(w * h * h * h / 12 + w * h * (ym - yc) * (ym - yc)), 6) AS ixx, round(sum(h * w * w * w / 12 + w * h * (xm - xc) * (xm - xc)), 6) AS iyy FROM (
  SELECT case_id, component, w, h, (xa + xb) / 2 AS xm, (ya + yb) / 2 AS ym, sum(w * h * (xa + xb) / 2) OVER p / sum(w * h) OVER p AS xc, sum(w * h * (ya + yb) / 2) OVER p / sum(w * h) OVER p AS yc
  FROM {cell_edges} WINDOW p AS (PARTITION BY case_id, component)) GROUP BY case_id, component""")
    r.add("ag4_column_quantities", "SELECT case_id, round(sum(area) / 10000 * 3.0, 6) AS volume_m3, round(sum(perimeter) * 0.01 * 3.0, 6) AS formwork_m2 FROM {ag2_rect_union} GROUP BY case_id")
    r.add("jn3_columns_on_walls", """
SELECT c.case_id, c.component, w.wall_id, min(u.bx0) AS bx0, max(u.bx1) AS bx1, min(u.by0) AS by0, max(u.by1) AS by1, min(u.cx) AS cx, min(u.cy) AS cy, min(w.wx0) AS wx0, min(w.wy0) AS wy0, min(w.wx1) AS wx1, min(w.wy1) AS wy1
FROM {cells} c JOIN {walls} w ON sqrt(power(greatest(0, c.xa - w.wx1, w.wx0 - c.xb), 2) + power(greatest(0, c.ya - w.wy1, w.wy0 - c.yb), 2)) < 20
JOIN {ag2_rect_union} u ON c.case_id = u.case_id AND c.component = u.component GROUP BY c.case_id, c.component, w.wall_id""")
    r.add("wall_order", """
SELECT case_id, wall_id, component, CASE WHEN wx0 = wx1 THEN 'y' ELSE 'x' END AS axis, CASE WHEN wx0 = wx1 THEN by0 ELSE bx0 END AS lo, CASE WHEN wx0 = wx1 THEN by1 ELSE bx1 END AS hi,
  CASE WHEN wx0 = wx1 THEN cy ELSE cx END AS c, CASE WHEN wx0 = wx1 THEN wx0 ELSE wy0 END AS line FROM {jn3_columns_on_walls}""")
    r.add("wn1_wall_beams", """
SELECT case_id, wall_id, axis, line, CAST(k AS BIGINT) AS beam_idx, CASE WHEN wide THEN hi ELSE lo END AS b0, CASE WHEN wide THEN next_lo ELSE last_hi END AS b1 FROM (
  SELECT *, max(CASE WHEN k > 1 AND k < n AND hi - lo > 70 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, wall_id) = 1 AS wide FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, wall_id ORDER BY c, component) AS k, count(*) OVER (PARTITION BY case_id, wall_id) AS n,
      lead(lo) OVER (PARTITION BY case_id, wall_id ORDER BY c, component) AS next_lo, last_value(hi) OVER (PARTITION BY case_id, wall_id ORDER BY c, component ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_hi FROM {wall_order}))
WHERE n >= 2 AND ((wide AND next_lo IS NOT NULL) OR (NOT wide AND k = 1))""")
    r.add("wn2_min_clear_gap", """
SELECT case_id, min(gap) AS min_gap FROM (SELECT case_id, lead(lo) OVER (PARTITION BY case_id, wall_id ORDER BY c, component) - hi AS gap FROM {wall_order}) WHERE gap IS NOT NULL GROUP BY case_id""")
    r.add("jn4_beam_cover", """
SELECT b.case_id, b.wall_id, b.beam_idx, b.axis, c.component, greatest(b.b0, CASE WHEN b.axis = 'x' THEN c.xa ELSE c.ya END) AS s, least(b.b1, CASE WHEN b.axis = 'x' THEN c.xb ELSE c.yb END) AS e
FROM {wn1_wall_beams} b JOIN {cells} c ON b.case_id = c.case_id AND b.line >= CASE WHEN b.axis = 'x' THEN c.ya ELSE c.xa END AND b.line <= CASE WHEN b.axis = 'x' THEN c.yb ELSE c.xb END
AND CASE WHEN b.axis = 'x' THEN c.xa ELSE c.ya END < b.b1 AND CASE WHEN b.axis = 'x' THEN c.xb ELSE c.yb END > b.b0""")
    r.add("wn3_clear_spans", """
SELECT case_id, wall_id, beam_idx, axis, s - reached AS span FROM (
  SELECT case_id, wall_id, beam_idx, axis, s, max(e) OVER (PARTITION BY case_id, wall_id, beam_idx ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM (
    SELECT case_id, wall_id, beam_idx, axis, s, e FROM {jn4_beam_cover} UNION ALL SELECT case_id, wall_id, beam_idx, axis, least(b0, b1) - 1e6, b0 FROM {wn1_wall_beams}
    UNION ALL SELECT case_id, wall_id, beam_idx, axis, b1, b1 + 1e6 FROM {wn1_wall_beams})) WHERE s - reached > 1e-9""")
    r.add("ag5_beam_volume", """
SELECT b.case_id, round(sum(abs(b1 - b0)) * 0.01 * 0.2 * 0.4, 6) AS raw_m3, round(sum(greatest(abs(b1 - b0) - coalesce(covered, 0), 0)) * 0.01 * 0.2 * 0.4, 6) AS net_m3
FROM {wn1_wall_beams} b LEFT JOIN (SELECT case_id, wall_id, beam_idx, sum(e - s) AS covered FROM (
  SELECT case_id, wall_id, beam_idx, component, s, max(e) AS e FROM {jn4_beam_cover} GROUP BY case_id, wall_id, beam_idx, component, s) GROUP BY case_id, wall_id, beam_idx) c
ON b.case_id = c.case_id AND b.wall_id = c.wall_id AND b.beam_idx = c.beam_idx GROUP BY b.case_id""")
    r.add("ag6_concrete_total", """
SELECT s.case_id, round(coalesce(c.volume_m3, 0) + coalesce(b.net_m3, 0) + 6.0192, 6) AS concrete_m3, coalesce(c.formwork_m2, 0) AS formwork_m2 FROM (SELECT DISTINCT case_id FROM {seg}) s
LEFT JOIN {ag4_column_quantities} c ON s.case_id = c.case_id LEFT JOIN {ag5_beam_volume} b ON s.case_id = b.case_id""")
    r.add("ag7_bbox_beams", """
SELECT case_id, component, CASE WHEN bx1 - bx0 > by1 - by0 THEN bx0 ELSE (bx0 + bx1) / 2 END AS x0, CASE WHEN bx1 - bx0 > by1 - by0 THEN (by0 + by1) / 2 ELSE by0 END AS y0,
  CASE WHEN bx1 - bx0 > by1 - by0 THEN bx1 ELSE (bx0 + bx1) / 2 END AS x1, CASE WHEN bx1 - bx0 > by1 - by0 THEN (by0 + by1) / 2 ELSE by1 END AS y1 FROM {ag2_rect_union}""")
    r.add("ag8_group_bounds", "SELECT case_id, group_key, max(length) AS lower, greatest(min(maxlength), max(length)) AS upper FROM {fn3_group_key} GROUP BY case_id, group_key")
    r.add("ag9_seed_lengths", "SELECT case_id, group_key, max(length) AS seed_length FROM {fn3_group_key} GROUP BY case_id, group_key")
    # Coordinates count to a millionth.
    r.add("fn16_fingerprint", "SELECT case_id, @sha256(@joined(" + " || ',' || ".join(f"coalesce(CAST(CAST(round({c} * 1000000) AS BIGINT) AS STRING), 'null')" for c in ("x", "y", "x1", "y1")) + ")) AS fingerprint FROM {fn1_endpoints} GROUP BY case_id")
    r.add("st1_dedup_cases", "SELECT min(case_id) AS case_id, fingerprint FROM {fn16_fingerprint} GROUP BY fingerprint")
    r.add("col_shape", """
SELECT u.case_id, u.component, area, perimeter, cx, cy, ixx, iyy, (cx - 360) / 720 AS ndx, (cy - 410) / 820 AS ndy FROM {ag2_rect_union} u JOIN {ag3_inertia} i ON u.case_id = i.case_id AND u.component = i.component""")
    r.add("fe_columns", """
SELECT case_id, round(sum(area), 8) AS columns_total_area_cm2, round(stddev_pop(area), 8) AS columns_std_area_cm2, min(area) AS columns_min_area_cm2, max(area) AS columns_max_area_cm2,
  round(sum(ixx), 8) AS inertia_sum_ix, round(sum(iyy), 8) AS inertia_sum_iy, round(sum(iyy) / (sum(ixx) + 1e-9), 12) + 0.0E0 AS inertia_ratio_iy_over_ix,
  round(sum(area * ndx * ndx) / sum(area), 12) + 0.0E0 AS column_area_spread_x_norm, round(sum(area * ndy * ndy) / sum(area), 12) + 0.0E0 AS column_area_spread_y_norm,
  round(sum(iyy * ndy * ndy) / sum(iyy), 12) + 0.0E0 AS columns_stiffness_spread_x_response_norm, round(sum(ixx * ndx * ndx) / sum(ixx), 12) + 0.0E0 AS columns_stiffness_spread_y_response_norm,
  round(avg(perimeter / sqrt(area)), 12) + 0.0E0 AS columns_mean_shape_factor, round(@pctl(perimeter / sqrt(area), 0.95), 12) + 0.0E0 AS columns_p95_shape_factor,
  round((avg(sqrt(iyy / area)) - avg(sqrt(ixx / area))) / (avg(sqrt(iyy / area)) + avg(sqrt(ixx / area))), 9) + 0.0E0 AS columns_mean_radius_gyration_directional_balance,
  round(avg(abs(0.5 * ln(iyy / ixx))), 12) + 0.0E0 AS columns_mean_abs_log_aspect_ratio, round(stddev_pop(abs(0.5 * ln(iyy / ixx))), 12) + 0.0E0 AS columns_std_abs_log_aspect_ratio, round(max(abs(0.5 * ln(iyy / ixx))), 12) + 0.0E0 AS columns_max_abs_log_aspect_ratio
FROM {col_shape} GROUP BY case_id""")
    r.add("fe_spans", """
SELECT case_id, round(coalesce(stddev_pop(CASE WHEN axis = 'x' THEN span END), 0), 9) AS beams_std_clear_span_x_cm, round(coalesce(stddev_pop(CASE WHEN axis = 'y' THEN span END), 0), 9) AS beams_std_clear_span_y_cm,
  coalesce(max(CASE WHEN axis = 'x' THEN span END), 0) AS beams_max_clear_span_x_cm, coalesce(max(CASE WHEN axis = 'y' THEN span END), 0) AS beams_max_clear_span_y_cm FROM {wn3_clear_spans} GROUP BY case_id""")
    r.add("fe_entropy", """
SELECT case_id, axis, round(greatest(-sum(d / (total + 1e-9) * ln(d / (total + 1e-9) + 1e-9)), 0), 9) AS span_entropy FROM (
  SELECT case_id, axis, d, sum(d) OVER (PARTITION BY case_id, axis) AS total FROM (
    SELECT case_id, axis, bin, count(*) / (max(n) * max(width)) AS d FROM (
      SELECT case_id, axis, n, CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 0.1 END AS width, CASE WHEN hi > lo THEN least(floor((span - lo) / ((hi - lo) / 10)), 9) ELSE 5 END AS bin FROM (
        SELECT case_id, axis, span, min(span) OVER p AS lo, max(span) OVER p AS hi, count(*) OVER p AS n FROM {wn3_clear_spans} WINDOW p AS (PARTITION BY case_id, axis)))
    GROUP BY case_id, axis, bin)) GROUP BY case_id, axis""")
    r.add("fd_columns", """
SELECT case_id, round(sum(area * ndx) / sum(area), 10) + 0.0E0 AS column_area_offset_x_norm, round(sum(area * ndy) / sum(area), 10) + 0.0E0 AS column_area_offset_y_norm, round(sum(area * ndx * ndy) / sum(area), 10) + 0.0E0 AS column_area_coupling_xy_norm,
  round(sum(iyy * ndx) / sum(iyy), 10) + 0.0E0 AS stiffness_ecc_x_norm, round(sum(ixx * ndy) / sum(ixx), 10) + 0.0E0 AS stiffness_ecc_y_norm, count(*) AS columns_count, round(avg(area), 8) AS columns_mean_area_cm2,
  round(sum(perimeter), 8) AS columns_total_perimeter_cm, round(avg(perimeter), 8) AS columns_mean_perimeter_cm, round(stddev_pop(perimeter), 8) AS columns_std_perimeter_cm, round(avg(4 * pi() * area / (perimeter * perimeter)), 10) + 0.0E0 AS columns_mean_compactness,
  round(avg(ixx), 6) AS inertia_mean_ix, round(avg(iyy), 6) AS inertia_mean_iy, round(avg(sqrt(ixx / area)), 10) + 0.0E0 AS mean_radius_gyration_x, round(avg(sqrt(iyy / area)), 10) + 0.0E0 AS mean_radius_gyration_y,
  round(avg(least(sqrt(ixx / area), sqrt(iyy / area))), 10) + 0.0E0 AS mean_radius_gyration_min, round(min(least(sqrt(ixx / area), sqrt(iyy / area))), 10) + 0.0E0 AS min_radius_gyration_global FROM {col_shape} GROUP BY case_id""")
    r.add("fd_spans", """
SELECT case_id, count(CASE WHEN axis = 'x' THEN 1 END) AS clear_span_count_x, count(CASE WHEN axis = 'y' THEN 1 END) AS clear_span_count_y,
  coalesce(sum(CASE WHEN axis = 'x' THEN span END), 0) AS beams_total_clear_length_x_cm, coalesce(sum(CASE WHEN axis = 'y' THEN span END), 0) AS beams_total_clear_length_y_cm,
  round(coalesce(avg(CASE WHEN axis = 'x' THEN span END), 0), 6) AS beams_mean_clear_span_x_cm, round(coalesce(avg(CASE WHEN axis = 'y' THEN span END), 0), 6) AS beams_mean_clear_span_y_cm,
  round(sum(span) * 0.01 * 0.2 * 0.4, 6) AS vol_beams_m3 FROM {wn3_clear_spans} GROUP BY case_id""")
    r.add("fd21_span_p95", "SELECT case_id, coalesce(@pctl(CASE WHEN axis = 'x' THEN span END, 0.95), 0) AS beams_p95_clear_span_x_cm, coalesce(@pctl(CASE WHEN axis = 'y' THEN span END, 0.95), 0) AS beams_p95_clear_span_y_cm FROM {wn3_clear_spans} GROUP BY case_id")
    r.add("fe_gate", "SELECT case_id, columns_count FROM {fd_columns} WHERE columns_count > 0 AND " + " AND ".join(f"{c} - {c} = 0" for c in ("columns_mean_area_cm2", "columns_total_perimeter_cm", "inertia_mean_ix", "inertia_mean_iy", "stiffness_ecc_x_norm", "stiffness_ecc_y_norm", "mean_radius_gyration_min")))
    r.add("fd4_quadrants", """
SELECT case_id, round(greatest(sum(a00), sum(a01), sum(a10), sum(a11)) / sum((xb - xa) * (yb - ya)), 6) AS max_quadrant_area_ratio_fixed FROM (
  SELECT *, greatest(least(xb, 360) - xa, 0) * greatest(least(yb, 410) - ya, 0) AS a00, greatest(least(xb, 360) - xa, 0) * greatest(yb - greatest(ya, 410), 0) AS a01,
    greatest(xb - greatest(xa, 360), 0) * greatest(least(yb, 410) - ya, 0) AS a10, greatest(xb - greatest(xa, 360), 0) * greatest(yb - greatest(ya, 410), 0) AS a11 FROM {cells}) GROUP BY case_id""")
