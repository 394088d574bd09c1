"""Readers, writers, reports, column functions, models and streams on small hand-made tables."""

from __future__ import annotations

import json
import statistics

import pytest
from pyspark.sql import functions as F

from caselake import plans
from caselake.functions import columns
from caselake.operators import diagnose, models
from caselake.operators.reports import html_cells
from caselake.sources import tables
from caselake.streaming import telemetry

R = plans.RELATIONS


def test_segments_with_mark_comma_and_bad_number(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("\ufeffX;y;dx;dy;length\n1,5;2;1;0;10\n0;0;0;1;oops\n", encoding="utf8")
    rows = sorted(tables.read_segments(spark, str(f)).collect(), key=lambda r: r["x"])
    assert [(r["x"], r["x1"], r["y1"], r["maxlength"], r["group_id"]) for r in rows] == [(0.0, None, None, None, None), (1.5, 11.5, 2.0, None, None)]
    with pytest.raises(ValueError, match="maxlength"):
        tables.read_design_space(spark, str(f))


def test_design_space_fills_blank_groups_with_their_own(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("x;y;dx;dy;length;maxlength;group_id\n0;0;1;0;10;20;\n0;0;1;0;10;20;\n0;0;1;0;10;20;g\n", encoding="utf8")
    assert tables.read_design_space(spark, str(f)).select("group_id").distinct().count() == 3


def test_grid_keeps_rejects(spark, tmp_path):
    f = tmp_path / "g.csv"
    f.write_text("x;y;binary_flag\n1;2;1\n1;2;7\nx;2;0\n3;4;0\n", encoding="utf8")
    good, bad = tables.read_grid(spark, str(f))
    assert (sorted(map(tuple, good.collect())), bad.count()) == ([(1.0, 2.0, 1), (3.0, 4.0, 0)], 2)


def test_reports_of_two_encodings(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("\ufeffAço".encode())
    (tmp_path / "b.html").write_bytes("Aço".encode("latin-1"))
    assert [r["html"] for r in tables.read_reports(spark, f"{tmp_path}/*.html").collect()] == ["Aço", "Aço"]


def test_checkpoint_contract(spark, tmp_path):
    good = {"version": 1, "names": ["a", "b"], "x": [[1, 2], [3, 4]], "y": [5, 6], "complete": True}
    for name, change in (("good", {}), ("order", {"names": ["b", "a"]}), ("short", {"y": [5]}), ("part", {"complete": False}), ("null", {"x": [[1, None], [3, 4]]})):
        f = tmp_path / f"{name}.json"
        f.write_text(json.dumps(good | change))
        df = tables.read_checkpoint(spark, str(f), ["a", "b"])
        if name == "good":
            assert [(r["row"], r["target"]) for r in df.collect()] == [(0, 5.0), (1, 6.0)]
        else:
            with pytest.raises(Exception, match="contract"):
                df.collect()


def test_runs_and_lines(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / run / "metrics").mkdir(parents=True)
        (tmp_path / run / "metrics" / "summary.json").write_text('{"mae": 1.5}')
    assert sorted(map(tuple, tables.read_runs(spark, str(tmp_path), "mae double").collect())) == [(1.5, "r1"), (1.5, "r2")]
    (tmp_path / "l.json").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert tables.read_ndjson(spark, str(tmp_path / "l.json"), "a int").count() == 2


def test_section_replaces_itself_only(spark, tmp_path):
    at = str(tmp_path / "store")
    rows = lambda n: spark.createDataFrame([("a", i, float(i)) for i in range(n)], "name string, idx int, value double")
    tables.store_section(rows(3), at, "r1", "s")
    tables.store_section(rows(4), at, "r2", "s")
    assert tuple(tables.store_section(rows(2), at, "r1", "s").first()) == ("a", 2, 1)
    assert spark.read.parquet(at).count() == 6
    with pytest.raises(TypeError):
        tables.store_section(spark.createDataFrame([("a", 0, "x")], "name string, idx int, value string"), at, "r1", "s")


def test_written_numbers(spark, tmp_path):
    tables.write_solution(spark.createDataFrame([(1, 2.5)], "id int, cost double"), str(tmp_path / "a"))
    assert spark.read.text(str(tmp_path / "a")).where("value <> 'id;cost'").first()[0] == "1;2,5"
    tables.write_vectors(spark.createDataFrame([(0, 1, 1.0, 2.0, 3.0, 4.0, 2.5)], "config_index int, segment_index int, start_x double, start_y double, end_x double, end_y double, length double"), str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b")).where("value like '0;%'").first()[0] == "0;1;1.000000;2.000000;3.000000;4.000000;2.500000"


def test_columns(spark):
    df = spark.createDataFrame([("1.234,5",), ("3,25",), ("-",), ("",), (None,), ("7",)], "s string")
    assert [r[0] for r in df.select(columns.parse_locale_number(F.col("s"))).collect()] == [1234.5, 3.25, None, None, None, 7.0]
    assert [r[0] for r in df.select(columns.parse_simple_number(F.col("s"))).collect()] == [None, 3.25, None, None, None, 7.0]
    assert spark.range(1).select(columns.fold_label(F.lit("  AÇO   Total "))).first()[0] == "aco total"


def test_cells_of_broken_pages(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>a &amp; b</td><th><b>c</b></th></tr></table>"), (2, None), (3, "<table><tr>"), (4, "")], "doc_id long, html string")
    assert [tuple(r) for r in html_cells(df).orderBy("cell_no").collect()] == [(1, 0, 0, 0, "a & b"), (1, 0, 0, 1, "c")]


def test_totals_take_the_last_row_and_head(spark):
    html = "<table><tr><td>Resumo de materiais</td></tr><tr><td></td><td>Aço</td><td>Concreto</td></tr><tr><td>Totais</td><td>1</td><td>2</td></tr><tr><td>Totais gerais</td><td>1.000,5</td><td>-</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "doc_id long, html string")
    labels = R.operator("report_labels")(rv1_html_cells=html_cells(df))
    got = R.operator("rv2_report_totals")(report_html=df, report_labels=labels, report_heads=R.operator("report_heads")(report_labels=labels))
    assert sorted(map(tuple, got.collect())) == [(1, 1000.5, None), (2, None, None)]


def test_normal_quantile(spark):
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").selectExpr(diagnose.normal_quantile("p")).collect()
    assert [r[0] for r in got] == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in ps], abs=1e-7)


@pytest.mark.parametrize("family", ["forest", "linear"])
def test_regressor(spark, family):
    df = spark.range(200).selectExpr("double(id % 20) AS a", "double(id % 7) AS b", "3 * double(id % 20) + double(id % 7) AS y")
    got = models.fit_regressor(df, "y", ["a", "b"], family, **({"numTrees": 20} if family == "forest" else {})).transform(df)
    assert got.selectExpr("avg(abs(prediction - y))").first()[0] < 3


def test_validity_gives_class_zero(spark):
    df = spark.range(200).selectExpr("double(id) AS a", "int(id >= 150) AS valid")
    params = models.fit_scaler(df, ["a"])
    got = models.p_invalid(models.fit_validity(models.scale(df, params), "valid", ["a"]), models.scale(df, params))
    low, high = (got.where(c).selectExpr("avg(p_invalid)").first()[0] for c in ("valid = 0", "valid = 1"))
    assert low > 0.8 and high < 0.3
    with pytest.raises(ValueError, match="one class"):
        models.fit_validity(df.where("valid = 1"), "valid", ["a"])


EVENTS = "event_id long, worker long, ts timestamp, disk double, failed int"


def _streamed(spark, tmp_path, make, mode="append"):
    """Rows of a stream over two files that arrive one after another."""
    src = tmp_path / "in"
    rows = [(1, 1, "2024-01-01 00:00:00", 0.5, 1), (2, 1, "2024-01-01 00:10:00", 0.85, 1), (3, 2, "2024-01-01 00:00:00", 0.95, 0)], [(4, 1, "2024-01-01 00:20:00", 0.5, 1), (5, 1, "2024-01-01 00:30:00", 0.5, 0), (6, 2, "2024-01-01 09:00:00", 0.1, 1)]
    for part in rows:
        spark.createDataFrame(part, EVENTS.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(src))
    name = f"out_{tmp_path.name}".replace("-", "_")
    make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_breaker_keeps_its_count_between_batches(spark, tmp_path):
    assert [tuple(r) for r in _streamed(spark, tmp_path, telemetry.stream_circuit_breaker)] == [(1, 4, 3)]


def test_alerts(spark, tmp_path):
    assert sorted(map(tuple, _streamed(spark, tmp_path, telemetry.stream_alerts))) == [(2, 1, "warn"), (3, 2, "stop")]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    got = _streamed(spark, tmp_path, telemetry.stream_health_windows)
    assert sorted((r["worker"], r["n"], r["max_disk"]) for r in got) == [(1, 4, 0.85), (2, 1, 0.95)]


def test_silence_ends_a_session(spark, tmp_path):
    got = _streamed(spark, tmp_path, telemetry.stream_sessions)
    assert sorted((r["worker"], r["n"]) for r in got) == [(1, 4), (2, 1)]


def test_dedup_keeps_the_first_of_each_key(spark, tmp_path):
    assert sorted(r["event_id"] for r in _streamed(spark, tmp_path, telemetry.stream_dedup)) == [1, 2, 3, 6]


def test_live_best(spark, tmp_path):
    got = _streamed(spark, tmp_path, lambda s: telemetry.stream_live_best(s.selectExpr("worker AS run_id", "disk AS cost")), "complete")
    assert sorted(map(tuple, got)) == [(1, 0.5, 4), (2, 0.1, 2)]


def test_ledger_takes_each_row_once(spark, tmp_path):
    src, ledger, state = (str(tmp_path / n) for n in ("in", "ledger", "state"))
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(src)
        telemetry.collect_ledger(spark.readStream.schema("id long").parquet(src), ledger, state)
    assert spark.read.parquet(ledger).select("id").distinct().count() == spark.read.parquet(ledger).count() == 20


def test_breakdown_prefers_the_whole_table_and_the_head_above(spark):
    tr = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    summary = "<table>" + tr("Resumo de materiais") + tr("Pilares", "9", "9") + tr("", "Aço", "Concreto") + tr("Pilares", "1", "2") + tr("x", "Concreto", "Aço") + tr("PILARES", "3", "4") + tr("Fundações", "-", "") + tr("Totais (geral)", "5", "6") + "</table>"
    whole = "<table>" + tr("Elemento", "fck", "Aço", "Concreto", "Fôrma") + tr("Pilares", "25", "1.000,5", "7", "8") + tr("Lajes", "25", "1") + tr("Totais", "", "2", "3", "4") + "</table>"
    df = spark.createDataFrame([(1, summary), (2, summary + whole), (3, "<table>" + tr("a") + "</table>"), (4, None)], "doc_id long, html string")
    got = {(r["doc_id"], r["element"]): tuple(r)[2:] for r in R.over(spark, report_html=df)("rv3_report_breakdown").collect()}
    assert got == {(1, "columns"): (4.0, 3.0, None, None), (1, "foundations"): (None, None, None, None), (2, "columns"): (1000.5, 7.0, 8.0, 25.0), (2, "slabs"): (1.0, None, None, 25.0), (2, "total"): (2.0, 3.0, 4.0, None)}
