from __future__ import annotations

from caselake.plans import QUERIES


def test_breakdown_sends_no_cells_to_all_tasks(spark):
    """The files of the reports are small, their cells are not; a join that goes by the files' size would broadcast them."""
    df = QUERIES["rv3_report_breakdown"](spark, "/root/testdata/sf0.001")
    assert df.count() > 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan
