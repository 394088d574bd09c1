from __future__ import annotations

from pyspark.sql import functions as F

from caselake.plans import QUERIES
from caselake.plans import RELATIONS as R
from caselake.plans.tables import REPORTS


def test_no_report_file_grows_with_the_table(spark):
    """A file is one value when it is read; all reports are still there, each with its line end."""
    html = R.frame(spark, "/root/testdata/sf0.1", "report_html")
    total, longest = html.agg(F.sum(F.length("html") + 1), F.max(F.length("html") + 1)).first()
    got = [r["n_chars"] for r in QUERIES["src4_reports"](spark, "/root/testdata/sf0.1").collect()]
    assert sum(got) == total and max(got) <= REPORTS * longest < total
