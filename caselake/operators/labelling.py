"""Labels by a user's backend: attempts, failures as rows, and a ledger so that a case is labelled once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "case_id long, status string, attempts int, steel double, concrete double, valid int, error string"
#: A backend takes a case as a dict of its columns and returns (steel, concrete, valid), or raises.
Backend = Callable[[dict[str, Any]], tuple[float, float, bool]]


def label_cases(cases: DataFrame, backend: Backend, ledger: DataFrame | None = None, attempts: int = 3, retry_failed: bool = False) -> DataFrame:
    """Ledger rows of the cases that ``ledger`` has none of: completed with their labels, or failed with the last error.

    A backend that raises, or returns a steel or concrete that isn't finite, is tried ``attempts`` times. With ``retry_failed`` cases whose last
    rows are failures are tried again. Rows of one case_id are labelled once, any of them; a null case_id is no case.
    The backend runs where the rows are, a batch at a time; other columns reach it as they are.
    """
    open_ = cases.where("case_id IS NOT NULL").dropDuplicates(["case_id"])
    if ledger is not None:
        done = ledger.where("status = 'completed'" if retry_failed else "status IN ('completed', 'failed')").select("case_id").distinct()
        open_ = open_.join(done, "case_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                error, made, tries = None, (None, None, None), 0
                while tries < attempts and made[0] is None:
                    tries += 1
                    try:
                        steel, concrete, valid = backend(row)
                        if not (abs(steel) < float("inf") and abs(concrete) < float("inf")):
                            raise ValueError("steel or concrete isn't finite")
                        made, error = (float(steel), float(concrete), int(valid)), None
                    except Exception as e:  # the backend's own errors are results here
                        error = f"{type(e).__name__}: {e}"
                out.append((row["case_id"], "failed" if error else "completed", tries, *made, error))
            yield pd.DataFrame(out, columns=["case_id", "status", "attempts", "steel", "concrete", "valid", "error"]).astype({"valid": "Int32", "steel": "Float64", "concrete": "Float64"})

    return open_.mapInPandas(run, LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each case of the ledger at ``path``: completed before failed, then more attempts."""
    rows = spark.read.schema(LEDGER).parquet(path)
    order = F.struct((F.col("status") == "completed").alias("c"), F.col("attempts"), *[F.col(c) for c in ("status", "steel", "concrete", "valid", "error")])
    best = rows.groupBy("case_id").agg(F.max(order).alias("b"))
    return best.select("case_id", "b.status", "b.attempts", "b.steel", "b.concrete", "b.valid", "b.error")


def collect_labels(cases: DataFrame, backend: Backend, path: str, attempts: int = 3, retry_failed: bool = False) -> DataFrame:
    """Label what the ledger at ``path`` lacks, append it there, and return the ledger. A lost executor repeats its batch; the rows are committed once."""
    spark = cases.sparkSession
    known = spark.read.schema(LEDGER).parquet(path) if _exists(spark, path) else None
    label_cases(cases, backend, known, attempts, retry_failed).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
