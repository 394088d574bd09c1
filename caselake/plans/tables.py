"""Queries that write derived tables to the shared folder and read them back, stream them, or fit models on them."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.operators import models
from caselake.operators.graph import shared_folder
from caselake.plans.relation import Relations
from caselake.sources import tables
from caselake.streaming import telemetry


#: A file is read as one value, so no file gets more reports than this, however many a task writes.
REPORTS = 2000


def _folder(spark: SparkSession) -> str:
    return posixpath.join(shared_folder(spark), f"tables-{uuid.uuid4().hex}")


def make(r: Relations) -> tuple[dict, dict[str, str]]:
    """Queries and their SQL."""

    def segment_file(spark: SparkSession, sf_dir: str) -> str:
        path = _folder(spark)
        seg = r.frame(spark, sf_dir, "seg")
        comma = {c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")) for c in ("x", "y", "dx", "dy", "length", "maxlength")}
        seg.withColumns(comma).write.csv(path, sep=";", header=True)
        return path

    def src1(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = tables.read_segments(spark, segment_file(spark, sf_dir))
        return got.select(*(F.col(c).cast("long").alias(c) for c in ("case_id", "seg_idx")), "x", "y", "x1", "y1", "length", "maxlength", "group_id")

    def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = tables.read_design_space(spark, segment_file(spark, sf_dir))
        return got.select(*(F.col(c).cast("long").alias(c) for c in ("case_id", "seg_idx")), "length", "maxlength", F.col("group_id").startswith("__solo_").cast("int").alias("solo"))

    def src3(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("x"), F.col("p_size").alias("y"), F.when(F.col("p_partkey") % 10 == 0, "bad").otherwise((F.col("p_partkey") % 2).cast("string")).alias("binary")).write.csv(path, sep=";", header=True)
        return tables.read_grid(spark, path)[0]

    def src4(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        r.frame(spark, sf_dir, "report_html").select("html").write.option("maxRecordsPerFile", REPORTS).text(path)
        return tables.read_reports(spark, f"{path}/part-*").select(F.length("html").alias("n_chars"))

    def snk3(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        tables.write_solution(r.frame(spark, sf_dir, "sm12_cost"), path)
        return spark.read.csv(path, sep=";", header=True).select(F.col("case_id").cast("long"), F.replace("cost", F.lit(","), F.lit(".")).cast("double").alias("cost"))

    def snk5(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = r.frame(spark, sf_dir, "log").select(F.col("run_id").cast("string").alias("name"), F.col("iteration").alias("idx"), F.col("cost").alias("value"))
        return tables.store_section(rows, _folder(spark), "all", "cost")

    def snk6(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = tables.regression_table(r.frame(spark, sf_dir, "reg"))
        return got.select("idx", *(F.round(c, 6).alias(c) for c in ("residual", "abs_error", "rel_error")))

    def ss6(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        source = f"{sf_dir}/events.parquet"
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source[:-1] + "[t]")
        telemetry.collect_ledger(stream.select("event_id", F.col("user_id").alias("worker"), "value"), f"{path}/ledger", f"{path}/state")
        return spark.read.parquet(f"{path}/ledger").select("event_id", "worker", "value")

    def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
        mat = r.frame(spark, sf_dir, "mat")
        model = models.fit_regressor(mat.where("k1 % 5 <> 0"), "score", ["q", "p", "d", "t"], "linear")
        return model.transform(mat.where("k1 % 5 = 0")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("prediction") - F.col("score"))).alias("mae"))

    def validity(spark: SparkSession, sf_dir: str) -> tuple:
        rows = r.frame(spark, sf_dir, "clf").selectExpr("idx", "valid", "p_invalid AS level", "double(idx % 97) AS slot")
        params = models.fit_scaler(rows.where("idx % 5 <> 0"), ["level", "slot"])
        return models.fit_validity(models.scale(rows.where("idx % 5 <> 0"), params), "valid", ["level", "slot"]), models.scale(rows, params)

    def ml8(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, rows = validity(spark, sf_dir)
        return models.p_invalid(model, rows).select("idx", "valid", "p_invalid")

    def ml7(spark: SparkSession, sf_dir: str) -> DataFrame:
        return models.coefficients(*validity(spark, sf_dir))

    def dg8(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, vec = (r.frame(spark, sf_dir, n) for n in ("vec_train", "vec"))
        return models.principal_components(train, vec).select("vec_id", "pc1", "pc2", "explained")

    def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
        return r.frame(spark, sf_dir, "mat").withColumn("fold", F.pmod(F.xxhash64("k1"), F.lit(3)).cast("int"))

    def ml10(spark: SparkSession, sf_dir: str) -> DataFrame:
        every = ["q", "p", "d", "t"]
        return models.ranked_candidates(models.cross_validate(folds(spark, sf_dir), "score", {"linear": ("linear", every, {}), "ridge": ("linear", every, {"regParam": 1.0}), "forest": ("forest", every, {"numTrees": 10})}))

    def ml12(spark: SparkSession, sf_dir: str) -> DataFrame:
        return models.ablation(folds(spark, sf_dir), "score", {"amount": ["q", "p"], "discount": ["d"], "tax": ["t"]})

    made = {"dg8_components": dg8, "ml10_cross_validation": ml10, "ml12_ablation": ml12, "src1_segments": src1, "src2_design_space": src2, "src3_grid": src3, "src4_reports": src4, "snk3_solution": snk3, "snk5_section": snk5, "snk6_regression_table": snk6, "ss6_ledger": ss6, "ml4_regressor": fitted, "ml7_coefficients": ml7, "ml8_p_invalid": ml8}
    with_seg = lambda sql, name="seg": r.duckdb(name).rsplit("\n", 1)[0] + "\n" + sql
    sql = {
        "src1_segments": with_seg("SELECT case_id, seg_idx, x, y, x + dx * length AS x1, y + dy * length AS y1, length, maxlength, group_id FROM seg"),
        "src2_design_space": with_seg("SELECT case_id, seg_idx, length, maxlength, CASE WHEN group_id IS NULL THEN 1 ELSE 0 END AS solo FROM seg"),
        "src3_grid": "SELECT CAST(p_partkey AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, CAST(p_partkey % 2 AS INTEGER) AS flag FROM part WHERE p_partkey % 10 <> 0",
        "snk3_solution": r.duckdb("sm12_cost"),
        "snk5_section": with_seg("SELECT CAST(run_id AS VARCHAR) AS name, count(*) AS n, max(iteration) AS last_idx FROM log GROUP BY run_id", "log"),
        "snk6_regression_table": with_seg("SELECT idx, round(y - yhat, 6) AS residual, round(abs(y - yhat), 6) AS abs_error, CASE WHEN y <> 0 THEN round((y - yhat) / y, 6) END AS rel_error FROM reg", "reg"),
        "ss6_ledger": "SELECT event_id, user_id AS worker, value FROM events",
    }
    return made, sql
