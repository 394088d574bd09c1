"""Readers and writers of segment tables, run records and reports.

Readers keep every column as text until it is parsed, so that a bad number costs a row or a value but never the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.functions.columns import parse_simple_number

SEGMENT_COLUMNS = ("x", "y", "dx", "dy", "length")
SPACE_COLUMNS = (*SEGMENT_COLUMNS, "maxlength")
FLAG_COLUMNS = ("binario", "binary", "binary_flag")


def _text_table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, sep=";", header=True, encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*(c.lstrip("\ufeff").strip().lower() for c in df.columns))


def _require(df: DataFrame, names: Sequence[str], path: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{path}: columns missing: {', '.join(missing)}")


def _with_optional(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with their end points; ``maxlength`` and ``group_id`` are null where the file has none. Bad numbers are null."""
    df = _text_table(spark, path)
    _require(df, SEGMENT_COLUMNS, path)
    df = _with_optional(df, "maxlength", "group_id").withColumns({c: parse_simple_number(F.col(c)) for c in SPACE_COLUMNS})
    return df.withColumns({"x1": F.col("x") + F.col("dx") * F.col("length"), "y1": F.col("y") + F.col("dy") * F.col("length")})


def read_design_space(spark: SparkSession, path: str) -> DataFrame:
    """``read_segments`` of a file that must have ``maxlength``; a blank group becomes one of the segment's own."""
    df = _text_table(spark, path)
    _require(df, SPACE_COLUMNS, path)
    seg = read_segments(spark, path)
    solo = F.concat(F.lit("__solo_"), F.monotonically_increasing_id().cast("string"))
    return seg.withColumn("group_id", F.when(F.trim(F.coalesce("group_id", F.lit(""))) == "", solo).otherwise(F.col("group_id")))


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (x, y, flag) of a grid, and the rows that did not parse, as read."""
    df = _text_table(spark, path)
    _require(df, ("x", "y"), path)
    flags = [c for c in FLAG_COLUMNS if c in df.columns]
    if not flags:
        raise ValueError(f"{path}: needs one of the columns {', '.join(FLAG_COLUMNS)}")
    parsed = df.withColumns({"_x": parse_simple_number(F.col("x")), "_y": parse_simple_number(F.col("y")), "_flag": F.coalesce(*flags).try_cast("int")})
    good = F.col("_x").isNotNull() & F.col("_y").isNotNull() & F.coalesce(F.col("_flag").isin(0, 1), F.lit(False))
    return parsed.where(good).select(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_flag").alias("flag")), parsed.where(~good).select(*df.columns)


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """(path, html) of report files: UTF-8 with or without its mark, else Latin-1."""
    raw = spark.read.format("binaryFile").load(glob)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return raw.select("path", F.regexp_replace(text, "^\ufeff", "").alias("html"))


def read_checkpoint(spark: SparkSession, path: str, features: Sequence[str], version: int = 1) -> DataFrame:
    """One row per sample of a checkpoint: (row, features, target). Raises where the contract does not hold.

    The file must name the version and the features in this order, hold as many targets as rows and only finite numbers.
    """
    df = spark.read.schema("version int, names array<string>, x array<array<double>>, y array<double>, complete boolean").json(path, multiLine=True)
    finite = lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(v)
    ok = F.coalesce(
        (F.col("version") == version) & (F.col("names") == F.array(*map(F.lit, features))) & F.col("complete") & (F.size("x") == F.size("y"))
        & F.forall("x", lambda r: (F.size(r) == len(features)) & F.forall(r, finite)) & F.forall("y", finite),
        F.lit(False),
    )
    checked = df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("checkpoint does not hold its contract")).cast("boolean")))
    return checked.select(F.posexplode(F.arrays_zip("x", "y")).alias("row", "s")).select("row", F.col("s.x").alias("features"), F.col("s.y").alias("target"))


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that parse; blank and broken lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One row per run folder below ``root``, with ``run_id`` from the folder's name."""
    df = spark.read.schema(schema).json(f"{root}/*/metrics/summary.json", multiLine=True)
    return df.withColumn("run_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/metrics/summary\.json$", 1))


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Final vectors (config_index, segment_index, start_x, start_y, end_x, end_y, length), six decimals."""
    numbers = ("start_x", "start_y", "end_x", "end_y", "length")
    df.select("config_index", "segment_index", *(F.format_string("%.6f", F.col(c)).alias(c) for c in numbers)).write.csv(path, sep=";", header=True, mode="overwrite")


def write_solution(df: DataFrame, path: str) -> None:
    """Numbers with a decimal comma."""
    number = {"double", "float"}
    cols = [F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) if t in number or t.startswith("decimal") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.csv(path, sep=";", header=True, mode="overwrite")


def store_section(df: DataFrame, path: str, run_id: str, section: str) -> DataFrame:
    """Replace one section of one run, leaving all others; returns the section's manifest (name, n, last_idx).

    ``df`` has (name, idx, value), value a number; other types are refused.
    """
    kind = dict(df.dtypes)["value"]
    if kind not in {"double", "float", "int", "bigint"}:
        raise TypeError(f"a section stores numbers, not {kind}")
    rows = df.select("name", "idx", F.col("value").cast("double"), F.lit(run_id).alias("run_id"), F.lit(section).alias("section"))
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "section").mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path).where((F.col("run_id") == run_id) & (F.col("section") == section))
    return stored.groupBy("name").agg(F.count("*").alias("n"), F.max("idx").alias("last_idx"))


def regression_table(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Residual, absolute and relative error; the last is null where the actual value is 0."""
    return df.withColumns({"residual": F.col(y) - F.col(yhat), "abs_error": F.abs(F.col(y) - F.col(yhat)), "rel_error": F.when(F.col(y) != 0, (F.col(y) - F.col(yhat)) / F.col(y))})
