"""Contracts of artifacts: which features, in which order and units, a model or a ledger was made for."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Contract = dict[str, Any]


def _text(value: Column | Any) -> Column:
    """A value as JSON, so that order and type of lists count."""
    return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v")))).otherwise(F.lit(None)) if isinstance(value, Column) else F.lit(json.dumps({"v": value}, separators=(",", ":"), ensure_ascii=False))


def _plain(text: Column) -> Column:
    return F.substring(text, 6, F.length(text) - 6)


def contract_problems(artifacts: DataFrame, contract: Contract, key: str, soft: Sequence[str] = ()) -> DataFrame:
    """(key, field, problem, found, expected, hard): a row for each field of an artifact that isn't what ``contract`` says.

    ``artifacts`` has a row for each artifact, fields as columns. A field that is null, or no column at all, is ``missing``, another value a
    ``mismatch``; values are compared as JSON, so lists must have the same names in the same order. Fields in ``soft`` are warnings,
    the others are hard. Other columns aren't read. An artifact without a problem has no row.
    """
    fields = []
    for name, expected in contract.items():
        found = _text(F.col(name)) if name in artifacts.columns else F.lit(None).cast("string")
        fields.append(F.struct(F.lit(name).alias("field"), _plain(found).alias("found"), _plain(_text(expected)).alias("expected"), F.lit(name not in soft).alias("hard")))
    each = artifacts.select(F.col(key), F.explode(F.array(*fields)).alias("f")).select(key, "f.*")
    each = each.where(~F.col("found").eqNullSafe(F.col("expected")))
    return each.select(key, "field", F.when(F.col("found").isNull(), "missing").otherwise("mismatch").alias("problem"), "found", "expected", "hard")


def _first_error(artifact: DataFrame, contract: Contract, label: str, soft: Sequence[str]) -> DataFrame:
    """One row (error): what the hard fields of all rows of ``artifact`` are at odds with, or null."""
    fields = [c for c in contract if c not in soft]
    named = {n: _plain(_text(F.col(n))) if n in artifact.columns else F.lit(None).cast("string") for n in fields}
    wrong = F.concat_ws(", ", *[F.when(~v.eqNullSafe(_plain(_text(contract[n]))), F.concat(F.lit(f"{n}: artifact "), v, F.lit(" expected "), _plain(_text(contract[n])))) for n, v in named.items()])
    gone = F.concat_ws(", ", *[F.when(v.isNull(), F.lit(n)) for n, v in named.items()])
    error = F.when(gone != "", F.concat(F.lit(f"{label} is missing required contract fields: "), gone)).when(wrong != "", F.concat(F.lit(f"{label} contract is incompatible: "), wrong))
    none = F.when(F.count("*") == 0, F.lit(f"{label} is missing: no artifact"))
    return artifact.agg(F.coalesce(F.min(error), none).alias("error"))


def require_contract(df: DataFrame, artifact: DataFrame, contract: Contract, label: str = "artifact", soft: Sequence[str] = ()) -> DataFrame:
    """``df``, which fails as soon as it is run if a row of ``artifact`` breaks a hard field of ``contract``.

    The check is a part of the plan: no job runs here. The error names missing fields, or each field at odds with both of its values.
    Soft fields are left to ``contract_problems``. An empty ``artifact`` is an error too.
    """
    row = F.broadcast(_first_error(artifact, contract, label, soft))  # one row
    kept = df.join(row.withColumnRenamed("error", "_error"))
    return kept.where(F.when(F.col("_error").isNull(), True).otherwise(F.raise_error(F.col("_error")).cast("boolean"))).drop("_error")


def resume_guard(pending: DataFrame, ledger: DataFrame, seed_hash: str, schema_version: int, names: Sequence[str]) -> DataFrame:
    """``pending`` of a collection whose ``ledger`` (seed_hash, schema_version, feature_names) began under the same seed, schema and names; else it fails when run."""
    return require_contract(pending, ledger.select(*[c for c in ("seed_hash", "schema_version", "feature_names") if c in ledger.columns]).distinct(), {"seed_hash": seed_hash, "schema_version": schema_version, "feature_names": list(names)}, "ledger")


def require_isolation(df: DataFrame, part: str, features: Sequence[str]) -> DataFrame:
    """``df``, which fails when run if a row of features (equal in all of them, nulls too) stands in two parts: split leakage."""
    row = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(features)])
    shared = df.groupBy(row.alias("_f")).agg(F.count_distinct(part).alias("_parts")).where("_parts > 1").agg(F.count("*").alias("_shared"))
    kept = df.join(F.broadcast(shared))  # one row
    fails = F.raise_error(F.concat(F.lit("split leakage: feature rows in several parts: "), F.col("_shared").cast("string"))).cast("boolean")
    return kept.where(F.when(F.col("_shared") == 0, True).otherwise(fails)).drop("_shared")
