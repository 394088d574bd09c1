"""Ranks and running sums over a whole table, without a window that gathers it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselake.operators.graph import written

#: A row's number within its partition is the low part of Spark's increasing ids.
PART_BITS = 33


def in_order(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None, total: str | None = None) -> DataFrame:
    """``df`` range-sorted by ``order``, with ``_rank`` (long, from 0) and, for each name of ``sums``, the sum of that column over the rows before; ``total`` names a column for the number of rows.

    Spark samples the borders of the ranges, so no task holds more than about a partition's share however the values are
    spread; rows alike in every key of ``order`` share a range, so ``order`` should end in what tells rows apart. The sorted
    rows are written once: counts of partitions, summed over earlier partitions, are the only thing that crosses them. Null sums
    count as 0. Rows that tie in ``order`` get some order. Columns named ``_at``, ``_part``, ``_rank`` or ``_base...`` are taken.
    """
    sums = sums or {}
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", PART_BITS))
    wide = {name: F.sum(F.coalesce(F.col(c), F.lit(0))) for name, c in sums.items()}
    parts = placed.groupBy("_part").agg(F.count("*").alias("_base_rank"), *[w.alias(f"_base_{n}") for n, w in wide.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    names = ["_base_rank", *[f"_base_{n}" for n in sums]]
    every = [] if total is None else [F.sum("_base_rank").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total)]
    bases = parts.select("_part", *every, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in names])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = {n: F.col(f"_base_{n}") + F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))).over(inside), F.lit(0)) for n, c in sums.items()}
    rank = (F.col("_base_rank") + F.col("_at").bitwiseAND(F.lit((1 << PART_BITS) - 1))).cast("long")
    out = placed.join(bases, "_part").withColumns({"_rank": rank, **before})
    return out.drop("_part", "_at", *names)


def quantile(df: DataFrame, column: str, q: float, name: str) -> DataFrame:
    """One row with the exact ``q``-quantile of a column, linear between neighbours; nulls are left out, no rows give null.

    The values are range-sorted and the two of the wanted ranks read, so no task gathers the distinct values.
    """
    rows = in_order(df.select(F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL"), [F.col("_v")], total="_n")
    at = (F.col("_n") - 1) * F.lit(q)
    near = rows.where((F.col("_rank") == F.floor(at)) | (F.col("_rank") == F.ceil(at)))
    return near.agg((F.min("_v") + (F.max("_v") - F.min("_v")) * F.max(at - F.floor(at))).alias(name))
