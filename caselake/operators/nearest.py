"""Exact nearest rows of a stated set of vectors, in blocks of both sides, and what is read from the distances."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselake.operators.graph import written

if TYPE_CHECKING:  # workers import this module by itself
    from caselake.plans.relation import Relations

#: Vectors of one side that meet in one task.
BLOCK = 4096


def _matrix(side: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.array(side.column("v").to_pylist(), np.float64)


def _to_pivots(side: pa.RecordBatch, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot."""
    m = _matrix(side)
    return np.stack([np.sqrt(((m - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(m) else np.zeros((0, len(pivots)))


def _meeting(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a block of test rows and a block of training rows (id, v) do in a task: the ``k`` nearest of the one for each of the other."""

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(some) and len(others):
            ids, m = others.column("id").to_numpy(), _matrix(others)
            for own, v in zip(some.column("id").to_pylist(), _matrix(some), strict=True):
                d = np.sqrt(((m - v) ** 2).sum(axis=1))
                best = np.lexsort((ids, d))[: max(k, 0)]
                out.append((np.full(len(best), own), ids[best], d[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pa.table({"id": pa.array(cols[0].astype(np.int64)), "near_id": pa.array(cols[1].astype(np.int64)), "distance": pa.array(cols[2].astype(np.float64))})

    return meet


def nearest(test: DataFrame, train: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, rank, near_id, distance): the min(k, rows of ``train`` - 1) nearest rows of ``train`` by Euclidean distance, ties to the smaller id.

    Each block of test rows meets each block of training rows in a task of its own and sends on ``k`` rows for each test row, so
    no task holds a whole side. A test row that is in ``train`` finds itself. Rows with a null id or vector take no part;
    vectors must all be of one length.
    """
    sides = [df.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) for df in (test, train)]
    counts = [s.count() for s in sides]
    k = min(k, counts[1] - 1)
    of_test, of_train = (max(1, math.ceil(n / block)) for n in counts)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sides[0].select("*", mine(of_test).alias("a"), every(of_train).alias("b"))
    right = sides[1].select("*", every(of_test).alias("a"), mine(of_train).alias("b"))

    meet = _meeting(k)
    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, "id long, near_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "near_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias(id), "rank", "near_id", "distance")


def nearest_pruned(test: DataFrame, train: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", pivots: int = 64, block: int = BLOCK) -> DataFrame:
    """The rows of ``nearest``, by fewer comparisons: training rows are filed under the nearest of ``pivots`` rows, and a test row visits a cell only
    if the triangle inequality lets it hold one of its ``k`` nearest.

    First a test row visits the nearest cells that hold ``k`` rows together; the k-th distance found bounds its true one. Then it visits the
    other cells whose pivot is no farther than that plus the cell's radius. Cells and their visitors are cut into blocks, so no task holds a whole cell.
    The pivots are the training rows of smallest hash, and the driver gets no more than them and a row for each cell.
    """
    filed, visits, k = _first_visits(test, train, k, id, vector, pivots)
    if filed is None or k < 1:
        return nearest(test, train, max(k, 0), id, vector, block)
    first = written(_visited(visits.where("first"), filed, k, block))
    reach = first.groupBy("id").agg(F.sort_array(F.collect_list("distance"))[k - 1].alias("reach"))  # k rows for each cell visited
    more = visits.where("NOT first").join(reach, "id").where(F.col("low") <= F.col("reach") * (1 + 1e-12))
    met = first.union(_visited(more.select(visits.columns), filed, k, block))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "near_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias(id), "rank", "near_id", "distance")


def _first_visits(test: DataFrame, train: DataFrame, k: int, id: str, vector: str, pivots: int) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Training rows (id, v, cell), and for each test row and cell (id, v, cell, low, first): the least distance to a row there, and whether to visit it first."""
    sides = [df.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) for df in (test, train)]
    chosen = np.array([r["v"] for r in sides[1].orderBy(F.xxhash64("id"), "id").limit(pivots).collect()], np.float64)
    if not len(chosen):
        return None, None, 0

    def file(batches):
        for b in batches:
            d = _to_pivots(b, chosen)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], names=["id", "v", "cell", "d"])

    filed = written(sides[1].mapInArrow(file, "id long, v array<double>, cell int, d double"))
    sizes, radius = np.zeros(len(chosen), np.int64), np.zeros(len(chosen))
    for r in filed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect():
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    k = min(k, int(sizes.sum()) - 1)

    def visit(batches):
        for b in batches:
            d = _to_pivots(b, chosen)
            near = np.argsort(d, axis=1, kind="stable")
            held = np.cumsum(sizes[near], axis=1) - sizes[near]
            first = np.zeros(d.shape, bool)
            np.put_along_axis(first, near, held < k, axis=1)
            row, cell = np.nonzero(np.broadcast_to(sizes > 0, d.shape))
            low = np.maximum(d - radius, 0)[row, cell]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(low), pa.array(first[row, cell])], names=["id", "v", "cell", "low", "first"])

    return filed.select("id", "v", "cell"), sides[0].mapInArrow(visit, "id long, v array<double>, cell int, low double, first boolean"), k


def _visited(visits: DataFrame, filed: DataFrame, k: int, block: int) -> DataFrame:
    """(id, near_id, distance): the ``k`` nearest rows of each cell that a test row visits, at most, for each of its blocks."""
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    plan = F.broadcast(blocks(visits, "of_test").join(blocks(filed, "of_train"), "cell"))  # a row for each pivot
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.select("id", "v", "cell").join(plan, "cell").select("id", "v", "cell", mine("of_test").alias("a"), every("of_train").alias("b"))
    right = filed.join(plan, "cell").select("id", "v", "cell", every("of_test").alias("a"), mine("of_train").alias("b"))
    return left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInArrow(_meeting(k), "id long, near_id long, distance double")


def define(r: Relations) -> None:
    r.add("vec", "SELECT vec_id, embedding FROM {embeddings} WHERE embedding IS NOT NULL")
    r.add("vec_train", "SELECT vec_id, embedding FROM {vec} WHERE vec_id % 5 <> 0")
    r.add("vec_test", "SELECT vec_id, embedding FROM {vec} WHERE vec_id % 5 = 0")
    r.add("jn9_nearest", """
SELECT vec_id, CAST(rank AS INTEGER) AS rank, near_id, round(distance, 6) AS distance FROM (SELECT vec_id, near_id, distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, near_id) AS rank FROM (
  SELECT a.vec_id, b.vec_id AS near_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance FROM {vec_test} a CROSS JOIN {vec_train} b))
WHERE rank <= least(5, (SELECT count(*) - 1 FROM {vec_train}))""", lambda vec_test, vec_train: nearest(vec_test, vec_train).withColumn("distance", F.round("distance", 6)))
    r.add("jn9_pruned", "SELECT vec_id, rank, near_id, distance FROM {jn9_nearest}")
    r.at_once("jn9_pruned", ("vec_test", "vec_train"), lambda vec_test, vec_train: nearest_pruned(vec_test, vec_train).withColumn("distance", F.round("distance", 6)))
    r.add("sm7_nearest_train", "SELECT vec_id, near_id, distance FROM {jn9_nearest} WHERE rank = 1")
    r.add("dg10_coverage", "SELECT count(*) AS n, round(avg(mean_distance), 4) AS mean_distance FROM (SELECT vec_id, avg(distance) AS mean_distance FROM {jn9_nearest} GROUP BY vec_id)")
