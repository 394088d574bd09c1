"""Splits by class and choices by bins: exact quotas, draws by keyed uniforms, ranks by range sort, errors where a class or a bin is too small."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.operators.importance import drawn
from caselake.operators.ranks import in_order

#: The most classes or bins that a split takes: their counts are all that the driver sees.
MOST = 1000


def quotas(counts: Sequence[int], take: int) -> list[int]:
    """``take`` dealt over groups in proportion to ``counts``, by largest remainders, ties to the earlier group."""
    total = sum(counts)
    whole = [take * c // total for c in counts]
    rest = sorted(range(len(counts)), key=lambda k: (-(take * counts[k] % total), k))[: take - sum(whole)]
    return [w + (k in rest) for k, w in enumerate(whole)]


def _counts(df: DataFrame, group: str) -> dict:
    rows = df.groupBy(group).count().orderBy(group).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} classes or bins")
    return {r[group]: r["count"] for r in rows}


def _first_of(df: DataFrame, group: str, sizes: dict, quota: dict, order: list[Column]) -> DataFrame:
    """``df`` with _in: a row's number within its group in ``order``, from 0; and _taken: whether that is under the group's quota."""
    start, before = {}, 0
    for g, n in sizes.items():
        start[g], before = before, before + n
    of = lambda values: F.element_at(F.create_map(*[x for g, v in values.items() for x in (F.lit(g), F.lit(v))]), F.col(group))
    placed = in_order(df, [F.col(group), *order])
    return placed.withColumn("_in", F.col("_rank") - of(start)).withColumn("_taken", F.col("_in") < of(quota)).drop("_rank")


def split_classes(df: DataFrame, id: str, label: str, test_ratio: float = 0.2, validation_ratio: float = 0.25, prefix: int = 0, seed: int = 3) -> DataFrame:
    """(id, label, part): test rows are drawn from rows after the first ``prefix`` by ``id`` alone, then validation from all others, both with the classes in proportion.

    Test is ``test_ratio`` of all rows, validation ``validation_ratio`` of the rest, rounded up. Raises ValueError for fewer than three rows or two
    classes, null labels, a ratio outside (0, 1), a prefix that leaves too few rows, and a class too small to stand in a draw. Rows that repeat an id are apart rows.
    """
    if not (0 < test_ratio < 1 and 0 < validation_ratio < 1):
        raise ValueError("test_ratio and validation_ratio must be between 0 and 1.")
    rows = in_order(df.select(id, label), [F.col(id)])
    sizes = _counts(rows, label)
    n = sum(sizes.values())
    if None in sizes:
        raise ValueError("Labels must not be null.")
    if n < 3:
        raise ValueError("At least three labels are required for a three-way split.")
    if len(sizes) < 2:
        raise ValueError("At least two classes are required for classification.")
    if not 0 <= prefix <= n:
        raise ValueError("The prefix is outside the dataset.")
    test = math.ceil(n * test_ratio)
    if n - prefix <= test:
        raise ValueError(f"There are not enough new samples to create a final test set after protecting {prefix} rows.")
    new = rows.where(F.col("_rank") >= prefix).select(id, label)
    of_new = _counts(new, label)
    quota = _sure(of_new, sizes, test, "The new samples")
    marked = _first_of(new, label, of_new, quota, [drawn(str(seed), F.col(id)), F.col(id)])
    rest = rows.where(F.col("_rank") < prefix).select(id, label).unionByName(marked.where("NOT _taken").select(id, label))
    of_rest = {c: sizes[c] - quota.get(c, 0) for c in sizes}
    take = _sure(of_rest, sizes, math.ceil((n - test) * validation_ratio), "The development data")
    both = _first_of(rest, label, of_rest, take, [drawn(str(seed + 1), F.col(id)), F.col(id)])
    out = both.select(id, label, F.when(F.col("_taken"), "validation").otherwise("train").alias("part"))
    return out.unionByName(marked.where("_taken").select(id, label, F.lit("test").alias("part")))


def _sure(sizes: dict, classes: dict, take: int, what: str) -> dict:
    if any(sizes.get(c, 0) < 2 for c in classes) or take < len(classes) or sum(sizes.values()) - take < len(classes):
        raise ValueError(f"{what} do not contain enough observations of every class for a stratified draw.")
    return dict(zip(sizes, quotas(list(sizes.values()), take), strict=True))


def choose_by_bins(df: DataFrame, id: str, value: str, p: str, edges: Sequence[float], size: int, threshold: float, half_width: float, protected: float = 0.0, seed: int = 82) -> DataFrame:
    """(id, bin, near, place, role): ``size`` rows, as many from each bin of ``value``; rows whose ``p`` is within ``half_width`` of ``threshold`` first, then by a keyed draw.

    Bins hold their lower edge, the last both; rows outside, and null values, are left out. ``protected`` is the share of rows, over all bins, that get the role ``protected_evaluation``, the
    others ``development``. Raises ValueError if edges don't rise strictly or ``size`` isn't a multiple of the bins, and RuntimeError if a bin has too few rows.
    """
    bins = len(edges) - 1
    if bins < 1 or any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("The edges of bins must be strictly increasing.")
    if size % bins or not 0 <= protected <= 1:
        raise ValueError("The size must be a multiple of the bins, the protected share between 0 and 1.")
    v = F.col(value)
    bin_ = F.coalesce(*[F.when((v >= a) & ((v < b) if k < bins - 1 else (v <= b)), k) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    near = F.coalesce((F.abs(F.col(p) - threshold) <= half_width).cast("int"), F.lit(0))
    rows = df.select(F.col(id), bin_.alias("bin"), near.alias("near")).where("bin IS NOT NULL")
    sizes, each = _counts(rows, "bin"), size // bins
    short = {k: sizes.get(k, 0) for k in range(bins) if sizes.get(k, 0) < each}
    if short:
        raise RuntimeError(f"Insufficient candidates: bins hold {short} of {each} rows")
    taken = _first_of(rows, "bin", sizes, dict.fromkeys(sizes, each), [F.col("near").desc(), drawn(str(seed), F.col(id)), F.col(id)]).where("_taken").drop("_taken")
    kept = dict(enumerate(quotas([each] * bins, round(size * protected))))
    out = _first_of(taken.withColumnRenamed("_in", "place"), "bin", dict.fromkeys(range(bins), each), kept, [drawn(str(seed + 1), F.col(id)), F.col(id)])
    return out.select(id, "bin", "near", F.col("place").cast("long").alias("place"), F.when(F.col("_taken"), "protected_evaluation").otherwise("development").alias("role"))
