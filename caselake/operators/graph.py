"""Connected components inside cases, and tables in the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cases of up to so many segments are solved as arrays; in larger ones labels travel in rounds of joins.
AS_ARRAY = 64


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session may do without one: there a temporary folder is shared by all."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _small(rects: DataFrame) -> DataFrame:
    """Components of whole cases as arrays: each round a rectangle takes the least label of those that touch it."""
    cases = rects.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "rx0", "rx1", "ry0", "ry1"))).alias("r"))
    touch = "x.rx0 <= y.rx1 AND y.rx0 <= x.rx1 AND x.ry0 <= y.ry1 AND y.ry0 <= x.ry1"
    labels = f"aggregate(sequence(1, size(r)), transform(r, (x, i) -> i), (l, k) -> transform(r, (x, i) -> array_min(transform(r, (y, j) -> CASE WHEN {touch} THEN l[j] ELSE l[i] END))))"
    return cases.select("case_id", "r", F.explode(F.expr(f"transform({labels}, (l, i) -> struct(r[i].seg_idx AS seg_idx, r[l].seg_idx AS component))")).alias("c")).select("case_id", "c.seg_idx", "c.component")


#: Side of the grid under whose fields the rectangles of larger cases are filed.
FIELD = 200.0


def _filed(rects: DataFrame) -> DataFrame:
    """``rects`` once for each field of the grid that they reach; those of small cases all under one."""
    size = rects.groupBy("case_id").agg((F.count("*") > AS_ARRAY).alias("_large")).withColumnRenamed("case_id", "_case")
    fields = lambda d: f"if(_large, sequence(cast(floor(r{d}0 / {FIELD}) AS BIGINT), cast(floor(r{d}1 / {FIELD}) AS BIGINT)), array(0L))"
    joined = rects.join(size, F.col("case_id") == F.col("_case")).drop("_case")
    return joined.withColumn("_gx", F.explode(F.expr(fields("x")))).withColumn("_gy", F.explode(F.expr(fields("y"))))


def meeting(left: DataFrame, right: DataFrame, where: str) -> DataFrame:
    """Rows of ``left`` (named a) and ``right`` (b) of one case whose rectangles (rx0, rx1, ry0, ry1) meet and for which ``where`` holds, each pair once.

    In cases of over ``AS_ARRAY`` rectangles only those that share a field of a grid are compared, and a pair counts in the field that holds
    the low corner of what they share, so the work grows with the rectangles and the pairs there are, not with the square of a case.
    """
    a, b = _filed(left).alias("a"), _filed(right).alias("b")
    corner = " AND ".join(f"(NOT a._large AND NOT b._large OR floor(greatest(a.r{d}0, b.r{d}0) / {FIELD}) = a._g{d})" for d in "xy")
    touch = "a.rx0 <= b.rx1 AND b.rx0 <= a.rx1 AND a.ry0 <= b.ry1 AND b.ry0 <= a.ry1"
    return a.join(b, F.expr(f"a.case_id = b.case_id AND a._gx = b._gx AND a._gy = b._gy AND {touch} AND {corner} AND {where}"))


def touching_pairs(fn4_rectangles: DataFrame) -> DataFrame:
    return meeting(fn4_rectangles, fn4_rectangles, "a.seg_idx < b.seg_idx").select("a.case_id", F.col("a.seg_idx").alias("a"), F.col("b.seg_idx").alias("b"))


def conflict_pairs(fn4_rectangles: DataFrame, group_axis: DataFrame) -> DataFrame:
    """Groups along x and along y that share an area of over 1e-9. The size of a case is that of all its rectangles."""
    rows = fn4_rectangles.join(group_axis.select("case_id", "group_key", "axis"), ["case_id", "group_key"])
    wide, high = "(least(a.rx1, b.rx1) - greatest(a.rx0, b.rx0))", "(least(a.ry1, b.ry1) - greatest(a.ry0, b.ry0))"
    met = meeting(rows, rows, f"a.axis = 'x' AND b.axis = 'y' AND {wide} > 0 AND {high} > 0 AND {wide} * {high} > 1e-9")
    return met.select("a.case_id", F.col("a.group_key").alias("x_group"), F.col("b.group_key").alias("y_group")).distinct()


def touching_components(rects: DataFrame, pairs: DataFrame) -> DataFrame:
    """(case_id, seg_idx, component) of rectangles (case_id, seg_idx, rx0, rx1, ry0, ry1), of which ``pairs`` (case_id, a, b) touch."""
    large = rects.groupBy("case_id").count().where(F.col("count") > AS_ARRAY).select("case_id")
    if large.isEmpty():
        return _small(rects)
    large = written(large)
    most = rects.join(large, "case_id", "left_anti")
    return _small(most).union(components(rects.join(large, "case_id", "left_semi"), pairs.join(large, "case_id", "left_semi")))


def components(nodes: DataFrame, edges: DataFrame, by: str = "case_id", node: str = "seg_idx", rounds: int = 60) -> DataFrame:
    """(by, node, component): the smallest node reachable over ``edges`` (by, a, b); nodes without edges stand alone.

    Each round hands the smallest label of a node's neighbours on and then follows labels to their own label,
    so rounds grow with the logarithm of the longest path; only nodes that have edges take part.
    """
    both = written(edges.select(by, "a", "b").union(edges.select(by, F.col("b"), F.col("a"))).distinct())
    label = both.groupBy(by, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    for _ in range(rounds):
        label = written(label)
        near = both.join(label.select(by, F.col("a").alias("b"), F.col("m").alias("mb")), [by, "b"]).groupBy(by, "a").agg(F.min("mb").alias("mb"))
        low = label.join(near, [by, "a"]).select(by, "a", "m", F.least("m", "mb").alias("l"))
        hop = low.select(by, F.col("a").alias("l"), F.col("l").alias("ll"))
        after = written(low.join(hop, [by, "l"], "left").select(by, "a", "m", F.least("l", F.coalesce("ll", "l")).alias("new")))
        label = after.select(by, "a", F.col("new").alias("m"))
        if after.where("new <> m").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(label.withColumnRenamed("a", node), [by, node], "left").select(by, node, F.coalesce("m", node).alias("component"))
