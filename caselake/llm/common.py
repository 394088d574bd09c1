"""What the training-data operators share: tables, cutting of lineage, connected components, bounded word caches."""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.operators.graph import shared_folder, written

#: Rows of one Arrow batch; whole texts travel in it, so it is far under Spark's default.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small: an executor's Python workers hold one batch each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``; only local sessions may do without one.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table in the shared folder; it stays there until the folder is cleared."""
    return written(df)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished rounds, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def count_for(total: int, each: int) -> int:
    """How many groups of about ``each`` a total makes: grows with the input."""
    return max(1, math.ceil(total / each))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links`` (a, b): rows (node, component), component the smallest node.

    Large-star and small-star contraction: every round each node points its larger neighbours, then its
    smaller ones, at the smallest node it sees, until nothing changes. A hub costs one row for each of its
    neighbours, and the number of rounds grows with the logarithm of the longest path. Links stay in Spark;
    each round is written to the shared folder, so lost executors cost at most one round.
    Nodes without links are not returned. Null ends and self links are ignored.
    """
    now = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    low = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = low.select(F.col("component").alias("node"), "component").distinct()
    return low.select(F.col("u").alias("node"), "component").union(roots)


class Codes(dict):
    """word -> number in order of first sight; ``new`` lists the words not yet valued."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Grown:
    """Rows of numbers appended in blocks, with room to spare."""

    def __init__(self, width: int | None = None, dtype=np.float64) -> None:
        self.n, self.a = 0, np.zeros((1024,) if width is None else (1024, width), dtype)

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.a):
            self.a = np.concatenate([self.a, np.zeros((max(len(rows), len(self.a)), *self.a.shape[1:]), self.a.dtype)])
        self.a[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many slices, one after the other."""
    ends = np.cumsum(lengths)
    out = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def blob_of(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def bytes_and_offsets(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow binary column without a copy of each value, and where each value starts; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.array([], pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def texts_of(column) -> list[bytes]:
    """The bytes of each value of an Arrow string or binary column; null as empty."""
    data, offs = bytes_and_offsets(column)
    raw = data.tobytes()
    return [raw[a:z] for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
