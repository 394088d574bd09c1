"""Streams of run telemetry. Each takes a streaming (or static) DataFrame with (event_id, worker, ts, disk, failed)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def stream_health_windows(df: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Mean and highest disk use for each worker and window; rows later than the watermark are left out."""
    return df.withWatermark("ts", LATE).groupBy("worker", F.window("ts", length, slide)).agg(F.avg("disk").alias("mean_disk"), F.max("disk").alias("max_disk"), F.count("*").alias("n"))


def stream_alerts(df: DataFrame, warn: float = 0.8, stop: float = 0.9) -> DataFrame:
    return df.where(F.col("disk") >= warn).select("event_id", "worker", F.when(F.col("disk") >= stop, "stop").otherwise("warn").alias("level"))


def stream_sessions(df: DataFrame, gap: str = "90 minutes") -> DataFrame:
    """Spans of a worker without a silence of ``gap``; a span that ends says that the worker was stuck from then on."""
    return df.withWatermark("ts", LATE).groupBy("worker", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("worker", F.col("s.start").alias("first_seen"), F.col("s.end").alias("silent_by"), "n")


def stream_dedup(df: DataFrame, keys: tuple[str, ...] = ("worker", "disk")) -> DataFrame:
    """The first row seen of each key, as long as the watermark remembers it."""
    return df.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(list(keys))


def stream_live_best(df: DataFrame) -> DataFrame:
    """Lowest cost so far for each run; needs (run_id, cost)."""
    return df.groupBy("run_id").agg(F.min("cost").alias("best"), F.count("*").alias("n"))


def stream_circuit_breaker(df: DataFrame, limit: int = 3) -> DataFrame:
    """(worker, event_id, streak) whenever a worker fails for the ``limit``-th time in a row; a success starts anew.

    State is one number a worker. A worker's rows of one micro-batch are put in order of time in its task; late rows of
    later batches count in the order they come.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        streak, out = state.get[0] if state.exists else 0, []
        for e, failed in pd.concat(list(chunks)).sort_values(["ts", "event_id"])[["event_id", "failed"]].itertuples(index=False):
            streak = streak + 1 if failed else 0
            if streak == limit:
                out.append((key[0], e, streak))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["worker", "event_id", "streak"])

    return df.groupBy("worker").applyInPandasWithState(step, "worker long, event_id long, streak int", "streak int", "append", GroupStateTimeout.NoTimeout)


def collect_ledger(df: DataFrame, ledger: str, checkpoint: str, per_trigger: str | None = None) -> None:
    """Append a stream to a ledger once and only once: a batch that is run again overwrites its own folder.

    Without ``per_trigger`` it takes all there is and ends.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    writer = df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    (writer.trigger(processingTime=per_trigger) if per_trigger else writer.trigger(availableNow=True)).start().awaitTermination()
