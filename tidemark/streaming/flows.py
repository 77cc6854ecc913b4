"""Incremental ingestion on Structured Streaming: tumbling windows, deduplication, sessions, revisions and keyed memory.

Each flow reads a stream of rows with a timestamp column ts and returns a streaming DataFrame; run() drives one to the end of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import fresh, remove


def source(spark: SparkSession, path: str, schema, max_files: int = 8) -> DataFrame:
    """Files of a folder (or one file) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run(flow: DataFrame, mode: str = "append") -> DataFrame:
    """What the flow writes until its input ends: exactly once, to the shared folder."""
    spark = flow.sparkSession
    out, state = fresh(spark, "stream"), fresh(spark, "stream-state")
    done = flow.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(flow.schema).parquet(out)


def upsert(flow: DataFrame, merge, memory: str | None = None, progress: str | None = None) -> DataFrame:
    """The memory that batches are merged into, one after the other: merge(old, new) gives the next state.

    Each batch writes a state of its own behind the one before, which a repeated batch reads again, so that it changes nothing;
    older ones are deleted. With the same folders `memory` and `progress` a later run goes on where this one ended.
    """
    spark = flow.sparkSession
    memory, progress = memory or fresh(spark, "memory"), progress or fresh(spark, "memory-progress")

    def step(batch: DataFrame, number: int) -> None:
        before = [n for n in _committed(spark, memory) if n < number]
        old = spark.read.parquet(f"{memory}/batch-{before[-1]}") if before else None
        merge(old, batch).write.mode("overwrite").parquet(f"{memory}/batch-{number}")
        for n in before[:-1]:
            remove(spark, f"{memory}/batch-{n}")

    flow.writeStream.foreachBatch(step).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{memory}/batch-{_committed(spark, memory)[-1]}")


def _committed(spark: SparkSession, memory: str) -> list[int]:
    """Numbers of the batches whose state is whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(memory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = [p.getName() for p in found if p.getName().startswith("batch-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("batch-")) for n in whole)


def tumbling(rows: DataFrame, by: str, width: str = "7 days", late: str = "1 day") -> DataFrame:
    windowed = rows.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), by)
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sliding(rows: DataFrame, by: str, width: str, step: str, late: str = "1 day") -> DataFrame:
    """Overlapping windows."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def first_seen(rows: DataFrame, key: list[str], late: str = "30 days") -> DataFrame:
    """The first row of each key."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def bursts(rows: DataFrame, by: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions: rows of a key no farther apart than the gap."""
    return rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def confirmations(rows: DataFrame, key: str, gap_days: int = 7, late: str = "1 day") -> DataFrame:
    """Keys seen twice at least gap_days apart, once each, with keyed state: the first time, and the first one far enough from it.

    The rows of a key come in any order and in several pieces, and a sighting may be older than all before. So the answer waits for the
    last piece of the batch, and times that an older first one could turn into the answer are kept until then. Rows without key or time count nowhere.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = rows.schema[key].dataType.simpleString()
    gap = gap_days * 86_400_000_000

    def held(parts: list) -> np.ndarray:
        """Distinct times up to the first that is far enough; no later one can be the answer, as the first only gets older."""
        times = np.unique(np.concatenate(parts))
        return times[: np.searchsorted(times, times[0] + gap) + 1] if len(times) else times

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, done = state.get if state.exists else (b"", False)
        parts, loose = [np.frombuffer(bytes(kept), "int64")], 0
        for pdf in batches:
            if done:
                continue
            parts.append(pdf["ts"].to_numpy("datetime64[us]").astype("int64"))
            loose += len(pdf)
            if loose > max(len(parts[0]), 10_000):
                parts, loose = [held(parts)], 0
        if not done:
            times = held(parts)
            done = bool(times[-1] - times[0] >= gap)
            if done:
                yield pd.DataFrame({key: [k[0]], "first_us": [times[0]], "confirmed_us": [times[-1]]})
            state.update((b"" if done else times.tobytes(), done))

    seen = rows.select(key, F.col("ts").cast("timestamp_ntz").alias("ts")).where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    return seen.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first_us long, confirmed_us long", "kept binary, done boolean", "append", GroupStateTimeout.NoTimeout)
