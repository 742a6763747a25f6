"""Change events as a stream: classify, debounce by event time, and merge into a table batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mirrorsift.operators.changes import Shown, classify_events, next_shown

EVENT_SCHEMA = "event_id long, ts timestamp, kind string, path string, new_path string"
SAMPLE_SCHEMA = "series string, ts timestamp, pending_bytes long, left long"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def debounced_changes(events: DataFrame, gap: str = "500 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """(path, released_from, last_ts, change, n) once a path has been quiet for the gap; the last change wins.

    Event time with a watermark: events later than the lateness are dropped. Append mode.
    """
    changes = classify_events(events).withWatermark("ts", lateness)
    last = F.max_by("change", F.struct("ts", "event_id"))
    g = changes.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("released_from"), F.max("ts").alias("last_ts"), last.alias("change"), F.count("*").alias("n"))
    return g.drop("w")


def for_each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, every: str = "10 seconds", mode: str = "append") -> StreamingQuery:
    """Run apply on each micro-batch. Batches may come again after a failure: apply must be idempotent by batch id."""
    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode(mode)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()


def merge_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """An idempotent sink: each batch replaces its own folder; read_latest gives the last change of each path."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return apply


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", True).parquet(folder)
    return df.groupBy("path").agg(F.max_by("change", F.struct("last_ts", "batch_id")).alias("change"), F.max("last_ts").alias("last_ts"))


def smoothed_eta_stream(samples: DataFrame) -> DataFrame:
    """(series, ts_ms, eta_seconds) of a stream of samples; a series' state is five numbers."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        speed, seconds, counted, at, held = (None if v is None or v != v else v for v in state.get) if state.exists else (None,) * 5
        now = Shown(speed, seconds, int(counted or 0))
        pdf = pd.concat(list(pdfs)).sort_values("ts")
        ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
        out = []
        for t, pending, left in zip(ms, pdf["pending_bytes"], pdf["left"], strict=True):
            dt, drained = (0.0, 0.0) if at is None else (max(0.0, (t - at) / 1000), held - pending)
            now = next_shown(now, dt, drained, pending, left)
            at, held = float(t), float(pending)
            out.append(now.label())
        state.update((now.speed, now.seconds, now.counted, at, held))
        yield pd.DataFrame({"series": key[0], "ts_ms": ms, "eta_seconds": pd.array(out, dtype="Float64")})

    return samples.groupBy("series").applyInPandasWithState(
        step, "series string, ts_ms long, eta_seconds double", "speed double, seconds double, counted int, at double, held double", "append", GroupStateTimeout.NoTimeout)
