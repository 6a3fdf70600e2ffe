"""Streaming sources, interval metrics and run records."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from wakeline.operators.metrics import throughput
from wakeline.streaming.monitor import INPUT


def frame_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = INPUT,
    fmt: str = "parquet",
    **options: object,
) -> DataFrame:
    """Frames already reduced to features, read as files arrive."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def end_mark(last: DataFrame, ts: str, seconds: float) -> DataFrame:
    """A frame of a session of its own, ``seconds`` after a recorded stream's last time.

    Replayed after the recording, it moves the watermark past everything, so open intervals
    and sessions are flushed as they are when a camera stops.
    """
    after = F.timestamp_micros(F.unix_micros(ts) + F.lit(int(seconds * 1_000_000)))
    values = {"session": F.lit("end of recording"), "ts": after, "frame": F.lit(-1), "has_face": F.lit(False), "latency_s": F.lit(0.0)}
    return last.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INPUT.fields])


def interval_metrics(frames: DataFrame, interval: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Frames, frames per second, latencies and face rate per session and interval.

    On streams (append mode, after the watermark) a group is one interval of one live
    camera, so the state of its exact percentiles is bounded by the frame rate. On batches
    the percentiles are ranked without collecting a group.
    """
    window = F.window("ts", interval)
    span_us = lambda w: F.unix_micros(w["end"]) - F.unix_micros(w["start"])
    if not frames.isStreaming:
        placed = frames.withColumn("_w", window).select(
            "*",
            F.unix_micros("_w.start").alias("window_start_us"),
            (span_us(F.col("_w")) / 1e6).alias("_s"),
        )
        keys = ["session", "window_start_us"]
        latency = F.col("latency_s") * 1000.0
        return throughput(placed, keys, latency, F.col("has_face"), F.max("_s"))
    seconds = span_us(F.col("window"))
    return (
        frames.withWatermark("ts", delay)
        .groupBy("session", window)
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.percentile(F.col("latency_s") * 1000.0, F.array(F.lit(0.5), F.lit(0.95))).alias("_p"),
            F.count_if("has_face").alias("_faces"),
        )
        .select(
            "session",
            F.unix_micros("window.start").alias("window_start_us"),
            "frames",
            (F.col("frames") / (seconds / 1e6)).alias("fps"),
            F.get("_p", F.lit(0)).alias("lat_ms_p50"),
            F.get("_p", F.lit(1)).alias("lat_ms_p95"),
            (F.col("_faces") / F.col("frames")).alias("face_rate"),
        )
    )


class RunRecords(StreamingQueryListener):
    """Start record with the configuration and stop record of every monitored query."""

    def __init__(self, emit: Callable[[str], None], config: Mapping[str, object]) -> None:
        self._emit = emit
        self._config = dict(config)

    def _record(self, event: str, **fields: object) -> None:
        self._emit(json.dumps({"ts": time.time(), "event": event, **fields}))

    def onQueryStarted(self, event) -> None:
        self._record("start", config=self._config, run=str(event.runId))

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._record("stop", run=str(event.runId))
