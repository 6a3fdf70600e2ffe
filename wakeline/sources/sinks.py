"""Telemetry and report sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCALARS = (T.StringType, T.BooleanType, T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)


def require_scalar(df: DataFrame) -> DataFrame:
    """Telemetry holds scalars only: no images, landmarks or vectors reach a sink.

    The start record's configuration, a map of text to text, is the one exception.
    """
    config = T.MapType(T.StringType(), T.StringType())
    bad = [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, _SCALARS) and not (f.name == "config" and f.dataType == config)
    ]
    if bad:
        raise ValueError(f"telemetry columns must be scalar: {bad}")
    return df


def _as_json(df: DataFrame) -> DataFrame:
    """Null fields are left out, so every event shows only its own fields."""
    return require_scalar(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def write_telemetry(df: DataFrame, path: str) -> None:
    """One JSON object per event, appended."""
    _as_json(df).write.mode("append").text(path)


def stream_telemetry(df: DataFrame, checkpoint: str, path: str | None = None, **trigger):
    """Telemetry of a stream to files, or to the console without a path."""
    writer = _as_json(df).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    if path is None:
        return writer.format("console").option("truncate", False).start()
    return writer.format("text").option("path", path).start()


def write_report(df: DataFrame, path: str, config: Mapping[str, object] | None = None) -> None:
    """An aggregated report as JSON, one object a row, with its configuration echoed."""
    row = df
    if config:
        row = df.withColumn(
            "config", F.create_map(*[F.lit(str(x)) for pair in config.items() for x in pair])
        )
    text = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)
