"""Frame tables: features per sample, recordings, caches, resumable extraction, checksums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.scalars import encode, on_stride
from wakeline.operators.runs import first_seen_ids
from wakeline.operators.segments import SEGMENT_ROWS, index_rows
from wakeline.schemas import FATIGUE_CLASSES
from wakeline.sources.filetrees import require_rows


def labelled_frames(
    frames: DataFrame,
    manifest: DataFrame,
    classes: Mapping[str, int] | Sequence[str] = FATIGUE_CLASSES,
    key: str = "sample_id",
    strict: bool = True,
) -> DataFrame:
    """Frames of the manifest's samples with their label and class number.

    A sample without frames and an unknown label are errors.
    """
    if strict:
        require_rows(manifest, frames, [key], "missing features")
    named = manifest.withColumn("class_index", encode(F.col("label"), classes, strict))
    return frames.join(named, [key])


def kept_rows(
    raw: DataFrame,
    keys: Sequence[str],
    frame: str,
    face: str,
    step: int = 1,
    out: str = "row",
) -> DataFrame:
    """Stride over raw frames, drop those without a face, number what is left."""
    kept = raw.filter(on_stride(F.col(frame), step)).filter(F.col(face).isNotNull())
    return index_rows(kept, keys, [frame], out)


def gaze_corpus(
    recordings: DataFrame, interval_key: str | None = None, strict: bool = True
) -> DataFrame:
    """Gaze rows with an interval id that is unique over the corpus.

    The id is the pair (recording, interval): numbered by first appearance inside the
    recording when ``interval_key`` names the annotated interval, else as stored.
    """
    if strict and recordings.isEmpty():
        raise FileNotFoundError("the gaze corpus is empty")
    if interval_key is None:
        return recordings.withColumn("interval", F.struct("recording", "interval_id"))
    ids = first_seen_ids(recordings, ["recording"], "frame", interval_key)
    named = ids.drop("first_frame")
    numbered = recordings.drop("interval_id").join(named, ["recording", interval_key])
    return numbered.withColumn("interval", F.struct("recording", "interval_id"))


def write_frames(df: DataFrame, path: str, keys: Sequence[str], frame: str, rows: int = SEGMENT_ROWS) -> None:
    """Frame table clustered by session stretch, so that scans of a session prune files."""
    clustered = df.withColumn("_seg", F.expr(f"`{frame}` div {rows}"))
    clustered.repartition(*keys, "_seg").sortWithinPartitions(*keys, frame).drop("_seg").write.mode(
        "overwrite"
    ).parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_feature_cache(df: DataFrame, path: str, backbone: str, split: str) -> None:
    """(sample_id, label_index, features) of one backbone and split, replacing only those."""
    named = df.select(
        "sample_id",
        F.col("label_index").cast("int").alias("label_index"),
        F.col("features").cast("array<float>").alias("features"),
        F.lit(backbone).alias("backbone"),
        F.lit(split).alias("split"),
    )
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "backbone", "split"
    ).parquet(path)


def read_feature_cache(spark: SparkSession, path: str, backbone: str, split: str) -> DataFrame:
    cached = spark.read.parquet(path)
    return cached.filter((F.col("backbone") == backbone) & (F.col("split") == split)).drop(
        "backbone", "split"
    )


def has_feature_cache(spark: SparkSession, path: str, backbone: str, split: str) -> bool:
    """Whether a cached split is there already, so that it need not be computed again."""
    from pyspark.errors import AnalysisException

    try:
        return not read_feature_cache(spark, path, backbone, split).isEmpty()
    except AnalysisException:
        return False


def write_predictions(df: DataFrame, path: str) -> None:
    """Held-out predictions, kept for regrouping later without refitting."""
    df.write.mode("overwrite").parquet(path)


def pending_samples(
    manifest: DataFrame, done: DataFrame | None, key: str = "sample_id", limit: int | None = None
) -> DataFrame:
    """Samples still to extract, in id order when a run is limited to the first few."""
    todo = manifest if done is None else manifest.join(done.select(key).distinct(), [key], "left_anti")
    return todo if limit is None else todo.orderBy(key).limit(limit)


def checksum_status(files: DataFrame, expected: DataFrame, content: str = "content") -> DataFrame:
    """(name, status) with status ok, mismatch or missing, by SHA-256."""
    actual = files.select("name", F.sha2(F.col(content), 256).alias("_actual"))
    return expected.join(actual, ["name"], "left").select(
        "name",
        F.when(F.col("_actual").isNull(), "missing")
        .when(F.col("_actual") == F.col("sha256"), "ok")
        .otherwise("mismatch")
        .alias("status"),
    )


def file_contents(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(name, content) of the files directly under a root."""
    reader = spark.read.format("binaryFile")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def verify_checksums(files: DataFrame, expected: DataFrame) -> None:
    bad = checksum_status(files, expected).filter(F.col("status") != "ok").limit(5).collect()
    missing = [r["name"] for r in bad if r["status"] == "missing"]
    if missing:
        raise FileNotFoundError(f"files of the dataset that are not there: {missing}")
    if bad:
        raise ValueError(f"mismatch of contents and checksum: {[r['name'] for r in bad]}")
