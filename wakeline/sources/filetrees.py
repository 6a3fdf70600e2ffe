"""Manifests built from file trees. Only paths are read, never file contents.

Every parser takes a DataFrame with a ``path`` relative to the dataset root, so it runs on
a listing of any origin; the ``*_manifest`` functions list a directory first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.scalars import directory_subject, encode, sanitise_id
from wakeline.schemas import (
    ACTIVITIES,
    ALL_ACTIVITIES,
    ANNOTATION_SUFFIX,
    BODY_SUFFIX,
    CLIP_STEM_LABELS,
    FACE_NAME,
    IMAGE_EXTENSIONS,
    VIDEO_EXTENSIONS,
)
from wakeline.sources.annotations import action_intervals, read_documents
from wakeline.sources.paths import relative_path

def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, length) of every file under a root that is not empty, paths relative to it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select(relative_path(F.col("path"), root).alias("path"), "length")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def parent(path: Column, up: int = 1) -> Column:
    """Name of a directory above the file, empty when there is none."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-1 - up)), F.lit(""))


def parse_class_stems(files: DataFrame, extensions: Sequence[str] = VIDEO_EXTENSIONS) -> DataFrame:
    """Clips named by class (0, 5 or 10) inside their subject's folder; others skipped."""
    wanted = extension(F.col("path")).isin(*[e.lower().lstrip(".") for e in extensions])
    label = encode(stem(F.col("path")), CLIP_STEM_LABELS, strict=False)
    return (
        files.filter(wanted)
        .select(F.col("path").alias("sample_id"), parent(F.col("path")).alias("subject_id"), label.alias("label"))
        .filter(F.col("label").isNotNull())
    )


def parse_eye_images(files: DataFrame, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Eye images whose name holds eight ``_`` fields; another count is an error."""
    wanted = extension(F.col("path")).isin(*[e.lower().lstrip(".") for e in extensions])
    fields = F.split(stem(F.col("path")), "_")
    wrong = F.raise_error(F.concat(F.lit("eight parts name an eye image, unlike "), file_name(F.col("path"))))
    checked = files.filter(wanted).withColumn(
        "_f", F.when(F.size(fields) == 8, fields).otherwise(wrong.cast("array<string>"))
    )
    at = lambda i: F.get("_f", F.lit(i))
    return checked.select(
        F.col("path").alias("sample_id"),
        at(0).alias("subject_id"),
        F.when(at(4).cast("int") == 1, "open").otherwise("closed").alias("label"),
        at(1).alias("image_id"),
        at(2).cast("int").alias("gender"),
        at(3).cast("int").alias("glasses"),
        at(4).cast("int").alias("eye_state"),
        at(5).cast("int").alias("reflections"),
        at(6).cast("int").alias("lighting"),
        at(7).alias("sensor_id"),
    )


def parse_face_videos(files: DataFrame, camera: str, strict: bool = True) -> DataFrame:
    """Videos named ``<num>-<Gender><Glasses>[-<Action>[&<Action>]].avi``.

    Mirror videos are labelled by their actions and must have some; dash videos hold all
    activities. An unrecognised name is an error, or dropped when not strict.
    """
    if camera not in ("mirror", "dash"):
        raise ValueError(f"videos come from the mirror or the dash, not from {camera!r}")
    name = file_name(F.col("path"))
    part = lambda i: F.regexp_extract(name, FACE_NAME, i)
    # Capitalised as a word: first letter upper, the rest lower.
    tokens = F.transform(
        F.split(part(4), "&"),
        lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30))),
    )
    actions = F.when(part(4) != "", tokens).otherwise(F.array().cast("array<string>"))
    parsed = files.withColumn("_ok", name.rlike(FACE_NAME))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("a video is named like none of the cameras: "), name))
        parsed = parsed.withColumn("_ok", F.when(F.col("_ok"), True).otherwise(wrong.cast("boolean")))
    named = parsed.filter("_ok").select(
        "path",
        part(1).cast("int").alias("subject_num"),
        part(2).alias("gender"),
        part(3).alias("glasses"),
        actions.alias("actions"),
    )
    if camera == "dash":
        label: Column = F.lit(ALL_ACTIVITIES)
    else:
        label = F.concat_ws("&", "actions")
        if strict:
            none = F.raise_error(F.concat(F.lit("the name of a mirror video says nothing of what is done: "), F.col("path")))
            label = F.when(F.size("actions") > 0, label).otherwise(none.cast("string"))
        else:
            named = named.filter(F.size("actions") > 0)
    return named.select(
        F.col("path").alias("sample_id"),
        F.concat("gender", F.col("subject_num").cast("string")).alias("subject_id"),
        label.alias("label"),
        "subject_num",
        "gender",
        "glasses",
        "actions",
    )


def parse_activity_documents(
    documents: DataFrame,
    files: DataFrame,
    allowed: Sequence[str] = ACTIVITIES,
    strict: bool = True,
) -> DataFrame:
    """Interval manifest of annotation documents (path, json), each next to its video."""
    prefix = "driver_actions/"
    found = documents.withColumn(
        "video", F.regexp_replace("path", ANNOTATION_SUFFIX.replace(".", r"\.") + "$", BODY_SUFFIX)
    )
    if strict:
        require_rows(
            found, files.select(F.col("path").alias("video")), ["video"], "body video missing"
        )
    rows = action_intervals(found, "json", ["path", "video"]).filter(
        F.col("action").startswith(prefix) & (F.col("action") != prefix + "unclassified")
    )
    short = F.substring(F.col("action"), len(prefix) + 1, 1 << 30)
    unknown = F.raise_error(F.concat(F.lit("drivers are not known to do this: "), F.col("action")))
    return rows.select(
        F.concat_ws("", "video", F.lit("#"), "start_frame", F.lit("-"), "end_frame").alias("sample_id"),
        F.concat_ws("_", parent(F.col("path"), 3), parent(F.col("path"), 2)).alias("subject_id"),
        F.when(short.isin(*allowed), short).otherwise(unknown).alias("label"),
        "start_frame",
        "end_frame",
    )


def class_stem_manifest(spark: SparkSession, root: str) -> DataFrame:
    return parse_class_stems(list_files(spark, root))


def eye_image_manifest(spark: SparkSession, root: str) -> DataFrame:
    return parse_eye_images(list_files(spark, root)).select("sample_id", "subject_id", "label")


def face_video_manifest(spark: SparkSession, root: str, camera: str) -> DataFrame:
    out = parse_face_videos(list_files(spark, root, "*.avi"), camera)
    if out.isEmpty():
        raise ValueError(f"{root} holds no video at any depth")
    return out.select("sample_id", "subject_id", "label")


def activity_manifest(spark: SparkSession, root: str) -> DataFrame:
    documents = read_documents(spark, root, f"*{ANNOTATION_SUFFIX}")
    return parse_activity_documents(documents, list_files(spark, root, f"*{BODY_SUFFIX}"))


def frame_files(
    files: DataFrame, manifest: DataFrame, labels: Sequence[str] = ACTIVITIES, strict: bool = True
) -> DataFrame:
    """One row per extracted frame image of every interval: (path, label_index, sample_id).

    Images sit in a directory named after the sanitised interval id. An interval without
    images and an unknown label are errors.
    """
    images = files.filter(file_name(F.col("path")).rlike(r"^frame_.*\.jpg$")).select(
        "path", F.regexp_replace("path", r"/[^/]*$", "").alias("_dir")
    )
    wanted = manifest.select(
        "sample_id",
        encode(F.col("label"), labels, strict).alias("label_index"),
        sanitise_id(F.col("sample_id")).alias("_dir"),
    )
    if strict:
        require_rows(wanted, images, ["_dir"], "no frame images for interval")
    return images.join(wanted, ["_dir"]).select("path", "label_index", "sample_id")


def missing_rows(wanted: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(available.select(*keys).distinct(), list(keys), "left_anti")


def require_rows(
    wanted: DataFrame, available: DataFrame, keys: Sequence[str], message: str
) -> None:
    """Fail when something wanted is not available, naming a few of the missing keys."""
    gone = [tuple(r) for r in missing_rows(wanted, available, keys).select(*keys).limit(5).collect()]
    if gone:
        raise FileNotFoundError(f"{message}: {gone}")


def recording_subjects(files: DataFrame) -> DataFrame:
    """Subject of every recording, from its group and subject directories."""
    return files.select("path", directory_subject(F.col("path")).alias("subject_id"))
