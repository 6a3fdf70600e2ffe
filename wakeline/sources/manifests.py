"""Sample manifests: CSV in and out, splits with their summary, guards."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.operators.metrics import bucket_summary
from wakeline.operators.splits import (
    assert_subject_independent,
    subject_independent_split,
)
from wakeline.schemas import INTERVAL_MANIFEST, MANIFEST
from wakeline.sources import filetrees

BUCKETS = ("train", "val", "test")


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Manifest rows, columns found by name whatever else a file holds and in which order.

    Files are grouped by their header line, and each group is read with its own names.
    """
    columns = [f.name for f in MANIFEST.fields]
    options = {"header": True, "escape": '"'}
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"))
    groups = heads.groupBy("head").agg(F.collect_list("file").alias("files")).orderBy("head").collect()
    out = None
    for group in groups:
        rows = spark.read.options(**options).csv([unquote(f) for f in group["files"]])
        missing = [c for c in columns if c not in rows.columns]
        if missing:
            raise ValueError(f"{group['files'][0]} has no column {', '.join(missing)}")
        out = rows.select(*columns) if out is None else out.unionByName(rows.select(*columns))
    return out if out is not None else spark.createDataFrame([], MANIFEST)


def read_interval_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Interval manifest rows; the header must name exactly the five columns in order."""
    options = {"header": True, "escape": '"'}
    header = spark.read.options(**options).csv(path).columns
    wanted = [f.name for f in INTERVAL_MANIFEST.fields]
    if header != wanted:
        raise ValueError(f"an interval manifest has another header than {header}")
    # Every file is checked against the schema, and a value that is no number is an error.
    return (
        spark.read.options(**options, enforceSchema=False, mode="FAILFAST")
        .schema(INTERVAL_MANIFEST)
        .csv(path)
    )


def write_manifest(df: DataFrame, path: str, schema: T.StructType = MANIFEST) -> None:
    columns = [f.name for f in schema.fields]
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_interval_manifest(df: DataFrame, path: str) -> None:
    write_manifest(df, path, INTERVAL_MANIFEST)


def split_summary(split: DataFrame) -> DataFrame:
    """Samples, subjects and class counts of the three buckets, empty ones included."""
    found = bucket_summary(split, ["split"])
    every = split.sparkSession.createDataFrame([(b,) for b in BUCKETS], "split string")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return every.join(found, ["split"], "left").select(
        "split",
        F.coalesce("samples", F.lit(0)).alias("samples"),
        F.coalesce("subjects", F.lit(0)).alias("subjects"),
        F.coalesce("class_distribution", none).alias("class_distribution"),
    )


def write_split(
    split: DataFrame, out_dir: str, seed: int, schema: T.StructType = MANIFEST
) -> None:
    """The rows partitioned by bucket, and ``summary`` with the seed and the counts."""
    columns = [f.name for f in schema.fields]
    split.select("split", *columns).write.mode("overwrite").partitionBy("split").option(
        "header", True
    ).option("escape", '"').csv(f"{out_dir}/samples")
    counts = {
        r["split"]: {
            "samples": r["samples"],
            "subjects": r["subjects"],
            "class_distribution": r["class_distribution"],
        }
        for r in split_summary(split).collect()
    }
    text = json.dumps({"counts": counts, "seed": seed}, indent=2, sort_keys=True)
    row = split.sparkSession.createDataFrame([(text,)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{out_dir}/summary", lineSep="\n")


def write_interval_split(split: DataFrame, out_dir: str, seed: int) -> None:
    write_split(split, out_dir, seed, INTERVAL_MANIFEST)


Builder = Callable[[SparkSession, str], DataFrame]

DATASET_BUILDERS: dict[str, Builder] = {
    "uta-rldd": filetrees.class_stem_manifest,
    "mrl": filetrees.eye_image_manifest,
    "dmd-distraction": filetrees.activity_manifest,
}
SPLIT_WRITERS: dict[str, Callable[[DataFrame, str, int], None]] = {
    "dmd-distraction": write_interval_split,
}


def build_dataset_splits(
    spark: SparkSession,
    dataset: str,
    root: str,
    out_dir: str,
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15),
    seed: int = 0,
    builders: Mapping[str, Builder] = DATASET_BUILDERS,
) -> DataFrame:
    """Build, split, check and write one dataset's manifest."""
    if dataset not in builders:
        raise ValueError(f"no builder for dataset {dataset!r}, only for {sorted(builders)}")
    manifest = builders[dataset](spark, root)
    if manifest.isEmpty():
        raise ValueError(f"{root!r} holds no samples in the layout of this dataset")
    split = assert_subject_independent(subject_independent_split(manifest, ratios, seed))
    SPLIT_WRITERS.get(dataset, write_split)(split, out_dir, seed)
    return split
