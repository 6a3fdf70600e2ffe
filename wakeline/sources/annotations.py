"""Annotation documents (JSON with a map of actions) as interval rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.schemas import ACTIONS_DDL, DOCUMENT_DDL
from wakeline.sources.paths import relative_path, url_decoded

GAZE_PREFIX = "gaze_zone/"


def read_documents(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(path, json) of every document under a root."""
    texts = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(F.col("_metadata.file_path").alias("_full"), F.col("value").alias("json"))
    )
    path = relative_path(url_decoded(F.col("_full")), root)
    return texts.select(path.alias("path"), "json")


def _explode_actions(df: DataFrame, actions: Column, carried: Sequence[str]) -> DataFrame:
    """One row per frame interval with its place in the document."""
    entries = df.select(*carried, F.posexplode(F.map_values(actions)).alias("_a", "_action"))
    return entries.select(
        *carried,
        F.coalesce(F.col("_action.type"), F.lit("")).alias("action"),
        "_a",
        F.posexplode("_action.frame_intervals").alias("_i", "_interval"),
    ).select(
        *carried,
        "action",
        F.struct("_a", "_i").alias("position"),
        F.col("_interval.frame_start").alias("start_frame"),
        F.col("_interval.frame_end").alias("end_frame"),
    )


def action_intervals(df: DataFrame, json: str, carried: Sequence[str]) -> DataFrame:
    """(carried…, action, start_frame, end_frame); neither root key is an error.

    The root is ``openlabel`` when the document has that key, ``vcd`` otherwise.
    """
    parsed = df.withColumn("_doc", F.from_json(F.col(json), DOCUMENT_DDL, {"mode": "FAILFAST"}))
    body = F.when(
        F.col("_doc.openlabel").isNotNull(), F.coalesce(F.col("_doc.openlabel.actions"), _no_actions())
    ).when(F.col("_doc.vcd").isNotNull(), F.coalesce(F.col("_doc.vcd.actions"), _no_actions()))
    missing = F.raise_error(F.lit("not an annotation document: no 'openlabel' or 'vcd' root key"))
    checked = parsed.withColumn("_actions", F.coalesce(body, missing.cast(ACTIONS_DDL)))
    return _explode_actions(checked, F.col("_actions"), carried).drop("position")


def _no_actions() -> Column:
    return F.create_map().cast(ACTIONS_DDL)


def gaze_intervals(df: DataFrame, json: str, carried: Sequence[str]) -> DataFrame:
    """(carried…, position, zone, start_frame, end_frame) of the gaze-zone actions.

    The root is ``openlabel`` or the bare document; ``position`` keeps document order.
    """
    parsed = df.withColumn("_doc", F.from_json(F.col(json), DOCUMENT_DDL, {"mode": "FAILFAST"}))
    actions = F.when(
        F.col("_doc.openlabel").isNotNull(), F.col("_doc.openlabel.actions")
    ).otherwise(F.col("_doc.actions"))
    rows = _explode_actions(parsed.withColumn("_actions", actions), F.col("_actions"), carried)
    zone = F.substring(F.col("action"), len(GAZE_PREFIX) + 1, 1 << 30)
    return (
        rows.filter(F.col("action").startswith(GAZE_PREFIX))
        .withColumn("zone", zone)
        .filter(F.col("zone") != "not_valid")
        .select(*carried, "position", "zone", "start_frame", "end_frame")
    )
