"""Yawn detection end to end: events, event features, detectors and the deploy decision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.functions.scalars import deploy_decision, event_rows, is_yawning
from wakeline.operators.intervals import nearest_rows
from wakeline.operators.metrics import pooled_vectors, video_report, video_scores
from wakeline.operators.runs import event_runs, proposal_events
from wakeline.operators.segments import SEGMENT_ROWS
from wakeline.operators.sweeps import select_threshold, threshold_sweep
from wakeline.schemas import CROP_MARGIN

EventsBuilder = Callable[[DataFrame], DataFrame]


def longest_runs(
    frames: DataFrame,
    manifest: DataFrame,
    keys: Sequence[str],
    frame: str,
    signal: str,
    threshold: float,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """One row per video: its label and its longest run at or above the threshold (or 0).

    All a detector needs at any minimum duration.
    """
    runs = event_runs(frames.select(*keys, frame, signal), keys, frame, signal, threshold, rows=rows)
    longest = runs.groupBy(*keys).agg(F.max("length").alias("longest"))
    return manifest.join(longest, list(keys), "left").withColumn(
        "longest", F.coalesce("longest", F.lit(0))
    )


def score_videos(longest: DataFrame, min_duration: int = 1, label: str = "label") -> DataFrame:
    if min_duration < 1:
        raise ValueError(f"an event of {min_duration} frames is none")
    return video_report(longest, label, F.col("longest") >= min_duration).withColumn(
        "min_duration", F.lit(min_duration)
    )


def sweep_durations(
    longest: DataFrame, durations: Sequence[int], min_recall: float = 0.90, label: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """Precision and recall at every minimum duration, and the selected one."""
    sweep = threshold_sweep(longest, "longest", is_yawning(F.col(label)), durations, "min_duration")
    return sweep, select_threshold(sweep, "min_duration", min_recall)


def select_tau(
    scored: DataFrame, steps: int = 101, min_recall: float = 0.90, label: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """Rates at evenly spaced score thresholds in [0, 1], and the selected one."""
    taus = [i / (steps - 1) for i in range(steps)]
    sweep = threshold_sweep(scored, "score", is_yawning(F.col(label)), taus, "tau")
    return sweep, select_threshold(sweep, "tau", min_recall)


def event_features(
    frames: DataFrame,
    crops: DataFrame,
    keys: Sequence[str],
    frame: str,
    signal: str,
    threshold: float,
    dim: int,
    n_frames: int = 5,
    events_builder: EventsBuilder | None = None,
    tolerance: int = CROP_MARGIN,
    strict: bool = True,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Pooled crop vectors per candidate event: (keys, start, end, label, features).

    ``crops`` has (keys, row, vector). The default events are label-blind, as a held-out
    video needs; pass ``training_events`` bound to a manifest for training.
    """
    if events_builder is None:
        events = proposal_events(
            frames.select(*keys, frame, signal), keys, frame, signal, threshold, rows=rows
        )
    else:
        events = events_builder(frames)
    event = [*keys, "start", "end", "label"]
    wanted = events.select(
        *event, F.posexplode(event_rows(F.col("start"), F.col("end"), n_frames)).alias("_i", "row")
    )
    found = nearest_rows(
        wanted,
        crops.select(*keys, F.col("row").alias("crop_row")),
        keys,
        tolerance=tolerance,
        strict=strict,
    )
    vectors = crops.select(*keys, F.col("row").alias("crop_row"), "vector")
    return pooled_vectors(found.join(vectors, [*keys, "crop_row"]), event, "vector", dim)


def compare_detectors(
    longest: DataFrame,
    scored_events: DataFrame,
    keys: Sequence[str],
    min_duration: int,
    tau: float,
    label: str = "label",
) -> DataFrame:
    """The plain rule, the rule with a minimum duration and the classifier on the same videos.

    One row per detector; rates without a denominator are 0, except the talking
    false-positive rate, which is null.
    """
    videos = video_scores(longest, scored_events.select(*keys, "score"), keys)
    rules = {
        "baseline_mar": F.col("longest") >= 1,
        "baseline_duration": F.col("longest") >= min_duration,
        "classifier": F.col("score") >= tau,
    }
    fired = [F.struct(F.lit(n).alias("detector"), hit.alias("fired")) for n, hit in rules.items()]
    each = videos.select(label, F.inline(F.array(*fired)))
    report = video_report(each, label, F.col("fired"), by=["detector"])
    return report.select(
        "detector",
        "n_videos",
        "tp",
        "fp",
        "fn",
        F.coalesce("precision", F.lit(0.0)).alias("precision"),
        F.coalesce("recall", F.lit(0.0)).alias("recall"),
        "talking_false_positive_rate",
    )


def decide(comparison: DataFrame) -> DataFrame:
    """``deploy`` or what blocks it, from the three rows of `compare_detectors`."""
    of = lambda name, column: F.max(F.when(F.col("detector") == name, F.col(column)))
    row = comparison.agg(
        of("classifier", "precision").alias("p"),
        of("classifier", "recall").alias("r"),
        of("baseline_duration", "precision").alias("bp"),
        of("baseline_duration", "recall").alias("br"),
    )
    return row.select(
        deploy_decision(F.col("p"), F.col("r"), F.col("bp"), F.col("br")).alias("deploy_decision")
    )
