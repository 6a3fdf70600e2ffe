"""Temporal fatigue models end to end: windows, baselines, tuning, another dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame

from wakeline.operators.intervals import closure_labels
from wakeline.operators.metrics import binary_drowsy_report
from wakeline.operators.scoring import evaluate_boosted_windows, run_sweep
from wakeline.operators.segments import SEGMENT_ROWS, cut
from wakeline.operators.sweeps import best_by
from wakeline.operators.windows import pane_windows, summary_panes, window_labels, window_summary
from wakeline.schemas import WINDOW_GRID

DEFAULT_GRID = tuple({"size": size, "stride": stride} for size, stride in WINDOW_GRID)
FEATURES = (
    "perclos",
    "blink_count",
    "yawn_count",
    "nod_count",
    "blink_rate_per_min",
    "yawn_rate_per_min",
    "nod_rate_per_min",
    "mean_blink_duration",
    "mean_ear",
    "mean_mar",
    "mean_abs_pitch",
)


def clip_windows(
    frames: DataFrame,
    labels: DataFrame,
    keys: Sequence[str],
    frame: str,
    size: int,
    stride: int,
    thresholds: Mapping[str, float],
    fps: float,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Window features with the label of their clip (keys, label)."""
    summary = window_summary(
        frames,
        keys,
        frame,
        size,
        stride,
        fps,
        thresholds["ear"],
        thresholds["mar"],
        thresholds["pitch"],
        rows=rows,
    )
    return summary.join(labels, list(keys))


def union_windows(*corpora: DataFrame) -> DataFrame:
    """Windows of several corpora, put together before training."""
    out = corpora[0]
    for other in corpora[1:]:
        out = out.unionByName(other)
    return out


def tune(
    spark,
    train: DataFrame,
    validate: DataFrame,
    labels: DataFrame,
    keys: Sequence[str],
    frame: str,
    thresholds: Mapping[str, float],
    fps: float,
    grid: Sequence[Mapping[str, int]] = DEFAULT_GRID,
    n_classes: int = 3,
    metric: str = "macro_auroc",
    rows: int = SEGMENT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Metrics of every (size, stride, …) configuration on validation, and the best one.

    Frames are read once, into the panes of all configurations, which are written.
    """
    if not grid:
        raise ValueError("the sweep grid is empty")
    lengths = sorted({gcd(c["size"], c["stride"]) for c in grid})
    limits = (thresholds["ear"], thresholds["mar"], thresholds["pitch"])
    parts = [cut(summary_panes(part, keys, frame, lengths, *limits, rows=rows)) for part in (train, validate)]

    def one(train_panes: DataFrame, val_panes: DataFrame, size: int, stride: int, **model) -> DataFrame:
        windows = [
            pane_windows(panes, keys, size, stride, gcd(size, stride), fps).join(labels, list(keys))
            for panes in (train_panes, val_panes)
        ]
        return evaluate_boosted_windows(*windows, FEATURES, "label", n_classes, **model)

    results = run_sweep(spark, *parts, grid, one)
    return results, best_by(results, metric)


def recording_windows(
    kept: DataFrame,
    intervals: DataFrame,
    recordings: DataFrame,
    keys: Sequence[str],
    size: int,
    stride: int,
    positive_fraction: float = 0.1,
    fps: float = 29.76,
    min_closed_seconds: float = 0.5,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Windows of kept rows, drowsy where enough of their raw frames are in a closure.

    ``kept`` has (keys, row, frame): its dense row number and the raw frame it came from.
    Recordings without annotations are left out.
    """
    annotated = kept.join(intervals.select(*keys).distinct(), list(keys), "left_semi")
    flagged = closure_labels(
        annotated, intervals, recordings, keys, "frame", fps, min_closed_seconds, rows=rows
    )
    return window_labels(flagged, keys, "row", "drowsy", size, stride, positive_fraction)


def cross_dataset_report(windows: DataFrame, level: Column) -> DataFrame:
    """A three-level classifier judged as a binary drowsy detector (windows with `drowsy`)."""
    scored = windows.withColumn("_pred", level == 2)
    return binary_drowsy_report(scored, "drowsy", "_pred")
