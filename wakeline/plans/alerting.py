"""Alert validation end to end: features to levels, levels to alert metrics, to a report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.scoring import window_levels
from wakeline.operators.segments import SEGMENT_ROWS, cut
from wakeline.operators.sweeps import select_alert_params, sweep_alerts
from wakeline.schemas import ALERT_GRID, AUDIBLE, BASELINE_PARAMS, FEATURE_COLUMNS, TIER_NAMES
from wakeline.sources.frames import labelled_frames
from wakeline.sources.sinks import write_report


def classify_frames(
    frames: DataFrame,
    keys: Sequence[str],
    frame: str,
    load,
    window: int = 150,
    columns: Sequence[str] = FEATURE_COLUMNS,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Fatigue level of every frame from its rolling window, scored once per frame."""
    return window_levels(frames, keys, frame, columns, load, window, rows)


def clip_lengths(
    frames: DataFrame, manifest: DataFrame, keys: Sequence[str], label: str = "label"
) -> DataFrame:
    counts = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    return manifest.join(counts, list(keys)).select(*keys, F.col(label).alias("label"), "n_frames")


def evaluate(
    levels: DataFrame,
    clips: DataFrame,
    keys: Sequence[str],
    frame: str,
    fps: float,
    params: tuple[int, int, int] = BASELINE_PARAMS,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """One parameter set at all three thresholds, one row per threshold tier."""
    out: DataFrame | None = None
    for tier in (1, 2, 3):
        row = sweep_alerts(levels, clips, keys, frame, "level", fps, [params], tier, rows)
        row = row.withColumn("threshold", F.lit(TIER_NAMES[tier]))
        out = row if out is None else out.unionByName(row)
    return out


def validate_alerts(
    frames: DataFrame,
    manifest: DataFrame,
    load,
    fps: float,
    out: str,
    mode: str = "sweep",
    window: int = 150,
    params: tuple[int, int, int] = BASELINE_PARAMS,
    rows: int = SEGMENT_ROWS,
    classify: Callable[..., DataFrame] = classify_frames,
) -> DataFrame:
    """Score the labelled frames, sweep or evaluate the alert machine, write the report.

    Levels are the expensive part and are written out once; every parameter set works on
    their runs.
    """
    if mode not in ("sweep", "evaluate"):
        raise ValueError(f"mode must be 'sweep' or 'evaluate', got {mode!r}")
    keys = ["sample_id"]
    known = labelled_frames(frames, manifest.select("sample_id", "label"))
    levels = cut(classify(known, keys, "frame", load, window, rows=rows))
    clips = clip_lengths(levels, manifest, keys)
    config = {"fps": fps, "window": window, "mode": mode}
    if mode == "sweep":
        sweep = sweep_alerts(levels, clips, keys, "frame", "level", fps, ALERT_GRID, AUDIBLE, rows)
        chosen = select_alert_params(sweep).select("grid_pos", F.lit(True).alias("selected"))
        report = sweep.join(F.broadcast(chosen), ["grid_pos"], "left").withColumn(  # a single row
            "selected", F.coalesce("selected", F.lit(False))
        )
    else:
        report = evaluate(levels, clips, keys, "frame", fps, params, rows)
    write_report(report, out, config)
    return report
