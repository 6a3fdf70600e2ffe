"""Driver-monitoring analytics on Spark DataFrames and streams."""

from wakeline.operators.alerts import (
    alarm_counts,
    cadenced_ema,
    change_events,
    debounce,
    debounce_binary,
    fuse_tiers,
    majority_smooth,
    parallel_tracks,
    streak_tier,
    tier_events,
)
from wakeline.operators.intervals import closure_labels, nearest_rows, zone_per_frame
from wakeline.operators.metrics import (
    confusion_matrix,
    coverage_table,
    evaluate_predictions,
    macro_auroc,
)
from wakeline.operators.runs import event_runs, sessionise
from wakeline.operators.segments import index_rows
from wakeline.operators.splits import (
    assert_subject_independent,
    subject_folds,
    subject_independent_split,
)
from wakeline.operators.sweeps import replay_summary, select_alert_params, sweep_alerts
from wakeline.operators.windows import sliding_windows, window_summary
from wakeline.plans.yawning import score_videos

__all__ = [
    "alarm_counts",
    "assert_subject_independent",
    "cadenced_ema",
    "change_events",
    "closure_labels",
    "confusion_matrix",
    "coverage_table",
    "debounce",
    "debounce_binary",
    "evaluate_predictions",
    "event_runs",
    "fuse_tiers",
    "index_rows",
    "macro_auroc",
    "majority_smooth",
    "nearest_rows",
    "parallel_tracks",
    "replay_summary",
    "score_videos",
    "select_alert_params",
    "sessionise",
    "sliding_windows",
    "streak_tier",
    "subject_folds",
    "subject_independent_split",
    "sweep_alerts",
    "tier_events",
    "window_summary",
    "zone_per_frame",
]
