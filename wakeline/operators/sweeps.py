"""Parameter sweeps over pre-aggregated data, and the fixed rules that pick a winner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.operators.alerts import (
    check_steps,
    committed_after,
    committed_before,
    level_rank,
)
from wakeline.operators.percentiles import exact_percentiles
from wakeline.operators.runs import equal_runs
from wakeline.operators.segments import (
    SEGMENT_ROWS,
    attach_carry,
    cut,
    scan,
    segment,
    within,
)
from wakeline.schemas import ALARM, ALERT_GRID, AUDIBLE, BASELINE_PARAMS, RECALL_FLOOR, VISUAL

Params = tuple[int, int, int]


# --- Alert machine over a grid ------------------------------------------------------------


def level_changes(
    runs: DataFrame,
    keys: Sequence[str],
    steps: Sequence[tuple[int, int]],
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Every commit of the debounce machine, for each (escalate, de-escalate) pair.

    Takes level runs (keys, value, start, length) and gives (keys, escalate, de_escalate,
    frame, was, now). Runs shorter than both steps never change the state, so they are
    dropped before the grid is applied; frames are never multiplied by the grid.
    """
    for pair in steps:
        check_steps(*pair)
    grid = F.array(
        *[F.struct(F.lit(e).alias("escalate"), F.lit(d).alias("de_escalate")) for e, d in steps]
    )
    shortest = min(min(pair) for pair in steps)
    long_runs = (
        runs.filter(F.col("length") >= shortest)
        .select(*keys, "value", "start", "length", F.inline(grid))
        .filter(F.col("length") >= F.least("escalate", "de_escalate"))
    )
    group = [*keys, "escalate", "de_escalate"]
    upward = F.col("escalate") <= F.col("de_escalate")
    reset = F.col("length") >= F.greatest("escalate", "de_escalate")
    base = segment(long_runs, "start", rows)
    part = within(group)
    order = W.partitionBy(*part).orderBy("start")
    packed = base.withColumn(
        "_resets", F.sum(reset.cast("bigint")).over(scan(part, "start"))
    ).withColumn("_event", F.col("_resets") * 4 + level_rank(F.col("value"), upward))
    before = F.max("_event").over(order.rowsBetween(W.unboundedPreceding, -1))
    summary = packed.groupBy(*part).agg(F.max("_event").alias("_packed"))
    known = packed.withColumn("_seen", before).join(committed_before(summary, group, upward), part)
    was = committed_after(F.col("_state"), F.col("_seen"), upward)
    step = F.when(F.col("value") > F.col("was"), F.col("escalate")).otherwise(F.col("de_escalate"))
    return (
        known.withColumn("was", was.cast("int"))
        .withColumn("_step", step)
        .filter((F.col("value") != F.col("was")) & (F.col("length") >= F.col("_step")))
        .select(
            *group,
            (F.col("start") + F.col("_step") - 1).alias("frame"),
            "was",
            F.col("value").cast("int").alias("now"),
        )
    )


def alarms(
    changes: DataFrame,
    clips: DataFrame,
    keys: Sequence[str],
    threshold: int,
    alarm_steps: Sequence[int],
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Frames where the tier rises to the threshold, per parameter set.

    VISUAL and AUDIBLE follow the commits alone, so their rows hold for every
    ``alarm_after`` and name none. ALARM (which adds ``alarm_after``) needs level 2 to stay
    committed for that many frames, counted to the next commit or the end of the clip.
    """
    group = [*keys, "escalate", "de_escalate"]
    if threshold in (VISUAL, AUDIBLE):
        rises = changes.filter((F.col("was") < threshold) & (F.col("now") >= threshold))
        return rises.select(*group, "frame")
    after = F.explode(F.array(*[F.lit(a) for a in alarm_steps])).alias("alarm_after")
    if threshold != ALARM:
        raise ValueError(f"no such alarm threshold: {threshold}")
    base = segment(changes, "frame", rows)
    order = W.partitionBy(*within(group)).orderBy("frame")
    known = attach_carry(
        base.withColumn("_next", F.lead("frame").over(order)),
        base,
        group,
        {"_head": F.min("frame")},
        {"_later": lambda s: F.min("_head").over(s)},
        following=True,
    )
    held = known.filter(F.col("now") == 2).join(clips.select(*keys, "n_frames"), list(keys))
    length = F.coalesce("_next", "_later", "n_frames") - F.col("frame")
    return (
        held.withColumn("_held", length)
        .select(*group, "frame", "_held", after)
        .filter(F.col("_held") >= F.col("alarm_after"))
        .select(*group, (F.col("frame") + F.col("alarm_after") - 1).alias("frame"), "alarm_after")
    )


def replay_summary(
    rises: DataFrame,
    clips: DataFrame,
    keys: Sequence[str],
    params: Sequence[str],
    grid: DataFrame,
    fps: float,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Clip-level alert metrics per parameter set.

    ``rises`` has one row per alarm (keys, params, frame), ``clips`` one row per clip
    (keys, label, n_frames) and ``grid`` one row per parameter set. Clips without alarms
    enter through the totals, so clips and grid are never multiplied.
    """
    label = F.col("label")
    unknown = F.raise_error(F.concat(F.lit("no clip is labelled "), label))
    known = F.when(label.isin("alert", "low_vigilance", "drowsy"), label).otherwise(unknown)
    checked = clips.withColumn("label", known)
    drowsy, alert_only = label == "drowsy", label == "alert"
    frames = lambda which: F.sum(F.when(which, F.col("n_frames")))
    totals = checked.agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.count_if(~drowsy).alias("n_not_drowsy_clips"),
        F.count_if(drowsy).alias("n_drowsy_clips"),
        (frames(~drowsy) / fps / 3600.0).alias("_nd_hours"),
        (frames(alert_only) / fps / 3600.0).alias("_ao_hours"),
    )
    per_clip = rises.groupBy(*keys, *params).agg(
        F.count(F.lit(1)).alias("_alarms"), F.min("frame").alias("_first")
    )
    labelled = per_clip.join(checked.select(*keys, "label"), list(keys))
    first = F.when(drowsy, F.col("_first") / fps)
    median = "median_time_to_first_alert_s"
    labelled = cut(labelled.withColumn("_t", first))
    sums = labelled.groupBy(*params).agg(
        F.sum(F.when(~drowsy, F.col("_alarms")).otherwise(0)).alias("_nd"),
        F.sum(F.when(alert_only, F.col("_alarms")).otherwise(0)).alias("_ao"),
        F.count_if(~drowsy).alias("_nd_clips"),
        F.count_if(drowsy).alias("_hits"),
    )
    out = grid.join(sums, list(params), "left")
    medians = exact_percentiles(labelled, params, "_t", {median: 0.5})
    out = out.join(medians, list(params), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.crossJoin(F.broadcast(totals)).select(  # totals is a single row
        *grid.columns,
        "n_clips",
        "n_not_drowsy_clips",
        "n_drowsy_clips",
        F.try_divide(zero("_nd"), "_nd_hours").alias("false_alarms_per_hour"),
        F.try_divide(zero("_nd_clips"), "n_not_drowsy_clips").alias(
            "fraction_not_drowsy_clips_with_alarm"
        ),
        F.try_divide(zero("_ao"), "_ao_hours").alias("false_alarms_per_hour_alert_clips_only"),
        F.try_divide(zero("_hits"), "n_drowsy_clips").alias("drowsy_detection_rate"),
        "median_time_to_first_alert_s",
    )


def parameter_grid(spark, grid: Sequence[Params] = ALERT_GRID) -> DataFrame:
    return spark.createDataFrame(
        [(i, *p) for i, p in enumerate(grid)],
        "grid_pos int, escalate int, de_escalate int, alarm_after int",
    )


def sweep_alerts(
    levels: DataFrame,
    clips: DataFrame,
    keys: Sequence[str],
    frame: str,
    level: str,
    fps: float,
    grid: Sequence[Params] = ALERT_GRID,
    threshold: int = AUDIBLE,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Replay every clip under every parameter set: one metrics row per set.

    ``clips`` has (keys, label, n_frames). Frames are reduced to level runs once.
    """
    steps = sorted({(e, d) for e, d, _ in grid})
    afters = sorted({a for _, _, a in grid})
    runs = equal_runs(levels.select(*keys, frame, level), keys, frame, level, rows=rows)
    changes = level_changes(cut(runs), keys, steps, rows)
    rises = alarms(changes, clips, keys, threshold, afters, rows)
    params = ["escalate", "de_escalate", *(["alarm_after"] if threshold == ALARM else [])]
    return replay_summary(
        rises, clips, keys, params, parameter_grid(levels.sparkSession, grid), fps, rows
    )


def select_alert_params(
    sweep: DataFrame, default: Params = BASELINE_PARAMS, strict: bool = True
) -> DataFrame:
    """The set with the fewest false alarms among those that detect as much as the default.

    Ties go to the faster median alert, then to the earlier grid position.
    """
    is_default = (
        (F.col("escalate") == default[0])
        & (F.col("de_escalate") == default[1])
        & (F.col("alarm_after") == default[2])
    )
    # One window over the grid, a row per parameter set, so the sweep runs once.
    whole_grid = W.partitionBy(F.lit(0))
    bar = F.max(F.when(is_default, F.col("drowsy_detection_rate"))).over(whole_grid)
    if strict:
        missing = F.raise_error(F.lit("the sweep lacks the default parameters"))
        no_rate = F.raise_error(F.lit("the baseline row has no drowsy clips"))
        defaults = F.count_if(is_default).over(whole_grid)
        bar = (
            F.when(defaults == 0, missing.cast("double"))
            .when(bar.isNull(), no_rate.cast("double"))
            .otherwise(bar)
        )
    # Sets without drowsy clips never qualify, but must not be dropped before the check.
    rate = F.coalesce("drowsy_detection_rate", F.lit(-1.0))
    eligible = sweep.withColumn("_bar", bar).filter(rate >= F.col("_bar"))
    return (
        eligible.orderBy(
            "false_alarms_per_hour", F.asc_nulls_last("median_time_to_first_alert_s"), "grid_pos"
        )
        .limit(1)
        .drop("_bar")
    )


# --- Threshold sweeps over one score per video ---------------------------------------------


def threshold_sweep(
    scored: DataFrame, score: str, truth: Column, grid: Sequence[float], name: str
) -> DataFrame:
    """tp, fp, fn, precision and recall at every grid value (fires when score >= value).

    Videos are reduced to counts per grid gap in one pass; the grid is applied to those.
    """
    values = sorted(set(grid))
    points = F.array(*[F.lit(v) for v in values])
    below = F.size(F.filter(points, lambda t: t <= F.col(score)))
    cells = scored.groupBy(truth.alias("_truth"), below.alias("_below")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    fired = F.col("_below") > F.col("_at")
    sums = cells.select("*", F.posexplode(points).alias("_at", name)).groupBy("_at", name).agg(
        F.sum(F.when(F.col("_truth") & fired, F.col("_n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("_truth") & fired, F.col("_n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("_truth") & ~fired, F.col("_n")).otherwise(0)).alias("fn"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    return sums.drop("_at").withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")})


def select_threshold(
    sweep: DataFrame, name: str, min_recall: float = RECALL_FLOOR
) -> DataFrame:
    """Highest precision among rows with enough recall, else highest recall; smaller on ties.

    One row: the selected value, its rates and ``floor_met``.
    """
    met = F.col("recall") >= min_recall
    first = F.struct(
        met.alias("met"), F.when(met, F.col("precision")).otherwise(F.col("recall")).alias("v"), (-F.col(name)).alias("s")
    )
    best = sweep.agg(F.max_by(F.struct(name, "precision", "recall", met.alias("floor_met")), first).alias("_b"))
    return best.select("_b.*")


def threshold_curve(
    peaks: DataFrame, peak: str, label: str, thresholds: Sequence[float]
) -> DataFrame:
    """Video precision and recall (null for no denominator) over signal thresholds.

    A video fires at every threshold up to its highest value, so one peak per video is
    enough for any number of thresholds.
    """
    truth = F.array_contains(F.split(F.col(label), "&"), "Yawning")
    sweep = threshold_sweep(peaks, peak, truth, thresholds, "threshold")
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return sweep.select("threshold", rate("tp", "fp").alias("precision"), rate("tp", "fn").alias("recall"))


def best_by(results: DataFrame, metric: str, position: str = "grid_pos") -> DataFrame:
    """Row with the highest metric, the first in the grid on a tie."""
    return results.orderBy(F.desc_nulls_last(metric), position).limit(1)
