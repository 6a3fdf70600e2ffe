"""Count-based windows over dense frames and the features summarised in them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.functions.scalars import in_state, rate_per_minute
from wakeline.operators.segments import SEGMENT_ROWS, halo, own_rows, within


def _check_window(size: int, stride: int) -> None:
    if size <= 0 or stride <= 0:
        raise ValueError("windows hold and move by at least one frame")


def rolling_window(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    columns: Sequence[str],
    capacity: int,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The last ``capacity`` rows at every row, oldest first: ``window`` and ``is_full``."""
    if capacity <= 0:
        raise ValueError("a rolling window holds at least one frame")
    if not columns:
        raise ValueError("a window needs at least one column")
    wide = halo(df, frame, before=capacity - 1, rows=rows)
    recent = W.partitionBy(*within(keys)).orderBy(frame).rowsBetween(1 - capacity, 0)
    item = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    out = wide.withColumn("window", F.collect_list(item).over(recent))
    return own_rows(out.withColumn("is_full", F.size("window") == capacity), frame, rows)


def rolling_level(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    capacity: int,
    features: Mapping[str, Column],
    level: Column,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Level of every row, 0 until the window has filled.

    ``features`` are aggregates over the last ``capacity`` rows and ``level`` is an
    expression over their names.
    """
    wide = halo(df, frame, before=capacity - 1, rows=rows)
    recent = W.partitionBy(*within(keys)).orderBy(frame).rowsBetween(1 - capacity, 0)
    scored = wide.withColumns({name: agg.over(recent) for name, agg in features.items()})
    full = F.col(frame) >= capacity - 1
    scored = scored.withColumn("level", F.when(full, level).otherwise(0).cast("int"))
    return own_rows(scored, frame, rows).drop(*features)


def sliding_windows(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    size: int,
    stride: int,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """One row per (window, frame) for every complete window; adds ``window_id``.

    Window k covers the frames k * stride … k * stride + size - 1. Whether its last frame
    exists is read off the rows borrowed from the next segment.
    """
    _check_window(size, stride)
    wide = halo(df, frame, after=size - 1, rows=rows)
    seen = wide.withColumn("_last", F.max(frame).over(W.partitionBy(*within(keys))))
    mine = own_rows(seen, frame, rows)
    first = F.greatest(F.lit(0), F.ceil((F.col(frame) - size + 1) / stride))
    last = F.least(
        F.floor(F.col(frame) / stride), F.floor((F.col("_last") + 1 - size) / stride)
    )
    return (
        mine.withColumn("_a", first)
        .withColumn("_b", last)
        .filter(F.col("_a") <= F.col("_b"))
        .withColumn("window_id", F.explode(F.sequence("_a", "_b")))
        .drop("_a", "_b", "_last")
    )


def labelled_windows(
    df: DataFrame,
    manifest: DataFrame,
    keys: Sequence[str],
    frame: str,
    columns: Sequence[str],
    size: int,
    stride: int,
    label: str = "label",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Training windows: (keys, window_id, features array ordered by frame, label).

    A window inherits the label of its session; sessions shorter than a window give none.
    """
    members = sliding_windows(df.select(*keys, frame, *columns), keys, frame, size, stride, rows)
    row = F.struct(F.col(frame).alias("_f"), F.array(*[F.col(c) for c in columns]).alias("x"))
    windows = members.groupBy(*keys, "window_id").agg(F.array_sort(F.collect_list(row)).alias("_r"))
    return windows.join(manifest.select(*keys, label), list(keys)).select(
        *keys, "window_id", F.transform("_r", lambda r: r["x"]).alias("features"), label
    )


def _over_panes(
    panes: DataFrame,
    keys: Sequence[str],
    size: int,
    stride: int,
    pane: int,
    aggs: Sequence[Column],
) -> DataFrame:
    """Combine pane partials (`_pane`, `_n`, …) into complete windows.

    A pane is the greatest common divisor of size and stride long, so every window is a
    whole number of panes and rows are aggregated once, whatever the overlap.
    """
    at = F.col("_pane") * pane
    spread = (
        panes.withColumn("_a", F.greatest(F.lit(0), F.ceil((at + pane - size) / stride)))
        .withColumn("_b", F.floor(at / stride))
        .filter(F.col("_a") <= F.col("_b"))
        .withColumn("window_id", F.explode(F.sequence("_a", "_b")))
        .withColumn("_opens", F.col("window_id") * stride == at)
    )
    return (
        spread.groupBy(*keys, "window_id")
        .agg(F.sum("_n").alias("_n"), *aggs)
        .filter(F.col("_n") == size)
        .drop("_n")
    )


def window_summary(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    size: int,
    stride: int,
    fps: float,
    ear_threshold: float,
    mar_threshold: float,
    nod_threshold: float,
    ear: str = "ear",
    mar: str = "mar",
    pitch: str = "pitch",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Eleven fatigue features per complete window.

    An onset is a row in state whose predecessor in the window is not; a window that opens
    in state counts one there. Closures are the in-state runs, so their mean length is the
    in-state rows over the onsets.
    """
    _check_window(size, stride)
    pane = gcd(size, stride)
    panes = summary_panes(df, keys, frame, [pane], ear_threshold, mar_threshold, nod_threshold, ear, mar, pitch, rows)
    return pane_windows(panes, keys, size, stride, pane, fps)


def summary_panes(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    lengths: Sequence[int],
    ear_threshold: float,
    mar_threshold: float,
    nod_threshold: float,
    ear: str = "ear",
    mar: str = "mar",
    pitch: str = "pitch",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Partial features of stretches of each of the ``lengths``, for windows that consist of them.

    The frames are put in order once; a stretch is summed in that order, as if it were the only one.
    """
    states = {
        "blink": in_state(F.col(ear), ear_threshold, "below"),
        "yawn": in_state(F.col(mar), mar_threshold, "above"),
        "nod": in_state(F.abs(F.col(pitch)), nod_threshold, "above"),
    }
    base = df.select(
        *keys,
        frame,
        F.col(ear).alias("_ear"),
        F.col(mar).alias("_mar"),
        F.abs(F.col(pitch)).alias("_pitch"),
        *[s.alias(f"_{name}") for name, s in states.items()],
    )
    w = W.partitionBy(*within(keys)).orderBy(frame)
    wide = halo(base, frame, before=1, rows=rows)
    onset = {n: F.col(f"_{n}") & ~F.coalesce(F.lag(f"_{n}").over(w), F.lit(False)) for n in states}
    flagged = wide.withColumns({f"_{n}_on": c for n, c in onset.items()})
    flagged = own_rows(flagged, frame, rows)
    each = [F.lit(n) for n in lengths]
    flagged = flagged.withColumn("_length", each[0] if len(each) == 1 else F.explode(F.array(*each)))
    opens = F.col(frame) % F.col("_length") == 0
    return flagged.groupBy(*keys, "_length", F.expr(f"`{frame}` div _length").alias("_pane")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("_blink").alias("_closed"),
        F.sum("_ear").alias("_ear"),
        F.sum("_mar").alias("_mar"),
        F.sum("_pitch").alias("_pitch"),
        *[F.count_if(f"_{n}_on").alias(f"_{n}_on") for n in states],
        # Extra onsets if a window opens on the first row of this pane.
        *[F.count_if(opens & F.col(f"_{n}") & ~F.col(f"_{n}_on")).alias(f"_{n}_open") for n in states],
    )


def pane_windows(panes: DataFrame, keys: Sequence[str], size: int, stride: int, pane: int, fps: float) -> DataFrame:
    """The windows of :func:`window_summary`, from its panes of one length."""
    _check_window(size, stride)
    if size % pane or stride % pane:
        raise ValueError(f"windows of {size} frames every {stride} do not consist of panes of {pane}")
    panes = panes.where(F.col("_length") == pane).drop("_length")
    states = ("blink", "yawn", "nod")
    counts = [
        F.sum(F.col(f"_{n}_on") + F.when(F.col("_opens"), F.col(f"_{n}_open")).otherwise(0)).alias(
            f"{n}_count"
        )
        for n in states
    ]
    sums = [F.sum(c).alias(c) for c in ("_closed", "_ear", "_mar", "_pitch")]
    windows = _over_panes(panes, keys, size, stride, pane, [*counts, *sums])
    return windows.select(
        *keys,
        "window_id",
        (F.col("_closed") / size).alias("perclos"),
        *[f"{n}_count" for n in states],
        *[rate_per_minute(F.col(f"{n}_count"), F.lit(size), fps).alias(f"{n}_rate_per_min") for n in states],
        F.coalesce(F.try_divide("_closed", "blink_count"), F.lit(0.0)).alias("mean_blink_duration"),
        (F.col("_ear") / size).alias("mean_ear"),
        (F.col("_mar") / size).alias("mean_mar"),
        (F.col("_pitch") / size).alias("mean_abs_pitch"),
    )


def window_labels(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    flag: str,
    size: int,
    stride: int,
    positive_fraction: float,
) -> DataFrame:
    """Windows whose share of flagged rows reaches the fraction: class 2, the others 0."""
    _check_window(size, stride)
    pane = gcd(size, stride)
    panes = df.groupBy(*keys, F.expr(f"`{frame}` div {pane}").alias("_pane")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(flag)).alias("_hits")
    )
    windows = _over_panes(panes, keys, size, stride, pane, [F.sum("_hits").alias("_hits")])
    drowsy = F.col("_hits") / size >= positive_fraction
    return windows.select(
        *keys, "window_id", drowsy.alias("drowsy"), F.when(drowsy, 2).otherwise(0).alias("label")
    )


def gate_with_margin(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    signal: str,
    has_crop: str,
    gate: float,
    margin: int,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Rows within ``margin`` rows of one at or above the gate that have a crop."""
    if margin < 0:
        raise ValueError(f"a margin of {margin} frames reaches nowhere")
    wide = halo(df, frame, before=margin, after=margin, rows=rows)
    around = W.partitionBy(*within(keys)).orderBy(frame).rowsBetween(-margin, margin)
    near = F.max(in_state(F.col(signal), gate, "above")).over(around)
    return own_rows(wide.withColumn("_near", near), frame, rows).filter(
        F.col("_near") & F.col(has_crop)
    ).drop("_near")


def perclos(ear: str | Column, threshold: float) -> Column:
    """Share of rows at or below the threshold, 0 for no rows (an aggregate)."""
    column = F.col(ear) if isinstance(ear, str) else ear
    closed = in_state(column, threshold, "below").cast("double")
    return F.coalesce(F.avg(closed), F.lit(0.0))


def session_onsets(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    signal: str,
    threshold: float,
    mode: str,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Onsets, rows in state and mean run length of a whole session.

    A run is one onset, so the mean run length is rows in state over onsets, 0 for none.
    """
    base = df.select(*keys, frame, in_state(F.col(signal), threshold, mode).alias("_in"))
    w = W.partitionBy(*within(keys)).orderBy(frame)
    wide = halo(base, frame, before=1, rows=rows)
    started = F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))
    flagged = own_rows(wide.withColumn("_on", started), frame, rows)
    out = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if("_on").alias("onsets"),
        F.count_if("_in").alias("in_state"),
    )
    mean = F.coalesce(F.try_divide("in_state", "onsets"), F.lit(0.0))
    return out.withColumn("mean_duration", mean)
