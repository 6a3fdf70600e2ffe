"""Column expressions: frame sampling, states, rates, encoders, ids, probabilities."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.schemas import (
    DROWSY_CLASS,
    ON_ROAD_ZONE,
    PRECISION_BAR,
    RECALL_DROP,
    RECALL_FLOOR,
)

#: How far below a bar still counts as on it.
BAR_SLACK = 1e-9

# --- Frame sampling ---------------------------------------------------------------------


def on_stride(frame: Column, step: int) -> Column:
    """Keep every ``step``-th raw frame; apply before dropping frames without a face."""
    if step < 1:
        raise ValueError(f"every {step}-th frame is no sampling; steps start at 1")
    return frame % step == 0


def sampled_frames(total: Column, source_fps: float, target_fps: float) -> Column:
    """Frame numbers kept when a clip is down-sampled, rounding halves to even."""
    if source_fps <= 0 or target_fps <= 0:
        raise ValueError(f"cannot sample from {source_fps} to {target_fps} frames a second")
    if target_fps >= source_fps:
        return _upto(total.cast("bigint"))
    step = source_fps / target_fps
    count = F.floor(total / step)
    return F.transform(_upto(count), lambda i: F.rint(i * F.lit(step)).cast("bigint"))


def _upto(count: Column) -> Column:
    """0 … count - 1, empty for 0."""
    empty = F.array().cast("array<bigint>")
    return F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), (count - 1).cast("bigint"))).otherwise(empty)


def interval_frames(start: Column, end: Column, stride: int, max_frames: int | None) -> Column:
    """Frames of an inclusive interval by stride, its last frame always included.

    More than ``max_frames`` are thinned to an even spread; one is the middle frame.
    """
    for name, value in (("stride", stride), ("frame limit", max_frames)):
        if value is not None and value <= 0:
            raise ValueError(f"a {name} of {value} selects nothing")
    valid = F.when(end < start, F.raise_error(F.lit("an interval runs backwards"))).otherwise(start)
    first, last = valid.cast("bigint"), end.cast("bigint")
    steps = F.sequence(first, last, F.lit(stride).cast("bigint"))
    every = F.array_union(steps, F.array(last))
    if max_frames is None:
        return every
    size = F.size(every)
    if max_frames == 1:
        thinned = F.array(F.element_at(every, F.floor(size / 2).cast("int") + 1))
    else:
        picks = F.sequence(F.lit(0), F.lit(max_frames - 1))
        at = lambda i: F.rint(i * (size - 1) / F.lit(float(max_frames - 1))).cast("int")
        thinned = F.transform(picks, lambda i: F.element_at(every, at(i) + 1))
    return F.when(size > max_frames, thinned).otherwise(every)


def clamp_frames(frames: Column, frame_count: Column) -> Column:
    """Frames that exist; an interval wholly past the end of its clip is an error."""
    kept = F.filter(frames, lambda i: i < frame_count)
    return F.when(F.size(kept) > 0, kept).otherwise(
        F.raise_error(F.lit("no frame of an interval is inside its clip"))
    )


def event_rows(start: Column, end: Column, n: int = 5) -> Column:
    """``n`` rows evenly spread over [start, end], repeating rows of short events."""
    if n <= 0:
        raise ValueError(f"{n} rows of an event cannot be drawn")
    valid = F.when(end < start, F.raise_error(F.lit("an event runs backwards"))).otherwise(start)
    if n == 1:
        return F.array(valid.cast("bigint"))
    span = (end - start).cast("double")
    step = lambda i: valid + F.rint(i * span / F.lit(float(n - 1))).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), step)


# --- States and rates -------------------------------------------------------------------


def in_state(value: Column, threshold: float, mode: str) -> Column:
    """At or below / at or above the threshold; NaN and null are in neither state."""
    if mode not in ("below", "above"):
        raise ValueError(f"no such side of a threshold: {mode!r}")
    number = value.cast("double")
    hit = number <= threshold if mode == "below" else number >= threshold
    return F.coalesce(hit & ~F.isnan(number), F.lit(False))


def rate_per_minute(count: Column, n_frames: Column, fps: float) -> Column:
    if fps <= 0:
        return F.lit(0.0)
    rate = count / (n_frames / F.lit(float(fps))) * 60.0
    return F.when(n_frames > 0, rate).otherwise(0.0)


# --- Classes ----------------------------------------------------------------------------


def encode(label: Column, classes: Mapping[str, int] | Sequence[str], strict: bool = True) -> Column:
    """Class number of a label; an unknown label is an error, or null when not strict."""
    numbers = classes if isinstance(classes, Mapping) else {c: i for i, c in enumerate(classes)}
    table = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    found = F.try_element_at(table, label)
    if not strict:
        return found
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))
    return F.when(found.isNotNull(), found).otherwise(unknown.cast("int"))


def decode(index: Column, classes: Mapping[str, int] | Sequence[str]) -> Column:
    names = classes if not isinstance(classes, Mapping) else sorted(classes, key=classes.get)
    return F.get(F.array(*[F.lit(c) for c in names]), index.cast("int"))


def eyes_on_road(zone: Column) -> Column:
    return zone == ON_ROAD_ZONE


def is_drowsy(level: Column, drowsy_class: int = DROWSY_CLASS) -> Column:
    return level == drowsy_class


def is_distracted(index: Column, safe_index: int) -> Column:
    return index != safe_index


def is_yawning(label: Column) -> Column:
    return F.array_contains(F.split(label, "&"), "Yawning")


def is_talking(label: Column) -> Column:
    return F.array_contains(F.split(label, "&"), "Talking")


# --- Identifiers ------------------------------------------------------------------------


def sanitise_id(sample_id: Column) -> Column:
    return F.replace(sample_id, F.lit("#"), F.lit("_"))


def video_of(sample_id: Column) -> Column:
    """Path part of an interval id (`video#start-end`)."""
    return F.substring_index(sample_id, "#", 1)


def recording_subject(stem: Column) -> Column:
    """Subject of a recording stem: its first two ``_``-separated tokens."""
    return F.substring_index(stem, "_", 2)


def directory_subject(path: Column, sep: str = "-") -> Column:
    """Subject from the group and subject directories, two and one levels above the file's."""
    parts = F.split(path, "/")
    return F.concat_ws(sep, F.try_element_at(parts, F.lit(-4)), F.try_element_at(parts, F.lit(-3)))


# --- Probabilities ----------------------------------------------------------------------


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    total = lambda powers: F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
    shifted = lambda top: F.transform(logits, lambda x: F.exp((x - top).cast("double")))
    normal = lambda powers: bind(total(powers), lambda t: F.transform(powers, lambda x: x / t))
    return bind(bind(F.array_max(logits), shifted), normal)


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("double"))


# --- Tiers and decisions ----------------------------------------------------------------


def fatigue_tier(committed: Column, drowsy_steps: Column, alarm_after: int) -> Column:
    return F.when(committed == 2, F.when(drowsy_steps >= alarm_after, 3).otherwise(2)).otherwise(
        committed
    )


def binary_tier(committed: Column, steps: Column, audible_after: int) -> Column:
    return F.when(committed, F.when(steps >= audible_after, 2).otherwise(1)).otherwise(0)


def tier_name(tier: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in ("NONE", "VISUAL", "AUDIBLE", "ALARM")]), tier)


def deploy_decision(
    precision: Column, recall: Column, base_precision: Column, base_recall: Column
) -> Column:
    """``deploy``, or the first gate that a detector does not pass.

    It has to be precise enough, find enough, and beat the baseline's precision without giving
    up more than ``RECALL_DROP`` of its recall. Each bar is met within ``BAR_SLACK``.
    """
    precise = precision >= PRECISION_BAR - BAR_SLACK
    finds_enough = recall >= RECALL_FLOOR - BAR_SLACK
    better = (precision > base_precision) & (base_recall - recall <= RECALL_DROP + BAR_SLACK)
    return (
        F.when(~precise, "blocked_precision")
        .when(~finds_enough, "blocked_recall")
        .when(~better, "blocked_baseline")
        .otherwise("deploy")
    )
