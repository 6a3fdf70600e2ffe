"""Run-length operators: equal-value runs, threshold events, sessionising, dense ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.operators.segments import (
    SEG,
    SEGMENT_ROWS,
    attach_carry,
    index_rows,
    scan,
    segment,
    within,
)

_MERGE = {"max": F.max, "min": F.min, "sum": F.sum}
#: The same for two values, of which either may be missing.
_BOTH = {
    "max": F.greatest,
    "min": F.least,
    "sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def equal_runs(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    value: str | Column,
    extras: Mapping[str, tuple[str, str]] | None = None,
    keep: Column | None = None,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Maximal runs of one value: (keys, value, start, end, length, extras…).

    ``frame`` is dense per session. ``extras`` maps an output name to (function, column)
    with function one of max, min, sum. ``keep`` is a filter on ``value``, applied before
    the runs are shuffled.
    """
    extras = dict(extras or {})
    source = df.withColumn("value", value if isinstance(value, Column) else F.col(value))
    return _merge_runs(segment(source, frame, rows), keys, frame, extras, keep, rows)


def _merge_runs(
    segmented: DataFrame,
    keys: Sequence[str],
    frame: str,
    extras: Mapping[str, tuple[str, str]],
    keep: Column | None,
    rows: int | None,
) -> DataFrame:
    part = within(keys)
    w = W.partitionBy(*part).orderBy(frame)
    previous = F.lag("value").over(w)
    first = F.row_number().over(w) == 1
    marked = segmented.withColumn("_new", first | ~F.col("value").eqNullSafe(previous)).withColumn(
        "_run", F.sum(F.col("_new").cast("bigint")).over(scan(part, frame))
    )
    if keep is not None:
        marked = marked.filter(keep)
    partial = marked.groupBy(*part, "_run").agg(
        F.first("value").alias("value"),
        F.min(frame).alias("start"),
        F.max(frame).alias("end"),
        *[_MERGE[fn](src).alias(name) for name, (fn, src) in extras.items()],
    )
    named = {"value": F.col("value"), "start": F.col("start"), "end": F.col("end")}
    named |= {name: F.col(name) for name in extras}
    row = F.struct(*[c.alias(n) for n, c in named.items()])
    ends = partial.groupBy(*part).agg(
        F.min_by(row, "start").alias("_first"), F.max_by(row, "start").alias("_last")
    )
    carried = _continued(ends, keys, extras)
    known = partial.join(carried, part)
    # A run that goes on from the segment before is part of the run that began it.
    begins = known.filter(~F.col("_goes_on") | (F.col("start") != F.col("_head")))
    closes = F.col("start") == F.col("_tail")
    more = F.when(closes, F.col("_more"))
    out = {"end": F.coalesce(more["end"], F.col("end"))}
    for name, (fn, _) in extras.items():
        out[name] = _BOTH[fn](F.col(name), more[name])
    out = begins.select(*keys, "value", "start", *[c.alias(n) for n, c in out.items()])
    return out.withColumn("length", F.col("end") - F.col("start") + 1)


def _continued(ends: DataFrame, keys: Sequence[str], extras: Mapping[str, tuple[str, str]]) -> DataFrame:
    """For every segment: whether its first run goes on from the segment before (``_goes_on``),
    where its first and last run start, and what later segments add to the last (``_more``).

    Takes the first and last run of each segment. First runs that go on through whole segments
    form a chain; what is left of a chain is added up from its end.
    """
    w = W.partitionBy(*keys).orderBy(SEG)
    was = F.lag("_last").over(w)
    goes_on = (was["end"] + 1 == F.col("_first.start")) & was["value"].eqNullSafe(F.col("_first.value"))
    through = F.lag(F.col("_first.start") == F.col("_last.start")).over(w)
    linked = ends.withColumns({"_goes_on": F.coalesce(goes_on, F.lit(False)), "_through": through})
    parted = ~(F.col("_goes_on") & F.coalesce("_through", F.lit(False)))
    chained = linked.withColumn("_chain", F.sum(parted.cast("int")).over(scan(keys, SEG)))
    left = W.partitionBy(*keys, "_chain").orderBy(SEG).rowsBetween(W.currentRow, W.unboundedFollowing)
    rest = [F.max(F.col("_first.end")).over(left).alias("end")]
    rest += [_MERGE[fn](F.col(f"_first.{name}")).over(left).alias(name) for name, (fn, _) in extras.items()]
    summed = chained.withColumn("_rest", F.struct(*rest))
    more = F.when(F.lead("_goes_on").over(w), F.lead("_rest").over(w))
    return summed.select(
        *within(keys),
        "_goes_on",
        F.col("_first.start").alias("_head"),
        F.col("_last.start").alias("_tail"),
        more.alias("_more"),
    )


def event_runs(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    signal: str,
    threshold: float,
    min_duration: int = 1,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Maximal runs at or above a threshold: (keys, start, end, length, peak).

    A value that is NaN or null neither starts a run nor ends one.
    """
    if min_duration < 1:
        raise ValueError(f"an event of {min_duration} frames is none")
    known = F.col(signal).isNotNull() & ~F.isnan(signal)
    base = segment(df, frame, rows).withColumn(
        "_mark", F.when(known, (F.col(signal) >= threshold).cast("int"))
    )
    local = base.withColumn(
        "_held", F.last("_mark", ignorenulls=True).over(scan(within(keys), frame))
    )
    state = attach_carry(
        local,
        base,
        keys,
        {"_tail": F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(frame)))},
        {"_carry": lambda s: F.last("_tail", ignorenulls=True).over(s)},
    ).withColumn("value", F.coalesce("_held", "_carry", F.lit(0)))
    state = state.withColumn("_peak", F.when(known, F.col(signal)))
    runs = _merge_runs(state, keys, frame, {"peak": ("max", "_peak")}, F.col("value") == 1, rows)
    return runs.filter(F.col("length") >= min_duration).drop("value")


def proposal_events(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    signal: str,
    threshold: float,
    min_duration: int = 1,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Every event, whatever the label of its video; ``label`` is a placeholder 0."""
    runs = event_runs(df, keys, frame, signal, threshold, min_duration, rows)
    return runs.withColumn("label", F.lit(0))


def training_events(
    df: DataFrame,
    manifest: DataFrame,
    keys: Sequence[str],
    frame: str,
    signal: str,
    threshold: float,
    min_duration: int = 1,
    label: str = "label",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Labelled events: the longest one of a yawning video, and all of any other video.

    Ties of length go to the higher peak, then to the earlier start. ``manifest`` has one
    row per session with its ``&``-joined video label.
    """
    runs = event_runs(df, keys, frame, signal, threshold, min_duration, rows)
    yawning = F.array_contains(F.split(F.col(label), "&"), "Yawning")
    named = runs.join(manifest.select(*keys, yawning.alias("_yawning")), list(keys))
    event = F.struct("start", "end", "length", "peak")
    best = (
        named.filter("_yawning")
        .groupBy(*keys)
        .agg(F.max_by(event, F.struct(F.col("length"), F.col("peak"), -F.col("start"))).alias("_e"))
        .select(*keys, "_e.*", F.lit(1).alias("label"))
    )
    others = named.filter(~F.col("_yawning")).select(
        *keys, "start", "end", "length", "peak", F.lit(0).alias("label")
    )
    return best.unionByName(others)


def sessionise(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    value: str,
    out: str = "interval_id",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Number the stretches of equal value and consecutive frames, from 0.

    ``frame`` is unique per session but may have gaps; a gap starts a new stretch.
    """
    base = segment(df, frame, rows)
    part = within(keys)
    w = W.partitionBy(*part).orderBy(frame)
    here = F.struct(F.col(frame).alias("f"), F.col(value).alias("v"))
    local = base.withColumn("_prev", F.lag(here).over(w))
    seen = attach_carry(
        local,
        base,
        keys,
        {"_tail": F.max_by(here, F.col(frame))},
        {"_carry": lambda s: F.last("_tail").over(s)},
    )
    prev = F.coalesce("_prev", "_carry")
    goes_on = prev.isNotNull() & prev["v"].eqNullSafe(F.col(value)) & (prev["f"] + 1 == F.col(frame))
    seen = seen.withColumn("_new", (~goes_on).cast("bigint"))
    counted = seen.withColumn("_n", F.sum("_new").over(scan(part, frame)))
    known = attach_carry(
        counted,
        seen,
        keys,
        {"_starts": F.sum("_new")},
        {"_off": lambda s: F.sum("_starts").over(s)},
    )
    number = F.col("_n") + F.coalesce("_off", F.lit(0)) - 1
    return known.withColumn(out, number).drop("_prev", "_carry", "_new", "_n", "_off", SEG)


def first_seen_ids(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    value: str,
    out: str = "interval_id",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Dense ids of a column's values in order of first appearance: (keys, value, id)."""
    firsts = df.groupBy(*keys, value).agg(F.min(frame).alias("first_frame"))
    return index_rows(firsts, keys, ["first_frame", value], out)
