"""Annotated intervals joined to frames, and nearest-row substitution."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.operators.segments import SEGMENT_ROWS, attach_carry, scan, segment, within
from wakeline.schemas import CLOSURE_FPS, CLOSURE_SECONDS, CROP_MARGIN, GAZE_ZONES

_BLOCK = 1024


def closure_labels(
    frames: DataFrame,
    intervals: DataFrame,
    lengths: DataFrame,
    keys: Sequence[str],
    frame: str,
    fps: float = CLOSURE_FPS,
    min_seconds: float = CLOSURE_SECONDS,
    closed_action: str = "eyes_state/close",
    out: str = "drowsy",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Frames inside an eye closure of at least ``min_seconds``.

    ``intervals`` has (keys, action, start_frame, end_frame), ends included, clamped to
    [0, n_frames) of ``lengths``. An interval adds 1 at its start and takes it away after
    its end; a frame is covered where the running total is positive. The cost is frames
    plus intervals, whatever the interval lengths and overlaps.
    """
    shortest = max(1, round(min_seconds * fps))
    long_enough = F.col("end_frame") - F.col("start_frame") + 1 >= shortest
    clamped = (
        intervals.filter((F.col("action") == closed_action) & long_enough)
        .join(lengths.select(*keys, "n_frames"), list(keys))
        .withColumn("_lo", F.greatest(F.lit(0), F.col("start_frame")).cast("bigint"))
        .withColumn("_hi", F.least(F.col("n_frames") - 1, F.col("end_frame")).cast("bigint"))
        .filter(F.col("_lo") <= F.col("_hi"))
    )
    steps = clamped.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("_lo").alias(frame), F.lit(1).alias("_step")),
                F.struct((F.col("_hi") + 1).alias(frame), F.lit(-1).alias("_step")),
            )
        ),
    )
    return _covered(frames, steps, keys, frame, out, rows)


def _covered(
    frames: DataFrame, steps: DataFrame, keys: Sequence[str], frame: str, out: str, rows: int
) -> DataFrame:
    # Steps at one frame are summed first, so the scan holds at most one row per frame.
    total = steps.groupBy(*keys, frame).agg(F.sum("_step").alias("_step"))
    payload = [c for c in frames.columns if c not in (*keys, frame)]
    row = F.struct(*payload) if payload else F.struct(F.lit(1).alias("_"))
    real = frames.select(*keys, frame, F.lit(0).cast("bigint").alias("_step"), row.alias("_row"))
    marks = total.select(*keys, frame, "_step").withColumn(
        "_row", F.lit(None).cast(real.schema["_row"].dataType)
    )
    both = segment(real.unionByName(marks), frame, rows)
    # A step counts from its own frame on, so it sorts before the frame itself.
    upto = scan(within(keys), frame, F.col("_row").isNotNull())
    local = both.withColumn("_open", F.sum("_step").over(upto))
    known = attach_carry(
        local,
        both,
        keys,
        {"_s": F.sum("_step")},
        {"_carry": lambda s: F.sum("_s").over(s)},
    )
    covered = F.col("_open") + F.coalesce("_carry", F.lit(0)) > 0
    kept = known.filter(F.col("_row").isNotNull())
    return kept.select(*keys, frame, *([F.col("_row." + c) for c in payload]), covered.alias(out))


def _frames_of(intervals: DataFrame, frame: str) -> DataFrame:
    """One row per frame of [start_frame, end_frame], in two bounded steps."""
    blocks = intervals.filter(F.col("start_frame") <= F.col("end_frame")).withColumn(
        "_b",
        F.explode(F.sequence(*(F.floor(F.col(c) / _BLOCK) for c in ("start_frame", "end_frame")))),
    )
    lo = F.greatest(F.col("start_frame").cast("bigint"), F.col("_b") * _BLOCK)
    hi = F.least(F.col("end_frame").cast("bigint"), F.col("_b") * _BLOCK + _BLOCK - 1)
    return blocks.withColumn(frame, F.explode(F.sequence(lo, hi))).drop("_b")


def _winners(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stretches of frames and the interval of the highest position there, as a sweep line.

    Intervals are clipped to spans of ``SEGMENT_ROWS`` frames and dealt by document and span;
    the bounds of a span are swept in order with the open intervals in a heap by position.
    """
    first, last = (F.floor(F.col(c) / SEGMENT_ROWS) for c in ("start_frame", "end_frame"))
    spans = intervals.where("start_frame <= end_frame").withColumn("_span", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start_frame").cast("bigint"), F.col("_span") * SEGMENT_ROWS)
    end = F.least(F.col("end_frame").cast("bigint"), F.col("_span") * SEGMENT_ROWS + SEGMENT_ROWS - 1)
    spans = spans.withColumns({"start_frame": begin, "end_frame": end})
    by = [*keys, "_span"]
    spans = spans.repartition(*by).sortWithinPartitions(*by, "start_frame")
    won = spans.mapInArrow(_sweep(len(keys)), spans.schema)
    return won.drop("_span", "position")


class _Later(tuple):
    """A position; the later one comes first in a heap."""

    @classmethod
    def of(cls, value, number: int) -> _Later:
        parts = value.values() if isinstance(value, dict) else [value]
        return cls((*((v is not None, v) for v in parts), number))

    def __lt__(self, other: tuple) -> bool:
        return tuple.__gt__(self, other)


def _sweep(n_keys: int) -> Callable:
    """Rows (keys, position, zone, interval key, start, end, span) sorted by document, span and
    start to the stretches their intervals win."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, seen, open_, out, schema = None, 0, 0, [], [], None

        def upto(stop: int | None) -> None:
            """Settle the frames before ``stop``, or all that are covered."""
            nonlocal at
            while open_ and (stop is None or at < stop):
                _, end, row = open_[0]
                if end < at:
                    heappop(open_)
                    continue
                until = end if stop is None else min(end, stop - 1)
                out.append((*row[:-3], at, until, row[-1]))
                at = until + 1

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                here = (*row[:n_keys], row[-1])
                if here != group:
                    upto(None)
                    group, at = here, row[-3]
                    open_.clear()
                upto(row[-3])
                at = max(at, row[-3])
                heappush(open_, (_Later.of(row[n_keys], seen), row[-2], row))
                seen += 1
            if out:
                yield _rows_batch(out, schema)
                out = []
        upto(None)
        if out:
            yield _rows_batch(out, schema)

    return run


def _rows_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def zone_per_frame(
    intervals: DataFrame,
    keys: Sequence[str],
    frame: str = "frame",
    lengths: DataFrame | None = None,
    zones: Sequence[str] = GAZE_ZONES,
    strict: bool = True,
) -> DataFrame:
    """Zone and interval key of every annotated frame, the last interval written winning.

    ``intervals`` has (keys, position, zone, start_frame, end_frame) with ``position`` in
    document order. Ends are clamped to the clip, starts are not. ``strict`` rejects
    unknown zones, as labels need; interval keys alone accept them. Frames are made of the
    stretches that an interval wins, so their number is that of the labelled frames, however
    intervals overlap.
    """
    known = intervals.filter(F.col("zone") != "not_valid")
    if strict:
        wrong = F.raise_error(F.concat(F.lit("unknown gaze zone: "), F.col("zone")))
        known = known.withColumn("zone", F.when(F.col("zone").isin(*zones), F.col("zone")).otherwise(wrong))
    if lengths is not None:
        known = known.join(lengths.select(*keys, "n_frames"), list(keys)).withColumn(
            "end_frame", F.least(F.col("end_frame").cast("bigint"), F.col("n_frames") - 1)
        )
    key = F.concat_ws(
        "", F.col("zone"), F.lit(":"), F.col("start_frame"), F.lit("-"), F.col("end_frame")
    )
    won = _winners(known.select(*keys, "position", "zone", key.alias("interval_key"), "start_frame", "end_frame"), keys)
    return _frames_of(won, frame).select(*keys, frame, "zone", "interval_key")


def label_rows(
    rows: DataFrame, labels: DataFrame, keys: Sequence[str], frame: str, how: str = "left"
) -> DataFrame:
    """Give kept rows the label of the raw frame they came from."""
    return rows.join(labels, [*keys, frame], how)


def nearest_rows(
    wanted: DataFrame,
    available: DataFrame,
    keys: Sequence[str],
    row: str = "row",
    crop_row: str = "crop_row",
    tolerance: int = CROP_MARGIN,
    strict: bool = True,
) -> DataFrame:
    """Nearest available row of every wanted row, the lower one on a tie.

    Adds ``crop_row`` and ``distance``; rows wanted twice come out twice. A row farther than
    ``tolerance`` from all available rows is an error, or null when not strict. Both tables
    are put on one line per session stretch; the last and the next available row are read off
    it, and stretches borrow the available rows ``tolerance`` beyond their borders.
    """
    span = max(SEGMENT_ROWS, tolerance)
    home = F.expr(f"_at div {span}")
    inside = F.expr(f"_at % {span}")
    borrowed = F.array_compact(
        F.array(home, F.when(inside >= span - tolerance, home + 1), F.when((inside < tolerance) & (home > 0), home - 1))
    )
    asked = wanted.select(*keys, F.col(row).cast("bigint").alias("_at"), F.struct(*wanted.columns).alias("_w"))
    offered = available.select(*keys, F.col(crop_row).cast("bigint").alias("_at"), F.lit(None).cast(asked.schema["_w"].dataType).alias("_w"))
    line = asked.withColumn("_seg", home).unionByName(offered.distinct().withColumn("_seg", F.explode(borrowed)))
    have = F.when(F.col("_w").isNull(), F.col("_at"))
    w = W.partitionBy(*keys, "_seg").orderBy("_at")
    upto = w.rangeBetween(W.unboundedPreceding, W.currentRow)
    onward = w.rangeBetween(W.currentRow, W.unboundedFollowing)
    near = line.withColumn("_lo", F.max(have).over(upto)).withColumn("_hi", F.min(have).over(onward)).where("_w is not null")
    below, above = F.col("_at") - F.col("_lo"), F.col("_hi") - F.col("_at")
    closest = F.when(F.col("_hi").isNull() | (below <= above), F.col("_lo")).otherwise(F.col("_hi"))
    distance = F.least(below, above)
    missing = F.raise_error(F.lit("an event row is too far from every crop")).cast("bigint")
    none = missing if strict else F.lit(None).cast("bigint")
    close = distance <= tolerance
    return near.select(
        "_w.*",
        F.when(close, closest).otherwise(none).alias(crop_row),
        F.when(close, distance).cast("int").alias("distance"),
    )
