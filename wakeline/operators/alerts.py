"""Alert tracks: debounced tiers, smoothing, streaks, cadence, fusion and change events.

The debounce machine commits a level after it has been seen for E steps in a row (going
up) or D steps (going down). Seen from the data, only two positions inside a run of equal
levels matter, lo = min(E, D) and hi = max(E, D):

* at position hi the level is committed whatever came before: a *reset*;
* at position lo it is committed in one direction only: committed becomes max(committed,
  level) when E <= D, min(committed, level) otherwise.

So the committed level is a running max (min) that starts again at every reset. Packed as
``resets so far * 4 + rank of the level`` it is one running maximum, which also composes
over segments.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.operators.segments import (
    SEG,
    SEGMENT_ROWS,
    SLICE,
    SLICE_ROWS,
    attach_carry,
    cut,
    halo,
    hold_last,
    index_rows,
    own_rows,
    running_sum,
    scan,
    segment,
    slice_by_order,
    within,
)
from wakeline.schemas import AUDIBLE, NONE, SAFE_ACTIVITY, VISUAL


def check_steps(*steps: int) -> None:
    if min(steps) <= 0:
        raise ValueError("steps of a track count from one")


# --- Debounced tracks (fatigue levels 0/1/2 and the binary distraction track) -----------


def level_rank(level: Column, upward: Column | bool) -> Column:
    """Order in which a level wins the running maximum."""
    if isinstance(upward, bool):
        return level if upward else 3 - level
    return F.when(upward, level).otherwise(3 - level)


def committed_after(state: Column, packed: Column, upward: Column | bool) -> Column:
    """Committed level after the packed summary ``packed``, from ``state`` before it."""
    level = level_rank(packed % 4, upward)
    if isinstance(upward, bool):
        joined = F.greatest(state, level) if upward else F.least(state, level)
    else:
        joined = F.when(upward, F.greatest(state, level)).otherwise(F.least(state, level))
    return F.when(packed.isNull(), state).when(packed >= 4, level).otherwise(joined)


def committed_before(summary: DataFrame, keys: Sequence[str], upward: Column | bool) -> DataFrame:
    """Committed level before each segment, from the packed summaries of the earlier ones."""
    before = W.partitionBy(*keys).orderBy(SEG)
    upto = before.rowsBetween(W.unboundedPreceding, W.currentRow)
    resets = F.sum(F.when(F.col("_packed") >= 4, 1).otherwise(0)).over(upto)
    packed = F.max(resets * 4 + F.col("_packed") % 4).over(upto)
    after = summary.withColumn("_after", packed)
    return after.withColumn("_in", F.lag("_after").over(before)).select(
        *keys, SEG, committed_after(F.lit(0), F.col("_in"), upward).alias("_state")
    )


class Track(NamedTuple):
    """A debounced track: levels from 0 to ``top``, and (escalate, de-escalate, alarm after).

    Frames where ``active`` is not true do not count: they take no step and hold the state.
    """

    name: str
    level: Column
    top: int
    steps: tuple[int, int, int]
    active: Column | None = None

    @property
    def upward(self) -> bool:
        return self.steps[0] <= self.steps[1]

    @property
    def lo(self) -> int:
        return min(self.steps[:2])

    @property
    def hi(self) -> int:
        return max(self.steps[:2])


def debounce_tracks(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    wanted: Sequence[Track],
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Adds ``<name>_level``, ``<name>_committed`` and ``<name>_tier`` of every track.

    All tracks share one scan of the segments, one summary row per segment and one join. What
    a segment cannot know are the run it begins in, the level committed before it and since
    when the top level has been committed. All but its first run is therefore worked out for
    each level that may have been committed, and the summaries say which one was.
    """
    for track in wanted:
        check_steps(*track.steps)
    tracks = [(f"_t{i}", t) for i, t in enumerate(wanted)]
    seen = {f"{p}l": t.level if t.active is None else F.when(t.active, t.level) for p, t in tracks}
    scanned = _scan_tracks(segment(df.withColumns(seen), frame, rows), keys, frame, tracks)
    known = scanned.join(_carried_tracks(scanned, keys, frame, tracks), within(keys))
    return known.select(*df.columns, *[c for p, t in tracks for c in _track_columns(p, t)])


def _scan_tracks(
    base: DataFrame, keys: Sequence[str], frame: str, tracks: Sequence[tuple[str, Track]]
) -> DataFrame:
    """Running columns of each track, by its counted frames in the segment.

    ``c`` counts them; ``prev`` is the level before, ``b`` and ``f`` the count where the present
    and the second run began, ``r`` the resets, ``p`` the packed event of all runs but the
    first, and ``z<s>`` the last count at which the top level was not committed after these,
    from level s.
    """
    w = W.partitionBy(*within(keys)).orderBy(frame)
    upto, earlier = scan(within(keys), frame), w.rowsBetween(W.unboundedPreceding, -1)
    out, steps = base, [{}, {}, {}, {}, {}]
    for p, t in tracks:
        level, c, b, r = (F.col(p + x) for x in "lcbr")
        counts = level.isNotNull()
        turn = counts & (level != F.col(f"{p}prev"))
        later = counts & b.isNotNull()
        reset = later & (c - b + 1 == t.hi)
        event = reset | (later & (c - b + 1 == t.lo))
        steps[0] |= {f"{p}c": F.count(level).over(upto), f"{p}prev": F.last(level, ignorenulls=True).over(earlier)}
        steps[1] |= {f"{p}b": F.max(F.when(turn, c)).over(upto), f"{p}f": F.min(F.when(turn, c)).over(upto)}
        steps[2] |= {f"{p}r": F.sum(F.when(reset, 1).otherwise(0)).over(upto)}
        steps[3] |= {f"{p}p": F.max(F.when(event, r * 4 + level_rank(level, t.upward))).over(upto)}
        for s in range(t.top + 1):
            after = committed_after(F.lit(s), F.col(f"{p}p"), t.upward)
            steps[4] |= {f"{p}z{s}": F.max(F.when(later & (after != t.top), c)).over(upto)}
    for columns in steps:
        out = out.withColumns(columns)
    return out


def _either(level: Column, top: int, of: str) -> Column:
    """The one of the columns ``<of>0`` … ``<of><top>`` that belongs to a level."""
    return F.coalesce(*[F.when(level == s, F.col(f"{of}{s}")) for s in range(top + 1)])


def _carried_tracks(
    scanned: DataFrame, keys: Sequence[str], frame: str, tracks: Sequence[tuple[str, Track]]
) -> DataFrame:
    """What every segment inherits: a row for each, worked out over the summaries.

    ``n0`` counted frames before it, ``lp`` the level they end with, ``carry`` of them in the
    run it begins in, ``in`` committed before and ``mid`` after its first run, and since which
    count the top level has been (``si``, ``sm``).
    """
    aggs = {}
    for p, t in tracks:
        level = F.col(f"{p}l")
        aggs |= {f"{p}{x}": F.max(f"{p}{x}") for x in "cbfp"}
        aggs |= {f"{p}z{s}": F.max(f"{p}z{s}") for s in range(t.top + 1)}
        aggs[f"{p}first"] = F.min_by(level, F.when(level.isNotNull(), F.col(frame)))
        aggs[f"{p}last"] = F.max_by(level, F.when(level.isNotNull(), F.col(frame)))
    out = scanned.groupBy(*within(keys)).agg(*[c.alias(n) for n, c in aggs.items()])
    w = W.partitionBy(*keys).orderBy(SEG)
    upto, earlier = scan(keys, SEG), w.rowsBetween(W.unboundedPreceding, -1)
    for p, t in tracks:
        n, begun, second, packed = (F.col(p + x) for x in "cbfp")
        whole = second.isNull()
        out = out.withColumns(
            {
                f"{p}n0": F.coalesce(F.sum(n).over(earlier), F.lit(0)),
                f"{p}lp": F.last(f"{p}last", ignorenulls=True).over(earlier),
            }
        )
        same = F.col(f"{p}first") == F.col(f"{p}lp")
        # Segments that are one run prolong the run before them.
        parted = (n > 0) & ~F.coalesce(whole & same, F.lit(False))
        out = out.withColumn(f"{p}g", F.sum(parted.cast("int")).over(upto))
        tail = F.when(whole, n).otherwise(n - begun + 1)
        out = out.withColumn(f"{p}tail", F.sum(tail).over(scan([*keys, f"{p}g"], SEG)))
        carry = F.when(same, F.lag(f"{p}tail").over(w)).otherwise(0)
        out = out.withColumn(f"{p}carry", F.coalesce(carry, F.lit(0)))
        first = level_rank(F.col(f"{p}first"), t.upward)
        reach = F.col(f"{p}carry") + F.when(whole, n).otherwise(second - 1)
        hits = {x: (F.col(f"{p}carry") < x) & (reach >= x) for x in (t.lo, t.hi)}
        lead = F.when(hits[t.hi], 4 + first).when(hits[t.lo], first)
        out = out.withColumn(f"{p}lead", lead)
        joined = F.greatest(f"{p}lead", F.when(hits[t.hi], 4).otherwise(0) + packed)
        out = out.withColumn(f"{p}all", joined)
        resets = F.sum(F.when(F.col(f"{p}all") >= 4, 1).otherwise(0)).over(upto)
        out = out.withColumn(f"{p}resets", resets)
        out = out.withColumn(f"{p}after", F.max(F.col(f"{p}resets") * 4 + F.col(f"{p}all") % 4).over(upto))
        out = out.withColumn(f"{p}in", committed_after(F.lit(0), F.lag(f"{p}after").over(w), t.upward))
        out = out.withColumn(f"{p}mid", committed_after(F.col(f"{p}in"), F.col(f"{p}lead"), t.upward))
        mid, n0 = F.col(f"{p}mid"), F.col(f"{p}n0")
        at_lo = hits[t.lo] & (committed_after(F.col(f"{p}in"), first, t.upward) == t.top)
        rose = n0 + F.when(at_lo, t.lo).otherwise(t.hi) - F.col(f"{p}carry")
        rose = F.when((mid == t.top) & (F.col(f"{p}in") != t.top), rose)
        ends = committed_after(mid, packed, t.upward) == t.top
        below = _either(mid, t.top, f"{p}z")
        since = F.when(below.isNotNull(), n0 + below + 1).when(mid == t.top, rose).otherwise(n0 + second)
        out = out.withColumn(f"{p}since", F.when(ends, since))
        out = out.withColumn(f"{p}si", F.last(f"{p}since", ignorenulls=True).over(earlier))
        out = out.withColumn(f"{p}sm", F.coalesce(rose, F.col(f"{p}si")))
    kept = [f"{p}{x}" for p, _ in tracks for x in ("n0", "lp", "carry", "in", "mid", "si", "sm")]
    return out.select(*within(keys), *kept)


def _track_columns(p: str, t: Track) -> list[Column]:
    """Level, committed level and tier of a row from its running columns and what it inherits."""
    c, begun, second, n0, carry, before, mid = (F.col(p + x) for x in ("c", "b", "f", "n0", "carry", "in", "mid"))
    level = F.coalesce(f"{p}l", f"{p}prev")
    at = carry + c
    ranked = committed_after(before, level_rank(level, t.upward), t.upward)
    lead = F.when(at >= t.hi, level).when(at >= t.lo, ranked).otherwise(before)
    rose = F.when((at >= t.lo) & (ranked == t.top), t.lo).otherwise(t.hi)
    lead_since = F.when(before == t.top, F.col(f"{p}si")).otherwise(n0 + rose - carry)
    below = _either(mid, t.top, f"{p}z")
    later = F.when(below.isNotNull(), n0 + below + 1).when(mid == t.top, F.col(f"{p}sm")).otherwise(n0 + second)
    committed = F.when(c == 0, before).when(begun.isNull(), lead).otherwise(committed_after(mid, F.col(f"{p}p"), t.upward))
    since = F.when(c == 0, F.col(f"{p}si")).when(begun.isNull(), lead_since).otherwise(later)
    held = n0 + c - since + 1
    tier = F.when((committed == t.top) & (held >= t.steps[2]), t.top + 1).otherwise(committed)
    named = {"level": F.coalesce(level, F.col(f"{p}lp"), F.lit(0)), "committed": committed, "tier": tier}
    return [x.cast("int").alias(f"{t.name}_{n}") for n, x in named.items()]


def _fatigue_level(level: str) -> Column:
    wrong = F.raise_error(F.concat(F.lit("no such fatigue level: "), F.col(level)))
    return F.when(F.col(level).isin(0, 1, 2), F.col(level).cast("int")).otherwise(wrong)


def debounce(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    level: str,
    escalate: int = 3,
    de_escalate: int = 8,
    alarm_after: int = 15,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Fatigue track: adds ``committed`` (0/1/2) and ``tier`` (0..3) to dense frames."""
    checked = df.withColumn(level, _fatigue_level(level))
    track = Track("_d", F.col(level), 2, (escalate, de_escalate, alarm_after))
    out = debounce_tracks(checked, keys, frame, [track], rows).drop("_d_level")
    return out.withColumnsRenamed({"_d_committed": "committed", "_d_tier": "tier"})


def debounce_binary(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    flag: str,
    escalate: int = 3,
    de_escalate: int = 8,
    audible_after: int = 15,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Distraction track: adds ``committed`` (0/1) and ``tier`` (0, 1 or 2)."""
    track = Track("_d", F.col(flag).cast("int"), 1, (escalate, de_escalate, audible_after))
    out = debounce_tracks(df, keys, frame, [track], rows).drop("_d_level")
    return out.withColumnsRenamed({"_d_committed": "committed", "_d_tier": "tier"})


# --- Tier changes and alarm counts ------------------------------------------------------


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    columns: Sequence[str],
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Adds ``prev_<column>`` from the row before, over dense frames."""
    w = W.partitionBy(*within(keys)).orderBy(frame)
    out = halo(df, frame, before=1, rows=rows)
    lagged = out.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})
    return own_rows(lagged, frame, rows)


def tier_events(
    df: DataFrame, keys: Sequence[str], frame: str, tier: str = "tier", rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Rows where the tier differs from the one before, which is 0 at the start."""
    out = with_previous(df.select(*keys, frame, tier), keys, frame, [tier], rows)
    previous = F.coalesce(F.col(f"prev_{tier}"), F.lit(NONE))
    return out.filter(F.col(tier) != previous).drop(f"prev_{tier}")


def alarm_counts(
    events: DataFrame,
    keys: Sequence[str],
    frame: str,
    threshold: int,
    tier: str = "tier",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Alarms and first alarm frame per session, over sparse tier events.

    An alarm is an event at or above the threshold whose predecessor is below it.
    """
    base = segment(events, frame, rows)
    w = W.partitionBy(*within(keys)).orderBy(frame)
    local = base.withColumn("_prev", F.lag(tier).over(w))
    seen = attach_carry(
        local,
        base,
        keys,
        {"_tail": F.max_by(tier, F.col(frame))},
        {"_carry": lambda s: F.last("_tail").over(s)},
    )
    before = F.coalesce("_prev", "_carry", F.lit(NONE))
    rises = (F.col(tier) >= threshold) & (before < threshold)
    return seen.groupBy(*keys).agg(
        F.count_if(rises).alias("alarms"), F.min(F.when(rises, F.col(frame))).alias("first_frame")
    )


# --- Gaze: majority filter and continuous streak ------------------------------------------


def majority_smooth(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    ts: str,
    zone: str,
    window_us: int,
    zones: Sequence[str] | None = None,
    out: str = "smoothed",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Most frequent zone of the last ``window_us`` microseconds, bounds included.

    A null zone yields null and clears the history. Ties go to the zone seen last. ``ts``
    holds microseconds and does not decrease with ``frame``. Every vote is counted in when
    it is seen and out when it expires, so the cost does not depend on the window length.
    ``zones`` is the vocabulary if it is small and known, a column of counts each; without it
    any number of zones is counted in rows: by segments that also see the votes open at their
    start (:func:`_segment_mode`), or, where windows are so long that these would be more rows
    than the table's, from the standings of zones (:func:`_sliding_mode`).
    """
    if window_us <= 0:
        raise ValueError(f"votes cannot be taken over {window_us} microseconds")
    if zones is None:
        return _open_mode(df, keys, frame, ts, zone, window_us, out, rows)
    unknown = F.raise_error(F.concat(F.lit("not in the vocabulary: "), F.col(zone)))
    listed = F.col(zone).isNull() | F.col(zone).isin(*zones)
    df = df.withColumn(zone, F.when(listed, F.col(zone)).otherwise(unknown))
    gaps = F.col(zone).isNull().cast("bigint")
    epochs = cut(running_sum(df, keys, frame, gaps, "_epoch", rows))
    group = [*keys, "_epoch"]
    moves = _moves(epochs, ts, zone, window_us)
    sliced = slice_by_order(moves, group, ["_at", "_move", frame])
    upto = scan(within(group, SLICE), "_at", "_move", frame)
    delta = F.when(F.col("_move") == 0, 1).otherwise(-1)
    counted, summaries, carries = {}, {}, {}
    for i, name in enumerate(zones):
        mine = F.col(zone) == name
        seen = F.when(mine & (F.col("_move") == 0), F.col(frame))
        counted[f"_c{i}"] = F.sum(F.when(mine, delta).otherwise(0)).over(upto)
        counted[f"_l{i}"] = F.max(seen).over(upto)
        summaries[f"_sc{i}"] = F.sum(F.when(mine, delta).otherwise(0))
        summaries[f"_sl{i}"] = F.max(seen)
        carries[f"_pc{i}"] = lambda s, i=i: F.sum(f"_sc{i}").over(s)
        carries[f"_pl{i}"] = lambda s, i=i: F.max(f"_sl{i}").over(s)
    known = attach_carry(
        sliced.withColumns(counted), sliced, group, summaries, carries, SLICE
    )
    ranked = [
        F.struct(
            (F.col(f"_c{i}") + F.coalesce(f"_pc{i}", F.lit(0))).alias("n"),
            F.greatest(f"_l{i}", F.col(f"_pl{i}").cast("bigint")).alias("last"),
            F.lit(name).alias("zone"),
        )
        for i, name in enumerate(zones)
    ]
    voted = F.when(F.col(zone).isNotNull(), F.array_max(F.array(*ranked))["zone"])
    return known.filter(F.col("_move") == 0).withColumn(out, voted).select(*df.columns, out)


def _moves(votes: DataFrame, ts: str, zone: str, window_us: int) -> DataFrame:
    """Votes come in at ts (``_move`` 0) and leave after ts + window (1), in that order at equal
    times; rows without a zone only come in."""
    in_and_out = F.when(F.col(zone).isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    moves = votes.withColumn("_move", F.explode(in_and_out))
    return moves.withColumn("_at", F.col(ts) + F.when(F.col("_move") == 1, window_us).otherwise(0))


def _open_mode(
    df: DataFrame, keys: Sequence[str], frame: str, ts: str, zone: str, window_us: int, out: str, rows: int
) -> DataFrame:
    """The majority over any number of zones, by the way that moves fewer rows."""
    df = cut(df)
    # Segments after the first, a row for every ``rows`` of a session: when their votes begin.
    later = segment(df, frame, rows).where(F.col(SEG) > 0)
    starts = later.groupBy(*keys, SEG).agg((F.min(ts) - window_us).alias("_from"))
    lists = cut(starts.groupBy(*keys).agg(F.collect_list(F.struct(SEG, "_from")).alias("_starts")))
    borrowed = F.transform(
        F.filter("_starts", lambda s: (s[SEG] > F.expr(f"`{frame}` div {rows}")) & (s["_from"] <= F.col(ts))), lambda s: s[SEG]
    )
    lent = df.join(F.broadcast(lists), list(keys)) if rows >= SLICE_ROWS else df.join(lists, list(keys))
    counts = lent.agg(F.sum(F.size(borrowed)).alias("n")).first()
    if (counts["n"] or 0) > df.count():
        return _sliding_mode(df, keys, frame, ts, zone, window_us, out, rows)
    return _segment_mode(df, lent.select(*df.columns, F.explode(borrowed).alias(SEG)), keys, frame, ts, zone, window_us, out, rows)


def _segment_mode(
    df: DataFrame, lent: DataFrame, keys: Sequence[str], frame: str, ts: str, zone: str, window_us: int, out: str, rows: int
) -> DataFrame:
    """One exchange: a segment's rows and those ``lent`` to it, walked in order."""
    wide = segment(df, frame, rows).select(*df.columns, SEG).unionByName(lent)
    dealt = wide.repartition(*within(keys)).sortWithinPartitions(*within(keys), frame)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in [*df.schema, T.StructField(out, df.schema[zone].dataType)]]
    return dealt.mapInArrow(_walk_votes(list(keys), frame, ts, zone, window_us, rows, out), ", ".join(columns))


def _walk_votes(keys: list[str], frame: str, ts: str, zone: str, window_us: int, rows: int, named: str) -> Callable:
    """Adds the most frequent zone of the window to rows sorted by segment and frame.

    Votes are counted in and out; a heap holds every (votes, last, zone) a zone has had, of which
    those that are no longer true are dropped when they come up, or when they are the most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, count, last, heap, votes = None, {}, {}, [], deque()
        for batch in batches:
            won = []
            columns = [batch.column(c).to_pylist() for c in (*keys, SEG, frame, ts, zone)]
            for *here, f, at, z in zip(*columns):
                if here != group:
                    group, count, last, heap, votes = here, {}, {}, [], deque()
                if z is None or None in here:
                    count, last, heap, votes = {}, {}, [], deque()
                    won.append(None)
                    continue
                while votes and votes[0][0] < at - window_us:
                    gone = votes.popleft()[1]
                    count[gone] -= 1
                    if count[gone]:
                        heappush(heap, (-count[gone], -last[gone], gone))
                    else:
                        del count[gone]
                votes.append((at, z))
                count[z], last[z] = count.get(z, 0) + 1, f
                heappush(heap, (-count[z], -f, z))
                while count.get(heap[0][2]) != -heap[0][0] or last[heap[0][2]] != -heap[0][1]:
                    heappop(heap)
                won.append(heap[0][2])
                if len(heap) > 4 * len(count) + 64:
                    heap = [(-n, -last[k], k) for k, n in count.items()]
                    heapify(heap)
                    last = {k: last[k] for k in count}
            own = pa.array([f // rows == s for f, s in zip(columns[-3], columns[-4])], pa.bool_())
            added = batch.append_column("_won", pa.array(won, batch.schema.field(zone).type))
            kept = added.drop_columns([SEG]).filter(own)
            if len(kept):
                yield kept.rename_columns([*kept.schema.names[:-1], named])

    return run


def _sliding_mode(
    df: DataFrame, keys: Sequence[str], frame: str, ts: str, zone: str, window_us: int, out: str, rows: int
) -> DataFrame:
    """The majority over any number of zones.

    Every move of a vote gives its zone a new standing (count, last vote) that lasts until the
    zone's next move. So a standing is an interval of moves, and the winner at a vote is the
    best standing that is open there: a sweep over moves with the standings in a heap, by spans
    of ``rows`` moves, which standings that outlast a span enter anew.
    """
    epochs = running_sum(df.select(*keys, frame, ts, zone), keys, frame, F.col(zone).isNull().cast("bigint"), "_epoch", rows)
    group = [*keys, "_epoch"]
    moves = _moves(epochs.where(F.col(zone).isNotNull()), ts, zone, window_us)
    # Numbered once and read by four scans.
    placed = cut(index_rows(moves, group, ["_at", "_move", frame], "_e", min(rows, SLICE_ROWS)).drop("_at", ts))
    by_zone = [*group, zone]
    base = segment(placed, "_e", rows)
    upto = scan(within(by_zone), "_e")
    delta, vote = F.when(F.col("_move") == 0, 1).otherwise(-1), F.when(F.col("_move") == 0, F.col(frame))
    local = base.withColumns(
        {
            "_n": F.sum(delta).over(upto),
            "_last": F.max(vote).over(upto),
            "_next": F.lead("_e").over(W.partitionBy(*within(by_zone)).orderBy("_e")),
        }
    )
    known = attach_carry(
        local,
        base,
        by_zone,
        {"_dn": F.sum(delta), "_dl": F.max(vote)},
        {"_pn": lambda s: F.sum("_dn").over(s), "_pl": lambda s: F.max("_dl").over(s)},
    )
    heads = {"_head": F.min("_e")}, {"_later": lambda s: F.min("_head").over(s)}
    known = attach_carry(known, base, by_zone, *heads, following=True).drop(SEG)
    end = F.coalesce(F.coalesce("_next", "_later") - 1, F.col("_e"))
    standing = known.select(
        *group,
        "_e",
        end.alias("_end"),
        (F.col("_n") + F.coalesce("_pn", F.lit(0))).alias("_n"),
        F.greatest("_last", "_pl").cast("bigint").alias("_last"),
        F.col(zone).alias("_zone"),
        F.when(F.col("_move") == 0, F.col(frame)).cast("bigint").alias("_vote"),
    )
    # Nothing stands open after a zone's last move, which takes its last vote away.
    standing = standing.withColumn("_span", F.explode(F.sequence(F.expr(f"_e div {rows}"), F.expr(f"_end div {rows}"))))
    standing = standing.withColumn("_vote", F.when(F.expr(f"_e div {rows} = _span"), F.col("_vote")))
    by = [*group, "_span"]
    dealt = standing.repartition(*by).sortWithinPartitions(*by, F.greatest(F.col("_e"), F.col("_span") * rows), "_e")
    names = [f"_k{i}" for i in range(len(keys))]
    fields = [f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys)]
    kind = df.schema[zone].dataType.simpleString()
    won = dealt.withColumnsRenamed(dict(zip(keys, names))).mapInArrow(_best_standing(len(keys)), ", ".join([*fields, "_f bigint", f"_z {kind}"]))
    same = F.col(frame) == F.col("_f")
    for k, n in zip(keys, names):
        same = same & (F.col(k) == F.col(n))
    return df.join(won, same, "left").select(*df.columns, F.col("_z").alias(out))


def _best_standing(n_keys: int) -> Callable:
    """Standings sorted by group, span and first move to (keys, frame, zone) of every vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heap = None, []
        for batch in batches:
            out, columns = [], [c.to_pylist() for c in batch.columns]
            for *names, epoch, move, end, n, last, zone, vote, span in zip(*columns):
                if (here := (*names, epoch, span)) != group:
                    group, heap = here, []
                if n:
                    heappush(heap, (-n, -last, end, zone))
                if vote is not None:
                    while heap[0][2] < move:
                        heappop(heap)
                    out.append((*names, vote, heap[0][3]))
            if out:
                schema = batch.schema
                kinds = [*(schema.field(i).type for i in range(n_keys)), pa.int64(), schema.field("_zone").type]
                labels = [*(schema.field(i).name for i in range(n_keys)), "_f", "_z"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=labels)

    return run


def streak_tier(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    ts: str,
    off_road: str,
    min_us: int,
    audible_us: int | None = None,
    out: str = "gaze_tier",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Tier by the time the flag has been true without a break: VISUAL, then AUDIBLE."""
    if min_us <= 0:
        raise ValueError(f"a streak of {min_us} microseconds says nothing")
    if audible_us is not None and audible_us < min_us:
        raise ValueError("audible comes no earlier than visual")
    off = F.coalesce(F.col(off_road), F.lit(False))
    base = segment(df.withColumn("_off", off), frame, rows)
    order = W.partitionBy(*within(keys)).orderBy(frame)
    upto = scan(within(keys), frame)
    # Inside the segment a streak begins on an off row that follows an on row (or nothing).
    begins = F.col("_off") & ~F.coalesce(F.lag("_off").over(order), F.lit(False))
    marked = base.withColumns(
        {
            "_began": F.last(F.when(begins, F.col(ts)), ignorenulls=True).over(upto),
            "_cut": F.max(~F.col("_off")).over(upto),
        }
    )
    known = marked.join(_open_streaks(marked, keys, frame), [*keys, SEG])
    start = F.when(F.col("_cut"), F.col("_began")).otherwise(F.coalesce("_carry", "_began"))
    elapsed = F.when(F.col("_off"), F.col(ts) - start)
    tier = F.when(elapsed >= min_us, VISUAL).otherwise(NONE)
    if audible_us is not None:
        tier = F.when(elapsed >= audible_us, AUDIBLE).otherwise(tier)
    return known.withColumn(out, tier).select(*df.columns, out)


def _open_streaks(marked: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """Start of the streak that is open when a segment begins (null for none).

    A segment leaves its last streak open; segments that never cut it prolong it.
    """
    tails = marked.groupBy(*keys, SEG).agg(
        F.max("_cut").cast("int").alias("_cuts"),
        F.max_by(F.when(F.col("_off"), F.col("_began")), F.col(frame)).alias("_open"),
    )
    upto_seg = scan(keys, SEG)
    grouped = tails.withColumn("_g", F.sum("_cuts").over(upto_seg))
    oldest = F.min("_open").over(scan([*keys, "_g"], SEG))
    left_open = grouped.withColumn("_left", F.when(F.col("_open").isNotNull(), oldest))
    return left_open.select(
        *keys, SEG, F.lag("_left").over(W.partitionBy(*keys).orderBy(SEG)).alias("_carry")
    )


# --- Distraction: cadence, exponential average, hold --------------------------------------


def cadenced_ema(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    probs: str,
    labels: Sequence[str],
    every_n: int = 5,
    alpha: float = 0.5,
    safe_label: str = SAFE_ACTIVITY,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Score every Nth frame, smooth the probabilities, hold them in between.

    Adds ``ran``, ``probabilities``, ``activity`` and ``distracted``. The frame counter
    also counts frames without an image (null ``probs``); those do not run.

    A run of samples maps the average before it to ``a p + b``. Segments are scanned with
    nothing before them, their (a, b) are composed over the session, and what a segment
    inherits fades with the samples since. Inside a segment the recursion is one scaled
    cumulative sum per class and block; blocks are long enough for what lies before the
    previous one to fall below 1e-200.
    """
    if every_n < 1:
        raise ValueError("the classifier runs every frame or less often")
    if not 0.0 < alpha <= 1.0:
        raise ValueError("a smoothing weight lies above 0 and up to 1")
    if safe_label not in labels:
        raise ValueError(f"{safe_label!r} is none of the activities")
    ran = ((F.col(frame) + 1) % every_n == 0) & F.col(probs).isNotNull()
    flagged = df.withColumn("ran", ran)
    if alpha == 1.0:
        held = hold_last(flagged, keys, frame, F.when(F.col("ran"), F.col(probs).cast("array<double>")), "_p", rows)
    else:
        held = _ema(flagged, keys, frame, probs, len(labels), alpha, rows)
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    uniform = F.array_repeat(F.lit(1.0 / len(labels)), len(labels))
    names = F.array(*[F.lit(x) for x in labels])
    return (
        held.withColumn("probabilities", F.coalesce("_p", uniform))
        .withColumn("activity", F.coalesce(F.get(names, best - 1), F.lit(safe_label)))
        .withColumn("distracted", F.col("activity") != safe_label)
        .drop("_p")
    )


def _ema(
    flagged: DataFrame, keys: Sequence[str], frame: str, probs: str, classes: int, alpha: float, rows: int
) -> DataFrame:
    """Adds ``_p``: the average after the last sample (``ran``), null before the first.

    The first sample counts in full, as if the average before it were that sample.
    """
    keep = 1.0 - alpha
    block = max(1, math.floor(math.log(1e-200) / math.log(keep)))
    fades = math.ceil(math.log(1e-20) / math.log(keep))
    every = range(classes)
    part = within(keys)
    w = W.partitionBy(*part).orderBy(frame)
    upto, earlier = scan(part, frame), w.rowsBetween(W.unboundedPreceding, -1)
    power = lambda n: F.pow(F.lit(keep), n.cast("double"))

    base = segment(flagged, frame, rows).withColumn("_x", F.when(F.col("ran"), F.col(probs).cast("array<double>")))
    scanned = base.withColumn("_c", F.count("_x").over(upto))
    scanned = scanned.withColumn("_block", F.greatest(F.floor((F.col("_c") - 1) / block), F.lit(0)))
    m = F.col("_c") - F.col("_block") * block
    inside = scan([*part, "_block"], frame)
    sums = [F.sum(F.get("_x", F.lit(k)) * alpha * power(-m)).over(inside) * power(m) for k in every]
    scanned = scanned.withColumn("_s", F.when(F.col("ran"), F.array(*sums)))
    full = F.last(F.when(m == block, F.col("_s")), ignorenulls=True).over(earlier)
    scanned = scanned.withColumn("_full", full)
    own = F.array(*[F.get("_s", F.lit(k)) + F.coalesce(F.get("_full", F.lit(k)), F.lit(0.0)) * power(m) for k in every])
    scanned = scanned.withColumn("_own", F.last(F.when(F.col("ran"), own), ignorenulls=True).over(upto))

    summary = scanned.groupBy(*part).agg(
        F.max("_c").alias("_n"),
        F.max_by("_own", frame).alias("_b"),
        F.min_by("_x", F.when(F.col("_x").isNotNull(), F.col(frame))).alias("_first"),
    )
    upto, earlier = scan(keys, SEG), W.partitionBy(*keys).orderBy(SEG).rowsBetween(W.unboundedPreceding, -1)
    summary = summary.withColumn("_upto", F.sum("_n").over(upto))
    # Segments without a sample change nothing; of the others at most `fades` matter.
    recent = W.partitionBy(*keys).orderBy("_upto").rangeBetween(-fades, 0)
    left = F.when(F.col("_n") > 0, F.struct(F.col("_upto").alias("at"), F.col("_b").alias("b")))
    summary = summary.withColumn("_left", F.collect_list(left).over(recent))

    def ended(k: int) -> Column:
        faded = lambda sum, x: sum + F.get(x["b"], F.lit(k)) * power(F.col("_upto") - x["at"])
        return F.aggregate("_left", F.lit(0.0), faded)

    summary = summary.withColumn("_end", F.when(F.col("_n") > 0, F.array(*[ended(k) for k in every])))
    summary = summary.withColumns(
        {
            "_before": F.col("_upto") - F.col("_n"),
            "_end": F.last("_end", ignorenulls=True).over(earlier),
            "_first": F.first("_first", ignorenulls=True).over(upto),
        }
    )
    inherited = [
        F.coalesce(F.get("_end", F.lit(k)), F.lit(0.0)) + F.get("_first", F.lit(k)) * power(F.col("_before")) for k in every
    ]
    carried = summary.select(*part, "_before", F.array(*inherited).alias("_carry"))
    known = scanned.join(carried, part)
    fresh = F.when(F.col("_block") == 0, power(F.col("_c"))).otherwise(0.0)
    smooth = [F.coalesce(F.get("_own", F.lit(k)), F.lit(0.0)) + F.get("_carry", F.lit(k)) * fresh for k in every]
    return known.select(*flagged.columns, F.when(F.col("_c") + F.col("_before") > 0, F.array(*smooth)).alias("_p"))


# --- Fusion ---------------------------------------------------------------------------------


def fuse_tiers(*tiers: str | Column) -> Column:
    """Most severe of the tracks; tracks that are null do not count."""
    if not tiers:
        return F.lit(NONE)
    columns = [F.col(t) if isinstance(t, str) else t for t in tiers]
    return F.coalesce(F.greatest(*columns, F.lit(NONE)), F.lit(NONE))


def parallel_tracks(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    face: str,
    level: str,
    distracted: str,
    params: tuple[int, int, int] = (3, 8, 15),
    distraction_params: tuple[int, int, int] | None = None,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Fatigue on face frames only (held in between), distraction on every frame.

    Adds ``fatigue_tier``, ``fatigue_level``, ``distraction_tier`` and the fused ``tier``.
    """
    tracks = [
        Track("_distraction", F.col(distracted).cast("int"), 1, distraction_params or params),
        Track("_fatigue", _fatigue_level(level), 2, params, F.coalesce(F.col(face), F.lit(False))),
    ]
    out = debounce_tracks(df, keys, frame, tracks, rows)
    return out.select(
        *df.columns,
        F.col("_distraction_tier").alias("distraction_tier"),
        F.col("_fatigue_tier").alias("fatigue_tier"),
        F.col("_fatigue_level").alias("fatigue_level"),
        fuse_tiers("_fatigue_tier", "_distraction_tier").alias("tier"),
    )


# --- Change events ------------------------------------------------------------------------


def change_events(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    tier: str = "tier",
    fatigue: str = "fatigue_level",
    face: str = "has_face",
    gaze: str = "gaze_zone",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Telemetry rows on every change: tier_change, gaze_change, face_lost, face_regained.

    Nothing is emitted on the first row. A missing zone holds the last known one.
    """
    base = segment(df.select(*keys, frame, tier, fatigue, face, gaze), frame, rows)
    w = W.partitionBy(*within(keys)).orderBy(frame)
    here = F.struct(F.col(tier).alias("tier"), F.col(face).alias("face"))
    zone = F.last(gaze, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    local = base.withColumns({"_was": F.lag(here).over(w), "_zone": zone})
    seen = attach_carry(
        local,
        base,
        keys,
        {"_tail": F.max_by(here, F.col(frame)), "_seen": F.max_by(gaze, F.when(F.col(gaze).isNotNull(), F.col(frame)))},
        {"_before": lambda s: F.last("_tail").over(s), "_known": lambda s: F.last("_seen", ignorenulls=True).over(s)},
    )
    was = F.coalesce("_was", "_before")
    seen = seen.withColumns({f"prev_{tier}": was["tier"], f"prev_{face}": was["face"], "_zone": F.coalesce("_zone", "_known")})
    no_text, no_int = F.lit(None).cast("string"), F.lit(None).cast("int")

    def event(kind: Column, was: Column, now: Column, fatigue_now: Column) -> Column:
        return F.struct(
            kind.alias("event"),
            was.cast("string").alias("from"),
            now.cast("string").alias("to"),
            fatigue_now.cast("int").alias("fatigue"),
        )

    rises = F.col(tier) != F.col(f"prev_{tier}")
    moves = F.col(gaze) != F.col("_zone")
    flips = F.col(face) != F.col(f"prev_{face}")
    events = F.array(
        F.when(rises, event(F.lit("tier_change"), F.col(f"prev_{tier}"), F.col(tier), F.col(fatigue))),
        F.when(moves, event(F.lit("gaze_change"), F.col("_zone"), F.col(gaze), no_int)),
        F.when(
            flips,
            event(
                F.when(F.col(face), F.lit("face_regained")).otherwise(F.lit("face_lost")),
                no_text,
                no_text,
                no_int,
            ),
        ),
    )
    return seen.select(*keys, frame, F.explode(F.array_compact(events)).alias("e")).select(
        *keys, frame, "e.*"
    )
