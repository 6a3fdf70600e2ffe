"""Live monitor as a keyed stateful stream.

Frames of a session arrive out of order within the watermark. They wait in keyed state, in
blocks of columns, until the watermark has passed them and are put in (ts, frame) order. Those
that are due at a timer are taken column by column, a stretch of frames at a time: rolling
windows and classifier, debounced fatigue track, cadenced distraction track, voted gaze zones
and off-road streaks, fusion, changes between rows and metrics intervals. A session that falls
silent is flushed, reported as stopped and forgotten.

A state key is a shard: the sessions of one hash. State calls, timers and tables that go to and
from Python cost by the shard; every session keeps its own clock and its own memory.

State per session is bounded: the window, one second of gaze votes, one metrics interval of
latencies and the frames newer than the watermark.
"""

from __future__ import annotations

import sys
import time
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wakeline.schemas import (
    ACTIVITIES,
    FEATURE_COLUMNS,
    LIVE_PARAMS,
    ON_ROAD_ZONE,
    SAFE_ACTIVITY,
    TIER_NAMES,
)

INPUT = T.StructType(
    [
        T.StructField("session", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("frame", T.LongType()),
        T.StructField("has_face", T.BooleanType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
        T.StructField("probabilities", T.ArrayType(T.DoubleType())),
        T.StructField("zone", T.StringType()),
        T.StructField("latency_s", T.DoubleType()),
    ]
)

OUTPUT = T.StructType(
    [
        T.StructField("session", T.StringType()),
        T.StructField("frame", T.LongType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("event", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("fatigue", T.IntegerType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("fatigue_tier", T.IntegerType()),
        T.StructField("distraction_tier", T.IntegerType()),
        T.StructField("gaze_tier", T.IntegerType()),
        T.StructField("activity", T.StringType()),
        T.StructField("gaze_zone", T.StringType()),
        T.StructField("frames", T.LongType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("lat_ms_p50", T.DoubleType()),
        T.StructField("lat_ms_p95", T.DoubleType()),
        T.StructField("face_rate", T.DoubleType()),
    ]
)

#: Columns of waiting frames; ``us`` is the time in microseconds.
WAITING = pa.schema(
    [
        ("us", pa.int64()),
        ("frame", pa.int64()),
        ("has_face", pa.bool_()),
        ("features", pa.list_(pa.float64())),
        ("probabilities", pa.list_(pa.float64())),
        ("zone", pa.string()),
        ("latency_s", pa.float64()),
    ]
)
#: Waiting frames of a shard; ``fires`` is the time whose passing makes a frame's session act.
SHARED = pa.schema([("session", pa.string()), ("fires", pa.int64()), *WAITING])
#: Waiting frames in one block of state, sessions in one, and frames that are taken at once.
BLOCK = 10_000
SESSIONS = 256
STRETCH = 1 << 16
#: State keys that sessions are dealt to.
SHARDS = 1024


@dataclass(frozen=True)
class MonitorConfig:
    """Parameters of the live monitor; ``classify`` maps a (window, features) array to a level."""

    classify: Callable[[np.ndarray], int]
    window: int = 150
    fatigue: tuple[int, int, int] = LIVE_PARAMS
    distraction: tuple[int, int, int] | None = LIVE_PARAMS
    every_n: int = 5
    alpha: float = 0.5
    labels: Sequence[str] = ACTIVITIES
    safe_label: str = SAFE_ACTIVITY
    gaze_min_s: float | None = 2.0
    gaze_audible_s: float | None = 4.0
    gaze_vote_s: float = 1.0
    metrics_s: float = 5.0
    idle_s: float = 60.0
    emit_frames: bool = True

    def __post_init__(self) -> None:
        if min(self.fatigue) <= 0 or (self.distraction and min(self.distraction) <= 0):
            raise ValueError("steps of a track count from one")
        if self.window <= 0:
            raise ValueError("a window holds at least one frame")
        if self.every_n < 1 or not 0.0 < self.alpha <= 1.0:
            raise ValueError("the cadence counts from one and the weight lies above 0 and up to 1")
        if self.safe_label not in self.labels:
            raise ValueError(f"{self.safe_label!r} is none of the activities")
        if self.gaze_min_s is not None:
            if self.gaze_min_s <= 0 or self.gaze_vote_s <= 0:
                raise ValueError("gaze times are longer than nothing")
            if self.gaze_audible_s is not None and self.gaze_audible_s < self.gaze_min_s:
                raise ValueError("audible comes no earlier than visual")


@dataclass
class Debounce:
    """Committed level, run of the current level, steps at the top level."""

    committed: int = 0
    level: int = -1
    run: int = 0
    held: int = 0

    def tier(self, top: int, after: int) -> int:
        return self.committed + (self.committed == top and self.held >= after)


@dataclass
class Session:
    """Everything a session remembers between timers."""

    window: list = field(default_factory=list)
    level: int = 0
    fatigue: list = field(default_factory=lambda: [0, -1, 0, 0])
    binary: list = field(default_factory=lambda: [0, -1, 0, 0])
    seen: int = 0
    probs: list | None = None
    vote_ts: list = field(default_factory=list)
    vote_zone: list = field(default_factory=list)
    off_since: float | None = None
    tier: int | None = None
    face: bool | None = None
    zone: str | None = None
    since: float | None = None
    latencies: list = field(default_factory=list)
    faces: int = 0
    last_ts: float = 0.0
    last_frame: int = -1


_NUMBERS = pa.list_(pa.float64())
STATE = pa.schema(
    [
        ("window", pa.list_(_NUMBERS)),
        ("level", pa.int32()),
        ("fatigue", pa.list_(pa.int64())),
        ("binary", pa.list_(pa.int64())),
        ("seen", pa.int64()),
        ("probs", _NUMBERS),
        ("vote_ts", _NUMBERS),
        ("vote_zone", pa.list_(pa.string())),
        ("off_since", pa.float64()),
        ("tier", pa.int32()),
        ("face", pa.bool_()),
        ("zone", pa.string()),
        ("since", pa.float64()),
        ("latencies", _NUMBERS),
        ("faces", pa.int64()),
        ("last_ts", pa.float64()),
        ("last_frame", pa.int64()),
    ]
)
#: Sessions of a shard; a session without waiting frames acts when ``fires`` has passed.
KNOWN = pa.schema([("session", pa.string()), ("fires", pa.int64()), *STATE])


def debounced(levels: Sequence[int], state: list, steps: tuple[int, int, int], top: int) -> tuple[np.ndarray, list]:
    """Tiers of a level series and the track's state after it; a run commits once at most."""
    levels, track = np.asarray(levels, np.int64), Debounce(*state)
    n = len(levels)
    if not n:
        return levels, state
    committed = np.empty(n, np.int64)
    starts = np.flatnonzero(np.append(True, levels[1:] != levels[:-1]))
    for lo, hi, level in zip(starts.tolist(), [*starts[1:].tolist(), n], levels[starts].tolist()):
        before, at = track.run if level == track.level else 0, hi
        if level != track.committed:
            at = min(lo + max((steps[0] if level > track.committed else steps[1]) - before, 1) - 1, hi)
        committed[lo:at] = track.committed
        if at < hi:
            committed[at:hi] = track.committed = level
        track.level, track.run = level, before + hi - lo
    full, place = committed == top, np.arange(n)
    below = np.maximum.accumulate(np.where(full, -1, place))
    held = np.where(full, place - below + np.where(below < 0, track.held, 0), 0)
    return committed + (full & (held >= steps[2])), [track.committed, track.level, track.run, int(held[-1])]


def fatigue_levels(s: Session, c: MonitorConfig, features: np.ndarray) -> np.ndarray:
    """Level at every face frame: the class of the last full window, the last one before."""
    n = len(features)
    if not n:
        return np.zeros(0, np.int64)
    rows = np.concatenate((np.asarray(s.window, float), features)) if s.window else features
    s.window = rows[-c.window :].tolist()
    early = max(n - max(len(rows) - c.window + 1, 0), 0)
    levels = np.full(n, s.level, np.int64)
    if len(rows) >= c.window:
        views = np.lib.stride_tricks.sliding_window_view(rows, c.window, axis=0)
        levels[early:] = [int(c.classify(v.T)) for v in views[len(views) - (n - early) :]]
    if ((levels < 0) | (levels > 2)).any():
        raise ValueError("the classifier gave a level other than 0, 1 and 2")
    s.level = int(levels[-1])
    return levels


def activities(s: Session, c: MonitorConfig, probabilities: pa.Array) -> np.ndarray:
    """Activity at every frame: the largest smoothed probability, renewed every n-th frame."""
    n = len(probabilities)
    turns = np.flatnonzero((s.seen + 1 + np.arange(n)) % c.every_n == 0)
    s.seen += n
    probs = None if s.probs is None else np.asarray(s.probs)
    names, renewed = [c.safe_label if probs is None else c.labels[int(np.argmax(probs))]], np.zeros(n, np.int64)
    for i, p in zip(turns.tolist(), probabilities.take(pa.array(turns)).to_pylist()):
        if p is not None:
            fresh = np.asarray(p, dtype=float)
            probs = fresh if probs is None else c.alpha * fresh + (1 - c.alpha) * probs
            names.append(c.labels[int(np.argmax(probs))])
            renewed[i] = 1
    s.probs = None if probs is None else probs.tolist()
    return np.array(names, object)[np.cumsum(renewed)]


def voted_zones(ts: np.ndarray, zones: np.ndarray, seconds: float) -> np.ndarray:
    """Most frequent zone among those of the last ``seconds``, bounds included, at every row.

    A missing zone starts the history anew; of zones with equal votes the one seen last wins.
    """
    n = len(ts)
    if not n:
        return zones
    names = sorted({z for z in zones if z is not None})
    number = {name: i for i, name in enumerate(names)}
    which = np.array([number.get(z, -1) for z in zones])
    gone, cast = which < 0, which[:, None] == np.arange(len(names))
    place = np.arange(n)
    fresh = np.maximum.accumulate(np.where(gone, place + 1, 0))
    start = np.maximum(np.searchsorted(ts, ts - seconds, side="left"), fresh)
    total = np.vstack((np.zeros((1, len(names)), np.int64), np.cumsum(cast, axis=0)))
    votes = total[1:] - total[np.minimum(start, place + 1)]
    latest = np.maximum.accumulate(np.where(cast, place[:, None], -1), axis=0)
    score = np.where(votes > 0, votes * (n + 1) + latest, -1)
    best = score.argmax(axis=1) if names else np.zeros(n, int)
    return np.array([None if g else names[b] for g, b in zip(gone, best)], object)


def off_road_tiers(s: Session, c: MonitorConfig, ts: np.ndarray, zones: np.ndarray) -> np.ndarray:
    """Tier by the time since the gaze left the road for good, which the session carries on."""
    off = np.array([z is not None and z != ON_ROAD_ZONE for z in zones], bool)
    place = np.arange(len(ts))
    broken = np.maximum.accumulate(np.where(off, -1, place))
    carried = ts[0] if s.off_since is None else s.off_since
    began = np.where(broken < 0, carried, ts[np.minimum(broken + 1, len(ts) - 1)])
    away = np.where(off, ts - began, -np.inf)
    s.off_since = float(began[-1]) if off[-1] else None
    audible = np.inf if c.gaze_audible_s is None else c.gaze_audible_s
    return (away >= c.gaze_min_s).astype(int) + (away >= audible)


def metrics_event(s: Session, latencies: Sequence[float], faces: int, now: float) -> dict:
    """Throughput record of the interval that ends now; the next one begins here."""
    spent = now - s.since if s.since is not None else 0.0
    n = len(latencies)
    halves = np.percentile(np.asarray(latencies) * 1000.0, [50, 95]) if n else np.zeros(2)
    s.since, s.latencies, s.faces = now, [], 0
    return {
        "event": "metrics",
        "frames": n,
        "fps": n / spent if spent > 0 else 0.0,
        "lat_ms_p50": float(halves[0]),
        "lat_ms_p95": float(halves[1]),
        "face_rate": faces / n if n else 0.0,
    }


def _interval_ends(s: Session, c: MonitorConfig, ts: np.ndarray) -> list[int]:
    """Rows at which a metrics interval is full."""
    times, ends, since, at = ts.tolist(), [], s.since, 0
    while at < len(times):
        full = at
        if times[at] - since < c.metrics_s:
            full = bisect_left(times, c.metrics_s, at, key=lambda t: t - since)
        if full < len(times):
            ends.append(full)
            since = times[full]
        at = full + 1
    return ends


def _percentiles(values: np.ndarray, sizes: np.ndarray, share: float) -> np.ndarray:
    """Interpolated percentile of each of the stretches that ``values``, sorted in each, consist of."""
    first = np.cumsum(sizes) - sizes
    at = (sizes - 1) * share
    low = np.floor(at).astype(np.int64)
    a, b = values[first + low], values[first + np.minimum(low + 1, sizes - 1)]
    part = at - low
    out = np.where(part >= 0.5, b - (b - a) * (1 - part), a + (b - a) * part)
    return np.where(np.isnan(values[first + sizes - 1]), np.nan, out)


def full_intervals(s: Session, c: MonitorConfig, ts: np.ndarray, face: np.ndarray, latency: np.ndarray) -> tuple[list[int], dict]:
    """Rows that end a metrics interval and the columns of its record; the session keeps the rest."""
    ends = _interval_ends(s, c, ts)
    done = ends[-1] + 1 if ends else 0
    rest = [] if ends else s.latencies
    if not ends:
        s.latencies, s.faces = [*rest, *latency.tolist()], s.faces + int(face.sum())
        return ends, {}
    values = np.concatenate((np.asarray(s.latencies, float), latency[:done])) * 1000.0
    sizes = np.diff(ends, prepend=-1)
    sizes[0] += len(s.latencies)
    values = values[np.lexsort((values, np.repeat(np.arange(len(ends)), sizes)))]
    faces = np.diff(np.cumsum(face)[ends], prepend=0)
    faces[0] += s.faces
    spent = np.diff(ts[ends], prepend=s.since)
    s.since, s.latencies, s.faces = float(ts[done - 1]), latency[done:].tolist(), int(face[done:].sum())
    return ends, {
        "frames": sizes,
        "fps": np.divide(sizes, spent, out=np.zeros(len(ends)), where=spent > 0),
        "lat_ms_p50": _percentiles(values, sizes, 0.5),
        "lat_ms_p95": _percentiles(values, sizes, 0.95),
        "face_rate": faces / sizes,
    }


def advance(s: Session, c: MonitorConfig, rows: pa.RecordBatch) -> pd.DataFrame:
    """Take ``WAITING`` frames in order; the frame states and events they cause, in order too."""
    return _event_rows(_placed(_changes(s, c, rows), rows))


def advance_sessions(sessions: Sequence[tuple[str | None, Session, int]], c: MonitorConfig, rows: pa.RecordBatch) -> pd.DataFrame:
    """What ``advance`` gives for sessions, (name, session, frames), whose frames follow each other."""
    base, kinds = 0, {}
    bases, names = [], np.array([name for name, *_ in sessions], object)
    for _, s, n in sessions:
        for event, at, of in _changes(s, c, rows.slice(base, n)):
            if len(at):
                kinds.setdefault(event, []).append((at + base, of))
        bases.append(base)
        base += n
    found = []
    for event, parts in kinds.items():
        at = np.concatenate([at for at, _ in parts])
        of = {k: np.concatenate([of[k] for _, of in parts]) for k in parts[0][1]}
        found.append((event, at, {"session": names[np.searchsorted(bases, at, side="right") - 1], **of}))
    # Events at a row come in the order they have within a session.
    found.sort(key=lambda kind: KINDS.index(kind[0]))
    return _event_rows(_placed(found, rows))


def _seconds(us: np.ndarray) -> np.ndarray:
    return us // 1_000_000 + us % 1_000_000 / 1e6


def _placed(found: Sequence[tuple[str, np.ndarray, dict]], rows: pa.RecordBatch) -> list[tuple[str, dict, np.ndarray]]:
    """Events with the number and the time of their frames."""
    frames, ts = rows["frame"].to_numpy(), _seconds(rows["us"].to_numpy())
    return [(event, {"frame": frames[at], "ts": ts[at], **of}, at) for event, at, of in found]


def _changes(s: Session, c: MonitorConfig, rows: pa.RecordBatch) -> list[tuple[str, np.ndarray, dict]]:
    """Frame states and events of one session: kind, rows and columns of each kind."""
    ts = _seconds(rows["us"].to_numpy())
    face = rows["has_face"].fill_null(False).to_numpy(zero_copy_only=False)
    n = len(ts)
    if s.since is None:
        s.since = float(ts[0])

    # Tracks: fatigue moves on face frames and is held between them.
    held = np.maximum.accumulate(np.where(face, np.cumsum(face), 0))
    before = (Debounce(*s.fatigue).tier(2, c.fatigue[2]), s.level)
    levels = fatigue_levels(s, c, _matrix(rows["features"].filter(pa.array(face))))
    tiers, s.fatigue = debounced(levels, s.fatigue, c.fatigue, 2)
    state = {"fatigue_tier": np.append(before[0], tiers)[held], "fatigue": np.append(before[1], levels)[held]}
    if c.distraction is not None:
        doing = activities(s, c, rows["probabilities"])
        tiers, s.binary = debounced(doing != c.safe_label, s.binary, c.distraction, 1)
        state |= {"activity": doing, "distraction_tier": tiers}
    zones = np.full(n, None, object)
    if c.gaze_min_s is not None:
        known = np.where(face, rows["zone"].to_numpy(zero_copy_only=False), None)
        all_ts = np.concatenate((np.array(s.vote_ts, float), ts))
        all_zones = np.concatenate((np.array(s.vote_zone, object), known))
        zones = voted_zones(all_ts, all_zones, c.gaze_vote_s)[len(s.vote_ts) :]
        state |= {"gaze_zone": zones, "gaze_tier": off_road_tiers(s, c, ts, zones)}
        missing = np.flatnonzero(np.equal(all_zones, None))
        keep = all_ts >= ts[-1] - c.gaze_vote_s
        keep[: missing[-1] + 1 if len(missing) else 0] = False
        s.vote_ts, s.vote_zone = all_ts[keep].tolist(), all_zones[keep].tolist()
    tier = state["tier"] = np.max([v for k, v in state.items() if k.endswith("_tier")], axis=0)

    # Changes: every column against the same column one row (for zones: one known zone) earlier.
    found = [("frame", np.arange(n), state)] if c.emit_frames else []
    was = np.append(tier[0] if s.tier is None else s.tier, tier[:-1])
    at = np.flatnonzero(was != tier)
    names = np.array(TIER_NAMES, object)
    found.append(("tier_change", at, {"from": names[was[at]], "to": names[tier[at]], "fatigue": state["fatigue"][at]}))
    seen = np.flatnonzero(np.not_equal(zones, None))
    shown = np.append(np.array([s.zone], object), zones[seen])
    at = np.flatnonzero(np.not_equal(shown[:-1], None) & (shown[1:] != shown[:-1]))
    found.append(("gaze_change", seen[at], {"from": shown[at], "to": shown[at + 1]}))
    turned = face != np.append(face[0] if s.face is None else s.face, face[:-1])
    found += [("face_lost", np.flatnonzero(turned & ~face), {}), ("face_regained", np.flatnonzero(turned & face), {})]
    # Metrics: rows up to the end of an interval belong to it.
    ends, records = full_intervals(s, c, ts, face, rows["latency_s"].to_numpy(zero_copy_only=False))
    found.append(("metrics", np.array(ends, np.int64), records))
    s.tier, s.face, s.zone = int(tier[-1]), bool(face[-1]), shown[-1]
    s.last_ts, s.last_frame = float(ts[-1]), rows["frame"][-1].as_py()
    return found


#: Order of the events that one frame causes.
KINDS = ("frame", "tier_change", "gaze_change", "face_lost", "face_regained", "metrics")


def _event_rows(found: Sequence[tuple[str, dict, np.ndarray]]) -> pd.DataFrame:
    """Events of several kinds, (kind, columns, rows), as ``OUTPUT`` rows in the order of their rows."""
    if not found:
        return pd.DataFrame(columns=OUTPUT.names)
    sizes = [len(at) for _, _, at in found]
    order = np.argsort(np.concatenate([at for *_, at in found]), kind="stable")
    out = {}
    for f in OUTPUT.fields:
        if f.name == "event":
            values = np.repeat(np.array([event for event, *_ in found], object), sizes)
            out[f.name] = values[order]
            continue
        parts = [of.get(f.name) for _, of, _ in found]
        whole, text = isinstance(f.dataType, (T.IntegerType, T.LongType)), isinstance(f.dataType, T.StringType)
        gap, kind = (None, object) if text else (0, np.int64) if whole else (np.nan, float)
        values = np.concatenate([np.full(n, gap, kind) if p is None else np.asarray(p, kind) for p, n in zip(parts, sizes)])[order]
        if whole:
            unset = np.repeat([p is None for p in parts], sizes)[order]
            values = pd.arrays.IntegerArray(values, unset)
        out[f.name] = values
    return pd.DataFrame(out)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of an array."""
    if lists.null_count or len(lengths := lists.value_lengths().unique()) > 1:
        raise ValueError("every frame with a face has the same number of features")
    width = lengths[0].as_py() if len(lengths) else 0
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


class MonitorProcessor(StatefulProcessor):
    """Sessions of a shard. Each acts by itself, when the watermark has passed its oldest waiting
    frame or, while none waits, the time at which it counts as stopped."""

    def __init__(self, config: MonitorConfig) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A value for each block, which sort by arrival.
        self.known = handle.getMapState("known", "part string", "sessions binary")
        self.pending = handle.getMapState("pending", "arrived string", "frames binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        soon, first = timerValues.getCurrentWatermarkInMs() + 1, None
        for batch in rows:
            if len(batch):
                block = _columns(batch, soon)
                _put(self.pending, block)
                oldest = int(block["fires"].to_numpy().min())
                first = oldest if first is None else min(first, oldest)
        if first is not None:
            # Fires as soon as the watermark has passed the oldest waiting frame.
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        known = {row.pop("session"): row for row in _get(self.known, KNOWN).to_pylist()}
        waiting = _get(self.pending, SHARED)
        us, fires = waiting["us"].to_numpy(), waiting["fires"].to_numpy()
        coded = waiting["session"].dictionary_encode(null_encoding="encode")
        code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        earliest = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(earliest, code, fires)
        idle = [known[name]["fires"] if name in known else None for name in names]
        acts = (earliest <= upto) | np.array([t is not None and t <= upto for t in idle], bool)
        due = acts[code] & (us // 1000 <= upto)
        later = np.bincount(code[~due], minlength=len(names))

        order = np.lexsort((waiting["frame"].to_numpy(), us, code))
        order = order[due[order]]
        acting = {names[i]: int(later[i]) for i in np.flatnonzero(acts)}
        acting |= {name: 0 for name, row in known.items() if row["fires"] is not None and row["fires"] <= upto and name not in acting}
        sessions = {name: _session(known[name]) if name in known else Session() for name in acting}
        for lo in range(0, len(order), STRETCH):
            taken = order[lo : lo + STRETCH]
            whose, starts = np.unique(code[taken], return_index=True)
            sizes = np.diff(starts, append=len(taken))
            parts = [(names[i], sessions[names[i]], int(n)) for i, n in zip(whose, sizes)]
            out = advance_sessions(parts, self.config, waiting.take(pa.array(taken)))
            if len(out):
                yield out

        idle_ms, ended = int(self.config.idle_s * 1000), []
        for name, n_later in acting.items():
            s = sessions[name]
            if not n_later and s.last_frame >= 0 and upto >= s.last_ts * 1000 + idle_ms:
                end = {"session": name, "frame": s.last_frame, "ts": s.last_ts}
                ended += [{**end, **metrics_event(s, s.latencies, s.faces, s.last_ts)}, {**end, "event": "stop"}]
                known.pop(name, None)
            else:
                known[name] = {"fires": None if n_later else int(s.last_ts * 1000) + idle_ms, **dict(zip(STATE.names, _values(s)))}
        for lo in range(0, len(ended), STRETCH):
            columns = {f.name: [event.get(f.name) for event in ended[lo : lo + STRETCH]] for f in OUTPUT.fields}
            yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in columns.items()})

        rest = np.flatnonzero(~due)
        if len(order):
            self.pending.clear()
            for lo in range(0, len(rest), BLOCK):
                _put(self.pending, waiting.take(pa.array(rest[lo : lo + BLOCK])))
        if acting:
            self.known.clear()
            rows = [{"session": name, **row} for name, row in known.items()]
            for lo in range(0, len(rows), SESSIONS):
                _put(self.known, pa.RecordBatch.from_pylist(rows[lo : lo + SESSIONS], KNOWN))
        clocks = [row["fires"] for row in known.values() if row["fires"] is not None]
        if len(rest):
            clocks.append(int(fires[rest].min()))
        if clocks:
            # The timer that fired is dropped after this.
            self.handle.registerTimer(max(min(clocks), upto + 1))

    def close(self) -> None:
        pass


def _put(state, rows: pa.RecordBatch) -> None:
    """Add a block of columns to a map state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    state.updateValue((f"{time.time_ns():020d}-{uuid.uuid4().hex}",), (sink.getvalue().to_pybytes(),))


def _get(state, schema: pa.Schema) -> pa.RecordBatch:
    """All blocks of a map state, in the order they were added."""
    blocks = sorted((k, bytes(v)) for (k,), (v,) in state.iterator())
    found = [batch for _, block in blocks for batch in pa.ipc.open_stream(block)]
    return pa.concat_batches(found) if found else pa.RecordBatch.from_pylist([], schema)


def _values(s: Session) -> tuple:
    return tuple(getattr(s, name) for name in STATE.names)


def _session(row: dict) -> Session:
    return Session(**{name: row[name] for name in STATE.names})


def _columns(batch: pd.DataFrame, soon: int) -> pa.RecordBatch:
    """Input rows as ``SHARED`` columns, firing from ``soon`` on; every frame has a time and a number."""
    columns = {f.name: pa.Array.from_pandas(batch[f.name], type=f.type) for f in SHARED if f.name != "fires"}
    if columns["us"].null_count or columns["frame"].null_count:
        raise ValueError("a frame has no time or no number")
    columns["fires"] = pa.array(np.maximum(columns["us"].to_numpy() // 1000, soon))
    return pa.RecordBatch.from_arrays([columns[name] for name in SHARED.names], schema=SHARED)


def monitor_stream(frames: DataFrame, config: MonitorConfig, delay: str = "10 seconds", shards: int = SHARDS) -> DataFrame:
    """Events and frame states of every session of a stream with the ``INPUT`` columns.

    Frames later than the watermark delay are dropped and counted by Spark. Sessions are dealt to
    ``shards`` state keys, a number that a checkpoint is bound to.
    """
    if shards < 1:
        raise ValueError("there is at least one shard")
    # Executors get the processor by value, so they need not have this package installed.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    wanted = frames.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INPUT.fields])
    return (
        wanted.withWatermark("ts", delay)
        .withColumn("us", F.unix_micros("ts"))
        .withColumn("shard", F.pmod(F.xxhash64("session"), F.lit(shards)))
        .groupBy("shard")
        .transformWithStateInPandas(
            statefulProcessor=MonitorProcessor(config),
            outputStructType=OUTPUT,
            outputMode="append",
            timeMode="eventTime",
        )
    )


def feature_array(columns: Sequence[str] = FEATURE_COLUMNS):
    return F.array(*[F.col(c).cast("double") for c in columns])
