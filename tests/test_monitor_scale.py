"""The monitor's cost per frame does not depend on how many are due at once."""

import datetime as dt
import tempfile
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from wakeline.streaming import metrics as live
from wakeline.streaming import monitor


def frames(n, gap_us, seed=1):
    rng = np.random.default_rng(seed)
    us = 1_700_000_000_000_000 + np.cumsum(rng.integers(gap_us // 2, gap_us * 2, n))
    face = rng.random(n) < 0.9
    zone = np.where(rng.random(n) < 0.8, rng.choice(np.array(["front", "left", "right"], object), n), None)
    columns = [us, np.arange(n), face, [[x] if f else None for x, f in zip(rng.random(n), face)],
               [list(rng.random(3)) if rng.random() < 0.9 else None for _ in range(n)], zone, rng.random(n) / 20]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, monitor.WAITING)], schema=monitor.WAITING)


def config(**more):
    return monitor.MonitorConfig(
        classify=lambda w: 2 if w[:, 0].mean() > 0.6 else 1 if w[:, 0].mean() > 0.5 else 0, window=7, fatigue=(2, 4, 5),
        distraction=(2, 3, 4), every_n=3, labels=["drinking", "safe_drive", "radio"], **more,
    )


def test_full_intervals_are_found_in_one_pass():
    s = monitor.Session(since=0.0)
    ts = 10.0 * np.arange(1, 500_001)
    began = time.monotonic()
    assert monitor._interval_ends(s, config(), ts) == list(range(len(ts)))
    assert time.monotonic() - began < 20


@pytest.mark.parametrize("stretch", [1, 13, 500])
def test_stretches_give_what_all_frames_at_once_give(stretch):
    rows, c = frames(2000, 300_000), config()
    s, parts = monitor.Session(), monitor.Session()
    want = monitor.advance(s, c, rows)
    got = [monitor.advance(parts, c, rows.slice(i, stretch)) for i in range(0, len(rows), stretch)]
    clean = lambda x: [tuple(None if str(v) in ("<NA>", "nan", "None") else v for v in r) for r in x]
    assert clean(t for g in got for t in g.astype(object).itertuples(index=False)) == clean(want.astype(object).itertuples(index=False))
    assert monitor._values(parts) == monitor._values(s)


def test_tracks_follow_every_step():
    rng = np.random.default_rng(5)
    for steps in ((1, 1, 1), (2, 4, 3), (5, 2, 6)):
        levels = np.repeat(rng.integers(0, 3, 120), rng.integers(1, 9, 120))
        committed, last, run, held, want = 0, -1, 0, 0, []
        for level in levels:
            run, last = run + 1 if level == last else 1, level
            if level != committed and run >= (steps[0] if level > committed else steps[1]):
                committed = level
            held = held + 1 if committed == 2 else 0
            want.append(committed + (committed == 2 and held >= steps[2]))
        state, got = [0, -1, 0, 0], []
        for part in np.split(levels, [50, 51, 200]):
            tiers, state = monitor.debounced(part, state, steps, 2)
            got += tiers.tolist()
        assert got == want and state == [committed, last, run, held]


def test_percentiles_are_numpys():
    rng = np.random.default_rng(2)
    values = [rng.random(n) * 40 for n in (1, 2, 3, 10, 57)]
    values[3][4] = np.nan
    sizes = np.array([len(v) for v in values])
    for share in (0.5, 0.95):
        got = monitor._percentiles(np.concatenate([np.sort(v) for v in values]), sizes, share)
        np.testing.assert_array_equal(got, [np.percentile(v, share * 100) for v in values])


def many(n_sessions, per):
    """Frames of sessions in turn, one of them without a name, as ``INPUT`` rows by time."""
    names = [None, *(f"s{i}" for i in range(1, n_sessions))]
    rows = []
    for i, name in enumerate(names):
        # Gaps stay under the idle time; sessions end one after the other.
        for f in frames(per + i % 3, 300_000, seed=i).to_pylist():
            at = dt.datetime.fromtimestamp(f.pop("us") // 1000 / 1000 + i % 7, dt.UTC)
            rows.append((name, at, *f.values()))
    return sorted(rows, key=lambda r: (r[1], r[2]))


def clean(row):
    return tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in row)


def alone(rows, c):
    """Events of every session by itself."""
    want = []
    for name in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2]))
        columns = [[round(r[1].timestamp() * 1000) * 1000 for r in mine], *([r[i] for r in mine] for i in range(2, 8))]
        batch = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, monitor.WAITING)], schema=monitor.WAITING)
        s = monitor.Session()
        out = monitor.advance(s, c, batch).astype(object)
        out = out.where(out.notna(), None).to_dict("records")
        end = {"frame": s.last_frame, "ts": s.last_ts}
        out += [{**end, **monitor.metrics_event(s, s.latencies, s.faces, s.last_ts)}, {**end, "event": "stop"}]
        want += [clean({**e, "session": name}.get(f.name) for f in monitor.OUTPUT) for e in out]
    return want


class Blocks(dict):
    def __init__(self, calls):
        self.calls = calls

    def updateValue(self, key, value):
        self.calls.append("update")
        self[key] = value

    def iterator(self):
        self.calls.append("read")
        return iter(list(self.items()))

    def clear(self):
        self.calls.append("clear")
        super().clear()


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getMapState(self, *_):
        return Blocks(self.calls)

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


@pytest.mark.parametrize("stretch", [7, 1 << 16])
def test_sessions_of_a_shard_share_state_calls(monkeypatch, stretch):
    monkeypatch.setattr(monitor, "STRETCH", stretch)
    rows, c, handle = many(200, 6), config(idle_s=30.0), Handle()
    taker = monitor.MonitorProcessor(c)
    taker.init(handle)
    table = pd.DataFrame(rows, columns=[f.name for f in monitor.INPUT])
    table["us"] = [round(r[1].timestamp() * 1000) * 1000 for r in rows]
    out, upto = [], 0
    for part in np.array_split(np.arange(len(table)), 4):
        out += taker.handleInputRows((1,), iter([table.iloc[part].sample(frac=1, random_state=1)]), Clock(upto))
        upto = int(table["us"].iloc[part[-1]]) // 1000
        assert min(handle.timers) <= upto
        handle.timers.clear()
        out += taker.handleExpiredTimer((1,), Clock(upto), None)
        assert all(t > upto for t in handle.timers)
    out += taker.handleExpiredTimer((1,), Clock(upto + 40_000), None)
    assert not taker.known and not taker.pending
    got = [clean(r) for part in out for r in part.astype(object).where(part.notna(), None).itertuples(index=False)]
    assert sorted(map(str, got)) == sorted(map(str, alone(rows, c)))
    assert len(handle.calls) < 60  # Of 200 sessions, five times.


def test_stream_of_sessions_in_few_shards(spark):
    rows, c = many(40, 6), config(idle_s=30.0)
    folder = tempfile.mkdtemp(prefix="shards-")
    last = (dt.datetime.fromtimestamp(1_800_000_000, dt.UTC), 0, True, [0.1], None, None, 0.01)
    for i, part in enumerate((rows[:100], rows[100:], [("flush", *last)])):
        spark.createDataFrame(part, monitor.INPUT).coalesce(1).write.parquet(f"{folder}/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = live.frame_stream(spark, f"{folder}/*", maxFilesPerTrigger=1)
    q = (
        monitor.monitor_stream(stream, c, "0 seconds", 3).writeStream.format("parquet").option("path", f"{folder}-out").outputMode("append")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="cp-")).trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    # Blocks, timers both ways and their indexes of three shards, not of forty sessions.
    assert 0 < max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) < 40
    out = spark.read.schema(monitor.OUTPUT).parquet(f"{folder}-out").where("session is null or session != 'flush'").collect()
    assert sorted(str(clean(r)) for r in out) == sorted(map(str, alone(rows, c)))
    with pytest.raises(ValueError, match="shard"):
        monitor.monitor_stream(stream, c, shards=0)
