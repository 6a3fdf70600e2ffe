"""Random sessions through the segmented operators, against plain folds.

Segments are a few rows long here, so borders fall everywhere.
"""

import math
import random

import pytest
from pyspark.sql import functions as F

import folds
from wakeline.operators import alerts, runs, segments


def make(spark, sessions, schema):
    return spark.createDataFrame(
        [(s, i, *row) for s, rows in sessions.items() for i, row in enumerate(rows)], schema
    )


def by_session(rows, *columns):
    out = {}
    for r in rows:
        out.setdefault(r["s"], []).append(tuple(r[c] for c in columns))
    return {s: sorted(v, key=lambda t: t[0]) for s, v in out.items()}


def level_sessions(rng, n=25):
    sessions = {}
    for s in range(n):
        seq = []
        while len(seq) < rng.randint(1, 140):
            seq += [rng.randint(0, 2)] * rng.randint(1, 9)
        sessions[s] = [(v,) for v in seq]
    return sessions


@pytest.mark.parametrize(
    "params,rows", [((3, 8, 15), 32), ((8, 3, 4), 16), ((1, 1, 1), 4), ((4, 4, 2), 8), ((2, 3, 2), 7), ((5, 2, 6), 1 << 20), ((2, 3, 2), 1 << 20)]
)
def test_debounce_equals_fold(spark, params, rows):
    rng = random.Random(hash(params) & 0xFFFF)
    sessions = level_sessions(rng)
    df = make(spark, sessions, "s int, frame long, level int")
    got = by_session(
        alerts.debounce(df, ["s"], "frame", "level", *params, rows=rows).collect(), "frame", "tier"
    )
    for s, rows_ in sessions.items():
        assert [t for _, t in got[s]] == folds.debounce([r[0] for r in rows_], *params), s


@pytest.mark.parametrize("params,rows", [((3, 8, 15), 32), ((6, 2, 3), 9), ((2, 2, 5), 7), ((3, 8, 4), 1 << 20)])
def test_binary_debounce_equals_fold(spark, params, rows):
    rng = random.Random(5)
    sessions = {s: [(r[0] > 0,) for r in v] for s, v in level_sessions(rng).items()}
    df = make(spark, sessions, "s int, frame long, flag boolean")
    got = by_session(
        alerts.debounce_binary(df, ["s"], "frame", "flag", *params, rows=rows).collect(), "frame", "tier"
    )
    for s, rows_ in sessions.items():
        assert [t for _, t in got[s]] == folds.debounce([int(r[0]) for r in rows_], *params, top=1)


def test_debounce_rejects_bad_input(spark):
    df = spark.createDataFrame([(1, 0, 5)], "s int, frame long, level int")
    with pytest.raises(Exception, match="no such fatigue level"):
        alerts.debounce(df, ["s"], "frame", "level").collect()
    with pytest.raises(ValueError):
        alerts.debounce(df, ["s"], "frame", "level", 0, 1, 1)


@pytest.mark.parametrize("rows", [3, 5, 1 << 20])
def test_event_runs_hold_on_nan(spark, rows):
    rng = random.Random(rows or 0)
    sessions = {
        s: [(rng.choice([0.1, 0.9, 0.9, math.nan, None, 0.5]),) for _ in range(rng.randint(1, 60))]
        for s in range(30)
    }
    df = make(spark, sessions, "s int, frame long, mar double")
    got = by_session(runs.event_runs(df, ["s"], "frame", "mar", 0.5, rows=rows).collect(), "start", "end", "peak")
    for s, values in sessions.items():
        series = [v[0] for v in values]
        want = folds.runs_at_or_above(series, 0.5)
        assert [(a, b) for a, b, _ in got.get(s, [])] == want
        for a, b, peak in got.get(s, []):
            assert peak == max(v for v in series[a : b + 1] if v is not None and v == v)


def test_event_runs_literals(spark):
    df = make(spark, {0: [(v,) for v in (0.1, 0.9, 0.9, 0.1, 0.9)], 1: [(0.9,)] * 3}, "s int, frame long, mar double")
    got = by_session(runs.event_runs(df, ["s"], "frame", "mar", 0.5).collect(), "start", "end")
    assert got == {0: [(1, 2), (4, 4)], 1: [(0, 2)]}


@pytest.mark.parametrize("rows", [2, 7, 1 << 20])
def test_majority_and_streak(spark, rows):
    rng = random.Random(11)
    sessions = {}
    for s in range(20):
        t, rows_ = 0, []
        for _ in range(rng.randint(1, 80)):
            t += rng.randint(1, 9)
            rows_.append((t, rng.choice(["front", "left", "right", None, "left"])))
        sessions[s] = rows_
    df = make(spark, sessions, "s int, frame long, ts long, zone string")
    smooth = alerts.majority_smooth(df, ["s"], "frame", "ts", "zone", 20, ["front", "left", "right"], rows=rows)
    got = by_session(smooth.collect(), "frame", "smoothed")
    flagged = df.withColumn("off", F.col("zone") != "front")
    tiers = by_session(
        alerts.streak_tier(flagged, ["s"], "frame", "ts", "off", 10, 25, rows=rows).collect(), "frame", "gaze_tier"
    )
    for s, rows_ in sessions.items():
        stamps, zones = [r[0] for r in rows_], [r[1] for r in rows_]
        assert [z for _, z in got[s]] == folds.majority(stamps, zones, 20)
        assert [t for _, t in tiers[s]] == folds.streak(
            stamps, [z is not None and z != "front" for z in zones], 10, 25
        )


@pytest.mark.parametrize("alpha,every,rows", [(0.5, 3, 64), (0.9, 1, 5), (1.0, 2, 4), (0.3, 2, 512), (0.4, 3, 1 << 20)])
def test_cadenced_ema(spark, alpha, every, rows):
    rng = random.Random(3)
    labels = ["a", "safe_drive", "c"]
    sessions = {
        s: [(None if rng.random() < 0.2 else [rng.random() for _ in labels],) for _ in range(rng.randint(1, 400))]
        for s in range(5)
    }
    df = make(spark, sessions, "s int, frame long, probs array<double>")
    out = alerts.cadenced_ema(df, ["s"], "frame", "probs", labels, every, alpha, rows=rows)
    got = by_session(out.collect(), "frame", "probabilities", "activity", "distracted", "ran")
    for s, rows_ in sessions.items():
        want = folds.ema([r[0] for r in rows_], every, alpha)
        for (i, p, activity, distracted, ran), w in zip(got[s], want):
            if w is None:
                assert p == [1 / 3] * 3 and activity == "safe_drive" and not distracted
            else:
                assert p == pytest.approx(w, abs=1e-12)
                assert activity == labels[w.index(max(w))]
                assert distracted == (activity != "safe_drive")


def test_index_rows(spark):
    rng = random.Random(9)
    data = [(s, rng.randint(0, 60) ** 2, i) for i, s in enumerate([0] * 60 + [1] * 3 + [2] * 20)]
    df = spark.createDataFrame(data, "s int, t long, id int")
    for rows in (1, 7, 1 << 17):
        got = by_session(segments.index_rows(df, ["s"], ["t", "id"], rows=rows).collect(), "frame", "id")
        for s in (0, 1, 2):
            want = [i for _, _, i in sorted(d for d in data if d[0] == s)]
            assert got[s] == list(enumerate(want))
    whole = segments.index_rows(df, [], ["s", "t", "id"], rows=9).orderBy("frame").collect()
    assert [r.frame for r in whole] == list(range(len(data))) and whole == sorted(whole, key=lambda r: (r.s, r.t, r.id))


def test_numbering_moves_and_writes_nothing_but_one_exchange(spark):
    df = spark.range(1000).selectExpr("id % 3 as s", "id as t")
    plan = segments.index_rows(df, ["s"], ["t"])._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower() and "Join" not in plan and plan.count("Window") == 1


def test_slices_know_nulls_and_odd_numbers(spark):
    rows = [(0, x, i) for i, x in enumerate([None, float("nan"), -0.0, 0.0, 1e300, -1e300, None, 5.0] * 20)]
    df = spark.createDataFrame(rows, "s int, t double, id int")
    got = segments.index_rows(df, ["s"], ["t", "id"], rows=8).orderBy("frame").collect()
    want = df.orderBy("s", "t", "id").collect()
    assert [r.id for r in got] == [r.id for r in want] and [r.frame for r in got] == list(range(len(rows)))


@pytest.mark.parametrize(
    "name,t,subject",
    [
        ("one outlying time", "if(id = 7, 100000000000L, id)", "0"),
        ("a constant first column", "5L", "0"),
        ("texts that start alike", "concat('subject_000000', id)", "0"),
        ("a hot session", "id", "if(id % 3 > 0, 0, id)"),
    ],
)
def test_slices_are_even_whatever_the_order(spark, name, t, subject):
    df = spark.range(20_000).selectExpr(f"{subject} as s", f"{t} as t", "id")
    sliced = segments.slice_by_order(df, ["s"], ["t", "id"], rows=1_000)
    sizes = [r["count"] for r in sliced.groupBy("s", segments.SLICE).count().collect()]
    assert max(sizes) <= 2 * 1_000, name
    assert sum(n >= 500 for n in sizes) >= 11, name
    got = segments.index_rows(df, ["s"], ["t", "id"], rows=1_000).orderBy("s", "frame").collect()
    assert [r.frame for r in got if r.s == 0] == list(range(sum(r.s == 0 for r in got)))
    assert sorted(got, key=lambda r: (r.s, r.t, r.id)) == got


@pytest.mark.parametrize("rows", [4, 1 << 20])
def test_sessionise_and_first_seen(spark, rows):
    rng = random.Random(2)
    data, want = [], []
    for s in range(10):
        frame, ident, prev = 0, -1, None
        for _ in range(rng.randint(1, 40)):
            frame += rng.choice([1, 1, 1, 9])
            zone = rng.choice("ab")
            if prev is None or prev != (frame - 1, zone):
                ident += 1
            prev = (frame, zone)
            data.append((s, frame, zone))
            want.append((s, frame, ident))
    df = spark.createDataFrame(data, "s int, frame long, zone string")
    got = runs.sessionise(df, ["s"], "frame", "zone", rows=rows).collect()
    assert sorted((r.s, r.frame, r.interval_id) for r in got) == sorted(want)
    ids = {(r.s, r.zone): r.interval_id for r in runs.first_seen_ids(df, ["s"], "frame", "zone", rows=rows).collect()}
    for s in range(10):
        order = list(dict.fromkeys(z for t, f, z in sorted(data) if t == s))
        assert [ids[(s, z)] for z in order] == list(range(len(order)))


@pytest.mark.parametrize("rows", [3, 1 << 20])
def test_equal_runs_merge_over_borders(spark, rows):
    rng = random.Random(4)
    sessions = level_sessions(rng, 10)
    df = make(spark, sessions, "s int, frame long, level int")
    got = by_session(
        runs.equal_runs(df, ["s"], "frame", "level", {"total": ("sum", "level")}, rows=rows).collect(),
        "start", "end", "value", "length", "total",
    )
    for s, rows_ in sessions.items():
        want, seq = [], [r[0] for r in rows_]
        for i, v in enumerate(seq):
            if i == 0 or seq[i - 1] != v:
                want.append([i, i, v, 0, 0])
            want[-1][1] = i
            want[-1][3] += 1
            want[-1][4] += v
        assert got[s] == [tuple(w) for w in want]


@pytest.mark.parametrize("rows", [8, 1 << 20])
def test_parallel_tracks_and_changes(spark, rows):
    rng = random.Random(8)
    sessions = {
        s: [
            (rng.random() < 0.7, rng.choice([0, 2, 2, 1]), rng.random() < 0.5, rng.choice(["front", "left", None]))
            for _ in range(50)
        ]
        for s in range(6)
    }
    df = make(spark, sessions, "s int, frame long, has_face boolean, level int, distracted boolean, gaze_zone string")
    out = alerts.parallel_tracks(df, ["s"], "frame", "has_face", "level", "distracted", (2, 3, 2), rows=rows).cache()
    got = by_session(out.collect(), "frame", "fatigue_tier", "distraction_tier", "tier", "fatigue_level")
    events = by_session(
        alerts.change_events(out, ["s"], "frame", rows=rows).collect(), "frame", "event", "from", "to", "fatigue"
    )
    for s, rows_ in sessions.items():
        faces = [r[1] for r in rows_ if r[0]]
        fatigue = iter(zip(folds.debounce(faces, 2, 3, 2), faces))
        binary = folds.debounce([int(r[2]) for r in rows_], 2, 3, 2, top=1)
        tier = level = 0
        want, changes, zone = [], [], None
        for i, r in enumerate(rows_):
            if r[0]:
                tier, level = next(fatigue)
            want.append((i, tier, binary[i], max(tier, binary[i]), level))
            if i and want[i][3] != want[i - 1][3]:
                changes.append((i, "tier_change", str(want[i - 1][3]), str(want[i][3]), level))
            if r[3] is not None:
                if zone is not None and zone != r[3]:
                    changes.append((i, "gaze_change", zone, r[3], None))
                zone = r[3]
            if i and r[0] != rows_[i - 1][0]:
                changes.append((i, "face_regained" if r[0] else "face_lost", None, None, None))
        assert got[s] == want
        assert sorted(events[s], key=str) == sorted(changes, key=str)


def test_alarm_counts(spark):
    df = make(spark, {0: [(10, 1), (20, 2), (30, 3), (40, 0), (50, 2)]}, "s int, i int, frame long, tier int")
    for threshold, want in ((2, (2, 20)), (3, (1, 30)), (1, (2, 10))):
        for rows in (15, 1 << 20):
            r = alerts.alarm_counts(df, ["s"], "frame", threshold, rows=rows).first()
            assert (r.alarms, r.first_frame) == want


def test_votes_over_zones_nobody_listed(spark):
    rows = [(0, i, i * 1_000_000, z) for i, z in enumerate(["roof", "roof", "lap", None, "lap", "sky", "sky"])]
    df = spark.createDataFrame(rows, "s int, frame long, ts long, zone string")
    got = alerts.majority_smooth(df, ["s"], "frame", "ts", "zone", 10_000_000).orderBy("frame").collect()
    assert [r.smoothed for r in got] == ["roof", "roof", "roof", None, "lap", "sky", "sky"]


@pytest.mark.parametrize("rows", [3, 16, 1 << 20])
def test_votes_over_many_zones_match_a_recount(spark, rows):
    rng = random.Random(rows)
    sessions, want = {}, {}
    for s in range(12):
        t, seen, rows_ = 0, [], []
        for i in range(rng.randint(1, 70)):
            t += rng.choice([0, 1, 1, 2, 9])
            zone = rng.choice([None, *"abcdefghij", "a", "b", "a"])
            seen = [v for v in seen if v[0] >= t - 12] + [(t, i, zone)] if zone else []
            counts = {z: (sum(v[2] == z for v in seen), max(v[1] for v in seen if v[2] == z)) for _, _, z in seen}
            want[s, i] = max(counts, key=counts.get) if zone else None
            rows_.append((t, zone))
        sessions[s] = rows_
    df = make(spark, sessions, "s int, frame long, ts long, zone string")
    got = alerts.majority_smooth(df, ["s"], "frame", "ts", "zone", 12, rows=rows).collect()
    assert {(r.s, r.frame): r.smoothed for r in got} == want and len(got) == len(want)


def plain_mode(rows, window):
    """The most frequent zone of (ts, zone) rows, all rows of the window counted at each."""
    out = []
    for i, (t, z) in enumerate(rows):
        seen = []
        for u, y in reversed(rows[: i + 1]):
            if y is None or u < t - window:
                break
            seen.append(y)
        out.append(max(seen, key=lambda y: (seen.count(y), -seen.index(y))) if z is not None else None)
    return out


@pytest.mark.parametrize("rows, window, way", [(1000, 15, "_segment_mode"), (16, 9, "_segment_mode"), (16, 400, "_sliding_mode")])
def test_open_vocabulary_is_walked_by_segments(spark, monkeypatch, rows, window, way):
    taken = []
    for name in ("_segment_mode", "_sliding_mode"):
        monkeypatch.setattr(alerts, name, lambda *a, name=name, fn=getattr(alerts, name): (taken.append(name), fn(*a))[1])
    rng = random.Random(rows + window)
    sessions = {}
    for s in ("a", "b"):
        t, sessions[s] = 0, []
        for _ in range(130):
            t += rng.choice((0, 1, 1, 3))
            sessions[s].append((t, None if rng.random() < 0.04 else f"z{rng.randint(0, 9)}"))
    flat = [(s, i, t, z, i * 0.5) for s, part in sessions.items() for i, (t, z) in enumerate(part)]
    flat.append((None, 0, 5, "z1", 0.0))
    df = spark.createDataFrame(flat, "s string, frame long, ts long, zone string, other double").repartition(5)
    out = alerts.majority_smooth(df, ["s"], "frame", "ts", "zone", window, rows=rows)
    got = {(r.s, r.frame): r for r in out.collect()}
    assert taken == [way] and out.columns == [*df.columns, "smoothed"] and len(got) == len(flat)
    assert got[None, 0].smoothed is None and got["b", 7].other == 3.5
    for s, part in sessions.items():
        assert [got[s, i].smoothed for i in range(len(part))] == plain_mode(part, window)
    if way == "_segment_mode":
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
