import random
import statistics

import pytest
from pyspark.sql import functions as F

import folds
from test_sequences import level_sessions, make
from wakeline.operators import metrics, percentiles, sweeps


def summarise(clips, threshold, fps, params):
    """Direct reading of the clip metrics, for a handful of clips."""
    rises = {}
    for s, (label, levels) in clips.items():
        tiers = folds.debounce(levels, *params)
        rises[s] = [
            i for i, t in enumerate(tiers) if t >= threshold and (i == 0 or tiers[i - 1] < threshold)
        ]
    quiet = [s for s, c in clips.items() if c[0] != "drowsy"]
    calm = [s for s, c in clips.items() if c[0] == "alert"]
    sleepy = [s for s, c in clips.items() if c[0] == "drowsy"]
    hours = lambda group: sum(len(clips[s][1]) for s in group) / fps / 3600
    firsts = [rises[s][0] / fps for s in sleepy if rises[s]]
    return (
        sum(len(rises[s]) for s in quiet) / hours(quiet),
        sum(bool(rises[s]) for s in quiet) / len(quiet),
        sum(len(rises[s]) for s in calm) / hours(calm),
        len(firsts) / len(sleepy),
        statistics.median(firsts) if firsts else None,
    )


@pytest.mark.parametrize("threshold,rows", [(1, 1 << 20), (2, 16), (3, 5), (3, 1 << 20)])
def test_sweep_equals_replay(spark, threshold, rows):
    rng = random.Random(threshold * 100 + (rows or 0))
    sessions = level_sessions(rng, 18)
    names = ["alert", "low_vigilance", "drowsy"]
    clips = {s: (names[s % 3], [r[0] for r in v]) for s, v in sessions.items()}
    levels = make(spark, sessions, "s int, frame long, level int")
    dim = spark.createDataFrame(
        [(s, c[0], len(c[1])) for s, c in clips.items()], "s int, label string, n_frames long"
    )
    grid = [(2, 3, 2), (5, 15, 45), (3, 2, 4), (4, 4, 1), (1, 6, 3)]
    out = sweeps.sweep_alerts(levels, dim, ["s"], "frame", "level", 10.0, grid, threshold, rows)
    got = {(r.escalate, r.de_escalate, r.alarm_after): r for r in out.collect()}
    assert len(got) == len(grid)
    for params in grid:
        r = got[params]
        assert (r.n_clips, r.n_not_drowsy_clips, r.n_drowsy_clips) == (18, 12, 6)
        have = (
            r.false_alarms_per_hour,
            r.fraction_not_drowsy_clips_with_alarm,
            r.false_alarms_per_hour_alert_clips_only,
            r.drowsy_detection_rate,
            r.median_time_to_first_alert_s,
        )
        want = summarise(clips, threshold, 10.0, params)
        assert have == pytest.approx(want, abs=1e-9), params


def test_replay_literals(spark):
    """Four clips of an hour at 10 fps."""
    clips = spark.createDataFrame(
        [("a", "alert", 36000), ("b", "low_vigilance", 36000), ("c", "drowsy", 36000), ("d", "drowsy", 36000)],
        "s string, label string, n_frames long",
    )
    grid = spark.createDataFrame([(0, 1)], "grid_pos int, p int")
    rises = spark.createDataFrame([("a", 1, 100), ("c", 1, 200)], "s string, p int, frame long")
    r = sweeps.replay_summary(rises, clips, ["s"], ["p"], grid, 10.0).first()
    assert r.false_alarms_per_hour == pytest.approx(0.5)
    assert r.fraction_not_drowsy_clips_with_alarm == 0.5
    assert r.false_alarms_per_hour_alert_clips_only == pytest.approx(1.0)
    assert r.drowsy_detection_rate == 0.5
    assert r.median_time_to_first_alert_s == 20.0
    wrong = clips.withColumn("label", F.lit("asleep"))
    with pytest.raises(Exception, match="no clip is labelled"):
        sweeps.replay_summary(rises, wrong, ["s"], ["p"], grid, 10.0).collect()


def sweep_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "grid_pos int, escalate int, de_escalate int, alarm_after int, false_alarms_per_hour double, "
        "drowsy_detection_rate double, median_time_to_first_alert_s double",
    )


def test_select_alert_params(spark):
    base = (0, 5, 15, 45, 9.0, 0.8, 10.0)
    pick = lambda rows: sweeps.select_alert_params(sweep_rows(spark, rows)).first().grid_pos
    assert pick([base, (1, 1, 1, 1, 1.0, 0.7, 1.0), (2, 2, 2, 2, 4.0, 0.8, 20.0), (3, 3, 3, 3, 4.0, 0.9, 12.0)]) == 3
    assert pick([base, (1, 1, 1, 1, 4.0, 0.8, None), (2, 2, 2, 2, 4.0, 0.8, 99.0)]) == 2
    assert pick([base, (1, 1, 1, 1, 4.0, 0.8, 7.0), (2, 2, 2, 2, 4.0, 0.8, 7.0)]) == 1
    with pytest.raises(Exception, match="default parameters"):
        pick([(1, 1, 1, 1, 4.0, 0.8, 7.0)])
    with pytest.raises(Exception, match="no drowsy clips"):
        pick([(0, 5, 15, 45, 9.0, None, None)])


def test_threshold_sweep_and_selection(spark):
    rows = [("Yawning", 10), ("Talking", 1), ("Normal", 1)]
    df = spark.createDataFrame(rows, "label string, longest int")
    truth = F.col("label") == "Yawning"
    sweep = sweeps.threshold_sweep(df, "longest", truth, range(1, 8), "min_duration")
    got = {r.min_duration: (r.tp, r.fp, r.fn) for r in sweep.collect()}
    assert got == {d: (1, 2 if d == 1 else 0, 0) for d in range(1, 8)}
    best = sweeps.select_threshold(sweep, "min_duration").first()
    assert (best.min_duration, best.floor_met) == (2, True)
    low = spark.createDataFrame([(1, 0.9, 0.3), (2, 0.2, 0.5), (3, 0.1, 0.5)], "d int, precision double, recall double")
    best = sweeps.select_threshold(low, "d").first()
    assert (best.d, best.floor_met) == (2, False)


def test_exact_percentiles(spark):
    rng = random.Random(3)
    data = [(g, rng.choice([rng.random() ** 9, 0.25, float(rng.randint(0, 3))])) for g in "aab" for _ in range(90)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: (r.lo, r.mid, r.hi) for r in percentiles.exact_percentiles(df, ["g"], "x", {"lo": 0.1, "mid": 0.5, "hi": 0.95}).collect()}

    def at(values, p):
        pos = p * (len(values) - 1)
        low = int(pos)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (pos - low)

    for g in "ab":
        values = sorted(x for k, x in data if k == g)
        assert got[g] == pytest.approx(tuple(at(values, p) for p in (0.1, 0.5, 0.95)), abs=1e-12)


@pytest.mark.parametrize("rows", [4, 1 << 20])
def test_auroc_pairwise(spark, rows):
    rng = random.Random(1)
    data = [(rng.randint(0, 2), [round(rng.random(), 1) for _ in range(3)]) for _ in range(120)]
    df = spark.createDataFrame(data, "y int, p array<double>")
    got = metrics.macro_auroc(df, "y", "p", 3).first()[0]
    areas = []
    for c in range(3):
        pos = [p[c] for y, p in data if y == c]
        neg = [p[c] for y, p in data if y != c]
        areas.append(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert got == pytest.approx(sum(areas) / 3, abs=1e-12)
    with pytest.raises(Exception, match="undefined"):
        metrics.macro_auroc(df.filter("y = 0"), "y", "p", 3).collect()
