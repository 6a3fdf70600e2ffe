import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import metrics, percentiles, windows


def test_perclos_and_onsets(spark):
    series = [0.30, 0.30, 0.05, 0.05, 0.30, 0.05]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(series)], "s int, frame long, ear double")
    for rows in (2, 1 << 20):
        r = windows.session_onsets(df, ["s"], "frame", "ear", 0.1, "below", rows).first()
        assert (r.frames, r.onsets, r.mean_duration) == (6, 2, 1.5)
    assert df.agg(windows.perclos("ear", 0.1)).first()[0] == 0.5
    assert df.filter("s = 9").agg(windows.perclos("ear", 0.1)).first()[0] == 0.0
    none = windows.session_onsets(df, ["s"], "frame", "ear", 0.01, "below").first()
    assert (none.onsets, none.mean_duration) == (0, 0.0)


def test_windows_need_positive_sizes(spark):
    df = spark.createDataFrame([(0, 0, 0.1)], "s int, frame long, ear double")
    for size, stride in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            windows.sliding_windows(df, ["s"], "frame", size, stride)
    with pytest.raises(ValueError):
        windows.rolling_window(df, ["s"], "frame", ["ear"], 0)


@pytest.mark.parametrize("size,stride,rows", [(4, 2, 5), (5, 3, 6), (3, 7, 4), (6, 4, 1 << 20)])
def test_window_summary_equals_direct(spark, size, stride, rows):
    rng = np.random.default_rng(size)
    n, fps = 40, 10.0
    ear, mar, pitch = rng.random(n), rng.random(n), rng.normal(0, 10, n)
    df = spark.createDataFrame(
        [(0, i, float(ear[i]), float(mar[i]), float(pitch[i])) for i in range(n)],
        "s int, frame long, ear double, mar double, pitch double",
    )
    got = {r.window_id: r for r in windows.window_summary(df, ["s"], "frame", size, stride, fps, 0.3, 0.6, 8.0, rows=rows).collect()}
    starts = list(range(0, n - size + 1, stride))
    assert sorted(got) == list(range(len(starts)))
    onsets = lambda state: int(state[0]) + int(np.sum(state[1:] & ~state[:-1]))
    for k, a in enumerate(starts):
        closed = ear[a : a + size] <= 0.3
        blinks = onsets(closed)
        r = got[k]
        assert r.perclos == pytest.approx(closed.mean())
        assert (r.blink_count, r.yawn_count, r.nod_count) == (
            blinks, onsets(mar[a : a + size] >= 0.6), onsets(np.abs(pitch[a : a + size]) >= 8.0)
        )
        assert r.mean_blink_duration == pytest.approx(closed.sum() / blinks if blinks else 0.0)
        assert r.blink_rate_per_min == pytest.approx(blinks / (size / fps) * 60)
        assert r.mean_abs_pitch == pytest.approx(np.abs(pitch[a : a + size]).mean())


def test_window_labels(spark):
    df = spark.createDataFrame([(0, i, 150 <= i < 170) for i in range(300)], "s int, frame long, flag boolean")
    out = windows.window_labels(df, ["s"], "frame", "flag", 150, 75, 0.1).orderBy("window_id").collect()
    assert [(r.drowsy, r.label) for r in out] == [(False, 0), (True, 2), (True, 2)]
    short = df.filter("frame < 100")
    assert windows.window_labels(short, ["s"], "frame", "flag", 150, 75, 0.1).count() == 0


def preds(spark, true, pred):
    return spark.createDataFrame(list(zip(true, pred)), "t int, p int")


def test_class_metrics(spark):
    df = preds(spark, [0, 0, 1, 1, 2], [0, 1, 1, 1, 2])
    recall = {r["class"]: r.recall for r in metrics.class_recall(df, "t", "p", 4).collect()}
    assert [recall[c] for c in range(3)] == [0.5, 1.0, 1.0] and math.isnan(recall[3])
    assert metrics.accuracy_and_false_alarms(df, "t", "p", 2).first().overall_accuracy == 0.8
    assert metrics.accuracy_and_false_alarms(preds(spark, [0, 1, 2], [2, 1, 2]), "t", "p", 2).first().false_alarm_rate == 0.5
    only = metrics.accuracy_and_false_alarms(preds(spark, [2, 2], [2, 1]), "t", "p", 2).first()
    assert only.false_alarm_rate == 0.0
    empty = metrics.accuracy_and_false_alarms(df.filter("t > 9"), "t", "p", 2).first()
    assert (empty.overall_accuracy, empty.false_alarm_rate) == (0.0, 0.0)


def test_two_class_auroc(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1]), (1, [0.2, 0.8]), (1, [0.6, 0.4]), (0, [0.5, 0.5])], "y int, s array<double>")
    assert metrics.macro_auroc(df, "y", "s", 2).first()[0] == 0.75


def test_interval_report(spark):
    probs = [[0.8, 0.2, 0.0], [0.3, 0.7, 0.0], [0.6, 0.4, 0.0], [0.1, 0.9, 0.0]]
    rows = [(f"i{i}", lab, p) for i, (lab, p) in enumerate(zip([0, 0, 0, 1], probs))]
    rows += [("i0", 0, [0.4, 0.6, 0.0])]
    df = spark.createDataFrame(rows, "sample_id string, label int, probs array<double>")
    mean = metrics.mean_probabilities(df, "sample_id", "label", "probs", 3)
    assert mean.filter("sample_id = 'i0'").first().probs == pytest.approx([0.6, 0.4, 0.0])
    r = metrics.interval_report(df, "sample_id", "label", "probs", ["a", "b", "c"]).first()
    assert r.overall_accuracy == 0.75
    assert r.balanced_accuracy == pytest.approx((2 / 3 + 1) / 2)
    assert r.absent_classes == ["c"] and r.per_class_recall["c"] == 0.0 and r.support["a"] == 3
    assert r.confusion_matrix == [[2, 1, 0], [0, 1, 0], [0, 0, 0]]
    mixed = df.unionByName(spark.createDataFrame([("i1", 1, probs[0])], df.schema))
    with pytest.raises(Exception, match="frames disagree"):
        metrics.mean_probabilities(mixed, "sample_id", "label", "probs", 3).collect()
    eye = metrics.recall_report(preds(spark, [1, 1, 1], [1, 1, 0]), "t", "p", ["closed", "open"], False).first()
    assert eye.balanced_accuracy == pytest.approx((0 + 2 / 3) / 2) and eye.per_class_recall["closed"] == 0.0


def test_votes_and_rates(spark):
    rows = [(0, 0, "front", "front"), (0, 1, "front", "front"), (0, 2, "front", "left"), (1, 0, "left", "left"),
            (1, 1, "left", "left"), (2, 0, "left", "right"), (2, 1, "left", "front")]
    df = spark.createDataFrame(rows, "interval int, frame int, truth string, said string")
    votes = metrics.majority_vote(df, ["interval"], "truth", "said", "frame")
    assert {r.interval: r.said for r in votes.collect()} == {0: "front", 1: "left", 2: "right"}
    r = metrics.road_rates(votes, "truth", "said").first()
    assert (r.n_on_road, r.n_off_road, r.false_alarms, r.detected, r.false_alarm_rate, r.detection_rate) == (1, 2, 0, 2, 0.0, 1.0)
    assert metrics.road_rates(votes.filter("truth != 'front'"), "truth", "said").first().false_alarm_rate is None
    zones = {r.zone: (r.n, r.correct) for r in metrics.zone_accuracy(votes, "truth", "said").collect()}
    assert zones == {"front": (1, 1), "left": (2, 1), "all": (3, 2)}
    twice = df.unionByName(spark.createDataFrame([(0, 9, "left", "left")], df.schema))
    with pytest.raises(Exception, match="more than one true label"):
        metrics.majority_vote(twice, ["interval"], "truth", "said", "frame").collect()


def test_coverage(spark):
    schema = "label string, feature_rows long, crop_rows long"
    table = metrics.coverage_table(spark.createDataFrame([("Talking", 10, 9), ("Talking", 990, 1), ("Normal", 0, 0)], schema))
    got = {r.label: (r.samples, r.feature_rows, r.crop_rows, r.retained_fraction) for r in table.collect()}
    assert got == {"Talking": (2, 1000, 10, 0.01), "Normal": (1, 0, 0, None), "all": (3, 1000, 10, 0.01)}
    for bad in (("x", 1, 2), ("x", -1, 0), ("x", 1, -1)):
        with pytest.raises(Exception, match="more crops than features"):
            metrics.coverage_table(spark.createDataFrame([bad], schema)).collect()


def test_latency(spark):
    rows = [(0, x, f) for x, f in ((0.01, True), (0.02, True), (0.03, False), (0.04, True))]
    df = spark.createDataFrame(rows, "s int, latency_s double, face boolean")
    r = metrics.throughput(df, ["s"], F.col("latency_s") * 1000, F.col("face"), F.max(F.lit(2.0))).first()
    assert (r.frames, r.fps, r.face_rate) == (4, 2.0, 0.75)
    assert (r.lat_ms_p50, r.lat_ms_p95) == pytest.approx((25.0, 38.5))
    still = metrics.throughput(df, ["s"], F.col("latency_s"), F.col("face"), F.max(F.lit(0.0))).first()
    assert still.fps == 0.0
    zero = spark.createDataFrame([("m", 0.0)], "model string, ms double")
    assert metrics.latency_report(zero, ["model"], "ms").first().fps == math.inf


def test_weights_and_majority(spark):
    df = spark.createDataFrame([(c,) for c in (0, 0, 0, 1, 2, 2, 2)], "label int")
    weights = {r["class"]: r.weight for r in metrics.class_weights(df, "label", 4).collect()}
    assert weights == pytest.approx({0: 7 / 12, 1: 7 / 4, 2: 7 / 12, 3: 7 / 4})
    assert metrics.majority_class(df, "label").first()[0] == 0
    with pytest.raises(Exception, match="no rows"):
        metrics.majority_class(df.filter("label > 9"), "label").collect()


def test_threshold_needs_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "mar double")
    assert percentiles.threshold_at_percentile(df, "mar").first()[0] == 99.0
    with pytest.raises(Exception, match="no values"):
        percentiles.threshold_at_percentile(df.filter("mar < 0"), "mar").collect()


def test_standardise(spark):
    df = spark.createDataFrame([(True, 1.0, 5.0), (True, 3.0, 5.0), (False, 5.0, 6.0)], "train boolean, a double, b double")
    got = sorted(tuple(r) for r in metrics.standardise(df, F.col("train"), ["a", "b"]).select("a", "b").collect())
    assert got == [(-1.0, 0.0), (1.0, 0.0), (3.0, 1.0)]


def test_label_coverage(spark):
    labels = spark.createDataFrame([("r", f) for f in (0, 5, 9, 10, 11)], "rec string, frame long")
    recs = spark.createDataFrame([("r", 10), ("q", 4)], "rec string, n_frames_total long")
    got = {r.rec: (r.n_frames_labelled, r.n_labels_past_end) for r in metrics.label_coverage(labels, recs, ["rec"]).collect()}
    assert got == {"r": (3, 2), "q": (0, 0)}


def test_binary_report(spark):
    df = spark.createDataFrame([(False, True), (False, False)], "t boolean, p boolean")
    r = metrics.binary_drowsy_report(df, "t", "p").first()
    assert math.isnan(r.drowsy_recall) and (r.n_windows, r.n_drowsy_true, r.false_alarm_rate, r.overall_accuracy) == (2, 0, 0.5, 0.5)


def test_rows_outside_the_classes_count(spark):
    df = spark.createDataFrame([(0, 0), (0, 7), (1, None), (5, 1), (1, 1)], "t int, p int")
    got = {r["class"]: (r.support, r.recall) for r in metrics.class_recall(df, "t", "p", 3, 0.0).collect()}
    assert got == {0: (2, 0.5), 1: (2, 0.5), 2: (0, 0.0)}
    with pytest.raises(Exception, match="none of the 3 classes"):
        metrics.confusion_matrix(df, "t", "p", 3).collect()
    weights = {r["class"]: r.weight for r in metrics.class_weights(df, "t", 3).collect()}
    assert weights == {0: pytest.approx(5 / 6), 1: pytest.approx(5 / 6), 2: pytest.approx(5 / 3)}


def test_radix_percentiles_of_odd_numbers(spark):
    rng = random.Random(21)
    odd = [-0.0, 0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0 + 2**-52, 1e-9, -7.25]
    groups = {"a": [rng.choice(odd) for _ in range(101)], None: [rng.gauss(0, 10.0 ** rng.randint(-6, 6)) for _ in range(200)]}
    groups["same"], groups["one"] = [3.5] * 40, [-2.0]
    rows = [(k, 1, x) for k, xs in groups.items() for x in xs] + [("none", 1, None), ("a", 1, None)]
    df = spark.createDataFrame(rows, "k string, _n int, x double").repartition(5)
    points = {"low": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "high": 1.0}
    got = {r.k: r for r in percentiles.exact_percentiles(df, ["k"], "x", points).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        for name, p in points.items():
            at = p * (len(xs) - 1)
            low, high = sorted(xs)[int(np.floor(at))], sorted(xs)[int(np.ceil(at))]
            assert got[k][name] == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12, abs=0)
    assert percentiles.exact_percentiles(df.where("x is null"), ["k"], "x", points).collect() == []


def test_ordered_bits_keep_the_order(spark):
    xs = [float("-inf"), -1e308, -1.5, -5e-324, 0.0, 5e-324, 1.5, 1e308, float("inf"), float("nan")]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(percentiles.ordered_bits(F.col("x")).alias("u")).collect()
    assert [r.u for r in rows] == sorted({r.u for r in rows})


def test_radix_area_under_the_curve_counts_ties_half(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 2), [rng.choice([0.1, 0.1 + 2**-40, rng.random(), -1e-300]) for _ in range(3)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, p array<double>")
    got = {r["class"]: r.auroc for r in metrics.auroc_per_class(df, "y", "p", 3).collect()}
    for c in range(3):
        pos, neg = [p[c] for y, p in rows if y == c], [p[c] for y, p in rows if y != c]
        wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert got[c] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
