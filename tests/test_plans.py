import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import metrics, runs, scoring
from wakeline.plans import alerting, fatigue, yawning


def peak_model():
    return lambda batch: np.where(batch[:, :, 0].mean(axis=1) < 0.3, 2, 0)


def clips(spark):
    """Six clips, the drowsy ones closing their eyes in the middle."""
    rng = np.random.default_rng(0)
    labels = ["alert", "low_vigilance", "drowsy"]
    rows = []
    for c in range(6):
        for i in range(200):
            shut = labels[c % 3] == "drowsy" and 60 <= i < 150
            rows.append((f"c{c}", i, float((0.1 if shut else 0.6) + rng.random() / 50), 0.1, 0.0, 0.0, 0.0))
    frames = spark.createDataFrame(rows, "sample_id string, frame long, ear double, mar double, pitch double, yaw double, roll double")
    manifest = spark.createDataFrame([(f"c{c}", f"s{c}", labels[c % 3]) for c in range(6)], "sample_id string, subject_id string, label string")
    return frames, manifest


@pytest.mark.parametrize("rows", [64, 1 << 20])
def test_validate_alerts(spark, rows):
    frames, manifest = clips(spark)
    scorer = peak_model
    out = tempfile.mkdtemp(prefix="rep-") + "/r"
    report = alerting.validate_alerts(frames, manifest, scorer, 10.0, out, "evaluate", 10, (5, 15, 45), rows)
    got = {r.threshold: r for r in report.collect()}
    assert set(got) == {"VISUAL", "AUDIBLE", "ALARM"}
    assert got["AUDIBLE"].drowsy_detection_rate == 1.0 and got["AUDIBLE"].false_alarms_per_hour == 0.0
    assert got["ALARM"].median_time_to_first_alert_s == pytest.approx(got["AUDIBLE"].median_time_to_first_alert_s + 4.4)
    written = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert {w["threshold"] for w in written} == set(got) and written[0]["config"]["mode"] == "evaluate"
    with pytest.raises(ValueError, match="mode"):
        alerting.validate_alerts(frames, manifest, scorer, 10.0, out, "guess")


def test_validate_alerts_sweep(spark):
    frames, manifest = clips(spark)
    scorer = peak_model
    out = tempfile.mkdtemp(prefix="rep-") + "/r"
    report = alerting.validate_alerts(frames, manifest, scorer, 10.0, out, "sweep", 10, rows=1 << 20)
    chosen = report.filter("selected").collect()
    assert report.count() == 64 and len(chosen) == 1 and chosen[0].escalate == 3


def test_yawn_detectors(spark):
    series = {"y1": [0.1] * 5 + [0.9] * 10, "y2": [0.9] * 9 + [0.1] * 6, "t1": [0.1, 0.9] * 7 + [0.1], "n1": [0.1] * 15}
    labels = {"y1": "Yawning", "y2": "Talking&Yawning", "t1": "Talking", "n1": "Normal"}
    frames = spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], "sample_id string, frame long, mar double")
    manifest = spark.createDataFrame([(k, k, v) for k, v in labels.items()], "sample_id string, subject_id string, label string")
    key = ["sample_id"]
    longest = yawning.longest_runs(frames, manifest, key, "frame", "mar", 0.5)
    r = yawning.score_videos(longest).first()
    assert (r.recall, r.precision, r.talking_false_positive_rate) == (1.0, pytest.approx(2 / 3), 1.0)
    _, best = yawning.sweep_durations(longest, range(1, 15))
    assert (best.first().min_duration, best.first().floor_met) == (2, True)
    crops = frames.withColumn("row", F.col("frame")).withColumn("vector", F.array(F.col("mar"), 1 - F.col("mar")))
    train = lambda f: runs.training_events(f, manifest, key, "frame", "mar", 0.5)
    events = yawning.event_features(frames, crops, key, "frame", "mar", 0.5, 2, events_builder=train)
    by_label = {r.label: r.n for r in events.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert by_label == {1: 2, 0: 7}
    held_out = yawning.event_features(frames, crops, key, "frame", "mar", 0.5, 2)
    assert {r.label for r in held_out.collect()} == {0}
    scored = held_out.withColumn("score", (F.col("end") - F.col("start")) / 10.0)
    table = yawning.compare_detectors(longest, scored.select("sample_id", "score"), key, 5, 0.5)
    got = {r.detector: (r.n_videos, r.tp, r.fp, r.fn) for r in table.collect()}
    assert got == {"baseline_mar": (4, 2, 1, 0), "baseline_duration": (4, 2, 0, 0), "classifier": (4, 2, 0, 0)}
    assert yawning.decide(table).first()[0] == "blocked_baseline"
    with pytest.raises(ValueError):
        yawning.score_videos(longest, 0)


def test_models_learn(spark):
    rng = np.random.default_rng(1)
    rows = [(c, [float(x) for x in rng.normal(c, 0.2, 4)], f"s{i % 3}") for i in range(90) for c in (i % 3,)]
    rows = [(c, v, f"p{i % 4}") for i, (c, v, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "label_index int, features array<double>, subject string")
    head, accuracy = scoring.fit_linear_head(df, df, penalties=(0.0,), max_iter=20)
    assert accuracy > 0.95
    vectors = scoring.as_vector(df, "features", "v").select(F.col("v").alias("features"), "label_index", "subject")
    fit = lambda train: scoring.fit_boosted(train, "label_index", 3, max_iter=3)
    pooled = scoring.leave_one_subject_out(vectors, "subject", fit)
    assert pooled.count() == 90
    assert metrics.frame_accuracy(pooled, "label_index", "prediction").first().accuracy > 0.9
    total = pooled.select(F.max(F.abs(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) - 1))).first()[0]
    assert total < 1e-9
    binary = df.withColumn("label", (F.col("label_index") == 2).cast("int"))
    model = scoring.fit_event_classifier(binary, max_iter=20)
    scored = scoring.score_events(model, binary)
    assert scored.filter("label = 1").agg(F.min("score")).first()[0] > scored.filter("label = 0").agg(F.max("score")).first()[0]


def test_cross_dataset(spark):
    kept = spark.createDataFrame([(r, i, i * 2) for r in ("a", "b") for i in range(60)], "rec string, row long, frame long")
    spans = spark.createDataFrame([("a", "eyes_state/close", 40, 79)], "rec string, action string, start_frame int, end_frame int")
    recs = spark.createDataFrame([("a", 130), ("b", 130)], "rec string, n_frames long")
    out = fatigue.recording_windows(kept, spans, recs, ["rec"], 20, 10, 0.5, 30.0, 0.5)
    got = [r.drowsy for r in out.orderBy("window_id").collect()]
    assert got == [False, True, True, True, False]  # recording b has no annotations
    report = fatigue.cross_dataset_report(out, F.when(F.col("window_id") > 1, 2).otherwise(0)).first()
    assert (report.n_windows, report.n_drowsy_true) == (5, 3)
    assert report.drowsy_recall == pytest.approx(2 / 3) and report.false_alarm_rate == 0.5
