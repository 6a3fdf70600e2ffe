"""Models whose results can fail: floors on held-out quality, and plain recomputation."""

import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from catalog import QUERIES
from wakeline.operators import scoring
from wakeline.operators.segments import cut
from wakeline.plans import fatigue

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def plain_discriminant(subjects, labels, vectors):
    out = []
    for i, s in enumerate(subjects):
        rest = [j for j, t in enumerate(subjects) if t != s and labels[j] is not None and vectors[j] is not None]
        x, y = np.array([vectors[j] for j in rest]), np.array([labels[j] for j in rest])
        if vectors[i] is None or labels[i] is None or not len(rest):
            out.append(None)
            continue
        classes = sorted(set(y))
        n = np.array([(y == c).sum() for c in classes])
        mean = np.array([x[y == c].mean(axis=0) for c in classes])
        var = np.maximum(((x**2).sum(axis=0) - (n[:, None] * mean**2).sum(axis=0)) / n.sum(), 1e-12)
        score = (mean / var) @ np.array(vectors[i]) - (mean**2 / var).sum(axis=1) / 2 + np.log(n / n.sum())
        out.append(classes[int(score.argmax())])
    return out


def test_all_folds_from_sums_match_refitting_each(spark):
    rng = np.random.default_rng(3)
    subjects = [["a", "b", "c", None][i % 4] for i in range(120)]
    labels = [int(rng.integers(0, 3)) for _ in range(120)]
    vectors = [[float(v) for v in rng.normal(label, 0.8, 5)] for label in labels]
    labels[7], vectors[11] = None, None
    labels[4] = 9  # a class that only subject "a" has
    rows = [(i, s, y, v, 1.0, 2) for i, (s, y, v) in enumerate(zip(subjects, labels, vectors))]
    df = spark.createDataFrame(rows, "i int, s string, y int, x array<double>, _n double, _d int").drop("_n", "_d").repartition(3)
    got = scoring.leave_one_subject_out_discriminant(df, "s", "y", "x").orderBy("i").collect()
    assert [r.prediction for r in got] == plain_discriminant(subjects, labels, vectors)
    assert 9 not in {r.prediction for r in got if r.s == "a"}
    assert scoring.leave_one_subject_out_discriminant(df.limit(0), "s", "y", "x").count() == 0


def test_jobs_do_not_grow_with_subjects(spark):
    def jobs(subjects):
        df = spark.range(200).selectExpr(f"id % {subjects} as s", "cast(id % 2 as int) as y", "array(double(id % 2), rand(1)) as x")
        spark.sparkContext.setJobGroup(f"folds{subjects}", "")
        scoring.leave_one_subject_out_discriminant(df, "s", "y", "x").collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds{subjects}"))

    assert jobs(50) <= jobs(3) + 2


@tables
def test_gaze_is_predicted_for_unseen_subjects(spark):
    rows = {(r.level, r.subject): r for r in QUERIES["gaze_leave_one_out"](spark, SF).collect()}
    pooled = rows["frame", "all"]
    assert pooled.n == 500 and len(rows) == 52
    assert pooled.accuracy > 0.5 and pooled.detection_rate > 0.8 and pooled.false_alarm_rate < 0.6


@tables
def test_linear_head_beats_the_majority(spark):
    rows = QUERIES["linear_head"](spark, SF).collect()
    chosen = [r for r in rows if r.chosen]
    assert len(rows) == 3 and len(chosen) == 1
    assert chosen[0].accuracy == max(r.accuracy for r in rows) > chosen[0].majority + 0.2


@tables
def test_event_scores_tell_videos_apart(spark):
    rows = QUERIES["event_classifier"](spark, SF).collect()
    mean = {y: np.mean([r.score for r in rows if r.label == y]) for y in (0, 1)}
    assert len(rows) == 50 and mean[1] > mean[0] + 0.1


@tables
def test_boosted_windows_beat_the_majority(spark):
    """Only the drowsy sessions differ from the others, so those must be found."""
    row = QUERIES["boosted_windows"](spark, SF).first()
    assert row.overall_accuracy > row.majority and row.macro_auroc > 0.75
    assert row.per_class_accuracy["2"] > 0.9 and row.false_alarm_rate < 0.1


@tables
def test_tuning_marks_the_best_configuration(spark):
    rows = QUERIES["window_tuning"](spark, SF).collect()
    chosen = [r for r in rows if r.chosen]
    assert len(chosen) == 1 and chosen[0].macro_auroc == max(r.macro_auroc for r in rows if r.macro_auroc is not None)
    assert len({(r["size"], r.stride) for r in rows}) == len(rows) > 1


def test_tuning_reads_the_frames_once(spark, monkeypatch):
    """Every configuration has the windows that it would have alone, labels that repeat included."""
    reads = []
    df = spark.range(2000).selectExpr("id % 4 as s", "id div 4 as frame", "cast(hash(id) % 40 as double) as ear", "0.01 * (hash(id, 1) % 30) as mar", "cast(hash(id, 2) % 9 as double) as pitch")
    frames = cut(df)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 2), (2, 2)], "s long, label int")
    limits, grid = {"ear": 8.0, "mar": 0.07, "pitch": 4.0}, [{"size": a, "stride": b} for a, b in ((60, 30), (50, 25), (20, 50))]
    seen = []

    def judged(train, validate, *_):
        seen.append((train, validate))
        return spark.range(1).select(F.lit(0.5).alias("macro_auroc"))

    panes = fatigue.summary_panes
    monkeypatch.setattr(fatigue, "summary_panes", lambda *a, **k: (reads.append(a[3]), panes(*a, **k))[1])
    monkeypatch.setattr(fatigue, "evaluate_boosted_windows", judged)
    parts = frames.where("s < 2"), frames.where("s >= 2")
    fatigue.tune(spark, *parts, labels, ["s"], "frame", limits, 30.0, grid)
    assert reads == [[10, 25, 30]] * 2 and len(seen) == 3
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    for c, windows in zip(grid, seen):
        for part, got in zip(parts, windows):
            want = fatigue.clip_windows(part, labels, ["s"], "frame", c["size"], c["stride"], limits, 30.0)
            assert got.columns == want.columns and rounded(got) == rounded(want) != []


def test_boosted_models_read_written_windows(spark):
    """The plan of the windows runs once for training and once for judging."""
    passes = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        passes.add(1)
        return float(x)

    df = spark.range(120).select((F.col("id") % 3).cast("int").alias("label"), counted(F.col("id") % 3 + F.col("id") % 2).alias("x"))
    scoring.evaluate_boosted_windows(df, df, ["x"], "label", 3, max_iter=2).collect()
    assert passes.value == 240
