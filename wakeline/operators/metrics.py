"""Evaluation metrics as aggregations.

What an empty denominator gives differs by metric and is kept as published: NaN for a
class recall, 0 for a false-alarm rate, null for rates reported with their denominators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.functions.scalars import argmax, eyes_on_road
from wakeline.operators.percentiles import SHIFTS, exact_percentiles, ordered_bits
from wakeline.operators.segments import scan


def _ratio(num: str | Column, den: str | Column, empty: float | None) -> Column:
    value = F.try_divide(
        (F.col(num) if isinstance(num, str) else num).cast("double"),
        (F.col(den) if isinstance(den, str) else den).cast("double"),
    )
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def _classes(df: DataFrame, n: int, name: str = "class") -> DataFrame:
    """The class numbers 0 … n-1, n rows."""
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias(name))


# --- Counts -----------------------------------------------------------------------------


def bucket_summary(manifest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Samples, distinct subjects and class counts (a map) per bucket.

    Counted by (bucket, subject, label) first, so a big bucket is spread over the subjects.
    """
    cells = manifest.groupBy(*by, "subject_id", "label").agg(F.count(F.lit(1)).alias("n"))
    subjects = (
        cells.groupBy(*by, "subject_id")
        .agg(F.sum("n").alias("n"))
        .groupBy(*by)
        .agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("subjects"))
    )
    labels = class_distribution(cells, by, F.sum("n"))
    maps = labels.groupBy(*by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias(
            "class_distribution"
        )
    )
    return subjects.join(maps, list(by)) if by else subjects.crossJoin(maps)


def class_distribution(
    manifest: DataFrame, by: Sequence[str] = (), count: Column | None = None
) -> DataFrame:
    total = F.count(F.lit(1)) if count is None else count
    return manifest.groupBy(*by, "label").agg(total.alias("n"))


def coverage_table(counts: DataFrame, strict: bool = True) -> DataFrame:
    """Pooled retained share per label and over all labels (label ``all``).

    ``counts`` has (label, feature_rows, crop_rows) per sample.
    """
    features, crops = F.col("feature_rows"), F.col("crop_rows")
    if strict:
        bad = (features < 0) | (crops < 0) | (crops > features)
        wrong = F.raise_error(F.lit("a sample has fewer than 0 rows, or more crops than features"))
        counts = counts.withColumn("crop_rows", F.when(bad, wrong.cast("bigint")).otherwise(crops))
    pooled = counts.rollup("label").agg(
        F.grouping("label").alias("_all"),
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum("feature_rows"), F.lit(0)).alias("feature_rows"),
        F.coalesce(F.sum("crop_rows"), F.lit(0)).alias("crop_rows"),
    )
    return pooled.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("label")).alias("label"),
        "samples",
        "feature_rows",
        "crop_rows",
        _ratio("crop_rows", "feature_rows", None).alias("retained_fraction"),
    )


def row_counts(frames: DataFrame, keys: Sequence[str], has_crop: str) -> DataFrame:
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("feature_rows"), F.count_if(F.col(has_crop)).alias("crop_rows")
    )


def label_coverage(labels: DataFrame, recordings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labelled frames inside and past the end of every recording (keys, n_frames_total).

    Counted per (recording, frame beyond the shared length or not) after a map-side sum.
    """
    joined = recordings.join(labels.select(*keys, "frame"), list(keys), "left")
    return joined.groupBy(*keys, "n_frames_total").agg(
        F.count_if(F.col("frame") < F.col("n_frames_total")).alias("n_frames_labelled"),
        F.count_if(F.col("frame") >= F.col("n_frames_total")).alias("n_labels_past_end"),
    )


# --- Confusion and class recall -----------------------------------------------------------


def _known(column: Column, n_classes: int) -> Column:
    return F.coalesce((column >= 0) & (column < n_classes), F.lit(False))


def confusion_matrix(
    df: DataFrame, true: str, pred: str, n_classes: int, strict: bool = True
) -> DataFrame:
    """Dense n x n counts, zeros included: (y_true, y_pred, n).

    A label or prediction that is no class is an error; when not ``strict`` such pairs
    follow as rows of their own.
    """
    y_true, y_pred = F.col(true).cast("int"), F.col(pred).cast("int")
    counts = df.groupBy(y_true.alias("y_true"), y_pred.alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    every = _classes(df, n_classes, "y_true").withColumn(
        "y_pred", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1)))
    )
    inside = _known(F.col("y_true"), n_classes) & _known(F.col("y_pred"), n_classes)
    if strict:
        alien = F.raise_error(F.lit(f"a label or prediction is none of the {n_classes} classes")).cast("bigint")
        counts = counts.withColumn("n", F.when(inside, F.col("n")).otherwise(alien))
    zeros = every.withColumn("n", F.lit(0).cast("bigint"))
    return zeros.unionByName(counts).groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))


def class_recall(df: DataFrame, true: str, pred: str, n_classes: int, empty: float = float("nan")) -> DataFrame:
    """(class, support, recall) of every class; ``empty`` for classes without a row.

    A prediction that is no class is a miss of its row's class.
    """
    cells = confusion_matrix(df, true, pred, n_classes, strict=False).where(_known(F.col("y_true"), n_classes))
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    per_class = cells.groupBy(F.col("y_true").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(hit).alias("_hit")
    )
    return per_class.select("class", "support", _ratio("_hit", "support", empty).alias("recall"))


def accuracy_and_false_alarms(
    df: DataFrame, true: str, pred: str, alarm_class: int, by: Sequence[str] = ()
) -> DataFrame:
    """Overall accuracy and false-alarm rate, both 0 for an empty denominator."""
    negative = F.col(true) != alarm_class
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(true) == F.col(pred)).alias("_ok"),
        F.count_if(negative).alias("_neg"),
        F.count_if(negative & (F.col(pred) == alarm_class)).alias("_fa"),
    )
    return counts.select(
        *by,
        _ratio("_ok", "_n", 0.0).alias("overall_accuracy"),
        _ratio("_fa", "_neg", 0.0).alias("false_alarm_rate"),
    )


def frame_accuracy(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(true) == F.col(pred)).alias("correct")
    )
    return counts.withColumn("accuracy", _ratio("correct", "n", 0.0))


def auroc_per_class(
    df: DataFrame, true: str, scores: str, n_classes: int
) -> DataFrame:
    """One-vs-rest area under the ROC curve per class, ties counted half.

    The rows of one (class, score) are counted first, and then by their leading bits. Null
    where a class has no positives or no negatives. Two classes are scored by class 1 alone.
    """
    wanted = [1] if n_classes == 2 else list(range(n_classes))
    each = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.get(scores, F.lit(c)).cast("double").alias("score"),
                (F.col(true) == c).alias("hit"),
            )
            for c in wanted
        ]
    )
    cells = (
        df.select(F.inline(each))
        .groupBy("class", "score")
        .agg(F.count_if("hit").alias("_p"), F.count_if(~F.col("hit")).alias("_q"))
    )
    # Two scores compare at the first of their bits that differ. From the last bits to the
    # first: what begins alike is put in order, wins are counted and the cells become one.
    # The window of a beginning holds the values of the next 21 or 22 bits at most.
    cells = cells.where("score is not null").select("class", ordered_bits(F.col("score")).alias("_u"), "_p", "_q", (F.col("_p") * F.col("_q") / 2.0).alias("_w"))
    for _ in SHIFTS[1:]:
        cells = cells.withColumnsRenamed({"_u": "_digit"}).withColumn("_u", F.shiftright("_digit", 21))
        below = F.sum("_q").over(scan(["class", "_u"], "_digit")) - F.col("_q")
        cells = cells.withColumn("_w", F.col("_w") + F.col("_p") * below)
        cells = cells.groupBy("class", "_u").agg(*[F.sum(c).alias(c) for c in ("_p", "_q", "_w")])
    below = F.sum("_q").over(scan(["class"], "_u")) - F.col("_q")
    whole = cells.withColumn("_w", F.col("_w") + F.col("_p") * below).groupBy("class")
    return whole.agg(F.try_divide(F.sum("_w"), F.sum("_p").cast("double") * F.sum("_q")).alias("auroc"))


def macro_auroc(
    df: DataFrame, true: str, scores: str, n_classes: int, strict: bool = True
) -> DataFrame:
    """Unweighted mean of the class areas; a class without both kinds of rows is an error."""
    per_class = auroc_per_class(df, true, scores, n_classes)
    undefined = F.raise_error(F.lit("AUROC is undefined: a class has no positives or no negatives"))
    fallback = undefined.cast("double") if strict else F.lit(None).cast("double")
    whole = F.count("auroc") == (1 if n_classes == 2 else n_classes)
    return per_class.agg(F.when(whole, F.avg("auroc")).otherwise(fallback).alias("macro_auroc"))


def evaluate_predictions(
    df: DataFrame, true: str, pred: str, scores: str, n_classes: int, alarm_class: int
) -> DataFrame:
    """One row: accuracy, macro AUROC, false-alarm rate and the class recalls (a map)."""
    cells = confusion_matrix(df, true, pred, n_classes, strict=False)
    right = F.col("y_true") == F.col("y_pred")
    quiet = F.col("y_true") != alarm_class
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    per_class = cells.groupBy("y_true").agg(
        F.sum("n").alias("_n"),
        total(right).alias("_ok"),
        total(quiet).alias("_neg"),
        total(quiet & (F.col("y_pred") == alarm_class)).alias("_fa"),
    )
    recall = _ratio("_ok", "_n", float("nan"))
    named = F.when(_known(F.col("y_true"), n_classes), F.struct(F.col("y_true").cast("string"), recall))
    entries = F.sort_array(F.collect_list(named))
    rates = per_class.agg(
        _ratio(F.sum("_ok"), F.sum("_n"), 0.0).alias("overall_accuracy"),
        _ratio(F.sum("_fa"), F.sum("_neg"), 0.0).alias("false_alarm_rate"),
        F.map_from_entries(entries).alias("per_class_accuracy"),
    )
    return rates.crossJoin(macro_auroc(df, true, scores, n_classes))  # two single rows


def binary_drowsy_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Windows, drowsy windows, recall (NaN for none), false alarms and accuracy."""
    t, p = F.col(true), F.col(pred)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(t).alias("n_drowsy_true"),
        F.count_if(t & p).alias("_tp"),
        F.count_if(~t & p).alias("_fp"),
        F.count_if(t == p).alias("_ok"),
    )
    return counts.select(
        "n_windows",
        "n_drowsy_true",
        _ratio("_tp", "n_drowsy_true", float("nan")).alias("drowsy_recall"),
        _ratio("_fp", F.col("n_windows") - F.col("n_drowsy_true"), 0.0).alias("false_alarm_rate"),
        _ratio("_ok", "n_windows", 0.0).alias("overall_accuracy"),
    )


def recall_report(
    df: DataFrame, true: str, pred: str, labels: Sequence[str], present_only: bool
) -> DataFrame:
    """Accuracy, balanced accuracy, recalls, supports, absent classes and confusion matrix.

    A class without rows has recall 0; the balanced mean leaves it out when
    ``present_only`` (activity intervals) and keeps it otherwise (eye state).
    """
    n = len(labels)
    names = F.array(*[F.lit(x) for x in labels])
    cells = confusion_matrix(df, true, pred, n)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    row = F.transform(
        F.array_sort(F.collect_list(F.struct("y_pred", "n"))), lambda cell: cell["n"]
    )
    per_class = cells.groupBy("y_true").agg(
        F.sum("n").alias("support"), F.sum(hit).alias("hits"), row.alias("row")
    )
    per_class = per_class.withColumn("recall", _ratio("hits", "support", 0.0)).withColumn(
        "label", F.get(names, F.col("y_true"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("y_true", "label", "recall", "support", "row")))
    present = F.col("support") > 0
    balanced = F.avg(F.when(present, F.col("recall"))) if present_only else F.avg("recall")
    report = per_class.agg(
        _ratio(F.sum("hits"), F.sum("support"), 0.0).alias("overall_accuracy"),
        F.coalesce(balanced, F.lit(0.0)).alias("balanced_accuracy"),
        ordered.alias("_rows"),
    )
    pairs = lambda value: F.map_from_entries(
        F.transform("_rows", lambda r: F.struct(r["label"], r[value]))
    )
    return report.select(
        "overall_accuracy",
        "balanced_accuracy",
        pairs("recall").alias("per_class_recall"),
        pairs("support").alias("support"),
        F.transform(F.filter("_rows", lambda r: r["support"] == 0), lambda r: r["label"]).alias(
            "absent_classes"
        ),
        F.transform("_rows", lambda r: r["row"]).alias("confusion_matrix"),
    )


# --- Interval-level aggregation -----------------------------------------------------------


def mean_probabilities(
    df: DataFrame, key: str, label: str, probs: str, n_classes: int, strict: bool = True
) -> DataFrame:
    """Mean probability vector per interval; mixed labels in one interval are an error."""
    out = df.groupBy(key).agg(
        F.min(label).alias(label),
        F.max(label).alias("_top"),
        F.array(*[F.avg(F.get(probs, F.lit(c)).cast("double")) for c in range(n_classes)]).alias(probs),
    )
    if strict:
        mixed = F.raise_error(F.concat(F.lit("frames disagree about the truth of "), F.col(key).cast("string")))
        same = F.col(label) == F.col("_top")
        out = out.withColumn(label, F.when(same, F.col(label)).otherwise(mixed.cast(out.schema[label].dataType)))
    return out.drop("_top")


def interval_report(
    df: DataFrame, key: str, label: str, probs: str, labels: Sequence[str]
) -> DataFrame:
    means = mean_probabilities(df, key, label, probs, len(labels))
    return recall_report(means.withColumn("_pred", argmax(F.col(probs))), label, "_pred", labels, True)


def majority_vote(
    df: DataFrame,
    keys: Sequence[str],
    true: str,
    pred: str,
    order: str,
    strict: bool = True,
) -> DataFrame:
    """Most frequent prediction per interval, the first seen on a tie.

    Votes are counted per (interval, prediction) before an interval is put together.
    """
    votes = df.groupBy(*keys, pred).agg(
        F.count(F.lit(1)).alias("_votes"),
        F.min(order).alias("_first"),
        F.min(true).alias("_lo"),
        F.max(true).alias("_hi"),
    )
    out = votes.groupBy(*keys).agg(
        F.min("_lo").alias(true),
        F.max("_hi").alias("_hi"),
        F.max_by(pred, F.struct(F.col("_votes"), -F.col("_first"))).alias(pred),
    )
    if strict:
        several = F.raise_error(F.lit("an interval has more than one true label"))
        same = F.col(true).eqNullSafe(F.col("_hi"))
        out = out.withColumn(true, F.when(same, F.col(true)).otherwise(several.cast(out.schema[true].dataType)))
    return out.drop("_hi")


def road_rates(
    df: DataFrame, true: str, pred: str, by: Sequence[str] = (), on_road=eyes_on_road
) -> DataFrame:
    """Eyes-off-road false-alarm and detection rates with their denominators."""
    truth, said = on_road(F.col(true)), on_road(F.col(pred))
    counts = df.groupBy(*by).agg(
        F.count_if(truth).alias("n_on_road"),
        F.count_if(~truth).alias("n_off_road"),
        F.count_if(truth & ~said).alias("false_alarms"),
        F.count_if(~truth & ~said).alias("detected"),
    )
    return counts.withColumns(
        {
            "false_alarm_rate": _ratio("false_alarms", "n_on_road", None),
            "detection_rate": _ratio("detected", "n_off_road", None),
        }
    )


def zone_accuracy(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(zone, n, correct, accuracy) per zone and over all zones (zone ``all``)."""
    counts = df.rollup(true).agg(
        F.grouping(true).alias("_all"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(true) == F.col(pred)).alias("correct"),
    )
    return counts.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col(true)).alias("zone"),
        "n",
        "correct",
        _ratio("correct", "n", None).alias("accuracy"),
    )


def subject_report(
    frame_predictions: DataFrame,
    subject: str,
    interval: Sequence[str],
    true: str,
    pred: str,
    order: str,
    on_road=eyes_on_road,
) -> DataFrame:
    """Zone accuracy and road rates per held-out subject and pooled (subject ``all``),
    for frames and for intervals by majority vote."""
    votes = majority_vote(frame_predictions, [subject, *interval], true, pred, order)
    both = (
        frame_predictions.select(subject, true, pred)
        .withColumn("level", F.lit("frame"))
        .unionByName(votes.select(subject, true, pred).withColumn("level", F.lit("interval")))
    )
    truth, said = on_road(F.col(true)), on_road(F.col(pred))
    counts = both.groupingSets([["level", subject], ["level"]], "level", subject).agg(
        F.grouping(subject).alias("_all"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(true) == F.col(pred)).alias("correct"),
        F.count_if(truth).alias("n_on_road"),
        F.count_if(~truth).alias("n_off_road"),
        F.count_if(truth & ~said).alias("false_alarms"),
        F.count_if(~truth & ~said).alias("detected"),
    )
    return counts.select(
        "level",
        F.when(F.col("_all") == 1, "all").otherwise(F.col(subject).cast("string")).alias("subject"),
        "n",
        "correct",
        "n_on_road",
        "n_off_road",
        "false_alarms",
        "detected",
        _ratio("correct", "n", None).alias("accuracy"),
        _ratio("false_alarms", "n_on_road", None).alias("false_alarm_rate"),
        _ratio("detected", "n_off_road", None).alias("detection_rate"),
    )


# --- Videos -------------------------------------------------------------------------------


def precision_recall(scored: DataFrame, truth: Column, fired: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision and recall (0 for no denominator) over one row per video."""
    counts = scored.groupBy(*by).agg(
        F.count_if(truth & fired).alias("tp"),
        F.count_if(~truth & fired).alias("fp"),
        F.count_if(truth & ~fired).alias("fn"),
    )
    return counts.withColumns(
        {
            "precision": _ratio("tp", F.col("tp") + F.col("fp"), 0.0),
            "recall": _ratio("tp", F.col("tp") + F.col("fn"), 0.0),
        }
    )


def video_report(scored: DataFrame, label: str, fired: Column, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and talking false-positive rate, null for no denominator."""
    parts = F.split(F.col(label), "&")
    truth = F.array_contains(parts, "Yawning")
    talking = F.array_contains(parts, "Talking") & ~truth
    counts = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_videos"),
        F.count_if(truth).alias("n_yawning_true"),
        F.count_if(truth & fired).alias("tp"),
        F.count_if(~truth & fired).alias("fp"),
        F.count_if(talking).alias("_talking"),
        F.count_if(talking & fired).alias("_talking_fp"),
    )
    return counts.select(
        *by,
        "n_videos",
        "n_yawning_true",
        "tp",
        "fp",
        (F.col("n_yawning_true") - F.col("tp")).alias("fn"),
        _ratio("tp", F.col("tp") + F.col("fp"), None).alias("precision"),
        _ratio("tp", "n_yawning_true", None).alias("recall"),
        _ratio("_talking_fp", "_talking", None).alias("talking_false_positive_rate"),
    )


def category_counts(scored: DataFrame, label: str, fired: Column) -> DataFrame:
    return scored.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fired).alias("predicted_yawning")
    )


def video_scores(
    videos: DataFrame, events: DataFrame, keys: Sequence[str], score: str = "score"
) -> DataFrame:
    """Highest event score of every video; videos without an event score 0."""
    best = events.groupBy(*keys).agg(F.max(score).alias("score"))
    return videos.join(best, list(keys), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


# --- Weights, pooling, latency --------------------------------------------------------------


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """Most frequent class, the lowest on a tie; no rows is an error."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.agg(F.max_by(label, F.struct(F.col("_n"), -F.col(label))).alias("majority_class"))
    empty = F.raise_error(F.lit("cannot fit a majority class on no rows")).cast("int")
    return best.select(F.coalesce(F.col("majority_class").cast("int"), empty).alias("majority_class"))


def class_weights(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """Inverse-frequency weights total / (n_classes * max(count, 1)) of every class."""
    counts = df.groupBy(F.col(label).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    dense = _classes(df, n_classes).join(counts, ["class"], "left")
    n = F.coalesce("n", F.lit(0))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_total"))  # every row, a class or not
    weight = F.col("_total") / (F.lit(n_classes) * F.greatest(n, F.lit(1)))
    return dense.crossJoin(F.broadcast(total)).select("class", n.alias("n"), weight.alias("weight"))


def pooled_vectors(
    df: DataFrame, keys: Sequence[str], vector: str, dim: int, out: str = "features"
) -> DataFrame:
    """Element-wise mean followed by element-wise maximum of the vectors of a group."""
    at = lambda i: F.get(vector, F.lit(i)).cast("double")
    mean = [F.avg(at(i)) for i in range(dim)]
    peak = [F.max(at(i)) for i in range(dim)]
    return df.groupBy(*keys).agg(F.array(*mean, *peak).alias(out))


def throughput(
    df: DataFrame,
    keys: Sequence[str],
    latency_ms: Column,
    face: Column,
    elapsed_s: Column,
) -> DataFrame:
    """Frames, frames per second, median and p95 latency and face rate per group.

    ``elapsed_s`` is an aggregate; no time elapsed means 0 frames per second.
    """
    base = df.withColumns({"_ms": latency_ms, "_face": face})
    counts = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if("_face").alias("_faces"), elapsed_s.alias("_s")
    )
    points = exact_percentiles(base, keys, "_ms", {"lat_ms_p50": 0.5, "lat_ms_p95": 0.95})
    joined = counts.join(points, list(keys)) if keys else counts.crossJoin(points)
    fps = F.when(F.col("_s") > 0, F.col("frames") / F.col("_s")).otherwise(0.0)
    return joined.select(
        *keys, "frames", fps.alias("fps"), "lat_ms_p50", "lat_ms_p95", _ratio("_faces", "frames", 0.0).alias("face_rate")
    )


def latency_report(df: DataFrame, keys: Sequence[str], latency_ms: str) -> DataFrame:
    """Mean, median, p95 and 1000 / mean (infinite for no time) per model."""
    means = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.avg(latency_ms).alias("mean_ms"))
    points = exact_percentiles(df, keys, latency_ms, {"p50_ms": 0.5, "p95_ms": 0.95})
    rate = F.when(F.col("mean_ms") > 0, 1000.0 / F.col("mean_ms")).otherwise(float("inf"))
    return means.join(points, list(keys)).withColumn("fps", rate)


def standardise(
    df: DataFrame, train: Column, columns: Sequence[str], floor: float = 1e-6
) -> DataFrame:
    """Centre and scale by the mean and population deviation of the training rows.

    A constant column is left unscaled. The statistics are a single broadcast row.
    """
    stats = df.filter(train).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns],
    )
    scaled = df.crossJoin(F.broadcast(stats))
    spread = lambda c: F.when(F.col(f"_s_{c}") < floor, 1.0).otherwise(F.col(f"_s_{c}"))
    return scaled.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / spread(c) for c in columns}).select(
        *df.columns
    )


def constant_predictions(df: DataFrame, majority: DataFrame, n_classes: int) -> DataFrame:
    """One-hot probabilities at the majority class (a single row) for every frame."""
    hot = F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda i: (i == F.col("majority_class")).cast("double"),
    )
    return df.crossJoin(F.broadcast(majority)).withColumn("probabilities", hot).drop("majority_class")
