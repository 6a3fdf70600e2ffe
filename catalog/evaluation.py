"""Evaluation operators: metrics, sweeps and selections, splits and folds, models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from catalog.base import (
    CLIPS,
    EV,
    LEVELS,
    LF,
    VIDEOS,
    clip_labels,
    event_frames,
    event_rows,
    fold_sql,
    long_frames,
    query,
    r6,
    table,
    video_labels,
)
from catalog.sequences import _RUNS, mouth_frames, rolled_levels
from wakeline.functions.scalars import argmax, deploy_decision, is_yawning, one_hot, softmax
from wakeline.operators import metrics, percentiles, runs, scoring, splits, sweeps
from wakeline.operators.segments import cut
from wakeline.plans import fatigue, yawning

def rounded(df, *columns):
    return df.select(*[r6(c).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- Predictions: two classes from labels, three from line items -----------------------------

_THREE = """three AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t,
  CASE WHEN l_quantity < 18 THEN 0 WHEN l_quantity < 35 THEN 1 ELSE 2 END AS p,
  l_quantity / 50.0 AS s0, l_discount * 10 AS s1, l_tax * 10 + l_linenumber AS s2 FROM lineitem)"""


def three_class(spark, sf):
    q = F.col("l_quantity")
    true = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    scores = F.array(q / 50.0, F.col("l_discount") * 10, F.col("l_tax") * 10 + F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select(
        true.alias("t"), F.when(q < 18, 0).when(q < 35, 1).otherwise(2).alias("p"), scores.alias("scores")
    )


def two_class(spark, sf):
    return table(spark, sf, "labels")


@query(
    "confusion_matrix",
    f"""WITH {_THREE}, c AS (SELECT unnest(range(0, 4)) AS c)
        SELECT CAST(a.c AS INTEGER) AS y_true, CAST(b.c AS INTEGER) AS y_pred,
          (SELECT count(*) FROM three WHERE t = a.c AND p = b.c) AS n FROM c AS a, c AS b""",
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(three_class(spark, sf), "t", "p", 4)


@query(
    "class_recall",
    f"""WITH {_THREE} SELECT t AS class, count(*) AS support, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS recall
        FROM three GROUP BY t UNION ALL SELECT 3, 0, CAST('nan' AS DOUBLE)""",
)
def class_recall(spark, sf):
    out = metrics.class_recall(three_class(spark, sf), "t", "p", 4)
    return out.withColumn("recall", F.when(F.isnan("recall"), F.col("recall")).otherwise(r6("recall")))


@query(
    "accuracy_and_false_alarms",
    f"""WITH {_THREE} SELECT round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS overall_accuracy,
        round(count(*) FILTER (t <> 2 AND p = 2) / CAST(count(*) FILTER (t <> 2) AS DOUBLE), 6) AS false_alarm_rate FROM three""",
)
def accuracy_and_false_alarms(spark, sf):
    out = metrics.accuracy_and_false_alarms(three_class(spark, sf), "t", "p", 2)
    return rounded(out, "overall_accuracy", "false_alarm_rate")


# Mann-Whitney over average ranks, class by class.
_AUROC = f"""{_THREE}, each AS (SELECT 0 AS c, t = 0 AS hit, s0 AS s FROM three UNION ALL SELECT 1, t = 1, s1 FROM three
    UNION ALL SELECT 2, t = 2, s2 FROM three),
  ranked AS (SELECT c, hit, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0 AS r FROM each),
  areas AS (SELECT c, (sum(CASE WHEN hit THEN r ELSE 0 END) - count(*) FILTER (hit) * (count(*) FILTER (hit) + 1) / 2.0)
    / (count(*) FILTER (hit) * CAST(count(*) FILTER (NOT hit) AS DOUBLE)) AS auroc FROM ranked GROUP BY c)"""


@query("macro_auroc", f"WITH {_AUROC} SELECT round(avg(auroc), 6) AS macro_auroc FROM areas")
def macro_auroc(spark, sf):
    return rounded(metrics.macro_auroc(three_class(spark, sf), "t", "scores", 3), "macro_auroc")


@query(
    "evaluate_predictions",
    f"""WITH {_AUROC}, r AS (SELECT t, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS recall FROM three GROUP BY t)
        SELECT (SELECT round(avg(auroc), 6) FROM areas) AS macro_auroc,
          (SELECT round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) FROM three) AS overall_accuracy,
          (SELECT round(count(*) FILTER (t <> 2 AND p = 2) / CAST(count(*) FILTER (t <> 2) AS DOUBLE), 6) FROM three) AS false_alarm_rate,
          (SELECT round(recall, 6) FROM r WHERE t = 0) AS recall_0, (SELECT round(recall, 6) FROM r WHERE t = 1) AS recall_1,
          (SELECT round(recall, 6) FROM r WHERE t = 2) AS recall_2""",
)
def evaluate_predictions(spark, sf):
    out = metrics.evaluate_predictions(three_class(spark, sf), "t", "p", "scores", 3, 2)
    recalls = [r6(F.col("per_class_accuracy")[str(c)]).alias(f"recall_{c}") for c in range(3)]
    return out.select(
        r6("macro_auroc").alias("macro_auroc"),
        r6("overall_accuracy").alias("overall_accuracy"),
        r6("false_alarm_rate").alias("false_alarm_rate"),
        *recalls,
    )


@query(
    "binary_drowsy_report",
    """SELECT count(*) AS n_windows, count(*) FILTER (quality = 1) AS n_drowsy_true,
       round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) FILTER (quality = 1), 6) AS drowsy_recall,
       round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) FILTER (quality = 0), 6) AS false_alarm_rate,
       round(avg(CASE WHEN toxic = quality THEN 1.0 ELSE 0.0 END), 6) AS overall_accuracy FROM labels""",
)
def binary_drowsy_report(spark, sf):
    pairs = two_class(spark, sf).select((F.col("quality") == 1).alias("t"), (F.col("toxic") == 1).alias("p"))
    out = metrics.binary_drowsy_report(pairs, "t", "p")
    return rounded(out, "drowsy_recall", "false_alarm_rate", "overall_accuracy")


@query(
    "eye_state_report",
    """WITH r AS (SELECT quality AS t, count(*) AS n, count(*) FILTER (toxic = quality) AS ok FROM labels GROUP BY quality)
       SELECT round(sum(ok) / CAST(sum(n) AS DOUBLE), 6) AS overall_accuracy, round(avg(ok / CAST(n AS DOUBLE)), 6) AS balanced_accuracy,
         round(max(ok / CAST(n AS DOUBLE)) FILTER (t = 0), 6) AS recall_closed, round(max(ok / CAST(n AS DOUBLE)) FILTER (t = 1), 6) AS recall_open,
         CAST(max(n) FILTER (t = 0) AS BIGINT) AS support_closed, CAST(max(n) FILTER (t = 1) AS BIGINT) AS support_open,
         (SELECT count(*) FROM labels WHERE quality = 0 AND toxic = 1) AS closed_called_open FROM r""",
)
def eye_state_report(spark, sf):
    out = metrics.recall_report(two_class(spark, sf), "quality", "toxic", ["closed", "open"], present_only=False)
    return out.select(
        r6("overall_accuracy").alias("overall_accuracy"),
        r6("balanced_accuracy").alias("balanced_accuracy"),
        *[r6(F.col("per_class_recall")[c]).alias(f"recall_{c}") for c in ("closed", "open")],
        *[F.col("support")[c].alias(f"support_{c}") for c in ("closed", "open")],
        F.col("confusion_matrix")[0][1].alias("closed_called_open"),
    )


# --- Intervals of frames -----------------------------------------------------------------------

_INTERVALS = """p AS (SELECT l_orderkey AS k, l_quantity AS a, l_discount * 400 AS b, l_tax * 300 + 10 AS c FROM lineitem),
  q AS (SELECT k, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM p),
  m AS (SELECT k, CAST(k % 4 AS INTEGER) AS label, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM q GROUP BY k)"""


def interval_probabilities(spark, sf):
    a, b, c = F.col("l_quantity"), F.col("l_discount") * 400, F.col("l_tax") * 300 + 10
    total = a + b + c
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        (F.col("l_orderkey") % 4).cast("int").alias("label"),
        F.array(a / total, b / total, c / total, F.lit(0.0), F.lit(0.0)).alias("probs"),
    )


@query(
    "mean_probabilities",
    f"WITH {_INTERVALS} SELECT k, label, round(a, 6) AS p0, round(b, 6) AS p1, round(c, 6) AS p2 FROM m",
)
def mean_probabilities(spark, sf):
    out = metrics.mean_probabilities(interval_probabilities(spark, sf), "k", "label", "probs", 5)
    return out.select("k", "label", *[r6(F.get("probs", F.lit(i))).alias(f"p{i}") for i in range(3)])


@query(
    "interval_report",
    f"""WITH {_INTERVALS}, e AS (SELECT label AS t, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS p FROM m),
        r AS (SELECT t, count(*) AS n, count(*) FILTER (t = p) AS ok FROM e GROUP BY t)
        SELECT round(sum(ok) / CAST(sum(n) AS DOUBLE), 6) AS overall_accuracy, round(avg(ok / CAST(n AS DOUBLE)), 6) AS balanced_accuracy,
          round(max(ok / CAST(n AS DOUBLE)) FILTER (t = 0), 6) AS recall_a, CAST(max(n) FILTER (t = 3) AS BIGINT) AS support_d,
          'e' AS absent FROM r""",
)
def interval_report(spark, sf):
    out = metrics.interval_report(interval_probabilities(spark, sf), "k", "label", "probs", list("abcde"))
    return out.select(
        r6("overall_accuracy").alias("overall_accuracy"),
        r6("balanced_accuracy").alias("balanced_accuracy"),
        r6(F.col("per_class_recall")["a"]).alias("recall_a"),
        F.col("support")["d"].alias("support_d"),
        F.concat_ws(",", "absent_classes").alias("absent"),
    )


_VOTES = """v AS (SELECT conv_id, conv_id % 3 AS t, role, count(*) AS n, min(turn) AS first FROM conversations GROUP BY conv_id, role),
  votes AS (SELECT conv_id, ['user', 'assistant', 'system'][t + 1] AS truth, role FROM
    (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS rn FROM v) AS x WHERE rn = 1)"""


def conversation_votes(spark, sf):
    names = F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))
    truth = F.get(names, (F.col("conv_id") % 3).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", truth.alias("truth"), "role")


@query("majority_vote", f"WITH {_VOTES} SELECT conv_id, truth, role FROM votes")
def majority_vote(spark, sf):
    return metrics.majority_vote(conversation_votes(spark, sf), ["conv_id"], "truth", "role", "turn")


def on_user(column: Column) -> Column:
    return column == "user"


_RATES = """count(*) FILTER (truth = 'user') AS n_on_road, count(*) FILTER (truth <> 'user') AS n_off_road,
  count(*) FILTER (truth = 'user' AND role <> 'user') AS false_alarms, count(*) FILTER (truth <> 'user' AND role <> 'user') AS detected,
  round(count(*) FILTER (truth = 'user' AND role <> 'user') / nullif(CAST(count(*) FILTER (truth = 'user') AS DOUBLE), 0), 6) AS false_alarm_rate,
  round(count(*) FILTER (truth <> 'user' AND role <> 'user') / nullif(CAST(count(*) FILTER (truth <> 'user') AS DOUBLE), 0), 6) AS detection_rate"""


@query("road_rates", f"WITH {_VOTES} SELECT {_RATES} FROM votes")
def road_rates(spark, sf):
    votes = majority_vote(spark, sf)
    return rounded(
        metrics.road_rates(votes, "truth", "role", on_road=on_user), "false_alarm_rate", "detection_rate"
    )


@query(
    "zone_accuracy",
    f"""WITH {_VOTES} SELECT coalesce(truth, 'all') AS zone, count(*) AS n, count(*) FILTER (truth = role) AS correct,
          round(avg(CASE WHEN truth = role THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM votes GROUP BY ROLLUP (truth)""",
)
def zone_accuracy(spark, sf):
    return rounded(metrics.zone_accuracy(majority_vote(spark, sf), "truth", "role"), "accuracy")


@query(
    "subject_report",
    f"""WITH f AS (SELECT conv_id % 7 AS subject, conv_id, turn, ['user', 'assistant', 'system'][conv_id % 3 + 1] AS truth, role FROM conversations),
        {_VOTES}, b AS (SELECT 'frame' AS level, subject, truth, role FROM f
          UNION ALL SELECT 'interval', conv_id % 7, truth, role FROM votes)
        SELECT level, CASE WHEN grouping(subject) = 1 THEN 'all' ELSE CAST(subject AS VARCHAR) END AS subject, count(*) AS n,
          count(*) FILTER (truth = role) AS correct, round(avg(CASE WHEN truth = role THEN 1.0 ELSE 0.0 END), 6) AS accuracy, {_RATES}
        FROM b GROUP BY GROUPING SETS ((level, subject), (level))""",
)
def subject_report(spark, sf):
    frames = conversation_votes(spark, sf).withColumn("subject", F.col("conv_id") % 7)
    out = metrics.subject_report(frames, "subject", ["conv_id"], "truth", "role", "turn", on_user)
    return rounded(out, "accuracy", "false_alarm_rate", "detection_rate")


# --- Counts, coverage, weights, pooling ----------------------------------------------------------


@query(
    "bucket_summary",
    """SELECT count(*) AS samples, count(DISTINCT c_nationkey) AS subjects, count(*) FILTER (c_mktsegment = 'BUILDING') AS building,
       count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer""",
)
def bucket_summary(spark, sf):
    out = metrics.bucket_summary(manifest(spark, sf))
    return out.select(
        "samples",
        "subjects",
        F.col("class_distribution")["BUILDING"].alias("building"),
        F.col("class_distribution")["MACHINERY"].alias("machinery"),
    )


@query(
    "crop_coverage",
    f"""WITH {EV}, {VIDEOS}, c AS (SELECT s, count(*) AS f, count(*) FILTER (value >= 60 AND face) AS r FROM ev GROUP BY s)
        SELECT coalesce(label, 'all') AS label, count(*) AS samples, CAST(sum(f) AS BIGINT) AS feature_rows, CAST(sum(r) AS BIGINT) AS crop_rows,
          round(sum(r) / CAST(sum(f) AS DOUBLE), 6) AS retained_fraction FROM c JOIN videos USING (s) GROUP BY ROLLUP (label)""",
)
def crop_coverage(spark, sf):
    rows = event_rows(spark, sf).withColumn("crop", (F.col("value") >= 60) & F.col("face"))
    counts = metrics.row_counts(rows, ["s"], "crop").join(video_labels(spark, sf), ["s"])
    return rounded(metrics.coverage_table(counts), "retained_fraction")


@query(
    "row_counts",
    f"WITH {EV} SELECT s, count(*) AS feature_rows, count(*) FILTER (value >= 60 AND face) AS crop_rows FROM ev GROUP BY s",
)
def row_counts(spark, sf):
    rows = event_rows(spark, sf).withColumn("crop", (F.col("value") >= 60) & F.col("face"))
    return metrics.row_counts(rows, ["s"], "crop")


@query(
    "label_coverage",
    f"""WITH {EV}, r AS (SELECT user_id AS s, 50 + user_id % 20 AS n FROM (SELECT DISTINCT user_id FROM events) AS u)
        SELECT r.s, n AS n_frames_total, count(*) FILTER (frame < n) AS n_frames_labelled, count(*) FILTER (frame >= n) AS n_labels_past_end
        FROM r LEFT JOIN ev ON ev.s = r.s AND zone <> 'error' GROUP BY r.s, n""",
)
def label_coverage(spark, sf):
    frames, _ = event_frames(spark, sf)
    recordings = frames.select("s").distinct().withColumn("n_frames_total", 50 + F.col("s") % 20)
    return metrics.label_coverage(frames.filter("zone != 'error'"), recordings, ["s"])


@query(
    "class_weights",
    """SELECT CAST(c AS INTEGER) AS class, count(label) AS n, round((SELECT count(*) FROM embeddings) / (12.0 * greatest(count(label), 1)), 6) AS weight
       FROM (SELECT unnest(range(0, 12)) AS c) AS t LEFT JOIN embeddings ON label = c GROUP BY c""",
)
def class_weights(spark, sf):
    return rounded(metrics.class_weights(table(spark, sf, "embeddings"), "label", 12), "weight")


@query(
    "majority_class",
    "SELECT CAST(label AS INTEGER) AS majority_class FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1",
)
def majority_class(spark, sf):
    return metrics.majority_class(table(spark, sf, "embeddings"), "label")


@query(
    "constant_predictions",
    """WITH m AS (SELECT label AS m FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
       SELECT vec_id, CAST(m AS INTEGER) AS predicted, 1.0::DOUBLE AS mass FROM embeddings, m""",
)
def constant_predictions(spark, sf):
    vectors = table(spark, sf, "embeddings")
    out = metrics.constant_predictions(vectors, metrics.majority_class(vectors, "label"), 10)
    mass = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    top = F.array_position("probabilities", F.lit(1.0)).cast("int") - 1
    return out.select("vec_id", top.alias("predicted"), mass.alias("mass"))


@query(
    "frame_accuracy",
    f"""WITH {_THREE} SELECT count(*) AS n, count(*) FILTER (t = p) AS correct,
          round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM three""",
)
def frame_accuracy(spark, sf):
    return rounded(metrics.frame_accuracy(three_class(spark, sf), "t", "p"), "accuracy")


@query(
    "pooled_vectors",
    """WITH e AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings)
       SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(max(CAST(x AS DOUBLE)), 6) AS peak
       FROM e GROUP BY label, i""",
)
def pooled_vectors(spark, sf):
    out = metrics.pooled_vectors(table(spark, sf, "embeddings"), ["label"], "embedding", 64)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(
        i.alias("i"), F.get("features", i).alias("mean"), F.get("features", i + 64).alias("peak")))
    return rounded(out.select("label", F.inline(pairs)), "mean", "peak")


@query(
    "threshold_at_percentile",
    "SELECT round(quantile_cont(value, 0.99), 6) AS threshold FROM events",
)
def threshold_at_percentile(spark, sf):
    return rounded(percentiles.threshold_at_percentile(table(spark, sf, "events"), "value"), "threshold")


@query(
    "exact_percentiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS q2,
       round(quantile_cont(l_extendedprice, 0.95), 6) AS q95 FROM lineitem GROUP BY 1""",
)
def exact_percentiles(spark, sf):
    points = {"q1": 0.25, "q2": 0.5, "q95": 0.95}
    out = percentiles.exact_percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", points)
    return rounded(out, *points)


@query(
    "throughput",
    f"""WITH {EV} SELECT zone, count(*) AS frames, round(count(*) / ((max(us) - min(us)) / 1000000.0), 6) AS fps,
          round(quantile_cont(value, 0.5), 6) AS lat_ms_p50, round(quantile_cont(value, 0.95), 6) AS lat_ms_p95,
          round(avg(CASE WHEN face THEN 1.0 ELSE 0.0 END), 6) AS face_rate FROM ev GROUP BY zone""",
)
def throughput(spark, sf):
    elapsed = (F.max("us") - F.min("us")) / 1e6
    rows = event_rows(spark, sf)
    out = metrics.throughput(rows, ["zone"], F.col("value"), F.col("face"), elapsed)
    return rounded(out, "fps", "lat_ms_p50", "lat_ms_p95", "face_rate")


@query(
    "latency_report",
    """SELECT l_linestatus, count(*) AS runs, round(avg(l_quantity), 6) AS mean_ms, round(quantile_cont(l_quantity, 0.5), 6) AS p50_ms,
       round(quantile_cont(l_quantity, 0.95), 6) AS p95_ms, round(1000.0 / avg(l_quantity), 6) AS fps FROM lineitem GROUP BY 1""",
)
def latency_report(spark, sf):
    out = metrics.latency_report(table(spark, sf, "lineitem"), ["l_linestatus"], "l_quantity")
    return rounded(out, "mean_ms", "p50_ms", "p95_ms", "fps")


@query(
    "standardise",
    """WITH st AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS stx
         FROM lineitem WHERE l_returnflag <> 'R')
       SELECT l_suppkey, l_linenumber, count(*) AS n, round(sum((l_quantity - mq) / sq), 4) AS ear, round(sum((l_tax - mt) / stx), 4) AS mar,
         0.0::DOUBLE AS flat FROM lineitem, st GROUP BY 1, 2""",
)
def standardise(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("ear"), F.col("l_tax").alias("mar"), F.lit(3.0).alias("flat")
    )
    out = metrics.standardise(items, F.col("l_returnflag") != "R", ["ear", "mar", "flat"])
    return out.groupBy("l_suppkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("ear"), 4).alias("ear"),
        F.round(F.sum("mar"), 4).alias("mar"),
        F.round(F.sum("flat"), 6).alias("flat"),
    )


# --- Sweeps and selections ------------------------------------------------------------------------

_DURATIONS = f"""{_RUNS}, {VIDEOS}, l AS (SELECT s, max(length) AS longest FROM runs GROUP BY s),
  v AS (SELECT contains('&' || label || '&', '&Yawning&') AS y, coalesce(longest, 0) AS longest FROM videos LEFT JOIN l USING (s)),
  d AS (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS min_duration),
  c AS (SELECT min_duration, count(*) FILTER (y AND longest >= min_duration) AS tp, count(*) FILTER (NOT y AND longest >= min_duration) AS fp,
    count(*) FILTER (y AND longest < min_duration) AS fn FROM v, d GROUP BY min_duration),
  sweep AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall FROM c)"""


@query(
    "duration_sweep",
    f"WITH {_DURATIONS} SELECT min_duration, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sweep",
)
def duration_sweep(spark, sf):
    frames, rows = mouth_frames(spark, sf)
    longest = yawning.longest_runs(frames, video_labels(spark, sf), ["s"], "frame", "mar", 40.0, rows)
    return rounded(yawning.sweep_durations(longest, range(1, 21))[0], "precision", "recall")


@query(
    "duration_selection",
    f"""WITH {_DURATIONS} SELECT min_duration, round(precision, 6) AS precision, round(recall, 6) AS recall, recall >= 0.9 AS floor_met FROM sweep
        ORDER BY recall >= 0.9 DESC, CASE WHEN recall >= 0.9 THEN precision ELSE recall END DESC, min_duration LIMIT 1""",
)
def duration_selection(spark, sf):
    frames, rows = mouth_frames(spark, sf)
    longest = yawning.longest_runs(frames, video_labels(spark, sf), ["s"], "frame", "mar", 40.0, rows)
    return rounded(yawning.sweep_durations(longest, range(1, 21))[1], "precision", "recall")


_TAUS = f"""{_RUNS}, {VIDEOS}, sc AS (SELECT s, max(peak / 200.0) AS score FROM runs WHERE length >= 2 GROUP BY s),
  v AS (SELECT s, contains('&' || label || '&', '&Yawning&') AS y, coalesce(score, 0.0) AS score FROM videos LEFT JOIN sc USING (s)),
  t AS (SELECT unnest(range(0, 101)) / CAST(100 AS DOUBLE) AS tau),
  c AS (SELECT tau, count(*) FILTER (y AND score >= tau) AS tp, count(*) FILTER (NOT y AND score >= tau) AS fp,
    count(*) FILTER (y AND score < tau) AS fn FROM v, t GROUP BY tau),
  sweep AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall FROM c)"""


def scored_videos(spark, sf):
    frames, rows = mouth_frames(spark, sf)
    events = runs.event_runs(frames, ["s"], "frame", "mar", 40.0, 2, rows).withColumn("score", F.col("peak") / 200.0)
    return metrics.video_scores(video_labels(spark, sf), events, ["s"])


@query("video_scores", f"WITH {_TAUS} SELECT s, round(score, 6) AS score FROM v")
def video_scores(spark, sf):
    return scored_videos(spark, sf).select("s", r6("score").alias("score"))


@query(
    "tau_sweep",
    f"WITH {_TAUS} SELECT round(tau, 6) AS tau, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sweep",
)
def tau_sweep(spark, sf):
    return rounded(yawning.select_tau(scored_videos(spark, sf))[0], "tau", "precision", "recall")


@query(
    "tau_selection",
    f"""WITH {_TAUS} SELECT round(tau, 6) AS tau, round(precision, 6) AS precision, round(recall, 6) AS recall, recall >= 0.9 AS floor_met FROM sweep
        ORDER BY recall >= 0.9 DESC, CASE WHEN recall >= 0.9 THEN precision ELSE recall END DESC, tau LIMIT 1""",
)
def tau_selection(spark, sf):
    return rounded(yawning.select_tau(scored_videos(spark, sf))[1], "tau", "precision", "recall")


@query(
    "threshold_curve",
    f"""WITH {EV}, {VIDEOS}, p AS (SELECT s, max(value) AS peak FROM ev WHERE face GROUP BY s),
        v AS (SELECT contains('&' || label || '&', '&Yawning&') AS y, peak FROM videos JOIN p USING (s)),
        t AS (SELECT CAST(unnest([100, 150, 200, 250, 1000]) AS DOUBLE) AS threshold)
        SELECT threshold, round(count(*) FILTER (y AND peak >= threshold) / nullif(CAST(count(*) FILTER (peak >= threshold) AS DOUBLE), 0), 6) AS precision,
          round(count(*) FILTER (y AND peak >= threshold) / nullif(CAST(count(*) FILTER (y) AS DOUBLE), 0), 6) AS recall FROM v, t GROUP BY threshold""",
)
def threshold_curve(spark, sf):
    faces = event_rows(spark, sf).filter("face")
    peaks = faces.groupBy("s").agg(F.max("value").alias("peak")).join(video_labels(spark, sf), ["s"])
    out = sweeps.threshold_curve(peaks, "peak", "label", [100.0, 150.0, 200.0, 250.0, 1000.0])
    return rounded(out, "precision", "recall")


def _sweep_sql(threshold: int) -> str:
    grid = """grid AS (SELECT row_number() OVER (ORDER BY e, d, a) - 1 AS pos, * FROM (SELECT CAST(unnest([3, 5, 8, 12]) AS INTEGER) AS e) AS x,
      (SELECT CAST(unnest([8, 15, 25, 40]) AS INTEGER) AS d) AS y, (SELECT CAST(unnest([15, 30, 45, 90]) AS INTEGER) AS a) AS z)"""
    fold = fold_sql("src", extra="pos")
    return f"""WITH RECURSIVE {LF}, {CLIPS}, {LEVELS}, {grid},
      src AS (SELECT s, frame, level, pos, e, d, a FROM levels, grid), {fold},
      tiers AS (SELECT s, pos, frame, CASE WHEN committed = 2 AND held >= a THEN 3 ELSE committed END AS tier FROM fold),
      rises AS (SELECT s, pos, frame FROM (SELECT *, lag(tier, 1, 0) OVER (PARTITION BY s, pos ORDER BY frame) AS prev FROM tiers) AS t
        WHERE tier >= {threshold} AND prev < {threshold}),
      n AS (SELECT s, label, count(*) AS n FROM lf JOIN clips USING (s) GROUP BY s, label),
      per AS (SELECT n.s, label, n, grid.pos, count(rises.frame) AS alarms, min(rises.frame) AS first
        FROM n CROSS JOIN grid LEFT JOIN rises ON rises.s = n.s AND rises.pos = grid.pos GROUP BY n.s, label, n, grid.pos),
      swept AS (SELECT pos, count(*) AS n_clips, count(*) FILTER (label <> 'drowsy') AS n_not_drowsy_clips, count(*) FILTER (label = 'drowsy') AS n_drowsy_clips,
        sum(alarms) FILTER (label <> 'drowsy') / (sum(n) FILTER (label <> 'drowsy') / 10.0 / 3600) AS fa,
        count(*) FILTER (label <> 'drowsy' AND alarms > 0) / CAST(count(*) FILTER (label <> 'drowsy') AS DOUBLE) AS fraction,
        sum(alarms) FILTER (label = 'alert') / (sum(n) FILTER (label = 'alert') / 10.0 / 3600) AS fa_alert,
        count(*) FILTER (label = 'drowsy' AND alarms > 0) / CAST(count(*) FILTER (label = 'drowsy') AS DOUBLE) AS detection,
        quantile_cont(first / 10.0, 0.5) FILTER (label = 'drowsy') AS median FROM per GROUP BY pos),
      named AS (SELECT CAST(pos AS INTEGER) AS grid_pos, e AS escalate, d AS de_escalate, a AS alarm_after, n_clips, n_not_drowsy_clips, n_drowsy_clips,
        round(fa, 6) AS false_alarms_per_hour, round(fraction, 6) AS fraction_not_drowsy_clips_with_alarm,
        round(fa_alert, 6) AS false_alarms_per_hour_alert_clips_only, round(detection, 6) AS drowsy_detection_rate,
        round(median, 6) AS median_time_to_first_alert_s FROM swept JOIN grid USING (pos))"""


_SWEPT = (
    "false_alarms_per_hour",
    "fraction_not_drowsy_clips_with_alarm",
    "false_alarms_per_hour_alert_clips_only",
    "drowsy_detection_rate",
    "median_time_to_first_alert_s",
)


def swept(spark, sf, threshold):
    frames, rows = long_frames(spark, sf)
    levels = rolled_levels(frames, rows)
    levels = cut(levels)
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("n_frames"))
    clips = clip_labels(spark, sf).join(counts, ["s"])
    return sweeps.sweep_alerts(levels, clips, ["s"], "frame", "level", 10.0, threshold=threshold, rows=rows)


@query("alert_sweep", f"{_sweep_sql(2)} SELECT * FROM named")
def alert_sweep(spark, sf):
    return rounded(swept(spark, sf, 2), *_SWEPT)


@query("alert_sweep_alarm_tier", f"{_sweep_sql(3)} SELECT * FROM named")
def alert_sweep_alarm_tier(spark, sf):
    return rounded(swept(spark, sf, 3), *_SWEPT)


@query(
    "alert_selection",
    f"""{_sweep_sql(2)} SELECT * FROM named WHERE drowsy_detection_rate >= (SELECT drowsy_detection_rate FROM named
          WHERE escalate = 5 AND de_escalate = 15 AND alarm_after = 45)
        ORDER BY false_alarms_per_hour, median_time_to_first_alert_s NULLS LAST, grid_pos LIMIT 1""",
)
def alert_selection(spark, sf):
    return rounded(sweeps.select_alert_params(swept(spark, sf, 2)), *_SWEPT)


@query(
    "best_configuration",
    f"WITH {_DURATIONS} SELECT min_duration FROM sweep ORDER BY recall * 0.5 + precision DESC, min_duration LIMIT 1",
)
def best_configuration(spark, sf):
    frames, rows = mouth_frames(spark, sf)
    longest = yawning.longest_runs(frames, video_labels(spark, sf), ["s"], "frame", "mar", 40.0, rows)
    sweep = yawning.sweep_durations(longest, range(1, 21))[0]
    scored = sweep.withColumn("merit", F.col("recall") * 0.5 + F.col("precision"))
    return sweeps.best_by(scored, "merit", "min_duration").select("min_duration")


@query(
    "deploy_gate",
    """WITH c AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN o_totalprice > 60000 THEN 1.0 ELSE 0.0 END) AS r FROM orders GROUP BY 1)
       SELECT o_custkey, CASE WHEN p * 0.5 + 0.6 + 1e-9 < 0.70 THEN 'blocked_precision' WHEN r + 1e-9 < 0.90 THEN 'blocked_recall'
         WHEN p * 0.5 + 0.6 <= 0.75 THEN 'blocked_baseline' WHEN 0.97 - r > 0.05 + 1e-9 THEN 'blocked_baseline' ELSE 'deploy' END AS decision FROM c""",
)
def deploy_gate(spark, sf):
    share = lambda c: F.avg(c.cast("double"))
    rates = table(spark, sf, "orders").groupBy("o_custkey").agg(
        share(F.col("o_orderstatus") == "F").alias("p"), share(F.col("o_totalprice") > 60000).alias("r")
    )
    gate = deploy_decision(F.col("p") * 0.5 + 0.6, F.col("r"), F.lit(0.75), F.lit(0.97))
    return rates.select("o_custkey", gate.alias("decision"))


# --- Splits and folds ---------------------------------------------------------------------------------


def manifest(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("sample_id"),
        F.col("c_nationkey").cast("string").alias("subject_id"),
        F.col("c_mktsegment").alias("label"),
    )


def split_sql(source: str, r0: float, r1: float, seed: int = 0) -> str:
    """Subjects in hash order; the first round_even(r0 n) train, the next round_even(r1 n) validate."""
    return f"""ranked AS (SELECT subject_id, row_number() OVER (ORDER BY md5('{seed}:' || subject_id)) - 1 AS place, count(*) OVER () AS n
        FROM (SELECT DISTINCT subject_id FROM {source}) AS u),
      buckets AS (SELECT subject_id, CASE WHEN place < round_even({r0} * n, 0) THEN 'train'
        WHEN place < round_even({r0} * n, 0) + round_even({r1} * n, 0) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


_MANIFEST = """m AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CAST(c_nationkey AS VARCHAR) AS subject_id, c_mktsegment AS label FROM customer)"""


@query(
    "subject_split",
    f"WITH {_MANIFEST}, {split_sql('m', 0.7, 0.15, 7)} SELECT sample_id, m.subject_id, label, split FROM m JOIN buckets USING (subject_id)",
)
def subject_split(spark, sf):
    return splits.subject_independent_split(manifest(spark, sf), seed=7)


@query(
    "contracted_split",
    f"""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CAST(c_custkey % 90 AS VARCHAR) AS subject_id FROM customer),
        {split_sql('c', 0.78, 0.0)} SELECT split, count(DISTINCT c.subject_id) AS subjects, count(*) AS samples FROM c JOIN buckets USING (subject_id) GROUP BY split""",
)
def contracted_split(spark, sf):
    rows = manifest(spark, sf).withColumn("subject_id", (F.col("sample_id").cast("bigint") % 90).cast("string"))
    out = splits.contracted_split(rows)
    return out.groupBy("split").agg(
        F.count_distinct("subject_id").alias("subjects"), F.count(F.lit(1)).alias("samples")
    )


@query(
    "validation_carve",
    f"""WITH {_MANIFEST}, {split_sql('m', 0.78, 0.0)}, t AS (SELECT sample_id, m.subject_id FROM m JOIN buckets USING (subject_id) WHERE split = 'train'),
        {split_sql('t', 0.8, 0.2, 3).replace('ranked', 'ranked2').replace('buckets', 'buckets2')}
        SELECT sample_id, t.subject_id, split FROM t JOIN buckets2 USING (subject_id)""",
)
def validation_carve(spark, sf):
    outer = splits.subject_independent_split(manifest(spark, sf), splits.MIRROR_RATIOS)
    return splits.carve_validation(outer, seed=3).select("sample_id", "subject_id", "split")


@query(
    "recording_split",
    f"""WITH r AS (SELECT 'g' || chr(65 + CAST(c_nationkey % 5 AS INTEGER)) || '_' || CAST(c_nationkey AS VARCHAR) || '_s' || CAST(c_custkey AS VARCHAR) AS stem,
          'g' || chr(65 + CAST(c_nationkey % 5 AS INTEGER)) || '_' || CAST(c_nationkey AS VARCHAR) AS subject_id FROM customer),
        {split_sql('r', 0.7, 0.0)} SELECT stem, r.subject_id, split FROM r JOIN buckets USING (subject_id)""",
)
def recording_split(spark, sf):
    return splits.recording_split(recording_stems(spark, sf))


def recording_stems(spark, sf):
    group = F.concat(F.lit("g"), F.char(65 + F.col("c_nationkey") % 5))
    return table(spark, sf, "customer").select(
        F.concat_ws("_", group, "c_nationkey", F.concat(F.lit("s"), F.col("c_custkey"))).alias("stem")
    )


@query(
    "subject_folds",
    """WITH n AS (SELECT CAST(c_nationkey AS VARCHAR) AS held_out, count(*) AS n_test FROM customer GROUP BY 1)
       SELECT row_number() OVER (ORDER BY held_out) - 1 AS fold, held_out, (SELECT count(*) FROM n) - 1 AS n_train_subjects,
         CAST((SELECT sum(n_test) FROM n) - n_test AS BIGINT) AS n_train, n_test FROM n""",
)
def subject_folds(spark, sf):
    return splits.subject_folds(manifest(spark, sf))


@query(
    "leaked_subjects",
    """WITH t AS (SELECT c_nationkey AS subject_id, CASE WHEN c_custkey % 40 < 30 THEN 'train' ELSE 'test' END AS split FROM customer)
       SELECT subject_id, count(DISTINCT split) AS splits FROM t GROUP BY subject_id HAVING count(DISTINCT split) > 1""",
)
def leaked_subjects(spark, sf):
    side = F.when(F.col("c_custkey") % 40 < 30, "train").otherwise("test")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("subject_id"), side.alias("split"))
    return splits.leaked_subjects(rows)


# --- Models ---------------------------------------------------------------------------------------------


def linear_model(weights):
    """Loader of a linear scorer, for checking batch scoring against SQL."""

    def load():
        w = np.asarray(weights, dtype=np.float64)
        return lambda batch: batch.astype(np.float64) @ w

    return load


@query(
    "batch_scoring",
    """SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 2 - CAST(embedding[2] AS DOUBLE) + 0.5 * CAST(embedding[64] AS DOUBLE), 5) AS score FROM embeddings""",
)
def batch_scoring(spark, sf):
    scorer = scoring.batch_scorer(linear_model([2.0, -1.0] + [0.0] * 61 + [0.5]), "double")
    return table(spark, sf, "embeddings").select("vec_id", F.round(scorer("embedding"), 5).alias("score"))


def window_level_model():
    def load():
        def level(windows):
            mean = windows[:, :, 0].mean(axis=1)
            return np.where(mean >= 60, 2, np.where(mean >= 30, 1, 0))

        return level

    return load


@query(
    "window_classifier",
    f"""WITH {EV} SELECT s, frame, CASE WHEN frame < 4 THEN 0 WHEN m >= 60 THEN 2 WHEN m >= 30 THEN 1 ELSE 0 END AS level
        FROM (SELECT s, frame, avg(round(value)) OVER (PARTITION BY s ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM ev) AS t""",
)
def window_classifier(spark, sf):
    frames, rows = event_frames(spark, sf)
    seen = frames.select("s", "frame", F.round("value").alias("x"))
    return scoring.window_levels(seen, ["s"], "frame", ["x"], window_level_model(), 5, rows)


@query(
    "softmax_argmax",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best,
       round(exp(CAST(list_max(embedding) AS DOUBLE)) / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE)))), 6) AS top FROM embeddings""",
)
def softmax_argmax(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumn("p", softmax(F.col("embedding")))
    return vectors.select("vec_id", argmax(F.col("embedding")).alias("best"), r6(F.array_max("p")).alias("top"))


def summary_windows(spark, sf, size=60, stride=30):
    frames, rows = long_frames(spark, sf)
    marked = frames.withColumn("ear", F.col("ear") + F.when(F.col("s") % 3 == 2, 12.0).otherwise(0.0))
    labels = clip_labels(spark, sf).select("s", (F.col("s") % 3).cast("int").alias("label"))
    limits = {"ear": 8.0, "mar": 0.07, "pitch": 4.0}
    return marked, labels, limits, rows, fatigue.clip_windows(
        marked, labels, ["s"], "frame", size, stride, limits, 30.0, rows
    )


def windows_sql(size, stride, name):
    """Windows of every supplier session, by the side of a split its windows fall on."""
    return f"""{name} AS (SELECT CAST(l_suppkey AS VARCHAR) AS subject_id, (count(*) - {size}) // {stride} + 1 AS n
      FROM lineitem GROUP BY l_suppkey HAVING count(*) >= {size})"""


def majority_share(df, label):
    """Share of the most frequent class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("share")).first()["share"]


@query(
    "boosted_split",
    f"""WITH {windows_sql(60, 30, 'w')}, {split_sql('w', 0.8, 0.2, 1)}
        SELECT split, CAST(sum(n) AS BIGINT) AS n FROM w JOIN buckets USING (subject_id) GROUP BY split""",
)
def boosted_split(spark, sf):
    """Windows on each side of the split that boosted trees are fitted on."""
    *_, windows = summary_windows(spark, sf)
    whole = splits.subject_independent_split(windows, (0.8, 0.2, 0.0), 1, "s")
    return whole.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("boosted_windows")
def boosted_windows(spark, sf):
    """Metrics of boosted trees on window features, trained on some sessions and judged on others."""
    *_, windows = summary_windows(spark, sf)
    whole = cut(splits.subject_independent_split(windows, (0.8, 0.2, 0.0), 1, "s"))
    train, validate = whole.filter("split = 'train'"), whole.filter("split = 'val'")
    out = scoring.evaluate_boosted_windows(train, validate, fatigue.FEATURES, "label", 3)
    return out.withColumn("majority", F.lit(majority_share(validate, "label")))


# Vectors of "subjects" who look at the place whose entry, of the first five, is the largest.
_GAZE_VECTORS = """g AS (
  SELECT vec_id, vec_id % 25 AS subject, vec_id // 100 AS block,
    list_position(embedding[1:5], list_max(embedding[1:5])) - 1 AS zone, embedding FROM embeddings)"""


def gaze_vectors(spark, sf):
    first = F.slice("embedding", 1, 5)
    zone = F.array_position(first, F.array_max(first)).cast("int") - 1
    at = F.floor(F.col("vec_id") / 100).alias("block")
    return table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 25).alias("subject"), at, zone.alias("zone"), "embedding")


@query(
    "gaze_leave_one_out",
    f"""WITH {_GAZE_VECTORS},
        e AS (SELECT vec_id, subject, zone AS c, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM g),
        own AS (SELECT subject, c, d, count(*) AS n, sum(x) AS m, sum(x * x) AS q FROM e GROUP BY ALL),
        whole AS (SELECT c, d, sum(n) AS n, sum(m) AS m, sum(q) AS q FROM own GROUP BY ALL),
        fold AS (SELECT f.subject, w.c, w.d, w.n - coalesce(o.n, 0) AS n, w.m - coalesce(o.m, 0) AS m, w.q - coalesce(o.q, 0) AS q
          FROM (SELECT DISTINCT subject FROM g) AS f CROSS JOIN whole AS w
          LEFT JOIN own AS o ON o.subject = f.subject AND o.c = w.c AND o.d = w.d),
        v AS (SELECT *, (sum(q) OVER fd - sum(m * m / n) OVER fd) / sum(n) OVER fd AS var, sum(n) OVER fd AS total
          FROM fold WHERE n > 0 WINDOW fd AS (PARTITION BY subject, d)),
        bias AS (SELECT subject, c, max(ln(n / total)) - sum(m / n * (m / n) / var) / 2 AS b FROM v GROUP BY ALL),
        s AS (SELECT e.vec_id, v.c, sum(e.x * (v.m / v.n / v.var)) + any_value(b) AS score FROM e
          JOIN v ON v.subject = e.subject AND v.d = e.d JOIN bias ON bias.subject = v.subject AND bias.c = v.c GROUP BY ALL),
        p AS (SELECT g.subject, g.block, g.vec_id, g.zone, arg_max(s.c, s.score) AS said FROM g JOIN s USING (vec_id) GROUP BY ALL),
        vote AS (SELECT subject, block, zone, said, row_number() OVER (PARTITION BY subject, block, zone ORDER BY count(*) DESC, min(vec_id)) AS rn
          FROM p GROUP BY subject, block, zone, said),
        b AS (SELECT 'frame' AS level, subject, zone, said FROM p UNION ALL SELECT 'interval', subject, zone, said FROM vote WHERE rn = 1)
        SELECT level, CASE WHEN grouping(subject) = 1 THEN 'all' ELSE CAST(subject AS VARCHAR) END AS subject, count(*) AS n,
          count(*) FILTER (zone = said) AS correct, count(*) FILTER (zone = 0) AS n_on_road, count(*) FILTER (zone <> 0) AS n_off_road,
          count(*) FILTER (zone = 0 AND said <> 0) AS false_alarms, count(*) FILTER (zone <> 0 AND said <> 0) AS detected,
          round(avg(CASE WHEN zone = said THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
          round(count(*) FILTER (zone = 0 AND said <> 0) / nullif(count(*) FILTER (zone = 0), 0), 6) AS false_alarm_rate,
          round(count(*) FILTER (zone <> 0 AND said <> 0) / nullif(count(*) FILTER (zone <> 0), 0), 6) AS detection_rate
        FROM b GROUP BY GROUPING SETS ((level, subject), (level))""",
)
def gaze_leave_one_out(spark, sf):
    """Every subject judged by a model that never saw them, frame by frame and by votes."""
    said = scoring.leave_one_subject_out_discriminant(gaze_vectors(spark, sf), "subject", "zone", "embedding", "said")
    said = said.withColumn("stay", F.concat_ws("-", "block", "zone"))  # one true zone an interval
    out = metrics.subject_report(said, "subject", ["stay"], "zone", "said", "vec_id", lambda c: c == 0)
    return rounded(out, "accuracy", "false_alarm_rate", "detection_rate")


_GRID_COUNTS = " UNION ALL ".join(
    f"SELECT {i} AS grid_pos, {c['size']} AS size, (SELECT CAST(sum((n - {c['size']}) // {c['stride']} + 1) AS BIGINT) FROM v WHERE n >= {c['size']}) AS n_validation"
    for i, c in enumerate(fatigue.DEFAULT_GRID)
)


@query(
    "window_tuning_sizes",
    f"""WITH w AS (SELECT CAST(l_suppkey AS VARCHAR) AS subject_id, count(*) AS n FROM lineitem GROUP BY l_suppkey),
        {split_sql('w', 0.8, 0.2, 1)}, v AS (SELECT n FROM w JOIN buckets USING (subject_id) WHERE split = 'val')
        SELECT * FROM ({_GRID_COUNTS}) AS g WHERE n_validation > 0""",
)
def window_tuning_sizes(spark, sf):
    """Validation windows of every configuration that is tried."""
    marked, *_ = summary_windows(spark, sf)
    carved = splits.subject_independent_split(marked, (0.8, 0.2, 0.0), 1, "s")
    lengths = carved.filter("split = 'val'").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    grid = [F.struct(F.lit(i).alias("grid_pos"), *[F.lit(c[k]).alias(k) for k in ("size", "stride")]) for i, c in enumerate(fatigue.DEFAULT_GRID)]
    held = lengths.select("n", F.inline(F.array(*grid))).where("n >= size")
    windows = F.sum(F.floor((F.col("n") - F.col("size")) / F.col("stride")) + 1)
    return held.groupBy("grid_pos", "size").agg(windows.alias("n_validation"))


@query("window_tuning")
def window_tuning(spark, sf):
    """Metrics of every window configuration on held-out sessions; ``chosen`` marks the best."""
    marked, labels, limits, rows, _ = summary_windows(spark, sf)
    carved = cut(splits.subject_independent_split(marked, (0.8, 0.2, 0.0), 1, "s"))
    train, validate = carved.filter("split = 'train'"), carved.filter("split = 'val'")
    results, _ = fatigue.tune(spark, train, validate, labels, ["s"], "frame", limits, 30.0, rows=rows)
    results = cut(results)
    best = sweeps.best_by(results, "macro_auroc").select(F.col("grid_pos").alias("best"))
    named = {k: F.col("config")[k].cast("int") for k in ("size", "stride")}
    known = results.withColumns(named).drop("config").crossJoin(F.broadcast(best))  # best is one row
    return known.withColumn("chosen", F.col("grid_pos") == F.col("best")).drop("best")


@query(
    "linear_head_split",
    f"""WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS subject_id FROM embeddings), {split_sql('e', 0.8, 0.2, 1)}
        SELECT split, count(*) AS n FROM buckets GROUP BY split""",
)
def linear_head_split(spark, sf):
    """Vectors on each side of the split of the linear head."""
    carved = splits.subject_independent_split(gaze_vectors(spark, sf), (0.8, 0.2, 0.0), 1, "vec_id")
    return carved.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("linear_head")
def linear_head(spark, sf):
    """Accuracy on validation for every penalty of a linear classifier; ``chosen`` is kept."""
    vectors = gaze_vectors(spark, sf).select("vec_id", F.col("embedding").alias("features"), F.col("zone").alias("label_index"))
    carved = cut(splits.subject_independent_split(vectors, (0.8, 0.2, 0.0), 1, "vec_id"))
    held = carved.filter("split = 'val'")
    best, tried = scoring.linear_head_sweep(carved.filter("split = 'train'"), held)
    kept = best.getOrDefault("regParam")
    rows = [(p, a, p == kept, majority_share(held, "label_index")) for p, a in tried.items()]
    return spark.createDataFrame(rows, "penalty double, accuracy double, chosen boolean, majority double")


@query("event_classifier")
def event_classifier(spark, sf):
    """One class-weighted score per video of those with events, and whether the video has a rare one."""
    events = gaze_vectors(spark, sf).select(
        (F.col("vec_id") % 50).alias("s"), F.col("embedding").alias("features"), (F.col("zone") == 3).cast("int").alias("label")
    )
    model = scoring.fit_event_classifier(events)
    scored = scoring.score_events(model, events)
    videos = events.groupBy("s").agg(F.max("label").alias("label"))
    return metrics.video_scores(videos, scored, ["s"])


@query(
    "event_features",
    f"""WITH {_RUNS}, cand AS (SELECT s, start, "end", length FROM runs WHERE length >= 1),
        w AS (SELECT s, start, "end", unnest(range(0, 5)) AS i FROM cand),
        want AS (SELECT s, start, "end", i, CAST(start + round_even(i * ("end" - start) / 4.0, 0) AS BIGINT) AS "row" FROM w),
        crops AS (SELECT s, frame AS crop_row, value AS x, k / 97.0 AS y FROM ev WHERE k % 4 <> 0),
        near AS (SELECT want.*, crop_row, x, y, row_number() OVER (PARTITION BY want.s, start, i ORDER BY abs(crop_row - "row"), crop_row) AS rn
          FROM want JOIN crops ON crops.s = want.s AND crop_row BETWEEN "row" - 9 AND "row" + 9)
        SELECT s, start, "end", 0 AS label, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y
        FROM near WHERE rn = 1 GROUP BY s, start, "end" """,
)
def event_features(spark, sf):
    """Crops are sparser here than the margin promises, so a wider reach is accepted."""
    frames, rows = mouth_frames(spark, sf)
    all_frames, _ = event_frames(spark, sf)
    crops = all_frames.filter("k % 4 != 0").select(
        "s", F.col("frame").alias("row"), F.array(F.col("value"), F.col("k") / 97.0).alias("vector")
    )
    out = yawning.event_features(frames, crops, ["s"], "frame", "mar", 40.0, 2, tolerance=9, rows=rows)
    names = ("mean_x", "mean_y", "max_x", "max_y")
    return out.select("s", "start", "end", "label", *[r6(F.get("features", F.lit(i))).alias(n) for i, n in enumerate(names)])


_DETECTORS = f"""{_RUNS}, {VIDEOS}, l AS (SELECT s, max(length) AS longest, max(peak / 200.0) FILTER (length >= 2) AS score FROM runs GROUP BY s),
  v AS (SELECT contains('&' || label || '&', '&Yawning&') AS y, contains('&' || label || '&', '&Talking&') AS t, coalesce(longest, 0) AS longest,
    coalesce(score, 0.0) AS score FROM videos LEFT JOIN l USING (s)),
  f AS (SELECT 'baseline_mar' AS detector, y, t, longest >= 1 AS fired FROM v UNION ALL SELECT 'baseline_duration', y, t, longest >= 4 FROM v
    UNION ALL SELECT 'classifier', y, t, score >= 0.9 FROM v)"""


@query(
    "detector_comparison",
    f"""WITH {_DETECTORS} SELECT detector, count(*) AS n_videos, count(*) FILTER (y AND fired) AS tp, count(*) FILTER (NOT y AND fired) AS fp,
          count(*) FILTER (y AND NOT fired) AS fn, round(coalesce(count(*) FILTER (y AND fired) / nullif(CAST(count(*) FILTER (fired) AS DOUBLE), 0), 0), 6) AS precision,
          round(coalesce(count(*) FILTER (y AND fired) / nullif(CAST(count(*) FILTER (y) AS DOUBLE), 0), 0), 6) AS recall,
          round(count(*) FILTER (t AND NOT y AND fired) / nullif(CAST(count(*) FILTER (t AND NOT y) AS DOUBLE), 0), 6) AS talking_false_positive_rate
        FROM f GROUP BY detector""",
)
def detector_comparison(spark, sf):
    frames, rows = mouth_frames(spark, sf)
    found = cut(runs.event_runs(frames, ["s"], "frame", "mar", 40.0, rows=rows))
    longest = found.groupBy("s").agg(F.max("length").alias("longest"))
    videos = video_labels(spark, sf).join(longest, ["s"], "left").withColumn("longest", F.coalesce("longest", F.lit(0)))
    events = found.filter("length >= 2").withColumn("score", F.col("peak") / 200.0)
    out = yawning.compare_detectors(videos, events, ["s"], 4, 0.9)
    return rounded(out, "precision", "recall", "talking_false_positive_rate")


@query(
    "precision_recall",
    f"""WITH {_DETECTORS} SELECT detector, count(*) FILTER (y AND fired) AS tp, count(*) FILTER (NOT y AND fired) AS fp, count(*) FILTER (y AND NOT fired) AS fn,
          round(coalesce(count(*) FILTER (y AND fired) / nullif(CAST(count(*) FILTER (fired) AS DOUBLE), 0), 0), 6) AS precision,
          round(coalesce(count(*) FILTER (y AND fired) / nullif(CAST(count(*) FILTER (y) AS DOUBLE), 0), 0), 6) AS recall
        FROM f WHERE detector = 'baseline_duration' GROUP BY detector""",
)
def precision_recall(spark, sf):
    frames, rows = mouth_frames(spark, sf)
    longest = yawning.longest_runs(frames, video_labels(spark, sf), ["s"], "frame", "mar", 40.0, rows)
    out = metrics.precision_recall(longest, is_yawning(F.col("label")), F.col("longest") >= 4)
    return rounded(out.withColumn("detector", F.lit("baseline_duration")), "precision", "recall")


@query(
    "category_counts",
    f"""WITH {_RUNS}, {VIDEOS}, l AS (SELECT s, max(length) AS longest FROM runs GROUP BY s)
        SELECT label, count(*) AS n, count(*) FILTER (coalesce(longest, 0) >= 4) AS predicted_yawning FROM videos LEFT JOIN l USING (s) GROUP BY label""",
)
def category_counts(spark, sf):
    frames, rows = mouth_frames(spark, sf)
    longest = yawning.longest_runs(frames, video_labels(spark, sf), ["s"], "frame", "mar", 40.0, rows)
    return metrics.category_counts(longest, "label", F.col("longest") >= 4)


@query(
    "one_hot",
    "SELECT vec_id, CAST(label AS INTEGER) AS hot, 1.0::DOUBLE AS mass FROM embeddings",
)
def one_hot_rows(spark, sf):
    hot = one_hot(F.col("label"), 10)
    vectors = table(spark, sf, "embeddings").withColumn("h", hot)
    mass = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    return vectors.select("vec_id", (F.array_position("h", F.lit(1.0)) - 1).cast("int").alias("hot"), mass.alias("mass"))
