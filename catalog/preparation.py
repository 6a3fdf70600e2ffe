"""Preparation operators: sources and sinks, documents, scalar functions, joins, unions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import (
    CLIPS,
    EV,
    LF,
    clip_labels,
    event_frames,
    event_rows,
    long_frames,
    query,
    r6,
    table,
)
from catalog.evaluation import _MANIFEST, manifest, split_sql
from wakeline.functions import geometry, scalars
from wakeline.operators import intervals, metrics, splits
from wakeline.operators.segments import index_rows, stage_folder
from wakeline.operators.windows import window_labels
from wakeline.plans.fatigue import union_windows
from wakeline.schemas import ACTIVITIES, FATIGUE_CLASSES, TELEMETRY
from wakeline.sources import annotations, filetrees, frames, manifests, sinks


def folder(spark):
    return f"{stage_folder(spark)}/run-{uuid.uuid4().hex}"


# --- Manifests ------------------------------------------------------------------------------


@query("manifest_files", f"WITH {_MANIFEST} SELECT sample_id, subject_id, label FROM m")
def manifest_files(spark, sf):
    """Written as CSV with a header and read back by column name."""
    path = folder(spark)
    manifests.write_manifest(manifest(spark, sf), path)
    return manifests.read_manifest(spark, path)


def interval_rows(spark, sf):
    rows = event_rows(spark, sf)
    span = F.concat_ws("", F.lit("g"), F.col("s"), F.lit("/video.mp4#"), F.col("event_id"), F.lit("-"), F.col("event_id") + F.col("k"))
    return rows.select(
        span.alias("sample_id"),
        F.col("s").cast("string").alias("subject_id"),
        F.col("zone").alias("label"),
        F.col("event_id").cast("int").alias("start_frame"),
        (F.col("event_id") + F.col("k")).cast("int").alias("end_frame"),
    )


_INTERVAL_ROWS = f"""WITH {EV} SELECT 'g' || s || '/video.mp4#' || event_id || '-' || (event_id + k) AS sample_id, CAST(s AS VARCHAR) AS subject_id,
  zone AS label, CAST(event_id AS INTEGER) AS start_frame, CAST(event_id + k AS INTEGER) AS end_frame FROM ev"""


@query("interval_manifest_files", _INTERVAL_ROWS)
def interval_manifest_files(spark, sf):
    path = folder(spark)
    manifests.write_interval_manifest(interval_rows(spark, sf), path)
    return manifests.read_interval_manifest(spark, path)


@query(
    "split_files",
    f"""WITH {_MANIFEST}, {split_sql('m', 0.7, 0.15, 2)} SELECT split, count(*) AS samples, count(DISTINCT m.subject_id) AS subjects,
          count(*) FILTER (label = 'BUILDING') AS building FROM m JOIN buckets USING (subject_id) GROUP BY split""",
)
def split_files(spark, sf):
    """A split written per bucket, with its summary; the written rows are counted again."""
    path = folder(spark)
    manifests.write_split(splits.subject_independent_split(manifest(spark, sf), seed=2), path, 2)
    written = spark.read.option("header", True).csv(f"{path}/samples")
    out = manifests.split_summary(written)
    return out.select("split", "samples", "subjects", F.col("class_distribution")["BUILDING"].alias("building"))


@query(
    "dataset_registry",
    f"WITH {_MANIFEST}, {split_sql('m', 0.7, 0.15, 5)} SELECT sample_id, m.subject_id, label, split FROM m JOIN buckets USING (subject_id)",
)
def dataset_registry(spark, sf):
    """A builder added to the registry, then built, split, checked and written by name."""
    builders = {**manifests.DATASET_BUILDERS, "customers": manifest}
    return manifests.build_dataset_splits(spark, "customers", sf, folder(spark), seed=5, builders=builders)


# --- File names -------------------------------------------------------------------------------


def customer_paths(spark, sf, *parts):
    return table(spark, sf, "customer").select(F.concat(*parts).alias("path"), F.lit(0).alias("length"))


@query(
    "class_stem_manifest",
    """WITH c AS (SELECT c_custkey, 'Fold' || c_nationkey % 3 || '/' || c_nationkey AS dir, ['0', '5', '10', '7'][c_custkey % 4 + 1] AS stem,
         ['mp4', 'MOV', 'txt'][c_custkey % 3 + 1] AS ext FROM customer)
       SELECT dir || '/v' || c_custkey || '/' || stem || '.' || ext AS sample_id, 'v' || c_custkey AS subject_id,
         CASE stem WHEN '0' THEN 'alert' WHEN '5' THEN 'low_vigilance' ELSE 'drowsy' END AS label FROM c WHERE stem <> '7' AND ext <> 'txt'""",
)
def class_stem_manifest(spark, sf):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    stem = F.get(F.array(*[F.lit(x) for x in ("0", "5", "10", "7")]), (key % 4).cast("int"))
    ext = F.get(F.array(*[F.lit(x) for x in ("mp4", "MOV", "txt")]), (key % 3).cast("int"))
    files = customer_paths(
        spark, sf, F.lit("Fold"), nation % 3, F.lit("/"), nation, F.lit("/v"), key, F.lit("/"), stem, F.lit("."), ext
    )
    return filetrees.parse_class_stems(files)


@query(
    "eye_image_manifest",
    """SELECT 'eyes/s' || c_nationkey || '_' || c_custkey || '_1_' || c_custkey % 2 || '_' || c_custkey % 3 % 2 || '_2_1_03.png' AS sample_id,
       's' || c_nationkey AS subject_id, CASE c_custkey % 3 % 2 WHEN 1 THEN 'open' ELSE 'closed' END AS label, CAST(c_custkey AS VARCHAR) AS image_id,
       CAST(c_custkey % 2 AS INTEGER) AS glasses, '03' AS sensor_id FROM customer""",
)
def eye_image_manifest(spark, sf):
    key = F.col("c_custkey")
    files = customer_paths(
        spark, sf, F.lit("eyes/s"), F.col("c_nationkey"), F.lit("_"), key, F.lit("_1_"), key % 2, F.lit("_"), key % 3 % 2, F.lit("_2_1_03.png")
    )
    return filetrees.parse_eye_images(files).select("sample_id", "subject_id", "label", "image_id", "glasses", "sensor_id")


def video_names(spark, sf):
    key = F.col("c_custkey")
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (key % len(xs)).cast("int"))
    return customer_paths(
        spark, sf, F.lit("clips/"), key, F.lit("-"), pick("Male", "Female"), pick("NoGlasses", "SunGlasses", "Glasses"),
        pick("-Talking", "-Talking&yawning", "-YAWNING", "", "-normal"), pick(".avi", " .avi", ".avi.avi", ".mp4"),
    )


_NAMES = """n AS (SELECT c_custkey AS k, ['Male', 'Female'][c_custkey % 2 + 1] AS gender, ['NoGlasses', 'SunGlasses', 'Glasses'][c_custkey % 3 + 1] AS glasses,
    ['-Talking', '-Talking&yawning', '-YAWNING', '', '-normal'][c_custkey % 5 + 1] AS action,
    ['Talking', 'Talking&Yawning', 'Yawning', '', 'Normal'][c_custkey % 5 + 1] AS label,
    ['.avi', ' .avi', '.avi.avi', '.mp4'][c_custkey % 4 + 1] AS ext FROM customer),
  v AS (SELECT *, 'clips/' || k || '-' || gender || glasses || action || ext AS sample_id FROM n WHERE ext <> '.mp4')"""


@query(
    "mirror_video_manifest",
    f"WITH {_NAMES} SELECT sample_id, gender || k AS subject_id, label, CAST(k AS INTEGER) AS subject_num, glasses FROM v WHERE label <> ''",
)
def mirror_video_manifest(spark, sf):
    out = filetrees.parse_face_videos(video_names(spark, sf), "mirror", strict=False)
    return out.select("sample_id", "subject_id", "label", "subject_num", "glasses")


@query(
    "dash_video_manifest",
    f"WITH {_NAMES} SELECT sample_id, gender || k AS subject_id, 'AllActivities' AS label, gender FROM v",
)
def dash_video_manifest(spark, sf):
    out = filetrees.parse_face_videos(video_names(spark, sf), "dash", strict=False)
    return out.select("sample_id", "subject_id", "label", "gender")


@query(
    "frame_file_listing",
    f"""WITH {EV}, i AS (SELECT event_id, 'v' || s || '.mp4#' || event_id || '-' || (event_id + k) AS sample_id, 'v' || s || '.mp4_' || event_id || '-' || (event_id + k) AS dir, k % 13 AS c FROM ev),
        f AS (SELECT event_id, unnest(range(0, 3)) AS n FROM ev)
        SELECT dir || '/frame_00000' || n || '.jpg' AS path, CAST(c AS INTEGER) AS label_index, sample_id FROM i JOIN f USING (event_id)""",
)
def frame_file_listing(spark, sf):
    names = F.array(*[F.lit(a) for a in ACTIVITIES])
    rows = event_rows(spark, sf)
    ident = F.concat_ws("", F.lit("v"), "s", F.lit(".mp4#"), "event_id", F.lit("-"), F.col("event_id") + F.col("k"))
    wanted = rows.select(ident.alias("sample_id"), F.get(names, F.col("k") % 13).alias("label"))
    found = wanted.select(
        scalars.sanitise_id(F.col("sample_id")).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")
    ).select(F.concat_ws("", "d", F.lit("/frame_00000"), "n", F.lit(".jpg")).alias("path"))
    return filetrees.frame_files(found, wanted)


# --- Annotation documents ---------------------------------------------------------------------------


def document_body(prefix, skipped):
    """Three actions of an event's document, the second of a kind that is skipped."""
    span = lambda a, b: F.array(F.struct(a.alias("frame_start"), b.alias("frame_end")))
    k = F.col("k")
    actions = F.create_map(
        F.lit("0"), F.struct(F.concat(F.lit(prefix), F.col("name")).alias("type"), span(k, k + 20).alias("frame_intervals")),
        F.lit("1"), F.struct(F.concat(F.lit(prefix), F.lit(skipped)).alias("type"), span(k + 5, k + 9).alias("frame_intervals")),
        F.lit("2"), F.struct(F.concat(F.lit(prefix), F.col("other")).alias("type"), span(k + 8, k + 12).alias("frame_intervals")),
    )
    return F.struct(actions.alias("actions"))


def activity_documents(spark, sf):
    """A document per event; a third of them use the other root key."""
    names = F.array(*[F.lit(a) for a in ACTIVITIES])
    rows = event_rows(spark, sf).withColumn("name", F.get(names, F.col("k") % 13)).withColumn("other", F.get(names, F.col("k") % 7))
    body = document_body("driver_actions/", "unclassified")
    doc = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(body.alias("vcd")))).otherwise(F.to_json(F.struct(body.alias("openlabel"))))
    path = F.concat_ws("", F.lit("gA/"), "s", F.lit("/s1/e"), "event_id", F.lit("_rgb_ann_distraction.json"))
    return rows.select(path.alias("path"), doc.alias("json"), "event_id", "s")


_ACTS = "['" + "','".join(ACTIVITIES) + "']"
_DOCS = f"""{EV}, i AS (SELECT event_id, s, {_ACTS}[k % 13 + 1] AS label, k AS a, k + 20 AS b FROM ev
    UNION ALL SELECT event_id, s, {_ACTS}[k % 7 + 1], k + 8, k + 12 FROM ev)"""


@query(
    "action_intervals",
    f"""WITH {_DOCS} SELECT event_id, 'driver_actions/' || label AS action, a AS start_frame, b AS end_frame FROM i
        UNION ALL SELECT event_id, 'driver_actions/unclassified', k + 5, k + 9 FROM ev""",
)
def action_intervals(spark, sf):
    return annotations.action_intervals(activity_documents(spark, sf), "json", ["event_id"])


@query(
    "activity_manifest",
    f"""WITH {_DOCS} SELECT 'gA/' || s || '/s1/e' || event_id || '_rgb_body.mp4#' || a || '-' || b AS sample_id, 'gA_' || s AS subject_id, label,
          a AS start_frame, b AS end_frame FROM i""",
)
def activity_manifest(spark, sf):
    docs = activity_documents(spark, sf)
    videos = docs.select(F.regexp_replace("path", "_rgb_ann_distraction.json$", "_rgb_body.mp4").alias("path"))
    return filetrees.parse_activity_documents(docs.select("path", "json"), videos)


GAZES = ("left", "front", "right", "infotainment", "steering_wheel")


def gaze_documents(spark, sf):
    """A document per event; a third of them bare, without a root key."""
    names = F.array(*[F.lit(a) for a in GAZES])
    rows = event_rows(spark, sf).withColumn("name", F.get(names, F.col("k") % 5)).withColumn("other", F.get(names, F.col("k") % 3))
    body = document_body("gaze_zone/", "not_valid")
    doc = F.when(F.col("event_id") % 3 == 0, F.to_json(body)).otherwise(F.to_json(F.struct(body.alias("openlabel"))))
    return rows.select(F.col("event_id").alias("r"), doc.alias("json"), "k")


_GZ = "['" + "','".join(GAZES) + "']"
# Frames of the first action, then of the third over it; ends clamped to the clip.
_GAZE = f"""{EV}, n AS (SELECT event_id AS r, k, 20 + k % 90 AS n FROM ev),
  i AS (SELECT r, 0 AS pos, {_GZ}[k % 5 + 1] AS zone, k AS a, least(k + 20, n - 1) AS b FROM n
    UNION ALL SELECT r, 2, {_GZ}[k % 3 + 1], k + 8, least(k + 12, n - 1) FROM n),
  f AS (SELECT r, pos, zone, a, b, unnest(range(a, b + 1)) AS frame FROM i WHERE a <= b),
  last AS (SELECT r, frame, zone, zone || ':' || a || '-' || b AS interval_key FROM
    (SELECT *, row_number() OVER (PARTITION BY r, frame ORDER BY pos DESC) AS rn FROM f) AS t WHERE rn = 1)"""


@query(
    "gaze_intervals",
    f"""WITH {EV} SELECT event_id AS r, {_GZ}[k % 5 + 1] AS zone, k AS start_frame, k + 20 AS end_frame FROM ev
        UNION ALL SELECT event_id, {_GZ}[k % 3 + 1], k + 8, k + 12 FROM ev""",
)
def gaze_intervals(spark, sf):
    return annotations.gaze_intervals(gaze_documents(spark, sf), "json", ["r"]).drop("position")


def zone_frames(spark, sf, strict):
    docs = gaze_documents(spark, sf)
    lengths = docs.select("r", (20 + F.col("k") % 90).alias("n_frames"))
    spans = annotations.gaze_intervals(docs, "json", ["r"])
    return intervals.zone_per_frame(spans, ["r"], "frame", lengths, strict=strict)


@query("zone_per_frame", f"WITH {_GAZE} SELECT r, CAST(frame AS BIGINT) AS frame, zone FROM last")
def zone_per_frame(spark, sf):
    return zone_frames(spark, sf, True).select("r", "frame", "zone")


@query("interval_key_per_frame", f"WITH {_GAZE} SELECT r, CAST(frame AS BIGINT) AS frame, interval_key FROM last")
def interval_key_per_frame(spark, sf):
    return zone_frames(spark, sf, False).select("r", "frame", "interval_key")


@query(
    "label_tokens",
    """SELECT doc_id, contains('&' || l || '&', '&Yawning&') AS yawning, contains('&' || l || '&', '&Talking&') AS talking
       FROM (SELECT doc_id, ['Yawning', 'Talking', 'Talking&Yawning', 'Normal', 'yawning'][doc_id % 5 + 1] AS l FROM documents) AS t""",
)
def label_tokens(spark, sf):
    names = F.array(*[F.lit(x) for x in ("Yawning", "Talking", "Talking&Yawning", "Normal", "yawning")])
    label = F.get(names, (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id", scalars.is_yawning(label).alias("yawning"), scalars.is_talking(label).alias("talking")
    )


# --- Joins --------------------------------------------------------------------------------------------

_CLOSURES = f"""{EV}, n AS (SELECT s, count(*) AS n FROM ev GROUP BY s),
  i AS (SELECT ev.s, greatest(0, frame - 2) AS a, least(n - 1, frame + k % 9) AS b FROM ev JOIN n USING (s) WHERE zone = 'error' AND k % 9 + 2 + 1 >= 6),
  d AS (SELECT ev.s, ev.frame, EXISTS (SELECT 1 FROM i WHERE i.s = ev.s AND ev.frame BETWEEN a AND b) AS drowsy FROM ev)"""


def closures(spark, sf):
    """Error events are eye closures of two frames before to k % 9 frames after them."""
    rows, size = event_frames(spark, sf)
    action = F.when(F.col("zone") == "error", "eyes_state/close").otherwise("eyes_state/open")
    spans = rows.select(
        "s", action.alias("action"), (F.col("frame") - 2).alias("start_frame"), (F.col("frame") + F.col("k") % 9).alias("end_frame")
    )
    lengths = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n_frames"))
    return rows.select("s", "frame", "face"), spans, lengths, size


@query("closure_labels", f"WITH {_CLOSURES} SELECT s, frame, drowsy FROM d")
def closure_labels(spark, sf):
    rows, spans, lengths, size = closures(spark, sf)
    return intervals.closure_labels(rows.select("s", "frame"), spans, lengths, ["s"], "frame", 30.0, 0.2, rows=size)


@query(
    "kept_row_labels",
    f"""WITH {_CLOSURES}, kept AS (SELECT s, frame, row_number() OVER (PARTITION BY s ORDER BY frame) - 1 AS "row" FROM ev WHERE frame % 2 = 0 AND face)
        SELECT kept.s, kept."row", kept.frame, drowsy FROM kept JOIN d ON d.s = kept.s AND d.frame = kept.frame""",
)
def kept_row_labels(spark, sf):
    """Stride, no-face filter and numbering, then the label of the raw frame."""
    rows, spans, lengths, size = closures(spark, sf)
    flagged = rows.withColumn("face", F.when(F.col("face"), True))
    kept = frames.kept_rows(flagged, ["s"], "frame", "face", 2).select("s", "row", "frame")
    labels = intervals.closure_labels(rows.select("s", "frame"), spans, lengths, ["s"], "frame", 30.0, 0.2, rows=size)
    return intervals.label_rows(kept, labels, ["s"], "frame")


@query(
    "nearest_rows",
    f"""WITH {EV}, have AS (SELECT s, frame AS crop_row FROM ev WHERE k % 4 <> 0),
        m AS (SELECT ev.s, ev.frame AS "row", crop_row, abs(crop_row - ev.frame) AS distance,
          row_number() OVER (PARTITION BY ev.s, ev.frame ORDER BY abs(crop_row - ev.frame), crop_row) AS rn
          FROM ev LEFT JOIN have ON have.s = ev.s AND abs(crop_row - ev.frame) <= 5)
        SELECT s, "row", crop_row, distance FROM m WHERE rn = 1""",
)
def nearest_rows(spark, sf):
    rows, _ = event_frames(spark, sf)
    have = rows.filter("k % 4 != 0").select("s", F.col("frame").alias("crop_row"))
    return intervals.nearest_rows(rows.select("s", F.col("frame").alias("row")), have, ["s"], strict=False)


@query(
    "labelled_frames",
    f"WITH {LF}, {CLIPS} SELECT lf.s, frame, label, CASE label WHEN 'alert' THEN 0 WHEN 'low_vigilance' THEN 1 ELSE 2 END AS class_index FROM lf JOIN clips ON clips.s = lf.s",
)
def labelled_frames(spark, sf):
    rows, _ = long_frames(spark, sf)
    out = frames.labelled_frames(rows.select("s", "frame"), clip_labels(spark, sf), FATIGUE_CLASSES, "s")
    return out.select("s", "frame", "label", "class_index")


@query(
    "annotated_recordings",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
)
def annotated_recordings(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(orders, ["c_custkey"], "left_semi")


@query(
    "missing_rows",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
)
def missing_rows(spark, sf):
    orders = table(spark, sf, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return filetrees.missing_rows(table(spark, sf, "customer").select("c_custkey"), orders, ["c_custkey"])


@query(
    "pending_samples",
    """SELECT CAST(c_custkey AS VARCHAR) AS sample_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)
       ORDER BY 1 LIMIT 20""",
)
def pending_samples(spark, sf):
    """The next samples of a resumed, limited run."""
    done = table(spark, sf, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").cast("string").alias("sample_id"))
    return frames.pending_samples(manifest(spark, sf).select("sample_id"), done, limit=20)


@query(
    "gaze_corpus",
    f"""WITH {EV}, f AS (SELECT s, zone, min(frame) AS first FROM ev GROUP BY s, zone),
        d AS (SELECT s, zone, row_number() OVER (PARTITION BY s ORDER BY first) - 1 AS id FROM f)
        SELECT CAST(ev.s AS VARCHAR) || ':' || id AS interval, count(*) AS n, min(frame) AS first_frame FROM ev JOIN d ON d.s = ev.s AND d.zone = ev.zone GROUP BY 1""",
)
def gaze_corpus(spark, sf):
    rows, _ = event_frames(spark, sf)
    corpus = frames.gaze_corpus(rows.select(F.col("s").alias("recording"), "frame", F.col("zone").alias("interval_key")), "interval_key")
    ident = F.concat_ws(":", F.col("interval.recording").cast("string"), F.col("interval.interval_id").cast("string"))
    return corpus.groupBy(ident.alias("interval")).agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"))


# --- Caches, outputs, checksums --------------------------------------------------------------------------


@query(
    "feature_cache",
    "SELECT vec_id % 2 AS part, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM embeddings GROUP BY 1",
)
def feature_cache(spark, sf):
    """Cached vectors per backbone and split; a split is replaced without touching the other."""
    path = folder(spark)
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("sample_id"), F.col("label").alias("label_index"), F.col("embedding").alias("features"), "vec_id"
    )
    frames.write_feature_cache(vectors, path, "small", "train")
    for part, split in ((0, "train"), (1, "test")):
        frames.write_feature_cache(vectors.filter(F.col("vec_id") % 2 == part), path, "small", split)
    both = [
        frames.read_feature_cache(spark, path, "small", s).withColumn("part", F.lit(p).cast("bigint"))
        for p, s in ((0, "train"), (1, "test"))
    ]
    return both[0].unionByName(both[1]).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label_index").cast("bigint").alias("labels")
    )


@query("prediction_output", "SELECT doc_id, quality, toxic FROM labels")
def prediction_output(spark, sf):
    path = folder(spark)
    frames.write_predictions(table(spark, sf, "labels"), path)
    return spark.read.parquet(path)


@query(
    "telemetry_output",
    f"WITH {EV} SELECT zone AS event, count(*) AS n, round(sum(us / 1000000.0 - 1704067200), 3) AS seconds FROM ev GROUP BY zone",
)
def telemetry_output(spark, sf):
    """One JSON object per event, read back with the telemetry schema."""
    path = folder(spark)
    rows = event_rows(spark, sf)
    sinks.write_telemetry(rows.select((F.col("us") / 1e6).alias("ts"), F.col("zone").alias("event"), F.col("level").alias("fatigue")), path)
    back = spark.read.schema(TELEMETRY).json(path)
    return back.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("ts") - 1704067200), 3).alias("seconds")
    )


@query(
    "report_output",
    "SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS overall_accuracy, '150' AS window_config FROM labels",
)
def report_output(spark, sf):
    path = folder(spark)
    report = metrics.accuracy_and_false_alarms(table(spark, sf, "labels"), "quality", "toxic", 1)
    sinks.write_report(report, path, {"window": 150})
    back = spark.read.json(path)
    return back.select(r6("overall_accuracy").alias("overall_accuracy"), F.col("config.window").alias("window_config"))


@query(
    "checksum_status",
    "SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents",
)
def checksum_status(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("d"), F.col("doc_id"))
    wrong = F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.sha2("text", 256))
    expected = docs.select(name.alias("name"), wrong.alias("sha256"))
    files = docs.filter(F.col("doc_id") % 11 != 0).select(name.alias("name"), F.col("text").alias("content"))
    return frames.checksum_status(files, expected)


@query("checksums", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def checksums(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# --- Frame sampling ------------------------------------------------------------------------------------------


@query("stride_filter", f"WITH {LF} SELECT s, frame FROM lf WHERE frame % 3 = 0")
def stride_filter(spark, sf):
    rows, _ = long_frames(spark, sf)
    return rows.filter(scalars.on_stride(F.col("frame"), 3)).select("s", "frame")


@query("no_face_filter", f"WITH {EV} SELECT event_id FROM ev WHERE face")
def no_face_filter(spark, sf):
    marks = event_rows(spark, sf).withColumn("landmarks", F.when(F.col("face"), F.col("value")))
    return marks.filter(F.col("landmarks").isNotNull()).select("event_id")


@query(
    "downsampled_frames",
    """WITH p AS (SELECT p_partkey, p_size * 3 AS total FROM part), i AS (SELECT p_partkey, unnest(range(0, CAST(floor(total / (30.0 / 8.0)) AS BIGINT))) AS i FROM p)
       SELECT p_partkey, CAST(round_even(i * (30.0::DOUBLE / 8.0), 0) AS BIGINT) AS frame FROM i""",
)
def downsampled_frames(spark, sf):
    parts = table(spark, sf, "part")
    return parts.select("p_partkey", F.explode(scalars.sampled_frames(F.col("p_size") * 3, 30.0, 8.0)).alias("frame"))


_PICKS = """iv AS (SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS a,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) * 2 + event_id % 13 AS b FROM events),
  steps AS (SELECT event_id, a, b, list_concat(list_filter(range(a, b + 1, 7), lambda x: x <> b), [CAST(b AS BIGINT)]) AS every FROM iv),
  n AS (SELECT event_id, every, len(every) AS size FROM steps),
  picks AS (SELECT event_id, unnest(CASE WHEN size <= 5 THEN every ELSE list_transform(range(0, 5), lambda i: every[CAST(round_even(i * (size - 1) / 4.0, 0) AS INTEGER) + 1]) END) AS frame FROM n)"""


def sampled_intervals(spark, sf):
    rows = event_rows(spark, sf)
    end = F.col("k") * 2 + F.col("event_id") % 13
    return rows.select("event_id", scalars.interval_frames(F.col("k"), end, 7, 5).alias("frames"))


@query("interval_frames", f"WITH {_PICKS} SELECT event_id, frame FROM picks")
def interval_frames(spark, sf):
    return sampled_intervals(spark, sf).select("event_id", F.explode("frames").alias("frame"))


@query(
    "clamped_frames",
    f"""WITH {_PICKS}, l AS (SELECT event_id, a + 1 + event_id % 40 AS n FROM iv)
        SELECT event_id, count(*) FILTER (frame < n) AS kept, count(*) FILTER (frame >= n) AS dropped FROM picks JOIN l USING (event_id) GROUP BY event_id""",
)
def clamped_frames(spark, sf):
    rows = event_rows(spark, sf).select("event_id", (F.col("k") + 1 + F.col("event_id") % 40).alias("n"))
    joined = sampled_intervals(spark, sf).join(rows, ["event_id"])
    kept = scalars.clamp_frames(F.col("frames"), F.col("n"))
    return joined.select(
        "event_id",
        F.size(kept).cast("bigint").alias("kept"),
        (F.size("frames") - F.size(kept)).cast("bigint").alias("dropped"),
    )


@query(
    "event_row_sampling",
    """WITH iv AS (SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS a, event_id % 13 AS w FROM events), i AS (SELECT unnest(range(0, 5)) AS i)
       SELECT event_id, CAST(i AS INTEGER) AS i, CAST(a + round_even(i * w / 4.0, 0) AS BIGINT) AS "row" FROM iv, i""",
)
def event_row_sampling(spark, sf):
    rows = event_rows(spark, sf)
    picked = scalars.event_rows(F.col("k"), F.col("k") + F.col("event_id") % 13, 5)
    return rows.select("event_id", F.posexplode(picked).alias("i", "row"))


# --- Geometry ------------------------------------------------------------------------------------------------


def points(n):
    """Points made of consecutive pairs of embedding entries."""
    return F.array(
        *[
            F.struct(
                F.get("embedding", F.lit(2 * i)).cast("double").alias("x"),
                F.get("embedding", F.lit(2 * i + 1)).cast("double").alias("y"),
            )
            for i in range(n)
        ]
    )


def _e(i: int) -> str:
    return f"CAST(embedding[{i + 1}] AS DOUBLE)"


def _gap(a: int, b: int) -> str:
    return f"sqrt(pow({_e(2 * a)} - {_e(2 * b)}, 2) + pow({_e(2 * a + 1)} - {_e(2 * b + 1)}, 2))"


@query(
    "aspect_ratio",
    f"SELECT vec_id, round(({_gap(1, 5)} + {_gap(2, 4)}) / (2 * {_gap(0, 3)}), 5) AS ratio FROM embeddings",
)
def aspect_ratio(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(geometry.aspect_ratio(points(6)), 5).alias("ratio"))


@query(
    "euler_angles",
    f"""SELECT vec_id, round(degrees(atan2({_e(7)}, {_e(8)})), 4) AS pitch, round(degrees(atan2(-{_e(6)}, sqrt({_e(0)} * {_e(0)} + {_e(3)} * {_e(3)}))), 4) AS yaw,
        round(degrees(atan2({_e(3)}, {_e(0)})), 4) AS roll FROM embeddings""",
)
def euler_angles(spark, sf):
    nine = F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double"))
    angles = table(spark, sf, "embeddings").select("vec_id", geometry.euler_degrees(nine).alias("a"))
    return angles.select("vec_id", *[F.round(F.col(f"a.{c}"), 4).alias(c) for c in ("pitch", "yaw", "roll")])


@query(
    "iris_offset",
    f"""SELECT vec_id, round(({_e(4)} - ({_e(0)} + {_e(2)}) / 2) / {_gap(0, 1)}, 4) AS dx, round(({_e(5)} - ({_e(1)} + {_e(3)}) / 2) / {_gap(0, 1)}, 4) AS dy FROM embeddings""",
)
def iris_offset(spark, sf):
    p = points(3)
    offset = geometry.socket_offset(p[0], p[1], p[2])
    found = table(spark, sf, "embeddings").select("vec_id", offset.alias("o"))
    return found.select("vec_id", F.round("o.dx", 4).alias("dx"), F.round("o.dy", 4).alias("dy"))


def _mouth(axis: int) -> str:
    return "[" + ", ".join(f"{_e(2 * i + axis)} * 900 + 320" for i in range(6)) + "]"


@query(
    "mouth_box",
    f"""WITH p AS (SELECT vec_id, {_mouth(0)} AS xs, {_mouth(1)} AS ys FROM embeddings),
        h AS (SELECT vec_id, list_sum(xs) / 6 AS cx, list_sum(ys) / 6 AS cy, greatest(list_max(xs) - list_min(xs), list_max(ys) - list_min(ys)) * (1.0 + 2.0 * 0.30) / 2.0 AS half FROM p),
        b AS (SELECT vec_id, CAST(round_even(greatest(0.0, cx - half), 0) AS INTEGER) AS x0, CAST(round_even(greatest(0.0, cy - half), 0) AS INTEGER) AS y0,
          CAST(round_even(least(640.0, cx + half), 0) AS INTEGER) AS x1, CAST(round_even(least(480.0, cy + half), 0) AS INTEGER) AS y1 FROM h)
        SELECT vec_id, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 END AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN y0 END AS y0,
          CASE WHEN x1 > x0 AND y1 > y0 THEN x1 END AS x1, CASE WHEN x1 > x0 AND y1 > y0 THEN y1 END AS y1 FROM b""",
)
def mouth_box(spark, sf):
    shifted = F.transform(points(6), lambda p: F.struct((p["x"] * 900 + 320).alias("x"), (p["y"] * 900 + 320).alias("y")))
    box = geometry.mouth_box(shifted, F.lit(640), F.lit(480))
    found = table(spark, sf, "embeddings").select("vec_id", box.alias("b"))
    return found.select("vec_id", "b.x0", "b.y0", "b.x1", "b.y1")


@query(
    "pixel_landmarks",
    f"SELECT vec_id, round({_e(0)} * 640, 5) AS x0, round({_e(1)} * 480, 5) AS y0, round({_e(62)} * 640, 5) AS x31 FROM embeddings",
)
def pixel_landmarks(spark, sf):
    found = table(spark, sf, "embeddings").select(
        "vec_id", geometry.to_pixels(points(32), F.lit(640), F.lit(480)).alias("p")
    )
    at = lambda i, a: F.round(F.col("p")[i][a], 5)
    return found.select("vec_id", at(0, "x").alias("x0"), at(0, "y").alias("y0"), at(31, "x").alias("x31"))


@query(
    "feature_rows",
    f"""SELECT vec_id, round((({_gap(1, 5)} + {_gap(2, 4)}) / (2 * {_gap(0, 3)}) + ({_gap(7, 11)} + {_gap(8, 10)}) / (2 * {_gap(6, 9)})) / 2, 4) AS ear,
        round(({_gap(13, 17)} + {_gap(14, 16)}) / (2 * {_gap(12, 15)}), 4) AS mar, round(CASE WHEN label = 0 THEN 0 ELSE {_e(40)} END, 5) AS pitch FROM embeddings""",
)
def feature_rows(spark, sf):
    """The five signals of a face mesh; the mesh points are placed where they are read."""
    mesh = [None] * 478
    for at, index in enumerate((*geometry.LEFT_EYE, *geometry.RIGHT_EYE, *geometry.MOUTH)):
        mesh[index] = at
    p = points(18)
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    landmarks = F.array(*[zero if at is None else F.get(F.col("p"), F.lit(at)) for at in mesh])
    pose = F.when(F.col("label") != 0, F.struct(*[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in ((40, "pitch"), (41, "yaw"), (42, "roll"))]))
    faces = table(spark, sf, "embeddings").withColumn("p", p).select("vec_id", landmarks.alias("landmarks"), pose.alias("pose"))
    signals = faces.select("vec_id", *geometry.frame_features(F.col("landmarks"), F.col("pose")))
    return signals.select("vec_id", F.round("ear", 4).alias("ear"), F.round("mar", 4).alias("mar"), F.round("pitch", 5).alias("pitch"))


# --- Classes and identifiers ---------------------------------------------------------------------------------


@query(
    "class_encoding",
    f"WITH {EV} SELECT event_id, zone, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], zone) - 1 AS INTEGER) AS class, zone AS decoded FROM ev",
)
def class_encoding(spark, sf):
    names = ("click", "error", "purchase", "signup", "view")
    coded = event_rows(spark, sf).select("event_id", "zone", scalars.encode(F.col("zone"), names).alias("class"))
    return coded.withColumn("decoded", scalars.decode(F.col("class"), names))


@query(
    "binary_collapses",
    f"WITH {EV} SELECT event_id, level = 2 AS drowsy, k % 13 <> 8 AS distracted, k % 2 = 0 AS on_road FROM ev",
)
def binary_collapses(spark, sf):
    return event_rows(spark, sf).select(
        "event_id",
        scalars.is_drowsy(F.col("level")).alias("drowsy"),
        scalars.is_distracted(F.col("k") % 13, ACTIVITIES.index("safe_drive")).alias("distracted"),
        scalars.eyes_on_road(F.when(F.col("k") % 2 == 0, "front").otherwise(F.col("zone"))).alias("on_road"),
    )


@query(
    "id_derivations",
    """SELECT page_id, 'a/b_c/v' || page_id || '_1-9' AS sanitised, 'gB_' || page_id AS subject, 'gB-' || page_id AS folder_subject, 'a/b_c/v' || page_id AS video FROM pages""",
)
def id_derivations(spark, sf):
    page = F.col("page_id")
    ident = F.concat(F.lit("a/b_c/v"), page, F.lit("#1-9"))
    stem = F.concat(F.lit("gB_"), page, F.lit("_s1_2019"))
    path = F.concat(F.lit("data/gB/"), page, F.lit("/s6/x.mp4"))
    return table(spark, sf, "pages").select(
        "page_id",
        scalars.sanitise_id(ident).alias("sanitised"),
        scalars.recording_subject(stem).alias("subject"),
        scalars.directory_subject(path).alias("folder_subject"),
        scalars.video_of(ident).alias("video"),
    )


@query(
    "state_predicates",
    f"""WITH {EV} SELECT event_id, face AND value <= 20.28 AS below, face AND value >= 54.06 AS above FROM ev""",
)
def state_predicates(spark, sf):
    """Rows without a face hold NaN, which is in neither state."""
    signal = F.when(F.col("face"), F.col("value")).otherwise(F.lit(float("nan")))
    return event_rows(spark, sf).select(
        "event_id",
        scalars.in_state(signal, 20.28, "below").alias("below"),
        scalars.in_state(signal, 54.06, "above").alias("above"),
    )


@query(
    "rate_per_minute",
    "SELECT c_custkey, round(CASE WHEN c_nationkey = 0 THEN 0.0 ELSE (c_custkey % 17) / (c_nationkey / 29.76) * 60 END, 6) AS rate FROM customer",
)
def rate_per_minute(spark, sf):
    rate = scalars.rate_per_minute(F.col("c_custkey") % 17, F.col("c_nationkey"), 29.76)
    return table(spark, sf, "customer").select("c_custkey", r6(rate).alias("rate"))


@query(
    "tier_mapping",
    """SELECT doc_id, CASE WHEN c = 2 AND h >= 45 THEN 'ALARM' WHEN c = 2 THEN 'AUDIBLE' WHEN c = 1 THEN 'VISUAL' ELSE 'NONE' END AS fatigue,
       CASE WHEN c > 0 AND h >= 45 THEN 2 WHEN c > 0 THEN 1 ELSE 0 END AS distraction FROM (SELECT doc_id, doc_id % 3 AS c, n_chars % 90 AS h FROM documents) AS t""",
)
def tier_mapping(spark, sf):
    level, held = (F.col("doc_id") % 3).cast("int"), F.col("n_chars") % 90
    return table(spark, sf, "documents").select(
        "doc_id",
        scalars.tier_name(scalars.fatigue_tier(level, held, 45)).alias("fatigue"),
        scalars.binary_tier(level > 0, held, 45).alias("distraction"),
    )


# --- Unions, guards, ordering -------------------------------------------------------------------------------


@query(
    "manifest_union",
    """SELECT 'c' || c_custkey AS sample_id, CAST(c_nationkey AS VARCHAR) AS subject_id, 'customer' AS label FROM customer
       UNION ALL SELECT 's' || s_suppkey, CAST(s_nationkey AS VARCHAR), 'supplier' FROM supplier""",
)
def manifest_union(spark, sf):
    def part(name, key, nation):
        return table(spark, sf, name).select(
            F.concat(F.lit(name[0]), F.col(key)).alias("sample_id"), F.col(nation).cast("string").alias("subject_id"), F.lit(name).alias("label")
        )

    return splits.union_manifests(part("customer", "c_custkey", "c_nationkey"), part("supplier", "s_suppkey", "s_nationkey"))


@query(
    "duplicate_ids",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
)
def duplicate_ids(spark, sf):
    return splits.duplicate_ids(table(spark, sf, "orders"), "o_custkey")


@query(
    "window_union",
    f"""WITH {EV}, {LF}, a AS (SELECT s, count(*) // 20 AS w FROM ev GROUP BY s), b AS (SELECT s, count(*) // 20 AS w FROM lf GROUP BY s)
        SELECT source, CAST(sum(w) AS BIGINT) AS windows FROM (SELECT 'events' AS source, w FROM a UNION ALL SELECT 'items', w FROM b) AS t GROUP BY source""",
)
def window_union(spark, sf):
    """Windows of two corpora put together, as before training on both."""
    short, _ = event_frames(spark, sf)
    long, _ = long_frames(spark, sf)
    parts = [
        window_labels(short.select("s", "frame", "face"), ["s"], "frame", "face", 20, 20, 0.5).withColumn("source", F.lit("events")),
        window_labels(long.select("s", "frame", (F.col("ear") > 9).alias("face")), ["s"], "frame", "face", 20, 20, 0.5).withColumn("source", F.lit("items")),
    ]
    return union_windows(*parts).groupBy("source").agg(F.count(F.lit(1)).alias("windows"))


@query(
    "ordered_intervals",
    f"""WITH {_DOCS} SELECT event_id, label AS action, a AS start_frame, b AS end_frame,
          row_number() OVER (ORDER BY a, b, label, event_id) - 1 AS place FROM i""",
)
def ordered_intervals(spark, sf):
    """Every interval with its place in (start, end, action) order over the whole corpus."""
    rows = annotations.action_intervals(activity_documents(spark, sf), "json", ["event_id"])
    short = rows.withColumn("action", F.replace("action", F.lit("driver_actions/"), F.lit("")))
    known = short.filter(F.col("action").isin(*ACTIVITIES))
    order = ["start_frame", "end_frame", "action", "event_id"]
    return index_rows(known, [], order, "place")


@query(
    "scalar_telemetry_guard",
    f"WITH {EV} SELECT event_id, zone AS event FROM ev",
)
def scalar_telemetry_guard(spark, sf):
    """Passes scalar telemetry through; vectors and images are refused (see the tests)."""
    return sinks.require_scalar(event_rows(spark, sf).select("event_id", F.col("zone").alias("event")))
