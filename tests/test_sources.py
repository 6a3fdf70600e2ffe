import hashlib
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wakeline.operators import intervals, splits
from wakeline.sources import annotations, filetrees, frames, manifests


def folder():
    return tempfile.mkdtemp(prefix="wk-")


def touch(root, *paths, text="x"):
    for path in paths:
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_manifest_by_column_name(spark):
    root = folder()
    touch(root, "m.csv", text='label,extra,sample_id,subject_id\nalert,1,"a,b.mp4",s1\n')
    assert rows(manifests.read_manifest(spark, f"{root}/m.csv")) == [("a,b.mp4", "s1", "alert")]
    df = spark.createDataFrame([('q"1,x', "s", "l")], "sample_id string, subject_id string, label string")
    manifests.write_manifest(df, f"{root}/out")
    assert rows(manifests.read_manifest(spark, f"{root}/out")) == [('q"1,x', "s", "l")]


def test_interval_manifest_header(spark):
    root = folder()
    good = "sample_id,subject_id,label,start_frame,end_frame\n"
    touch(root, "a.csv", text=good + "gA/1/s1/video.mp4#100-199,gA_1,drinking,100,199\n")
    assert rows(manifests.read_interval_manifest(spark, f"{root}/a.csv")) == [
        ("gA/1/s1/video.mp4#100-199", "gA_1", "drinking", 100, 199)
    ]
    touch(root, "b.csv", text="sample_id,subject_id,label,end_frame,start_frame\nx,s,l,1,2\n")
    with pytest.raises(ValueError, match="header"):
        manifests.read_interval_manifest(spark, f"{root}/b.csv")
    touch(root, "c.csv", text=good + "x,s,l,one,2\n")
    with pytest.raises(Exception):
        manifests.read_interval_manifest(spark, f"{root}/c.csv").collect()


def test_class_stem_tree(spark):
    root = folder()
    touch(root, "f1/23/0.mp4", "f1/23/5.MOV", "f1/24/10.avi", "f1/24/7.mp4", "f1/24/notes.txt", "f2/a+b c%41/0.mkv")
    assert rows(filetrees.class_stem_manifest(spark, root)) == [
        ("f1/23/0.mp4", "23", "alert"),
        ("f1/23/5.MOV", "23", "low_vigilance"),
        ("f1/24/10.avi", "24", "drowsy"),
        ("f2/a+b c%41/0.mkv", "a+b c%41", "alert"),
    ]


def test_eye_images(spark):
    root = folder()
    touch(root, "s1/s0001_00123_1_0_1_2_1_03.png", "s1/s0001_00124_1_0_0_2_1_03.PNG")
    assert rows(filetrees.eye_image_manifest(spark, root)) == [
        ("s1/s0001_00123_1_0_1_2_1_03.png", "s0001", "open"),
        ("s1/s0001_00124_1_0_0_2_1_03.PNG", "s0001", "closed"),
    ]
    touch(root, "s1/s0001_00123.png")
    with pytest.raises(Exception, match="eight parts"):
        filetrees.eye_image_manifest(spark, root).collect()


def test_face_video_names(spark):
    names = ["12-MaleNoGlasses-Talking&yawning.avi", "9-FemaleGlasses.avi.avi", "13-MaleNoGlasses .avi", "3-FemaleSunGlasses-Normal.avi"]
    files = spark.createDataFrame([(f"Mirror/{n}",) for n in names], "path string")
    dash = filetrees.parse_face_videos(files, "dash").collect()
    assert {(r.subject_id, r.label) for r in dash} == {
        ("Male12", "AllActivities"), ("Female9", "AllActivities"), ("Male13", "AllActivities"), ("Female3", "AllActivities")
    }
    assert {r.path: r.actions for r in filetrees.parse_face_videos(files, "dash").withColumnRenamed("sample_id", "path").collect()}[
        "Mirror/12-MaleNoGlasses-Talking&yawning.avi"
    ] == ["Talking", "Yawning"]
    with pytest.raises(Exception, match="says nothing"):
        filetrees.parse_face_videos(files, "mirror").collect()
    mirror = filetrees.parse_face_videos(files.filter("path like '%-Talking%' or path like '%Normal%'"), "mirror")
    assert {r.label for r in mirror.collect()} == {"Talking&Yawning", "Normal"}
    with pytest.raises(Exception, match="none of the cameras"):
        filetrees.parse_face_videos(spark.createDataFrame([("x/clip.avi",)], "path string"), "dash").collect()
    with pytest.raises(ValueError):
        filetrees.parse_face_videos(files, "roof")
    empty = folder()
    touch(empty, "readme.txt")
    with pytest.raises(ValueError, match="holds no video"):
        filetrees.face_video_manifest(spark, empty, "dash")


def openlabel(pairs, root="openlabel"):
    body = {"actions": {str(i): {"type": t, "frame_intervals": [{"frame_start": a, "frame_end": b} for a, b in v]} for i, (t, v) in enumerate(pairs)}}
    return json.dumps({root: body} if root else body)


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, json string")


def test_action_intervals(spark):
    pairs = [("driver_actions/safe_drive", [(41, 100), (0, 9)]), ("driver_actions/drinking", [(10, 40)])]
    for root in ("openlabel", "vcd"):
        got = annotations.action_intervals(docs(spark, openlabel(pairs, root)), "json", ["doc"])
        ordered = got.orderBy("start_frame", "end_frame", "action").select("action", "start_frame", "end_frame")
        assert [tuple(r) for r in ordered.collect()] == [
            ("driver_actions/safe_drive", 0, 9), ("driver_actions/drinking", 10, 40), ("driver_actions/safe_drive", 41, 100)
        ]
    assert annotations.action_intervals(docs(spark, '{"vcd": {}}'), "json", ["doc"]).count() == 0
    with pytest.raises(Exception, match="root key"):
        annotations.action_intervals(docs(spark, '{"other": 1}'), "json", ["doc"]).collect()


def test_closures(spark):
    text = openlabel([("eyes_state/close", [(10, 29), (90, 130)]), ("eyes_state/open", [(30, 60)]), ("eyes_state/close", [(70, 75)])])
    spans = annotations.action_intervals(docs(spark, text), "json", ["doc"])
    frames_df = spark.range(100).selectExpr("0 doc", "id frame")
    lengths = spark.createDataFrame([(0, 100)], "doc int, n_frames long")
    for size in (7, 1 << 20):
        out = intervals.closure_labels(frames_df, spans, lengths, ["doc"], "frame", 30, 0.5, rows=size)
        assert sorted(r.frame for r in out.filter("drowsy").collect()) == [*range(10, 30), *range(90, 100)]
        assert out.count() == 100


def test_gaze_last_writer_wins(spark):
    text = openlabel([("gaze_zone/front", [(2, 6)]), ("gaze_zone/not_valid", [(2, 5)]), ("gaze_zone/left", [(5, 8)]), ("blinks/x", [(0, 9)])], None)
    lengths = spark.createDataFrame([(0, 8)], "doc int, n_frames long")
    spans = annotations.gaze_intervals(docs(spark, text), "json", ["doc"])
    got = intervals.zone_per_frame(spans, ["doc"], "frame", lengths).collect()
    assert sorted((r.frame, r.zone, r.interval_key) for r in got) == [
        (2, "front", "front:2-6"), (3, "front", "front:2-6"), (4, "front", "front:2-6"),
        (5, "left", "left:5-7"), (6, "left", "left:5-7"), (7, "left", "left:5-7"),
    ]
    odd = annotations.gaze_intervals(docs(spark, openlabel([("gaze_zone/roof", [(0, 2)])])), "json", ["doc"])
    assert intervals.zone_per_frame(odd, ["doc"], "frame", strict=False).count() == 3
    with pytest.raises(Exception, match="unknown gaze zone"):
        intervals.zone_per_frame(odd, ["doc"], "frame").collect()


def test_swept_zones_match_painting_frame_by_frame(spark):
    import random

    rng = random.Random(11)
    span = intervals.SEGMENT_ROWS
    spans, want = [], {}
    for doc in (0, 1, None):
        for position in rng.sample(range(200), 60):
            start = rng.choice([rng.randint(-20, 300), span - rng.randint(0, 40)])
            end = start + rng.randint(-2, 50)
            zone = rng.choice(["front", "left", "not_valid"])
            spans.append((doc, position, zone, start, end))
    for doc, _, zone, start, end in sorted(spans, key=lambda s: s[1]):
        if zone != "not_valid":
            want |= {(doc, f): (zone, f"{zone}:{start}-{end}") for f in range(start, end + 1)}
    df = spark.createDataFrame(spans, "doc int, position int, zone string, start_frame int, end_frame int")
    got = intervals.zone_per_frame(df.repartition(3), ["doc"], "frame").collect()
    assert {(r.doc, r.frame): (r.zone, r.interval_key) for r in got} == want and len(got) == len(want)
    assert intervals.zone_per_frame(df.limit(0), ["doc"], "frame").count() == 0


def test_activity_tree_and_registry(spark):
    root, out = folder(), folder()
    base = "gA/{}/s1/gA_{}_s1"
    for n in range(1, 11):
        text = openlabel([("driver_actions/drinking", [(n, n + 30)]), ("driver_actions/unclassified", [(0, 3)]), ("gaze_on_road/x", [(0, 3)])])
        touch(root, base.format(n, n) + "_rgb_ann_distraction.json", text=text)
        touch(root, base.format(n, n) + "_rgb_body.mp4")
    split = manifests.build_dataset_splits(spark, "dmd-distraction", root, out, seed=3)
    got = {r.sample_id: r for r in split.collect()}
    assert len(got) == 10
    r = got["gA/4/s1/gA_4_s1_rgb_body.mp4#4-34"]
    assert (r.subject_id, r.label, r.start_frame, r.end_frame) == ("gA_4", "drinking", 4, 34)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"train": 7, "val": 2, "test": 1}  # round(1.5) is 2
    summary = json.loads("".join(r.value + "\n" for r in spark.read.text(f"{out}/summary", wholetext=True).collect()))
    assert summary["seed"] == 3 and summary["counts"]["train"]["subjects"] == 7
    assert summary["counts"]["train"]["class_distribution"] == {"drinking": 7}
    os.rename(f"{root}/gA/4/s1/gA_4_s1_rgb_body.mp4", f"{root}/gA/4/s1/other.mp4")
    with pytest.raises(FileNotFoundError, match="body video"):
        filetrees.activity_manifest(spark, root)
    with pytest.raises(ValueError, match="no builder"):
        manifests.build_dataset_splits(spark, "nope", root, out)
    empty = folder()
    touch(empty, "x.txt")
    with pytest.raises(ValueError, match="holds no samples"):
        manifests.build_dataset_splits(spark, "uta-rldd", empty, out)
    bad = docs(spark, openlabel([("driver_actions/flying", [(0, 2)])])).select(F.lit("a/b/c/d_rgb_ann_distraction.json").alias("path"), "json")
    with pytest.raises(Exception, match="not known to do"):
        filetrees.parse_activity_documents(bad, spark.createDataFrame([("a/b/c/d_rgb_body.mp4",)], "path string")).collect()


def test_frame_files(spark):
    manifest = spark.createDataFrame([("v.mp4#1-9", "s", "radio", 1, 9)], "sample_id string, subject_id string, label string, start_frame int, end_frame int")
    files = spark.createDataFrame([("v.mp4_1-9/frame_000001.jpg",), ("v.mp4_1-9/frame_000004.jpg",), ("v.mp4_1-9/x.png",)], "path string")
    assert rows(filetrees.frame_files(files, manifest).select("path", "label_index")) == [
        ("v.mp4_1-9/frame_000001.jpg", 5), ("v.mp4_1-9/frame_000004.jpg", 5)
    ]
    with pytest.raises(FileNotFoundError):
        filetrees.frame_files(files.filter("path like '%png'"), manifest)
    with pytest.raises(Exception, match="unknown label"):
        filetrees.frame_files(files, manifest.withColumn("label", F.lit("flying"))).collect()


def test_missing_features_and_labels(spark):
    table = spark.createDataFrame([("a", 0, 0.1)], "sample_id string, frame long, ear double")
    manifest = spark.createDataFrame([("a", "s", "alert"), ("b", "s", "alert")], "sample_id string, subject_id string, label string")
    with pytest.raises(FileNotFoundError, match="missing features"):
        frames.labelled_frames(table, manifest)
    assert frames.labelled_frames(table, manifest.filter("sample_id = 'a'")).first().class_index == 0


def test_checksums(spark):
    root = folder()
    touch(root, "a.zip", text="one")
    touch(root, "b.zip", text="two")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    files = frames.file_contents(spark, root)
    expect = lambda *p: spark.createDataFrame(list(p), "name string, sha256 string")
    frames.verify_checksums(files, expect(("a.zip", sha("one")), ("b.zip", sha("two"))))
    with pytest.raises(ValueError, match="mismatch"):
        frames.verify_checksums(files, expect(("a.zip", sha("two"))))
    with pytest.raises(FileNotFoundError):
        frames.verify_checksums(files, expect(("c.zip", sha("two"))))


def test_cache_and_resume(spark):
    root = folder() + "/cache"
    assert not frames.has_feature_cache(spark, root, "net", "train")
    df = spark.createDataFrame([("a", 1, [0.5])], "sample_id string, label_index int, features array<float>")
    frames.write_feature_cache(df, root, "net", "train")
    frames.write_feature_cache(df.withColumn("sample_id", F.lit("b")), root, "net", "val")
    assert frames.has_feature_cache(spark, root, "net", "train")
    assert rows(frames.read_feature_cache(spark, root, "net", "val")) == [("b", 1, [0.5])]
    manifest = spark.createDataFrame([(x,) for x in "dcba"], "sample_id string")
    todo = frames.pending_samples(manifest, manifest.filter("sample_id = 'b'"), limit=2)
    assert [r[0] for r in todo.collect()] == ["a", "c"]


def test_kept_rows(spark):
    raw = spark.createDataFrame([(0, i, None if i in (3, 6) else 1.0) for i in range(12)], "s int, frame long, face double")
    out = frames.kept_rows(raw, ["s"], "frame", "face", 3)
    assert rows(out.select("frame", "row")) == [(0, 0), (9, 1)]


def test_nearest_rows(spark):
    wanted = spark.createDataFrame([("v", 10), ("v", 13), ("v", 20)], "k string, row long")
    have = spark.createDataFrame([("v", 10), ("v", 12), ("v", 14), ("v", 25)], "k string, crop_row long")
    got = {r.row: (r.crop_row, r.distance) for r in intervals.nearest_rows(wanted, have, ["k"]).collect()}
    assert got == {10: (10, 0), 13: (12, 1), 20: (25, 5)}
    far = spark.createDataFrame([("v", 31)], "k string, row long")
    with pytest.raises(Exception, match="too far"):
        intervals.nearest_rows(far, have, ["k"]).collect()


def manifest_30(spark):
    labels = ["alert", "low_vigilance", "drowsy"]
    data = [(f"s{i:03d}_{j}", f"s{i:03d}", labels[i % 3]) for i in range(30) for j in range(3)]
    return spark.createDataFrame(data, "sample_id string, subject_id string, label string")


def test_subject_split(spark):
    manifest = manifest_30(spark)
    split = splits.subject_independent_split(manifest, seed=1).cache()
    assert split.count() == 90
    splits.assert_subject_independent(split)
    subjects = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count_distinct("subject_id").alias("n")).collect()}
    assert subjects == {"train": 21, "val": 4, "test": 5}  # round(4.5) is 4
    again = splits.subject_independent_split(manifest.repartition(7), seed=1)
    assert rows(split) == rows(again)
    assert rows(split) != rows(splits.subject_independent_split(manifest, seed=2))
    leaked = split.withColumn("split", F.when(F.col("sample_id") == "s000_0", "x").otherwise(F.col("split")))
    with pytest.raises(splits.SubjectLeakageError, match="s000"):
        splits.assert_subject_independent(leaked)


def test_split_contract_and_folds(spark):
    manifest = manifest_30(spark)
    with pytest.raises(ValueError, match="contract"):
        splits.contracted_split(manifest)
    assert splits.contracted_split(manifest, 23, 7).filter("split = 'val'").count() == 0
    folds = splits.subject_folds(manifest).orderBy("fold").collect()
    assert [f.held_out for f in folds] == [f"s{i:03d}" for i in range(30)]
    assert {(f.n_train_subjects, f.n_train, f.n_test) for f in folds} == {(29, 87, 3)}
    with pytest.raises(ValueError, match="no subjects"):
        splits.subject_folds(manifest.limit(0))
    with pytest.raises(ValueError, match="two manifests share"):
        splits.union_manifests(manifest, manifest)


def test_manifest_files_of_different_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sample_id,subject_id,label\na1,subA,alert\n")
    (tmp_path / "b.csv").write_text("label,extra,sample_id,subject_id\ndrowsy,x,b1,subB\n")
    got = manifests.read_manifest(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(tuple(r) for r in got.collect()) == [("a1", "subA", "alert"), ("b1", "subB", "drowsy")]
    (tmp_path / "c.csv").write_text("label,sample_id\ndrowsy,c1\n")
    with pytest.raises(ValueError, match="no column subject_id"):
        manifests.read_manifest(spark, str(tmp_path / "*.csv"))


def test_rows_wanted_twice_come_out_twice(spark):
    wanted = spark.createDataFrame([("s", 5), ("s", 5), ("s", 900), ("t", 3)], "s string, row long")
    crops = spark.createDataFrame([("s", 4), ("s", 6), ("s", 6), ("t", 20)], "s string, crop_row long")
    got = intervals.nearest_rows(wanted, crops, ["s"], tolerance=9, strict=False).collect()
    assert sorted((r.s, r.row, r.crop_row, r.distance) for r in got if r.crop_row) == [("s", 5, 4, 1)] * 2
    assert sorted((r.s, r.row) for r in got if r.crop_row is None) == [("s", 900), ("t", 3)]
