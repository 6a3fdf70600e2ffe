"""The stream and the batch operators must agree frame by frame."""

import datetime as dt
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from wakeline.functions.scalars import tier_name
from wakeline.operators import alerts
from wakeline.schemas import TIER_NAMES
from wakeline.sources import sinks
from wakeline.streaming import metrics as live
from wakeline.streaming import monitor

LABELS = ["drinking", "safe_drive", "radio"]
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def classify(window):
    mean = window[:, 0].mean()
    return 2 if mean < 0.35 else 1 if mean < 0.5 else 0


def make_rows(n_sessions=4, n=120):
    rng = random.Random(21)
    rows = []
    for s in range(n_sessions):
        t = START
        for i in range(n):
            t += dt.timedelta(milliseconds=rng.randint(50, 400))
            face = rng.random() < 0.85
            base = 0.2 if (i // 25) % 2 else 0.6
            rows.append(
                (
                    f"s{s}",
                    t,
                    i,
                    face,
                    [base + rng.random() * 0.2, 0.1, 0.0, 0.0, 0.0] if face else None,
                    [rng.random() for _ in LABELS] if rng.random() < 0.9 else None,
                    rng.choice(["front", "left", "left", "right"]) if face else None,
                    rng.random() / 20,
                )
            )
    return rows


@pytest.fixture(scope="module")
def replay(spark):
    rows = make_rows()
    rng = random.Random(4)
    folder = tempfile.mkdtemp(prefix="frames-")
    # Three files, rows shuffled inside each, and a late row that lets the watermark pass.
    by_time = sorted(rows, key=lambda r: r[1])
    cuts = [by_time[:150], by_time[150:330], by_time[330:]]
    end = ("flush", START + dt.timedelta(hours=3), 0, True, [0.6, 0.0, 0.0, 0.0, 0.0], None, "front", 0.01)
    for i, part in enumerate([*cuts, [end]]):
        rng.shuffle(part)
        spark.createDataFrame(part, monitor.INPUT).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    config = monitor.MonitorConfig(
        classify=classify, window=6, fatigue=(2, 4, 5), distraction=(2, 3, 4), every_n=3, alpha=0.5,
        labels=LABELS, gaze_min_s=1.0, gaze_audible_s=2.5, gaze_vote_s=1.0, metrics_s=5.0, idle_s=30.0,
    )
    stream = live.frame_stream(spark, f"{folder}/*", maxFilesPerTrigger=1)
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    records = []
    listener = live.RunRecords(records.append, {"window": 6})
    spark.streams.addListener(listener)
    query = (
        monitor.monitor_stream(stream, config, "10 minutes")
        .writeStream.format("memory").queryName("replayed").outputMode("append")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="cp-"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    out = [r.asDict() for r in spark.sql("select * from replayed where session != 'flush'").collect()]
    spark.streams.removeListener(listener)
    return rows, out, records


def batch(spark, rows):
    df = spark.createDataFrame(rows, monitor.INPUT).withColumn("us", F.unix_micros("ts"))
    from pyspark.sql import Window as W

    # Levels per face frame from the last six feature rows, as the stream's classifier sees them.
    faces = df.filter("has_face").withColumn("k", F.row_number().over(W.partitionBy("session").orderBy("frame")))
    mean = F.avg(F.get("features", F.lit(0))).over(W.partitionBy("session").orderBy("frame").rowsBetween(-5, 0))
    level = F.when(F.col("k") < 6, 0).when(mean < 0.35, 2).when(mean < 0.5, 1).otherwise(0)
    levels = faces.select("session", "frame", level.alias("level"))
    ema = alerts.cadenced_ema(df, ["session"], "frame", "probabilities", LABELS, 3, 0.5)
    base = ema.join(levels, ["session", "frame"], "left")
    tracks = alerts.parallel_tracks(
        base, ["session"], "frame", "has_face", "level", "distracted", (2, 4, 5), (2, 3, 4)
    )
    voted = alerts.majority_smooth(tracks, ["session"], "frame", "us", "zone", 1_000_000, ["front", "left", "right"], "gaze_zone")
    off = voted.withColumn("off", F.col("gaze_zone") != "front")
    out = alerts.streak_tier(off, ["session"], "frame", "us", "off", 1_000_000, 2_500_000)
    return out.withColumn("tier", alerts.fuse_tiers("tier", "gaze_tier"))


def test_stream_equals_batch(spark, replay):
    rows, out, _ = replay
    got = {(r["session"], r["frame"]): r for r in out if r["event"] == "frame"}
    assert len(got) == len(rows)
    final = batch(spark, rows).cache()
    for r in final.collect():
        g = got[(r["session"], r["frame"])]
        for a, b in (("tier", "tier"), ("fatigue_tier", "fatigue_tier"), ("distraction_tier", "distraction_tier"),
                     ("gaze_tier", "gaze_tier"), ("activity", "activity"), ("gaze_zone", "gaze_zone"), ("fatigue", "fatigue_level")):
            assert g[a] == r[b], (r["session"], r["frame"], a)
    assert {g["tier"] for g in got.values()} >= {0, 1, 2}
    named = final.withColumn("tier", tier_name(F.col("tier")))
    want = alerts.change_events(named, ["session"], "frame").collect()
    kinds = ("tier_change", "gaze_change", "face_lost", "face_regained")
    key = lambda r: (r["session"], r["frame"], r["event"], r["from"], r["to"], r["fatigue"])
    assert sorted(map(str, (key(r) for r in out if r["event"] in kinds))) == sorted(map(str, map(key, want)))
    assert {r["from"] for r in want if r["event"] == "tier_change"} <= set(TIER_NAMES)


def test_stream_metrics_and_stop(replay):
    rows, out, records = replay
    for s in {r[0] for r in rows}:
        flushed = [r for r in out if r["session"] == s and r["event"] == "metrics"]
        assert sum(r["frames"] for r in flushed) == 120
        assert [r["event"] for r in out if r["session"] == s].count("stop") == 1
        full = [r for r in sorted(flushed, key=lambda r: r["frame"])][0]
        mine = [r for r in rows if r[0] == s and r[2] <= full["frame"]]
        assert (mine[-1][1] - mine[0][1]).total_seconds() >= 5.0 > (mine[-2][1] - mine[0][1]).total_seconds()
        assert full["face_rate"] == pytest.approx(sum(r[3] for r in mine) / len(mine))
    parsed = [json.loads(r) for r in records]
    assert parsed[0]["event"] == "start" and parsed[0]["config"] == {"window": 6}


def test_interval_metrics_stream_equals_batch(spark):
    rows = make_rows(2, 80)
    folder = tempfile.mkdtemp(prefix="frames-")
    end = ("flush", START + dt.timedelta(hours=3), 0, True, None, None, None, 0.01)
    spark.createDataFrame(rows, monitor.INPUT).coalesce(1).write.parquet(f"{folder}/a")
    spark.createDataFrame([end], monitor.INPUT).coalesce(1).write.parquet(f"{folder}/b")
    stream = live.frame_stream(spark, f"{folder}/*", maxFilesPerTrigger=1)
    q = (
        live.interval_metrics(stream).writeStream.format("memory").queryName("intervals").outputMode("append")
        .option("checkpointLocation", tempfile.mkdtemp(prefix="cp-")).trigger(availableNow=True).start()
    )
    q.awaitTermination(300)
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    got = plain(spark.sql("select * from intervals where session != 'flush'"))
    assert got == plain(live.interval_metrics(spark.createDataFrame(rows, monitor.INPUT))) and len(got) > 4


def test_telemetry_sink(spark):
    folder = tempfile.mkdtemp(prefix="telemetry-") + "/out"
    df = spark.createDataFrame([(1.5, "tier_change", "NONE", "VISUAL", 1), (2.0, "face_lost", None, None, None)],
                               "ts double, event string, from string, to string, fatigue int")
    sinks.write_telemetry(df, folder)
    lines = sorted(json.loads(r.value)["event"] + str(len(json.loads(r.value))) for r in spark.read.text(folder).collect())
    assert lines == ["face_lost2", "tier_change5"]
    with pytest.raises(ValueError, match="scalar"):
        sinks.require_scalar(df.withColumn("landmarks", F.array(F.lit(1.0))))
    with pytest.raises(ValueError, match="scalar"):
        sinks.require_scalar(df.withColumn("image", F.lit(b"x")))
