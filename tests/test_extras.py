import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.functions import geometry
from wakeline.operators import alerts, runs, scoring, segments
from wakeline.schemas import LEFT_EYE, LEFT_IRIS, RIGHT_EYE, RIGHT_IRIS
from wakeline.sources import filetrees, frames, sinks
from wakeline.streaming import metrics as live
from wakeline.streaming import monitor


def field(number, payload):
    """One length-delimited or integer field of a protocol buffer."""
    varint = lambda n: bytes([n & 0x7F | 0x80]) + varint(n >> 7) if n > 0x7F else bytes([n])
    if isinstance(payload, int):
        return varint(number << 3) + varint(payload)
    data = payload.encode() if isinstance(payload, str) else payload
    return varint(number << 3 | 2) + varint(len(data)) + data


def onnx_argmax(path):
    """A model file with a single ArgMax node over (rows, 3) floats."""

    def value(name, kind, dims):
        shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    axis = field(1, "axis") + field(3, 1) + field(20, 2)
    flat = field(1, "keepdims") + field(3, 0) + field(20, 2)
    node = field(1, "x") + field(2, "y") + field(4, "ArgMax") + field(5, axis) + field(5, flat)
    graph = field(1, node) + field(2, "g") + field(11, value("x", 1, ["n", 3])) + field(12, value("y", 7, ["n"]))
    with open(path, "wb") as f:
        f.write(field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13)))


def test_onnx_scoring(spark):
    path = tempfile.mkdtemp(prefix="onnx-") + "/m.onnx"
    onnx_argmax(path)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.random(3)] if i % 7 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    scorer = scoring.batch_scorer(scoring.onnx_loader(path), "int")
    got = {r.i: r.y for r in df.select("i", scorer("x").alias("y")).collect()}
    assert got == {i: int(np.argmax(x)) if x else None for i, x in rows}


def test_gaze_features(spark):
    mesh = [(0.0, 0.0)] * 478
    mesh[LEFT_EYE[0]], mesh[LEFT_EYE[3]], mesh[LEFT_IRIS[0]] = (0.0, 0.0), (10.0, 0.0), (7.0, 1.0)
    mesh[RIGHT_EYE[0]], mesh[RIGHT_EYE[3]], mesh[RIGHT_IRIS[0]] = (20.0, 0.0), (30.0, 0.0), (25.0, -2.0)
    df = spark.createDataFrame([(mesh, None), (mesh, (1.0, 2.0, 3.0))], "m array<struct<x:double,y:double>>, pose struct<pitch:double,yaw:double,roll:double>")
    got = [tuple(r) for r in df.select(*geometry.gaze_features(F.col("m"), F.col("pose"))).collect()]
    assert got[0] == pytest.approx((0, 0, 0, 0.2, 0.1, 0.0, -0.2))
    assert got[1][:3] == (1.0, 2.0, 3.0)


def test_recording_subjects(spark):
    files = spark.createDataFrame([("gF/23/s6/a_rgb_face.mp4",), ("gZ/33/s6/b_rgb_face.mp4",)], "path string")
    assert {r.subject_id for r in filetrees.recording_subjects(files).collect()} == {"gF-23", "gZ-33"}


def test_frame_table(spark):
    df = spark.range(1000).selectExpr("id % 3 as s", "id div 3 as frame", "rand(1) as ear")
    path = tempfile.mkdtemp(prefix="frames-") + "/t"
    frames.write_frames(df, path, ["s"], "frame", 100)
    back = frames.read_frames(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_streamed_telemetry(spark):
    folder = tempfile.mkdtemp(prefix="tele-")
    rows = [("s", 1_700_000_000.0 + i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "session string, t double, frame long").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    full = df.select("session", "ts", "frame", F.lit(True).alias("has_face"), F.array(F.lit(0.5)).alias("features"),
                     F.lit(None).cast("array<double>").alias("probabilities"), F.lit("left").alias("zone"), F.lit(0.01).alias("latency_s"))
    full.write.parquet(f"{folder}/in")
    config = monitor.MonitorConfig(classify=lambda w: 0, window=2, distraction=None, emit_frames=False, gaze_min_s=2.0, gaze_audible_s=5.0)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = monitor.monitor_stream(live.frame_stream(spark, f"{folder}/in"), config, "0 seconds")
    sinks.stream_telemetry(out, f"{folder}/cp", f"{folder}/out", availableNow=True).awaitTermination(120)
    events = [json.loads(r.value) for r in spark.read.text(f"{folder}/out").collect()]
    changes = sorted((e["ts"] - rows[0][1], e["from"], e["to"]) for e in events if e["event"] == "tier_change")
    assert changes == [(2.0, "NONE", "VISUAL"), (5.0, "VISUAL", "AUDIBLE")]
    assert sum(e["event"] == "metrics" for e in events) == 3


def test_monitor_config_checks():
    for bad in (dict(window=0), dict(fatigue=(0, 1, 1)), dict(every_n=0), dict(alpha=0.0), dict(safe_label="x"),
                dict(gaze_min_s=0.0), dict(gaze_min_s=3.0, gaze_audible_s=2.0)):
        with pytest.raises(ValueError):
            monitor.MonitorConfig(classify=lambda w: 0, **bad)


def test_track_parameter_checks(spark):
    df = spark.createDataFrame([("s", 0, 0, "front", [1.0])], "s string, frame long, ts long, zone string, p array<double>")
    with pytest.raises(ValueError):
        alerts.majority_smooth(df, ["s"], "frame", "ts", "zone", 0, ["front"])
    with pytest.raises(ValueError):
        alerts.streak_tier(df, ["s"], "frame", "ts", "zone", 0)
    with pytest.raises(ValueError):
        alerts.streak_tier(df, ["s"], "frame", "ts", "zone", 5, 4)
    for bad in (dict(every_n=0), dict(alpha=1.5), dict(safe_label="x")):
        with pytest.raises(ValueError):
            alerts.cadenced_ema(df, ["s"], "frame", "p", ["safe_drive"], **bad)
    with pytest.raises(ValueError):
        runs.event_runs(df, ["s"], "frame", "ts", 0.5, 0)


def test_hot_session_is_cut(spark):
    """One session holds a third of the rows; segment sizes give the same tiers and runs."""
    base = spark.range(90_000).selectExpr("if(id < 30000, 0, 1 + id % 60) as s", "id", "hash(id) as h")
    held = base.selectExpr("s", "id", "cast(pmod(hash(id div 7), 3) as int) as level")
    out = []
    for size in (4096, 1 << 20):
        indexed = segments.index_rows(held, ["s"], ["id"], "frame")
        tiers = alerts.debounce(segments.cut(indexed), ["s"], "frame", "level", 4, 9, 12, rows=size)
        islands = runs.equal_runs(segments.cut(tiers), ["s"], "frame", "tier", rows=size)
        out.append((tiers, islands))
    for a, b in zip(*out):
        columns = sorted(a.columns)
        assert a.select(columns).exceptAll(b.select(columns)).isEmpty()
        assert a.count() == b.count()
    # No partition of the segmented plan is asked to sort the whole hot session.
    plan = out[0][0]._jdf.queryExecution().toString()
    assert "_seg" in plan


def test_stage_folder_needs_a_shared_place(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        segments.stage_folder(Session())
