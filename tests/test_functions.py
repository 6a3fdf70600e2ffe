import math

import pytest
from pyspark.sql import functions as F

from wakeline.functions import geometry as g
from wakeline.functions import scalars as s
from wakeline.schemas import ACTIVITIES, FATIGUE_CLASSES, GAZE_ZONES


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)

    def value(column):
        return row.select(column.alias("v")).first()["v"]

    return value


def pts(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])


def test_aspect_ratio(one):
    eye = pts((0, 0), (1, 1), (3, 1), (4, 0), (3, -1), (1, -1))
    assert one(g.aspect_ratio(eye)) == 0.5
    flat = pts((0, 0), (1, 1), (3, 1), (0, 0), (3, -1), (1, -1))
    assert one(g.aspect_ratio(flat)) == 0.0
    with pytest.raises(Exception, match="6 points"):
        one(g.aspect_ratio(pts((0, 0), (1, 1))))


def test_euler_degrees(one):
    a = math.radians(30)
    yaw = [math.cos(a), 0, math.sin(a), 0, 1, 0, -math.sin(a), 0, math.cos(a)]
    out = one(g.euler_degrees(F.array(*[F.lit(float(x)) for x in yaw])))
    assert (out.pitch, out.yaw, out.roll) == pytest.approx((0, 30, 0))
    up = [0, 0, 1, 0, 1, 0, -1, 0, 0]  # looking straight up: the gimbal branch
    out = one(g.euler_degrees(F.array(*[F.lit(float(x)) for x in up])))
    assert out.yaw == pytest.approx(90) and out.roll == 0.0


def test_iris_offset(one):
    offset = one(g.socket_offset(*[pts(p)[0] for p in ((0, 0), (10, 0), (7, 1))]))
    assert (offset.dx, offset.dy) == pytest.approx((0.2, 0.1))
    none = one(g.socket_offset(*[pts(p)[0] for p in ((1, 1), (1, 1), (7, 1))]))
    assert (none.dx, none.dy) == (0.0, 0.0)
    with pytest.raises(ValueError):
        g.iris_offset(F.col("x"), "third")


def test_mouth_box(one):
    square = pts((90, 100), (110, 100), (100, 90), (100, 110), (95, 100), (105, 100))
    box = one(g.mouth_box(square, F.lit(640), F.lit(480)))
    assert tuple(box) == (84, 84, 116, 116)
    clipped = one(g.mouth_box(square, F.lit(105), F.lit(480)))
    assert tuple(clipped) == (84, 84, 105, 116)
    point = pts(*[(100, 100)] * 6)
    assert one(g.mouth_box(point, F.lit(640), F.lit(480))) is None


def test_frame_sampling(one):
    assert one(s.sampled_frames(F.lit(30), 30, 10)) == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    assert one(s.sampled_frames(F.lit(4), 10, 10)) == [0, 1, 2, 3]
    assert one(s.sampled_frames(F.lit(0), 30, 10)) == []
    assert one(s.sampled_frames(F.lit(10), 30, 12)) == [round(i * 2.5) for i in range(4)]
    with pytest.raises(ValueError):
        s.sampled_frames(F.lit(4), 0, 10)


def test_interval_frames(one):
    pick = lambda a, b, stride, n=None: one(s.interval_frames(F.lit(a), F.lit(b), stride, n))
    assert pick(10, 19, 3) == [10, 13, 16, 19]
    assert pick(10, 20, 3) == [10, 13, 16, 19, 20]
    assert pick(5, 5, 4) == [5]
    assert pick(0, 9, 1, 1) == [5]
    every = list(range(0, 21, 2))
    assert pick(0, 20, 2, 4) == [every[round(i * 10 / 3)] for i in range(4)]
    with pytest.raises(Exception, match="backwards"):
        pick(9, 3, 1)
    for bad in ((0, None), (1, 0)):
        with pytest.raises(ValueError):
            s.interval_frames(F.lit(0), F.lit(1), *bad)
    frames = F.array(*[F.lit(x) for x in (1, 5, 9)])
    assert one(s.clamp_frames(frames, F.lit(6))) == [1, 5]
    with pytest.raises(Exception, match="inside its clip"):
        one(s.clamp_frames(frames, F.lit(1)))


def test_event_rows(one):
    for start, end in ((3, 8), (4, 4), (0, 2), (10, 31)):
        want = [start + round(i * (end - start) / 4) for i in range(5)]
        assert one(s.event_rows(F.lit(start), F.lit(end))) == want
    assert one(s.event_rows(F.lit(3), F.lit(9), 1)) == [3]
    with pytest.raises(Exception, match="backwards"):
        one(s.event_rows(F.lit(3), F.lit(2)))


def test_states_and_rates(one):
    assert one(s.in_state(F.lit(0.1), 0.1, "below")) and one(s.in_state(F.lit(0.1), 0.1, "above"))
    for mode in ("below", "above"):
        assert one(s.in_state(F.lit(float("nan")), 0.1, mode)) is False
        assert one(s.in_state(F.lit(None).cast("double"), 0.1, mode)) is False
    with pytest.raises(ValueError):
        s.in_state(F.lit(1.0), 0.1, "near")
    assert one(s.rate_per_minute(F.lit(3), F.lit(300), 30.0)) == pytest.approx(18.0)
    assert one(s.rate_per_minute(F.lit(3), F.lit(0), 30.0)) == 0.0
    assert one(s.rate_per_minute(F.lit(3), F.lit(300), 0.0)) == 0.0


def test_classes(one):
    assert one(s.encode(F.lit("drowsy"), FATIGUE_CLASSES)) == 2
    assert one(s.encode(F.lit("safe_drive"), ACTIVITIES)) == 8
    assert one(s.encode(F.lit("front"), GAZE_ZONES)) == 2
    assert one(s.encode(F.lit("asleep"), FATIGUE_CLASSES, strict=False)) is None
    with pytest.raises(Exception, match="unknown label"):
        one(s.encode(F.lit("asleep"), FATIGUE_CLASSES))
    assert one(s.decode(F.lit(1), FATIGUE_CLASSES)) == "low_vigilance"
    assert one(s.argmax(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.5)))) == 1
    soft = one(s.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert soft == [0.5, 0.5]
    assert one(s.is_yawning(F.lit("Talking&Yawning"))) and not one(s.is_yawning(F.lit("yawning")))


def test_tiers_and_gate(one):
    assert one(s.fatigue_tier(F.lit(2), F.lit(15), 15)) == 3
    assert one(s.fatigue_tier(F.lit(2), F.lit(14), 15)) == 2
    assert one(s.tier_name(F.lit(3))) == "ALARM"
    gate = lambda *v: one(s.deploy_decision(*[F.lit(x) for x in v]))
    assert gate(0.7, 0.9, 0.6, 0.95) == "deploy"
    assert gate(0.699, 0.5, 0.6, 0.95) == "blocked_precision"
    assert gate(0.7, 0.899, 0.6, 0.95) == "blocked_recall"
    assert gate(0.8, 0.95, 0.8, 0.95) == "blocked_baseline"
    assert gate(0.9, 0.9, 0.8, 0.96) == "blocked_baseline"


def test_identifiers(one):
    assert one(s.sanitise_id(F.lit("gA/1/s1/video.mp4#100-199"))) == "gA/1/s1/video.mp4_100-199"
    assert one(s.recording_subject(F.lit("gB_10_s5_2019"))) == "gB_10"
    assert one(s.directory_subject(F.lit("root/gF/23/s6/x_rgb_face.mp4"))) == "gF-23"
