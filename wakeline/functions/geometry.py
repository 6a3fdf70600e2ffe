"""Column expressions over face landmarks (arrays of ``struct<x, y>``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.schemas import LEFT_EYE, LEFT_IRIS, MOUTH, RIGHT_EYE, RIGHT_IRIS


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2.0)) + F.pow(a["y"] - b["y"], F.lit(2.0)))


def pick(landmarks: Column, indices: Sequence[int]) -> Column:
    return F.array(*[F.get(landmarks, F.lit(i)) for i in indices])


def aspect_ratio(points: Column) -> Column:
    """(|p2-p6| + |p3-p5|) / (2 |p1-p4|) over exactly six points, 0 for no width."""
    p = [F.get(points, F.lit(i)) for i in range(6)]
    width = _distance(p[0], p[3])
    height = _distance(p[1], p[5]) + _distance(p[2], p[4])
    wrong = F.raise_error(F.lit("an aspect ratio needs 6 points")).cast("double")
    return F.when(F.size(points) != 6, wrong).when(width < 1e-9, 0.0).otherwise(height / (2.0 * width))


def eye_aspect_ratio(landmarks: Column) -> Column:
    """Mean of both eyes."""
    left = aspect_ratio(pick(landmarks, LEFT_EYE))
    right = aspect_ratio(pick(landmarks, RIGHT_EYE))
    return (left + right) / 2.0


def mouth_aspect_ratio(landmarks: Column) -> Column:
    return aspect_ratio(pick(landmarks, MOUTH))


def euler_degrees(rotation: Column) -> Column:
    """(pitch, yaw, roll) of a row-major 3 x 3 rotation given as an array of 9."""
    r = lambda row, col: F.get(rotation, F.lit(row * 3 + col))
    size = F.hypot(r(0, 0), r(1, 0))
    flat = size < 1e-6
    pitch = F.when(flat, F.atan2(-r(1, 2), r(1, 1))).otherwise(F.atan2(r(2, 1), r(2, 2)))
    yaw = F.atan2(-r(2, 0), size)
    roll = F.when(flat, 0.0).otherwise(F.atan2(r(1, 0), r(0, 0)))
    return F.struct(
        F.degrees(pitch).alias("pitch"), F.degrees(yaw).alias("yaw"), F.degrees(roll).alias("roll")
    )


def iris_offset(landmarks: Column, eye: str) -> Column:
    """Iris centre from the socket centre, in socket widths; (0, 0) for no width."""
    eyes = {"left": (LEFT_EYE, LEFT_IRIS), "right": (RIGHT_EYE, RIGHT_IRIS)}
    if eye not in eyes:
        raise ValueError(f"a face has no {eye!r} eye")
    contour, iris = eyes[eye]
    return socket_offset(
        F.get(landmarks, F.lit(contour[0])),
        F.get(landmarks, F.lit(contour[3])),
        F.get(landmarks, F.lit(iris[0])),
    )


def socket_offset(first: Column, fourth: Column, iris: Column) -> Column:
    width = _distance(first, fourth)

    def along(axis: str) -> Column:
        offset = (iris[axis] - (first[axis] + fourth[axis]) / 2.0) / width
        return F.when(width <= 0.0, 0.0).otherwise(offset).alias(f"d{axis}")

    return F.struct(along("x"), along("y"))


def mouth_box(points: Column, width: Column, height: Column, margin: float = 0.30) -> Column:
    """Square box around the mouth points, clamped to the image; null when degenerate."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    spread = lambda a: F.array_max(a) - F.array_min(a)
    half = F.greatest(spread(xs), spread(ys)) * (1.0 + 2.0 * margin) / 2.0
    low = lambda a: F.rint(F.greatest(F.lit(0.0), mean(a) - half)).cast("int")
    high = lambda a, top: F.rint(F.least(top.cast("double"), mean(a) + half)).cast("int")
    x0, y0, x1, y1 = low(xs), low(ys), high(xs, width), high(ys, height)
    box = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return F.when((x1 > x0) & (y1 > y0), box)


def to_pixels(landmarks: Column, width: Column, height: Column) -> Column:
    return F.transform(
        landmarks, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y"))
    )


def frame_features(landmarks: Column, pose: Column) -> list[Column]:
    """The five fatigue signals; a pose that could not be solved is neutral."""
    angles = [F.coalesce(pose[a], F.lit(0.0)).alias(a) for a in ("pitch", "yaw", "roll")]
    return [
        eye_aspect_ratio(landmarks).alias("ear"),
        mouth_aspect_ratio(landmarks).alias("mar"),
        *angles,
    ]


def gaze_features(landmarks: Column, pose: Column) -> list[Column]:
    """The seven gaze signals, on the pose already solved for the frame."""
    left, right = iris_offset(landmarks, "left"), iris_offset(landmarks, "right")
    return [
        *[F.coalesce(pose[a], F.lit(0.0)).alias(a) for a in ("pitch", "yaw", "roll")],
        left["dx"].alias("left_iris_dx"),
        left["dy"].alias("left_iris_dy"),
        right["dx"].alias("right_iris_dx"),
        right["dy"].alias("right_iris_dy"),
    ]
