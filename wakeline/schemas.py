"""Table schemas and the fixed values every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("subject_id", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

INTERVAL_MANIFEST = T.StructType(
    MANIFEST.fields
    + [
        T.StructField("start_frame", T.IntegerType()),
        T.StructField("end_frame", T.IntegerType()),
    ]
)

FRAMES = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("frame", T.LongType()),
        T.StructField("ear", T.DoubleType()),
        T.StructField("mar", T.DoubleType()),
        T.StructField("pitch", T.DoubleType()),
        T.StructField("yaw", T.DoubleType()),
        T.StructField("roll", T.DoubleType()),
    ]
)

# One annotation document: a map of actions, each with its frame intervals.
ACTIONS_DDL = (
    "map<string,struct<type:string,"
    "frame_intervals:array<struct<frame_start:int,frame_end:int>>>>"
)
DOCUMENT_DDL = (
    f"struct<openlabel:struct<actions:{ACTIONS_DDL}>,vcd:struct<actions:{ACTIONS_DDL}>,"
    f"actions:{ACTIONS_DDL}>"
)

TELEMETRY = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("event", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("fatigue", T.IntegerType()),
        T.StructField("frames", T.LongType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("lat_ms_p50", T.DoubleType()),
        T.StructField("lat_ms_p95", T.DoubleType()),
        T.StructField("face_rate", T.DoubleType()),
        T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    ]
)

# --- Fixed values -----------------------------------------------------------------------

FEATURE_COLUMNS = ("ear", "mar", "pitch", "yaw", "roll")
GAZE_FEATURE_COLUMNS = (
    "pitch",
    "yaw",
    "roll",
    "left_iris_dx",
    "left_iris_dy",
    "right_iris_dx",
    "right_iris_dy",
)

TIER_NAMES = ("NONE", "VISUAL", "AUDIBLE", "ALARM")
NONE, VISUAL, AUDIBLE, ALARM = range(4)

FATIGUE_CLASSES = {"alert": 0, "low_vigilance": 1, "drowsy": 2}
EYE_CLASSES = {"closed": 0, "open": 1}
ACTIVITIES = (
    "change_gear",
    "drinking",
    "hair_and_makeup",
    "phonecall_left",
    "phonecall_right",
    "radio",
    "reach_backseat",
    "reach_side",
    "safe_drive",
    "standstill_or_waiting",
    "talking_to_passenger",
    "texting_left",
    "texting_right",
)
GAZE_ZONES = (
    "left_mirror",
    "left",
    "front",
    "center_mirror",
    "front_right",
    "right_mirror",
    "right",
    "infotainment",
    "steering_wheel",
)
ON_ROAD_ZONE = "front"
SAFE_ACTIVITY = "safe_drive"
DROWSY_CLASS = 2

CLIP_STEM_LABELS = {"0": "alert", "5": "low_vigilance", "10": "drowsy"}
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg")

MAR_THRESHOLD = 0.616703
CROP_GATE = 0.45
CROP_MARGIN = 5
CLOSURE_FPS = 29.76
CLOSURE_SECONDS = 0.5

# escalate, de-escalate, alarm-after: machine default, sweep baseline, live monitor.
MACHINE_PARAMS = (3, 8, 15)
BASELINE_PARAMS = (5, 15, 45)
LIVE_PARAMS = (8, 40, 45)
ESCALATE_STEPS = (3, 5, 8, 12)
DE_ESCALATE_STEPS = (8, 15, 25, 40)
ALARM_AFTER_STEPS = (15, 30, 45, 90)
ALERT_GRID = tuple(
    (e, d, a) for e in ESCALATE_STEPS for d in DE_ESCALATE_STEPS for a in ALARM_AFTER_STEPS
)

# Face-mesh point numbers, ordered p1..p6 (corners p1 and p4, pairs p2/p6 and p3/p5).
LEFT_EYE = (33, 160, 158, 133, 153, 144)
RIGHT_EYE = (362, 385, 387, 263, 373, 380)
MOUTH = (61, 37, 267, 291, 314, 84)
HEAD_POSE = (1, 152, 33, 263, 61, 291)
LEFT_IRIS = (468, 469, 470, 471, 472)
RIGHT_IRIS = (473, 474, 475, 476, 477)

# Split ratios (train, validation, test): videos, their inner validation, recordings.
MIRROR_RATIOS = (0.78, 0.0, 0.22)
VALIDATION_RATIOS = (0.8, 0.2, 0.0)
RECORDING_RATIOS = (0.7, 0.0, 0.3)
# Window size and stride of the tuned configurations.
WINDOW_GRID = ((100, 50), (150, 75), (200, 100), (150, 50))

# File names: `<num>-<Gender><Glasses>[-<Action>].avi`, annotation and video endings.
# The words of a face video's name.
_GENDERS = ("Male", "Female")
_GLASSES = ("NoGlasses", "SunGlasses", "GlassesBeard", "Glassesmoustache", "Glasses")
FACE_NAME = rf"^([0-9]+)-({'|'.join(_GENDERS)})({'|'.join(_GLASSES)})(?:-([&A-Za-z]+))?\s*(?:[.]avi)+$"
ALL_ACTIVITIES = "AllActivities"
ANNOTATION_SUFFIX = "_rgb_ann_distraction.json"
BODY_SUFFIX = "_rgb_body.mp4"

PRECISION_BAR = 0.70
RECALL_FLOOR = 0.90
RECALL_DROP = 0.05
