"""Sequence operators: windows, runs, alert tracks, change events, streams."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from catalog.base import (
    BINARY_TIER,
    CLIPS,
    EV,
    HOUR_US,
    LEVELS,
    LF,
    ROWS,
    SLICE,
    TIER,
    VIDEOS,
    ZONES,
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
from wakeline.functions.scalars import rate_per_minute, tier_name
from wakeline.operators import alerts, runs, windows
from wakeline.operators.segments import cut, index_rows, stage_folder
from wakeline.plans.yawning import longest_runs, score_videos
from wakeline.schemas import LIVE_PARAMS, TIER_NAMES
from wakeline.streaming import camera_log, extraction
from wakeline.streaming import metrics as live
from wakeline.streaming import monitor


def rolled_levels(frames, rows):
    level = F.when(F.col("m") >= 27.5, 2).when(F.col("m") >= 24, 1).otherwise(0)
    return windows.rolling_level(
        frames.select("s", "frame", "ear"), ["s"], "frame", 20, {"m": F.avg("ear")}, level, rows
    ).select("s", "frame", "level")


# --- Rows and windows -----------------------------------------------------------------------


@query("frame_index", f"WITH {EV} SELECT s, event_id, frame FROM ev")
def frame_index(spark, sf):
    return event_frames(spark, sf)[0].select("s", "event_id", "frame")


@query(
    "rolling_window",
    f"""WITH {EV}, w AS (SELECT s, frame, value,
          count(*) OVER o AS n, sum(value) OVER o AS total, first_value(value) OVER o AS oldest
        FROM ev WINDOW o AS (PARTITION BY s ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
        SELECT s, frame, n AS held, n = 5 AS is_full, round(total, 6) AS total, oldest FROM w""",
)
def rolling_window(spark, sf):
    frames, rows = event_frames(spark, sf)
    out = windows.rolling_window(frames.select("s", "frame", "value"), ["s"], "frame", ["value"], 5, rows)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "s",
        "frame",
        F.size("window").cast("bigint").alias("held"),
        "is_full",
        r6(total).alias("total"),
        F.get("window", F.lit(0)).alias("oldest"),
    )


@query(
    "sliding_windows",
    f"""WITH {LF}, n AS (SELECT s, count(*) AS n FROM lf GROUP BY s),
        k AS (SELECT s, n, unnest(range(0, CAST(n // 75 + 1 AS BIGINT))) AS window_id FROM n),
        w AS (SELECT lf.s, window_id, frame FROM k JOIN lf ON lf.s = k.s
              AND frame >= window_id * 75 AND frame < window_id * 75 + 150 WHERE window_id * 75 + 150 <= n)
        SELECT s, window_id, count(*) AS n, min(frame) AS first_frame, max(frame) AS last_frame
        FROM w GROUP BY s, window_id""",
)
def sliding_windows(spark, sf):
    frames, rows = long_frames(spark, sf)
    out = windows.sliding_windows(frames.select("s", "frame"), ["s"], "frame", 150, 75, rows)
    return out.groupBy("s", "window_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
    )


@query(
    "labelled_windows",
    f"""WITH {LF}, {CLIPS}, n AS (SELECT s, count(*) AS n FROM lf GROUP BY s),
        k AS (SELECT s, n, unnest(range(0, CAST(n // 60 + 1 AS BIGINT))) AS window_id FROM n),
        m AS (SELECT lf.s, window_id, ear, mar, frame FROM k JOIN lf ON lf.s = k.s
              AND frame >= window_id * 60 AND frame < window_id * 60 + 120 WHERE window_id * 60 + 120 <= n)
        SELECT m.s, window_id, label, count(*) AS n_rows, round(sum(ear), 6) AS ear_total,
          round(sum(mar * (frame - window_id * 60)), 6) AS mar_moment
        FROM m JOIN clips ON clips.s = m.s GROUP BY m.s, window_id, label""",
)
def labelled_windows(spark, sf):
    frames, rows = long_frames(spark, sf)
    out = windows.labelled_windows(
        frames, clip_labels(spark, sf), ["s"], "frame", ["ear", "mar"], 120, 60, rows=rows
    )
    ear = F.aggregate("features", F.lit(0.0), lambda a, x: a + x[0])
    moment = F.aggregate(
        F.transform("features", lambda x, i: x[1] * i), F.lit(0.0), lambda a, x: a + x
    )
    return out.select(
        "s",
        "window_id",
        "label",
        F.size("features").cast("bigint").alias("n_rows"),
        r6(ear).alias("ear_total"),
        r6(moment).alias("mar_moment"),
    )


_SUMMARY = f"""WITH {LF}, n AS (SELECT s, count(*) AS n FROM lf GROUP BY s),
  k AS (SELECT s, n, unnest(range(0, CAST(n // 75 + 1 AS BIGINT))) AS window_id FROM n),
  m AS (SELECT lf.s, window_id, frame, ear, mar, abs(pitch) AS p,
          ear <= 8 AS b, mar >= 0.07 AS y, abs(pitch) >= 4 AS d
        FROM k JOIN lf ON lf.s = k.s AND frame >= window_id * 75 AND frame < window_id * 75 + 150
        WHERE window_id * 75 + 150 <= n),
  o AS (SELECT *, b AND NOT coalesce(lag(b) OVER w, false) AS bo, y AND NOT coalesce(lag(y) OVER w, false) AS yo,
          d AND NOT coalesce(lag(d) OVER w, false) AS dd
        FROM m WINDOW w AS (PARTITION BY s, window_id ORDER BY frame)),
  g AS (SELECT s, window_id, count(*) FILTER (b) AS closed, count(*) FILTER (bo) AS bc,
          count(*) FILTER (yo) AS yc, count(*) FILTER (dd) AS dc, avg(ear) AS me, avg(mar) AS mm, avg(p) AS mp
        FROM o GROUP BY s, window_id)
  SELECT s, window_id, round(closed / 150.0, 6) AS perclos, bc AS blink_count, yc AS yawn_count, dc AS nod_count,
    round(bc / (150 / 30.0) * 60, 6) AS blink_rate_per_min, round(yc / (150 / 30.0) * 60, 6) AS yawn_rate_per_min,
    round(dc / (150 / 30.0) * 60, 6) AS nod_rate_per_min,
    round(CASE WHEN bc = 0 THEN 0.0 ELSE closed / CAST(bc AS DOUBLE) END, 6) AS mean_blink_duration,
    round(me, 6) AS mean_ear, round(mm, 6) AS mean_mar, round(mp, 6) AS mean_abs_pitch FROM g"""


@query("window_summary", _SUMMARY)
def window_summary(spark, sf):
    frames, rows = long_frames(spark, sf)
    out = windows.window_summary(frames, ["s"], "frame", 150, 75, 30.0, 8.0, 0.07, 4.0, rows=rows)
    counts = ("s", "window_id", "blink_count", "yawn_count", "nod_count")
    return out.select(*[F.col(c) if c in counts else r6(c).alias(c) for c in out.columns])


@query(
    "window_labels",
    f"""WITH {LF}, n AS (SELECT s, count(*) AS n FROM lf GROUP BY s),
        k AS (SELECT s, n, unnest(range(0, CAST(n // 30 + 1 AS BIGINT))) AS window_id FROM n),
        m AS (SELECT lf.s, window_id, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS share
              FROM k JOIN lf ON lf.s = k.s AND frame >= window_id * 30 AND frame < window_id * 30 + 40
              WHERE window_id * 30 + 40 <= n GROUP BY lf.s, window_id)
        SELECT s, window_id, share >= 0.55 AS drowsy, CASE WHEN share >= 0.55 THEN 2 ELSE 0 END AS label FROM m""",
)
def window_labels(spark, sf):
    frames, _ = long_frames(spark, sf)
    flagged = frames.withColumn("flag", F.col("l_linestatus") == "F")
    return windows.window_labels(flagged, ["s"], "frame", "flag", 40, 30, 0.55)


@query(
    "perclos",
    "SELECT l_suppkey AS s, round(avg(CASE WHEN l_quantity <= 10 THEN 1.0 ELSE 0.0 END), 6) AS perclos "
    "FROM lineitem GROUP BY 1",
)
def perclos(spark, sf):
    items = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "s")
    return items.groupBy("s").agg(r6(windows.perclos("l_quantity", 10.0)).alias("perclos"))


@query(
    "session_onsets",
    f"""WITH {LF}, f AS (SELECT s, frame, ear <= 15 AS b FROM lf),
        o AS (SELECT s, b, b AND NOT coalesce(lag(b) OVER (PARTITION BY s ORDER BY frame), false) AS bo FROM f)
        SELECT s, count(*) AS frames, count(*) FILTER (bo) AS onsets,
          round(CASE WHEN count(*) FILTER (bo) = 0 THEN 0.0
            ELSE count(*) FILTER (b) / CAST(count(*) FILTER (bo) AS DOUBLE) END, 6) AS mean_duration,
          round(count(*) FILTER (bo) / (count(*) / 30.0) * 60, 6) AS rate_per_min
        FROM o GROUP BY s""",
)
def session_onsets(spark, sf):
    frames, rows = long_frames(spark, sf)
    out = windows.session_onsets(frames, ["s"], "frame", "ear", 15.0, "below", rows)
    rate = rate_per_minute(F.col("onsets"), F.col("frames"), 30.0)
    return out.select("s", "frames", "onsets", r6("mean_duration").alias("mean_duration"), r6(rate).alias("rate_per_min"))


@query(
    "gate_with_margin",
    f"""WITH {EV}, g AS (SELECT s, frame, face, max(CASE WHEN value >= 120 THEN 1 ELSE 0 END)
          OVER (PARTITION BY s ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM ev)
        SELECT s, frame FROM g WHERE near = 1 AND face""",
)
def gate_with_margin(spark, sf):
    frames, rows = event_frames(spark, sf)
    out = windows.gate_with_margin(frames, ["s"], "frame", "value", "face", 120.0, 5, rows)
    return out.select("s", "frame")


# --- Runs -----------------------------------------------------------------------------------

_RUNS = f"""{EV}, m AS (SELECT s, frame, value, CASE WHEN face THEN CASE WHEN value >= 40 THEN 1 ELSE 0 END END AS mark FROM ev),
  h AS (SELECT s, frame, value, mark, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY s ORDER BY frame
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM m),
  g AS (SELECT *, frame - row_number() OVER (PARTITION BY s, st ORDER BY frame) AS grp FROM h),
  runs AS (SELECT s, min(frame) AS start, max(frame) AS "end", count(*) AS length,
          max(CASE WHEN mark IS NOT NULL THEN value END) AS peak FROM g WHERE st = 1 GROUP BY s, grp)"""


def mouth_frames(spark, sf):
    """Signal per session; frames without a face have none (a NaN, which holds a run)."""
    frames, rows = event_frames(spark, sf)
    signal = F.when(F.col("face"), F.col("value")).otherwise(F.lit(float("nan")))
    return frames.select("s", "frame", signal.alias("mar")), rows


@query("event_runs", f'WITH {_RUNS} SELECT s, start, "end", length, peak FROM runs')
def event_runs(spark, sf):
    frames, rows = mouth_frames(spark, sf)
    return runs.event_runs(frames, ["s"], "frame", "mar", 40.0, rows=rows)


@query("proposal_events", f'WITH {_RUNS} SELECT s, start, "end", peak, 0 AS label FROM runs WHERE length >= 2')
def proposal_events(spark, sf):
    frames, rows = mouth_frames(spark, sf)
    return runs.proposal_events(frames, ["s"], "frame", "mar", 40.0, 2, rows).drop("length")


@query(
    "training_events",
    f"""WITH {_RUNS}, {VIDEOS},
        t AS (SELECT runs.*, contains('&' || label || '&', '&Yawning&') AS y,
                row_number() OVER (PARTITION BY s ORDER BY length DESC, peak DESC, start) AS rn
              FROM runs JOIN videos USING (s) WHERE length >= 2)
        SELECT s, start, "end", length, peak, CASE WHEN y THEN 1 ELSE 0 END AS label FROM t WHERE NOT y OR rn = 1""",
)
def training_events(spark, sf):
    frames, rows = mouth_frames(spark, sf)
    return runs.training_events(frames, video_labels(spark, sf), ["s"], "frame", "mar", 40.0, 2, rows=rows)


@query(
    "video_scores_at_duration",
    f"""WITH {_RUNS}, {VIDEOS}, l AS (SELECT s, max(length) AS longest FROM runs GROUP BY s),
        v AS (SELECT s, contains('&' || label || '&', '&Yawning&') AS y, contains('&' || label || '&', '&Talking&') AS t,
                coalesce(longest, 0) >= 3 AS fired FROM videos LEFT JOIN l USING (s))
        SELECT count(*) AS n_videos, count(*) FILTER (y) AS n_yawning_true, count(*) FILTER (y AND fired) AS tp,
          count(*) FILTER (NOT y AND fired) AS fp, count(*) FILTER (y AND NOT fired) AS fn,
          round(count(*) FILTER (y AND fired) / CAST(count(*) FILTER (fired) AS DOUBLE), 6) AS precision,
          round(count(*) FILTER (y AND fired) / CAST(count(*) FILTER (y) AS DOUBLE), 6) AS recall,
          round(count(*) FILTER (t AND NOT y AND fired) / CAST(count(*) FILTER (t AND NOT y) AS DOUBLE), 6)
            AS talking_false_positive_rate, 3 AS min_duration
        FROM v""",
)
def video_scores_at_duration(spark, sf):
    frames, rows = mouth_frames(spark, sf)
    longest = longest_runs(frames, video_labels(spark, sf), ["s"], "frame", "mar", 40.0, rows)
    out = score_videos(longest, 3)
    rates = ("precision", "recall", "talking_false_positive_rate")
    return out.select(*[r6(c).alias(c) if c in rates else F.col(c) for c in out.columns])


@query(
    "sessionise",
    f"""WITH {EV}, f AS (SELECT s, frame, zone FROM ev WHERE face),
        n AS (SELECT s, frame, zone, CASE WHEN lag(frame) OVER w = frame - 1 AND lag(zone) OVER w = zone THEN 0 ELSE 1 END AS st
              FROM f WINDOW w AS (PARTITION BY s ORDER BY frame))
        SELECT s, frame, zone, CAST(sum(st) OVER (PARTITION BY s ORDER BY frame) - 1 AS BIGINT) AS interval_id FROM n""",
)
def sessionise(spark, sf):
    frames, rows = event_frames(spark, sf)
    faces = frames.filter("face").select("s", "frame", "zone")
    return runs.sessionise(faces, ["s"], "frame", "zone", rows=rows)


@query(
    "first_seen_ids",
    f"""WITH {EV}, f AS (SELECT s, k, min(frame) AS first_frame FROM ev GROUP BY s, k)
        SELECT s, k, first_frame, row_number() OVER (PARTITION BY s ORDER BY first_frame) - 1 AS interval_id FROM f""",
)
def first_seen_ids(spark, sf):
    frames, rows = event_frames(spark, sf)
    return runs.first_seen_ids(frames, ["s"], "frame", "k", rows=rows)


# --- Fatigue and distraction tracks -----------------------------------------------------------


@query(
    "hold_last_classification",
    f"WITH {LF}, {LEVELS} SELECT s, frame, level FROM levels",
)
def hold_last_classification(spark, sf):
    frames, rows = long_frames(spark, sf)
    return rolled_levels(frames, rows)


_DEBOUNCE = f"""WITH RECURSIVE {EV}, src AS (SELECT s, frame, level, 2 AS e, 3 AS d, 2 AS a FROM ev),
  {fold_sql("src")}"""


@query("debounce", f"{_DEBOUNCE} SELECT s, frame, level, committed, {TIER} AS tier FROM fold")
def debounce(spark, sf):
    frames, rows = event_frames(spark, sf)
    return alerts.debounce(frames.select("s", "frame", "level"), ["s"], "frame", "level", 2, 3, 2, rows=rows)


@query(
    "debounce_slow_up",
    f"""WITH RECURSIVE {LF}, {LEVELS}, src AS (SELECT s, frame, level, 9 AS e, 4 AS d, 6 AS a FROM levels),
        {fold_sql("src")} SELECT s, frame, level, committed, {TIER} AS tier FROM fold""",
)
def debounce_slow_up(spark, sf):
    frames, rows = long_frames(spark, sf)
    levels = rolled_levels(frames, rows)
    return alerts.debounce(levels, ["s"], "frame", "level", 9, 4, 6, rows=rows)


@query(
    "debounce_binary",
    f"""WITH RECURSIVE {EV}, src AS (SELECT s, frame, CASE WHEN zone IN ('view', 'click') THEN 0 ELSE 1 END AS level,
          2 AS e, 2 AS d, 3 AS a FROM ev), {fold_sql("src", top=1)}
        SELECT s, frame, level = 1 AS distracted, committed, {BINARY_TIER} AS tier FROM fold""",
)
def debounce_binary(spark, sf):
    frames, rows = event_frames(spark, sf)
    flagged = frames.select("s", "frame", (~F.col("zone").isin("view", "click")).alias("distracted"))
    return alerts.debounce_binary(flagged, ["s"], "frame", "distracted", 2, 2, 3, rows=rows)


_TIERS = f"{_DEBOUNCE}, tiers AS (SELECT s, frame, {TIER} AS tier FROM fold)"
_CHANGES = f"""{_TIERS}, changes AS (SELECT s, frame, tier FROM (SELECT s, frame, tier,
    coalesce(lag(tier) OVER (PARTITION BY s ORDER BY frame), 0) AS prev FROM tiers) AS t WHERE tier <> prev)"""


def event_tiers(spark, sf):
    frames, rows = event_frames(spark, sf)
    levels = cut(frames.select("s", "frame", "level"))
    return alerts.debounce(levels, ["s"], "frame", "level", 2, 3, 2, rows=rows), rows


@query("tier_events", f"{_CHANGES} SELECT s, frame, tier FROM changes")
def tier_events(spark, sf):
    tiers, rows = event_tiers(spark, sf)
    return alerts.tier_events(cut(tiers), ["s"], "frame", rows=rows)


@query(
    "alarm_counts",
    f"""{_CHANGES}, r AS (SELECT s, frame, tier, coalesce(lag(tier) OVER (PARTITION BY s ORDER BY frame), 0) AS prev FROM changes)
        SELECT s, count(*) FILTER (tier >= 2 AND prev < 2) AS alarms, min(frame) FILTER (tier >= 2 AND prev < 2) AS first_frame
        FROM r GROUP BY s""",
)
def alarm_counts(spark, sf):
    tiers, rows = event_tiers(spark, sf)
    events = alerts.tier_events(cut(tiers), ["s"], "frame", rows=rows)
    return alerts.alarm_counts(cut(events), ["s"], "frame", 2, rows=rows)


# --- Gaze tracks --------------------------------------------------------------------------------

# Votes of the last two days, found by comparing every row with the rows before it.
_VOTED = f"""{EV}, e AS (SELECT *, sum(CASE WHEN face THEN 0 ELSE 1 END) OVER (PARTITION BY s ORDER BY frame) AS epoch FROM ev),
  v AS (SELECT a.s, a.frame, b.zone, count(*) AS n, max(b.frame) AS last FROM e AS a JOIN e AS b
        ON a.s = b.s AND a.epoch = b.epoch AND b.face AND a.face AND b.frame <= a.frame AND b.us >= a.us - {48 * HOUR_US}
        GROUP BY a.s, a.frame, b.zone),
  best AS (SELECT s, frame, zone FROM (SELECT *, row_number() OVER (PARTITION BY s, frame ORDER BY n DESC, last DESC) AS rn
        FROM v) AS t WHERE rn = 1),
  voted AS (SELECT ev.s, ev.frame, ev.us, best.zone AS smoothed FROM ev LEFT JOIN best ON best.s = ev.s AND best.frame = ev.frame)"""


def voted_zones(spark, sf):
    frames, rows = event_frames(spark, sf)
    seen = frames.select("s", "frame", "us", F.when(F.col("face"), F.col("zone")).alias("zone"))
    return (
        alerts.majority_smooth(cut(seen), ["s"], "frame", "us", "zone", 48 * HOUR_US, ZONES, rows=rows),
        rows,
    )


@query("majority_smooth", f"WITH {_VOTED} SELECT s, frame, smoothed FROM voted")
def majority_smooth(spark, sf):
    return voted_zones(spark, sf)[0].select("s", "frame", "smoothed")


# A zone for every part and line: far too many to list.
_PLACES = """pl AS (
  SELECT l_suppkey AS s, l_partkey || '-' || l_linenumber % 5 AS zone, row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS frame
  FROM lineitem)"""


@query(
    "majority_open_vocabulary",
    f"""WITH {_PLACES},
        v AS (SELECT a.s, a.frame, b.zone, count(*) AS n, max(b.frame) AS last FROM pl AS a JOIN pl AS b
              ON a.s = b.s AND b.frame BETWEEN a.frame - 60 AND a.frame GROUP BY a.s, a.frame, b.zone)
        SELECT s, frame, zone AS smoothed FROM
          (SELECT *, row_number() OVER (PARTITION BY s, frame ORDER BY n DESC, last DESC) AS rn FROM v) AS t
        WHERE rn = 1""",
)
def majority_open_vocabulary(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    zone = F.concat_ws("-", F.col("l_partkey").cast("string"), (F.col("l_linenumber") % 5).cast("string"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), *order, zone.alias("zone"))
    frames = index_rows(rows, ["s"], order, "frame", SLICE).select("s", "frame", "zone", (F.col("frame") * 1000).alias("us"))
    voted = alerts.majority_smooth(frames, ["s"], "frame", "us", "zone", 60_000, rows=ROWS)
    return voted.select("s", "frame", "smoothed")


_STREAK = f"""{_VOTED}, o AS (SELECT s, frame, us, smoothed, coalesce(smoothed <> 'view', false) AS off FROM voted),
  i AS (SELECT *, sum(CASE WHEN off THEN 0 ELSE 1 END) OVER (PARTITION BY s ORDER BY frame) AS isl FROM o),
  t AS (SELECT *, us - min(CASE WHEN off THEN us END) OVER (PARTITION BY s, isl) AS away FROM i),
  streaks AS (SELECT s, frame, CASE WHEN NOT off THEN 0 WHEN away >= {24 * HOUR_US} THEN 2 WHEN away >= {12 * HOUR_US} THEN 1
    ELSE 0 END AS gaze_tier FROM t)"""


@query("streak_tier", f"WITH {_STREAK} SELECT s, frame, gaze_tier FROM streaks")
def streak_tier(spark, sf):
    voted, rows = voted_zones(spark, sf)
    off = cut(voted).withColumn("off", F.col("smoothed") != "view")
    out = alerts.streak_tier(off, ["s"], "frame", "us", "off", 12 * HOUR_US, 24 * HOUR_US, rows=rows)
    return out.select("s", "frame", "gaze_tier")


# --- Cadenced average, parallel tracks, change events ---------------------------------------------


@query(
    "cadenced_ema",
    f"""WITH RECURSIVE {EV}, p AS (SELECT s, frame, value / 193.0 AS p0, k / 97.0 AS p1, 0.4 AS p2,
          row_number() OVER (PARTITION BY s ORDER BY frame) - 1 AS q FROM ev WHERE (frame + 1) % 3 = 0 AND face),
        ema AS (SELECT s, frame, q, CAST(p0 AS DOUBLE) AS x0, CAST(p1 AS DOUBLE) AS x1, CAST(p2 AS DOUBLE) AS x2 FROM p WHERE q = 0
          UNION ALL SELECT p.s, p.frame, p.q, 0.5 * p.p0 + 0.5 * x0, 0.5 * p.p1 + 0.5 * x1, 0.5 * p.p2 + 0.5 * x2
          FROM ema JOIN p ON p.s = ema.s AND p.q = ema.q + 1),
        h AS (SELECT ev.s, ev.frame, last_value(x0 IGNORE NULLS) OVER w AS x0, last_value(x1 IGNORE NULLS) OVER w AS x1,
          last_value(x2 IGNORE NULLS) OVER w AS x2, ema.s IS NOT NULL AS ran
          FROM ev LEFT JOIN ema ON ema.s = ev.s AND ema.frame = ev.frame
          WINDOW w AS (PARTITION BY ev.s ORDER BY ev.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT s, frame, ran, round(coalesce(x0, 1 / 3.0), 6) AS p0, round(coalesce(x1, 1 / 3.0), 6) AS p1,
          round(coalesce(x2, 1 / 3.0), 6) AS p2,
          CASE WHEN x0 IS NULL THEN 'safe_drive' WHEN x0 >= x1 AND x0 >= x2 THEN 'radio' WHEN x1 >= x2 THEN 'drinking'
            ELSE 'safe_drive' END AS activity FROM h""",
)
def cadenced_ema(spark, sf):
    frames, rows = event_frames(spark, sf)
    probs = F.array(F.col("value") / 193.0, F.col("k") / 97.0, F.lit(0.4))
    seen = frames.select("s", "frame", F.when(F.col("face"), probs).alias("probs"))
    out = alerts.cadenced_ema(
        cut(seen), ["s"], "frame", "probs", ["radio", "drinking", "safe_drive"], 3, 0.5, rows=rows
    )
    return out.select(
        "s", "frame", "ran", *[r6(F.get("probabilities", F.lit(i))).alias(f"p{i}") for i in range(3)], "activity"
    )


_PARALLEL = f"""WITH RECURSIVE {EV},
  f AS (SELECT s, frame AS raw, level, row_number() OVER (PARTITION BY s ORDER BY frame) - 1 AS frame, 2 AS e, 3 AS d, 2 AS a
        FROM ev WHERE face), {fold_sql("f", "ff")},
  g AS (SELECT s, frame, CASE WHEN zone IN ('view', 'click') THEN 0 ELSE 1 END AS level, 2 AS e, 3 AS d, 2 AS a FROM ev),
  {fold_sql("g", "gg", top=1)},
  j AS (SELECT ev.s, ev.frame, ev.face, ev.zone,
      coalesce(last_value(CASE WHEN ff.committed = 2 AND ff.held >= 2 THEN 3 ELSE ff.committed END IGNORE NULLS) OVER w, 0) AS fatigue_tier,
      coalesce(last_value(ff.level IGNORE NULLS) OVER w, 0) AS fatigue_level,
      CASE WHEN gg.committed = 1 AND gg.held >= 2 THEN 2 ELSE gg.committed END AS distraction_tier
    FROM ev LEFT JOIN f ON f.s = ev.s AND f.raw = ev.frame LEFT JOIN ff ON ff.s = f.s AND ff.frame = f.frame
    JOIN gg ON gg.s = ev.s AND gg.frame = ev.frame
    WINDOW w AS (PARTITION BY ev.s ORDER BY ev.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  fused AS (SELECT *, greatest(fatigue_tier, distraction_tier) AS tier FROM j)"""


def fused_frames(spark, sf):
    frames, rows = event_frames(spark, sf)
    seen = frames.select(
        "s", "frame", "face", "zone", "level", (~F.col("zone").isin("view", "click")).alias("distracted")
    )
    out = alerts.parallel_tracks(
        cut(seen), ["s"], "frame", "face", "level", "distracted", (2, 3, 2), rows=rows
    )
    return out, rows


@query(
    "parallel_tracks",
    f"{_PARALLEL} SELECT s, frame, fatigue_tier, fatigue_level, distraction_tier, tier FROM fused",
)
def parallel_tracks(spark, sf):
    out, _ = fused_frames(spark, sf)
    return out.select("s", "frame", "fatigue_tier", "fatigue_level", "distraction_tier", "tier")


@query(
    "change_events",
    f"""{_PARALLEL}, c AS (SELECT s, frame, ['NONE', 'VISUAL', 'AUDIBLE', 'ALARM'][tier + 1] AS tier, fatigue_level, face,
          CASE WHEN face THEN zone END AS gaze FROM fused),
        d AS (SELECT *, lag(tier) OVER w AS pt, lag(face) OVER w AS pf, last_value(gaze IGNORE NULLS) OVER (PARTITION BY s
          ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pg FROM c WINDOW w AS (PARTITION BY s ORDER BY frame))
        SELECT s, frame, 'tier_change' AS event, pt AS "from", tier AS "to", fatigue_level AS fatigue FROM d WHERE tier <> pt
        UNION ALL SELECT s, frame, 'gaze_change', pg, gaze, NULL FROM d WHERE gaze <> pg
        UNION ALL SELECT s, frame, CASE WHEN face THEN 'face_regained' ELSE 'face_lost' END, NULL, NULL, NULL FROM d WHERE face <> pf""",
)
def change_events(spark, sf):
    fused, rows = fused_frames(spark, sf)
    named = cut(fused).select(
        "s",
        "frame",
        tier_name(F.col("tier")).alias("tier"),
        "fatigue_level",
        F.col("face").alias("has_face"),
        F.when(F.col("face"), F.col("zone")).alias("gaze_zone"),
    )
    return alerts.change_events(named, ["s"], "frame", rows=rows)


@query(
    "fuse_tiers",
    "SELECT event_id, coalesce(greatest(CASE WHEN value >= 54.06 THEN 2 WHEN value < 5 THEN NULL ELSE 0 END, "
    "CASE WHEN event_type = 'error' THEN 3 WHEN event_type = 'view' THEN NULL ELSE 1 END), 0) AS tier FROM events",
)
def fuse_tiers(spark, sf):
    first = F.when(F.col("value") >= 54.06, 2).when(F.col("value") >= 5, 0)
    second = F.when(F.col("zone") == "error", 3).when(F.col("zone") != "view", 1)
    return event_rows(spark, sf).select("event_id", alerts.fuse_tiers(first, second).alias("tier"))


# --- Streams ------------------------------------------------------------------------------------


def event_stream(spark, sf):
    """The events file as a stream of monitor input rows."""
    schema = table(spark, sf, "events").schema
    return monitor_input(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet"))


def monitor_input(events):
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int")
    return events.select(
        F.col("user_id").cast("string").alias("session"),
        F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts"),
        F.col("event_id").alias("frame"),
        (k % 10 != 0).alias("has_face"),
        F.array(F.col("value")).alias("features"),
        F.lit(None).cast("array<double>").alias("probabilities"),
        F.col("event_type").alias("zone"),
        (F.col("value") / 1000.0).alias("latency_s"),
    )


def run_stream(spark, df):
    """Run a stream over what is there and return its output table."""
    folder = f"{stage_folder(spark)}/stream-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(
        provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    try:
        writer = df.writeStream.format("parquet").option("path", f"{folder}/out")
        started = (
            writer.option("checkpointLocation", f"{folder}/checkpoint")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        started.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query(
    "interval_metrics",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, epoch_us(ts) // 86400000000 * 86400000000 AS window_start_us,
          value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) % 10 <> 0 AS face FROM events)
        SELECT session, window_start_us, count(*) AS frames, round(count(*) / 86400.0, 6) AS fps,
          round(quantile_cont(value, 0.5), 6) AS lat_ms_p50, round(quantile_cont(value, 0.95), 6) AS lat_ms_p95,
          round(avg(CASE WHEN face THEN 1.0 ELSE 0.0 END), 6) AS face_rate FROM e GROUP BY 1, 2""",
)
def interval_metrics(spark, sf):
    raw = event_rows(spark, sf).select(
        F.col("s").cast("string").alias("session"),
        F.timestamp_micros("us").alias("ts"),
        F.col("face").alias("has_face"),
        (F.col("value") / 1000.0).alias("latency_s"),
    )
    out = live.interval_metrics(raw, "1 day")
    exact = ("session", "window_start_us", "frames")
    return out.select(*[F.col(c) if c in exact else r6(c).alias(c) for c in out.columns])


@query(
    "monitor_stream",
    f"""WITH RECURSIVE {EV}, f AS (SELECT s, frame AS raw, value, row_number() OVER (PARTITION BY s ORDER BY frame) - 1 AS frame
          FROM ev WHERE face),
        src AS (SELECT s, raw, frame, CASE WHEN frame < 3 THEN 0 WHEN m >= 54.06 THEN 2 WHEN m >= 20.28 THEN 1 ELSE 0 END AS level,
          2 AS e, 3 AS d, 2 AS a FROM (SELECT *, avg(value) OVER (PARTITION BY s ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m
          FROM f) AS t), {fold_sql("src")},
        j AS (SELECT ev.s, ev.event_id, coalesce(last_value(CASE WHEN committed = 2 AND held >= 2 THEN 3 ELSE committed END IGNORE NULLS) OVER w, 0) AS tier,
          coalesce(last_value(fold.level IGNORE NULLS) OVER w, 0) AS fatigue
          FROM ev LEFT JOIN src ON src.s = ev.s AND src.raw = ev.frame LEFT JOIN fold ON fold.s = src.s AND fold.frame = src.frame
          WINDOW w AS (PARTITION BY ev.s ORDER BY ev.frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT CAST(s AS VARCHAR) AS session, event_id AS frame, tier, fatigue FROM j""",
)
def monitor_stream(spark, sf):
    def level(window):
        mean = window[:, 0].mean()
        return 2 if mean >= 54.06 else 1 if mean >= 20.28 else 0

    config = monitor.MonitorConfig(
        classify=level, window=4, fatigue=(2, 3, 2), distraction=None, gaze_min_s=None, idle_s=30 * 86400.0
    )
    out = run_stream(spark, monitor.monitor_stream(event_stream(spark, sf), config, "0 seconds"))
    return out.filter("event = 'frame'").select("session", "frame", "tier", "fatigue")


@query(
    "interval_metrics_stream",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, epoch_us(ts) // 86400000000 * 86400000000 AS window_start_us, value FROM events)
        SELECT session, window_start_us, count(*) AS frames, round(quantile_cont(value, 0.5), 6) AS lat_ms_p50
        FROM e GROUP BY 1, 2""",
)
def interval_metrics_stream(spark, sf):
    """Every day, the last one too: a mark after the last frame closes it, as a stop does."""
    out = run_stream(spark, live.interval_metrics(ended_stream(spark, sf), "1 day", "0 seconds"))
    return out.select("session", "window_start_us", "frames", r6("lat_ms_p50").alias("lat_ms_p50"))


@query(
    "camera_log_stream",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session, epoch_us(ts) // 86400000000 * 86400000000 AS window_start_us,
          value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) % 10 <> 0 AS face FROM events)
        SELECT session, window_start_us, count(*) AS frames, round(count(*) / 86400.0, 6) AS fps,
          round(quantile_cont(value, 0.5), 6) AS lat_ms_p50, round(quantile_cont(value, 0.95), 6) AS lat_ms_p95,
          round(avg(CASE WHEN face THEN 1.0 ELSE 0.0 END), 6) AS face_rate FROM e GROUP BY 1, 2""",
)
def camera_log_stream(spark, sf):
    """Daily metrics of cameras that write a log: the stream stops when the first half of the
    time is in, the log grows, and the stream goes on where it was."""
    folder = f"{stage_folder(spark)}/camera-{uuid.uuid4().hex}"
    events = monitor_input(table(spark, sf, "events"))
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("ts"))
    half = ends.select(F.timestamp_micros(((F.unix_micros("a") + F.unix_micros("ts")) / 2).cast("long")).alias("half"))
    events = events.crossJoin(half)  # of one row

    def go_on():
        frames = camera_log.camera_log_stream(spark, f"{folder}/log", 20_000, f"{folder}/progress")
        out = live.interval_metrics(frames, "1 day", "0 seconds")
        writer = out.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
        running = writer.option("checkpointLocation", f"{folder}/checkpoint").start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
        return out.schema

    camera_log.append_frames(events.where("ts <= half").drop("half"), f"{folder}/log", 0)
    go_on()
    camera_log.append_frames(events.where("ts > half").drop("half"), f"{folder}/log", 1)
    camera_log.append_frames(live.end_mark(ends, "ts", 365 * 86400.0), f"{folder}/log", 2, files=1)
    out = spark.read.schema(go_on()).parquet(f"{folder}/out")
    rounded = ("fps", "lat_ms_p50", "lat_ms_p95", "face_rate")
    return out.select("session", "window_start_us", "frames", *[r6(c).alias(c) for c in rounded])


def ended_stream(spark, sf):
    """The event stream and a mark a year after its last frame, in a session of its own."""
    frames = event_stream(spark, sf)
    last = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("ts"))
    mark = cut(live.end_mark(last, "ts", 365 * 86400.0))
    return frames.unionByName(spark.readStream.schema(mark.schema).parquet(mark.inputFiles()[0].rsplit("/", 1)[0]))


@query(
    "monitor_events",
    f"""WITH {EV}, z AS (SELECT *, lag(face) OVER w AS had, CASE WHEN face THEN zone END AS gaze,
            lag(CASE WHEN face THEN zone END IGNORE NULLS) OVER w AS was FROM ev WINDOW w AS (PARTITION BY s ORDER BY frame))
        SELECT CAST(s AS VARCHAR) AS session, event_id AS frame, CASE WHEN face THEN 'face_regained' ELSE 'face_lost' END AS event,
          NULL AS before, NULL AS after FROM z WHERE had IS NOT NULL AND had <> face
        UNION ALL SELECT CAST(s AS VARCHAR), event_id, 'gaze_change', was, gaze FROM z WHERE gaze <> was
        UNION ALL SELECT CAST(s AS VARCHAR), max_by(event_id, frame), 'stop', NULL, NULL FROM z GROUP BY s""",
)
def monitor_events(spark, sf):
    """Face and gaze changes and the stop of every session, votes reaching back a moment only."""
    config = monitor.MonitorConfig(
        classify=lambda window: 0, window=1, distraction=None, gaze_min_s=1.0, gaze_audible_s=None, gaze_vote_s=1e-7,
        metrics_s=1e9, idle_s=40 * 86400.0, emit_frames=False,
    )
    out = run_stream(spark, monitor.monitor_stream(ended_stream(spark, sf), config, "0 seconds"))
    kept = out.filter(F.col("event").isin("face_lost", "face_regained", "gaze_change", "stop"))
    return kept.select("session", "frame", "event", F.col("from").alias("before"), F.col("to").alias("after"))


# The monitor as it runs in a car: all three tracks, production parameters, metrics. Eight
# cameras share the events, so that windows of 150 faces fill.
_UP, _DOWN, _AFTER = LIVE_PARAMS
_STEPS = f"{_UP} AS e, {_DOWN} AS d, {_AFTER} AS a"
_NAMES = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(TIER_NAMES))
_LIVE = f"""WITH RECURSIVE raw AS MATERIALIZED (
    SELECT user_id % 8 AS s, event_id, epoch_us(ts) AS us, value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k,
      CASE event_type WHEN 'view' THEN 'front' ELSE event_type END AS zone,
      row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS frame FROM events),
  ev AS MATERIALIZED (SELECT *, k % 10 <> 0 AS face FROM raw),
  f AS MATERIALIZED (SELECT s, frame AS raw, row_number() OVER w - 1 AS frame, avg(value) OVER (w ROWS BETWEEN 149 PRECEDING AND CURRENT ROW) AS m
    FROM ev WHERE face WINDOW w AS (PARTITION BY s ORDER BY frame)),
  fl AS MATERIALIZED (SELECT s, raw, frame, CASE WHEN frame < 149 THEN 0 WHEN m >= 52.0013 THEN 2 WHEN m >= 48.0017 THEN 1 ELSE 0 END AS level, {_STEPS} FROM f),
  {fold_sql("fl", "ff")},
  p AS MATERIALIZED (SELECT s, frame, value / 193.0 AS p0, k / 97.0 AS p1, row_number() OVER (PARTITION BY s ORDER BY frame) - 1 AS q
    FROM ev WHERE (frame + 1) % 5 = 0 AND face),
  ema AS (SELECT s, frame, q, CAST(p0 AS DOUBLE) AS x0, CAST(p1 AS DOUBLE) AS x1 FROM p WHERE q = 0
    UNION ALL SELECT p.s, p.frame, p.q, 0.5 * p.p0 + 0.5 * x0, 0.5 * p.p1 + 0.5 * x1 FROM ema JOIN p ON p.s = ema.s AND p.q = ema.q + 1),
  h AS (SELECT ev.s, ev.frame, last_value(x0 IGNORE NULLS) OVER w AS x0, last_value(x1 IGNORE NULLS) OVER w AS x1
    FROM ev LEFT JOIN ema ON ema.s = ev.s AND ema.frame = ev.frame WINDOW w AS (PARTITION BY ev.s ORDER BY ev.frame)),
  act AS MATERIALIZED (SELECT s, frame, CASE WHEN x0 IS NULL OR (0.55 > x0 AND 0.55 > x1) THEN 'safe_drive' WHEN x0 >= x1 THEN 'radio' ELSE 'drinking' END AS activity FROM h),
  g AS MATERIALIZED (SELECT s, frame, CASE WHEN activity = 'safe_drive' THEN 0 ELSE 1 END AS level, {_STEPS} FROM act),
  {fold_sql("g", "gg", top=1)},
  ep AS (SELECT *, sum(CASE WHEN face THEN 0 ELSE 1 END) OVER (PARTITION BY s ORDER BY frame) AS epoch FROM ev),
  v AS (SELECT a.s, a.frame, b.zone, count(*) AS n, max(b.frame) AS last FROM ep AS a JOIN ep AS b
    ON a.s = b.s AND a.epoch = b.epoch AND a.face AND b.face AND b.frame <= a.frame AND b.us >= a.us - 1000000 GROUP BY ALL),
  best AS (SELECT s, frame, zone FROM (SELECT *, row_number() OVER (PARTITION BY s, frame ORDER BY n DESC, last DESC) AS rn FROM v) AS t WHERE rn = 1),
  o AS (SELECT ev.s, ev.frame, us, best.zone AS gaze, coalesce(best.zone <> 'front', false) AS off
    FROM ev LEFT JOIN best ON best.s = ev.s AND best.frame = ev.frame),
  i AS (SELECT *, sum(CASE WHEN off THEN 0 ELSE 1 END) OVER (PARTITION BY s ORDER BY frame) AS isl FROM o),
  away AS (SELECT s, frame, gaze, off, us - min(CASE WHEN off THEN us END) OVER (PARTITION BY s, isl) AS t FROM i),
  j AS (SELECT ev.s, ev.frame, ev.event_id, ev.us, ev.value, ev.face, activity, gaze,
      CASE WHEN NOT off THEN 0 WHEN t >= 4000000 THEN 2 WHEN t >= 2000000 THEN 1 ELSE 0 END AS gaze_tier,
      coalesce(last_value(CASE WHEN ff.committed = 2 AND ff.held >= ff.a THEN 3 ELSE ff.committed END IGNORE NULLS) OVER w, 0) AS fatigue_tier,
      coalesce(last_value(ff.level IGNORE NULLS) OVER w, 0) AS fatigue,
      CASE WHEN gg.committed = 1 AND gg.held >= gg.a THEN 2 ELSE gg.committed END AS distraction_tier
    FROM ev JOIN away ON away.s = ev.s AND away.frame = ev.frame JOIN act ON act.s = ev.s AND act.frame = ev.frame
    JOIN gg ON gg.s = ev.s AND gg.frame = ev.frame LEFT JOIN fl ON fl.s = ev.s AND fl.raw = ev.frame
    LEFT JOIN ff ON ff.s = fl.s AND ff.frame = fl.frame WINDOW w AS (PARTITION BY ev.s ORDER BY ev.frame)),
  fused AS (SELECT *, greatest(fatigue_tier, distraction_tier, gaze_tier) AS tier FROM j),
  turns AS (SELECT *, lag(tier) OVER (PARTITION BY s ORDER BY frame) AS was FROM fused),
  m AS (SELECT s, frame, us AS since, 0 AS part, false AS ended FROM ev WHERE frame = 0
    UNION ALL SELECT ev.s, ev.frame, CASE WHEN ev.us - m.since >= 5000000 THEN ev.us ELSE m.since END,
      m.part + CASE WHEN m.ended THEN 1 ELSE 0 END, ev.us - m.since >= 5000000
    FROM m JOIN ev ON ev.s = m.s AND ev.frame = m.frame + 1),
  parts AS (SELECT m.s, part, bool_or(ended) AS ended, count(*) AS n, max(ev.us) AS till, arg_max(event_id, ev.frame) AS event_id,
      quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, avg(CASE WHEN face THEN 1.0 ELSE 0.0 END) AS faces
    FROM m JOIN ev ON ev.s = m.s AND ev.frame = m.frame GROUP BY m.s, part),
  firsts AS (SELECT s, min(us) AS us0, max(us) AS us1, arg_max(event_id, frame) AS last FROM ev GROUP BY s),
  timed AS (SELECT parts.*, till - coalesce(lag(till) OVER (PARTITION BY parts.s ORDER BY part), us0) AS spent FROM parts JOIN firsts USING (s)),
  rest AS (SELECT s, last, last IN (SELECT event_id FROM parts WHERE ended AND parts.s = firsts.s) AS closed FROM firsts),
  flushed AS (
    SELECT s, event_id, n, n / (spent / 1000000.0) AS fps, p50, p95, faces FROM timed WHERE ended
    UNION ALL SELECT s, event_id, n, CASE WHEN spent > 0 THEN n / (spent / 1000000.0) ELSE 0 END, p50, p95, faces FROM timed WHERE NOT ended
    UNION ALL SELECT s, last, 0, 0, 0, 0, 0 FROM rest WHERE closed)
  SELECT CAST(s AS VARCHAR) AS session, event_id AS frame, 'frame' AS event, NULL AS before, NULL AS after, fatigue, tier, fatigue_tier,
    distraction_tier, gaze_tier, activity, gaze AS gaze_zone, NULL AS frames, NULL AS fps, NULL AS lat_ms_p50, NULL AS lat_ms_p95, NULL AS face_rate FROM fused
  UNION ALL SELECT CAST(s AS VARCHAR), event_id, 'tier_change', CASE was {_NAMES} END, CASE tier {_NAMES} END, fatigue,
    NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM turns WHERE was <> tier
  UNION ALL SELECT CAST(s AS VARCHAR), event_id, 'metrics', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n, round(fps, 6),
    round(p50, 6), round(p95, 6), round(faces, 6) FROM flushed
  UNION ALL SELECT CAST(s AS VARCHAR), last, 'stop', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM firsts"""


@query("monitor_whole", _LIVE)
def monitor_whole(spark, sf):
    """Frame states, tier changes, metrics and stops of the live monitor with every track on."""

    def level(window):
        mean = window[:, 0].mean()
        return 2 if mean >= 52.0013 else 1 if mean >= 48.0017 else 0

    raw = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int")
    probabilities = F.array(F.col("value") / 193.0, k / 97.0, F.lit(0.55))
    frames = raw.select(
        (F.col("user_id") % 8).cast("string").alias("session"),
        F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts"),
        F.col("event_id").alias("frame"),
        (k % 10 != 0).alias("has_face"),
        F.array(F.col("value")).alias("features"),
        F.when(k % 10 != 0, probabilities).alias("probabilities"),
        F.when(F.col("event_type") == "view", "front").otherwise(F.col("event_type")).alias("zone"),
        (F.col("value") / 1000.0).alias("latency_s"),
    )
    last = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("ts"))
    mark = cut(live.end_mark(last, "ts", 365 * 86400.0))
    ended = frames.unionByName(spark.readStream.schema(mark.schema).parquet(mark.inputFiles()[0].rsplit("/", 1)[0]))
    config = monitor.MonitorConfig(classify=level, labels=("radio", "drinking", "safe_drive"), idle_s=40 * 86400.0)
    out = run_stream(spark, monitor.monitor_stream(ended, config, "0 seconds"))
    out = out.filter(F.col("event").isin("frame", "tier_change", "metrics", "stop") & (F.col("session") != "end of recording"))
    exact = ("session", "frame", "event", "fatigue", "tier", "fatigue_tier", "distraction_tier", "gaze_tier", "activity", "gaze_zone", "frames")
    rounded = ("fps", "lat_ms_p50", "lat_ms_p95", "face_rate")
    return out.select(*exact, F.col("from").alias("before"), F.col("to").alias("after"), *[r6(c).alias(c) for c in rounded])


@query(
    "resumed_extraction",
    """SELECT l_suppkey AS sample_id, count(*) AS frames, round(sum(l_quantity), 6) AS ear_total, round(max(l_tax), 6) AS mar_peak
       FROM lineitem GROUP BY 1""",
)
def resumed_extraction(spark, sf):
    """Per-sample features of an extraction that stops in its second batch and is run again."""
    folder = f"{stage_folder(spark)}/extraction-{uuid.uuid4().hex}"
    samples = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    samples.repartition(4, "sample_id").write.parquet(f"{folder}/manifest")
    frames = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "sample_id")

    def process(batch):
        return frames.join(batch, "sample_id").groupBy("sample_id").agg(
            F.count(F.lit(1)).alias("frames"), r6(F.sum("l_quantity")).alias("ear_total"), r6(F.max("l_tax")).alias("mar_peak")
        )

    started = []

    def stopping(batch):
        started.append(batch)
        if len(started) > 1:
            raise RuntimeError("the extraction is stopped")
        return process(batch)

    manifest = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/manifest")
    try:
        extraction.extract(manifest, f"{folder}/run", stopping)
    except StreamingQueryException:
        pass
    extraction.extract(manifest, f"{folder}/run", process)
    return extraction.extracted(spark, f"{folder}/run", process(samples).schema)
