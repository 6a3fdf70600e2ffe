"""How the given tables stand in for frame tables, and the registry of checked queries."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators.segments import SEGMENT_ROWS, SLICE_ROWS, index_rows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ZONES = ("click", "error", "purchase", "signup", "view")
HOUR_US = 3_600_000_000

#: Segment size of the checked queries; tests set a small one.
ROWS = int(os.environ.get("CHECK_ROWS", SEGMENT_ROWS))
SLICE = min(ROWS, SLICE_ROWS)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where plain SQL can say the same, its check."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wall_micros(ts: str) -> Column:
    """Microseconds of a zone-less timestamp, whatever the session time zone."""
    local = F.col(ts).cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(local, F.current_timezone()))


def r6(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular frames before numbering: session, time, signal, zone, level, face."""
    value = F.col("value")
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("s"),
        "event_id",
        wall_micros("ts").alias("us"),
        F.col("event_type").alias("zone"),
        "value",
        F.when(value >= 54.06, 2).when(value >= 20.28, 1).otherwise(0).alias("level"),
        k.alias("k"),
        (k % 10 != 0).alias("face"),
    )


def event_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Events as frames of a session per user, and the segment size."""
    rows = event_rows(spark, sf)
    return index_rows(rows, ["s"], ["us", "event_id"], "frame", SLICE), ROWS


def long_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Line items as long sessions per supplier, and the segment size."""
    items = table(spark, sf, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    rows = items.select(
        F.col("l_suppkey").alias("s"),
        *order,
        F.col("l_quantity").alias("ear"),
        F.col("l_tax").alias("mar"),
        (F.col("l_discount") * 100 - 5).alias("pitch"),
        "l_returnflag",
        "l_linestatus",
    )
    return index_rows(rows, ["s"], order, "frame", SLICE).drop(*order), ROWS


def clip_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Fatigue label per supplier session."""
    turn = F.col("s_suppkey") % 3
    label = F.when(turn == 0, "alert").when(turn == 1, "low_vigilance").otherwise("drowsy")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"), label.alias("label"))


def video_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Video label per user session."""
    turn = F.col("s") % 4
    label = (
        F.when(turn == 0, "Yawning")
        .when(turn == 1, "Talking")
        .when(turn == 2, "Talking&Yawning")
        .otherwise("Normal")
    )
    sessions = table(spark, sf, "events").select(F.col("user_id").alias("s")).distinct()
    return sessions.withColumn("label", label)


EV = """ev AS (
  SELECT user_id AS s, event_id, epoch_us(ts) AS us, event_type AS zone, value,
    CASE WHEN value >= 54.06 THEN 2 WHEN value >= 20.28 THEN 1 ELSE 0 END AS level,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) % 10 <> 0 AS face,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame
  FROM events)"""

LF = """lf AS (
  SELECT l_suppkey AS s, l_quantity AS ear, l_tax AS mar, l_discount * 100 - 5 AS pitch,
    l_returnflag, l_linestatus,
    row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS frame
  FROM lineitem)"""

CLIPS = """clips AS (
  SELECT s_suppkey AS s,
    CASE s_suppkey % 3 WHEN 0 THEN 'alert' WHEN 1 THEN 'low_vigilance' ELSE 'drowsy' END AS label
  FROM supplier)"""

VIDEOS = """videos AS (
  SELECT DISTINCT user_id AS s,
    CASE user_id % 4 WHEN 0 THEN 'Yawning' WHEN 1 THEN 'Talking' WHEN 2 THEN 'Talking&Yawning'
      ELSE 'Normal' END AS label
  FROM events)"""

# Level of a long session: rolling mean of the last 20 signals, 0 until 20 are there.
LEVELS = """levels AS (
  SELECT s, frame, CASE WHEN frame < 19 THEN 0 WHEN m >= 27.5 THEN 2 WHEN m >= 24 THEN 1 ELSE 0 END AS level
  FROM (SELECT s, frame, avg(ear) OVER (PARTITION BY s ORDER BY frame
          ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM lf) AS rolled)"""


def fold_sql(source: str, name: str = "fold", top: int = 2, extra: str = "", params: str = "") -> str:
    """The alert machine step by step as a recursive query over ``source(s, frame, level)``.

    ``source`` also provides e, d and a (and ``extra`` columns that tell sessions apart).
    """
    x = "".join(f"{c}, " for c in extra.split(",") if c)
    on = "".join(f" AND n.{c} = p.{c}" for c in extra.split(",") if c)
    nx = "".join(f"n.{c}, " for c in extra.split(",") if c)
    cnt = "CASE WHEN n.level = p.level THEN p.cnt + 1 ELSE 1 END"
    commit = (
        f"CASE WHEN n.level > p.committed AND ({cnt}) >= n.e THEN n.level "
        f"WHEN n.level < p.committed AND ({cnt}) >= n.d THEN n.level ELSE p.committed END"
    )
    first = "CASE WHEN level > 0 AND e <= 1 THEN level ELSE 0 END"
    return f"""{name} AS (
  SELECT s, {x}frame, level, 1 AS cnt, {first} AS committed,
    CASE WHEN {first} = {top} THEN 1 ELSE 0 END AS held, a
  FROM {source} WHERE frame = 0
  UNION ALL
  SELECT n.s, {nx}n.frame, n.level, {cnt}, {commit},
    CASE WHEN ({commit}) = {top} THEN p.held + 1 ELSE 0 END, n.a
  FROM {name} AS p JOIN {source} AS n ON n.s = p.s AND n.frame = p.frame + 1{on})"""


TIER = "CASE WHEN committed = 2 AND held >= a THEN 3 ELSE committed END"
BINARY_TIER = "CASE WHEN committed = 1 AND held >= a THEN 2 ELSE committed END"
