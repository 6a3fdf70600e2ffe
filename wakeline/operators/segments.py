"""Ordered scans over sessions of any length.

Most sessions are short; one may hold a third of a table. There is one plan for both:
sessions are cut into *segments* of at most ``rows`` frames, every window runs inside a
segment, and what crosses a border travels in one of two ways:

``halo``
    for bounded look-back or look-ahead: the few rows near a border are also given to the
    neighbouring segment. No join, one exchange.
``attach_carry``
    for unbounded look-back: each segment is reduced to one summary row, the summaries
    (rows / segment size of them) are scanned per session, and the carried value is joined
    back on the segment key the rows are already partitioned by.

Where rows have no frame number yet, they are cut at quantiles of a sketch of their whole
order (`slice_by_order`), a literal table, so slices are even whatever the order's values look
like. Segments and slices are functions of the row, so a recomputed task gives the same.
Because a carry reads its input twice, operators made of several scans write it out in
between (`cut`).
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import cache
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

SEGMENT_ROWS = 1 << 20
SLICE_ROWS = 1 << 17
#: Most bounds a table is cut at, and rows of the sketch for each of them.
MOST_BOUNDS = 4096
SKETCH = 32
SEG = "_seg"
SLICE = "_slice"


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="wakeline-")


def stage_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may do without one; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return (folder or _own_folder()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write an intermediate result once, so that it is not computed for every reader.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def within(keys: Sequence[str], part: str = SEG) -> list[str]:
    """Partitioning of a scan: the segments (or slices) of the sessions."""
    return [*keys, part]


def scan(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    """From the first row of the partition up to and including the current one."""
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def segment(df: DataFrame, frame: str, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Number the segments of a table whose ``frame`` is unique per session."""
    return df.withColumn(SEG, F.expr(f"`{frame}` div {rows}"))


def halo(
    df: DataFrame, frame: str, before: int = 0, after: int = 0, rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Segments that also see ``before`` rows of the previous and ``after`` of the next one.

    ``frame`` must be dense per session (0, 1, 2, …; see :func:`index_rows`). Drop the rows
    a segment only borrows with :func:`own_rows` at the end.
    """
    if before < 0 or after < 0:
        raise ValueError("halo sizes must not be negative")
    if max(before, after) > rows:
        raise ValueError(f"a halo of {max(before, after)} rows needs segments of at least that size")
    home = F.expr(f"`{frame}` div {rows}")
    inside = F.expr(f"`{frame}` % {rows}")
    targets = [home]
    if before:
        targets.append(F.when(inside >= rows - before, home + 1))
    if after:
        targets.append(F.when((inside < after) & (home > 0), home - 1))
    if len(targets) == 1:
        return df.withColumn(SEG, home)
    return df.withColumn(SEG, F.explode(F.array_compact(F.array(*targets))))


def own_rows(df: DataFrame, frame: str, rows: int = SEGMENT_ROWS) -> DataFrame:
    return df.filter(f"`{frame}` div {rows} = {SEG}").drop(SEG)


def attach_carry(
    scanned: DataFrame,
    base: DataFrame,
    keys: Sequence[str],
    aggs: Mapping[str, Column],
    carries: Mapping[str, Callable[[WindowSpec], Column]],
    part: str = SEG,
    following: bool = False,
) -> DataFrame:
    """Join to every row what the earlier (or later) segments of its session left behind.

    ``aggs`` reduce each segment of ``base`` to a summary row; each entry of ``carries``
    builds its column from a window over the summary rows strictly before (after) the
    current segment. Keys are not null.
    The join is inner, so that both of its sides start from the same filtered scan and
    Spark can share their exchange.
    """
    order = W.partitionBy(*keys).orderBy(part)
    span = (
        order.rowsBetween(1, W.unboundedFollowing)
        if following
        else order.rowsBetween(W.unboundedPreceding, -1)
    )
    summary = base.groupBy(*keys, part).agg(*[c.alias(n) for n, c in aggs.items()])
    carried = summary.select(*keys, part, *[make(span).alias(n) for n, make in carries.items()])
    return scanned.join(carried, [*keys, part])


def order_bounds(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SLICE_ROWS
) -> DataFrame:
    """Where to cut a table into even stretches of (keys, order): ``keys, _bounds``.

    The bounds are quantiles of a sketch of the rows: those whose hash of keys and order is
    among the smallest, whatever task reads them, so sketches merge by union and the bounds
    depend on nothing but the rows. About ``rows`` rows lie between two bounds, more in tables
    of over ``rows * MOST_BOUNDS`` rows, so the sketch fits the driver and the bounds are a
    literal table that can be broadcast. Sessions between two bounds are not in it.
    """
    count = df.count()
    wanted = min(-(-count // rows) - 1, MOST_BOUNDS)
    picked: list[Row] = []
    if wanted > 0:
        share = min(1.0, SKETCH * (wanted + 1) / count)
        low = F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 30)) < math.ceil(share * (1 << 30))
        sketch = df.select(*keys, *order).where(low).orderBy(*keys, *order).collect()
        picked = [sketch[len(sketch) * i // (wanted + 1)] for i in range(1, wanted + 1)] if sketch else []
    if not picked:  # a table without rows, which the optimizer takes out of joins
        return df.select(*keys, F.array(F.struct(*order)).alias("_bounds")).limit(0)
    table = [
        (*key, [tuple(r[c] for c in order) for r in stretch])
        for key, stretch in groupby(picked, key=lambda r: tuple(r[c] for c in keys))
    ]
    place = T.StructType([T.StructField(c, df.schema[c].dataType) for c in order])
    fields = [*(df.schema[c] for c in keys), T.StructField("_bounds", T.ArrayType(place))]
    return df.sparkSession.createDataFrame(table, T.StructType(fields))


def _cut_at(df: DataFrame, bounds: DataFrame, keys: Sequence[str], order: Sequence[str], how: str) -> DataFrame:
    """Adds the slice: how many bounds of the session lie at or before the row."""
    here, end = F.struct(*order), F.size("_bounds")

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        after = F.get("_bounds", mid) <= here
        lo = F.when((s["lo"] < s["hi"]) & after, mid + 1).otherwise(s["lo"])
        hi = F.when((s["lo"] < s["hi"]) & ~after, mid).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(end + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), end.alias("hi"))
    place = F.aggregate(steps, start, half, lambda s: s["lo"])
    # At most MOST_BOUNDS bounds are broadcast.
    on = list(keys) if keys else F.lit(True)
    out = df.join(F.broadcast(bounds), on, how)
    return out.withColumn(SLICE, F.coalesce(place, F.lit(0)).cast("bigint")).drop("_bounds")


def slice_by_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SLICE_ROWS
) -> DataFrame:
    """Cut a table into even stretches of (keys, order): adds the slice number.

    Slices are per session and cut at literal bounds (:func:`order_bounds`), so a row's slice
    is a function of the row: nothing is moved or written, and neither outliers nor a constant
    leading column nor text that starts alike makes one slice long. Rows that agree in keys and
    order stay together.
    """
    return _cut_at(df, order_bounds(df, keys, order, rows), keys, order, "left")


def index_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "frame",
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """Dense 0-based position of every row in its session.

    ``order`` must be a total order. Rows are numbered inside their slices; where a session has
    several, the sizes of its earlier slices are added, so a long session is numbered by many
    tasks, at one exchange for all sessions.
    """
    bounds = order_bounds(df, keys, order, rows)
    sliced = _cut_at(df, bounds, keys, order, "left")
    inside = F.row_number().over(W.partitionBy(*within(keys, SLICE)).orderBy(*order))
    # Only sessions that are cut have anything to add: at most twice as many slices as bounds.
    cuts = _cut_at(df.select(*keys, *order), bounds, keys, order, "inner")
    sizes = cuts.groupBy(*within(keys, SLICE)).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*keys, SLICE, F.sum("_n").over(earlier).alias("_before"))
    known = sliced.withColumn("_rn", inside).join(F.broadcast(before), within(keys, SLICE), "left")
    position = F.coalesce("_before", F.lit(0)).cast("bigint") + F.col("_rn") - 1
    return known.withColumn(out, position).drop(SLICE, "_rn", "_before")


def hold_last(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    value: str | Column,
    out: str,
    rows: int = SEGMENT_ROWS,
    include_current: bool = True,
) -> DataFrame:
    """Last non-null value so far; over the rows before the current one on request."""
    named = df.withColumn(out, value if isinstance(value, Column) else F.col(value))
    base = segment(named, frame, rows)
    w = W.partitionBy(*within(keys)).orderBy(frame)
    span = w.rowsBetween(W.unboundedPreceding, W.currentRow if include_current else -1)
    local = base.withColumn("_held", F.last(out, ignorenulls=True).over(span))
    known = attach_carry(
        local,
        base,
        keys,
        {"_tail": F.max_by(out, F.when(F.col(out).isNotNull(), F.col(frame)))},
        {"_carry": lambda s: F.last("_tail", ignorenulls=True).over(s)},
    )
    return known.withColumn(out, F.coalesce("_held", "_carry")).drop("_held", "_carry", SEG)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    frame: str,
    value: Column,
    out: str,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Cumulative sum over the whole session, current row included."""
    base = segment(df.withColumn("_v", value), frame, rows)
    local = base.withColumn(out, F.sum("_v").over(scan(within(keys), frame)))
    known = attach_carry(
        local,
        base,
        keys,
        {"_s": F.sum("_v")},
        {"_carry": lambda s: F.sum("_s").over(s)},
    )
    total = F.coalesce(out, F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return known.withColumn(out, total).drop("_carry", "_v", SEG)
