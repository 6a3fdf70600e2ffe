"""Embedding whitening by spectral divide and conquer.

Entries become integers on a grid, so that sums over any number of rows, in any order, are
exact. Two passes over the vectors give the sums and, with every entry centred by the rounded
mean, the sums of products; what the rounding of the mean leaves is taken off exactly, and only
then does the covariance become a matrix of doubles. Polar decompositions (``qdwh``) split it
into its components on the driver: d squared numbers for d dimensions, whatever the rows. The
components are broadcast (d numbers each) and every row is projected on them in a third pass,
whose rows are written: the covariance of what was written says how far from white it is.

Defined results: null vectors and those with null or non-finite entries are left out; a shorter
vector has 0.0 where others have entries (so has an empty one, everywhere); null ids and
repeated rows are rows like others; components without variance cannot be whitened and are left
out, so a table of one vector, of equal vectors or of none gives no rows; entries beyond
``2**62`` on the grid count as that; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.qdwh import components
from wakeline.llm.staging import staged

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8

_LARGEST = float(1 << 62)
#: Rows taken at once, and the magnitude up to which their products add up exactly in doubles.
_ROWS = 4096
_EXACT = 1 << 20
_WIDE = pa.decimal128(38, 0)


def grid(vectors: pa.Array, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the vectors that count, their lengths, and all their entries on the grid."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    bounds = vectors.offsets.to_numpy()
    entries = vectors.values
    value = entries.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(value)
    size = np.diff(bounds)
    before = np.concatenate(([0], np.cumsum(bad)))
    known = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(known & (before[bounds[1:]] == before[bounds[:-1]]))
    lengths = size[good]
    at = np.repeat(bounds[:-1][good] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    with np.errstate(over="ignore"):
        cells = np.floor(value[at] * scale)
    return good, lengths, np.clip(cells, -_LARGEST, _LARGEST).astype(np.int64) + offset


def matrix(lengths: np.ndarray, entries: np.ndarray, centre: np.ndarray, offset: int) -> np.ndarray:
    """Rows less the centre; missing entries are 0.0 before they go on the grid."""
    d = len(centre)
    out = np.full((len(lengths), d), offset, np.int64)
    out[np.arange(d) < lengths[:, None]] = entries
    if len(out) and max(int(np.abs(out).max()), int(np.abs(centre).max(initial=0))) >= 1 << 61:
        return out.astype(object) - centre.astype(object)
    return out - centre


def products(y: np.ndarray) -> np.ndarray:
    """Exact y'y as Python integers."""
    if y.dtype != object and (not len(y) or int(np.abs(y).max()) < _EXACT):
        wide = y.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    exact = y.astype(object)
    return exact.T @ exact


def _sums(scale: int, offset: int) -> Callable:
    """Per task: how many vectors, and the sum and number of entries of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, count = 0, np.zeros(0, object), np.zeros(0, object)
        for batch in batches:
            _, lengths, entries = grid(batch.column("vector"), scale, offset)
            n += len(lengths)
            d = int(lengths.max(initial=0))
            if d > len(total):
                total = np.concatenate((total, np.zeros(d - len(total), object)))
                count = np.concatenate((count, np.zeros(d - len(count), object)))
            dim = np.arange(len(entries)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            low = entries & 0xFFFFFFFF
            for part, unit in ((entries >> 32, 1 << 32), (low, 1)):
                added = np.zeros(d, np.int64)
                np.add.at(added, dim, part)
                total[:d] += added.astype(object) * unit
            count[:d] += np.bincount(dim, minlength=d).astype(object)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *range(len(total))], pa.int32()),
                pa.array([0, *map(int, total)], _WIDE),
                pa.array([n, *map(int, count)], pa.int64()),
            ],
            names=["dim", "total", "n"],
        )

    return run


def _moments(scale: int, offset: int, centre) -> Callable:
    """Per task: sums of products of centred entries, the upper half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(centre.value)
        total = np.zeros((d, d), object)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                _, lengths, entries = grid(batch.column("vector").slice(at, _ROWS), scale, offset)
                total += products(matrix(lengths, entries, centre.value, offset))
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([int(x) for x in total[i, j]], _WIDE)],
            names=["i", "j", "total"],
        )

    return run


class Fit(NamedTuple):
    """Components of a fit list: ``vectors`` (a column each) with their ``values``, falling."""

    n: int
    centre: np.ndarray
    rest: np.ndarray  # sums less n times the centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(rows: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> Fit | None:
    """Components of all vectors of ``rows(vector)``; None without any vector or dimension."""
    spark = rows.sparkSession
    vectors = rows.select("vector")
    sums = vectors.mapInArrow(_sums(scale, offset), "dim int, total decimal(38,0), n bigint")
    # One row for each dimension.
    found = {r["dim"]: r for r in sums.groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}
    n, d = found[-1]["n"] if found else 0, len(found) - 1
    if not n or d < 1:
        return None
    total = [int(found[k]["total"]) + offset * (n - found[k]["n"]) for k in range(d)]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(total, centre)], object)
    moments = vectors.mapInArrow(_moments(scale, offset, spark.sparkContext.broadcast(centre)), "i int, j int, total decimal(38,0)")
    # d squared numbers, halved.
    exact = np.zeros((d, d), object)
    for r in moments.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        exact[r["i"], r["j"]] = exact[r["j"], r["i"]] = int(r["total"])
    centred = n * exact - np.outer(rest, rest)
    covariance = np.array([[x / (n * n) for x in row] for row in centred], np.float64)
    values, basis = components(covariance)
    return Fit(n, centre, rest, values, basis, float(np.trace(covariance)))


def _project(scale: int, offset: int, shared) -> Callable:
    """Rows to their exact deviation and their place along each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, k = shared.value
        n, rest = fitted.n, fitted.rest
        mean = np.array([r / n for r in rest], np.float64)
        turn = fitted.vectors[:, :k] / np.sqrt(fitted.values[:k])
        own = sum(int(r) * int(r) for r in rest)
        # Sums of d products of an entry below ``_EXACT`` and a rest of n / 2 at most.
        small = len(rest) * _EXACT * (n + 1) < 1 << 62
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                good, lengths, entries = grid(batch.column("vector").slice(at, _ROWS), scale, offset)
                y = matrix(lengths, entries, fitted.centre, offset)
                if y.dtype != object and small and (not len(y) or int(np.abs(y).max()) < _EXACT):
                    squares, across = (y * y).sum(axis=1), y @ rest.astype(np.int64)
                else:
                    exact = y.astype(object)
                    squares, across = (exact * exact).sum(axis=1), exact @ rest
                deviation = [n * n * int(a) - 2 * n * int(b) + own for a, b in zip(squares, across)]
                white = (y.astype(np.float64) - mean) @ turn
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(at, _ROWS).take(pa.array(good)),
                        pa.array(deviation, _WIDE),
                        pa.FixedSizeListArray.from_arrays(pa.array(white.reshape(-1)), k).cast(pa.list_(pa.float64())),
                    ],
                    names=["id", "deviation", "white"],
                )

    return run


def whiten(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    keep: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``.

    One row for each vector and each of the first ``keep`` components. ``deviation`` is the
    sum over dimensions of (n x - sums) squared as an exact decimal; ``identity_error`` is
    measured on the whitened rows.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    kind = given.schema["id"].dataType.simpleString()
    fitted = fit(given, scale, offset)
    k = 0
    if fitted is not None:
        floor = 8 * np.finfo(np.float64).eps * len(fitted.values) * max(float(fitted.values[0]), 0.0)
        k = min(keep, int((fitted.values > floor).sum()))
    if not k:
        columns = f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return spark.createDataFrame([], columns).withColumnRenamed("id", id)
    shared = spark.sparkContext.broadcast((fitted, k))
    white = staged(given.mapInArrow(_project(scale, offset, shared), f"id {kind}, deviation decimal(38,0), white array<double>"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    at = [F.get("white", F.lit(i)) for i in range(k)]
    found = white.agg(
        *[F.avg(at[i]).alias(f"m{i}") for i in range(k)], *[F.avg(at[i] * at[j]).alias(f"p{i}_{j}") for i, j in pairs]
    ).first()
    error = max(abs(found[f"p{i}_{j}"] - found[f"m{i}"] * found[f"m{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values[:k]])
    return white.select("id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        F.col("id").alias(id),
        (F.col("at") + 1).alias("component"),
        F.lit(fitted.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
