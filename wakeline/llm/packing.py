"""Best-fit packing by minimum bin slack.

Token pieces differ only in length as far as packing goes, so the packing is decided on the
histogram of lengths, which has one entry per length up to the capacity, whatever the corpus
holds. Each step takes the longest length left and finds, by dynamic programming over bit
sets of reachable sums, the fullest sequence that can be made with it from the lengths left.
That combination is taken as often as the counts allow. A step uses a length up or leaves
fewer of it than fit a sequence, so there are at most about C + C ln C steps for a capacity C.

Pieces then find their places: a piece is the r-th of its length, and the plan says in which
sequence, and where, the r-th piece of a length lies. Ranks come from counts per input
part and length, so no task sees more than its part.

Defined results: a null or empty text is one piece holding the closing id; a text longer than
the capacity is cut into pieces of the capacity of which the first may be shorter; repeated
rows and null ids are packed each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm.staging import staged
from wakeline.llm.tokens import default_path, encode

CAPACITY = 1024
CLOSING = 2


def fullest(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """Pieces (length: how many) whose sum is the largest not above ``room``.

    Bit s of ``reach`` says that s can be made; longer lengths are tried first, in lots of 1,
    2, 4, ... pieces, and the way back prefers them.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:
            lot = min(lot, left)
            more = (reach | reach << (lot * length)) & full
            if more != reach:
                steps.append((reach, length, lot))
                reach = more
            left, lot = left - lot, 2 * lot
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, {}
    for before, length, lot in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + lot
            total -= lot * length
    return taken


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, and how many sequences of each; every piece is in one."""
    counts = {x: n for x, n in histogram.items() if n}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        combination = fullest(counts, capacity - longest)
        counts[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in combination.items())
        for x, n in combination.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((combination, times))
    return out


class Places:
    """Sequence and offset of the r-th piece of a length under a plan."""

    def __init__(self, combinations: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for combination, times in combinations:
            offset = 0
            for length in sorted(combination, reverse=True):
                n, rank = combination[length], used.get(length, 0)
                rows.setdefault(length, []).append((rank, n, sequence, offset))
                used[length] = rank + n * times
                offset += n * length
            sequence += times
        self.rows = {x: np.array(r, np.int64) for x, r in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            rows = self.rows[int(x)]
            row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
            past = rank[at] - row[:, 0]
            sequence[at] = row[:, 2] + past // row[:, 1]
            offset[at] = row[:, 3] + past % row[:, 1] * x
        return sequence, offset


_PIECES = "part bigint, id {}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint{}"


def _pieces(path: str, capacity: int, closing: int, with_ids: bool) -> Callable:
    """Texts to pieces; ``part`` and ``nth`` number the pieces of a length within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, owner, piece, start, length, crc, body = batch.column("id"), [], [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                tokens = np.append(encode(path, text.as_py() or ""), np.uint32(closing)).astype("<u4")
                first = len(tokens) % capacity or capacity
                cuts = [0, *range(first, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    raw = tokens[a:b].tobytes()
                    owner.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw))
                    body.append(raw)
            sizes = np.array(length, np.int64)
            nth = np.empty(len(sizes), np.int64)
            order = np.argsort(sizes, kind="stable")
            count = np.bincount(sizes, minlength=capacity + 1)
            nth[order] = np.arange(len(sizes)) - np.repeat(np.cumsum(count) - count, count)
            nth += seen[sizes]
            seen += count
            columns = [
                pa.array(np.full(len(sizes), part, np.int64)),
                ids.take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(sizes),
                pa.array(crc, pa.int64()),
                pa.array(nth),
            ]
            names = ["part", "id", "piece", "start", "length", "ids_crc32", "nth"]
            if with_ids:
                columns.append(pa.array(body, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _place(places) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            found = places.value.find(length, rank)
            names = [n for n in batch.schema.names if n not in ("part", "nth", "before")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(x) for x in found], names=[*names, "sequence_id", "offset"]
            )

    return run


def pack(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    closing: int = CLOSING,
    with_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece, and the
    ids (little-endian 32-bit) if ``with_ids``.

    The pieces are written once: the histogram, the counts per part and the pieces themselves
    are read from there, so numbers stay as they are if a task runs again.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = _PIECES.format(kind, ", ids binary" if with_ids else "")
    pieces = staged(rows.mapInArrow(_pieces(path or default_path(), capacity, closing, with_ids), schema))
    counts = staged(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    # One row per length: at most ``capacity``.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(
        F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    ranked = pieces.join(before, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).drop("_part", "_length")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name not in ("part", "nth", "before")]
    out = ranked.mapInArrow(_place(places), ", ".join([*fields, "sequence_id bigint", "offset bigint"]))
    return out.withColumnRenamed("id", id)
