"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets four counts. Documents that pass the base rules feed one sketch per
language, source and measure: a log-linear histogram whose buckets hold an integer to one
part in 32. Two sketches merge by adding counts, so a source with few documents borrows the
merged sketch of its language, or of everything. Quartiles of a sketch give fences, which
are joined to the documents and decide.

The sketch is exact about ranks and the same whatever order rows arrive in.

Defined results: a null text has no words and fails the base rules; null languages and
sources are groups of their own; repeated rows are judged each; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm.staging import dropped, staged
from wakeline.llm.words import (
    IS_CODE_POINT,
    IS_SEPARATOR,
    Chunk,
    chunks,
    keyed,
    sequences,
    span_hashes,
    words,
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
MIN_DOCS = 200
SPREAD = 3

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True

#: Measure: (numerator, parts, least distance of the fence from the quartile, lower fence too).
MEASURES = {
    "symbols": ("n_symbols", 1000, 100, False),
    "dup_lines": ("n_dup_lines", 1000, 100, False),
    "repeats": ("n_repeat_words", 1000, 350, False),
    "word_length": ("word_chars", 100, 200, True),
}


def _repeated_lines(chunk: Chunk) -> np.ndarray:
    breaks = np.flatnonzero(chunk.data == 10)
    start = np.union1d(chunk.offsets[:-1][np.diff(chunk.offsets) > 0], breaks + 1)
    start = start[start < len(chunk.data)]
    text = np.searchsorted(chunk.offsets, start, side="right") - 1
    stop = np.minimum(np.append(start[1:], len(chunk.data)), chunk.offsets[text + 1])
    stop = stop - (chunk.data[stop - 1] == 10)
    filled = np.concatenate(([0], np.cumsum(~IS_SEPARATOR[chunk.data])))
    worded = filled[stop] > filled[start]
    start, stop, text = start[worded], stop[worded], text[worded]
    _, first = np.unique(keyed(span_hashes(chunk.data, start, stop), text), return_index=True)
    return np.bincount(text, minlength=chunk.texts) - np.bincount(text[first], minlength=chunk.texts)


def count_chunk(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    found = words(chunk)
    h = span_hashes(chunk.data, found.start, found.end)
    windows = sequences(h, 3)
    here = np.flatnonzero(found.text[: len(windows)] == found.text[2:]) if len(windows) else np.zeros(0, int)
    _, which, times = np.unique(
        keyed(windows[here], found.text[here]), return_inverse=True, return_counts=True
    )
    again = np.zeros(len(h), bool)
    for i in range(3):
        again[here[times[which] > 1] + i] = True
    return {
        "n_words": np.bincount(found.text, minlength=chunk.texts),
        "word_chars": chunk.per_text(IS_CODE_POINT[chunk.data] & ~IS_SEPARATOR[chunk.data]),
        "n_symbols": chunk.per_text(_IS_SYMBOL[chunk.data]),
        "n_dup_lines": _repeated_lines(chunk) if len(chunk.data) else np.zeros(chunk.texts, int),
        "n_repeat_words": np.bincount(found.text[again], minlength=chunk.texts),
    }


def _count_batches(column: str, keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [count_chunk(c) for c in chunks(batch.column(column))]
            names = [n for n in batch.schema.names if keep_text or n != column]
            counts = [pa.array(np.concatenate([p[c] for p in parts] or [np.zeros(0)]).astype(np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + counts, names=names + list(COUNTS))

    return run


def text_counts(docs: DataFrame, keep: Sequence[str], text: str = "text", with_text: bool = False) -> DataFrame:
    """Columns ``keep`` and the counts of every whole text, which is ``text`` if it is kept."""
    rows = docs.select(*keep, F.col(text).cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if with_text or f.name != "text"]
    return rows.mapInArrow(_count_batches("text", with_text), ", ".join(fields + [f"{c} bigint" for c in COUNTS]))


def base_failed() -> Column:
    """Too few words, or more than half of them inside repeated three-word windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measure(name: str) -> Column:
    """A measure as an integer: parts per word; 0 without words."""
    count, parts, _, _ = MEASURES[name]
    return F.when(F.col("n_words") > 0, F.floor(parts * F.col(count) / F.col("n_words"))).otherwise(0).cast("long")


def bucket_of(value: Column) -> Column:
    """Bucket of a non-negative integer: itself below 64, then 32 buckets to each doubling."""
    e = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(e * 32 + F.call_function("shiftrightunsigned", value, e)).cast("long")


def least_of(bucket: Column) -> Column:
    """Smallest integer of a bucket."""
    e = (F.floor(bucket / 32) - 1).cast("int")
    return F.when(bucket < 64, bucket).otherwise(F.call_function("shiftleft", bucket - e * 32, e)).cast("long")


def sketches(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketch rows ``by, measure, bucket, n`` of the documents that pass the base rules."""
    pairs = [
        F.struct(F.lit(m).alias("measure"), bucket_of(measure(m)).alias("bucket")) for m in MEASURES
    ]
    rows = counted.where(~base_failed()).select(*by, F.explode(F.array(*pairs)).alias("p"))
    return rows.groupBy(*by, "p.measure", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge a sketch to the groups ``by``: documents, first and third quartile per measure.

    A group has as many rows as filled buckets, which integers of 64 bits bound by 1,920.
    """
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*by, "measure")
    ranked = merged.select(
        *by,
        "measure",
        "bucket",
        F.sum("n").over(w.orderBy("bucket")).alias("upto"),
        F.sum("n").over(w).alias("docs"),
    )

    def at(quarter: int) -> Column:
        return least_of(F.min(F.when(4 * F.col("upto") >= quarter * F.col("docs"), F.col("bucket"))))

    return ranked.groupBy(*by, "measure").agg(
        F.first("docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3")
    )


def fences(sketch: DataFrame, by: Sequence[str], min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per group ``by``: lowest and highest accepted value of each measure.

    The narrowest of (all of ``by``, first of ``by``, everything) with ``min_docs``
    documents gives the quartiles; everything does when none has as many.
    """
    levels = [list(by), [by[0]], []]
    own, wide, whole = (quartiles(sketch, keys) for keys in levels)

    def renamed(df: DataFrame, tag: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{tag}_{c}" for c in ("docs", "q1", "q3")})

    rows = renamed(own, "a")
    wide = renamed(wide, "b").withColumnsRenamed({by[0]: "_wide", "measure": "_measure"})
    rows = rows.join(wide, rows[by[0]].eqNullSafe(wide["_wide"]) & (rows["measure"] == wide["_measure"]))
    rows = rows.join(renamed(whole, "c"), "measure")

    def pick(c: str) -> Column:
        return (
            F.when(F.col("a_docs") >= min_docs, F.col(f"a_{c}"))
            .when(F.col("b_docs") >= min_docs, F.col(f"b_{c}"))
            .otherwise(F.col(f"c_{c}"))
        )

    rows = rows.select(*by, "measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    out = []
    for m, (_, _, margin, two_sided) in MEASURES.items():
        reach = F.greatest(SPREAD * (F.col("q3") - F.col("q1")), F.lit(margin))
        here = F.col("measure") == m
        out.append(F.max(F.when(here, F.col("q3") + reach)).alias(f"{m}_high"))
        if two_sided:
            out.append(F.max(F.when(here, F.col("q1") - reach)).alias(f"{m}_low"))
    return rows.groupBy(*by).agg(*out)


def _limits(counted: DataFrame, groups: Sequence[str], min_docs: int) -> DataFrame:
    limits = fences(sketches(counted, groups), groups, min_docs)
    return limits.withColumnsRenamed({g: f"{g}_f" for g in groups})


def _judged(counted: DataFrame, limits: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counted rows with their fences, and the verdict as ``kept``."""
    on = None
    for g in groups:
        same = counted[g].eqNullSafe(limits[f"{g}_f"])
        on = same if on is None else on & same
    inside = F.lit(True)
    for m, (_, _, _, two_sided) in MEASURES.items():
        inside = inside & (measure(m) <= F.col(f"{m}_high"))
        if two_sided:
            inside = inside & (measure(m) >= F.col(f"{m}_low"))
    return counted.join(limits, on, "left").withColumn("kept", F.coalesce(~base_failed() & inside, F.lit(False)))


def judge(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    by: Sequence[str] = ("lang", "source"),
    text: str = "text",
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Columns ``keep``, the counts, ``base_failed`` and ``kept`` of every row of ``docs``.

    The counts are written once: the sketches and the joined filter both read them.
    """
    groups = [f"_by{i}" for i in range(len(by))]
    named = docs.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)],
        *[F.col(b).alias(g) for b, g in zip(by, groups)],
        F.col(text).alias("text"),
    )
    counted = staged(text_counts(named, [c for c in named.columns if c != "text"]))
    return _judged(counted, _limits(counted, groups, min_docs), groups).select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)],
        *COUNTS,
        base_failed().alias("base_failed"),
        "kept",
    )


def keep_good(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows of ``docs`` that the rules keep, unchanged.

    The fences, a row for each language and source, are fitted on the counts and joined to the
    texts where they are read, which counts them again: no text is moved to meet its verdict.
    """
    groups = ["_by0", "_by1"]
    by = [F.col("lang").alias(groups[0]), F.col("source").alias(groups[1])]
    counted = staged(text_counts(docs.select(*by, F.col("text").alias("text")), groups))
    limits = staged(_limits(counted, groups, min_docs))
    dropped(counted)
    # Columns of the documents may have any name.
    own = {f"_c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(o) for o, c in own.items()], *by)
    text = next(o for o, c in own.items() if c == "text")
    rows = text_counts(rows, [c for c in rows.columns if c != text], text, with_text=True)
    kept = _judged(rows, limits, groups).where("kept")
    return kept.select(*[F.col("text" if c == "text" else o).cast(docs.schema[c].dataType).alias(c) for o, c in own.items()])
