"""Exact token-length histogram and what it answers for every context limit.

Documents are counted by group and encoded length; sums over shorter and over longer lengths
then give, for every length as a limit, how many documents fit, the tokens that truncation
keeps, and the quantile that the length is. Any other limit has the answers of the longest
length up to it.

Defined results: null and empty texts have length 0 (plus the closing id, if one is added);
null groups are groups; repeated rows count each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.llm.staging import staged
from wakeline.llm.tokens import default_path, encode

_SPAN = 1024
#: Context limits that are asked for whether a document has that length or not.
LIMITS = (128, 512, 1024, 2048, 4096, 8192, 32768, 131072)


def _lengths(path: str, closing: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(encode(path, t)) + closing if t else closing for t in (x.as_py() for x in batch.column("text"))]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [pa.array(sizes, pa.int64())], names=[*kept, "n_tokens"])

    return run


def token_lengths(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", path: str | None = None, closing: int = 0
) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` of every whole text; ``closing`` ids are added to each."""
    rows = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)], F.col(text).cast("string").alias("text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    out = rows.mapInArrow(_lengths(path or default_path(), closing), ", ".join([*fields, "n_tokens bigint"]))
    return out.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keep)})


def length_histogram(lengths: DataFrame, by: Sequence[str]) -> DataFrame:
    """Documents of each group and length."""
    return lengths.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limit_table(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for every group and length that occurs, read as a context limit.

    ``docs_within``, ``tokens_within``: documents no longer than it and their tokens;
    ``docs_beyond``, ``tokens_beyond``: the longer ones; ``truncated_tokens``: all tokens left
    when every document is cut to the limit; ``share_within``: the quantile that the limit is.

    Running sums go over spans of ``1,024`` lengths and then over the spans, so no window
    holds more than the lengths of a span or the spans of a group.
    """
    rows = histogram.withColumn("tokens", F.col("n_docs") * F.col("n_tokens")).withColumn(
        "span", F.floor(F.col("n_tokens") / _SPAN)
    )
    spans = rows.groupBy(*by, "span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    group = W.partitionBy(*by, F.floor(F.col("span") / _SPAN))
    top = W.partitionBy(*by)
    blocks = spans.groupBy(*by, F.floor(F.col("span") / _SPAN).alias("block")).agg(F.sum("d").alias("bd"), F.sum("t").alias("bt"))
    before = top.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        *by, "block",
        F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("bd0"), F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("bt0"),
        F.sum("bd").over(top).alias("all_docs"), F.sum("bt").over(top).alias("all_tokens"),
    )
    before = group.orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(
        *by, "span", F.floor(F.col("span") / _SPAN).alias("block"),
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
    )
    spans = _same(spans, blocks, [*by, "block"]).withColumn("d0", F.col("d0") + F.col("bd0")).withColumn("t0", F.col("t0") + F.col("bt0"))
    w = W.partitionBy(*by, "span").orderBy("n_tokens")
    rows = rows.select(*by, "span", "n_tokens", "n_docs", F.sum("n_docs").over(w).alias("d"), F.sum("tokens").over(w).alias("t"))
    rows = _same(rows, spans.drop("block", "bd0", "bt0"), [*by, "span"])
    within, tokens = F.col("d") + F.col("d0"), F.col("t") + F.col("t0")
    beyond = F.col("all_docs") - within
    return rows.select(
        *by,
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        within.alias("docs_within"),
        tokens.alias("tokens_within"),
        beyond.alias("docs_beyond"),
        (F.col("all_tokens") - tokens).alias("tokens_beyond"),
        (tokens + beyond * F.col("n_tokens")).alias("truncated_tokens"),
        (within / F.col("all_docs")).alias("share_within"),
    )


def at_limits(table: DataFrame, by: Sequence[str], limits: Sequence[int]) -> DataFrame:
    """The answers of a :func:`limit_table` at any limits, whether a document has that length
    or not: those of the longest length up to the limit, or of none."""
    if not limits or min(limits) < 0:
        raise ValueError("limits count tokens")
    at = F.struct("docs_within", "tokens_within")
    found = table.groupBy(*by).agg(
        *[F.max_by(at, F.when(F.col("context_limit") <= x, F.col("context_limit"))).alias(f"_at{i}") for i, x in enumerate(limits)],
        F.max(F.col("docs_within") + F.col("docs_beyond")).alias("_docs"),
        F.max(F.col("tokens_within") + F.col("tokens_beyond")).alias("_tokens"),
    )
    rows = F.array(*[F.struct(F.lit(x).cast("bigint").alias("context_limit"), F.col(f"_at{i}").alias("at")) for i, x in enumerate(limits)])
    found = found.select(*by, "_docs", "_tokens", F.inline(rows))
    within, tokens = (F.coalesce(F.col(f"at.{c}_within"), F.lit(0)) for c in ("docs", "tokens"))
    beyond = F.col("_docs") - within
    return found.select(
        *by,
        "context_limit",
        within.alias("docs_within"),
        tokens.alias("tokens_within"),
        beyond.alias("docs_beyond"),
        (F.col("_tokens") - tokens).alias("tokens_beyond"),
        (tokens + beyond * F.col("context_limit")).alias("truncated_tokens"),
        (within / F.col("_docs")).alias("share_within"),
    )


def quantile_lengths(table: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``share, n_tokens`` for every group: the least length that so many documents stay within."""
    if not shares or any(not 0.0 < s <= 1.0 for s in shares):
        raise ValueError("shares lie above 0 and up to 1")
    docs = F.col("docs_within") + F.col("docs_beyond")
    each = [
        F.struct(F.lit(s).alias("share"), F.min(F.when(F.col("docs_within") >= s * docs, F.col("context_limit"))).alias("n_tokens"))
        for s in shares
    ]
    return table.groupBy(*by).agg(F.array(*each).alias("_each")).select(*by, F.inline("_each"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def token_limits(
    docs: DataFrame, by: Sequence[str] = ("lang",), text: str = "text", path: str | None = None, closing: int = 0
) -> DataFrame:
    """Histogram and limit table of the documents, by group; ``by`` may be empty."""
    lengths = token_lengths(docs, by, text, path, closing)
    return limit_table(length_histogram(lengths, by), by)


def corpus_limits(
    docs: DataFrame, by: str = "lang", limits: Sequence[int] = LIMITS, text: str = "text", path: str | None = None, closing: int = 0
) -> DataFrame:
    """Limit table of every group and of the whole corpus (``whole``, its group null), at every
    length that occurs and at ``limits``.

    Texts are encoded once; the histogram is written, as both tables and all limits read it.
    """
    parts = staged(length_histogram(token_lengths(docs, [by], text, path, closing), [by]))
    every = parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    both = parts.withColumn("whole", F.lit(False)).unionByName(
        every.select(F.lit(None).cast(parts.schema[by].dataType).alias(by), "n_tokens", "n_docs", F.lit(True).alias("whole"))
    )
    group = [by, "whole"]
    table = staged(limit_table(both, group))
    given = at_limits(table, group, limits).withColumn("n_docs", F.lit(0).cast("bigint"))
    have = table.select(*[F.col(c).alias(f"_{c}") for c in (*group, "context_limit")])
    same = F.col(by).eqNullSafe(F.col(f"_{by}")) & (F.col("whole") == F.col("_whole")) & (F.col("context_limit") == F.col("_context_limit"))
    return table.unionByName(given.join(have, same, "left_anti"))
