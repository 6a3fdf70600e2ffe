"""Secret scan with corpus-wide ownership frequency.

Every whole text is searched for credentials of known form (the base kinds) and for opaque
tokens of mixed characters. All values found, as hashes, are counted by the distinct
repositories and owners they occur with, over the whole corpus. A value that many owners or
repositories hold is a copied example; one that few hold looks like a live credential. Opaque
tokens count as secrets only if they look live, and add spans of kind ``live``; base spans
stay whatever they are.

Defined results: null and empty texts hold nothing; null repositories and owners are one
repository and owner; repeated rows are scanned each and are one occurrence; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.staging import staged, unused

KINDS = ("assign", "access", "hex", "live")
MIN_OWNERS = 5
MIN_REPOSITORIES = 8
MASK = "[secret]"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True)


def _opaque(value: str) -> bool:
    """Letters and digits without a pattern: at least three bits a character."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= 3.0


def find(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans and opaque tokens outside them, as ``(start, kind number, end, value)``."""
    base = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    base.sort(key=lambda s: s[:2])
    # Tokens ascend, so one walk over the base spans knows the furthest end of all that begin
    # before a token ends.
    more, at, reach = [], 0, 0
    for m in _OPAQUE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and _opaque(m[0]):
            more.append((m.start(), 3, m.end(), m[0]))
    return base, more


def joined(spans: Sequence[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        counts, digests, spans = [], [], []
        for text in batch.column("text"):
            base, more = find(text.as_py() or "")
            kinds = [s[1] for s in base]
            counts.append([kinds.count(k) for k in range(3)])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append([dict(start=a, kind=k, end=b, value=_digest(v)) for a, k, b, v in base + more])
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(n) for n in kept),
                pa.array(range(row, row + len(counts)), pa.int64()),
                *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
                pa.array(digests, pa.string()),
                pa.array(spans, _FOUND),
            ],
            names=[*kept, "row", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )
        row += len(counts)


def ownership(found: DataFrame) -> DataFrame:
    """``value, owners, repositories``: how many distinct ones hold each value."""
    held = found.select("value", "owner", "repository").distinct()
    owners = held.select("value", "owner").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    places = held.groupBy(F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("repositories"))
    return owners.join(places, F.col("value") == F.col("_v")).drop("_v")


def scan(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    owner: Sequence[str] = ("source",),
    repository: Sequence[str] = ("source", "lang"),
    min_owners: int = MIN_OWNERS,
    min_repositories: int = MIN_REPOSITORIES,
) -> DataFrame:
    """Columns ``keep``, base counts and digest, all spans, live and copied values of every row.

    ``secrets`` lists the spans with ``live`` for each; the scan is written once, as the
    corpus counts and the rows both come from it.
    """

    def named(columns: Sequence[str]):
        return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])), 256)

    rows = docs.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)],
        named(owner).alias("owner"),
        named(repository).alias("repository"),
        F.col(text).cast("string").alias("text"),
    )
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    fields += ["row bigint", "n_assign bigint", "n_access bigint", "n_hex bigint", "base_sha256 string"]
    fields.append("found array<struct<start:bigint,kind:int,end:bigint,value:bigint>>")
    scanned = staged(rows.mapInArrow(_scan, ", ".join(fields)))
    found = scanned.select("row", "owner", "repository", F.explode("found").alias("f")).select("row", "owner", "repository", "f.*")
    counts = staged(ownership(found)).withColumnRenamed("value", "_v")
    live = (F.col("owners") < min_owners) & (F.col("repositories") < min_repositories)
    spans = (
        found.join(counts, F.col("value") == F.col("_v"))
        .withColumn("live", live)
        .where(F.col("live") | (F.col("kind") < 3))
        .groupBy(F.col("row").alias("_row"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("secrets"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform("secrets", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>")
    out = scanned.join(staged(spans), F.col("row") == F.col("_row"), "left").withColumn("secrets", F.coalesce("secrets", empty))
    return out.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)],
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.array_join(shown, ",").alias("spans"),
        F.size(F.filter("secrets", lambda s: s["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter("secrets", lambda s: ~s["live"])).cast("bigint").alias("n_copied"),
        "secrets",
    )


def mask(text: str, spans: Sequence[tuple[int, int]]) -> str:
    """The text with every span, overlapping ones together, put out of sight."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mask(column: str, spans_in: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(column), batch.column(spans_in)
            done = [
                mask(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()]) if s.is_valid and t.is_valid else t.as_py()
                for t, s in zip(texts, spans)
            ]
            names = [n for n in batch.schema.names if n != spans_in]
            yield pa.RecordBatch.from_arrays(
                [pa.array(done, texts.type) if n == column else batch.column(n) for n in names], names=names
            )

    return run


def _suspect(column: str, flag: str) -> Callable:
    """Adds whether a text holds anything that may be a secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [any(find(t.as_py() or "")) for t in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.bool_())], names=[*batch.schema.names, flag])

    return run


def mask_live(docs: DataFrame, text: str = "text", **limits: int) -> DataFrame:
    """``docs`` with live-looking credentials masked in the text; other rows and columns as they are.

    Texts that hold something like a secret are set apart and scanned; spans depend on the text
    alone once the corpus is counted, so rows with equal texts share them. The other texts stay
    where they are read.
    """
    key, live, flag = unused(docs, "text_hash"), unused(docs, "live_spans"), unused(docs, "suspect")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    flagged = docs.mapInArrow(_suspect(text, flag), f"{kinds}, `{flag}` boolean")
    held = staged(flagged.where(flag).drop(flag))
    rows = held.select(F.sha2(text, 256).alias("hash"), F.col(text).alias("text"), "source", "lang")
    spans = scan(rows, keep=("hash",), **limits).where("n_live > 0")
    spans = staged(
        spans.select(F.col("hash").alias(key), F.filter("secrets", lambda s: s["live"]).alias(live)).dropDuplicates([key])
    )
    masked = held.join(spans, F.sha2(held[text], 256) == F.col(key), "left").drop(key).mapInArrow(_mask(text, live), kinds)
    return flagged.where(~F.col(flag)).drop(flag).unionByName(masked)
