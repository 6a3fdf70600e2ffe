"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of digests of its paragraphs; long paragraphs are cut after words whose
hash says so, so a change moves only the piece it is in. A sketch has cells of (count, sum
of digests by exclusive or, the same of their checksums); a digest is added to three cells.
Sketches of two versions subtract cell by cell, which cancels what they share. A cell that
holds one digest gives it away; taking that out of its other cells frees more, until all
cells are empty and the differing digests are known. If that fails, the pair is done again
with sketches of twice the size, until it works.

The likeness of two texts is the share of common digests: common / all. All pairs of a batch
are peeled together, in numpy.

Defined results: null and empty texts have an empty set, and two empty sets have likeness 1;
rows are ordered by id, then text, so repeated rows follow each other; a row without id is
followed by nothing and follows nothing; a single row follows itself; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.substrings import Prefixes
from wakeline.llm.words import Chunk, chunks, mix, span_hashes, words

CELLS = 12
_PIECE_WORDS = 6
_HANDFUL = 1 << 20
_U = np.uint64


def digests(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text number and digest of the distinct paragraph pieces of each text."""
    found = words(chunk)
    n = len(found.text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    h = span_hashes(chunk.data, found.start, found.end)
    line = np.concatenate(([0], np.cumsum(chunk.data == 10)))[found.start]
    begins = np.ones(n, bool)
    begins[1:] = (found.text[1:] != found.text[:-1]) | (line[1:] != line[:-1]) | (h[:-1] % _U(_PIECE_WORDS) == 0)
    at = np.flatnonzero(begins)
    piece = Prefixes(h).hash(at, np.append(at[1:], n))
    text = found.text[at]
    order = np.lexsort((piece, text))
    text, piece = text[order], piece[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (piece[1:] != piece[:-1])
    return text[new], piece[new]


def _cells(digest: np.ndarray, size: int) -> list[np.ndarray]:
    third = _U(size // 3)
    return [(mix(digest + _U(j * 0x5851F42D4C957F2D % (1 << 64)) + _U(size)) % third + _U(j) * third).astype(np.int64) for j in range(3)]


def _check(digest: np.ndarray) -> np.ndarray:
    return mix(digest ^ _U(0x2545F4914F6CDD1D)) >> _U(32)


class Sketches(NamedTuple):
    """Cells of several sketches, row by row."""

    count: np.ndarray
    sums: np.ndarray
    checks: np.ndarray

    @classmethod
    def empty(cls, n: int, size: int) -> Sketches:
        return cls(np.zeros((n, size), np.int64), np.zeros((n, size), _U), np.zeros((n, size), _U))

    def add(self, owner: np.ndarray, digest: np.ndarray, sign: np.ndarray | int = 1) -> None:
        size = self.count.shape[1]
        for cell in _cells(digest, size):
            at = owner * size + cell
            np.add.at(self.count.reshape(-1), at, sign)
            np.bitwise_xor.at(self.sums.reshape(-1), at, digest)
            np.bitwise_xor.at(self.checks.reshape(-1), at, _check(digest))

    def minus(self, other: Sketches, mine: np.ndarray, theirs: np.ndarray) -> Sketches:
        return Sketches(
            self.count[mine] - other.count[theirs],
            self.sums[mine] ^ other.sums[theirs],
            self.checks[mine] ^ other.checks[theirs],
        )

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take all digests out; their sketch, digest and sign, and which sketches got empty."""
        n, size = self.count.shape
        owners, found, signs = [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        while True:
            row, cell = np.nonzero((np.abs(self.count) == 1) & (self.checks == _check(self.sums)))
            digest, sign = self.sums[row, cell], self.count[row, cell]
            own = np.zeros(len(row), bool)
            for place in _cells(digest, size):
                own |= place == cell
            row, digest, sign = row[own], digest[own], sign[own]
            order = np.lexsort((digest, row))
            row, digest, sign = row[order], digest[order], sign[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
            row, digest, sign = row[new], digest[new], sign[new]
            if not len(row) or sum(map(len, owners)) > 4 * n * size:
                break
            self.add(row, digest, -sign)
            owners.append(row)
            found.append(digest)
            signs.append(sign)
        done = ~(self.count.any(axis=1) | self.sums.any(axis=1) | self.checks.any(axis=1))
        return np.concatenate(owners), np.concatenate(found), np.concatenate(signs), done

    def text(self, row: int) -> str:
        """One sketch as base64: counts (64 bits, as a text of any length may need), sums (64) and
        checks (32), little-endian."""
        raw = self.count[row].astype("<i8").tobytes() + self.sums[row].astype("<u8").tobytes()
        return base64.b64encode(raw + self.checks[row].astype("<u4").tobytes()).decode()


def sketch(text: np.ndarray, digest: np.ndarray, n: int, size: int) -> Sketches:
    out = Sketches.empty(n, size)
    out.add(text, digest)
    return out


def differing(text: np.ndarray, digest: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, base: Sketches) -> np.ndarray:
    """How many digests each pair of texts (``a[i]``, ``b[i]``) differs in, by peeling."""
    out = np.zeros(len(a), np.int64)
    left, size, sketches, renamed = np.arange(len(a)), base.count.shape[1], base, np.arange(n)
    while len(left):
        for some in np.array_split(left, max(1, len(left) * size >> 18)):
            owner, _, _, done = sketches.minus(sketches, renamed[a[some]], renamed[b[some]]).peel()
            out[some] = np.where(done, np.bincount(owner, minlength=len(some)), -1)
        left = left[out[left] < 0]
        size *= 2
        needed = np.unique(np.concatenate((a[left], b[left])))
        renamed = np.full(n, -1)
        renamed[needed] = np.arange(len(needed))
        use = renamed[text] >= 0
        sketches = sketch(renamed[text[use]], digest[use], len(needed), size) if len(left) else base
    return out


def likeness(differ: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Common over all digests, from set sizes and differing digests."""
    every = (first + second + differ) // 2
    return np.where(every > 0, (first + second - differ) / np.maximum(first + second + differ, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last half replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Row(NamedTuple):
    id: int | None
    text: str
    following: str


def _finish(rows: list[Row], cells: int, kind: pa.DataType) -> pa.RecordBatch:
    changed = [edited(r.text, r.following) for r in rows]
    n = len(rows)
    every = pa.array([r.text for r in rows] + changed + [r.following for r in rows], pa.large_string())
    parts = []
    for chunk in chunks(every):
        text, digest = digests(chunk)
        parts.append((text + chunk.first, digest))
    text, digest = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    base = sketch(text, digest, 3 * n, cells)
    size = np.bincount(text, minlength=3 * n)
    own = np.arange(n)
    near = [
        likeness(differing(text, digest, 3 * n, own, own + shift, base), size[:n], size[shift : shift + n])
        for shift in (n, 2 * n)
    ]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r.id for r in rows], kind),
            pa.array([len(r.text) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([base.text(i) for i in range(n)], pa.string()),
            pa.array([base.text(n + i) for i in range(n)], pa.string()),
            pa.array(near[0]),
            pa.array(near[1]),
        ],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _place(cuts) -> Callable:
    """Rows to ranges of ids; the first rows of a range also go to the one before, as its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(cuts.value, np.int64)
        for batch in batches:
            ids = batch.column("id")
            known = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            value = ids.fill_null(0).to_numpy().astype(np.int64)
            slot = np.zeros(len(value), np.int64)
            slot[known] = np.searchsorted(starts, value[known], side="right")
            first = known[starts[slot[known] - 1] == value[known]] if len(starts) else known[:0]
            before = np.where(slot[first] == 1, len(starts), slot[first] - 1)
            for rows, ranges, end in ((np.arange(len(value)), slot, False), (first, before, True)):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranges), pa.array(np.full(len(rows), end)), ids.take(take), batch.column("text").take(take)],
                    names=["range", "end", "id", "text"],
                )

    return run


def _follow(cells: int, kind: pa.DataType) -> Callable:
    """Rows sorted by range to their results, a handful of texts at a time."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        last = None
        for batch in batches:
            for place, end, id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "end", "id", "text"))):
                text = text or ""
                if last is not None and last[0] == place and not last[1] and id is not None:
                    yield Row(last[2], last[3], text)
                last = (place, end, id, text)
                if id is None:
                    yield Row(None, text, "")
                    last = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in pairs(batches):
            held.append(row)
            size += len(row.text)
            if size >= _HANDFUL or len(held) >= 4096:
                yield _finish(held, cells, kind)
                held, size = [], 0
        if held:
            yield _finish(held, cells, kind)

    return run


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Ranges of ids are cut at ids of the table, four for each shuffle partition, so what
    follows the last row of a range is known to be the first of the next and is sent along:
    texts move once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / (4 * parts) for i in range(4 * parts)]
    found = rows.agg(F.percentile_approx("id", shares, 100 * parts), F.min("id")).first()
    cuts = sorted({*(found[0] or []), *([] if found[1] is None else [found[1]])})
    placed = rows.mapInArrow(_place(spark.sparkContext.broadcast(cuts)), "range bigint, end boolean, id bigint, text string")
    placed = placed.repartition(parts, "range").sortWithinPartitions("range", "end", "id", "text")
    return placed.mapInArrow(
        _follow(cells, pa.int64()),
        "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    ).withColumnRenamed("id", id)
