"""Fill-in-the-middle transformation with content-defined chunk memoization.

A unit is a word with the white space before it; white space at the end is a unit of its
own. A text of n units is cut before unit boundaries that hashes of its id choose, and its
three parts change places.

Where the cuts lie is found without tokenizing documents. A rolling hash over the last
``WINDOW`` bytes cuts texts into chunks, so passages that texts share fall into the same
chunks wherever they stand. A chunk is summed up once: how many units end inside it, how many
code points it has, and whether it begins and ends with white space. Summaries are kept by the
chunk's bytes, so an equal hash alone never makes two chunks one. Summaries combine: a unit
also ends between a chunk that ends in a word and one that begins with white space. Running
sums over a document's chunks give n and the chunk each cut lies in, and only that chunk is
looked at again.

Defined results: null and empty texts have no units and stay as they are (``plain``); a row
without id draws as the id ``null``; repeated rows come out alike; a table without rows gives
none; other columns are ignored, whatever their names. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.words import IS_CODE_POINT, IS_SEPARATOR, Chunk, chunks, mix

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PERCENT = 50
SUFFIX_FIRST_PERCENT = 80

WINDOW = 16
AVERAGE = 256
LONGEST = 4096
#: Bytes of chunks a worker remembers, in each of two generations.
MEMORY = 16 << 20

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes up to and including each byte (fewer at the start)."""
    h, width, power = _BYTE[data], 1, _ODD
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] * _U(power)
        h, width, power = longer, 2 * width, power * power % (1 << 64)
    return mix(h)


def cut_chunks(chunk: Chunk) -> np.ndarray:
    """First bytes of the pieces of all texts, and the end; no piece reaches over texts.

    A piece has ``WINDOW`` to ``LONGEST`` bytes but at the end of a text.
    """
    size = len(chunk.data)
    starts = np.unique(chunk.offsets[:-1][np.diff(chunk.offsets) > 0])
    if not size:
        return np.zeros(1, np.int64)
    marks = np.flatnonzero(rolling(chunk.data) % _U(AVERAGE) == 0) + 1
    home = starts[np.searchsorted(starts, marks - 1, side="right") - 1]
    cuts = np.union1d(starts, marks[(marks - home >= WINDOW) & (marks < size)])
    gaps = np.diff(np.append(cuts, size))
    extra = [np.arange(cuts[i] + LONGEST, cuts[i] + gaps[i], LONGEST) for i in np.flatnonzero(gaps > LONGEST)]
    return np.append(np.unique(np.concatenate([cuts, *extra])), size).astype(np.int64)


class Memo:
    """Summaries of chunks by their bytes: ends inside, code points, white space first and last.

    Two generations bound what is held: when the young one is full it becomes the old one,
    and what the old one knows comes back when it is asked for.
    """

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held = memory, 0
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.computed = 0

    def _keep(self, piece: bytes, summary: tuple) -> None:
        if self.held > self.memory:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[piece] = summary
        self.held += len(piece) + 200

    def summaries(self, pieces: list[bytes]) -> np.ndarray:
        """One row for each piece."""
        known: list[tuple | None] = []
        fresh: dict[bytes, tuple] = {}
        for piece in pieces:
            found = self.young.get(piece)
            if found is None and (found := self.old.get(piece)) is not None:
                self._keep(piece, found)
            if found is None:
                fresh[piece] = ()
            known.append(found)
        if fresh:
            for piece, found in zip(fresh, _summed(list(fresh))):
                fresh[piece] = found
                self._keep(piece, found)
            self.computed += len(fresh)
        return np.array([fresh[p] if k is None else k for p, k in zip(pieces, known)], np.int64).reshape(-1, 4)


def _summed(pieces: list[bytes]) -> list[tuple]:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    at = np.cumsum(size) - size
    blank = IS_SEPARATOR[data]
    ends = blank.copy()
    ends[1:] &= ~blank[:-1]
    ends[at] = False
    return list(
        zip(
            np.add.reduceat(ends, at, dtype=np.int64).tolist(),
            np.add.reduceat(IS_CODE_POINT[data], at, dtype=np.int64).tolist(),
            blank[at].tolist(),
            blank[at + size - 1].tolist(),
        )
    )


class Units:
    """The units of all texts of a chunk, from the summaries of their pieces."""

    def __init__(self, chunk: Chunk, memo: Memo):
        self.data = chunk.data
        self.cuts = cut_chunks(chunk)
        self.pieces = [chunk.data[a:b].tobytes() for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist())]
        rows = memo.summaries(self.pieces)
        self.first = np.searchsorted(self.cuts[:-1], chunk.offsets[:-1])
        self.last = np.searchsorted(self.cuts[:-1], chunk.offsets[1:])
        # A unit ends at the start of a piece if that is white space and the piece before,
        # of the same text, ends in a word.
        self.joint = np.zeros(len(rows), bool)
        self.joint[1:] = (rows[1:, 2] == 1) & (rows[:-1, 3] == 0)
        self.joint[self.first[self.first < len(rows)]] = False
        self.ended = np.concatenate(([0], np.cumsum(rows[:, 0] + self.joint)))
        self.chars = np.concatenate(([0], np.cumsum(rows[:, 1])))
        self.offsets = chunk.offsets
        self.count = np.where(np.diff(chunk.offsets) > 0, self.ended[self.last] - self.ended[self.first] + 1, 0)

    def end(self, text: int, units: int) -> tuple[int, int]:
        """Byte and code point, from the start of the text, where its first ``units`` end."""
        lo, hi = int(self.first[text]), int(self.last[text])
        begin = int(self.offsets[text])
        if units == 0:
            return 0, 0
        if units >= self.count[text]:
            return int(self.offsets[text + 1]) - begin, int(self.chars[hi] - self.chars[lo])
        target = int(self.ended[lo]) + units
        at = int(np.searchsorted(self.ended[lo : hi + 1], target, side="left")) + lo - 1
        piece = np.frombuffer(self.pieces[at], np.uint8)
        blank = IS_SEPARATOR[piece]
        ends = blank.copy()
        ends[1:] &= ~blank[:-1]
        ends[0] = self.joint[at]
        place = int(np.flatnonzero(ends)[target - int(self.ended[at]) - 1])
        chars = int(self.chars[at] - self.chars[lo]) + int(IS_CODE_POINT[piece[:place]].sum())
        return int(self.cuts[at]) - begin + place, chars


def draws(seed: int, id: int | None) -> list[int]:
    """Four numbers of 32 bits from seed and id."""
    digest = hashlib.sha256(f"{seed}:{'null' if id is None else id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _transform(seed: int, percent: int, suffix_first: int) -> Callable:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            ids = batch.column("id")
            for chunk in chunks(batch.column("text")):
                units = Units(chunk, memo)
                own = ids.slice(chunk.first, chunk.texts)
                forms, before, middles, outputs = [], [], [], []
                for i, id in enumerate(own.to_pylist()):
                    n = int(units.count[i])
                    body = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]].tobytes()
                    h1, h2, h3, h4 = draws(seed, id)
                    if n == 0 or h3 % 100 >= percent or any(x in body for x in marks):
                        forms.append("plain")
                        before.append(None)
                        middles.append(None)
                        outputs.append(body)
                        continue
                    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                    (a, a_chars), (b, b_chars) = units.end(i, low), units.end(i, high)
                    first = h4 % 100 < suffix_first
                    head, tail = (s, p) if first else (p, s)
                    one, two = (body[b:], body[:a]) if first else (body[:a], body[b:])
                    forms.append("spm" if first else "psm")
                    before.append(a_chars)
                    middles.append(b_chars - a_chars)
                    outputs.append(b"".join((head, one, tail, two, m, body[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [
                        own,
                        pa.array(units.count.astype(np.int64)),
                        pa.array(forms, pa.string()),
                        pa.array(before, pa.int64()),
                        pa.array(middles, pa.int64()),
                        pa.array(outputs, pa.binary()),
                    ],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    percent: int = PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output``: every text in the form its id draws.

    ``form`` is ``plain``, ``psm`` (prefix, suffix, middle) or ``spm`` (suffix first); texts
    that hold one of the marks stay plain, so marks in an output can be trusted.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(
        _transform(seed, percent, suffix_first_percent),
        "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary",
    )
    return out.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id)


def restore(form: Column, output: Column) -> Column:
    """The text that an output was made from."""

    def between(begin: str, end: str) -> Column:
        return F.substring_index(F.substring(output, F.lit(len(begin) + 1), F.length(output)), end, 1)

    def after(mark: str, text: Column) -> Column:
        return F.substring(text, F.locate(mark, text) + len(mark), F.length(text))

    middle = after(MIDDLE, output)

    def inner(mark: str) -> Column:
        return F.substring_index(after(mark, output), MIDDLE, 1)

    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, inner(SUFFIX)))
        .when(form == "spm", F.concat(inner(PREFIX), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )
