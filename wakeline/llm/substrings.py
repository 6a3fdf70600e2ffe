"""Substring removal: word windows that also start in an earlier document.

Texts are streamed to shards in runs. A window of ``WINDOW`` words belongs to the least hash
of its word sequences of ``ANCHOR`` words; consecutive windows with the same least hash are
a run. Equal windows have equal anchors, so they meet in one shard, and text whose anchors
no other document has goes nowhere.

1. Every text gives its runs: anchor, place, length and a hash of the words.
2. Runs whose anchor is in one document only are done. Of equal runs only that of the least
   id matters; the others are wholly covered.
3. Distinct runs of anchors with several go to shards. A shard puts the documents of an anchor
   in order and halves them, and halves the halves, down to single ones: any two documents are
   in different halves once. At each depth one FM-index holds the runs of all earlier halves,
   and the runs of the later halves are streamed through it by backward search. A window whose
   matching statistic is ``WINDOW`` or more is covered. Stretches with words in a sequence that
   no other document of the anchor has are left out from the start, and stretches that are
   covered wholly are neither indexed nor streamed again, as an earlier one has all of them.
4. An anchor with more words than a shard should hold is cut over several by content. Windows
   that are first in their shard then meet once more, in shards keyed by the window's words,
   where at most one copy comes from each.
5. The covered intervals go back to their documents.

Defined results: null, empty and short texts lose nothing; rows without id lose nothing and
cover nothing; rows that repeat an id do not cover each other; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.fm_index import FMIndex
from wakeline.llm.grouped import groups
from wakeline.llm.staging import staged
from wakeline.llm.words import Chunk, chunks, mix, sequences, span_hashes, words

WINDOW = 50
ANCHOR = 16
SHARD_WORDS = 1 << 18

_U = np.uint64
_ODD = 0xD6E8FEB86659FD93
_BACK = pow(_ODD, -1, 1 << 64)
_RUNS = "array<struct<anchor:bigint,content:bigint,start:int,len:int>>"


def least_of_next(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each ``k`` consecutive values."""
    width, out = 1, h
    while 2 * width <= k:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    return np.minimum(out[: len(h) - k + 1], out[k - width : len(h) - width + 1])


class Prefixes:
    """Hash of any stretch of a word sequence from running sums."""

    def __init__(self, h: np.ndarray):
        up = np.full(len(h) + 1, _ODD, _U)
        down = np.full(len(h) + 1, _BACK, _U)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        self.down = np.cumprod(down)
        self.sums = np.concatenate((np.zeros(1, _U), np.cumsum(h * up[:-1], dtype=_U)))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U) * _U(_ODD))


def _hashed(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a chunk, and the first word and number of words of each text."""
    found = words(chunk)
    count = np.bincount(found.text, minlength=chunk.texts)
    return span_hashes(chunk.data, found.start, found.end), np.cumsum(count) - count, count


def runs_of(h: np.ndarray, first: np.ndarray, count: np.ndarray, window: int, anchor: int):
    """Text number, anchor, content, first window (in the text) and windows of every run."""
    text = np.repeat(np.arange(len(count)), count)
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    least = least_of_next(sequences(h, anchor), window - anchor + 1)
    inside = text[:n] == text[window - 1 :]
    begins = inside.copy()
    begins[1:] &= (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1])
    at = np.flatnonzero(begins)
    stop = np.concatenate((at[1:], [n])) if len(at) else at
    last = first[text[at]] + count[text[at]] - window + 1
    stop = np.minimum(stop, last)
    content = Prefixes(h).hash(at, stop + window - 1)
    return text[at], least[at].view(np.int64), content.view(np.int64), at - first[text[at]], stop - at


def _whole_hash(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return Prefixes(h).hash(first, first + count).view(np.int64)


def _texts(chunk: Chunk) -> Iterator[bytes]:
    body = chunk.data.tobytes()
    for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:]):
        yield body[a:b]


def _describe(window: int, anchor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                h, first, count = _hashed(chunk)
                text, anchors, content, start, size = runs_of(h, first, count, window, anchor)
                per = np.bincount(text, minlength=chunk.texts)
                ends = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32))
                fields = [pa.array(anchors), pa.array(content), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(chunk.first, chunk.texts),
                        pa.array(_whole_hash(h, first, count)),
                        pa.array(count.astype(np.int64)),
                        pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in _texts(chunk)], pa.string()),
                        pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["anchor", "content", "start", "len"])),
                    ],
                    names=["id", "key", "n_words", "sha", "runs"],
                )

    return run


def _cut_runs(window: int) -> Callable:
    """Texts with the runs wanted from them to the word hashes of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            ids = batch.column("id").to_pylist()
            for chunk in chunks(batch.column("text")):
                h, first, count = _hashed(chunk)
                prefixes = Prefixes(h)
                rows: list[tuple] = []
                for t in range(chunk.texts):
                    for w in wanted[chunk.first + t]:
                        a = first[t] + w["start"]
                        b = a + w["len"] + window - 1
                        if b > first[t] + count[t]:
                            continue
                        same = prefixes.hash(np.array([a]), np.array([b])).view(np.int64)[0] == w["content"]
                        if same:  # else the row only shares the id
                            rows.append((w["shard"], w["split"], w["anchor"], w["anchor"], w["content"], ids[chunk.first + t], 0, h[a:b].tobytes()))
                yield _run_batch(rows)

    return run


#: Runs can only have windows in common where ``meet`` is equal.
_RUN_SCHEMA = "shard bigint, split boolean, meet bigint, anchor bigint, content bigint, id {}, offset int, words binary"
_RUN_NAMES = ["shard", "split", "meet", "anchor", "content", "id", "offset", "words"]
_RUN_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_RUN_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUN_TYPES)], names=_RUN_NAMES)


def _split_windows(window: int) -> Callable:
    """Runs to their windows, keyed by the words of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                h = np.frombuffer(r["words"], _U)
                at = np.arange(len(h) - window + 1)
                key = Prefixes(h).hash(at, at + window).view(np.int64)
                yield _run_batch(
                    [
                        (int(k), False, int(k), r["anchor"], r["content"], r["id"], r["lo"] + int(i), h[i : i + window].tobytes())
                        for i, k in zip(at, key)
                    ]
                )

    return run


def matching_statistics(
    indexed: list[np.ndarray], texts: list[np.ndarray], indexed_part: np.ndarray, text_part: np.ndarray
) -> list[np.ndarray]:
    """For each word of each text how many words from there on an indexed run of the same part has.

    The index holds the runs one after the other, each closed by a symbol of its own; a word
    is another symbol in each part.
    """
    sizes = np.array([len(r) for r in indexed])
    ends = np.cumsum(sizes + 1) - 1
    word = np.ones(int(ends[-1]) + 1, bool)
    word[ends] = False
    known, kind = np.unique(np.concatenate(indexed), return_inverse=True)
    pairs, symbol = np.unique(np.repeat(indexed_part, sizes) * len(known) + kind, return_inverse=True)
    symbols = np.empty(len(word), np.int64)
    symbols[ends] = np.arange(len(indexed))
    symbols[word] = symbol + len(indexed)
    index = FMIndex(symbols)

    lengths = np.array([len(t) for t in texts])
    stream = np.concatenate(texts)
    kind = np.minimum(np.searchsorted(known, stream), len(known) - 1)
    pair = np.repeat(text_part, lengths) * len(known) + kind
    place = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
    present = (known[kind] == stream) & (pairs[place] == pair)
    found = index.statistics(np.where(present, place + len(indexed), -1), np.cumsum(lengths), lengths)
    return np.split(found, np.cumsum(lengths)[:-1])


def shared_windows(runs: list[np.ndarray], ids: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Which windows, of the runs put one after the other, have no sequence of a third of their
    words that only one id of the group has. No other window can be covered or cover."""
    gram = max(1, window // 3)
    words = np.concatenate(runs)
    owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    n, m = len(words) - gram + 1, len(words) - window + 1
    inside = owner[:n] == owner[gram - 1 :]
    at = owner[:n][inside]
    key = np.unique(mix(sequences(words, gram)[inside] ^ mix(group[at].astype(_U))), return_inverse=True)[1]
    least, most = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), np.iinfo(np.int64).min)
    np.minimum.at(least, key, ids[at])
    np.maximum.at(most, key, ids[at])
    shared = np.zeros(n, bool)
    shared[inside] = (least < most)[key]
    alone = np.concatenate(([0], np.cumsum(~shared)))
    return (alone[window - gram + 1 :] == alone[:m]) & (owner[:m] == owner[window - 1 :])


def search_shard(runs: list[np.ndarray], ids: np.ndarray, meet: np.ndarray, window: int) -> list[np.ndarray]:
    """For each run which of its windows also occur in a run of equal ``meet`` with a smaller id.

    ``runs``: word hashes. What is indexed and streamed are stretches of :func:`shared_windows`.
    """
    covered = [np.zeros(len(r) - window + 1, bool) for r in runs]
    group = np.unique(meet, return_inverse=True)[1]
    stretches = _stretches(shared_windows(runs, ids, group, window))
    if not len(stretches):
        return covered
    first = np.cumsum([0] + [len(r) for r in runs])
    of = np.searchsorted(first, stretches[:, 0], side="right") - 1
    at = stretches - first[of][:, None]
    pieces = [runs[r][lo : hi + window - 1] for r, (lo, hi) in zip(of, at)]
    ids, group = ids[of], group[of]
    order = np.lexsort((ids, group))
    new_group = np.diff(group[order], prepend=-1) != 0
    new = new_group | (np.diff(ids[order], prepend=ids[order[0]]) != 0)
    step = np.cumsum(new)
    place = np.empty(len(pieces), np.int64)  # of the piece's id among those of its group
    place[order] = step - np.maximum.accumulate(np.where(new_group, step, 0))
    open_pieces = np.ones(len(pieces), bool)
    for depth in range(int(place.max()).bit_length() - 1, -1, -1):
        part = group * (int(place.max()) + 1) + (place >> (depth + 1))
        later = (place >> depth & 1).astype(bool)
        early, late = np.flatnonzero(open_pieces & ~later), np.flatnonzero(open_pieces & later)
        early, late = early[np.isin(part[early], part[late])], late[np.isin(part[late], part[early])]
        if not len(late):
            continue
        found = matching_statistics([pieces[i] for i in early], [pieces[i] for i in late], part[early], part[late])
        for i, matched in zip(late, found):
            lo, hi = at[i]
            covered[of[i]][lo:hi] |= matched[: hi - lo] >= window
            open_pieces[i] = not covered[of[i]][lo:hi].all()
    return covered


def _stretches(mask: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge.reshape(-1, 2)


def _search(window: int) -> Callable:
    """Runs sorted by shard to covered stretches of windows, and, for anchors that were cut
    over several shards, to the stretches that are not covered here, with their words."""

    def results(rows: list[tuple]) -> pa.RecordBatch:
        runs = [np.frombuffer(r[7], _U) for r in rows]
        ids, meet = (np.array([r[c] for r in rows], np.int64) for c in (5, 2))
        out = []
        for (_, split, _, anchor, content, id, offset, _), run, covered in zip(rows, runs, search_shard(runs, ids, meet, window)):
            for lo, hi in _stretches(covered):
                out.append((anchor, content, id, offset + int(lo), offset + int(hi), None))
            if split:
                for lo, hi in _stretches(~covered):
                    out.append((anchor, content, id, offset + int(lo), offset + int(hi), run[lo : hi + window - 1].tobytes()))
        names = ["anchor", "content", "id", "lo", "hi", "words"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        columns = list(zip(*out)) if out else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, _RUN_NAMES):
            yield results(rows)

    return run


def _searched(runs: DataFrame, window: int) -> DataFrame:
    rows = runs.repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(_search(window), "anchor bigint, content bigint, id bigint, lo int, hi int, words binary")


def _remove(window: int) -> Callable:
    """Texts with the covered stretches found under their id to the words removed and what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found").to_pylist()
            for chunk in chunks(batch.column("text")):
                h, first, count = _hashed(chunk)
                own = _whole_hash(h, first, count)
                out = []
                for t, body in enumerate(_texts(chunk)):
                    mine = [x["covers"] for x in found[chunk.first + t] or () if x["key"] == own[t]]
                    gone = covered_words(int(count[t]), [(c["lo"], c["hi"]) for x in mine for c in x], window)
                    left = b" ".join(w for w, g in zip(body.split(), gone) if not g)
                    out.append((int(count[t]), int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode()))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(chunk.first, chunk.texts), *(pa.array(c, t) for c, t in zip(zip(*out), types))],
                    names=["id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return run


def covered_words(n: int, stretches: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which of ``n`` words are in a window that starts in one of the stretches."""
    change = np.zeros(n + 1, np.int64)
    for lo, hi in stretches:
        change[lo] += 1
        change[hi + window - 1] -= 1
    return np.cumsum(change[:n]) > 0


def covered_windows(described: DataFrame, rows: DataFrame, window: int, shard_words: int) -> DataFrame:
    """``id, key, covers`` of the texts that hold covered windows."""
    runs = described.where("id is not null").select("id", "key", F.explode("runs").alias("r")).select("id", "key", "r.*")
    shared = runs.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    shared = staged(shared.where("least <> most").select(F.col("anchor").alias("_a")))
    runs = staged(runs.join(shared, F.col("anchor") == F.col("_a")).drop("_a"))

    distinct = staged(
        runs.groupBy("anchor", "content")
        .agg(F.min(F.struct("id", "start", "len")).alias("f"))
        .select("anchor", "content", "f.*")
    )
    sizes = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("several"), F.sum(F.col("len") + window - 1).alias("words"))
    sizes = staged(sizes.where("several > 1").withColumnRenamed("anchor", "_a"))
    shards = int((sizes.agg(F.sum("words")).first()[0] or 0) // shard_words) + 1

    cuts = F.ceil(F.col("words") / (shard_words // 2))
    place = F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("content"), cuts)), F.lit(shards))
    wanted = distinct.join(sizes, F.col("anchor") == F.col("_a")).select(
        "id", F.struct(place.alias("shard"), (cuts > 1).alias("split"), "anchor", "content", "start", "len").alias("w")
    )
    wanted = staged(wanted.groupBy("id").agg(F.collect_list("w").alias("wanted")))
    texts = rows.join(wanted.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).select("id", "text", "wanted")
    found = staged(_searched(texts.mapInArrow(_cut_runs(window), _RUN_SCHEMA.format("bigint")), window))
    again = found.where("words is not null").mapInArrow(_split_windows(window), _RUN_SCHEMA.format("bigint"))
    again = again.withColumn("shard", F.pmod("shard", F.lit(8 * shards)))
    covers = found.where("words is null").unionByName(_searched(again, window)).where("words is null")
    covers = staged(covers.groupBy("anchor", "content").agg(F.collect_list(F.struct("lo", "hi")).alias("part")))

    firsts = distinct.select(F.col("anchor").alias("_a"), F.col("content").alias("_c"), F.col("id").alias("first"))
    verdict = runs.join(firsts, (F.col("anchor") == F.col("_a")) & (F.col("content") == F.col("_c")))
    whole = verdict.where("id > first").select("id", "key", F.col("start").alias("lo"), (F.col("start") + F.col("len")).alias("hi"))
    parts = (
        verdict.where("id = first").drop("_a", "_c")
        .join(covers.withColumnsRenamed({"anchor": "_a", "content": "_c"}), (F.col("anchor") == F.col("_a")) & (F.col("content") == F.col("_c")))
        .select("id", "key", "start", F.explode("part").alias("p"))
        .select("id", "key", (F.col("start") + F.col("p.lo")).alias("lo"), (F.col("start") + F.col("p.hi")).alias("hi"))
    )
    stretches = whole.union(parts).groupBy("id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("covers"))
    return staged(stretches)


def remove_repeats(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    shard_words: int = SHARD_WORDS,
    with_text: bool = False,
) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` of every row, and ``kept`` (the words that stay,
    joined by a space) if ``with_text``.

    Without texts wanted, they are read again only where part of them goes; for the others
    the first pass knows the hash.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    described = staged(
        rows.mapInArrow(_describe(window, anchor), f"id bigint, key bigint, n_words bigint, sha string, runs {_RUNS}")
    )
    covers = covered_windows(described, rows, window, shard_words)
    found = covers.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("key", "covers")).alias("found"))
    removed = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    changed = rows.join(found, F.col("id") == F.col("_id"), "left" if with_text else "inner")
    changed = changed.select("id", "text", "found").mapInArrow(_remove(window), removed)
    if with_text:
        return changed.withColumnRenamed("id", id)
    same = described.join(found.select("_id"), F.col("id") == F.col("_id"), "left_anti").select(
        "id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256")
    )
    return same.unionByName(changed.drop("kept")).withColumnRenamed("id", id)
