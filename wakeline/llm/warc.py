"""WARC archives with deduplicated payloads, and a globally ordered index of their captures.

Writing: pages are first seen by digest only. The greatest id of each payload keeps it (a
response), the others become revisit records, which need no payload; so of a payload that a
third of all pages share, one copy travels. Records are lines of Spark's text writer, whose
line end is the end of a WARC record, gzipped.

Reading: every record names its archive in its second line, which no payload can know, so
Spark's text reader cuts files there, record by record, whatever payloads hold. Lengths and
digests are checked on the way.

Index: every reading task sorts its captures into runs (``RUN`` entries in memory at most) and
writes them in blocks. Ranges of the whole order (URL key, time, id, place in the archive) are
cut from a bounded sample of keys, so captures of one hot URL are spread as well; the sample
decides how even ranges are, not what comes out. In each range the runs are merged by a loser
tree. A block joins the tree when its first key is next, so a run never has more than one block
in memory; more than ``FAN`` runs are merged in groups first.

Defined results: a null payload is empty; a null URL has the empty key; a null id counts as the
least; of rows that share payload and id the latest, then the one of the greatest URL responds,
of repeated rows one; without rows there are no captures; other columns are ignored, whatever
their names; payloads of any length are kept whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.staging import delete_at_end, shared_folder, staged

END = "\r\n\r\n"
VERSION = "WARC/1.1\r\n"
RUN = 1 << 15
BLOCK = 256
FAN = 256
RANGE = 1 << 18
SAMPLES = 32
#: First second of captures that have no time of their own: they are taken an id a second.
EPOCH = 946_684_800
_LATEST = (1 << 31) - 1


class Archive(NamedTuple):
    """Where an archive is, and the line that tells its records from anything inside them."""

    path: str
    name: str

    @property
    def opening(self) -> str:
        return f"{VERSION}WARC-Warcinfo-ID: <urn:uuid:{self.name}>\r\n"


# --- Writing --------------------------------------------------------------------------------


def base32(hex40: Column) -> Column:
    """A SHA-1 in hexadecimal digits as base32: five digits are four letters."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    fives = [F.lpad(F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fives), digits, letters)


def _second(id: str) -> Column:
    return F.lit(EPOCH) + F.least(F.greatest(F.coalesce(F.col(id), F.lit(0)), F.lit(0)), F.lit(_LATEST))


def _iso(seconds: Column) -> Column:
    """Seconds since 1970 as text, whatever the session's time zone."""
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    parts = [F.lpad(x.cast("int").cast("string"), 2, "0") for x in (F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60)))]
    return F.concat(days.cast("string"), F.lit("T"), F.concat_ws(":", *parts), F.lit("Z"))


def _record_id(id: Column, key: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), F.substring(key, 1, 24), F.lit(":"), copy.cast("string"), F.lit(">"))


def _record(archive: Archive, kind: str, record_id: Column, more: Column, block: Column, mime: str) -> Column:
    return F.concat(
        F.lit(f"{archive.opening}WARC-Type: {kind}\r\nWARC-Record-ID: "),
        record_id,
        more,
        F.lit(f"\r\nContent-Type: {mime}\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )


def _http(size: Column, payload: Column) -> Column:
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ")
    return F.concat(head, size.cast("string"), F.lit(END), payload)


def write_archive(
    pages: DataFrame,
    path: str,
    id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    captured: str | None = None,
    min_bytes: int = 0,
) -> Archive:
    """Write a record for every row to ``path``; payloads under ``min_bytes`` are never shared.

    ``captured``: column with the second of each capture, since 1970.
    """
    archive = Archive(path, str(uuid.uuid4()))
    rows = pages.select(
        F.col(id).cast("bigint").alias("id"),
        F.replace(F.replace(F.col(url).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        (_second(id) if captured is None else F.col(captured).cast("bigint")).alias("at"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumns({"sha": F.sha2("payload", 256), "sha1": F.sha1("payload"), "size": F.octet_length("payload")})
    key = F.sha2(F.to_json(F.struct("id", "url", "at", "sha")), 256).alias("key")
    seen = rows.select("id", "url", "at", "sha", "sha1", "size", key)
    seen = staged(seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias("times")))
    best = seen.groupBy(F.col("sha").alias("_sha")).agg(F.max(F.struct("id", "at", "url", "key")).alias("best"))
    bodies = F.when(F.col("size") < min_bytes, F.col("times")).when(F.col("key") == F.col("best.key"), 1).otherwise(0)
    seen = staged(seen.join(best, F.col("sha") == F.col("_sha")).withColumn("bodies", bodies).drop("_sha"))

    def described(copy: Column) -> tuple[Column, Column]:
        about = F.concat(
            F.lit("\r\nWARC-Date: "),
            _iso(F.col("at")),
            F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")),
            F.lit("\r\nWARC-Payload-Digest: sha1:"),
            base32(F.col("sha1")),
        )
        return _record_id(F.col("id"), F.col("key"), copy), about

    http = "application/http; msgtype=response"
    own, about = described(F.col("copy"))
    wanted = seen.where("bodies > 0").select(F.col("key").alias("_key"), "bodies")
    # Repeated rows become one before the payloads are dealt out.
    held = rows.withColumn("key", key).dropDuplicates(["key"]).join(wanted, F.col("key") == F.col("_key"))
    held = held.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bodies") - 1)))
    responses = held.select(_record(archive, "response", own, about, _http(F.col("size"), F.col("payload")), http).alias("value"))
    again = seen.where("bodies < times").withColumn("copy", F.explode(F.sequence("bodies", F.col("times") - 1)))
    profile = "\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "
    about = F.concat(about, F.lit(profile), _record_id(F.col("best.id"), F.col("best.key"), F.lit(0)))
    revisits = again.select(_record(archive, "revisit", own, about, _http(F.col("size"), F.lit("")), http).alias("value"))
    info = F.lit("software: wakeline\r\nformat: WARC File Format 1.1\r\n")
    opening = _record(archive, "warcinfo", F.lit(f"<urn:uuid:{archive.name}>"), F.lit(f"\r\nWARC-Date: {_utc_now()}"), info, "application/warc-fields")
    first = pages.sparkSession.range(1).select(opening.alias("value"))
    responses.unionByName(revisits).unionByName(first).write.text(path, compression="gzip", lineSep=END)
    return archive


def _utc_now() -> str:
    from datetime import datetime, timezone

    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


# --- Reading --------------------------------------------------------------------------------

_RECORD = [
    ("urlkey", pa.string(), "string"),
    ("captured", pa.string(), "string"),
    ("id", pa.int64(), "bigint"),
    ("file", pa.string(), "string"),
    ("offset", pa.int64(), "bigint"),
    ("length", pa.int64(), "bigint"),
    ("record_type", pa.string(), "string"),
    ("payload_digest", pa.string(), "string"),
    ("payload_bytes", pa.int64(), "bigint"),
    ("refers_to", pa.int64(), "bigint"),
]
FIELDS = [name for name, _, _ in _RECORD]
_ENTRY = pa.struct([(name, kind) for name, kind, _ in _RECORD])
_COLUMNS = ", ".join(f"{name} {sql}" for name, _, sql in _RECORD)
_STRUCT = "struct<" + ",".join(f"{name}:{sql}" for name, _, sql in _RECORD) + ">"


def url_key(url: str | None) -> str:
    """Host backwards, then path and query: pages of a host, and of its domain, sort together."""
    if url is None:
        return ""
    _, found, rest = url.partition("://")
    if not found:
        return url
    stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:stop].encode().lower().decode()
    return ",".join(reversed(host.split("."))) + ")" + rest[stop:].partition("#")[0]


def _page_of(record_id: str) -> int | None:
    number = record_id.strip("<>").split(":")[2]
    return int(number) if number else None


def parse(piece: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and payload of a record without its opening, checked."""
    end = END.encode()
    head, _, rest = piece.partition(end)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    length = int(fields["Content-Length"])
    if rest[length:] != end:
        raise ValueError(f"a record of {length} bytes has {len(rest) - len(end)}")
    http, _, payload = rest[:length].partition(end)
    if fields["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what was written")
        fields["payload_bytes"] = str(len(payload))
    elif fields["WARC-Type"] == "revisit":
        fields["payload_bytes"] = http.decode().rpartition("Content-Length: ")[2]
    return fields, payload


def _entries(opening: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """Index entry and payload of each page record, file by file."""
    file, offset = None, 0
    for batch in batches:
        for name, piece in zip(batch.column("file"), batch.column("value")):
            name, piece = name.as_py(), piece.as_py()
            if name != file:
                # What stands before the first record of a file: nothing.
                file, offset = name, len(piece)
                if piece:
                    raise ValueError(f"{name} does not begin with a record")
                continue
            size = opening + len(piece)
            fields, payload = parse(piece)
            if fields["WARC-Type"] != "warcinfo":
                yield (
                    url_key(fields.get("WARC-Target-URI")),
                    "".join(c for c in fields["WARC-Date"] if c.isdigit()),
                    _page_of(fields["WARC-Record-ID"]),
                    file,
                    offset,
                    size,
                    fields["WARC-Type"],
                    fields["WARC-Payload-Digest"][5:],
                    int(fields["payload_bytes"]),
                    _page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
                ), payload
            offset += size


def _pieces(spark: SparkSession, archive: Archive) -> DataFrame:
    lines = spark.read.text(archive.path, lineSep=archive.opening)
    return lines.select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("value"))


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every page record: index fields and ``payload``, which revisits do not have."""
    opening = len(archive.opening)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for entry, payload in _entries(opening, batches):
            held.append((*entry, payload if entry[6] == "response" else None))
            size += len(payload) + 200
            if size > 1 << 20:
                yield _flat(held, True)
                held, size = [], 0
        if held:
            yield _flat(held, True)

    return _pieces(spark, archive).mapInArrow(run, f"{_COLUMNS}, payload binary")


def _flat(rows: list[tuple], payload: bool = False) -> pa.RecordBatch:
    kinds = [(name, kind) for name, kind, _ in _RECORD] + [("payload", pa.binary())] * payload
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds]
    )


# --- Index ----------------------------------------------------------------------------------


def order(entry: tuple) -> tuple:
    """The whole order of captures; nothing ties, as places in an archive differ."""
    return entry[0], entry[1], -(1 << 63) if entry[2] is None else entry[2], entry[3], entry[4]


def _block_batch(rows: list[tuple[int, int, list[tuple]]]) -> pa.RecordBatch:
    """Rows of range, run and sorted entries."""
    entries = [[dict(zip(FIELDS, e)) for e in block] for _, _, block in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([b[0] for b in entries], _ENTRY),
            pa.array(entries, pa.list_(_ENTRY)),
        ],
        names=["range", "run", "first", "entries"],
    )


_BLOCKS = f"range bigint, run bigint, first {_STRUCT}, entries array<{_STRUCT}>"


def _tuples(entries: list[dict]) -> list[tuple]:
    return [tuple(e[f] for f in FIELDS) for e in entries]


def _runs(opening: int, size: int, block: int) -> Callable:
    """Records to locally sorted runs, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def sorted_run(held: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
            held.sort(key=order)
            for at in range(0, len(held), 16 * block):
                yield _block_batch([(0, number, held[i : i + block]) for i in range(at, min(at + 16 * block, len(held)), block)])

        held = []
        for entry, _ in _entries(opening, batches):
            held.append(entry)
            if len(held) >= size:
                yield from sorted_run(held, number)
                held, number = [], number + 1
        yield from sorted_run(held, number)

    return run


def _sliced(cuts) -> Callable:
    """Blocks cut at the borders of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, block in zip(batch.column("run").to_pylist(), batch.column("entries").to_pylist()):
                entries = _tuples(block)
                keys = [order(e) for e in entries]
                at, place = 0, bisect_left(cuts.value, keys[0])
                while at < len(entries):
                    # Range r holds the keys above cut r - 1 and up to cut r.
                    stop = len(entries)
                    if place < len(cuts.value):
                        stop = at
                        while stop < len(entries) and keys[stop] <= cuts.value[place]:
                            stop += 1
                    if stop > at:
                        out.append((place, number, entries[at:stop]))
                    at, place = stop, place + 1
            if out:
                yield _block_batch(out)

    return run


class LoserTree:
    """Tournament of sorted blocks: each inner node keeps the loser of its match.

    Taking the winner replays one path from leaf to root. Blocks may join later.
    """

    def __init__(self) -> None:
        self.blocks: list[tuple[list[tuple], list[tuple]]] = []
        self.at: list[int] = []
        self.losers: list[int] = []
        self.winner = -1

    def _key(self, i: int) -> tuple | None:
        """Next key of a player; None, which loses, when it has no more."""
        if i < 0 or self.at[i] >= len(self.blocks[i][0]):
            return None
        return self.blocks[i][1][self.at[i]]

    def _beats(self, i: int, j: int) -> bool:
        a, b = self._key(i), self._key(j)
        return a is not None and (b is None or a < b)

    def join(self, block: list[tuple]) -> None:
        """Let a block take part; blocks that are used up leave."""
        live = [i for i in range(len(self.blocks)) if self.at[i] < len(self.blocks[i][0])]
        self.blocks = [self.blocks[i] for i in live] + [(block, [order(e) for e in block])]
        self.at = [self.at[i] for i in live] + [0]
        leaves = 1 << (len(self.blocks) - 1).bit_length()
        won = [-1] * leaves + [i if i < len(self.blocks) else -1 for i in range(leaves)]
        self.losers = [-1] * leaves
        for node in range(leaves - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = won[1]

    def first(self) -> tuple | None:
        return self._key(self.winner)

    def take(self) -> tuple:
        i = self.winner
        entry = self.blocks[i][0][self.at[i]]
        self.at[i] += 1
        node = (len(self.losers) + i) // 2
        while node:
            if self._beats(self.losers[node], i):
                i, self.losers[node] = self.losers[node], i
            node //= 2
        self.winner = i
        return entry


def merge(blocks: Iterable[list[tuple]]) -> Iterator[tuple]:
    """Entries of sorted blocks, given by their first keys, in one order."""
    tree = LoserTree()
    for block in blocks:
        due = order(block[0])
        while (first := tree.first()) is not None and first < due:
            yield tree.take()
        tree.join(block)
    while tree.first() is not None:
        yield tree.take()


def _keyed_blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[tuple[int, int], Iterator[list[tuple]]]]:
    """Groups of rows that agree in range and ``key``, each with its blocks as they come."""
    rows = (
        (place, (r, k), block)
        for batch in batches
        for place, (r, k, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range", key, "entries"))))
    )
    held = next(rows, None)

    def blocks(group: tuple[int, int]) -> Iterator[list[tuple]]:
        nonlocal held
        while held is not None and held[1] == group:
            block = _tuples(held[2])
            held = next(rows, None)
            yield block

    while held is not None:
        yield held[1], blocks(held[1])


def _merged_runs(block: int) -> Callable:
    """Runs of a group to one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (place, group), blocks in _keyed_blocks(batches, "grp"):
            held = []
            for entry in merge(blocks):
                held.append(entry)
                if len(held) == block:
                    yield _block_batch([(place, group, held)])
                    held = []
            if held:
                yield _block_batch([(place, group, held)])

    return run


def _histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges to entries with their place, and the place where their URL begins in the range."""
    for (place, _), blocks in _keyed_blocks(batches, "grp"):
        held, at, begin, last = [], 0, 0, None
        places: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            flat = _flat(held)
            more = [pa.array([place] * len(held), pa.int64()), *(pa.array([p[i] for p in places], pa.int64()) for i in (0, 1))]
            return pa.RecordBatch.from_arrays([*flat.columns, *more], names=[*flat.schema.names, "range", "place", "begin"])

        for entry in merge(blocks):
            if entry[0] != last:
                begin, last = at, entry[0]
            held.append(entry)
            places.append((at, begin))
            at += 1
            if len(held) == 8192:
                yield flush()
                held, places = [], []
        if held:
            yield flush()


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks of a range and group together, by their first keys."""
    first = ["first.urlkey", "first.captured", F.coalesce("first.id", F.lit(-(1 << 63))), "first.file", "first.offset"]
    return blocks.repartition(parts, "range", "grp").sortWithinPartitions("range", "grp", *first)


def capture_index(
    spark: SparkSession, archive: Archive, run: int = RUN, block: int = BLOCK, fan: int = FAN, per_range: int = RANGE
) -> DataFrame:
    """Index entries of all captures with ``position`` (from 1, over all) and ``capture`` (from
    1, of its URL key), by URL key, time, id and place."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = staged(_pieces(spark, archive).mapInArrow(_runs(len(archive.opening), run, block), _BLOCKS))
    entries = blocks.select(F.explode("entries").alias("e"))
    size = blocks.agg(F.sum(F.size("entries")).alias("n"), F.count_distinct("run").alias("runs")).first()
    ranges = max(parts, -(-(size["n"] or 0) // per_range))
    sample = entries.orderBy(F.xxhash64("e.id", "e.file", "e.offset")).limit(SAMPLES * ranges).select("e.*").collect()
    keys = sorted(order(tuple(r[f] for f in FIELDS)) for r in sample)
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    shared = spark.sparkContext.broadcast(cuts)
    sliced = blocks.mapInArrow(_sliced(shared), _BLOCKS)
    runs = size["runs"]
    while runs > fan:
        runs = -(-runs // fan)
        grouped = sliced.withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(runs)))
        sliced = staged(_dealt(grouped, ranges).mapInArrow(_merged_runs(block), _BLOCKS))
    merged = staged(
        _dealt(sliced.withColumn("grp", F.lit(0).cast("bigint")), ranges).mapInArrow(
            _histories, f"{_COLUMNS}, range bigint, place bigint, begin bigint"
        )
    )
    # One row for each range.
    found = merged.groupBy("range").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("urlkey", "place").alias("first"),
        F.max_by("urlkey", "place").alias("last"),
        F.max("begin").alias("begin"),
    )
    before, start, last, rows = 0, 0, None, []
    for r in sorted(found.collect(), key=lambda r: r["range"]):
        opened = start if r["first"] == last else before
        rows.append((r["range"], before, opened))
        start, last = (before + r["begin"] if r["begin"] else opened), r["last"]
        before += r["n"]
    placed = spark.createDataFrame(rows, "_range bigint, before bigint, opened bigint")
    out = merged.join(placed, F.col("range") == F.col("_range"))
    position = F.col("before") + F.col("place") + 1
    opened = F.when(F.col("begin") == 0, F.col("opened")).otherwise(F.col("before") + F.col("begin"))
    return out.select(*FIELDS, position.alias("position"), (position - opened).alias("capture"))


def captures(pages: DataFrame, path: str | None = None, id: str = "page_id", **columns) -> DataFrame:
    """Write ``pages`` to an archive, read it back and return its index.

    Without ``path`` the archive goes to the shared folder, until the driver's JVM ends.
    """
    spark = pages.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
        delete_at_end(spark, path)
    archive = write_archive(pages, path, id=id, **columns)
    return capture_index(spark, archive).withColumnRenamed("id", id)
