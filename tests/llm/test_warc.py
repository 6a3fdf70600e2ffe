"""Archives that are written, read back and indexed, against plain code."""

import base64
import hashlib
import random

import pytest

from wakeline.llm import warc

COLUMNS = "page_id bigint, url string, html string, id string, at string, sha string, key string, size string, file string, value string, range string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], COLUMNS).repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    """Sorted (id, bytes, digest, type, refers to); one row of the greatest id responds."""
    low = lambda i: -1 if i is None else i
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -2), low(i))
    out, done = [], set()
    for i, _, html in rows:
        body = (html or "").encode()
        first = low(i) == best[html or ""] and (html or "") not in done
        if first or len(body) < min_bytes:
            done.add(html or "")
            out.append((i, len(body), digest(html), "response", None))
        else:
            owner = best[html or ""]
            out.append((i, len(body), digest(html), "revisit", None if owner < 0 else owner))
    return sorted(out, key=str)


def shown(found):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str)


def odd_rows():
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:0>\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    return [
        (1, "http://a.example.com/x?q=1#top", tricky),
        (2, "HTTP://A.Example.com/x?q=1", tricky),
        (3, None, None),
        (4, "no scheme at all", ""),
        (None, None, "null id"),
        (None, "http://b.org", "null id"),
        (5, "http://b.org/line\r\nContent-Length: 9", "same"),
        (5, "http://b.org/line\r\nContent-Length: 9", "same"),
        (5, "http://c.org/", "same"),
        (6, "http://b.org?x=http://z.org/", "ü\U0001f600" * 400_000),
        (7, "http://b.org?x=http://z.org/", "ü\U0001f600" * 400_000),
        (8, "http://ÄÖ.org/é", "\x00\x01 control\r\r\n"),
        (9, "://", "\r\n\r\n"),
    ]


def test_odd_pages(spark, tmp_path):
    rows = odd_rows()
    found = warc.captures(frame(spark, rows), f"{tmp_path}/a").collect()
    assert shown(found) == expected(rows)
    places = [(r.file, r.offset, r.length) for r in found]
    assert len(set(places)) == len(rows)
    keys = [warc.order(tuple(r[f if f != "id" else "page_id"] for f in warc.FIELDS)) for r in sorted(found, key=lambda r: r.position)]
    assert keys == sorted(keys) and sorted(r.position for r in found) == list(range(1, len(rows) + 1))


def test_payloads_come_back_and_places_are_right(spark, tmp_path):
    rows = odd_rows()
    archive = warc.write_archive(frame(spark, rows), f"{tmp_path}/a")
    records = warc.read_archive(spark, archive).collect()
    texts = {digest(h): (h or "").encode() for _, _, h in rows}
    responses = [r for r in records if r.record_type == "response"]
    assert len(responses) == len(texts) and all(r.payload == texts[r.payload_digest] for r in responses)
    assert all(r.payload is None for r in records if r.record_type == "revisit")
    import gzip
    import pathlib

    for r in records:
        whole = gzip.decompress(pathlib.Path(tmp_path, "a", r.file).read_bytes())
        record = whole[r.offset : r.offset + r.length]
        assert record.startswith(archive.opening.encode()) and record.endswith(b"\r\n\r\n")
        assert f"WARC-Type: {r.record_type}".encode() in record


def test_small_payloads_can_stay_apart(spark, tmp_path):
    rows = [(i, "http://a.org/", "copy") for i in range(5)] + [(9, "u", "long copy"), (8, "u", "long copy"), (7, "u", "copy"), (7, "u", "copy")]
    found = warc.captures(frame(spark, rows), f"{tmp_path}/a", min_bytes=5).collect()
    assert shown(found) == expected(rows, 5)


def test_histories_over_many_runs_and_ranges(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://h{rng.randint(0, 3)}.org/{rng.choice('ab')}" if i % 3 else "http://hot.org/", f"p{rng.randint(0, 30)}") for i in range(400)]
    archive = warc.write_archive(frame(spark, rows).repartition(9), f"{tmp_path}/a")
    seconds = {i: warc.EPOCH + i for i, _, _ in rows}
    for settings in ({}, {"run": 7, "block": 3, "fan": 4}, {"run": 1, "block": 1, "fan": 2, "per_range": 20}):
        found = sorted(warc.capture_index(spark, archive, **settings).collect(), key=lambda r: r.position)
        assert [r.position for r in found] == list(range(1, 401))
        want = sorted(((warc.url_key(u), seconds[i], i) for i, u, _ in rows))
        assert [(r.urlkey, r.id) for r in found] == [(u, i) for u, _, i in want]
        seen = {}
        for r in found:
            seen[r.urlkey] = seen.get(r.urlkey, 0) + 1
            assert r.capture == seen[r.urlkey]
        assert [r.captured for r in found[:2]] == sorted(r.captured for r in found[:2]) and found[0].captured.startswith("20000101")


def test_given_times_order_captures(spark, tmp_path):
    rows = [(1, "http://a.org/", "x"), (2, "http://a.org/", "y"), (3, "http://a.org/", "z")]
    pages = frame(spark, rows).selectExpr("page_id", "url", "html", "1700000000 - 86400 * page_id AS second")
    found = warc.captures(pages, f"{tmp_path}/a", captured="second").orderBy("position").collect()
    assert [(r.page_id, r.capture, r.captured) for r in found] == [
        (3, 1, "20231111221320"),
        (2, 2, "20231112221320"),
        (1, 3, "20231113221320"),
    ]


def test_no_pages(spark, tmp_path):
    assert warc.captures(frame(spark, []), f"{tmp_path}/a").collect() == []


def test_damage_is_noticed():
    good = (
        b"WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1::0>\r\nWARC-Payload-Digest: sha1:"
        + digest("hello").encode()
        + b"\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    )
    assert warc.parse(good)[1] == b"hello"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"hello", b"jello"))
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"hello", b"hell"))


@pytest.mark.parametrize("seed", range(6))
def test_loser_tree_merges_blocks_as_sorting_does(seed):
    rng = random.Random(seed)
    runs = [sorted((f"u{rng.randint(0, 5)}", "", rng.randint(0, 9), "f", n * 100 + i) for i in range(rng.randint(0, 30))) for n in range(rng.randint(1, 12))]
    blocks = [run[i : i + 4] for run in runs for i in range(0, len(run), 4)]
    blocks.sort(key=lambda b: warc.order(b[0]))
    assert list(warc.merge(blocks)) == sorted((e for r in runs for e in r), key=warc.order)
