"""The fill-in-the-middle transformation against a plain tokenizer."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from plain import edge_rows, frame, vocabulary
from pyspark.sql import functions as F

from wakeline.llm import fill_middle
from wakeline.llm.words import chunks

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h1, h2, h3, h4 = fill_middle.draws(42, doc_id)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def checked(spark, rows):
    made = fill_middle.fill_in_middle(frame(spark, rows).repartition(3))
    made = made.withColumn("back", fill_middle.restore(F.col("form"), F.col("output")))
    got = [tuple(r) for r in made.collect()]
    want = [expected(r[0], r[1]) + (r[1] or "",) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted(want, key=key)
    return {r[2] for r in got}


def test_edges_against_plain_code(spark):
    rows = edge_rows()
    rows += [(100 + i, t, "en", "a") for i, t in enumerate(("has <P> in it", "<S>", "a<M>b " * 40, "x<", "<S", "<P <S <M", "S> P> M>" * 9))]
    rows += [(200 + i, " \t" * i + "wörd \U0001f600" * i + "\n" * (i % 3), "en", "a") for i in range(60)]
    rows += [(300, "y" * 50_000, "en", "a"), (301, " " * 30_000, "en", "a"), (302, "z " * 20_000 + "q" * 20_000, "en", "a")]
    assert checked(spark, rows) == {"plain", "psm", "spm"}


def test_many_forms_and_shared_passages(spark):
    rng = random.Random(3)
    vocab = vocabulary(300)
    shared = " ".join(rng.choice(vocab) for _ in range(2_000))
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80))) + rng.choice(["", " ", "\n"]) + shared * (i % 2), "en", "a") for i in range(400)]
    rows += [(9, "the same text <S", "en", "a")] * 3
    checked(spark, rows)


def test_nothing(spark):
    assert fill_middle.fill_in_middle(frame(spark, [])).collect() == []


@pytest.mark.parametrize("tail", ["", " "])
def test_pieces_of_shared_passages_are_summed_up_once(tail):
    rng = random.Random(1)
    vocab = vocabulary(500)
    passage = " ".join(rng.choice(vocab) for _ in range(20_000))
    texts = [f"head {i} of text {passage}{tail}" for i in range(5)]
    memo = fill_middle.Memo()
    seen = 0
    for chunk in chunks(pa.array(texts)):
        units = fill_middle.Units(chunk, memo)
        seen += len(units.pieces)
        assert units.count.tolist() == [len(UNIT.findall(texts[chunk.first + i])) for i in range(chunk.texts)]
    assert memo.computed < seen / 3


def test_memory_is_bounded_and_forgetting_changes_nothing():
    rng = np.random.default_rng(0)
    texts = pa.array([bytes(rng.choice(list(b"abc \n"), 20_000)).decode() for _ in range(20)])
    small = fill_middle.Memo(10_000)
    for chunk in chunks(texts):
        a, b = fill_middle.Units(chunk, small), fill_middle.Units(chunk, fill_middle.Memo())
        assert a.count.tolist() == b.count.tolist()
        assert [a.end(0, k) for k in range(0, int(a.count[0]), 97)] == [b.end(0, k) for k in range(0, int(a.count[0]), 97)]
        again = fill_middle.Units(chunk, small)
        assert again.count.tolist() == b.count.tolist()
    assert small.held < 20_000 and sum(map(len, small.old)) < 20_000


def test_equal_bytes_are_cut_alike_wherever_they_stand():
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef ") for _ in range(30_000))
    cuts = []
    for head in ("", "some other beginning "):
        (chunk,) = chunks(pa.array([head + passage]))
        cuts.append({int(c) - len(head) for c in fill_middle.cut_chunks(chunk)})
    assert len(cuts[0] & cuts[1]) > 0.9 * len(cuts[0])


def test_draws_follow_the_stated_hash():
    digest = hashlib.sha256(b"42:7").hexdigest()
    assert fill_middle.draws(42, 7)[1] == int(digest[8:16], 16)
