import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from plain import edge_rows, frame, vocabulary, words

from wakeline.llm import fingerprints as fp
from wakeline.llm import substrings
from wakeline.llm.fm_index import FMIndex, suffix_order
from wakeline.llm.words import chunks


def longest(text, runs):
    """Words from each place of a text on that some run has, by trying."""
    pieces = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    return [max((n for n in range(1, len(text) - i + 1) if tuple(text[i : i + n]) in pieces), default=0) for i in range(len(text))]


def test_suffix_order_and_shared_lengths():
    rng = np.random.default_rng(1)
    for _ in range(20):
        runs = [rng.integers(0, 3, rng.integers(1, 30)) for _ in range(8)]
        symbols = np.concatenate([np.append(r + 8, i) for i, r in enumerate(runs)])
        order, shared = suffix_order(symbols)
        text = symbols.tolist()
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        assert shared[0] == -1
        for a, b, n in zip(order, order[1:], shared[1:]):
            assert text[a : a + n] == text[b : b + n] and text[a : a + n + 1] != text[b : b + n + 1]


@pytest.mark.parametrize("kinds", [2, 4, 30])
def test_matching_statistics_of_texts_that_are_not_in_the_index(kinds):
    rng = np.random.default_rng(kinds)
    for _ in range(10):
        runs = [rng.integers(0, kinds, rng.integers(1, 25)).astype(np.uint64) for _ in range(12)]
        texts = [rng.integers(0, kinds + 1, rng.integers(1, 40)).astype(np.uint64) for _ in range(9)]
        of_run, of_text = rng.integers(0, 3, 12), rng.integers(0, 4, 9)
        got = substrings.matching_statistics(runs, texts, of_run, of_text)
        for text, part, found in zip(texts, of_text, got):
            assert found.tolist() == longest(text.tolist(), [r.tolist() for r, p in zip(runs, of_run) if p == part])


def test_index_keeps_no_suffix_order():
    index = FMIndex(np.array([2, 3, 2, 0, 2, 3, 1]))
    assert not {"order", "symbols"} & set(vars(index))
    low, high = index.extend(np.array([2]), np.array([0]), np.array([7]))
    assert (high - low).tolist() == [3]


@pytest.mark.parametrize("window", [2, 4, 6, 9])
def test_only_earlier_documents_cover(window):
    rng = np.random.default_rng(window)
    for _ in range(20):
        ids, meet = rng.integers(0, 9, 25), rng.integers(0, 3, 25)
        runs = [rng.integers(0, 2, rng.integers(window, window + 9)).astype(np.uint64) for _ in range(25)]
        got = substrings.search_shard(runs, ids, meet, window)
        for run, id, m, covered in zip(runs, ids, meet, got):
            earlier = [r.tolist() for r, i, k in zip(runs, ids, meet) if i < id and k == m]
            assert covered.tolist() == [n >= window for n in longest(run.tolist(), earlier)][: len(run) - window + 1]


def expected(rows, window):
    first = {}
    for d, text, *_ in rows:
        if d is not None:
            w = words(text)
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, text, *_ in rows:
        w = words(text)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    """Texts that share passages, lines shorter than a window, and whole copies."""
    rng = random.Random(seed)
    vocab = vocabulary(60, seed)
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [some(rng.randint(6, 30)) for _ in range(4)]
    rows = []
    for i in range(60):
        w = some(rng.randint(0, 20))
        for _ in range(rng.randint(0, 3)):
            w += rng.choice(shared) + some(rng.randint(0, 9))
        if i % 9 == 8:
            w = words(rows[rng.randrange(len(rows))][1])
        if i % 11 == 10:
            w = w[:3] * 20
        rows.append((i * 37 % 101, ("\n" if i % 2 else " ").join(w), "en", "a"))
    return rows


@pytest.mark.parametrize("seed, shard_words", [(1, 1 << 18), (2, 200), (3, 40)])
def test_removed_words_match_plain_search(spark, seed, shard_words):
    rows = passages(seed)
    got = substrings.remove_repeats(frame(spark, rows), window=8, anchor=3, shard_words=shard_words).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, 8)


def test_removal_on_odd_rows(spark):
    rows = edge_rows()
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, 50)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_kept_text_is_returned(spark):
    rows = passages(4)
    got = substrings.remove_repeats(frame(spark, rows), window=8, anchor=3, with_text=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == expected(rows, 8)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_anchors_of_equal_windows_are_equal():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    h[200:260] = h[20:80]
    text, anchor, _, start, size = substrings.runs_of(h, np.array([0]), np.array([300]), 20, 5)
    of = {int(s) + i: a for a, s, n in zip(anchor, start, size) for i in range(n)}
    assert sorted(of) == list(range(281))
    assert all(of[20 + i] == of[200 + i] for i in range(41))


def piece_set(text):
    out = set()
    for chunk in chunks(pa.array([text])):
        out |= set(fp.digests(chunk)[1].tolist())
    return out


def test_fingerprints_match_sets(spark):
    rows = [r for r in passages(5) + [(500, None, "en", "a"), (501, "", "en", "a"), (502, "é ü\nß", None, None)]]
    rows.append((499, rows[3][1], "en", "a"))
    got = {r.doc_id: r for r in fp.fingerprints(frame(spark, rows)).collect()}
    rows.sort()
    assert len(got) == len(rows)
    print_of = {}
    for (d, text, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for other, near in ((changed, r.near_edited), (after, r.near_next)):
            a, b = piece_set(text), piece_set(other)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert print_of.setdefault(text, r.fingerprint) == r.fingerprint
        assert print_of.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint


def test_fingerprints_of_odd_rows(spark):
    rows = edge_rows()
    got = fp.fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.n_chars for r in got if r.doc_id is None} == {0, len(rows[3][1])}
    assert all(r.edited_sha256 == hashlib.sha256((rows[3][1][: (len(rows[3][1]) + 1) // 2]).encode()).hexdigest() for r in got if r.doc_id is None and r.n_chars)
    assert fp.fingerprints(frame(spark, [])).count() == 0
    one = fp.fingerprints(frame(spark, [(3, "a b c", "en", "a")])).first()
    assert one.near_next == 1.0


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 2**64 - 1, 400, dtype=np.uint64)) for _ in range(2))
    common = a[:300]
    b = np.unique(np.concatenate((common, b[:90])))
    text = np.repeat([0, 1], [len(a), len(b)])
    digest = np.concatenate((a, b))
    base = fp.sketch(text, digest, 2, 12)
    assert fp.differing(text, digest, 2, np.array([0]), np.array([1]), base)[0] == len(np.setxor1d(a, b))
    big = fp.sketch(text, digest, 2, 768)
    _, found, sign, done = big.minus(big, np.array([0]), np.array([1])).peel()
    assert done.all() and set(found[sign > 0]) == set(np.setdiff1d(a, b)) and set(found[sign < 0]) == set(np.setdiff1d(b, a))
