import random

import numpy as np
import pytest
from plain import components, edge_rows, frame, vocabulary, words

from wakeline.llm import jaccard_trie as jt
from wakeline.llm.components import components as spark_components


def grams(text, n):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(lowered)
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else set(zip(*(w[i:] for i in range(n))))


def expected(rows, n, percent):
    sets = [grams(r[1], n) for r in rows]
    nodes = range(len(rows))
    linked = [
        (i, j)
        for i in nodes
        for j in nodes
        if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    label = components(nodes, linked)
    out = []
    for i in nodes:
        ids = [rows[j][0] for j in nodes if label[j] == label[i] and rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), (min(ids) if ids else None) if sets[i] else rows[i][0]))
    return sorted(out, key=str)


def families(seed, sizes, edits):
    """Groups of texts that differ in a few words from their first."""
    rng = random.Random(seed)
    vocab = vocabulary(300, seed)
    rows = []
    for size in sizes:
        base = [rng.choice(vocab) for _ in range(rng.randint(4, 160))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                w += [rng.choice(vocab) for _ in range(rng.randint(1, 4))]
            text = " ".join(w)
            rows.append((len(rows) * 7 % 1009, text.upper() if rng.random() < 0.1 else text, "en", "a"))
    return rows


@pytest.mark.parametrize("seed, n, percent, block", [(1, 3, 90, 1 << 19), (2, 3, 90, 400), (3, 5, 80, 300), (4, 2, 70, 900)])
def test_components_match_all_pairs(spark, seed, n, percent, block):
    rows = families(seed, [1] * 20 + [2, 3, 5, 40, 12, 8], 3)
    got = jt.jaccard_components(frame(spark, rows), n=n, percent=percent, block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, n, percent)


def test_odd_rows(spark):
    rows = edge_rows()
    got = jt.jaccard_components(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, 3, 90)
    assert jt.jaccard_components(frame(spark, [])).count() == 0


def test_small_sets_at_the_threshold(spark):
    base = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(base[: 10 + i]), "en", "a") for i in range(3)]
    rows += [(10 + i, " ".join(["x", *base][: 9 + i]), "en", "a") for i in range(4)]
    got = jt.jaccard_components(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, 3, 90)


def test_signatures_never_miss_a_pair():
    """A pair shares more signatures than either set may leave out."""
    rng = np.random.default_rng(3)
    for percent in (70, 80, 90, 95):
        for _ in range(400):
            a = int(rng.integers(1, 120))
            pool = np.unique(rng.integers(0, 2**64 - 1, 400, dtype=np.uint64))
            rng.shuffle(pool)
            common, rest = pool[:a], pool[a:]
            x = np.concatenate((common[: a - int(rng.integers(0, a // 5 + 1))], rest[: int(rng.integers(0, a // 6 + 1))]))
            pair = [np.unique(common), np.unique(x)]
            both = len(np.intersect1d(*pair))
            if 100 * both < percent * (len(pair[0]) + len(pair[1]) - both) or np.array_equal(*pair):
                continue
            text = np.repeat([0, 1], [len(p) for p in pair])
            owner, sig, kind = jt.signatures(text, np.concatenate(pair), np.array([len(p) for p in pair]), percent)
            enough = []
            for cls in np.unique(kind >> 32):
                mine = [(owner == t) & (kind >> 32 == cls) for t in (0, 1)]
                shared = np.intersect1d(sig[mine[0]], sig[mine[1]]).size
                enough.append(all(m.any() and shared > (kind[m][0] & 0xFFFFFFFF) for m in mine))
            assert any(enough)


def test_trie_finds_what_comparison_finds():
    rng = np.random.default_rng(8)
    for _ in range(30):
        pool = np.arange(1, 60, dtype=np.uint64)
        sets = sorted((np.sort(rng.choice(pool, rng.integers(20, 55), replace=False)) for _ in range(25)), key=lambda s: s.astype(">u8").tobytes())
        got = {i: set(w.tolist()) - {i} for i, w in jt.Trie(sets).walk(75, np.arange(len(sets)))}
        for i, x in enumerate(sets):
            want = {j for j, y in enumerate(sets) if i != j and 100 * (o := len(np.intersect1d(x, y))) >= 75 * (len(x) + len(y) - o)}
            assert got.get(i, set()) == want


def test_long_chains_are_one_component(spark):
    links = [(i, i + 1) for i in range(0, 400)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.label for r in spark_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert len({got[i] for i in range(401)}) == 1 and got[1001] == got[1000] != got[0] and 5000 not in got


def test_one_of_each_group_stays(spark):
    rows = families(6, [3, 1, 4], 1)
    out = jt.keep_first(frame(spark, rows), n=5, percent=80)
    want = expected(rows, 5, 80)
    assert out.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in want})


def test_repeated_ids_are_told_apart(spark):
    rng = random.Random(9)
    vocab = vocabulary(3000, 9)
    some = [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(7)]
    rows = [
        (1, some[0]), (1, some[0]), (1, some[0]), (2, some[0]),  # repeated rows of the least id
        (3, some[1]), (4, some[1]), (4, some[2]),  # an id with a copy and an unrelated text
        (5, some[3]), (6, some[3]), (5, some[4]), (7, some[4]),  # two groups with one least id
        (8, some[5]), (8, some[5] + " more"), (8, some[5].upper()), (9, some[5]),  # one id, near copies
        (10, some[6]), (10, some[6]),  # repeated rows without another copy
        (11, ""), (11, ""), (None, some[0]), (None, some[0]),
    ]
    docs = frame(spark, [(*r, "en", f"s{i}") for i, r in enumerate(rows)])
    out = jt.keep_first(docs, n=5, percent=80)
    assert out.columns == docs.columns
    out = out.collect()
    eights = [r.text for r in out if r.doc_id == 8]
    assert len(eights) == 1 and eights[0].lower().startswith(some[5])
    want = [(1, some[0]), (3, some[1]), (4, some[2]), (5, some[3]), (5, some[4]), (10, some[6]), (11, ""), (11, ""), (None, some[0]), (None, some[0])]
    assert sorted(((r.doc_id, r.text) for r in out if r.doc_id != 8), key=str) == sorted(want, key=str)
