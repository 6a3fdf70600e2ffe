"""Whitening against exact integers and a dense eigensolver."""

import math
import random

import numpy as np
import pytest

from wakeline.llm import qdwh, whitening
from wakeline.llm.queries import QUERIES

COLUMNS = "vec_id bigint, embedding array<double>, n bigint, deviation string, component int, white string, id string, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], 1, "x", 2, "y", "z", "w") for i, v in rows], COLUMNS).repartition(3)


def expected(rows, keep=8):
    """Per id: exact deviation; and the whitened rows up to sign."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    x = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (d - len(v)) for _, v in good]
    n = len(x)
    sums = [sum(r[k] for r in x) for k in range(d)]
    centred = [[n * r[k] - sums[k] for k in range(d)] for r in x]
    deviation = [sum(c * c for c in r) for r in centred]
    cov = np.array([[sum(r[a] * r[b] for r in centred) / n**3 for b in range(d)] for a in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(keep, d)
    white = (np.array(centred, float) / n) @ vectors[:, :k] / np.sqrt(values[:k])
    return [i for i, _ in good], n, deviation, white, values / np.trace(cov)


def compare(spark, rows):
    ids, n, deviation, white, share = expected(rows)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == len(ids) * white.shape[1]
    by_component = {}
    for r in got:
        by_component.setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
    assert sorted(by_component) == list(range(1, white.shape[1] + 1))
    want = sorted(zip((i is None for i in ids), (i or 0 for i in ids), deviation))
    for c, found in by_component.items():
        assert sorted((r.vec_id is None, r.vec_id or 0, int(r.deviation)) for r in found) == want
        # Either sign, the same for all rows.
        mine = sorted((int(r.deviation), r.whitened) for r in found)
        same = sorted(zip(deviation, white[:, c - 1]))
        flip = sorted(zip(deviation, -white[:, c - 1]))
        assert any(np.allclose([b for _, b in mine], [b for _, b in s], atol=1e-7) for s in (same, flip))


def test_against_exact_integers_and_a_dense_solver(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0.3 * k, 0.1 + 0.07 * k) for k in range(12)]) for i in range(150)]
    compare(spark, rows)


def test_left_out_rows_short_rows_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.1 + 0.05 * k) for k in range(5)]) for i in range(40)]
    rows += [(40, None), (41, [0.1, None, 0.2, 0.0, 0.0]), (42, [math.nan] * 5), (43, [math.inf, 0, 0, 0, 0.0])]
    rows += [(None, [0.5, 0.25, -0.125, 1.0, 2.0]), (7, rows[7][1]), (44, [0.75, -0.5]), (45, [])]
    compare(spark, rows)


def test_large_entries_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1e9, 1e9), rng.uniform(-1, 1), rng.uniform(-1e4, 1e4)]) for i in range(30)]
    ids, n, deviation, _, _ = expected(rows)
    got = whitening.whiten(frame(spark, rows)).where("component = 1").collect()
    assert {r.vec_id: int(r.deviation) for r in got} == dict(zip(ids, deviation))


def test_nothing_to_whiten(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [math.nan])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, []), (2, [])])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [0.1, 0.2])] * 3)).collect() == []


def test_components_without_variance_are_left_out(spark):
    rng = random.Random(7)
    rows = [(i, [x := rng.random(), 0.5, x]) for i in range(30)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1, rel=1e-9)


def test_an_extreme_entry_counts_as_the_end_of_the_grid(spark):
    rows = [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.25])]
    got = whitening.whiten(frame(spark, rows)).where("component = 1").collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3]


def test_sums_are_exact_beyond_doubles():
    y = np.array([[1 << 40, 3], [5, 1 << 45]])
    assert whitening.products(y).tolist() == [[(1 << 80) + 25, 3 * (1 << 40) + 5 * (1 << 45)]] * 1 + [[3 * (1 << 40) + 5 * (1 << 45), 9 + (1 << 90)]]


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_divide_and_conquer_solves(d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((3 * d + 2, d)) * np.linspace(1, 5, d)
    v = x.T @ x
    values, q = qdwh.components(v)
    assert np.allclose(values, np.linalg.eigh(v)[0][::-1], rtol=1e-12, atol=1e-12 * values[0])
    assert np.abs(q.T @ q - np.eye(d)).max() < 1e-13 and np.abs(v @ q - q * values).max() < 1e-12 * values[0]


@pytest.mark.parametrize("values", [[2, 2, 2, 2], [5, 5, 1, 1, 1, 0, 0], [1, 0, -1], [0, 0], [3.0**-k for k in range(25)]])
def test_repeated_zero_and_graded_eigenvalues(values):
    rng = np.random.default_rng(1)
    basis, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    v = basis @ np.diag(values) @ basis.T
    found, q = qdwh.components(v)
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-13)
    assert np.abs(v @ q - q * found).max() < 1e-13


def test_query_against_plain_code(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, n, deviation, white, share = expected(rows)
    got = QUERIES["op11_embedding_whitening"](spark, sf).collect()
    assert len(got) == 8 * len(ids)
    place = {i: k for k, i in enumerate(ids)}
    assert all(r.deviation == deviation[place[r.vec_id]] and r.identity_error < 1e-4 for r in got)
    for c in range(8):
        mine = np.array([r.whitened for r in sorted(got, key=lambda r: place[r.vec_id]) if r.component == c + 1])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-8
