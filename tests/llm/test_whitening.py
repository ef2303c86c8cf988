"""Whitening against exact fractions and a plain solver."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from textloom.llm import whitening
from textloom.llm.common import Workspace

SCHEMA = "vec_id long, embedding array<float>, label int, x long, pos int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "n") for i, v in rows], SCHEMA)


def brute(rows, most=16):
    """Rows as the definition has them: covariance in fractions, eigenvectors of it in doubles."""
    ok = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in ok})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    cov = np.array([[float(sum((Fraction(x[a]) - Fraction(sums[a], n)) * (Fraction(x[b]) - Fraction(sums[b], n)) for x in fit) / n) for b in range(d)] for a in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = []
    for i, x in ok:
        z = np.array([float(Fraction(x[k]) - Fraction(sums[k], n)) for k in range(d)])
        y = z @ vectors / np.sqrt(values)
        out.append((i, n, sum((n * x[k] - sums[k]) ** 2 for k in range(d)), y, values / np.trace(cov)))
    return out, cov, values, vectors


def test_products_and_sums_are_exact_to_a_hundred_bits():
    r = np.random.default_rng(1)
    at = whitening.Centre(7, tuple(int(v) for v in r.integers(10**7, 10**8, 5)))
    x = r.integers(10**6, 10**7, (333, 5))
    high, low = whitening.outer(*at.centred(x))
    want = [sum((int(row[a]) - Fraction(at.sums[a], 7)) * (int(row[b]) - Fraction(at.sums[b], 7)) for row in x) for a in range(5) for b in range(a, 5)]
    scale = max(abs(w) for w in want)
    assert all(abs(Fraction(float(h)) + Fraction(float(s)) - w) < scale / 2**95 for h, s, w in zip(high, low, want))


def test_eigenvectors_to_double_precision():
    r = np.random.default_rng(2)
    q = np.linalg.qr(r.normal(size=(20, 20)))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal in extended precision
        q = q @ (3 * np.eye(20, dtype=np.longdouble) - q.T @ q) / 2
    values = np.concatenate([[3.0, 3.0 - 1e-9, 1.0, 1.0 - 1e-6], 5 * 10.0 ** -np.arange(1, 17)])
    order = np.argsort(-values, kind="stable")
    a = (q * values) @ q.T
    got, vectors = whitening.eigen((a + a.T) / 2)
    assert np.allclose(got.astype(float), values[order], rtol=1e-12, atol=1e-17)
    for k, i in enumerate(order[:6]):
        assert min(np.abs(vectors[:, k] - q[:, i]).max(), np.abs(vectors[:, k] + q[:, i]).max()) < 1e-9
    assert np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-17


def test_whitening_matches_fractions(spark):
    r = np.random.default_rng(3)
    mix = r.normal(size=(18, 18)) * (0.75 ** np.arange(18))
    rows = [(k, (r.normal(size=18) @ mix.T + 5).astype(np.float32).tolist()) for k in range(300)]
    rows += [(500 + k, rows[3][1]) for k in range(40)] + [(None, rows[7][1]), (3, rows[3][1])]  # copies, and identifiers that repeat or are missing
    rows += [(900, None), (901, [None] + rows[0][1][1:]), (902, [math.nan] + rows[0][1][1:]), (903, [math.inf] * 18), (904, []), (905, [1.0, 2.0])]
    want, cov, values, vectors = brute([x for x in rows if x[1] and len(x[1]) == 18])
    with Workspace(spark, "t") as ws:
        got = whitening.whiten(ws, frame(spark, rows).repartition(7)).collect()
    assert len(got) == 16 * len(want)
    by = {}
    for g in got:
        by.setdefault((g["vec_id"], g["component"]), []).append(g)
    signs = {}
    for i, n, deviation, y, share in want:
        for c in range(16):
            g = by[i, c + 1][0]
            assert (g["n"], g["deviation"]) == (n, deviation)
            signs.setdefault(c, 1 if g["whitened"] * y[c] >= 0 else -1)
            assert g["whitened"] * signs[c] == pytest.approx(y[c], abs=1e-8)
            assert g["explained"] == pytest.approx(share[c], rel=1e-9) and 0 <= g["identity_error"] < 1e-9


def test_few_vectors_and_flat_dimensions(spark):
    with Workspace(spark, "t") as ws:
        assert whitening.whiten(ws, frame(spark, [])).collect() == []
    with Workspace(spark, "t") as ws:
        assert whitening.whiten(ws, frame(spark, [(1, None), (2, [])])).collect() == []
    with Workspace(spark, "t") as ws:
        assert whitening.whiten(ws, frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    with Workspace(spark, "t") as ws:  # two vectors have one component
        got = whitening.whiten(ws, frame(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 4.0, 3.0]), (2, [1.0, 4.0, 3.0])])).collect()
        assert [r["component"] for r in got] == [1, 1, 1] and sorted(abs(r["whitened"]) for r in got) == pytest.approx([1, 1, 1])
        assert got[0]["explained"] == pytest.approx(1) and got[0]["deviation"] == 128**2 and got[0]["identity_error"] < 1e-12


def test_huge_entries(spark):
    rows = [(k, [float(k), 3e38 * (k % 2), -1e30 * (k % 3)]) for k in range(9)]
    with Workspace(spark, "t") as ws:
        got = whitening.whiten(ws, frame(spark, rows)).collect()
    assert len({r["vec_id"] for r in got}) == 9 and all(r["deviation"] is None and math.isfinite(r["whitened"]) for r in got)


def test_exact_deviations():
    at = whitening.Centre(3, (3_000_001, 2_999_990))
    x = np.array([[1_000_000, 10**9], [2**51, 5]], np.int64)
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, at.sums)) for row in x]
    assert at.deviations(x[:1]) == want[:1] and at.deviations(x) == [want[0], None]
