"""Whitening: the solver against dense eigenvalues, the operator against numpy, and rows that aren't fit."""

import math
from collections import Counter

import numpy as np
import pytest

from folia.llm import whitening as W


@pytest.mark.parametrize("width", [1, 3, 9, 64, 300])
@pytest.mark.parametrize("kind", ["spread", "flat", "twins", "low"])
def test_solver(width, kind):
    rng = np.random.default_rng(width)
    scale = {"spread": np.geomspace(1, 1e-4, width), "flat": np.ones(width), "twins": np.repeat(np.arange(width, 0, -1.0), 2)[:width], "low": (np.arange(width) < 5) * 1.0}[kind]
    turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
    v = (turn * scale) @ turn.T
    values, vectors = W.jacobi_davidson(lambda b: v @ b, width, 8)
    want = np.sort(scale)[::-1][: len(values)]
    assert len(values) == min(8, width)
    assert np.abs(values - want).max() < 1e-12 * want[0]
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def brute(rows):
    """(rows by id, n, sums, eigenvalues, vectors, trace) of what is fit."""
    fit = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) < W.BOUND for c in v)]
    sizes = Counter(len(v) for _, v in fit)
    usual = max(sizes, key=lambda s: (sizes[s], s))
    fit = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in fit if len(v) == usual]
    x = np.asarray([v for _, v in fit], float)
    z = x - x.mean(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(x))
    return fit, len(fit), x.sum(0), values[::-1], vectors[:, ::-1], values.sum()


def check(df, rows):
    out = W.whitened(df).collect()
    fit, n, sums, values, vectors, trace = brute(rows)
    k = max((r["component"] for r in out), default=0)
    assert k == min(8, int((values > W.RANK * values[0]).sum())) and len(out) == k * n
    for c in range(k):
        own = sorted((r for r in out if r["component"] == c + 1), key=lambda r: (r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"], abs(r["whitened"])))
        line = np.asarray([r["whitened"] for r in own])
        ids = [(i is not None, i or 0, sum((n * x - int(s)) ** 2 for x, s in zip(v, sums, strict=True)), v) for i, v in fit]
        ids = sorted(ids, key=lambda t: (t[0], t[1], t[2], abs((np.asarray(t[3]) - sums / n) @ vectors[:, c])))
        want = np.asarray([(np.asarray(t[3]) - sums / n) @ vectors[:, c] for t in ids]) / math.sqrt(values[c])
        assert min(np.abs(line - want).max(), np.abs(line + want).max()) < 1e-6
        assert [r["deviation"] for r in own] == [t[2] for t in ids]
        assert {r["n"] for r in own} == {n}
        assert all(abs(r["explained"] - values[c] / trace) < 1e-9 for r in own)
    assert len({r["identity_error"] for r in out}) <= 1 and all(r["identity_error"] < 1e-6 for r in out)


@pytest.mark.parametrize("parts", [W.PARTS, 2])
def test_operator(spark, monkeypatch, parts):
    monkeypatch.setattr(W, "PARTS", parts)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(12) * np.geomspace(3, 0.1, 12)).tolist()) for i in range(90)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (200, None), (201, []), (202, [None] * 12), (203, [float("nan")] + [0.0] * 11), (204, [float("inf")] * 12), (205, [1.0] * 11), (206, [1e300] * 12)]
    check(spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, x int, component string").repartition(5), rows)


def test_few_dimensions_ranks_and_rows(spark):
    kind = "vec_id long, embedding array<float>"
    check(spark.createDataFrame(one := [(i, [float(i * i % 7), 1.0]) for i in range(20)], kind), one)
    line = [(i, [float(i), 2.0 * i, -float(i)]) for i in range(30)]
    check(spark.createDataFrame(line, kind), line)
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        assert W.whitened(spark.createDataFrame(rows, kind)).collect() == []


def test_deviations_beyond_a_long():
    fitted = W.Fit(10**6, (0, 0), 1.0, np.ones(1), np.zeros((2, 1)))
    assert W._deviations(np.asarray([[3, -4], [2**40, 1]]), fitted) == [25 * 10**12, None]
    assert W._deviations(np.asarray([[2900, 0], [0, 0]]), fitted) == [2900**2 * 10**12, 0]
