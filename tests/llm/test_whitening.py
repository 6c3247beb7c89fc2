"""Whitening against exact sums and eigenvectors of double precision."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import queries, whitening


def _turned(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 5, 30),
        np.concatenate([[3.0] * 4, 1 + 1e-9 * np.arange(6), [1e-3, 1e-6, 0.0, 0.0]]),
        2 + np.concatenate([1e-5 * np.arange(5), 0.1 + 1e-8 * np.arange(5), 0.2 + 1e-12 * np.arange(5)]),
        np.ones(12),
        10.0 ** -np.arange(12),
    ],
)
def test_eigenvectors(values):
    values = np.sort(values)[::-1]
    a = _turned(values, 5)
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    size = np.abs(values).max()
    assert np.abs(found - values).max() < 1e-14 * size * len(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14
    # Residuals at the level of rounding also where eigenvalues lie together.
    assert np.abs(a @ x - x * found).max() < 2e-15 * size * len(values)


def test_vectors_of_apart_eigenvalues_agree_with_double_precision():
    a = _turned(np.linspace(1, 9, 40), 6)
    a = (a + a.T) / 2
    values, wanted = np.linalg.eigh(a)
    found, x = whitening.eigen(a)
    assert np.allclose(found, values[::-1], rtol=1e-14)
    assert np.abs(np.abs((x * wanted[:, ::-1]).sum(0)) - 1).max() < 1e-13
    single = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(float)
    assert np.abs(a @ single - single * found).max() > 1e-8 > np.abs(a @ x - x * found).max()


def _expected(rows, components):
    used = [(k, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for k, v in rows]
    distinct = sorted({tuple(x) for _, x in used})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[j] for x in distinct) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in distinct])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    out = []
    for key, x in used:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        white = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)]) @ turn / np.sqrt(values)
        out += [(key, j + 1, n, deviation, white[j], values[j]) for j in range(len(values))]
    return out, float(np.trace(centred.T @ centred / n))


def _same(found, rows, components):
    want, trace = _expected(rows, components)
    found = sorted((r for r in found), key=lambda r: (r["vec_id"] is None, r["vec_id"], r["component"]))
    want.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    assert [tuple(r)[:4] for r in found] == [w[:4] for w in want]
    for j in range(1, components + 1):
        a = np.array([r["whitened"] for r in found if r["component"] == j])
        b = np.array([w[4] for w in want if w[1] == j])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
    assert all(abs(r["explained"] / (w[5] / trace) - 1) < 1e-9 for r, w in zip(found, want, strict=True))
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(2)
    good = [(int(i), (rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]).astype(np.float32).tolist()) for i in range(200)]
    good += [good[3], good[3], (900, good[5][1]), (None, good[7][1])] + [(1000 + i, good[9][1]) for i in range(50)]
    bad = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [math.nan] * 6), (303, [math.inf] * 6), (304, [1.0, 2.0]), (305, [])]
    rows = [(k, v, "x", 1.0, 7) for k, v in good + bad]
    return good, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, component string, whitened double, x int")


def test_odd_rows(odd):
    good, table = odd
    _same(whitening.whitened(table, 4).collect(), good, 4)
    assert whitening.whitened(table, 16).agg(F.max("component")).first()[0] == 6


def test_one_vector_and_none(odd):
    _, table = odd
    assert whitening.whitened(table.limit(0)).count() == 0
    assert whitening.whitened(table.filter("vec_id >= 1000")).count() == 0
    assert whitening.whitened(table.filter("vec_id in (300, 305)")).count() == 0


def test_few_vectors_have_few_components(odd):
    good, table = odd
    found = whitening.whitened(table.filter("vec_id < 3"), 16).collect()
    _same(found, good[:3], 2)


def test_huge_entries(spark):
    rows = [(i, [1e300 * (i - 2), float(i * i)]) for i in range(5)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 2).collect()
    # The other component is lost in the rounding of the first.
    assert len(found) == 5 and all(r["deviation"] == whitening.MOST for r in found if r["vec_id"] != 2)
    assert all(math.isfinite(r["whitened"]) for r in found)


def test_registered(spark, sf_dir):
    found = queries.op13_whitening(spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    _same(found, [(r["vec_id"], r["embedding"]) for r in table], 16)
