"""Whitening against a plain computation, and its eigenvalue solver against numpy's."""

from __future__ import annotations

import math

import numpy as np
import pytest
from tapeledger.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, whitened string"


def symmetric(n, kind, seed):
    r = np.random.default_rng(seed)
    if kind == "plain":
        a = r.standard_normal((n, n))
        return a @ a.T
    if kind == "diagonal with equal values":
        return np.diag(np.r_[np.ones(n - n // 2), np.full(n // 2, 2.0)])
    if kind == "clusters":
        q = np.linalg.qr(r.standard_normal((n, n)))[0]
        a = q @ np.diag(np.r_[np.full(n // 2, 3.0), np.linspace(3, 3 + 1e-9, n - n // 2)]) @ q.T
        return (a + a.T) / 2
    b = r.standard_normal((n, max(1, n // 3)))
    return b @ b.T * 1e9


@pytest.mark.parametrize("kind", ["plain", "diagonal with equal values", "clusters", "low rank"])
@pytest.mark.parametrize("n", [1, 2, 3, 16, 64])
def test_eigenpairs(n, kind):
    a, k = symmetric(n, kind, n), min(16, n)
    values, vectors = whitening.leading_eigenpairs(a, k)
    size = np.abs(a).max()
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-13 * size)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13


def test_sturm_counts():
    d, e = np.array([2.0, 1.0, 3.0, 0.0]), np.array([1.0, 0.0, 0.5])
    all_values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-2, 5, 40)
    assert whitening.below(d, e, at).tolist() == [(all_values < x).sum() for x in at]


def plain(vectors):
    """``n``, deviations, whitened rows and shares by numpy over the distinct vectors."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:16]
    live = order[e[order] > 1e-9 * e.sum()]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return n, deviation, (x - total / n) @ v[:, live] / np.sqrt(e[live]), e[live] / e.sum()


@pytest.mark.parametrize("d", [3, 20])
def test_whitening_of_odd_tables(spark, d):
    r = np.random.default_rng(d)
    good = (r.standard_normal((120, d)) * np.linspace(3, 0.2, d)).astype(np.float32)
    good[100:] = good[:20]  # copies: fitted once
    rows = [(i if i % 7 else None, [float(c) for c in v], 1, "x") for i, v in enumerate(good)]
    bad = [(500, None, 1, "x"), (501, [], 1, "x"), (502, [math.nan] * d, 1, "x"), (503, [math.inf] + [0.0] * (d - 1), 1, "x"), (504, [None] + [1.0] * (d - 1), 1, "x"), (505, [1.0] * (d + 1), 1, "x")]
    got = whitening.whiten(spark.createDataFrame(rows + bad, SCHEMA).repartition(5)).collect()
    n, deviation, w, share = plain(good)
    assert len(got) == 120 and {x["n"] for x in got} == {n} and n == 100
    first = {}
    for x in got:
        first.setdefault(x["deviation"], x)
    sign = None
    for i in range(120):
        x = first[deviation[i]]
        mine = np.array(x["whitened"])
        sign = np.sign(mine * w[i]) if sign is None else sign
        assert np.allclose(mine * sign, w[i], atol=1e-8) and np.allclose(x["explained"], share, rtol=1e-9)
    assert 0 <= got[0]["identity_error"] < 1e-9
    long = whitening.component_rows(whitening.whiten(spark.createDataFrame(rows, SCHEMA)))
    assert long.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted({x["component"] for x in long.collect()}) == list(range(1, min(16, d) + 1)) and long.count() == 120 * min(16, d)


def test_whitening_without_variance_and_of_nothing(spark):
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (2, [1.0, 2.0], 1, "")], SCHEMA)).collect()
    assert [(x["n"], x["deviation"], x["whitened"], x["explained"]) for x in same] == [(1, 0, [], [])] * 2
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.component_rows(whitening.whiten(spark.createDataFrame([(1, None, 1, "")], SCHEMA))).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0], 1, "") for i in range(4)], SCHEMA)).collect()
    assert all(len(x["whitened"]) == 1 and np.allclose(x["explained"], [1.0]) for x in flat)


def test_exact_sums_of_large_numbers():
    big = np.array([[1 << 40, 3], [-(1 << 40), 5]], np.int64)
    assert whitening._gram(big).tolist() == [[2 << 80, -(2 << 40)], [-(2 << 40), 34]]
    model = whitening.Whitener(3, [10, -4], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[7, 2], [1 << 50, 0]], np.int64)
    assert model.deviation(x) == [(21 - 10) ** 2 + (6 + 4) ** 2, None]


def test_query_over_the_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    table = queries.table(spark, sf, "embeddings")
    got = queries.QUERIES["op13_embedding_whitening"](spark, sf).toPandas()
    vectors = table.orderBy("vec_id").toPandas()
    n, deviation, w, share = plain(np.stack(vectors["embedding"]))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[vectors["vec_id"]].to_numpy()
    sign = np.sign((wide * w).sum(axis=0))
    assert np.allclose(wide * sign, w, atol=1e-7) and got["identity_error"].max() < 1e-4 and (got["n"] == n).all()
    assert dict(zip(got["vec_id"], got["deviation"])) == dict(zip(vectors["vec_id"], deviation))
    assert np.allclose(got.groupby("component")["explained"].first(), share, rtol=1e-6)
