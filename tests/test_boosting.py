"""Quantile boosting against a plain version in numpy, and on rows that it hasn't seen."""

import numpy as np
import pytest

from chronolake.operators import boosting

TAUS = [0.1, 0.5, 0.9]


def made(rng, n):
    x = rng.normal(size=(n, 3)).round(2)
    y = (2 * x[:, 0] + (x[:, 1] > 0) + (0.5 + np.abs(x[:, 0])) * rng.normal(size=n)).round(6)
    return x, y


def plain_fit(x, y, edges, trees, depth, rate, least, bins):
    cell = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    out = []
    for tau in TAUS:
        p = np.full(len(y), np.quantile(y, tau))
        for _ in range(trees):
            at = np.zeros(len(y), int)
            for level in range(depth):
                new = at * 2
                for node in range(2**level):
                    own = at == node
                    g = tau - (y[own] < p[own])
                    best = (1e-9, 0, -1)
                    for f in range(x.shape[1]):
                        for b in range(bins):
                            left = cell[own, f] <= b
                            a, c = left.sum(), (~left).sum()
                            if a >= least and c >= least:
                                gain = round(g[left].sum() ** 2 / a + g[~left].sum() ** 2 / c - g.sum() ** 2 / len(g), 9)
                                if gain > best[0]:
                                    best = (gain, f, b)
                    if best[2] >= 0:
                        new[own] += cell[own, best[1]] > best[2]
                at = new
            for leaf in range(2**depth):
                own = at == leaf
                if own.any():
                    p[own] += rate * np.quantile(y[own] - p[own], tau)
        out.append(p)
    return np.sort(np.array(out).T, 1)


@pytest.fixture(scope="module")
def fitted(spark):
    x, y = made(np.random.default_rng(1), 400)
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double").repartition(3)
    return x, y, df, boosting.fit(df, ["a", "b", "c"], "y", TAUS, 4, 2, 0.5, 16, 10)


def test_equals_the_plain_version(fitted):
    x, y, df, model = fitted
    got = np.array([r.quantiles for r in boosting.predict(df, model).orderBy("i").collect()])
    assert np.allclose(got, plain_fit(x, y, model.edges, 4, 2, 0.5, 10, 16), atol=1e-9)


def test_beats_the_plain_quantile(spark, fitted):
    *_, model = fitted
    x, y = made(np.random.default_rng(2), 600)
    df = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(x)], "i int, a double, b double, c double")
    q = np.array([r.quantiles for r in boosting.predict(df, model).orderBy("i").collect()])
    loss = lambda p, t: np.mean(np.where(y >= p, t * (y - p), (1 - t) * (p - y)))
    for k, t in enumerate(TAUS):
        assert loss(q[:, k], t) < 0.8 * loss(model.base[k], t)
        assert abs(np.mean(y <= q[:, k]) - t) < 0.08


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (2.0, 3.0), (2.0, 3.0)], "x double, y double")
    model = boosting.fit(df, ["x"], "y", [0.5], 1, 1)
    assert [r.quantiles for r in boosting.predict(df, model).collect()] == [[3.0]] * 4
    with pytest.raises(ValueError):
        boosting.fit(df.where("false"), ["x"], "y", [0.5])
