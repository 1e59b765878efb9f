"""Models from sums of products against plain fits on all rows."""

import datetime

import numpy as np
import pandas as pd
import pytest

from chronolake.operators import gram


def panel(rng, n=240, p=4, groups="ab"):
    out = []
    for g in groups:
        x = rng.normal(0, [1, 3, 0.2, 1][:p], (n, p)) + [0, 5, 1, 0][:p]
        y = 2 + x @ np.array([1.5, 0, -2, 0][:p]) + rng.normal(0, 0.5, n)
        out += [(g, i, i * 5 // n, *map(float, x[i]), float(y[i])) for i in range(n)]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    data = panel(np.random.default_rng(1))
    return data, spark.createDataFrame(data, "g string, t int, fold int, x0 double, x1 double, x2 double, x3 double, y double")


XS = ["x0", "x1", "x2", "x3"]


def plain_net(x, y, l1, l2):
    """Proximal gradient on the rows themselves."""
    mean, dev = x.mean(0), x.std(0)
    z, c = (x - mean) / dev, y - y.mean()
    a, d = z.T @ z / len(z), z.T @ c / len(z)
    b, step = np.zeros(x.shape[1]), 1 / (np.linalg.eigvalsh(a)[-1] + l2)
    for _ in range(2_000):
        v = b - step * (a @ b - d + l2 * b)
        b = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
    return np.r_[y.mean() - (b / dev) @ mean, b / dev]


@pytest.mark.parametrize("ratio", [1.0, 0.5, 0.0])
def test_penalty_path(rows, ratio):
    data, df = rows
    penalties = [1.0, 0.1, 0.01]
    got = {(r.g, r.penalty): r for r in gram.penalty_path(df, "g", "fold", XS, "y", penalties, ratio).collect()}
    for g in "ab":
        a = np.array([r[2:] for r in data if r[0] == g], float)
        fold, x, y = a[:, 0], a[:, 1:5], a[:, 5]
        errors = {}
        for lam in penalties:
            e = []
            for k in range(1, 5):
                c = plain_net(x[fold < k], y[fold < k], lam * ratio, lam * (1 - ratio))
                e.append(np.mean((y[fold == k] - c[0] - x[fold == k] @ c[1:]) ** 2))
            errors[lam] = np.mean(e)
            c = plain_net(x, y, lam * ratio, lam * (1 - ratio))
            r = got[g, lam]
            assert np.allclose([r.intercept, *r.coef], c, atol=1e-6) and abs(r.cv_mse - errors[lam]) < 1e-6
        assert [lam for lam in penalties if got[g, lam].chosen] == [min(errors, key=errors.get)]


def test_lasso_selects(rows):
    _, df = rows
    path = gram.penalty_path(df, "g", "fold", XS, "y", [0.3])
    assert sorted((r.g, r.term) for r in gram.selected(path, "g", XS).collect()) == [(g, x) for g in "ab" for x in ("x0", "x2")]


def test_constant_column_and_lone_fold(spark):
    df = spark.createDataFrame([("a", 0, 1.0, float(i), 2.0 * i) for i in range(10)], "g string, fold int, c double, x double, y double")
    (r,) = gram.penalty_path(df, "g", "fold", ["c", "x"], "y", [0.0]).collect()
    assert r.cv_mse is None and r.chosen and np.allclose([r.intercept, *r.coef], [0, 0, 2], atol=1e-9)
    assert gram.penalty_path(df.where("false"), "g", "fold", ["c", "x"], "y", [0.0]).collect() == []


def test_ridge_is_the_normal_equations(rows):
    data, df = rows
    for r in gram.ridge(df, "g", [gram.F.lit(1.0), *XS], "y", [0, 1, 1, 1, 1]).collect():
        a = np.array([x[3:] for x in data if x[0] == r.g], float)
        x = np.column_stack([np.ones(len(a)), a[:, :4]])
        assert np.allclose(r.coef, np.linalg.solve(x.T @ x + np.diag([0, 1, 1, 1, 1]), x.T @ a[:, 4])) and r.n == len(a)


def test_bayesian_ridge(rows):
    """Both precisions are at a maximum of the evidence, and predictions have the spread of the posterior."""
    data, df = rows
    fits = gram.bayesian_ridge(df, "g", XS, "y")
    got = {r.g: r for r in fits.collect()}
    spread = {(r.g, r.t): r for r in gram.predicted_spread(df, fits, "g", XS).collect()}
    for g in "ab":
        a = np.array([x[1:] for x in data if x[0] == g], float)
        x, y = a[:, 2:6] - a[:, 2:6].mean(0), a[:, 6] - a[:, 6].mean()
        r = got[g]

        def evidence(noise, weight):
            c = np.eye(len(y)) / noise + x @ x.T / weight
            return -0.5 * (np.linalg.slogdet(c)[1] + y @ np.linalg.solve(c, y))

        best = evidence(r.noise, r.weight)
        for f in (0.7, 1.4):
            assert best > evidence(r.noise * f, r.weight) and best > evidence(r.noise, r.weight * f) - 1e-3
        s = np.linalg.inv(r.weight * np.eye(4) + r.noise * x.T @ x)
        assert np.allclose(r.coef, r.noise * s @ x.T @ y)
        for i in (0, 17, 200):
            one = spread[g, i]
            assert np.isclose(one.std, np.sqrt(1 / r.noise + x[i] @ s @ x[i])) and np.isclose(one.prediction, a[:, 6].mean() + x[i] @ np.array(r.coef))


def test_piecewise_trend(spark):
    """A made series with a bend, seasons and a holiday is carried on."""
    rng, start = np.random.default_rng(3), datetime.date(2020, 1, 1)
    days = [start + datetime.timedelta(i) for i in range(1_500)]
    bend = np.maximum(np.arange(1_530) - 700, 0)
    true = 50 + 0.02 * np.arange(1_530) + 0.05 * bend + 5 * np.sin(2 * np.pi * np.arange(1_530) / 7) + 8 * np.cos(2 * np.pi * np.arange(1_530) / 365.25)
    y = true[:1_500] + rng.normal(0, 0.5, 1_500) + np.array([20.0 * (d.strftime("%m-%d") == "12-25") for d in days])
    df = spark.createDataFrame([("a", d, float(v)) for i, (d, v) in enumerate(zip(days, y, strict=True)) if i % 11], "e string, ts date, v double")
    got = gram.piecewise_trend(df, "e", "ts", "v", 30, holidays=["12-25"]).orderBy("step").collect()
    assert [r.ts for r in got] == [days[-1] + datetime.timedelta(i) for i in range(1, 31)]
    assert np.abs(np.array([r.forecast for r in got]) - true[1_500:]).max() < 2.0
    assert 0.04 < (got[-1].trend - got[0].trend) / 29 < 0.1


def system(rng, rank, n=600):
    """Three channels: as many returning processes as ``rank``, random walks else, mixed by a fixed matrix."""
    e, x = rng.normal(size=(n, 3)), np.zeros((n, 3))
    for t in range(1, n):
        x[t] = x[t - 1] * np.where(np.arange(3) < rank, 0.5, 1.0) + e[t]
    return x @ np.array([[1.0, 0.5, 0.2], [0.3, 1.0, -0.4], [-0.5, 0.2, 1.0]])


def plain_johansen(x, lags):
    d, k = np.diff(x, axis=0), x.shape[1]
    z = np.column_stack([np.ones(len(d) - lags), *(d[lags - j : len(d) - j] for j in range(1, lags + 1))])
    r = [v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (d[lags:], x[lags:-1])]
    s00, s01, s11 = r[0].T @ r[0], r[0].T @ r[1], r[1].T @ r[1]
    value = np.sort(np.linalg.eigvals(np.linalg.solve(s11, s01.T @ np.linalg.solve(s00, s01))).real)[::-1]
    return value, np.array([-len(z) * np.log1p(-value[r:]).sum() for r in range(k)])


def test_johansen(spark):
    rng, right, seen = np.random.default_rng(5), 0, {}
    rows = []
    for i in range(24):
        x = system(rng, i % 4)
        seen[i] = x
        rows += [(i, t, *map(float, v)) for t, v in enumerate(x)]
    got = gram.johansen(spark.createDataFrame(rows, "g int, ts int, a double, b double, c double"), "g", "ts", ["a", "b", "c"], 1).toPandas()
    for g, part in got.groupby("g"):
        value, trace = plain_johansen(seen[g], 1)
        part = part.sort_values("rank_null")
        assert np.allclose(part["eigenvalue"], value, atol=1e-8) and np.allclose(part["trace"], trace, rtol=1e-6, atol=1e-6)
        right += part["rank"].iloc[0] == g % 4
        # The first relation leaves a stationary mix.
        if g % 4:
            mix = seen[g] @ np.array(part["vector"].iloc[0])
            assert abs(np.corrcoef(mix[1:], mix[:-1])[0, 1]) < 0.9
    assert right >= 20


def plain_breaks(y, lags, trim, trend_break):
    z, n = np.diff(y), len(y)
    t = np.arange(n)
    rows = np.arange(lags, n - 1)
    base = np.column_stack([np.ones(len(rows)), t[rows + 1] + 1, *(z[rows - j] for j in range(1, lags + 1))])
    best = None
    m = len(rows)
    for i in range(int(np.ceil(trim * m)), int(np.floor((1 - trim) * m)) + 1):
        after = np.arange(m) >= i
        x = [base, after[:, None], *([np.where(after, np.arange(m) - (i - 1), 0)[:, None]] if trend_break else []), y[rows][:, None]]
        x = np.column_stack(x)
        b, *_ = np.linalg.lstsq(x, z[rows], rcond=None)
        e = z[rows] - x @ b
        s = b[-1] / np.sqrt(e @ e / (m - x.shape[1]) * np.linalg.inv(x.T @ x)[-1, -1])
        if best is None or s < best[0]:
            best = (s, int(rows[i - 1] + 1))
    return best


@pytest.mark.parametrize("trend_break", [False, True])
def test_zivot_andrews(spark, trend_break):
    rng, rows, made = np.random.default_rng(7), [], {}
    for g in range(6):
        y = np.cumsum(rng.normal(size=120)) if g < 3 else rng.normal(size=120) + 0.03 * np.arange(120) + 6 * (np.arange(120) >= 50)
        made[g] = y
        rows += [(g, i, float(v)) for i, v in enumerate(y)]
    got = {r.g: r for r in gram.zivot_andrews(spark.createDataFrame(rows, "g int, ts int, y double"), "g", "ts", "y", 1, 0.15, trend_break).collect()}
    for g, y in made.items():
        s, at = plain_breaks(y, 1, 0.15, trend_break)
        assert abs(got[g].statistic - s) < 1e-5 and got[g].break_at == at
    assert all(got[g].stationary for g in (3, 4, 5)) and sum(got[g].stationary for g in (0, 1, 2)) <= 1
    assert all(abs(got[g].break_at - 49) <= 1 for g in (3, 4, 5))
