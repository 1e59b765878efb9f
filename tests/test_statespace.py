"""Seasonal ARIMA and structural models on planted processes, and against plain likelihoods."""

import numpy as np
import pytest

from chronolake.operators import statespace as ss


def process(rng, n, phi, theta, burn=300):
    e, y = rng.normal(size=n + burn), np.zeros(n + burn)
    for t in range(n + burn):
        y[t] = e[t] + sum(c * y[t - i] for i, c in enumerate(phi, 1) if t >= i) + sum(c * e[t - i] for i, c in enumerate(theta, 1) if t >= i)
    return y[burn:]


def plain_likelihood(y, phi, theta):
    """The density of a normal vector with the autocovariances of the process."""
    n, m = len(y), 4_000
    psi = np.zeros(m)
    for j in range(m):
        psi[j] = (j == 0) + (theta[j - 1] if 1 <= j <= len(theta) else 0) + sum(phi[i - 1] * psi[j - i] for i in range(1, min(j, len(phi)) + 1))
    cov = np.array([psi[: m - k] @ psi[k:] for k in range(n)])
    full = cov[np.abs(np.arange(n)[:, None] - np.arange(n))]
    s2 = y @ np.linalg.solve(full, y) / n
    return -0.5 * (n * (np.log(2 * np.pi) + 1 + np.log(s2)) + np.linalg.slogdet(full)[1]), s2


@pytest.mark.parametrize(("phi", "theta"), [([0.6], [0.4]), ([0.5, -0.3], []), ([], [0.7, 0.2]), ([0.3, 0, 0, 0.4, -0.12], [0.5])])
def test_likelihood_is_exact(phi, theta):
    y = process(np.random.default_rng(len(phi)), 60, phi, theta)
    value, s2 = ss.arma_likelihood(y, np.array([phi, phi]).reshape(2, -1), np.array([theta, theta]).reshape(2, -1))
    want = plain_likelihood(y, phi, theta)
    assert np.allclose(value, want[0], atol=1e-6) and np.allclose(s2, want[1], rtol=1e-6)


def test_polynomials():
    got = ss.multiplied(np.array([[0.5]]), np.array([[0.4]]), 12)[0]
    want = np.zeros(13)
    want[0], want[11], want[12] = 0.5, 0.4, -0.2
    assert np.allclose(got, want)
    for row in ss.stable(np.random.default_rng(1).normal(size=(50, 4))):
        assert np.abs(np.roots(np.r_[1, -row])).max() < 1


@pytest.fixture(scope="module")
def planted():
    """Ten processes of orders (1,0,1)(1,0,0)12."""
    phi = ss.multiplied(np.array([[0.5]]), np.array([[0.6]]), 12)[0]
    return [10 + process(np.random.default_rng(i), 400, phi, [0.5]) for i in range(10)]


def test_coefficients_are_recovered(planted):
    models = [ss.fit_arima(y, (1, 0, 1), (1, 0, 0), 12) for y in planted]
    for name, want in (("short", 0.5), ("ma", 0.5), ("long", 0.6)):
        got = [float(getattr(m, name)[0]) for m in models]
        assert abs(np.mean(got) - want) < 0.06 and np.abs(np.array(got) - want).max() < 0.25, name
    assert all(abs(m.beta[0] - 10) < 3 and 0.8 < m.variance < 1.25 for m in models)


def test_search_finds_the_orders(planted):
    found = [ss.search_arima(y, 0, 0, 12).order[:2] for y in planted[:2]]
    assert ((1, 0, 1), (1, 0, 0)) in found
    # Where another model is chosen, its criterion is less than the planted one's.
    for y, o in zip(planted, found, strict=False):
        assert ss.fit_arima(y, *o, 12).aic <= ss.fit_arima(y, (1, 0, 1), (1, 0, 0), 12).aic + 1e-3


def test_regressors_and_forecasts():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(320, 2))
    y = x @ [3.0, -2.0] + np.cumsum(process(rng, 320, [0.5], []))
    model = ss.fit_arima(y[:300], (1, 1, 0), x=x[:300])
    assert np.allclose(model.beta, [3, -2], atol=0.2) and abs(model.short[0] - 0.5) < 0.15
    f, e = ss.forecast_arima(model, y[:300], 20, x[:300], x[300:])
    assert (np.abs(y[300:] - f) < 3 * e).all() and (np.diff(e) > 0).all()
    # One step of an autoregression by hand.
    ar = ss.fit_arima(y[:300], (1, 1, 0))
    d = np.diff(y[:300])
    assert np.isclose(ss.forecast_arima(ar, y[:300], 1)[0][0], y[299] + ar.short[0] * d[-1])


def test_seasonal_differences_repeat_a_season():
    y = np.tile(np.arange(12.0), 10) + np.repeat(np.arange(10.0), 12) + np.random.default_rng(3).normal(0, 0.01, 120)
    f, _ = ss.forecast_arima(ss.fit_arima(y, (0, 0, 0), (0, 1, 0), 12), y, 12)
    assert np.allclose(f, y[-12:])


def test_arima_table(spark):
    y = [10 + np.sin(2 * np.pi * i / 4) + 0.1 * i for i in range(60)]
    rows = [("a", i, float(v)) for i, v in enumerate(y)] + [("b", i, 1.0) for i in range(3)]
    got = ss.arima_forecasts(spark.createDataFrame(rows, "e string, t int, v double"), "e", "t", "v", 4, 1, 1, 4, 1).toPandas()
    a = got[got.e == "a"].sort_values("step")
    assert np.allclose(a.forecast, [10 + np.sin(2 * np.pi * i / 4) + 0.1 * i for i in range(60, 64)], atol=0.2) and not a.failed.any()
    assert got[got.e == "b"].failed.all() and (got[got.e == "b"].forecast == 1).all()


# ---------------------------------------------------------------- structural models


def plain_smoothing(s, y, variances):
    """Mean and spread of the states given the data, from one joint normal vector."""
    m, n = len(s.z), len(y)
    q = np.zeros((m, m))
    q[s.free, s.free] = variances[1:]
    start = np.eye(m) * 1e6 * np.nanvar(y)
    known = np.isfinite(y)
    mean = np.zeros(m)
    mean[0] = y[known][0]
    power, cov, means = [np.eye(m)], np.zeros((n, n)), np.zeros(n)
    for _ in range(n):
        power.append(s.t @ power[-1])
    states = [start]
    for _ in range(1, n):
        states.append(s.t @ states[-1] @ s.t.T + q)
    for i in range(n):
        means[i] = s.z @ power[i] @ mean
        for j in range(i, n):
            cov[i, j] = cov[j, i] = s.z @ power[j - i] @ states[i] @ s.z
    k = cov[np.ix_(known, known)] + variances[0] * np.eye(known.sum())
    gain = np.linalg.solve(k, cov[known]).T
    return means + gain @ (y[known] - means[known]), np.sqrt(np.maximum(np.diag(cov - gain @ cov[known]), 0))


@pytest.mark.parametrize(("trend", "season"), [(False, 0), (True, 0), (True, 4)])
def test_smoothing_is_the_conditional_mean(trend, season):
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(size=40)) + 3 * np.sin(np.arange(40) * np.pi / 2)
    y[[5, 6, 7, 20, 39]] = np.nan
    s = ss.structure(trend, season)
    v = np.r_[1.0, np.full(len(s.free), 0.3)]
    got, want = ss.smoothed(s, y, v), plain_smoothing(s, y, v)
    assert np.allclose(got[0], want[0], atol=2e-3) and np.allclose(got[1], want[1], atol=2e-2)


def test_gaps_are_filled_better_than_by_lines(spark):
    rng, rows, truth = np.random.default_rng(5), [], {}
    for g in range(4):
        y = 20 + 0.3 * np.arange(120) + 6 * np.sin(2 * np.pi * np.arange(120) / 12) + np.cumsum(rng.normal(0, 0.3, 120)) + rng.normal(0, 0.5, 120)
        gap = rng.random(120) < 0.25
        gap[[0, 119]] = False
        gap[40:47] = True
        truth[g] = (y, gap)
        rows += [(g, i, None if gap[i] else float(v)) for i, v in enumerate(y)]
    got = ss.structural_fill(spark.createDataFrame(rows, "g int, t int, v double"), "g", "t", "v", True, 12).toPandas().sort_values(["g", "t"])
    for g, (y, gap) in truth.items():
        part = got[got.g == g]
        line = np.interp(np.arange(120), np.flatnonzero(~gap), y[~gap])
        filled = part.filled.to_numpy()
        assert np.array_equal(filled[~gap], y[~gap]) and (part["std"].to_numpy()[gap] > 0).all()
        assert np.abs(filled - y)[gap].mean() < 0.5 * np.abs(line - y)[gap].mean()
    few = ss.structural_fill(spark.createDataFrame([("a", 1, 1.0), ("a", 2, None)], "g string, t int, v double"), "g", "t", "v").toPandas()
    assert few.failed.all()


def test_structural_forecast():
    y = 5 + 0.5 * np.arange(96) + 4 * np.tile([1, -1, 2, -2], 24) + np.random.default_rng(6).normal(0, 0.2, 96)
    f = ss.structural(True, 4)(y, 8)
    assert np.abs(f - (5 + 0.5 * np.arange(96, 104) + 4 * np.tile([1, -1, 2, -2], 2))).max() < 1.5
