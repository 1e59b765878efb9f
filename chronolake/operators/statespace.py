"""State-space models of single series: seasonal ARIMA with regressors, structural models, smoothing of gaps.

Likelihoods are exact (Kalman recursion from the stationary or diffuse start) and taken for a batch of parameter sets at once, so a
gradient or a line search costs one pass over the series. Series are fitted one by one, all in parallel (see ``forecast.per_series``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chronolake.functions.windows import Names, names

LOG_2PI = float(np.log(2 * np.pi))


# ---------------------------------------------------------------- optimiser


def minimise(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int = 60, step: float = 1e-5) -> tuple[np.ndarray, float]:
    """Quasi-Newton descent on a function of a batch of points (rows): central differences and all steps of a line search in one call each."""
    x, k = np.asarray(start, float), len(start)
    if not k:
        return x, float(f(x[None])[0])
    inverse, value, slope = np.eye(k), float(f(x[None])[0]), None
    for _ in range(rounds):
        if slope is None:
            around = f(np.concatenate([x + step * np.eye(k), x - step * np.eye(k)]))
            slope = (around[:k] - around[k:]) / (2 * step)
        way = -inverse @ slope
        if slope @ way >= 0:
            inverse, way = np.eye(k), -slope
        lengths = np.minimum(1.0, 2.0 / max(np.abs(way).max(), 1e-12)) * 0.5 ** np.arange(10)
        tried = f(x + lengths[:, None] * way)
        best = int(np.nanargmin(np.where(np.isfinite(tried), tried, np.inf)))
        if not tried[best] < value - 1e-9 * max(1.0, abs(value)):
            break
        moved = lengths[best] * way
        x, value = x + moved, float(tried[best])
        around = f(np.concatenate([x + step * np.eye(k), x - step * np.eye(k)]))
        new = (around[:k] - around[k:]) / (2 * step)
        turn = new - slope
        curve = moved @ turn
        if curve > 1e-12:
            left = np.eye(k) - np.outer(moved, turn) / curve
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / curve
        slope = new
    return x, value


# ---------------------------------------------------------------- seasonal ARIMA


def stable(x: np.ndarray) -> np.ndarray:
    """Coefficients (rows) of a stationary autoregression from any numbers, which become partial autocorrelations."""
    r = np.tanh(x)
    out = np.zeros_like(r)
    for k in range(r.shape[1]):
        out[:, :k], out[:, k] = out[:, :k] - r[:, k : k + 1] * out[:, :k][:, ::-1], r[:, k]
    return out


def multiplied(short: np.ndarray, long: np.ndarray, season: int) -> np.ndarray:
    """Coefficients of (1 - short)(1 - long at the season), as those of lags 1, 2, ...: rows of a batch."""
    n, p, q = len(short), short.shape[1], long.shape[1]
    a, b = np.zeros((n, p + 1)), np.zeros((n, q * season + 1))
    a[:, 0] = b[:, 0] = 1
    a[:, 1:] = -short
    b[:, season * np.arange(1, q + 1)] = -long
    out = np.zeros((n, p + q * season + 1))
    for i in range(p + 1):
        out[:, i : i + b.shape[1]] += a[:, i : i + 1] * b
    return -out[:, 1:]


def _system(phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions, noise loadings and stationary covariances of ARMA models (rows of coefficients)."""
    n, m = len(phi), max(phi.shape[1], theta.shape[1] + 1, 1)
    t, r = np.zeros((n, m, m)), np.zeros((n, m))
    t[:, : phi.shape[1], 0] = phi
    t[:, np.arange(m - 1), np.arange(1, m)] = 1
    r[:, 0], r[:, 1 : theta.shape[1] + 1] = 1, theta
    # Doubling: the sum of T^k Q T'^k, twice as many terms each time.
    q, a = r[:, :, None] * r[:, None, :], t
    for _ in range(40):
        new = q + a @ q @ a.transpose(0, 2, 1)
        a = a @ a
        done = np.abs(new - q).max() <= 1e-12 * max(np.abs(new).max(), 1.0)
        q = new
        if done or not np.isfinite(q).all():
            break
    return t, r, q


def arma_likelihood(y: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood (noise variance at its best) and that variance, for each row of coefficients; ``y`` has a row for each, or one for all. Missing values are stepped over."""
    t, r, p = _system(phi, theta)
    rr, n, y = r[:, :, None] * r[:, None, :], len(phi), np.atleast_2d(y)
    a, known = np.zeros((n, t.shape[1])), np.isfinite(y[0])
    squares, logs = np.zeros(n), np.zeros(n)
    for i in range(y.shape[1]):
        if known[i]:
            f = np.maximum(p[:, 0, 0], 1e-12)
            v, gain = y[:, i] - a[:, 0], p[:, :, 0] / f[:, None]
            squares += v * v / f
            logs += np.log(f)
            a = a + gain * v[:, None]
            p = p - gain[:, :, None] * p[:, :1, :]
        a = np.einsum("nij,nj->ni", t, a)
        p = t @ p @ t.transpose(0, 2, 1) + rr
    m = int(known.sum())
    s2 = np.maximum(squares / m, 1e-300)
    out = -0.5 * (m * (LOG_2PI + 1 + np.log(s2)) + logs)
    return np.where(np.isfinite(out), out, -1e300), s2


@dataclass
class Arima:
    """A fitted model. order: (p, d, q), (P, D, Q), season. phi and theta: coefficients of all lags, seasons multiplied in."""

    order: tuple[tuple[int, int, int], tuple[int, int, int], int]
    short: np.ndarray
    long: np.ndarray
    ma: np.ndarray
    season_ma: np.ndarray
    beta: np.ndarray
    variance: float
    likelihood: float
    count: int

    @property
    def aic(self) -> float:
        return 2 * self.count - 2 * self.likelihood

    @property
    def phi(self) -> np.ndarray:
        return multiplied(self.short[None], self.long[None], self.order[2])[0]

    @property
    def theta(self) -> np.ndarray:
        return -multiplied(-self.ma[None], -self.season_ma[None], self.order[2])[0]


def differenced(y: np.ndarray, d: int, big: int, season: int) -> np.ndarray:
    for _ in range(big):
        y = y[season:] - y[:-season]
    for _ in range(d):
        y = y[1:] - y[:-1]
    return y


def fit_arima(y: np.ndarray, order: tuple[int, int, int], seasonal: tuple[int, int, int] = (0, 0, 0), season: int = 1, x: np.ndarray | None = None, rounds: int = 60) -> Arima:
    """Greatest exact likelihood. ``x`` has a row of regressors for each value; without differences a constant is one of them."""
    (p, d, q), (sp, sd, sq) = order, seasonal
    z = differenced(np.asarray(y, float), d, sd, season)
    regressors = np.zeros((len(y), 0)) if x is None else np.asarray(x, float).reshape(len(y), -1)
    w = np.column_stack([np.ones(len(z)), differenced(regressors, d, sd, season)] if not d + sd else [differenced(regressors, d, sd, season)])
    k = w.shape[1]
    known = np.isfinite(z)
    if known.sum() < p + q + sp + sq + k + 2:
        raise ValueError("too few values")
    scale = max(float(z[known].std()), 1e-12)
    beta = np.linalg.lstsq(w[known], z[known], rcond=None)[0] if k else np.zeros(0)
    spread = np.maximum(w[known].std(0), np.abs(w[known]).mean(0)) if k else np.ones(0)
    unit = scale / np.maximum(spread, 1e-12)

    def parts(v: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b, c, e, f = np.split(v, np.cumsum([p, sp, q, sq]), axis=1)
        return stable(a), stable(b), -stable(c), -stable(e), beta + f * unit

    def loss(v: np.ndarray) -> np.ndarray:
        a, b, c, e, f = parts(v)
        rest = z[None] - f @ w.T if k else z[None]
        return -arma_likelihood(rest, multiplied(a, b, season), -multiplied(-c, -e, season))[0] / len(z)

    best, _ = min((minimise(loss, np.r_[np.full(p + sp, s), np.full(q + sq, 0.05), np.zeros(k)], rounds) for s in ((0.1, 0.6) if p + sp else (0.1,))), key=lambda b: b[1])
    a, b, c, e, f = parts(best[None])
    rest = z[None] - f @ w.T if k else z[None]
    value, s2 = arma_likelihood(rest, multiplied(a, b, season), -multiplied(-c, -e, season))
    return Arima((order, seasonal, season), a[0], b[0], c[0], e[0], f[0], float(s2[0]), float(value[0]), p + q + sp + sq + k + 1)


def forecast_arima(model: Arima, y: np.ndarray, horizon: int, x: np.ndarray | None = None, ahead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts and their standard errors; ``ahead`` has the regressors of the steps to come."""
    (_, d, _), (_, sd, _), season = model.order
    y = np.asarray(y, float)
    k = len(model.beta) - (not d + sd)
    past, future = (np.zeros((n, 0)) if v is None else np.asarray(v, float).reshape(n, -1) for v, n in ((x, len(y)), (ahead, horizon)))
    base = y - past @ model.beta[len(model.beta) - k :] - (model.beta[0] if not d + sd else 0.0)
    z = differenced(base, d, sd, season)
    t, r, p = (v[0] for v in _system(model.phi[None], model.theta[None]))
    a, rr = np.zeros(len(r)), np.outer(r, r)
    for v in z:
        if np.isfinite(v):
            gain = p[:, 0] / max(p[0, 0], 1e-12)
            a, p = a + gain * (v - a[0]), p - np.outer(gain, p[0])
        a, p = t @ a, t @ p @ t.T + rr
    steps = []
    for _ in range(horizon):
        steps.append(a[0])
        a = t @ a
    # Differences are undone by the product of their polynomials, for values and for the weights of the shocks.
    poly = np.ones(1)
    for lag in [1] * d + [season] * sd:
        factor = np.zeros(lag + 1)
        factor[0], factor[-1] = 1, -1
        poly = np.convolve(poly, factor)
    out = list(base)
    for s in steps:
        out.append(s - sum(c * out[-i] for i, c in enumerate(poly[1:], 1)))
    full, psi = np.convolve(np.r_[1, -model.phi], poly), np.zeros(horizon)
    for j in range(horizon):
        psi[j] = (1.0 if j == 0 else (model.theta[j - 1] if j <= len(model.theta) else 0.0)) - sum(full[i] * psi[j - i] for i in range(1, min(j, len(full) - 1) + 1))
    level = np.array(out[len(base) :]) + (model.beta[0] if not d + sd else 0.0) + future @ model.beta[len(model.beta) - k :]
    return level, np.sqrt(model.variance * np.cumsum(psi**2))


def search_arima(y: np.ndarray, d: int, big: int, season: int, most: int = 2, most_season: int = 1, x: np.ndarray | None = None) -> Arima:
    """Stepwise search for the orders of least information criterion: from four simple models, one order more or less at a time."""
    tried: dict[tuple[int, int, int, int], Arima | None] = {}

    def of(o: tuple[int, int, int, int]) -> float:
        p, q, sp, sq = o
        if o not in tried:
            if not (0 <= p <= most and 0 <= q <= most and 0 <= sp <= most_season and 0 <= sq <= most_season) or (season == 1 and sp + sq):
                tried[o] = None
            else:
                try:
                    tried[o] = fit_arima(y, (p, d, q), (sp, big, sq), season, x, 30)
                except (ValueError, np.linalg.LinAlgError):
                    tried[o] = None
        return tried[o].aic if tried[o] else np.inf

    s = int(season > 1)
    best = min([(0, 0, 0, 0), (1, 0, s, 0), (0, 1, 0, s), (1, 1, s, 0)], key=of)
    while True:
        near = [tuple(np.add(best, m)) for m in product((-1, 0, 1), repeat=4) if 0 < sum(map(abs, m)) <= 2]
        new = tuple(map(int, min([best, *near], key=of)))
        if new == best or not of(new) < of(best) - 1e-6:
            break
        best = new
    if not tried.get(best):
        raise ValueError("no model can be fitted")
    return fit_arima(y, (best[0], d, best[1]), (best[2], big, best[3]), season, x)


def arima_forecasts(df: DataFrame, entity: Names, ts: str, value: str, horizon: int, d: int = 1, big: int = 1, season: int = 12, most: int = 2) -> DataFrame:
    """The searched model's forecasts of each series: ``entity``, ``step``, ``forecast``, ``lower``, ``upper`` (95 %), ``orders``, ``aic``, ``failed`` (then the last value goes on)."""
    keys = names(entity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(ts)[value].to_numpy(float)
        try:
            model = search_arima(y, d, big, season, most)
            f, e = forecast_arima(model, y, horizon)
            (a, b, _), told, aic, failed = model.order, "", model.aic, False
            told = f"{a}{b}{season}"
        except (ValueError, np.linalg.LinAlgError):
            f, e, told, aic, failed = np.full(horizon, y[-1]), np.full(horizon, np.nan), None, None, True
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * horizon for k in keys}, "step": np.arange(1, horizon + 1), "forecast": f, "lower": f - 1.96 * e, "upper": f + 1.96 * e, "orders": told, "aic": aic, "failed": failed})

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{fields}, step int, forecast double, lower double, upper double, orders string, aic double, failed boolean")


# ---------------------------------------------------------------- structural models


@dataclass
class Structure:
    """Level, trend and season as states. z: what is seen of the state; t: transition; free: which states have noise of their own."""

    z: np.ndarray
    t: np.ndarray
    free: list[int]


def structure(trend: bool = True, season: int = 0) -> Structure:
    """A level that wanders, a slope that wanders, and dummy seasons that change slowly."""
    m = 1 + trend + (season - 1 if season else 0)
    t, z, free = np.zeros((m, m)), np.zeros(m), [0]
    t[0, 0] = z[0] = 1
    if trend:
        t[0, 1] = t[1, 1] = 1
        free.append(1)
    if season:
        at = 1 + trend
        t[at, at:] = -1
        t[np.arange(at + 1, m), np.arange(at, m - 1)] = 1
        z[at] = 1
        free.append(at)
    return Structure(z, t, free)


def _filter(s: Structure, y: np.ndarray, variances: np.ndarray, keep: bool = False) -> tuple:
    """Log likelihoods of rows of variances (observation, then free states), the first values of a diffuse start left out; with ``keep``, the states of the first row."""
    n, m = len(variances), len(s.z)
    known = np.isfinite(y)
    scale = max(float(np.nanvar(y)), 1e-12)
    q = np.zeros((n, m, m))
    q[:, s.free, s.free] = variances[:, 1:]
    a, p = np.zeros((n, m)), np.broadcast_to(np.eye(m) * 1e6 * scale, (n, m, m)).copy()
    a[:, 0] = y[known][0]
    value, seen, states = np.zeros(n), 0, []
    for i, v in enumerate(y):
        before = (a[0].copy(), p[0].copy())
        if known[i]:
            pz = p @ s.z
            f = pz @ s.z + variances[:, 0]
            e = v - a @ s.z
            gain = pz / f[:, None]
            a, p = a + gain * e[:, None], p - gain[:, :, None] * pz[:, None, :]
            seen += 1
            if seen > m:
                value -= 0.5 * (LOG_2PI + np.log(f) + e * e / f)
        if keep:
            states.append((*before, a[0].copy(), p[0].copy()))
        a, p = a @ s.t.T, s.t @ p @ s.t.T + q
    return (value, states, a[0], p[0], q[0]) if keep else (value,)


def fit_structure(s: Structure, y: np.ndarray) -> np.ndarray:
    """Variances of greatest likelihood: of the observation and of each free state."""
    known = y[np.isfinite(y)]
    if len(known) < len(s.z) + 3:
        raise ValueError("too few values")
    scale = max(float(np.var(known)), 1e-12)
    loss = lambda v: -_filter(s, y, scale * np.exp(np.clip(v, -25, 6)))[0] / len(known)
    starts = [np.r_[-1.0, np.full(len(s.free), -3.0)], np.r_[-3.0, -1.0, np.full(len(s.free) - 1, -6.0)]]
    best, _ = min((minimise(loss, x) for x in starts), key=lambda b: b[1])
    return scale * np.exp(np.clip(best, -25, 6))


def smoothed(s: Structure, y: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The series as its states explain it, from all values before and after, and its standard error (Rauch, Tung and Striebel's recursion)."""
    _, states, _, _, _ = _filter(s, y, variances[None], True)
    a, p = states[-1][2], states[-1][3]
    out, spread = np.zeros(len(y)), np.zeros(len(y))
    out[-1], spread[-1] = a @ s.z, s.z @ p @ s.z
    for i in range(len(y) - 2, -1, -1):
        _, _, now, cov = states[i]
        next_a, next_p = states[i + 1][0], states[i + 1][1]
        j = np.linalg.solve(next_p + 1e-12 * np.trace(next_p) / len(next_p) * np.eye(len(next_p)), s.t @ cov).T
        a = now + j @ (a - next_a)
        p = cov + j @ (p - next_p) @ j.T
        out[i], spread[i] = a @ s.z, s.z @ p @ s.z
    return out, np.sqrt(np.maximum(spread, 0.0))


def structural_fill(df: DataFrame, entity: Names, ts: str, value: str, trend: bool = True, season: int = 0) -> DataFrame:
    """Missing values by the smoothed states: all rows with ``filled``, ``std`` (0 where the value was known) and ``failed`` (too few values: nothing is filled)."""
    keys = names(entity)
    s = structure(trend, season)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        y = pdf[value].to_numpy(float)
        gap, failed = ~np.isfinite(y), False
        filled, std = y.copy(), np.zeros(len(y))
        try:
            if gap.any():
                level, spread = smoothed(s, y, fit_structure(s, y))
                filled[gap], std[gap] = level[gap], spread[gap]
        except (ValueError, np.linalg.LinAlgError):
            std[gap], failed = np.nan, True
        return pd.DataFrame({**{k: pdf[k] for k in [*keys, ts]}, "filled": filled, "std": std, "failed": failed})

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*keys, ts])
    return df.groupBy(*keys).applyInPandas(run, f"{fields}, filled double, std double, failed boolean")


def structural(trend: bool = True, season: int = 0) -> Callable[[np.ndarray, int], np.ndarray]:
    """A forecaster for ``forecast.per_series``: states at the end, carried on. Missing values are allowed."""

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        s = structure(trend, season)
        _, _, a, _, _ = _filter(s, y, fit_structure(s, y)[None], True)
        out = []
        for _ in range(h):
            out.append(a @ s.z)
            a = s.t @ a
        return np.array(out)

    return fit


def level_smoothing(y: np.ndarray, obs: float, state: float) -> np.ndarray:
    """A local level of known variances, smoothed; it starts at the first value with the observation's variance. Missing values are filled."""
    a, p, kept = y[np.isfinite(y)][0], obs, []
    for i, v in enumerate(y):
        if i:
            p += state
        before = (a, p)
        if i and np.isfinite(v):
            gain = p / (p + obs)
            a, p = a + gain * (v - a), (1 - gain) * p
        kept.append((*before, a, p))
    out = [kept[-1][2]]
    for i in range(len(y) - 2, -1, -1):
        out.append(kept[i][2] + kept[i][3] / kept[i + 1][1] * (out[-1] - kept[i + 1][0]))
    return np.array(out[::-1])
