"""Forecasters. Each takes a table of series and returns ``entity..., step, forecast`` for steps 1 to ``horizon``.

The closed forms are one aggregate per series and a spread over steps. Recurrences and searches run
on one series at a time in Python, all series in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names, series


def _steps(horizon: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")


def mean(df: DataFrame, entity: Names, ts: str, value: str, horizon: int) -> DataFrame:
    return df.groupBy(*names(entity)).agg(F.avg(value).alias("forecast")).select(*names(entity), _steps(horizon), "forecast")


def naive(df: DataFrame, entity: Names, ts: str, value: str, horizon: int, z: float = 1.96) -> DataFrame:
    """The last value, with an interval that widens by the root of the step."""
    d = df.withColumn("__d", F.col(value) - F.lag(value).over(series(entity, ts)))
    one = d.groupBy(*names(entity)).agg(F.max_by(value, ts).alias("forecast"), F.stddev_samp("__d").alias("__s"))
    at = one.select(*names(entity), _steps(horizon), "forecast", "__s")
    wide = z * F.col("__s") * F.sqrt("step")
    return at.withColumns({"lower": F.col("forecast") - wide, "upper": F.col("forecast") + wide}).drop("__s")


def drift(df: DataFrame, entity: Names, ts: str, value: str, horizon: int) -> DataFrame:
    one = df.groupBy(*names(entity)).agg(F.max_by(value, ts).alias("__l"), F.min_by(value, ts).alias("__f"), F.count(value).alias("__n"))
    at = one.select(*names(entity), _steps(horizon), "__l", "__f", "__n")
    return at.select(*names(entity), "step", (F.col("__l") + F.col("step") * (F.col("__l") - F.col("__f")) / (F.col("__n") - 1)).alias("forecast"))


def seasonal_naive(df: DataFrame, entity: Names, ts: str, value: str, horizon: int, season: int, z: float = 1.96) -> DataFrame:
    """The last season again and again, with an interval that widens with each."""
    keys = names(entity)
    w = series(entity, ts)
    d = df.select(*keys, value, F.row_number().over(w).alias("__i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__n"), (F.col(value) - F.lag(value, season).over(w)).alias("__d"))
    # Step h repeats place (h - 1) mod season of the last season.
    one = d.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("__i") > F.col("__n") - season, F.struct("__i", F.col(value).alias("v"))))).alias("__last"),
        F.stddev_samp("__d").alias("__s"),
    )
    at = one.select(*keys, _steps(horizon), "__last", "__s")
    f = F.col("__last")[F.pmod(F.col("step") - 1, F.lit(season))]["v"]
    wide = z * F.col("__s") * F.sqrt(1 + F.floor((F.col("step") - 1) / season))
    return at.select(*keys, "step", f.alias("forecast"), (f - wide).alias("lower"), (f + wide).alias("upper"))


def ses_level(value: str, i: str, n: str, alpha: float) -> Column:
    """Level of simple smoothing as an aggregate: weights alpha (1 - alpha)^(n - i), the first value's without alpha. ``i`` counts from 1."""
    back = F.col(n) - F.col(i)
    return F.sum(F.col(value) * F.pow(F.lit(1 - alpha), back) * F.when(F.col(i) == 1, 1.0).otherwise(alpha))


def _numbered(df: DataFrame, entity: Names, ts: str) -> DataFrame:
    return df.withColumns({"__i": F.row_number().over(series(entity, ts)), "__n": F.count(F.lit(1)).over(Window.partitionBy(*names(entity)))})


def ses(df: DataFrame, entity: Names, ts: str, value: str, horizon: int, alpha: float = 0.3) -> DataFrame:
    one = _numbered(df, entity, ts).groupBy(*names(entity)).agg(ses_level(value, "__i", "__n", alpha).alias("forecast"))
    return one.select(*names(entity), _steps(horizon), "forecast")


def theta(df: DataFrame, entity: Names, ts: str, value: str, horizon: int, alpha: float = 0.3) -> DataFrame:
    """Half the straight line's continuation, half simple smoothing."""
    n = _numbered(df, entity, ts)
    t = F.col("__i") - 1
    one = n.groupBy(*names(entity)).agg(F.regr_slope(F.col(value), t).alias("__b"), F.regr_intercept(F.col(value), t).alias("__a"), ses_level(value, "__i", "__n", alpha).alias("__l"), F.max("__n").alias("__n"))
    at = one.select(*names(entity), _steps(horizon), "__a", "__b", "__l", "__n")
    return at.select(*names(entity), "step", (0.5 * (F.col("__a") + F.col("__b") * (F.col("__n") - 1 + F.col("step"))) + 0.5 * F.col("__l")).alias("forecast"))


def demand_class(df: DataFrame, entity: Names, ts: str, value: str, zero_based: bool = False) -> DataFrame:
    """Mean interval between demands, squared variation of their sizes, and the class these give. With ``zero_based`` each interval counts one more, from a start of 0."""
    keys = names(entity)
    n = df.withColumn("__i", F.row_number().over(series(entity, ts))).where(F.col(value) > 0)
    gap = F.col("__i") - F.lag("__i", 1, 0).over(Window.partitionBy(*keys).orderBy("__i")) + (1 if zero_based else 0)
    one = n.withColumn("__g", gap).groupBy(*keys).agg(F.avg("__g").alias("adi"), F.pow(F.stddev_pop(value) / F.avg(value), 2).alias("cv2"), F.count(F.lit(1)).alias("n_demands"))
    kind = F.when((F.col("adi") < 1.32) & (F.col("cv2") < 0.49), "smooth").when(F.col("adi") < 1.32, "erratic").when(F.col("cv2") < 0.49, "intermittent").otherwise("lumpy")
    return one.withColumn("class", kind)


def tsb(df: DataFrame, entity: Names, ts: str, value: str, horizon: int, alpha: float = 0.1, beta: float = 0.1) -> DataFrame:
    """Intermittent demand: smoothed size times smoothed chance of a demand, as one aggregate.

    Both start from the first value: its size and 1, or 1 and a half where it's no demand.
    """
    keys, w = names(entity), series(entity, ts)
    hit = (F.col(value) > 0).cast("int")
    n = df.select(*keys, F.col(value).alias("__v"), hit.alias("__h"), F.row_number().over(w).alias("__i"), F.sum(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__j"))
    g = Window.partitionBy(*keys)
    n = n.withColumns({"__n": F.count(F.lit(1)).over(g), "__m": F.sum("__h").over(g)})
    first = F.max(F.when(F.col("__i") == 1, F.col("__v")))
    size = F.sum(F.when(F.col("__h") == 1, alpha * F.col("__v") * F.pow(F.lit(1 - alpha), F.col("__m") - F.col("__j"))).otherwise(0.0)) + F.pow(F.lit(1 - alpha), F.max("__m")) * F.when(first > 0, first).otherwise(1.0)
    chance = F.sum(beta * F.col("__h") * F.pow(F.lit(1 - beta), F.col("__n") - F.col("__i"))) + F.pow(F.lit(1 - beta), F.max("__n")) * F.when(first > 0, 1.0).otherwise(0.5)
    one = n.groupBy(*keys).agg((size * chance).alias("forecast"))
    return one.select(*keys, _steps(horizon), "forecast")


# ---------------------------------------------------------------- one series at a time

Fit = Callable[[np.ndarray, int], np.ndarray]


def per_series(df: DataFrame, entity: Names, ts: str, value: str, horizon: int, fit: Fit) -> DataFrame:
    """A function of (values, horizon) for each series. One that fails falls back to the last value, and ``failed`` says so."""
    keys = names(entity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, failed = pdf.sort_values(ts)[value].to_numpy(float), False
        try:
            f = np.asarray(fit(y, horizon), float)
        except (np.linalg.LinAlgError, ValueError, IndexError):
            f, failed = np.full(horizon, y[-1]), True
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * horizon for k in keys}, "step": np.arange(1, horizon + 1), "forecast": f, "failed": failed})

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{fields}, step int, forecast double, failed boolean")


def holt(alpha: float = 0.3, beta: float = 0.1, phi: float = 1.0) -> Fit:
    """Level and trend, the trend damped by ``phi``."""

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        level, trend = y[0], y[1] - y[0] if len(y) > 1 else 0.0
        for v in y[1:]:
            last = level
            level = alpha * v + (1 - alpha) * (level + phi * trend)
            trend = beta * (level - last) + (1 - beta) * phi * trend
        return level + np.cumsum(phi ** np.arange(1, h + 1)) * trend

    return fit


def _holt_winters(y: np.ndarray, h: int, m: int, a: float, b: float, g: float, multiplicative: bool) -> tuple[np.ndarray, float]:
    level, trend = y[:m].mean(), (y[m : 2 * m].mean() - y[:m].mean()) / m
    season = list(y[:m] / level if multiplicative else y[:m] - level)
    sse = 0.0
    for i, v in enumerate(y):
        s = season[i % m]
        expected = (level + trend) * s if multiplicative else level + trend + s
        sse += (v - expected) ** 2
        last = level
        level = a * (v / s if multiplicative else v - s) + (1 - a) * (level + trend)
        trend = b * (level - last) + (1 - b) * trend
        season[i % m] = g * (v / level if multiplicative else v - level) + (1 - g) * s
    steps = np.arange(1, h + 1)
    s = np.array([season[(len(y) + k - 1) % m] for k in steps])
    return ((level + steps * trend) * s if multiplicative else level + steps * trend + s), sse


def holt_winters(season: int, multiplicative: bool = False) -> Fit:
    """Additive or multiplicative seasons; smoothing weights of least squared error on a grid."""

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        if len(y) < 2 * season:
            raise ValueError("two seasons are needed")
        grid = [(a, b, g) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.01, 0.1, 0.3) for g in (0.05, 0.2, 0.5)]
        return min((_holt_winters(y, h, season, *p, multiplicative) for p in grid), key=lambda x: x[1])[0]

    return fit


def auto_smoothing(season: int) -> Fit:
    """The smoothing model of least information criterion among simple, trended, damped and seasonal ones."""

    def errors(fit: Fit, y: np.ndarray, start: int) -> float:
        e = [y[i] - fit(y[:i], 1)[0] for i in range(start, len(y))]
        return float(np.mean(np.square(e)))

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        start = max(2, len(y) // 2)
        models: list[tuple[Fit, int]] = [(lambda x, k: np.full(k, pd.Series(x).ewm(alpha=0.3, adjust=False).mean().iloc[-1]), 1), (holt(), 2), (holt(phi=0.9), 3)]
        if start >= 2 * season:
            models += [(holt_winters(season), 3 + season)]
        n = len(y) - start
        best = min(models, key=lambda m: n * np.log(errors(m[0], y, start) + 1e-12) + 2 * m[1])
        return best[0](y, h)

    return fit


def least_squares(x: np.ndarray, y: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    return np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y) if ridge else np.linalg.lstsq(x, y, rcond=None)[0]


def arima(p: int = 2, d: int = 1, q: int = 0) -> Fit:
    """Autoregression on differences; moving-average terms from the residuals of a long autoregression (two stages)."""

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        z, heads = y.astype(float), []
        for _ in range(d):
            heads.append(z[-1])
            z = np.diff(z)
        k = max(p, q, 1)
        long = min(max(p + q + 3, 5), max(1, len(z) // 4))
        e = np.zeros(len(z))
        if q:
            x = np.column_stack([np.ones(len(z) - long), *(z[long - i : len(z) - i] for i in range(1, long + 1))])
            e[long:] = z[long:] - x @ least_squares(x, z[long:])
        start = long + q if q else k
        cols = [np.ones(len(z) - start), *(z[start - i : len(z) - i] for i in range(1, p + 1)), *(e[start - i : len(z) - i] for i in range(1, q + 1))]
        x = np.column_stack(cols)
        c = least_squares(x, z[start:])
        zz, ee = list(z), list(e)
        for _ in range(h):
            zz.append(float(c @ np.array([1.0, *(zz[-i] for i in range(1, p + 1)), *(ee[-i] for i in range(1, q + 1))])))
            ee.append(0.0)
        out = np.array(zz[len(z) :])
        for last in reversed(heads):
            out = last + np.cumsum(out)
        return out

    return fit


def auto_arima(most: int = 2) -> Fit:
    """Orders of least error on a held-out tail."""

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        cut = max(8, len(y) - max(h, 4))
        tries = [(p, d, q) for p in range(most + 1) for d in (0, 1) for q in range(most + 1) if p + q]

        def error(o: tuple[int, int, int]) -> float:
            try:
                return float(np.mean((arima(*o)(y[:cut], len(y) - cut) - y[cut:]) ** 2))
            except (np.linalg.LinAlgError, ValueError, IndexError):
                return np.inf

        return arima(*min(tries, key=error))(y, h)

    return fit


def croston_tsb(alpha: float = 0.1, beta: float = 0.1) -> Fit:
    """Demand size and probability, each smoothed; the forecast is their product."""

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        known = y[y > 0]
        size, chance = (known[0] if len(known) else 0.0), float((y > 0).mean())
        for v in y:
            chance = chance + beta * ((v > 0) - chance)
            if v > 0:
                size = size + alpha * (v - size)
        return np.full(h, size * chance)

    return fit


def local_level(obs: float = 1.0, state: float = 0.1) -> Fit:
    """A local level by the Kalman filter; missing values only widen the state."""

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        known = y[~np.isnan(y)]
        level, var = known[0], known.var() + 1e-9
        scale = known.var() + 1e-9
        for v in y:
            var += state * scale
            if not np.isnan(v):
                gain = var / (var + obs * scale)
                level, var = level + gain * (v - level), (1 - gain) * var
        return np.full(h, level)

    return fit


def recursive(lag_steps: list[int], ridge: float = 1e-6) -> Fit:
    """A linear model of lags, its forecasts fed back."""

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        k = max(lag_steps)
        x = np.column_stack([np.ones(len(y) - k), *(y[k - i : len(y) - i] for i in lag_steps)])
        c, out = least_squares(x, y[k:], ridge), list(y)
        for _ in range(h):
            out.append(float(c @ np.array([1.0, *(out[-i] for i in lag_steps)])))
        return np.array(out[len(y) :])

    return fit


def direct(lag_steps: list[int], ridge: float = 1e-6, group: int = 1) -> Fit:
    """A linear model per step ahead (``group`` 1), or one for several steps at once."""

    def fit(y: np.ndarray, h: int) -> np.ndarray:
        if h % group:
            raise ValueError("the horizon isn't a multiple of the group")
        k, out = max(lag_steps), []
        now = np.array([1.0, *(y[len(y) - i] for i in lag_steps)])
        for first in range(1, h + 1, group):
            ahead = first + group - 1
            rows = range(k, len(y) - ahead + 1)
            x = np.array([[1.0, *(y[r - i] for i in lag_steps)] for r in rows])
            t = np.array([y[r + first - 1 : r + ahead] for r in rows])
            out += list(now @ np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ t))
        return np.array(out)

    return fit


def mimo(lag_steps: list[int], ridge: float = 1e-6) -> Fit:
    """One linear model whose answer is the whole horizon: all steps share the rows and the matrix."""
    return lambda y, h: direct(lag_steps, ridge, h)(y, h)


def multi_step(strategy: str, lag_steps: list[int], group: int = 1, ridge: float = 1e-6) -> Fit:
    """A linear model of lags by strategy: "recursive", "direct" (a model per step), "mimo" (one for all) or "dirmo" (one per ``group`` steps)."""
    known = {"recursive": lambda: recursive(lag_steps, ridge), "direct": lambda: direct(lag_steps, ridge), "mimo": lambda: mimo(lag_steps, ridge), "dirmo": lambda: direct(lag_steps, ridge, group)}
    if strategy not in known:
        raise ValueError(f"unknown strategy {strategy!r}")
    return known[strategy]()


#: Forecasters by name, for backtests: of (df, entity, ts, value, horizon).
REGISTRY: dict[str, Callable[..., DataFrame]] = {"mean": mean, "naive": naive, "drift": drift, "ses": ses, "theta": theta}
