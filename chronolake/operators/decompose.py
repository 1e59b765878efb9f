"""Trend, season and rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names, series


def centred_mean(value: str, entity: Names, ts: Names, period: int) -> Column:
    """Centred moving average over a whole period, the two ends of an even one at half weight; null near the ends."""
    w, h = series(entity, ts), period // 2
    wide = w.rowsBetween(-h, h)
    if period % 2:
        return F.when(F.count(value).over(wide) == period, F.avg(value).over(wide))
    both = (F.avg(value).over(w.rowsBetween(-h, h - 1)) + F.avg(value).over(w.rowsBetween(-h + 1, h))) / 2
    return F.when(F.count(value).over(wide) == period + 1, both)


def classical(df: DataFrame, entity: Names, ts: str, value: str, period: int, multiplicative: bool = False) -> DataFrame:
    """Adds ``trend``, ``seasonal``, ``resid``. Seasons average to 0 (or 1). Rows are numbered from 0 in each entity."""
    keys = names(entity)
    v = F.col(value)
    d = df.withColumn("trend", centred_mean(value, entity, ts, period)).withColumn("__s", F.pmod(F.row_number().over(series(entity, ts)) - 1, F.lit(period)))
    apart = v / F.col("trend") if multiplicative else v - F.col("trend")
    d = d.withColumn("__d", apart)
    means = d.groupBy(*keys, "__s").agg(F.avg("__d").alias("__raw"))
    level = F.avg("__raw").over(Window.partitionBy(*keys))
    means = means.select(*keys, "__s", (F.col("__raw") / level if multiplicative else F.col("__raw") - level).alias("seasonal"))
    out = d.join(means, [*keys, "__s"])
    rest = v / F.col("trend") / F.col("seasonal") if multiplicative else v - F.col("trend") - F.col("seasonal")
    return out.withColumn("resid", rest).drop("__s", "__d")


def strength(df: DataFrame, entity: Names) -> DataFrame:
    """Strength of trend and season of an additive decomposition, from 0 to 1."""
    r, t, s = F.col("resid"), F.col("trend"), F.col("seasonal")

    def of(c: Column) -> Column:
        return F.greatest(F.lit(0.0), 1 - F.var_samp(r) / F.var_samp(F.when(r.isNotNull(), c + r)))

    return df.groupBy(*names(entity)).agg(of(t).alias("trend_strength"), of(s).alias("seasonal_strength"))


def loess(y: np.ndarray, span: int, weights: np.ndarray | None = None, beyond: int = 0) -> np.ndarray:
    """Local linear fits with tricube weights over the ``span`` nearest places; missing places are estimated too, and ``beyond`` places before and after."""
    n = len(y)
    known = np.flatnonzero(~np.isnan(y))
    w0 = np.ones(n) if weights is None else weights
    out = np.empty(n + 2 * beyond)
    for i in range(-beyond, n + beyond):
        far = np.abs(known - i)
        near = known[np.argsort(far, kind="stable")[: min(span, len(known))]]
        reach = max(np.abs(near - i).max(), 1) * max(1.0, span / len(near))
        w = (1 - np.minimum(np.abs(near - i) / (reach + 1e-9), 1) ** 3) ** 3 * w0[near]
        if w.sum() < 1e-12:
            w = np.ones(len(near))
        x = near - np.average(near, weights=w)
        s = (w * x * x).sum()
        b = (w * x * y[near]).sum() / s if s > 1e-12 else 0.0
        out[i + beyond] = np.average(y[near], weights=w) + b * (i - np.average(near, weights=w))
    return out


def stl_arrays(y: np.ndarray, period: int, seasonal: int = 7, robust: bool = True, inner: int = 2, outer: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and rest by repeated local fits (Cleveland and others 1990).

    Each place of the cycle is smoothed over the cycles and carried one cycle beyond both ends; what running means of one
    cycle (twice) and of three rows and a local fit leave of that is trend, and taken out of the season. Series of less than
    two cycles have no season.
    """
    n = len(y)
    trend, season, w = np.zeros(n), np.zeros(n), np.ones(n)
    span = int(np.ceil(1.5 * period / (1 - 1.5 / max(seasonal, 2))) // 2 * 2 + 1)
    if n < 2 * period:
        trend = loess(y, span)
        return trend, season, y - trend
    for _ in range(outer if robust else 1):
        for _ in range(inner):
            d = y - trend
            cycle = np.empty(n + 2 * period)
            for k in range(period):
                cycle[k::period] = loess(d[k::period], seasonal, w[k::period], 1)
            low = cycle
            for size in (period, period, 3):
                low = np.convolve(low, np.full(size, 1 / size), "valid")
            season = cycle[period : period + n] - loess(low, period + 1 - period % 2)
            trend = loess(y - season, span, w)
        rest = y - trend - season
        h = 6 * np.nanmedian(np.abs(rest))
        w = np.where(np.isnan(rest), 1.0, (1 - np.minimum(np.abs(rest) / max(h, 1e-12), 1) ** 2) ** 2)
    return trend, season, y - trend - season


def stl(df: DataFrame, entity: Names, ts: str, value: str, period: int, seasonal: int = 7, robust: bool = True) -> DataFrame:
    """Adds ``trend``, ``seasonal``, ``resid`` by local fits, one entity at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        t, s, r = stl_arrays(pdf[value].to_numpy(float), period, seasonal, robust)
        return pdf.assign(trend=t, seasonal=s, resid=r)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*names(entity)).applyInPandas(run, f"{fields}, trend double, seasonal double, resid double")


def stl_filled(y: np.ndarray, period: int, rounds: int = 5) -> np.ndarray:
    """Missing values by trend plus season, from a straight line between neighbours, renewed ``rounds`` times. Without any value all stay missing."""
    gone = np.isnan(y)
    out = pd.Series(y).interpolate(method="linear").ffill().bfill().to_numpy(copy=True)
    if gone.all():
        return out
    for _ in range(rounds if gone.any() else 0):
        trend, season, _ = stl_arrays(out, period)
        out[gone] = (trend + season)[gone]
    return out


def stl_outliers(df: DataFrame, entity: Names, ts: str, value: str, period: int, most: float = 3.0) -> DataFrame:
    """Adds ``robust_z`` of the rest by local fits (0.6745 deviations from its median over their median) and ``outlier``."""
    fit = stl(df, entity, ts, value, period)
    middle = fit.join(fit.groupBy(*names(entity)).agg(F.median("resid").alias("__m")), names(entity))
    spread = middle.groupBy(*names(entity)).agg(F.median(F.abs(F.col("resid") - F.col("__m"))).alias("__s"))
    z = 0.6745 * (F.col("resid") - F.col("__m")) / (F.col("__s") + 1e-8)
    return middle.join(spread, names(entity)).withColumn("robust_z", z).withColumn("outlier", F.abs("robust_z") > most).drop("__m", "__s")


def mstl(df: DataFrame, entity: Names, ts: str, value: str, periods: list[int], rounds: int = 2) -> DataFrame:
    """Several periods in turn, shortest first: ``trend``, ``seasonal_<period>``, ``resid``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        y = pdf[value].to_numpy(float)
        seasons = {p: np.zeros(len(y)) for p in sorted(periods)}
        trend = np.zeros(len(y))
        for _ in range(rounds):
            for p in seasons:
                other = sum(s for q, s in seasons.items() if q != p)
                trend, seasons[p], _ = stl_arrays(y - other, p, robust=False)
        rest = y - trend - sum(seasons.values())
        return pdf.assign(trend=trend, **{f"seasonal_{p}": s for p, s in seasons.items()}, resid=rest)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    extra = ", ".join(f"seasonal_{p} double" for p in sorted(periods))
    return df.groupBy(*names(entity)).applyInPandas(run, f"{fields}, trend double, {extra}, resid double")
