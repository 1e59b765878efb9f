"""Quantile and interval forecasts: scores, conformal intervals, coverage."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.scalars import normal_cdf, normal_pdf
from chronolake.functions.windows import Names, names, series


def pinball(y: Column, q: Column, tau: Column) -> Column:
    e = y - q
    return F.when(e >= 0, tau * e).otherwise((tau - 1) * e)


def rearranged(df: DataFrame, row: Names, tau: str, q: str) -> DataFrame:
    """Quantiles made to rise with their level."""
    w = Window.partitionBy(*names(row)).orderBy(tau).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(q, F.max(q).over(w))


def covered(y: str, lower: str, upper: str) -> Column:
    return F.col(y).between(F.col(lower), F.col(upper)).cast("double")


def interval_score(y: str, lower: str, upper: str, alpha: float) -> Column:
    a, lo, hi = F.col(y), F.col(lower), F.col(upper)
    miss = F.when(a < lo, lo - a).when(a > hi, a - hi).otherwise(0.0)
    return hi - lo + 2 / alpha * miss


def interval_report(df: DataFrame, by: Names, y: str, lower: str, upper: str, alpha: float) -> DataFrame:
    wide = F.col(upper) - F.col(lower)
    return df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(covered(y, lower, upper)).alias("coverage"),
        F.avg(wide).alias("mean_width"),
        F.percentile(wide, 0.5).alias("median_width"),
        F.stddev_pop(wide).alias("std_width"),
        F.avg(interval_score(y, lower, upper, alpha)).alias("winkler"),
    )


def reliability(df: DataFrame, tau: str, y: str, q: str) -> DataFrame:
    """Share of values at or below each quantile, beside its level."""
    return df.groupBy(tau).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) <= F.col(q)).cast("double")).alias("empirical"), F.avg(pinball(F.col(y), F.col(q), F.col(tau))).alias("pinball"))


def crps_normal(y: Column, mu: Column, sigma: Column) -> Column:
    z = (y - mu) / sigma
    return sigma * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def crps_quantiles(df: DataFrame, row: Names, tau: str, y: str, q: str) -> DataFrame:
    """Twice the pinball loss, weighted by half the distance of the levels beside each."""
    w = Window.partitionBy(*names(row)).orderBy(tau)
    weight = (F.coalesce(F.lead(tau).over(w), F.lit(1.0)) - F.coalesce(F.lag(tau).over(w), F.lit(0.0))) / 2
    part = df.select(*names(row), (2 * weight * pinball(F.col(y), F.col(q), F.col(tau))).alias("__p"))
    return part.groupBy(*names(row)).agg(F.sum("__p").alias("crps"))


def crps_samples(df: DataFrame, row: Names, y: str, x: str) -> DataFrame:
    """From samples: mean distance from the value less half the mean distance of samples, the latter from their ranks instead of all pairs."""
    keys = names(row)
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(x))
    d = df.select(*keys, y, x, r.alias("__r"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__n"))
    spread = F.sum((2 * F.col("__r") - F.col("__n") - 1) * F.col(x)) / F.pow(F.max("__n"), 2)
    return d.groupBy(*keys).agg((F.avg(F.abs(F.col(x) - F.col(y))) - spread).alias("crps"))


def conformal_level(n: int, alpha: float) -> float:
    return min(1.0, math.ceil((1 - alpha) * (n + 1)) / n) if n else 1.0


def conformal_width(scores: DataFrame, by: Names, score: str, alpha: float) -> DataFrame:
    """The quantile of calibration scores that covers a new one: level ceil((1 - alpha)(n + 1)) / n, interpolated linearly.

    The level depends on each group's size, so the quantile is read from ranks: no list of scores is made.
    """
    keys = names(by)
    w, g = Window.partitionBy(*keys).orderBy(score), Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(g)
    ranked = scores.select(*keys, F.col(score).alias("s"), (F.row_number().over(w) - 1).alias("r"), n.alias("n"))
    at = F.least(F.lit(1.0), F.ceil((1 - alpha) * (F.col("n") + 1)) / F.col("n")) * (F.col("n") - 1)
    placed = ranked.withColumn("at", at).withColumn("part", F.col("at") - F.floor("at"))
    weight = F.when(F.col("r") == F.floor("at"), 1 - F.col("part")).when(F.col("r") == F.floor("at") + 1, F.col("part"))
    return placed.withColumn("w", weight).groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.col("w") * F.col("s")).alias("width"))


def conformal(calibration: DataFrame, test: DataFrame, by: Names, y: str, f: str, alpha: float) -> DataFrame:
    """Intervals of equal width around the forecasts of ``test``, from absolute residuals of ``calibration``."""
    width = conformal_width(calibration.withColumn("__s", F.abs(F.col(y) - F.col(f))), by, "__s", alpha)
    return test.join(width.drop("n"), names(by)).withColumns({"lower": F.col(f) - F.col("width"), "upper": F.col(f) + F.col("width")})


def conformal_quantiles(calibration: DataFrame, test: DataFrame, by: Names, y: str, lower: str, upper: str, alpha: float) -> DataFrame:
    """Quantile intervals widened (or narrowed) by what calibration rows missed them by."""
    score = F.greatest(F.col(lower) - F.col(y), F.col(y) - F.col(upper))
    width = conformal_width(calibration.withColumn("__s", score), by, "__s", alpha)
    return test.join(width.drop("n"), names(by)).withColumns({"cqr_lower": F.col(lower) - F.col("width"), "cqr_upper": F.col(upper) + F.col("width")})


def sliding_conformal(df: DataFrame, entity: Names, ts: str, y: str, f: str, size: int, alpha: float) -> DataFrame:
    """Intervals from the last ``size`` absolute residuals, once there are that many."""
    w = series(entity, ts).rowsBetween(-size, -1)
    s = F.abs(F.col(y) - F.col(f))
    d = df.withColumn("__s", s)
    width = F.when(F.count("__s").over(w) == size, F.percentile("__s", conformal_level(size, alpha)).over(w))
    return d.withColumn("width", width).drop("__s").withColumns({"lower": F.col(f) - F.col("width"), "upper": F.col(f) + F.col("width")})


def adaptive_conformal(df: DataFrame, entity: Names, ts: str, y: str, f: str, alpha: float = 0.1, gamma: float = 0.01, start: int = 20) -> DataFrame:
    """Miscoverage steers the level: alpha rises after a hit and falls after a miss. One series at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        s = (pdf[y] - pdf[f]).abs().to_numpy()
        a, widths, levels = alpha, np.full(len(s), np.nan), np.full(len(s), np.nan)
        for i in range(start, len(s)):
            widths[i], levels[i] = np.quantile(s[:i], min(1.0, max(0.0, 1 - a))), a
            a = min(0.99, max(0.01, a + gamma * (alpha - float(s[i] > widths[i]))))
        return pdf.assign(alpha_t=levels, lower=pdf[f] - widths, upper=pdf[f] + widths)

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.groupBy(*names(entity)).applyInPandas(run, f"{fields}, alpha_t double, lower double, upper double")


def calibration_error(df: DataFrame, tau: str, y: str, q: str) -> DataFrame:
    """One row: mean distance of empirical from nominal levels."""
    r = reliability(df, tau, y, q)
    return r.agg(F.avg(F.abs(F.col("empirical") - F.col(tau))).alias("mace"))


def residual_interval(df: DataFrame, by: Names, f: str, e: str, z: float = 1.96) -> DataFrame:
    """Forecasts with ``z`` sample deviations of their group's residuals on both sides."""
    sd = df.groupBy(*names(by)).agg(F.stddev_samp(e).alias("__s"))
    return df.join(sd, names(by)).withColumns({"lower": F.col(f) - z * F.col("__s"), "upper": F.col(f) + z * F.col("__s")}).drop("__s")


def rolling_coverage(y: str, lower: str, upper: str, entity: Names, ts: Names, size: int = 50, least: int = 10) -> Column:
    """Share of the last ``size`` rows inside their intervals, once there are ``least``."""
    w = series(entity, ts).rowsBetween(-(size - 1), 0)
    hit = covered(y, lower, upper)
    return F.when(F.count(hit).over(w) >= least, F.avg(hit).over(w))


def empirical_interval(residuals: DataFrame, by: Names, e: str, alpha: float) -> DataFrame:
    return residuals.groupBy(*names(by)).agg(F.percentile(e, alpha / 2).alias("low"), F.percentile(e, 1 - alpha / 2).alias("high"))


def bootstrap_interval(residuals: DataFrame, by: Names, e: str, horizon: int, paths: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Quantiles of sums of resampled residuals, step by step; one series at a time."""
    keys = names(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf[e].dropna().to_numpy()
        draws = np.random.default_rng(seed).choice(r, (paths, horizon)).cumsum(1)
        q = np.quantile(draws, [alpha / 2, 1 - alpha / 2], axis=0)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * horizon for k in keys}, "step": np.arange(1, horizon + 1), "low": q[0], "high": q[1]})

    fields = ", ".join(f"`{k}` {residuals.schema[k].dataType.simpleString()}" for k in keys)
    return residuals.groupBy(*keys).applyInPandas(run, f"{fields}, step int, low double, high double")
