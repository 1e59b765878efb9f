"""Reports that judge forecasts, residuals and series as a whole: one row for each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names, series
from chronolake.operators import gram, stats


def pinball(y: Column, q: Column, tau: float) -> Column:
    return F.greatest(tau * (y - q), (tau - 1) * (y - q))


def probabilistic_report(df: DataFrame, by: Names, y: str, quantiles: Sequence[str], reference: Sequence[str], taus: Sequence[float]) -> DataFrame:
    """How good forecast quantiles are, beside reference quantiles: ``n``, ``pinball`` (mean over quantiles), ``crps`` (twice that), ``crps_skill``, ``coverage``, ``width`` and ``winkler`` of the outer pair, ``calibration_error``.

    ``quantiles`` and ``reference`` are columns in the order of ``taus``, which rise and are symmetric. Skill is 1 less the ratio to the reference; null where that is 0.
    """
    v, k = F.col(y), len(taus)
    own = sum((pinball(v, F.col(q), t) for q, t in zip(quantiles, taus, strict=True)), F.lit(0.0)) / k
    other = sum((pinball(v, F.col(q), t) for q, t in zip(reference, taus, strict=True)), F.lit(0.0)) / k
    low, high, alpha = F.col(quantiles[0]), F.col(quantiles[-1]), 2 * taus[0]
    miss = F.greatest(low - v, v - high, F.lit(0.0))
    below = [F.avg((v <= F.col(q)).cast("double")) for q in quantiles]
    one = df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(own).alias("pinball"), F.avg(2 * other).alias("__ref"), F.avg(((v >= low) & (v <= high)).cast("double")).alias("coverage"), F.avg(high - low).alias("width"), F.avg(high - low + 2 / alpha * miss).alias("winkler"),
        (sum((F.abs(b - t) for b, t in zip(below, taus, strict=True)), F.lit(0.0)) / k).alias("calibration_error"),
    )
    return one.select(*names(by), "n", "pinball", (2 * F.col("pinball")).alias("crps"), F.when(F.col("__ref") > 0, 1 - 2 * F.col("pinball") / F.col("__ref")).alias("crps_skill"), "coverage", "width", "winkler", "calibration_error")


#: 95 % points of chi-square by degrees of freedom.
CHI2_95 = {5: 11.0705, 10: 18.3070, 20: 31.4104}


def residual_report(df: DataFrame, entity: Names, ts: str, e: str, lags: int = 10) -> DataFrame:
    """What a model left in its residuals: ``n``, ``mean``, ``bias_t``, ``std``, ``durbin_watson``, ``ljung_box`` (``lags`` lags), ``jarque_bera``, ``arch`` (Engle's statistic with one lag), and whether each is unsuspicious at 5 %."""
    keys, w = names(entity), series(entity, ts)
    rho = stats.acf(df, entity, ts, e, lags)
    box = rho.groupBy(*keys).agg((F.max("n") * (F.max("n") + 2) * F.sum(F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag")))).alias("ljung_box"))
    x = F.col(e).cast("double")
    d = df.select(*keys, x.alias("e"), F.lag(x).over(w).alias("l"))
    square, before = F.col("e") * F.col("e"), F.col("l") * F.col("l")
    n = F.count("e")
    one = d.groupBy(*keys).agg(
        n.alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("std"), (F.sum(F.pow(F.col("e") - F.col("l"), 2)) / F.sum(square)).alias("durbin_watson"),
        (n / 6 * (F.pow(F.skewness("e"), 2) + F.pow(F.kurtosis("e"), 2) / 4)).alias("jarque_bera"), (F.count("l") * F.pow(F.corr(square, before), 2)).alias("arch"),
    )
    met = one.join(box, keys).withColumn("bias_t", F.col("mean") / F.col("std") * F.sqrt("n"))
    # Two-sided 5 % point of the normal, 95 % points of chi-square with 2 and 1 degrees of freedom.
    return met.select(*keys, "n", "mean", "bias_t", "std", "durbin_watson", "ljung_box", "jarque_bera", "arch", (F.abs("bias_t") < 1.96).alias("unbiased"), (F.col("ljung_box") < CHI2_95[lags]).alias("white"), (F.col("jarque_bera") < 5.9915).alias("normal"), (F.col("arch") < 3.8415).alias("even"))


def stationarity(df: DataFrame, entity: Names, ts: str, value: str, lags: int = 3) -> DataFrame:
    """Unit-root and level-stationarity tests together: ``adf``, ``kpss``, ``verdict``.

    "stationary" where both say so, "unit root" where both deny it, "trend or break" where only the unit root is rejected, "too little evidence" where neither is.
    """
    keys = names(entity)
    root = gram.unit_root(df, entity, ts, value, lags).select(*keys, F.col("statistic").alias("adf"), "stationary")
    level = stats.kpss(df, entity, ts, value, lags).select(*keys, "kpss")
    # Fixed value: 5 % point of the level test.
    still = F.col("kpss") < 0.463
    verdict = F.when(F.col("stationary") & still, "stationary").when(F.col("stationary"), "trend or break").when(still, "too little evidence").otherwise("unit root")
    return root.join(level, keys).select(*keys, "adf", "kpss", verdict.alias("verdict"))


def made_stationary(df: DataFrame, entity: Names, ts: str, value: str, lags: int = 3) -> DataFrame:
    """Series as they are where the unit root is rejected, else their differences: ``prepared`` and ``differenced``; a first difference that doesn't exist goes."""
    keys = names(entity)
    known = gram.unit_root(df, entity, ts, value, lags).select(*keys, F.coalesce(~F.col("stationary"), F.lit(True)).alias("differenced"))
    d = df.withColumn("__d", F.col(value) - F.lag(value).over(series(entity, ts))).join(known, keys)
    return d.withColumn("prepared", F.when(F.col("differenced"), F.col("__d")).otherwise(F.col(value))).where("prepared is not null").drop("__d")
