"""Drift between reference and current data, alerts, and decisions about models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, expanding, names, series, trailing
from chronolake.operators.quantile import exact_quantiles
from chronolake.operators.stats import ks_and_w1


def psi(df: DataFrame, by: Names, value: str, is_reference: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Stability index over bins of equal reference frequency. Current values outside the reference's range are left out, empty shares count ``eps``."""
    keys = names(by)
    ref = F.col(is_reference) == 1
    cuts = exact_quantiles(df.where(ref), keys, value, [i / bins for i in range(bins + 1)], "e")
    v = F.col(value)
    d = df.select(*keys, v.alias("__v"), F.col(is_reference).alias("__r")).join(cuts, keys)
    one = d.where((F.col("__v") >= F.col("e")[0]) & (F.col("__v") <= F.col("e")[bins])).select(*keys, "__v", "e", F.col("__r").alias("r"), (1 - F.col("__r")).alias("c"))
    at = F.size(F.filter(F.slice("e", 2, bins - 1), lambda x: x < F.col("__v"))).alias("bin")
    c = one.select(*keys, at, "r", "c").groupBy(*keys, "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    g = Window.partitionBy(*keys)
    p, q = F.greatest(F.col("r") / F.sum("r").over(g), F.lit(eps)), F.greatest(F.col("c") / F.sum("c").over(g), F.lit(eps))
    one = c.select(*keys, ((q - p) * F.log(q / p)).alias("x")).groupBy(*keys).agg(F.sum("x").alias("psi"))
    level = F.when(F.col("psi") < 0.1, "none").when(F.col("psi") < 0.25, "moderate").otherwise("severe")
    return one.withColumn("severity", level)


def drift_report(df: DataFrame, by: Names, value: str, is_reference: str) -> DataFrame:
    """Stability index, distances, and whether there is drift, per group."""
    keys = names(by)
    ref = df.where(F.col(is_reference) == 1).groupBy(*keys).agg(F.stddev_samp(value).alias("std"))
    both = psi(df, by, value, is_reference).join(ks_and_w1(df, by, value, is_reference), keys).join(ref, keys)
    return both.withColumn("w1_scaled", F.col("w1") / F.col("std")).withColumn("drifted", (F.col("psi") >= 0.1) | (F.col("ks_p") < 0.05)).drop("std")


def rolling_error(e: str, entity: Names, ts: Names, size: int) -> Column:
    return F.avg(F.abs(F.col(e))).over(trailing(entity, ts, size))


def hysteresis(df: DataFrame, entity: Names, ts: str, ratio: str, up: float = 1.5, down: float = 1.2) -> DataFrame:
    """``state`` 1 from where the ratio goes over ``up`` until it falls below ``down``, and ``event`` start or end where that changes.

    The state is the last of the two thresholds that was crossed, so a window replaces the loop.
    """
    r = F.col(ratio)
    crossed = F.when(r > up, 1).when(r < down, 0)
    d = df.withColumn("__c", crossed).withColumn("state", F.coalesce(F.last("__c", ignorenulls=True).over(expanding(entity, ts)), F.lit(0))).drop("__c")
    was = F.coalesce(F.lag("state").over(series(entity, ts)), F.lit(0))
    return d.withColumn("event", F.when((F.col("state") == 1) & (was == 0), "start").when((F.col("state") == 0) & (was == 1), "end"))


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metrics (entity, metric, value) that break rules (metric, op, threshold, severity, action). Few rules, many metrics."""
    v, t = F.col("value"), F.col("threshold")
    broken = F.when(F.col("op") == "gt", v > t).when(F.col("op") == "lt", v < t).when(F.col("op") == "gte", v >= t).when(F.col("op") == "lte", v <= t)
    return metrics.join(rules, "metric").where(broken)


def summary(fired: DataFrame, entity: Names) -> DataFrame:
    """Worst severity and numbers of alerts per entity."""
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    return fired.groupBy(*names(entity)).agg(F.count(F.lit(1)).alias("n_alerts"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.max_by("severity", rank).alias("worst"))


def retrain_trigger(error: Column, baseline: Column, psi_: Column, rows: Column, days: Column, worse: float = 1.2, psi_limit: float = 0.25, most_rows: int = 10_000, least_days: int = 7) -> Column:
    """Why a model should be fitted again, or null; never within ``least_days`` of the last time."""
    return F.when(days < least_days, F.lit(None)).when(error > worse * baseline, "performance").when(psi_ > psi_limit, "drift").when(rows > most_rows, "volume")


def promotes(new: Column, old: Column, gain: float = 0.02) -> Column:
    return (old - new) / old > gain


def best_version(runs: DataFrame, model: str, metric: str) -> DataFrame:
    """The run of least metric of each model, the newest of equal ones."""
    w = Window.partitionBy(model).orderBy(metric, F.desc("version"))
    return runs.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def canary(key: str, percent: int) -> Column:
    """The share of keys that a new model serves; a key always goes the same way."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(100)) < percent


def latency_window(value: str, entity: Names, ts: Names, size: int = 500) -> dict[str, Column]:
    w = trailing(entity, ts, size)
    return {f"p{p}": F.percentile(value, p / 100).over(w) for p in (50, 95, 99)}


def retrain_windows(df: DataFrame, entity: Names, ts: str, every: int, length: int) -> DataFrame:
    """A schedule of retraining from each series' first to its last day: ``entity``, ``window``, ``train_start``, ``train_end``, ``score_end`` (dates, ends in).

    A model is trained on ``length`` days at most, and scores the ``every`` days that follow.
    """
    keys = names(entity)
    ends = df.groupBy(*keys).agg(F.to_date(F.min(ts)).alias("lo"), F.to_date(F.max(ts)).alias("hi"))
    k = ends.withColumn("window", F.explode(F.expr(f"sequence(1, greatest(1, cast(floor(datediff(hi, lo) / {every}) as int)))")))
    end = F.date_add("lo", F.col("window") * every - 1)
    return k.select(*keys, "window", F.greatest("lo", F.date_sub(end, length - 1)).alias("train_start"), end.alias("train_end"), F.least("hi", F.date_add(end, every)).alias("score_end")).where("train_end < hi")


def batch_scores(vectors: DataFrame, entity: Names, start: str, forecast: str, version: str) -> DataFrame:
    """Forecast vectors as rows for a serving table: ``entity``, ``step``, ``date`` (from the day after ``start``), ``forecast``, ``version``."""
    rows = vectors.select(*names(entity), F.col(start).alias("__d"), F.posexplode(forecast).alias("__i", "forecast"))
    return rows.select(*names(entity), (F.col("__i") + 1).alias("step"), F.date_add(F.to_date("__d"), F.col("__i") + 1).alias("date"), "forecast", F.lit(version).alias("version"))
