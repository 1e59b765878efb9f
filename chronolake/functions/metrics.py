"""Forecast metrics as aggregates over columns of actual and forecast values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names, series

EPS = 1e-8


def point(y: str = "y", f: str = "f") -> dict[str, Column]:
    """Errors of a forecast. Percentages are shares; their denominators have a small addend."""
    a, e = F.col(y), F.col(f) - F.col(y)
    size = F.abs(e)
    return {
        "mae": F.avg(size),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mape": F.avg(size / (F.abs(a) + EPS)),
        "smape": F.avg(size / ((F.abs(a) + F.abs(F.col(f))) / 2 + EPS)),
        "mdae": F.percentile(size, 0.5),
        "wmape": F.sum(size) / F.sum(F.abs(a)),
        "bias": F.avg(e),
        "max_error": F.max(size),
    }


def relative_errors(y: str = "y", f: str = "f") -> dict[str, Column]:
    """Median of percentage errors, and the ratio of root mean square to mean absolute error (1 where all are of one size)."""
    size = F.abs(F.col(f) - F.col(y))
    return {"mdape": F.percentile(size / (F.abs(F.col(y)) + EPS), 0.5), "rmse_over_mae": F.sqrt(F.avg(size * size)) / F.avg(size)}


def by_horizon(scored: DataFrame, model: Names = "model", step: str = "step", y: str = "actual", f: str = "forecast") -> DataFrame:
    """Errors of each model at each step ahead."""
    e = F.col(f) - F.col(y)
    return scored.groupBy(*names(model), step).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def owa(smape: Column, mase_: Column, base_smape: Column, base_mase: Column) -> Column:
    """Overall weighted average: half the sum of both errors over those of the baseline."""
    return (smape / base_smape + mase_ / base_mase) / 2


def rmsse(scored: DataFrame, train: DataFrame, entity: Names, ts: str, value: str, y: str = "y", f: str = "f") -> DataFrame:
    """Root mean squared error over the training rows' mean squared one-step difference, per entity: (entity, rmsse)."""
    keys = names(entity)
    d = F.col(value) - F.lag(value).over(series(keys, ts))
    scale = train.select(*keys, F.pow(d, 2).alias("__d")).groupBy(*keys).agg(F.avg("__d").alias("__s"))
    own = scored.groupBy(*keys).agg(F.avg(F.pow(F.col(f) - F.col(y), 2)).alias("__e"))
    return own.join(scale, keys).select(*keys, F.sqrt(F.col("__e") / F.col("__s")).alias("rmsse"))


def weighted(errors: DataFrame, weights: DataFrame, entity: Names, error: str, weight: str) -> DataFrame:
    """One row: errors by entity, weighted by their share of all weights."""
    return errors.join(weights, names(entity)).agg((F.sum(F.col(error) * F.col(weight)) / F.sum(weight)).alias(f"w{error}"))


def error_correlation(df: DataFrame, by: Names, a: str, b: str) -> DataFrame:
    """Correlation of two models' errors: the lower, the more a blend can gain."""
    return df.groupBy(*names(by)).agg(F.corr(a, b).alias("corr"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mean precision at each positive, the highest scores first; equal scores count together."""
    by = df.groupBy(score).agg(F.sum(label).alias("__p"), F.count(F.lit(1)).alias("__n")).withColumn("__k", -F.col(score))
    seen = running_before(running_before(by, "__k", "__p", "__pb"), "__k", "__n", "__nb")
    precision = (F.col("__pb") + F.col("__p")) / (F.col("__nb") + F.col("__n"))
    return seen.agg((F.sum(precision * F.col("__p")) / F.sum("__p")).alias("average_precision"))


def threshold_at(df: DataFrame, label: str, score: str, sensitivity: float) -> DataFrame:
    """The highest score from which on at least that share of the positives is flagged, and the share of negatives flagged with them."""
    by = df.groupBy(score).agg(F.sum(label).alias("__p"), F.sum(1 - F.col(label)).alias("__q")).withColumn("__k", -F.col(score))
    seen = running_before(running_before(by, "__k", "__p", "__pb"), "__k", "__q", "__qb")
    totals = by.agg(F.sum("__p").alias("__tp"), F.sum("__q").alias("__tq"))
    rate = (F.col("__pb") + F.col("__p")) / F.col("__tp")
    row = F.struct(F.col(score).alias("threshold"), rate.alias("sensitivity"), ((F.col("__qb") + F.col("__q")) / F.col("__tq")).alias("false_positive_rate"))
    return seen.join(F.broadcast(totals)).where(rate >= sensitivity).agg(F.max_by(row, score).alias("r")).select("r.*")


def segments(df: DataFrame, entity: Names, index: str, actual: str, flagged: str) -> DataFrame:
    """Each run of actual anomalies: start, end, whether any of its rows is flagged, and after how many rows the first one is."""
    keys = names(entity)
    w = series(keys, index)
    n = df.withColumn("__i", F.row_number().over(w)).withColumn("__g", F.col("__i") - F.sum(actual).over(w))
    own = n.where(F.col(actual) == 1)
    first = F.min(F.when(F.col(flagged) == 1, F.col("__i")))
    return own.groupBy(*keys, "__g").agg(F.min(index).alias("start"), F.max(index).alias("end"), F.max(flagged).alias("detected"), (first - F.min("__i")).alias("latency")).drop("__g")


def report(df: DataFrame, by: Names, y: str = "y", f: str = "f") -> DataFrame:
    return df.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in point(y, f).items()))


def naive_scale(df: DataFrame, entity: Names, ts: str, value: str, season: int = 1) -> DataFrame:
    """Mean absolute seasonal difference of the training rows, the denominator of scaled errors."""
    d = F.abs(F.col(value) - F.lag(value, season).over(series(entity, ts)))
    return df.select(*names(entity), d.alias("__d")).groupBy(*names(entity)).agg(F.avg("__d").alias("scale"))


def mase(scored: DataFrame, scale: DataFrame, entity: Names, y: str = "y", f: str = "f") -> DataFrame:
    own = scored.groupBy(*names(entity)).agg(F.avg(F.abs(F.col(f) - F.col(y))).alias("mae"))
    return own.join(scale, names(entity)).withColumn("mase", F.col("mae") / F.col("scale"))


def skill(metric: Column, baseline: Column) -> Column:
    """1 - metric / baseline."""
    return 1 - metric / baseline


def detection(actual: str, flagged: str) -> dict[str, Column]:
    """Precision, recall and F1 of 0/1 columns."""
    tp = F.sum(F.col(actual) * F.col(flagged)).cast("double")
    fp, fn = F.sum((1 - F.col(actual)) * F.col(flagged)), F.sum(F.col(actual) * (1 - F.col(flagged)))
    p, r = tp / (tp + fp + 1e-12), tp / (tp + fn + 1e-12)
    return {"tp": tp.cast("long"), "fp": fp.cast("long"), "fn": fn.cast("long"), "precision": p, "recall": r, "f1": 2 * p * r / (p + r + 1e-12)}


def running_before(df: DataFrame, key: str, value: str, name: str, parts: int = 64) -> DataFrame:
    """Adds the sum of ``value`` over all rows of smaller ``key`` (numbers, distinct). Rows are dealt by ranges of the
    key and summed within them; only a total for each range is summed over all of them, so no task orders the whole table."""
    edges = sorted(set(df.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 0.001)))
    # Plain comparisons: with a lambda, a filter inferred for the join below names this side's key on the other side, and the job fails.
    at = sum((F.when(F.col(key) > e, 1).otherwise(0) for e in edges), F.lit(0))
    d = df.withColumn("__r", at)
    totals = d.groupBy("__r").agg(F.sum(value).alias("__t"))
    before = totals.select("__r", F.coalesce(F.sum("__t").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("__o", own).join(F.broadcast(before), "__r").withColumn(name, F.col("__o") + F.col("__b")).drop("__r", "__o", "__b")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from counts by distinct score: ties count half."""
    by = df.groupBy(score).agg(F.sum(label).alias("__p"), F.sum(1 - F.col(label)).alias("__n"))
    part = running_before(by, score, "__n", "__below")
    return part.agg((F.sum(F.col("__p") * (F.col("__below") + F.col("__n") / 2)) / (F.sum("__p") * F.sum("__n"))).alias("auc"), F.sum("__p").alias("n_positive"), F.sum("__n").alias("n_negative"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def macro_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and mean F1 over actual classes, from the confusion table."""
    c = confusion(df, actual, predicted)
    n, hit = F.col("n"), F.col(actual) == F.col(predicted)
    rows = c.groupBy(F.col(actual).alias("k")).agg(F.sum(n).alias("real"), F.sum(F.when(hit, n).otherwise(0)).alias("tp"))
    cols = c.groupBy(F.col(predicted).alias("k")).agg(F.sum(n).alias("said"))
    f1 = 2.0 * F.col("tp") / (F.col("real") + F.coalesce("said", F.lit(0)))
    return rows.join(cols, "k", "left").agg((F.sum("tp") / F.sum("real")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def brier(label: str, p: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(label), 2))
