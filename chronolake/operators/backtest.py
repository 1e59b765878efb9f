"""Folds as tables, and forecasts from many origins in one plan."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names, series
from chronolake.operators.forecast import Fit, ses_level

def level_rows(alpha: float) -> int:
    """Rows beyond which all older values together weigh less than a double's last digit in a smoothed level."""
    return 1 if alpha >= 1 else min(2**31 - 2, math.ceil(math.log(2.0**-60) / math.log1p(-alpha))) if alpha > 0 else 2**31 - 2


def origins(n: int, least: int, horizon: int, count: int, gap: int = 0) -> list[int]:
    """Last training places, evenly spread."""
    return [int(x) for x in np.linspace(least - 1, n - 1 - gap - horizon, count)]


def expanding_folds(n: int, folds: int, test: int, gap: int = 0, most: int | None = None) -> list[tuple[int, int, int, int]]:
    """(train start, train end, test start, test end), ends exclusive, the last fold at the end of the series."""
    out = []
    for k in range(folds):
        start = n - (folds - k) * test
        end = start - gap
        if end > 0:
            out.append((max(0, end - most) if most else 0, end, start, start + test))
    return out


def purged_folds(n: int, folds: int, purge: int, embargo: int) -> list[tuple[list[tuple[int, int]], tuple[int, int]]]:
    """Training stretches and the validation stretch of each fold; rows near the validation are left out on both sides."""
    edges = np.linspace(0, n, folds + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        parts = [(0, max(0, int(a) - purge)), (min(n, int(b) + embargo), n)]
        out.append(([p for p in parts if p[1] > p[0]], (int(a), int(b))))
    return out


def fold_table(spark: SparkSession, folds: Sequence[tuple[int, int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, *map(int, f)) for i, f in enumerate(folds)], "fold int, train_start int, train_end int, test_start int, test_end int")


def split_rows(df: DataFrame, entity: Names, ts: str, folds: DataFrame) -> DataFrame:
    """Each row beside every fold that it belongs to, with its part. Folds are few, rows many."""
    n = df.withColumn("t", F.row_number().over(series(entity, ts)) - 1)
    part = F.when(F.col("t").between(F.col("train_start"), F.col("train_end") - 1), "train").when(F.col("t").between(F.col("test_start"), F.col("test_end") - 1), "test")
    return n.join(F.broadcast(folds)).withColumn("part", part).where("part is not null").drop("train_start", "train_end", "test_start", "test_end")


def tail_folds(df: DataFrame, entity: Names, ts: str, folds: int, test: int, gap: int = 0, window: int | None = None) -> DataFrame:
    """Each row beside every fold it belongs to (``t`` from 0, ``fold``, ``part``), for test stretches at the end of each entity's own length.

    Training rows are all before the gap, or the last ``window`` of them.
    """
    n = df.withColumns({"t": F.row_number().over(series(entity, ts)) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*names(entity)))})
    f = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("__s", F.col("__n") - (folds - F.col("fold")) * test)
    train = F.col("t") < F.col("__s") - gap
    if window:
        train = train & (F.col("t") >= F.col("__s") - gap - window)
    part = F.when(train, "train").when(F.col("t").between(F.col("__s"), F.col("__s") + test - 1), "test")
    return f.withColumn("part", part).where("part is not null").drop("__n", "__s")


def purged_rows(df: DataFrame, entity: Names, ts: str, folds: int, purge: int, embargo: int) -> DataFrame:
    """Each row beside every fold (``t`` from 0, ``fold``, ``part``): a stretch of each entity is for validation, rows up to ``purge`` before and ``embargo`` after it are in neither part."""
    n = df.withColumns({"t": F.row_number().over(series(entity, ts)) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*names(entity)))})
    f = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    a, b = F.floor(F.col("__n") * F.col("fold") / folds), F.floor(F.col("__n") * (F.col("fold") + 1) / folds)
    part = F.when((F.col("t") >= a) & (F.col("t") < b), "validation").when((F.col("t") < a - purge) | (F.col("t") >= b + embargo), "train")
    return f.withColumn("part", part).where("part is not null").drop("__n")


def closed_form(df: DataFrame, entity: Names, ts: str, value: str, horizon: int, season: int, step: int, least: int, count: int, alpha: float = 0.3) -> DataFrame:
    """Forecasts of five baselines from ``count`` origins, ``step`` apart back from the end: (entity, origin, step, model, forecast, actual, scale).

    An origin's training rows are all before it. Each series is numbered once, and everything an origin
    needs is a running sum at its row.
    ``scale`` is the training rows' mean absolute difference, for scaled errors.
    """
    keys = names(entity)
    w, g = series(entity, ts), Window.partitionBy(*keys)
    n = df.select(*keys, F.col(value).alias("y"), F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(g).alias("n"), F.abs(F.col(value) - F.lag(value).over(w)).alias("d"))
    # Origin k is the place after which k * step + horizon rows are left. What an origin needs of all rows
    # is a running sum at its own row; only the smoothed level takes rows to origins, those close enough to count.
    t, y, w = F.col("i"), F.col("y"), series(keys, "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumns({"t": t - F.col("n") / 2, "c": y - F.avg("y").over(g)})
    total, mean_t, mean_c = F.count(F.lit(1)).over(upto), F.avg("t").over(upto), F.avg("c").over(upto)
    slope = (F.sum(F.col("t") * F.col("c")).over(upto) - total * mean_t * mean_c) / (F.sum(F.col("t") * F.col("t")).over(upto) - total * mean_t * mean_t)
    left = F.col("n") - horizon - t
    run = n.select(*keys, "i", F.avg("y").over(upto).alias("mean"), y.alias("naive"), F.first("y").over(upto).alias("first"), slope.alias("b"), F.avg("i").over(upto).alias("mt"), F.avg("d").over(upto).alias("scale"), F.collect_list(y).over(w.rowsBetween(-(season - 1), 0)).alias("last"), left.alias("left"))
    at_origin = (F.col("left") % step == 0) & F.col("left").between(0, (count - 1) * step) & (F.col("i") >= least)
    one = run.where(at_origin).select(*keys, F.col("i").alias("origin"), "mean", "naive", "first", "b", (F.col("mean") - F.col("b") * F.col("mt")).alias("a"), "scale", "last")
    ends = F.expr(f"filter(transform(sequence(0, {count - 1}), k -> n - {horizon} - k * {step}), o -> o >= {least} and o >= i and o < cast(i as long) + {level_rows(alpha)})")
    level = n.withColumn("origin", F.explode(ends)).groupBy(*keys, "origin").agg(ses_level("y", "i", "origin", alpha).alias("ses"))
    one = one.join(level, [*keys, "origin"])
    at = one.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    h, o = F.col("step"), F.col("origin")
    models = {
        "naive": F.col("naive"),
        "seasonal_naive": F.col("last")[F.pmod(h - 1, F.lit(season))],
        "drift": F.col("naive") + h * (F.col("naive") - F.col("first")) / (o - 1),
        "ses": F.col("ses"),
        "theta": 0.5 * (F.col("a") + F.col("b") * (o + h)) + 0.5 * F.col("ses"),
    }
    long = at.select(*keys, "origin", "step", "scale", F.explode(F.array(*(F.struct(F.lit(k).alias("model"), c.alias("forecast")) for k, c in models.items()))).alias("m"))
    actual = n.select(*keys, F.col("i").alias("__i"), F.col("y").alias("actual"))
    return long.withColumn("__i", o + h).join(actual, [*keys, "__i"]).select(*keys, "origin", "step", "m.model", "m.forecast", "actual", "scale")


def per_series(df: DataFrame, entity: Names, ts: str, value: str, models: dict[str, Fit], ends: Callable[[int], list[int]], horizon: int) -> DataFrame:
    """Any forecasters from chosen origins, one series at a time; a failing one falls back to the last value, and ``failed`` says so."""
    keys = names(entity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(ts)[value].to_numpy(float)
        rows = []
        for o in ends(len(y)):
            train, test = y[: o + 1], y[o + 1 : o + 1 + horizon]
            for name, fit in models.items():
                failed = False
                try:
                    f = fit(train, horizon)
                except (np.linalg.LinAlgError, ValueError, IndexError):
                    f, failed = np.full(horizon, train[-1]), True
                rows += [(*(pdf[k].iloc[0] for k in keys), o, s + 1, name, float(f[s]), float(a), failed) for s, a in enumerate(test)]
        return pd.DataFrame(rows, columns=[*keys, "origin", "step", "model", "forecast", "actual", "failed"])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{fields}, origin int, step int, model string, forecast double, actual double, failed boolean")


def leaderboard(scored: DataFrame) -> DataFrame:
    """Errors by model over all origins and steps, with the gain over the naive forecast."""
    e = F.col("forecast") - F.col("actual")
    by = scored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e) / F.col("scale")).alias("mase"))
    base = by.where("model = 'naive'").select(F.col("mae").alias("__b"))
    return by.join(F.broadcast(base)).withColumn("gain", 1 - F.col("mae") / F.col("__b")).drop("__b")


def zero_shot_rows(df: DataFrame, entity: Names, ts: str, horizon: int, windows: int, least: int, stride: int | None = None) -> DataFrame:
    """Test rows of windows laid back from each series' end, for models that aren't trained: rows with ``window`` (0 the last), ``step``, ``context`` (rows before).

    Windows with fewer than ``least`` rows of context are left out, so all models meet the same ones.
    """
    gap = stride or horizon
    n = df.withColumns({"__i": F.row_number().over(series(entity, ts)), "__n": F.count(F.lit(1)).over(Window.partitionBy(*names(entity)))})
    k = n.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1)))).withColumn("context", F.col("__n") - horizon - F.col("window") * gap)
    k = k.withColumn("step", F.col("__i") - F.col("context"))
    return k.where((F.col("context") >= least) & F.col("step").between(1, horizon)).drop("__i", "__n")


def random_folds(df: DataFrame, id_: Names, folds: int) -> DataFrame:
    """Adds ``fold`` by a hash of the id. For rows without an order only: in a series, neighbours of a test row would be trained on."""
    return df.withColumn("fold", (_hashed(names(id_)) % folds).cast("int"))


def _hashed(columns: Sequence[str]) -> Column:
    """32 bits of the MD5 of the columns as text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns))), 1, 8), 16, 10).cast("long")


def stratified_folds(df: DataFrame, label: str, id_: str, folds: int) -> DataFrame:
    """Adds ``fold`` so that the folds' numbers of each label differ by one at most: rows of a label are dealt in the order of a hash of their id.

    The order within a label is laid by ranges of the hash with a count of each range, so no label has to fit in a task.
    """
    h = _hashed([id_])
    d = df.withColumns({"__h": h, "__r": F.shiftright(h, 20)})
    sizes = d.groupBy(label, "__r").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.withColumn("__b", F.sum("__c").over(Window.partitionBy(label).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))).drop("__c")
    place = F.row_number().over(Window.partitionBy(label, "__r").orderBy("__h", id_)) - 1
    met = d.withColumn("__p", place).join(before.withColumnsRenamed({label: "__l", "__r": "__s"}), F.col(label).eqNullSafe(F.col("__l")) & (F.col("__r") == F.col("__s")))
    return met.withColumn("fold", ((F.coalesce("__b", F.lit(0)) + F.col("__p")) % folds).cast("int")).drop("__h", "__r", "__b", "__p", "__l", "__s")
