"""Features of a series. What is shifted never sees its own row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, expanding, gated, names, series, shifted, trailing, whole


def lags(value: str, entity: Names, ts: Names, steps: Sequence[int]) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(value, k).over(series(entity, ts)) for k in steps}


def leads(value: str, entity: Names, ts: Names, steps: Sequence[int]) -> dict[str, Column]:
    """Direct targets, one per step ahead."""
    return {f"lead_{k}": F.lead(value, k).over(series(entity, ts)) for k in steps}


def differences(value: str, entity: Names, ts: Names, season: int) -> dict[str, Column]:
    w, v = series(entity, ts), F.col(value)
    last = F.lag(value).over(w)
    return {"diff": v - last, f"diff_{season}": v - F.lag(value, season).over(w), "log_diff": F.log(v) - F.log(last), "pct_change": v / last - 1}


def rolling(value: str, entity: Names, ts: Names, sizes: Sequence[int], least: int = 1, shift: bool = True) -> dict[str, Column]:
    """Mean, sample deviation, least and greatest over windows; a deviation needs two values."""
    out = {}
    for n in sizes:
        w = shifted(entity, ts, n) if shift else trailing(entity, ts, n)
        for name, fn, floor in (("mean", F.avg, 1), ("std", F.stddev_samp, 2), ("min", F.min, 1), ("max", F.max, 1)):
            out[f"roll_{name}_{n}"] = gated(fn, value, w, max(least, floor))
    return out


def rolling_quantiles(value: str, entity: Names, ts: Names, size: int, least: int = 1) -> dict[str, Column]:
    w = trailing(entity, ts, size)
    q = {p: gated(lambda c, p=p: F.percentile(c, p), value, w, least) for p in (0.25, 0.5, 0.75)}
    return {"q25": q[0.25], "median": q[0.5], "q75": q[0.75], "iqr": q[0.75] - q[0.25]}


def expanding_stats(value: str, entity: Names, ts: Names) -> dict[str, Column]:
    w = expanding(entity, ts, 1)
    return {"exp_mean": F.avg(value).over(w), "exp_std": gated(F.stddev_samp, value, w, 2), "exp_min": F.min(value).over(w), "exp_max": F.max(value).over(w)}


def rolling_pair(a: str, b: str, entity: Names, ts: Names, size: int) -> dict[str, Column]:
    """Correlation with another column and slope on the row number ``t``, over full windows."""
    w = trailing(entity, ts, size)
    full = F.count(F.lit(1)).over(w) == size
    return {"corr": F.when(full, F.corr(a, b).over(w)), "slope": F.when(full, F.regr_slope(F.col(a), F.col("t")).over(w))}


def ewm(df: DataFrame, entity: Names, ts: str, value: str, alpha: float, adjust: bool = False, name: str = "ewm") -> DataFrame:
    """Exponentially weighted mean along each entity, one pass. ``adjust`` divides by the weights so far."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        return pdf.assign(**{name: pdf[value].ewm(alpha=alpha, adjust=adjust).mean()})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*names(entity)).applyInPandas(run, f"{fields}, `{name}` double")


def ewm_over(value: str, entity: Names, ts: Names, alpha: float, reach: int) -> Column:
    """The same with ``adjust`` by expressions alone, for weights that end after ``reach`` rows."""
    values = F.collect_list(F.col(value)).over(trailing(entity, ts, reach))
    weights = F.transform(values, lambda _, i: F.pow(F.lit(1 - alpha), F.size(values) - 1 - i))
    top = F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    return top / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)


def target_encoding(df: DataFrame, key: str, target: str, smoothing: float) -> DataFrame:
    """(n * mean + m * global) / (n + m) by key, joined on; the table of keys is aggregated first."""
    total = df.agg(F.avg(target).alias("__g"))
    table = df.groupBy(key).agg(F.count(target).alias("__n"), F.avg(target).alias("__m")).join(F.broadcast(total))
    encoded = table.select(key, ((F.col("__n") * F.col("__m") + smoothing * F.col("__g")) / (F.col("__n") + smoothing)).alias("encoded"))
    return df.join(encoded, key, "left")


def scaled(df: DataFrame, entity: Names, value: str) -> DataFrame:
    """z-score (sample deviation), min-max and robust scale in each entity; a spread below 1e-8 counts as 1. Sizes come from one aggregate."""
    keys = names(entity)
    v = F.col(value)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    by = df.groupBy(*keys).agg(F.avg(v).alias("__m"), F.stddev_samp(v).alias("__s"), F.min(v).alias("__lo"), F.max(v).alias("__hi"), q.alias("__q"))

    def safe(c: Column) -> Column:
        return F.when(c < 1e-8, 1.0).otherwise(c)

    return df.join(by, keys).withColumns(
        {
            "z": (v - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s")),
            "minmax": (v - F.col("__lo")) / safe(F.col("__hi") - F.col("__lo")),
            "robust": (v - F.col("__q")[1]) / safe(F.col("__q")[2] - F.col("__q")[0]),
        }
    ).drop("__m", "__s", "__lo", "__hi", "__q")


def static(df: DataFrame, entity: Names, value: str, t: str = "t") -> DataFrame:
    """Mean, deviation (population), variation, length, share of zeros and trend slope of each series."""
    v = F.col(value)
    return df.groupBy(*names(entity)).agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        (F.stddev_pop(v) / (F.avg(v) + 1e-8)).alias("cv"),
        F.count(v).alias("length"),
        F.avg((v == 0).cast("double")).alias("sparsity"),
        F.regr_slope(v, F.col(t)).alias("slope"),
    )


def sliding(df: DataFrame, entity: Names, ts: str, value: str, look_back: int, horizon: int, stride: int = 1) -> DataFrame:
    """Supervised windows: arrays ``x`` (past) and ``y`` (ahead), whole ones only."""
    w = series(entity, ts)
    n = F.row_number().over(w)
    x = F.collect_list(value).over(w.rowsBetween(-(look_back - 1), 0))
    y = F.collect_list(value).over(w.rowsBetween(1, horizon))
    made = df.select(*names(entity), ts, n.alias("n"), x.alias("x"), y.alias("y"))
    return made.where((F.size("x") == look_back) & (F.size("y") == horizon) & (F.pmod(F.col("n") - look_back, F.lit(stride)) == 0))


def indicators(price: str, entity: Names, ts: Names) -> dict[str, Column]:
    """Price against its mean, relative strength (14), band position (20), by rows."""
    w, p = series(entity, ts), F.col(price)
    ma, sd = F.avg(p).over(trailing(entity, ts, 20)), F.stddev_samp(p).over(trailing(entity, ts, 20))
    full = F.count(F.lit(1)).over(trailing(entity, ts, 20)) == 20
    change = p - F.lag(p).over(w)
    return {"change": change, "price_vs_ma": F.when(full, p / ma - 1), "band": F.when(full, (p - (ma - 2 * sd)) / (4 * sd))}


def relative_strength(df: DataFrame, entity: Names, ts: str, change: str, size: int = 14, name: str = "rsi") -> DataFrame:
    """100 - 100 / (1 + mean gain / mean loss) over full windows of changes."""
    w, c = trailing(entity, ts, size), F.col(change)
    gain, loss = F.avg(F.when(c > 0, c).otherwise(0.0)).over(w), F.avg(F.when(c < 0, -c).otherwise(0.0)).over(w)
    full = F.count(c).over(w) == size
    return df.withColumn(name, F.when(full, 100 - 100 / (1 + gain / (loss + 1e-12))))


def drawdown(price: str, entity: Names, ts: Names) -> Column:
    peak = F.max(price).over(expanding(entity, ts))
    return (F.col(price) - peak) / peak


def average_rank(value: str, entity: Names) -> Column:
    """Rank from 1, ties at their mean."""
    from pyspark.sql import Window

    w = Window.partitionBy(*names(entity)).orderBy(value)
    same = Window.partitionBy(*names(entity), value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2


def codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Numbers from 0 for the sorted distinct values; only the distinct values are numbered in one task."""
    from pyspark.sql import Window

    table = df.select(column).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(table, column)


def age_weight(ts: str, now: Column, decay: float) -> Column:
    """decay ** age in days, for training windows that forget."""
    return F.pow(F.lit(decay), F.datediff(now, F.col(ts)))


def group_share(value: str, entity: Names) -> Column:
    return F.col(value) / F.sum(value).over(whole(entity))


def horizon_safe(columns: Sequence[str], step: int) -> list[str]:
    """Columns whose lag or difference reaches back at least ``step``; columns of other kinds stay."""
    import re

    return [c for c in columns if not (m := re.fullmatch(r"(?:lag|diff)_(\d+)", c)) or int(m[1]) >= step]


def box_cox(values: np.ndarray, grid: Sequence[float] = tuple(np.linspace(-2, 2, 81))) -> float:
    """The power of greatest likelihood on a grid."""
    logs = np.log(values)

    def likelihood(p: float) -> float:
        y = logs if abs(p) < 1e-9 else (values**p - 1) / p
        return -len(values) / 2 * np.log(y.var()) + (p - 1) * logs.sum()

    return float(max(grid, key=likelihood))


#: Public holidays on the same day each year (month, day).
HOLIDAYS = ((1, 1), (7, 4), (11, 11), (12, 25), (12, 26))


def holiday(ts: str, days: Sequence[tuple[int, int]] = HOLIDAYS) -> Column:
    """1 on the days given as (month, day), else 0."""
    c = F.col(ts)
    hit = [(F.month(c) == m) & (F.dayofmonth(c) == d) for m, d in days]
    return sum((h.cast("int") for h in hit[1:]), hit[0].cast("int"))


def interactions(pairs: Sequence[tuple[str, str]], eps: float = 1e-8) -> dict[str, Column]:
    """Product and ratio of pairs of columns."""
    out = {}
    for a, b in pairs:
        out |= {f"{a}_x_{b}": F.col(a) * F.col(b), f"{a}_per_{b}": F.col(a) / (F.col(b) + eps)}
    return out


def unscaled(df: DataFrame, sizes: DataFrame, entity: Names, z: str, name: str = "value") -> DataFrame:
    """Values back from z-scores and the ``mean`` and ``std`` of each entity."""
    return df.join(sizes, names(entity)).withColumn(name, F.col(z) * F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")) + F.col("mean")).drop("mean", "std")


def box_cox_power(df: DataFrame, entity: Names, value: str, grid: Sequence[float]) -> DataFrame:
    """The power of greatest likelihood among ``grid`` for each entity's positive values, by one aggregate.

    The transform's constant is left out: it moves no variance, but next to it a large value's negative power is lost in the last digit.
    """
    v, keys = F.col(value).cast("double"), names(entity)
    logs = F.log(v)

    def moved(p: float) -> Column:
        return logs if abs(p) < 1e-9 else F.pow(v, F.lit(float(p))) / p

    scores = [F.struct((-F.count(v) / 2 * F.log(F.var_pop(moved(p))) + (p - 1) * F.sum(logs)).alias("l"), F.lit(-float(p)).alias("m")) for p in grid]
    best = df.where(v > 0).groupBy(*keys).agg(F.array_max(F.array(*scores)).alias("b"))
    return best.select(*keys, (-F.col("b.m")).alias("power"))


def market(price: str, entity: Names, ts: Names, size: int = 20, year: int = 252) -> dict[str, Column]:
    """Realised volatility of log returns (by the year), and the value against its mean over ``size`` rows; full windows only."""
    w, p = trailing(entity, ts, size), F.col(price)
    back = F.log(p) - F.log(F.lag(p).over(series(entity, ts)))
    full = F.count(F.lit(1)).over(w) == size
    return {"log_return": back, "ratio": F.when(full, p / F.avg(p).over(w)), "scale": F.lit(float(year) ** 0.5)}


def macd(df: DataFrame, entity: Names, ts: str, price: str, fast: float = 2 / 13, slow: float = 2 / 27, signal: float = 2 / 10) -> DataFrame:
    """Adds ``macd`` (fast less slow smoothed price) and ``macd_signal``, its own smoothing."""
    d = ewm(ewm(df, entity, ts, price, fast, name="__fast"), entity, ts, price, slow, name="__slow")
    d = d.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    return ewm(d, entity, ts, "macd", signal, name="macd_signal")


def parts(df: DataFrame, entity: Names, ts: Names, shares: Sequence[float], labels: Sequence[str] = ("train", "calibration", "test")) -> DataFrame:
    """Adds ``part`` by position in time: the first share of each entity's rows, the next, and so on."""
    keys = names(entity)
    i = F.row_number().over(series(keys, ts)) - 1
    at = i / F.count(F.lit(1)).over(whole(keys))
    out, upto = F.lit(labels[-1]), 0.0
    edges = []
    for share, label in zip(shares[:-1], labels[:-1], strict=True):
        upto += share
        edges.append((upto, label))
    for edge, label in reversed(edges):
        out = F.when(at < edge, label).otherwise(out)
    return df.withColumn("part", out)


def entity_part(key: str, percent: int) -> Column:
    """``test`` for that share of entities, ``train`` for the others; an entity is never in both."""
    return F.when(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(100)) < percent, "test").otherwise("train")


def build(df: DataFrame, entity: Names, ts: str, value: str, lag_steps: Sequence[int] = (), sizes: Sequence[int] = (), season: int | None = None, calendar: Sequence[str] = ()) -> DataFrame:
    """A feature table in one call: lags, shifted rolling statistics, differences and parts of the calendar, by name. None sees its own row's value but the differences."""
    from chronolake.operators.spine import calendar_parts

    cols = lags(value, entity, ts, lag_steps) | rolling(value, entity, ts, sizes)
    if season:
        cols |= differences(value, entity, ts, season)
    own = calendar_parts(ts)
    return df.withColumns(cols | {k: own[k] for k in calendar})


def ewm_spread(df: DataFrame, entity: Names, ts: str, value: str, halflife: float) -> DataFrame:
    """Adds ``ewm`` and ``ewm_std`` (corrected for bias), weights halving every ``halflife`` rows, divided by the weights so far."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        e = pdf[value].ewm(halflife=halflife)
        return pdf.assign(ewm=e.mean(), ewm_std=e.std())

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*names(entity)).applyInPandas(run, f"{fields}, ewm double, ewm_std double")


def fit_encoding(df: DataFrame, key: str, target: str, smoothing: float) -> DataFrame:
    """``key``, ``encoded`` and ``default`` (the mean of all) from training rows, for :func:`encode`."""
    total = df.agg(F.avg(target).alias("default"))
    table = df.groupBy(key).agg(F.count(target).alias("__n"), F.avg(target).alias("__m")).join(F.broadcast(total))
    return table.select(key, ((F.col("__n") * F.col("__m") + smoothing * F.col("default")) / (F.col("__n") + smoothing)).alias("encoded"), "default")


def encode(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Rows with ``encoded``; a key that training didn't see has the mean of all."""
    default = table.agg(F.max("default").alias("__d"))
    return df.join(table.select(key, "encoded"), key, "left").join(F.broadcast(default)).withColumn("encoded", F.coalesce("encoded", "__d")).drop("__d")
