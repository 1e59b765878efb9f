"""Missing values, filled within each entity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, expanding, following, names, series, whole
from chronolake.operators.spine import gap_position


def ffill(value: str, entity: Names, ts: Names) -> Column:
    return F.last(value, ignorenulls=True).over(expanding(entity, ts))


def bfill(value: str, entity: Names, ts: Names) -> Column:
    return F.first(value, ignorenulls=True).over(following(entity, ts))


def ffill_limited(df: DataFrame, entity: Names, ts: str, value: str, limit: int, name: str = "filled") -> DataFrame:
    """Carried forward over at most ``limit`` missing rows."""
    placed = gap_position(df, entity, ts, value, "__place")
    return placed.withColumn(name, F.when(F.col("__place") <= limit, ffill(value, entity, ts))).drop("__place")


def bfill_limited(df: DataFrame, entity: Names, ts: str, value: str, limit: int, name: str = "filled") -> DataFrame:
    """Carried back over at most ``limit`` missing rows."""
    back = series(entity, ts).rowsBetween(0, limit)
    return df.withColumn(name, F.first(value, ignorenulls=True).over(back))


def mean_fill(value: str, entity: Names) -> Column:
    return F.coalesce(F.col(value), F.avg(value).over(whole(entity)))


def linear(value: str, entity: Names, ts: Names, at: Column) -> Column:
    """Linear between neighbours along ``at``. After the last value that value stays, before the first it's null."""
    v, x = F.col(value), at.cast("double")
    pair = F.when(v.isNotNull(), F.struct(v.alias("v"), x.alias("x")))
    prev, nxt = F.last(pair, ignorenulls=True).over(expanding(entity, ts)), F.first(pair, ignorenulls=True).over(following(entity, ts))
    between = prev["v"] + (nxt["v"] - prev["v"]) * (x - prev["x"]) / (nxt["x"] - prev["x"])
    return F.coalesce(v, F.when(nxt.isNull(), prev["v"]).when(prev.isNotNull(), between))


def linear_by_row(df: DataFrame, entity: Names, ts: str, value: str, name: str = "filled") -> DataFrame:
    """:func:`linear` by row number."""
    n = df.withColumn("__n", F.row_number().over(series(entity, ts)))
    return n.withColumn(name, linear(value, entity, ts, F.col("__n"))).drop("__n")


def linear_by_time(df: DataFrame, entity: Names, ts: str, value: str, name: str = "filled") -> DataFrame:
    return df.withColumn(name, linear(value, entity, ts, F.unix_micros(F.col(ts).cast("timestamp"))))


def seasonal_mean(value: str, entity: Names, season: Column) -> Column:
    return F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(*names(entity), season)))


def with_indicator(df: DataFrame, entity: Names, value: str) -> DataFrame:
    """A 0/1 flag of what was missing, and the median in its place."""
    middle = df.groupBy(*names(entity)).agg(F.percentile(value, 0.5).alias("__m"))
    return df.join(middle, names(entity)).withColumns({"was_missing": F.col(value).isNull().cast("int"), "filled": F.coalesce(F.col(value), "__m")}).drop("__m")


def since_observed(value: str, entity: Names, ts: Names) -> Column:
    """Hours since the last value; 0 before any. Of several order columns the first is the time."""
    at = F.unix_micros(F.col(names(ts)[0]).cast("timestamp")) / 3_600_000_000
    seen = F.last(F.when(F.col(value).isNotNull(), at), ignorenulls=True).over(expanding(entity, ts))
    return F.coalesce(at - seen, F.lit(0.0))


def natural_spline(y: np.ndarray) -> np.ndarray:
    """Natural cubic spline through the known places of an array; outside of them the nearest value."""
    known = np.flatnonzero(~np.isnan(y))
    if len(known) < 3:
        return np.interp(np.arange(len(y)), known, y[known]) if len(known) else y
    h = np.diff(known).astype(float)
    slope = np.diff(y[known]) / h
    a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
    m = np.concatenate([[0], np.linalg.solve(a, 6 * np.diff(slope)), [0]])
    x = np.clip(np.arange(len(y)), known[0], known[-1])
    i = np.clip(np.searchsorted(known, x, side="right") - 1, 0, len(h) - 1)
    t, u = x - known[i], known[i + 1] - x
    return m[i] * u**3 / (6 * h[i]) + m[i + 1] * t**3 / (6 * h[i]) + (y[known][i] / h[i] - m[i] * h[i] / 6) * u + (y[known][i + 1] / h[i] - m[i + 1] * h[i] / 6) * t


def knn_fill(y: np.ndarray, k: int = 5, lags: int = 3) -> np.ndarray:
    """Mean of the values at the ``k`` places whose neighbourhood is most like the missing place's."""
    base = pd.Series(y).interpolate(limit_direction="both").to_numpy()
    pad = np.pad(base, lags, mode="edge")
    around = np.stack([pad[lags + s : lags + s + len(y)] for s in range(-lags, lags + 1) if s], 1)
    known, out = np.flatnonzero(~np.isnan(y)), y.copy()
    for i in np.flatnonzero(np.isnan(y)):
        far = ((around[known] - around[i]) ** 2).sum(1)
        near = known[np.argsort(far, kind="stable")[:k]]
        out[i] = y[near].mean() if len(near) else np.nan
    return out


def by_series(df: DataFrame, entity: Names, ts: str, value: str, fill, name: str = "filled") -> DataFrame:  # noqa: ANN001
    """An array function over each entity's values in order, one entity at a time. For methods that no window expresses."""
    keys = names(entity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        return pdf.assign(**{name: fill(pdf[value].to_numpy(float))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*keys).applyInPandas(run, f"{fields}, `{name}` double")
