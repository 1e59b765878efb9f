"""Time buckets: downsampling, upsampling, profiles. A bucket is labelled by its start unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names, series
from chronolake.operators import spine as sp


def bucket(ts: str | Column, unit: str) -> Column:
    """Start of the bucket: left-closed, left-labelled."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(unit, c)


def week_ending_sunday(ts: str) -> Column:
    """Right-closed, right-labelled weeks: the Sunday that ends the week."""
    return F.date_add(F.to_date(F.date_trunc("week", F.col(ts))), 6)


def right_closed(ts: str, step: str) -> Column:
    """End of a right-closed bucket of a fixed length: a time on the edge belongs to the bucket that it ends."""
    w = F.window(F.expr(f"cast({ts} as timestamp) - interval 1 microsecond"), step)
    return w.getField("end")


def local_day(ts: str, zone: str) -> Column:
    """Day of a UTC time in a time zone."""
    return F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))


STATS = ("sum", "mean", "min", "max", "count", "std", "median", "first", "last", "range")


def stats(value: str, ts: str, which: Sequence[str] = STATS) -> list[Column]:
    """Aggregates named after what they are; std is that of a sample, first and last go by time."""
    v = F.col(value)
    every = {
        "sum": F.sum(v),
        "mean": F.avg(v),
        "min": F.min(v),
        "max": F.max(v),
        "count": F.count(v),
        "std": F.stddev_samp(v),
        "median": F.percentile(v, 0.5),
        "first": F.min_by(v, F.col(ts)),
        "last": F.max_by(v, F.col(ts)),
        "range": F.max(v) - F.min(v),
    }
    return [every[k].alias(k) for k in which]


def downsample(df: DataFrame, entity: Names, ts: str, value: str, unit: str, which: Sequence[str] = ("sum",)) -> DataFrame:
    """One row per entity and bucket with the named aggregates. Partial sums go into the shuffle, not rows."""
    at = bucket(ts, unit).alias("bucket")
    return df.groupBy(*names(entity), at).agg(*stats(value, ts, which))


def by_rules(df: DataFrame, entity: Names, at: Column, rules: dict[str, Column]) -> DataFrame:
    """A rule per column, in one pass."""
    return df.groupBy(*names(entity), at.alias("bucket")).agg(*(c.alias(k) for k, c in rules.items()))


def ohlc(df: DataFrame, entity: Names, ts: Names, price: str, at: Column, volume: str | None = None) -> DataFrame:
    """Open, high, low, close by time (further order columns break ties), and the summed volume."""
    order = F.struct(*names(ts))
    p = F.col(price)
    rules = [F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close")]
    if volume:
        rules.append(F.sum(volume).alias("volume"))
    return df.groupBy(*names(entity), at.alias("bucket")).agg(*rules)


def with_empty_buckets(df: DataFrame, entity: Names, at: str, value: str, step: str, empty: float | None = 0.0) -> DataFrame:
    """Buckets laid on a spine; an empty one's value is ``empty``: 0 for sums, null for means."""
    laid = sp.on_spine(df, entity, at, step)
    return laid if empty is None else laid.withColumn(value, F.coalesce(value, F.lit(empty)))


def upsample(df: DataFrame, entity: Names, ts: str, step: str = "1 day") -> DataFrame:
    """Rows at every step up to the last time; values stay null between. Fill them with an imputation."""
    return sp.on_spine(df, entity, ts, step)


def spread_over_month(value: str, month: str) -> Column:
    """A month's total as an equal share of each of its days."""
    return F.col(value) / F.dayofmonth(F.last_day(F.col(month)))


def profile(df: DataFrame, entity: Names, part: Column, value: str) -> DataFrame:
    """Mean by a part of the calendar, such as the hour."""
    return df.groupBy(*names(entity), part.alias("part")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def aligned(fine: DataFrame, coarse: DataFrame, fine_ts: str, coarse_ts: str, value: str, entity: Names = ()) -> DataFrame:
    """Each fine row with the coarse value (of its entity) whose period it lies in: an equi-join on the month, not a range join."""
    keys = names(entity)
    c = coarse.select(*keys, F.to_date(F.date_trunc("month", coarse_ts)).alias("__m"), F.col(value))
    return fine.withColumn("__m", F.to_date(F.date_trunc("month", fine_ts))).join(c, [*keys, "__m"], "left").drop("__m")


def rolled(df: DataFrame, entity: Names, at: str, value: str, size: int, name: str = "rolled") -> DataFrame:
    """Trailing sum over buckets, null until ``size`` of them are there."""
    w = series(entity, at).rowsBetween(-(size - 1), 0)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) == size, F.sum(value).over(w)))
