"""Regular time axes: spines, gaps against them, calendar parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions.scalars import cyclical
from chronolake.functions.windows import Names, names, series, whole


def spine(df: DataFrame, entity: Names, ts: str, step: str = "1 day") -> DataFrame:
    """Every step from each entity's first to its last time, one row each."""
    keys = names(entity)
    ends = df.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return ends.select(*keys, F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias(ts))


def common_spine(df: DataFrame, entity: Names, ts: str, step: str = "1 day") -> DataFrame:
    """Every step between the first and last time of all, for each entity."""
    keys = names(entity)
    ends = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    grid = ends.select(F.expr(f"sequence(lo, hi, interval {step})").alias("steps"))
    # One row of bounds goes to every entity; the steps come out on the executors.
    return df.select(*keys).distinct().join(F.broadcast(grid)).select(*keys, F.explode("steps").alias(ts))


def on_spine(df: DataFrame, entity: Names, ts: str, step: str = "1 day", common: bool = False) -> DataFrame:
    """The rows laid on their spine: columns are null where a step has no row."""
    grid = (common_spine if common else spine)(df, entity, ts, step)
    return grid.join(df, [*names(entity), ts], "left")


def completeness(df: DataFrame, entity: Names, ts: str, step: str = "1 day", common: bool = False) -> DataFrame:
    """Per entity: steps expected and present, gaps, percent complete, first and last gap."""
    keys = names(entity)
    present = df.select(*keys, ts).distinct().withColumn("here", F.lit(1))
    laid = (common_spine if common else spine)(df, entity, ts, step).join(present, [*keys, ts], "left")
    gap = F.when(F.col("here").isNull(), F.col(ts))
    n = F.count(F.lit(1))
    return laid.groupBy(*keys).agg(
        n.alias("n_expected"),
        F.count("here").alias("n_actual"),
        (n - F.count("here")).alias("n_gaps"),
        F.round(100.0 * F.count("here") / n, 4).alias("pct_complete"),
        F.min(gap).alias("first_gap"),
        F.max(gap).alias("last_gap"),
    )


def gap_runs(df: DataFrame, entity: Names, ts: str, value: str) -> DataFrame:
    """Runs of consecutive rows without a value: start, end, length."""
    keys = names(entity)
    run = df.withColumn("run", F.count(value).over(series(entity, ts))).where(F.col(value).isNull())
    return run.groupBy(*keys, "run").agg(F.min(ts).alias("gap_start"), F.max(ts).alias("gap_end"), F.count(F.lit(1)).alias("gap_length")).drop("run")


def gap_position(df: DataFrame, entity: Names, ts: str, value: str, name: str = "gap_position") -> DataFrame:
    """0 on a row with a value, else its place in its run of missing rows."""
    run = df.withColumn("__run", F.count(value).over(series(entity, ts)))
    place = F.row_number().over(series([*names(entity), "__run"], ts)) - F.when(F.col("__run") > 0, 1).otherwise(0)
    return run.withColumn(name, F.when(F.col(value).isNotNull(), 0).otherwise(place)).drop("__run")


def frequency(df: DataFrame, entity: Names, ts: str) -> DataFrame:
    """The most frequent distance of neighbours in seconds, the smaller of equally frequent ones."""
    keys = names(entity)
    step = (F.col(ts).cast("timestamp").cast("long") - F.lag(F.col(ts).cast("timestamp").cast("long")).over(series(entity, ts))).alias("seconds")
    counts = df.select(*keys, step).where("seconds is not null").groupBy(*keys, "seconds").count()
    return counts.groupBy(*keys).agg(F.min_by("seconds", F.struct(-F.col("count"), F.col("seconds"))).alias("seconds"))


def position(entity: Names, ts: Names) -> Column:
    """Row number from 0, for trends and Fourier terms."""
    return F.row_number().over(series(entity, ts)) - 1


def calendar_parts(ts: str) -> dict[str, Column]:
    """Month, day, weekday (Monday 0), and so on, by name."""
    c = F.col(ts)
    return {
        "year": F.year(c),
        "quarter": F.quarter(c),
        "month": F.month(c),
        "week": F.weekofyear(c),
        "day": F.dayofmonth(c),
        "day_of_year": F.dayofyear(c),
        "day_of_week": F.weekday(c),
        "is_weekend": (F.weekday(c) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(c) == 1).cast("int"),
        "is_month_end": (F.to_date(c) == F.last_day(c)).cast("int"),
    }


def cyclical_parts(ts: str) -> dict[str, Column]:
    month, dow = F.month(F.col(ts)), F.weekday(F.col(ts))
    (a, b), (c, d) = cyclical(month, 12), cyclical(dow, 7)
    return {"month_sin": a, "month_cos": b, "dow_sin": c, "dow_cos": d}


def fourier(t: Column, periods: Sequence[float], order: int) -> dict[str, Column]:
    """``order`` pairs of sine and cosine for each period, on a row position."""
    out = {}
    for p in periods:
        for k in range(1, order + 1):
            s, c = cyclical(k * t, p)
            out |= {f"sin_{p:g}_{k}".replace(".", "_"): s, f"cos_{p:g}_{k}".replace(".", "_"): c}
    return out


def forecast_index(df: DataFrame, entity: Names, ts: str, horizon: int, step: str = "1 day") -> DataFrame:
    """The ``horizon`` steps after each entity's last time."""
    keys = names(entity)
    last = df.groupBy(*keys).agg(F.max(ts).alias("last"))
    return last.select(*keys, F.posexplode(F.expr(f"transform(sequence(1, {horizon}), i -> i)")).alias("pos", "step"), "last").select(*keys, "step", F.expr(f"last + step * interval {step}").alias(ts))


def per_entity_count(entity: Names) -> Column:
    return F.count(F.lit(1)).over(whole(entity))


def missing(df: DataFrame, entity: Names, ts: str, step: str = "1 day") -> DataFrame:
    """The steps between an entity's first and last time that have no row."""
    keys = names(entity)
    return spine(df, entity, ts, step).join(df.select(*keys, ts), [*keys, ts], "left_anti")
