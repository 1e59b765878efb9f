"""Checks on series tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names, series


def report(df: DataFrame, entity: Names, ts: str, value: str) -> DataFrame:
    """Per entity: bounds, rows, missing values, repeated times, distances between neighbours, moments."""
    keys = names(entity)
    before = F.lag(ts).over(series(entity, ts))
    step = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1_000_000
    seen = df.select(*keys, ts, value, step.alias("step"))
    v = F.col(value)
    return seen.groupBy(*keys).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(v.isNull()).alias("n_missing"),
        F.count_if(F.col("step") == 0).alias("n_duplicate_ts"),
        F.min("step").alias("least_step"),
        F.max("step").alias("greatest_step"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )


def schema_checks(df: DataFrame, entity: Names, ts: str, value: str, low: float, high: float, most_null_pct: float = 10.0) -> DataFrame:
    """One row: how many rows break each rule, and whether all hold."""
    keys = [*names(entity), ts]
    # A pair of entity and time that occurs n times counts n - 1 times.
    pairs = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("known"), F.count_if((F.col(value) < low) | (F.col(value) > high)).alias("out"))
    one = pairs.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum("out").alias("n_out_of_range"), (100.0 * (1 - F.sum("known") / F.sum("n"))).alias("null_pct"))
    return one.withColumn("passed", (F.col("n_duplicates") == 0) & (F.col("n_out_of_range") == 0) & (F.col("null_pct") <= most_null_pct))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table, if it has the columns."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {', '.join(absent)}")
    return df


def fill_error(original: DataFrame, filled: DataFrame, keys: Names, value: str, name: str) -> DataFrame:
    """Mean absolute and root mean square error of filled values where the original is known."""
    e = F.col(name) - F.col(value)
    both = original.select(*names(keys), value).join(filled.select(*names(keys), name), names(keys)).where(e.isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
