"""The queries, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions.scalars import clean_round

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *digits: int, **by_name: int) -> DataFrame:
    """Every double rounded: to the given number of digits, six by default, or as named."""
    n = digits[0] if digits else 6
    return df.select(*(clean_round(F.col(c), by_name.get(c, n)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def no_zone(c: Column) -> Column:
    return c.cast("timestamp_ntz")


# ---------------------------------------------------------------- series made of the tables

#: Daily revenue by order priority, only days with orders.
DAILY = "daily AS (SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)"
#: Daily revenue of all orders.
TOTAL = "total AS (SELECT 'all' AS entity, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 2)"
#: Monthly revenue by order priority.
MONTHLY = "monthly AS (SELECT o_orderpriority AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)"
#: Events by user and day with gaps: days without events are there without a count.
USER_DAYS = """
ud AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS value FROM events GROUP BY 1, 2),
ends AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM ud GROUP BY 1),
grid AS (SELECT user_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
laid AS (SELECT g.user_id, g.day, u.n, u.value FROM grid g LEFT JOIN ud u ON g.user_id = u.user_id AND g.day = u.day)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))


def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.lit("all").alias("entity"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("entity"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("ts")).agg(F.sum("o_totalprice").alias("value"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
