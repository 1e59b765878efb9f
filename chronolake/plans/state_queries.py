"""Queries of state-space models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions.windows import series
from chronolake.operators import forecast, impute, statespace
from chronolake.plans.catalog import MONTHLY, monthly, query, rounded


def gapped_months(spark: SparkSession, d: str) -> DataFrame:
    """Monthly revenue in millions by priority; months whose number by series leaves 3 or 4 over 11 are hidden."""
    n = monthly(spark, d).withColumn("t", F.row_number().over(series("entity", "ts")) - 1)
    return n.select("entity", "ts", F.when(~(F.col("t") % 11).isin(3, 4), F.col("value") / 1e6).alias("value"))


@query()
def seasonal_arima_forecast(spark: SparkSession, d: str) -> DataFrame:
    x = monthly(spark, d).withColumn("value", F.col("value") / 1e6)
    return statespace.arima_forecasts(x, "entity", "ts", "value", 12, 1, 0, 12, 1)


@query()
def structural_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecast.per_series(gapped_months(spark, d), "entity", "ts", "value", 12, statespace.structural(True, 12))


@query()
def structural_gaps(spark: SparkSession, d: str) -> DataFrame:
    return statespace.structural_fill(gapped_months(spark, d), "entity", "ts", "value", True, 12)


@query(f"""
WITH RECURSIVE {MONTHLY}, n AS MATERIALIZED (SELECT entity, ts, CASE WHEN (row_number() OVER w - 1) % 11 NOT IN (3, 4) THEN value / 1e6 END AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY entity) AS n FROM monthly WINDOW w AS (PARTITION BY entity ORDER BY ts)),
f AS (SELECT entity, i, y AS a0, CAST(1 AS DOUBLE) AS p0, y AS a, CAST(1 AS DOUBLE) AS p FROM n WHERE i = 1
 UNION ALL SELECT n.entity, n.i, f.a, f.p + 0.1, CASE WHEN n.y IS NULL THEN f.a ELSE f.a + (f.p + 0.1) / (f.p + 1.1) * (n.y - f.a) END, CASE WHEN n.y IS NULL THEN f.p + 0.1 ELSE (1 - (f.p + 0.1) / (f.p + 1.1)) * (f.p + 0.1) END FROM f JOIN n ON n.entity = f.entity AND n.i = f.i + 1),
g AS MATERIALIZED (SELECT * FROM f), b AS (SELECT g.entity, g.i, g.a AS s FROM g JOIN n ON n.entity = g.entity AND n.i = g.i WHERE n.i = n.n UNION ALL SELECT g.entity, g.i, g.a + g.p / h.p0 * (b.s - h.a0) FROM b JOIN g ON g.entity = b.entity AND g.i = b.i - 1 JOIN g h ON h.entity = b.entity AND h.i = b.i)
SELECT n.entity, n.ts, round(s, 5) AS value FROM n JOIN b ON b.entity = n.entity AND b.i = n.i""")
def smoothed_level(spark: SparkSession, d: str) -> DataFrame:
    """A local level of fixed variances from all months before and after, hidden ones included."""
    return rounded(impute.by_series(gapped_months(spark, d), "entity", "ts", "value", lambda y: statespace.level_smoothing(y, 1.0, 0.1)).select("entity", "ts", F.col("filled").alias("value")), 5)
