"""Queries that fit models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions.windows import series
from chronolake.operators import backtest, boosting, explain, features, learn, spine
from chronolake.session import shared_folder
from chronolake.plans.catalog import daily, query, rounded, table
from chronolake.plans.watch_queries import HOURS, hours, least_squares

LAGS = ["lag_1", "lag_7", "roll_mean_7", "day_of_week"]


def supervised(spark: SparkSession, d: str) -> DataFrame:
    x = daily(spark, d)
    cols = features.lags("value", "entity", "ts", [1, 7]) | {"roll_mean_7": features.rolling("value", "entity", "ts", [7])["roll_mean_7"], "day_of_week": spine.calendar_parts("ts")["day_of_week"]}
    return x.select("entity", "ts", "value", *(c.alias(k) for k, c in cols.items()), (F.row_number().over(series("entity", "ts")) - 1).alias("t")).na.drop()


@query()
def global_ridge(spark: SparkSession, d: str) -> DataFrame:
    x = supervised(spark, d)
    cut = F.lit("2000-01-01").cast("date")
    return learn.predicted(learn.regressor("ridge", LAGS, "value").fit(x.where(F.col("ts") < cut)), x.where(F.col("ts") >= cut)).select("entity", "ts", "value", "prediction")


@query()
def global_boosted(spark: SparkSession, d: str) -> DataFrame:
    x = supervised(spark, d)
    cut = F.lit("2000-01-01").cast("date")
    return learn.predicted(learn.regressor("boosted", LAGS, "value").fit(x.where(F.col("ts") < cut)), x.where(F.col("ts") >= cut)).select("entity", "ts", "value", "prediction")


@query()
def quantile_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Three quantiles of each day from 2000 on, from trees fitted on the days before, beside the plain quantiles of these."""
    x = supervised(spark, d)
    model = boosting.fit(x.where("ts < DATE '2000-01-01'"), LAGS, "value", [0.1, 0.5, 0.9], trees=6)
    later = boosting.predict(x.where("ts >= DATE '2000-01-01'"), model)
    return later.select("entity", "ts", "value", *(F.col("quantiles")[i].alias(f"q_{p}") for i, p in enumerate((10, 50, 90))), *(F.lit(b).alias(f"plain_{p}") for b, p in zip(model.base, (10, 50, 90), strict=True)))


@query()
def boosted_contributions(spark: SparkSession, d: str) -> DataFrame:
    """What each feature adds to each prediction of boosted trees."""
    x = supervised(spark, d)
    model = learn.regressor("boosted", LAGS, "value").fit(x.where("ts < DATE '2000-01-01'"))
    found = explain.contributions(model, x.where("ts >= DATE '2000-01-01'"), LAGS)
    return found.select("entity", "ts", "prediction", "base", *(F.col("contributions")[i].alias(f"from_{c}") for i, c in enumerate(LAGS)))


@query()
def stacked_folds(spark: SparkSession, d: str) -> DataFrame:
    x = supervised(spark, d)
    n = x.agg(F.max("t")).first()[0] + 1
    oof = learn.out_of_fold(x, backtest.expanding_folds(n, 4, n // 5), "t", LAGS, "value", ["ridge", "forest"])
    w = learn.blend_weights(oof, ["p_ridge", "p_forest"], "value")
    return oof.select("entity", "t", "value", "p_ridge", "p_forest", sum(F.lit(v) * F.col(k) for k, v in w.items()).alias("blend"))


CHANNELS = ("click", "view", "purchase")
TERMS = ["one", *(f"{c}_{k}" for k in (1, 2) for c in CHANNELS)]


@query(f"""
WITH RECURSIVE {HOURS}, x AS (SELECT 'a' AS g, CAST(1 AS DOUBLE) AS one, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CHANNELS)}, {", ".join(f"CAST(lag({c}, {k}) OVER (ORDER BY ts) AS DOUBLE) AS {c}_{k}" for k in (1, 2) for c in CHANNELS)} FROM h), v AS (SELECT * FROM x WHERE click_2 IS NOT NULL),
{", ".join(least_squares(f"r_{c}", "v", TERMS, c) for c in CHANNELS)}
{" UNION ALL ".join(f"SELECT '{c}' AS channel, CAST(unnest(range(0, {len(TERMS)})) AS INT) AS term, round(unnest(coef), 6) + 0.0 AS coefficient FROM r_{c}" for c in CHANNELS)}""")
def vector_autoregression(spark: SparkSession, d: str) -> DataFrame:
    names = ["click", "view", "purchase"]
    c = learn.vector_autoregression(hours(spark, d), "ts", names, 2)
    rows = [(names[i], j, float(v)) for i, r in enumerate(c) for j, v in enumerate(r)]
    return rounded(spark.createDataFrame(rows, "channel string, term int, coefficient double"))


@query()
def series_clusters(spark: SparkSession, d: str) -> DataFrame:
    return learn.clusters(table(spark, d, "embeddings"), "embedding", 10).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))


@query()
def linked_clusters(spark: SparkSession, d: str) -> DataFrame:
    return learn.linked_clusters(table(spark, d, "embeddings"), "embedding", 10).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))


@query()
def shape_clusters(spark: SparkSession, d: str) -> DataFrame:
    return learn.shape_clusters(table(spark, d, "embeddings"), "embedding", 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_other FROM (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ts, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE)) AS i FROM (SELECT DISTINCT o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders) x) y WHERE i > 7")
def reloaded_model(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of a model and of what is read back from its written form: rows, and rows that differ."""
    x = supervised(spark, d)
    model = learn.regressor("ridge", LAGS, "value").fit(x)
    again = learn.reloaded(model, shared_folder(spark, "model"))
    both = learn.predicted(again, learn.predicted(model, x).withColumnRenamed("prediction", "first"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("first").eqNullSafe(F.col("prediction"))).alias("n_other"))


@query()
def calibrated_quality(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("n_chars").cast("double").alias("score"))
    return learn.calibrated(s.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0), s, "quality", "score").select("doc_id", "quality", "p")
