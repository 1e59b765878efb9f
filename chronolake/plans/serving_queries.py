"""Queries of forecasts from state, and of features that expire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.plans.catalog import no_zone, query, rounded, table
from chronolake.streaming import serving


@query("""
WITH g AS (SELECT user_id, event_id, ts, value, CASE WHEN ts - lag(ts) OVER o > INTERVAL 1 DAY THEN 1 ELSE 0 END AS anew FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(anew) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stretch FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id) - 1 AS known FROM s),
f AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, avg(known) OVER w AS t, covar_pop(value, known) OVER w / nullif(var_pop(known) OVER w, 0) AS b FROM k WINDOW w AS (PARTITION BY user_id, stretch ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, ts, round(value, 4) + 0.0 AS value, known, CASE WHEN n >= 5 THEN round(m + b * (known - t), 4) + 0.0 END AS forecast, CASE WHEN n >= 5 THEN round(b, 4) + 0.0 END AS slope FROM f""")
def served_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Each event's value as its user's last twelve foretell it, a user silent for a day starting anew."""
    e = table(spark, d, "events")
    out = serving.serve_table(e, "user_id", ["ts", "event_id"], "value", keep=12, least=5, expiry_ms=86_400_000)
    return rounded(out.withColumn("ts", no_zone(F.col("ts"))), 4)


@query("""
WITH n AS (SELECT user_id, max(ts) AS ts, arg_max(value, {'a': ts, 'b': event_id}) AS value, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type FROM events GROUP BY 1), a AS (SELECT c_custkey AS user_id, (SELECT max(ts) FROM events) AS now FROM customer)
SELECT a.user_id, round(n.value, 6) + 0.0 AS value, event_type, n.user_id IS NOT NULL AS found FROM a LEFT JOIN n ON n.user_id = a.user_id AND n.ts > now - INTERVAL 12 HOUR""")
def online_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Newest features of every customer at the end of the events, none of them over twelve hours old."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value", "event_type")
    newest = e.groupBy("user_id").agg(F.max_by(F.struct("ts", "value", "event_type"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return rounded(serving.lookup(asked, newest, "user_id", "ts", "now", "12 HOURS", ["value", "event_type"]).drop("now"))
