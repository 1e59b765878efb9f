"""Queries on splits, gaps, fills, features and folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.functions.scalars import clip
from chronolake.functions.windows import series
from chronolake.operators import backtest, features, impute, spine, stats, validate
from chronolake.plans.catalog import DAILY, MONTHLY, TOTAL, USER_DAYS, daily, monthly, no_zone, query, rounded, table, total, user_days
from chronolake.sources import readers
from chronolake.streaming import jobs

# ---------------------------------------------------------------- splits and folds


@query(f"""
WITH {DAILY}, n AS (SELECT entity, ts, (row_number() OVER (PARTITION BY entity ORDER BY ts) - 1) / CAST(count(*) OVER (PARTITION BY entity) AS DOUBLE) AS place FROM daily)
SELECT entity, CASE WHEN place < 0.6 THEN 'train' WHEN place < 0.8 THEN 'calibration' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first, max(ts) AS last FROM n GROUP BY 1, 2""")
def three_way_split(spark: SparkSession, d: str) -> DataFrame:
    p = features.parts(daily(spark, d), "entity", "ts", [0.6, 0.2, 0.2])
    return p.groupBy("entity", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(f"""
WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY entity) AS n FROM monthly), f AS (SELECT *, n - (4 - fold) * 6 AS s FROM n CROSS JOIN (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS fold) k)
SELECT entity, fold, CASE WHEN t < s THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(avg(value), 4) AS mean FROM f WHERE (t < s - 1 AND t >= s - 25) OR t BETWEEN s AND s + 5 GROUP BY 1, 2, 3""")
def fixed_window_folds(spark: SparkSession, d: str) -> DataFrame:
    """Folds whose training rows are the last 24 before a gap of one."""
    f = backtest.tail_folds(monthly(spark, d), "entity", "ts", 4, 6, 1, 24)
    return rounded(f.groupBy("entity", "fold", "part").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), 4)


@query(f"""
WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY entity) AS n FROM monthly), f AS (SELECT *, CAST(floor(n * k / 5.0) AS BIGINT) AS a, CAST(floor(n * (k + 1) / 5.0) AS BIGINT) AS b FROM n CROSS JOIN (SELECT CAST(unnest(generate_series(0, 4)) AS INT) AS k) q)
SELECT entity, k AS fold, CASE WHEN t >= a AND t < b THEN 'validation' ELSE 'train' END AS part, count(*) AS n FROM f WHERE (t >= a AND t < b) OR t < a - 2 OR t >= b + 3 GROUP BY 1, 2, 3""")
def purged_embargo_folds(spark: SparkSession, d: str) -> DataFrame:
    return backtest.purged_rows(monthly(spark, d), "entity", "ts", 5, 2, 3).groupBy("entity", "fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {DAILY}, c AS (SELECT unnest([DATE '1996-01-01', DATE '1997-01-01', DATE '1998-01-01']) AS cutoff), m AS (SELECT entity, cutoff, avg(value) AS f FROM daily JOIN c ON ts < cutoff GROUP BY 1, 2)
SELECT m.entity, m.cutoff, count(*) AS n, round(avg(abs(value - f)), 4) AS mae FROM daily JOIN m ON m.entity = daily.entity WHERE ts >= cutoff AND ts < cutoff + 90 GROUP BY 1, 2""")
def date_cutoff_backtest(spark: SparkSession, d: str) -> DataFrame:
    x = daily(spark, d)
    cuts = spark.createDataFrame([(f"{y}-01-01",) for y in (1996, 1997, 1998)], "c string").select(F.to_date("c").alias("cutoff"))
    both = x.join(F.broadcast(cuts))
    mean = both.where("ts < cutoff").groupBy("entity", "cutoff").agg(F.avg("value").alias("f"))
    test = both.where((F.col("ts") >= F.col("cutoff")) & (F.col("ts") < F.date_add("cutoff", 90))).join(mean, ["entity", "cutoff"])
    return rounded(test.groupBy("entity", "cutoff").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("value") - F.col("f"))).alias("mae")), 4)


# ---------------------------------------------------------------- sources, spines, gaps


@query("SELECT event_id, date_trunc('second', ts) AS by_text, date_trunc('second', ts) AS by_seconds, date_trunc('millisecond', ts) AS by_millis, CAST(date_trunc('second', ts) + INTERVAL 9 HOUR AS TIMESTAMP) AS in_zone FROM events")
def parse_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy/MM/dd HH.mm.ss").alias("text"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    cols = {"by_text": readers.parse_ts("text", fmt="yyyy/MM/dd HH.mm.ss"), "by_seconds": readers.parse_ts("s", "s"), "by_millis": readers.parse_ts("ms", "ms"), "in_zone": readers.parse_ts("s", "s", zone="Asia/Tokyo")}
    return e.select("event_id", *(no_zone(c).alias(k) for k, c in cols.items()))


@query("SELECT o_orderpriority AS entity, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-12-31' GROUP BY 1")
def time_range_scan(spark: SparkSession, d: str) -> DataFrame:
    o = readers.ingest(spark, "parquet", "1995-01-01", "1995-12-31", "o_orderdate", path=f"{d}/orders.parquet")
    return rounded(o.groupBy(F.col("o_orderpriority").alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("value")), 2)


@query(f"WITH {USER_DAYS} SELECT user_id, day FROM laid WHERE n IS NULL")
def missing_days(spark: SparkSession, d: str) -> DataFrame:
    return spine.missing(user_days(spark, d).select("user_id", "day"), "user_id", "day")


@query(f"""
WITH {USER_DAYS}, s AS (SELECT user_id, (epoch(CAST(day AS TIMESTAMP)) - epoch(CAST(lag(day) OVER (PARTITION BY user_id ORDER BY day) AS TIMESTAMP))) AS s FROM ud), c AS (SELECT user_id, s, count(*) AS n FROM s WHERE s IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS k FROM c)
SELECT user_id, CAST(s AS BIGINT) AS seconds FROM r WHERE k = 1""")
def common_distance(spark: SparkSession, d: str) -> DataFrame:
    return spine.frequency(user_days(spark, d), "user_id", "day")


@query(f"WITH {DAILY} SELECT entity, CAST(step AS INT) AS step, max(ts) + CAST(step AS INT) AS ts FROM daily CROSS JOIN (SELECT unnest(generate_series(1, 14)) AS step) h GROUP BY 1, 2")
def forecast_days(spark: SparkSession, d: str) -> DataFrame:
    return spine.forecast_index(daily(spark, d), "entity", "ts", 14).select("entity", "step", F.to_date("ts").alias("ts"))


@query("""
WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1, 2), v AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT coalesce(c.user_id, v.user_id) AS user_id, coalesce(c.day, v.day) AS day, clicks, views FROM c FULL JOIN v ON c.user_id = v.user_id AND c.day = v.day""")
def outer_aligned_days(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    c = e.where("event_type = 'click'").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("clicks"))
    v = e.where("event_type = 'view'").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("views"))
    return c.join(v, ["user_id", "day"], "full")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def deduplicated_events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.deduplicated(table(spark, d, "events"), ["user_id", "event_type"], "ts", "1 hour").select("user_id", "event_type")


# ---------------------------------------------------------------- fills


@query("""
WITH m AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v FROM events), w AS (SELECT *, epoch_us(ts) AS t, last_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER p AS pt, last_value(v IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN v IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER f AS nt, first_value(v IGNORE NULLS) OVER f AS nv
 FROM m WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN nv IS NULL THEN pv WHEN pv IS NOT NULL THEN pv + (nv - pv) * CAST(t - pt AS DOUBLE) / (nt - pt) END, 4) AS filled FROM w""")
def interpolate_by_time(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    return rounded(e.select("event_id", impute.linear("v", "user_id", ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp"))).alias("filled")), 4)


@query(f"""
WITH {USER_DAYS} SELECT user_id, day, round(first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 6) AS filled FROM laid""")
def bfill_two_days(spark: SparkSession, d: str) -> DataFrame:
    laid = spine.on_spine(user_days(spark, d), "user_id", "day")
    return rounded(impute.bfill_limited(laid, "user_id", "day", "value", 2).select("user_id", "day", "filled"))


@query(f"""
WITH {DAILY}, m AS (SELECT entity, ts, value, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM daily), k AS (SELECT *, CASE WHEN i % 9 <> 0 THEN value END AS v FROM m), f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM k)
SELECT count(*) AS n, round(avg(abs(f - value)), 4) AS mae, round(sqrt(avg((f - value) * (f - value))), 4) AS rmse FROM f""")
def fill_errors(spark: SparkSession, d: str) -> DataFrame:
    """How far values carried forward over hidden days are from those days' values."""
    x = daily(spark, d).withColumn("i", F.row_number().over(series("entity", "ts")))
    hidden = x.withColumn("v", F.when(F.col("i") % 9 != 0, F.col("value")))
    filled = hidden.withColumn("f", impute.ffill("v", "entity", "ts"))
    return rounded(validate.fill_error(x, filled, ["entity", "ts"], "value", "f"), 4)


# ---------------------------------------------------------------- features


@query(f"""
WITH {DAILY}, l AS (SELECT *, lag(value, 7) OVER (PARTITION BY entity ORDER BY ts) AS b, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM daily)
SELECT entity, ts, round(CASE WHEN count(*) OVER w = 30 THEN corr(value, b) OVER w END, 5) + 0.0 AS corr FROM l WHERE b IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rolling_correlation(spark: SparkSession, d: str) -> DataFrame:
    l7 = daily(spark, d).withColumns({"b": F.lag("value", 7).over(series("entity", "ts")), "t": F.row_number().over(series("entity", "ts"))}).where("b is not null")
    return rounded(l7.select("entity", "ts", features.rolling_pair("value", "b", "entity", "ts", 30)["corr"].alias("corr")), 5)


@query(f"""
WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM monthly), p AS (SELECT a.entity, a.ts, b.value AS v, pow(0.5, (a.i - b.i) / 6.0) AS w FROM n a JOIN n b ON a.entity = b.entity AND b.i <= a.i),
m AS (SELECT entity, ts, sum(v * w) / sum(w) AS m, sum(w) AS s, sum(w * w) AS q FROM p GROUP BY 1, 2)
SELECT p.entity, p.ts, round(any_value(m), 4) AS ewm, round(CASE WHEN any_value(s * s - q) > 1e-9 THEN sqrt(sum(w * (v - m) * (v - m)) / any_value(s) * any_value(s * s) / any_value(s * s - q)) END, 3) AS ewm_std FROM p JOIN m ON m.entity = p.entity AND m.ts = p.ts GROUP BY 1, 2""")
def ewm_halflife(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.ewm_spread(monthly(spark, d), "entity", "ts", "value", 6).select("entity", "ts", "ewm", "ewm_std"), 4, ewm_std=3)


@query(f"""
WITH {TOTAL}, n AS (SELECT ts, value, lag(value) OVER (ORDER BY ts) AS before FROM total)
SELECT ts, CASE WHEN (month(ts), day(ts)) IN ((1, 1), (7, 4), (11, 11), (12, 25), (12, 26)) THEN 1 ELSE 0 END AS holiday, round(value * before / 1e6, 2) AS product, round(value / (before + 1e-8), 6) AS ratio, round(pow(0.99, date_diff('day', ts, DATE '1999-01-01')), 8) AS weight, round(least(greatest(value, 1e6), 3e6), 4) AS clipped, round(ln(1 + value), 6) AS log1p FROM n""")
def holiday_ratio_weight(spark: SparkSession, d: str) -> DataFrame:
    n = total(spark, d).withColumn("before", F.lag("value").over(series("entity", "ts")))
    both = features.interactions([("value", "before")])
    return rounded(n.select("ts", features.holiday("ts").alias("holiday"), (both["value_x_before"] / 1e6).alias("product"), both["value_per_before"].alias("ratio"), features.age_weight("ts", F.lit("1999-01-01").cast("date"), 0.99).alias("weight"), clip(F.col("value"), 1e6, 3e6).alias("clipped"), F.log1p("value").alias("log1p")), 6, product=2, weight=8, clipped=4)


@query(f"WITH {DAILY} SELECT entity, ts, round(value, 4) AS value, round(value / sum(value) OVER (PARTITION BY entity), 9) AS share FROM daily")
def scale_and_back(spark: SparkSession, d: str) -> DataFrame:
    """Values scaled to z-scores and back, and each one's share of its entity."""
    x = daily(spark, d)
    sizes = x.groupBy("entity").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    z = features.scaled(x, "entity", "value").withColumn("share", features.group_share("value", "entity"))
    return rounded(features.unscaled(z.select("entity", "ts", "z", "share"), sizes, "entity", "z").select("entity", "ts", "value", "share"), 4, share=9)


@query(f"""
WITH {DAILY}, g AS (SELECT (k - 10) / 5.0 AS p FROM (SELECT unnest(generate_series(0, 20)) AS k) q), l AS (SELECT entity, p, -count(*) / 2.0 * ln(var_pop(CASE WHEN abs(p) < 1e-9 THEN ln(value) ELSE (pow(value, p) - 1) / p END)) + (p - 1) * sum(ln(value)) AS l FROM daily CROSS JOIN g GROUP BY 1, 2)
SELECT entity, round(arg_max(p, l), 6) + 0.0 AS power FROM l GROUP BY 1""")
def box_cox_power(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.box_cox_power(daily(spark, d), "entity", "value", [(k - 10) / 5 for k in range(21)]))


@query(f"""
WITH {DAILY}, n AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, value - avg(value) OVER (PARTITION BY entity) AS d FROM daily), g AS (SELECT entity, sum(d * d) AS g0, count(*) AS n FROM n GROUP BY 1),
k AS (SELECT unnest(generate_series(1, 28)) AS lag), s AS (SELECT a.entity, lag, sum(a.d * b.d) AS g FROM n a CROSS JOIN k JOIN n b ON a.entity = b.entity AND b.i = a.i - lag GROUP BY 1, 2), r AS (SELECT entity, lag, g / g0 AS rho FROM s JOIN g USING (entity)), o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(rho) DESC) AS rank FROM r)
SELECT entity, CAST(lag AS INT) AS lag, round(rho, 6) + 0.0 AS rho, CAST(rank AS INT) AS rank FROM o WHERE rank <= 5""")
def lags_by_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    a = stats.acf(daily(spark, d), "entity", "ts", "value", 28).select("entity", "lag", "rho")
    ranked = a.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.abs("rho").desc())))
    return rounded(ranked.where("rank <= 5"))


@query(f"""
WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, ln(value) - ln(lag(value) OVER (PARTITION BY entity ORDER BY ts)) AS r FROM monthly),
e AS (SELECT a.entity, a.ts, a.i, sum(b.value * pow(11 / 13.0, a.i - b.i) * CASE WHEN b.i = 1 THEN 1 ELSE 2 / 13.0 END) - sum(b.value * pow(25 / 27.0, a.i - b.i) * CASE WHEN b.i = 1 THEN 1 ELSE 2 / 27.0 END) AS macd FROM n a JOIN n b ON a.entity = b.entity AND b.i <= a.i GROUP BY 1, 2, 3),
s AS (SELECT a.entity, a.ts, any_value(a.macd) AS macd, sum(b.macd * pow(0.8, a.i - b.i) * CASE WHEN b.i = 1 THEN 1 ELSE 0.2 END) AS sig FROM e a JOIN e b ON a.entity = b.entity AND b.i <= a.i GROUP BY 1, 2),
v AS (SELECT entity, ts, CASE WHEN count(*) OVER w = 20 THEN value / avg(value) OVER w END AS ratio, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w * sqrt(12) END AS vol FROM n WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT s.entity, s.ts, round(macd, 3) + 0.0 AS macd, round(sig, 3) + 0.0 AS macd_signal, round(ratio, 6) AS ratio, round(vol, 6) AS volatility FROM s JOIN v ON v.entity = s.entity AND v.ts = s.ts""")
def market_features(spark: SparkSession, d: str) -> DataFrame:
    m = features.macd(monthly(spark, d), "entity", "ts", "value")
    cols = features.market("value", "entity", "ts", 20, 12)
    x = m.withColumns({k: cols[k] for k in ("log_return", "ratio")})
    vol = features.gated(F.stddev_samp, "log_return", features.trailing("entity", "ts", 20), 20) * math.sqrt(12)
    return rounded(x.select("entity", "ts", "macd", "macd_signal", "ratio", vol.alias("volatility")), 6, macd=3, macd_signal=3)


@query(f"""
WITH {DAILY} SELECT entity, ts, round(lag(value, 7) OVER w, 4) AS lag_7, round(lag(value, 28) OVER w, 4) AS lag_28, round(CASE WHEN count(value) OVER s >= 1 THEN avg(value) OVER s END, 4) AS roll_mean_7, round(CASE WHEN count(value) OVER s >= 2 THEN stddev_samp(value) OVER s END, 4) AS roll_std_7, round(value - lag(value, 7) OVER w, 4) + 0.0 AS diff_7, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(month(ts) AS INT) AS month
FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts), s AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def retail_features(spark: SparkSession, d: str) -> DataFrame:
    b = features.build(daily(spark, d), "entity", "ts", "value", [7, 28], [7], 7, ["day_of_week", "month"])
    return rounded(b.select("entity", "ts", "lag_7", "lag_28", "roll_mean_7", "roll_std_7", "diff_7", "day_of_week", "month"), 4)


@query("""
WITH h AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS v FROM events GROUP BY 1), e AS (SELECT min(ts) AS lo, max(ts) AS hi FROM h), g AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM e), l AS (SELECT CAST(g.ts AS TIMESTAMP) AS ts, coalesce(v, 0) AS v FROM g LEFT JOIN h ON h.ts = g.ts)
SELECT ts, round(v, 6) AS v, round(lag(v, 24) OVER w, 6) AS lag_24, round(lag(v, 168) OVER w, 6) AS lag_168, round(avg(v) OVER (ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 6) AS roll_mean_24, CASE WHEN hour(ts) BETWEEN 8 AND 19 AND isodow(ts) <= 5 THEN 1 ELSE 0 END AS is_peak FROM l WINDOW w AS (ORDER BY ts)""")
def energy_features(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "events").groupBy(F.lit("all").alias("entity"), no_zone(F.date_trunc("hour", "ts")).alias("ts")).agg(F.sum("value").alias("v"))
    laid = spine.on_spine(h, "entity", "ts", "1 hour").withColumn("v", F.coalesce("v", F.lit(0.0)))
    b = features.build(laid, "entity", "ts", "v", [24, 168], [24])
    peak = F.hour("ts").between(8, 19) & (F.weekday("ts") < 5)
    return rounded(b.select("ts", "v", "lag_24", "lag_168", "roll_mean_24", peak.cast("int").alias("is_peak")))
