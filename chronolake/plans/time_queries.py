"""Queries on resampling, gaps, imputation, features, joins and decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions.windows import series
from chronolake.operators import decompose, features, impute, joins, resample, spine, validate
from chronolake.plans.catalog import DAILY, MONTHLY, TOTAL, USER_DAYS, daily, monthly, no_zone, query, rounded, table, total, user_days


@query("""
SELECT event_type AS entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, round(min(value), 6) AS min,
 round(max(value), 6) AS max, count(value) AS count, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median, round(arg_min(value, ts), 6) AS first, round(arg_max(value, ts), 6) AS last, round(max(value) - min(value), 6) AS range
FROM events GROUP BY 1, 2""")
def resample_daily_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_type", "entity")
    return rounded(resample.downsample(e, "entity", "ts", "value", "day", resample.STATS).withColumn("bucket", no_zone(F.col("bucket"))))


@query("""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, round(arg_min(value, event_id), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, event_id), 6) AS close, round(sum(value), 6) AS volume
FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events) x GROUP BY 1""".replace("arg_min(value, event_id)", "arg_min(value, rn)").replace("arg_max(value, event_id)", "arg_max(value, rn)"))
def resample_ohlc_hourly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.ohlc(table(spark, d, "events"), [], ["ts", "event_id"], "value", no_zone(resample.bucket("ts", "hour")), "value"))


@query("""
SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS bucket, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) / count(*) AS price, max(l_linenumber) AS lines, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def resample_multi_rule_monthly(spark: SparkSession, d: str) -> DataFrame:
    # A sum of cents is exact once rounded, so both engines divide the same number.
    rules = {"quantity": F.round(F.sum("l_quantity"), 2), "price": F.round(F.sum("l_extendedprice"), 2) / F.count(F.lit(1)), "lines": F.max("l_linenumber"), "n": F.count(F.lit(1))}
    return resample.by_rules(table(spark, d, "lineitem"), "l_returnflag", F.to_date(F.date_trunc("month", "l_shipdate")), rules)


@query("""
SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week_ending, round(sum(o_totalprice), 4) AS value, count(*) AS n FROM orders GROUP BY 1""")
def resample_weekly_sun_label(spark: SparkSession, d: str) -> DataFrame:
    at = resample.week_ending_sunday("o_orderdate").alias("week_ending")
    return rounded(table(spark, d, "orders").groupBy(at).agg(F.sum("o_totalprice").alias("value"), F.count(F.lit(1)).alias("n")), 4)


@query("""
SELECT CAST(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS DATE) AS local_day, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1""")
def resample_tz_daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return rounded(e.groupBy(resample.local_day("ts", "Asia/Kolkata").alias("local_day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")))


@query("""
SELECT CAST(to_timestamp(ceil(epoch_us(ts) / 1e6 / 21600) * 21600) AS TIMESTAMP) AS bucket_end, count(*) AS n FROM events GROUP BY 1""")
def resample_right_closed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(no_zone(resample.right_closed("ts", "6 hours")).alias("bucket_end")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {MONTHLY},
ends AS (SELECT entity, min(ts) AS lo, max(ts) AS hi FROM monthly GROUP BY 1),
grid AS (SELECT entity, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ts FROM ends),
laid AS (SELECT g.entity, g.ts, m.value, row_number() OVER (PARTITION BY g.entity ORDER BY g.ts) AS n FROM grid g LEFT JOIN monthly m ON g.entity = m.entity AND g.ts = m.ts),
f AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS pv, last_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER w AS pn,
 first_value(value IGNORE NULLS) OVER x AS nv, first_value(CASE WHEN value IS NOT NULL THEN n END IGNORE NULLS) OVER x AS nn FROM laid
 WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT entity, ts, round(pv, 4) AS ffill, round(nv, 4) AS bfill, round(CASE WHEN value IS NOT NULL THEN value WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (n - pn) / (nn - pn) END, 4) AS linear FROM f""")
def upsample_monthly_fills(spark: SparkSession, d: str) -> DataFrame:
    up = resample.upsample(monthly(spark, d), "entity", "ts")
    out = impute.linear_by_row(up, "entity", "ts", "value", "linear").withColumns({"ffill": impute.ffill("value", "entity", "ts"), "bfill": impute.bfill("value", "entity", "ts")})
    return rounded(out.select("entity", "ts", "ffill", "bfill", "linear"), 4)


@query(f"WITH {MONTHLY} SELECT entity, ts, round(value / day(last_day(ts)), 4) AS per_day FROM monthly")
def distribute_month_total(spark: SparkSession, d: str) -> DataFrame:
    return rounded(monthly(spark, d).select("entity", "ts", resample.spread_over_month("value", "ts").alias("per_day")), 4)


@query("SELECT event_type, hour(ts) AS part, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1, 2")
def seasonal_profile_hour(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.profile(table(spark, d, "events"), "event_type", F.hour("ts"), "value"))


@query("""
WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1)
SELECT ts, round(value, 4) AS value, round(CASE WHEN count(*) OVER x = 4 THEN sum(value) OVER x END, 4) AS rolled FROM w WINDOW x AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def resample_then_roll(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    return rounded(resample.rolled(w.withColumn("e", F.lit(1)), "e", "ts", "value", 4).drop("e"), 4)


@query(f"""
WITH {USER_DAYS}
SELECT user_id, day, coalesce(n, 0) AS n, round(coalesce(value, 0), 6) AS value FROM laid""")
def empty_buckets_as_zero(spark: SparkSession, d: str) -> DataFrame:
    laid = spine.on_spine(user_days(spark, d), "user_id", "day")
    return rounded(laid.select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.lit(0.0)).alias("value")))


@query(f"""
WITH {USER_DAYS}
SELECT user_id, count(*) AS n_expected, count(n) AS n_actual, count(*) - count(n) AS n_gaps, round(100.0 * count(n) / count(*), 4) AS pct_complete,
 min(CASE WHEN n IS NULL THEN day END) AS first_gap, max(CASE WHEN n IS NULL THEN day END) AS last_gap FROM laid GROUP BY 1""")
def completeness_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spine.completeness(user_days(spark, d), "user_id", "day"), 4)


@query(f"""
WITH {USER_DAYS},
run AS (SELECT *, count(value) OVER (PARTITION BY user_id ORDER BY day) AS r FROM laid)
SELECT user_id, min(day) AS gap_start, max(day) AS gap_end, count(*) AS gap_length FROM run WHERE value IS NULL GROUP BY user_id, r""")
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    return spine.gap_runs(spine.on_spine(user_days(spark, d), "user_id", "day"), "user_id", "day", "value")


@query(f"""
WITH {USER_DAYS},
run AS (SELECT *, count(value) OVER (PARTITION BY user_id ORDER BY day) AS r FROM laid)
SELECT user_id, day, CASE WHEN value IS NULL THEN row_number() OVER (PARTITION BY user_id, r ORDER BY day) - 1 ELSE 0 END AS gap_position,
 round(CASE WHEN value IS NULL AND row_number() OVER (PARTITION BY user_id, r ORDER BY day) - 1 > 2 THEN NULL ELSE last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END, 6) AS filled FROM run""")
def ffill_limit_gap_position(spark: SparkSession, d: str) -> DataFrame:
    laid = spine.gap_position(spine.on_spine(user_days(spark, d), "user_id", "day"), "user_id", "day", "value")
    out = impute.ffill_limited(laid, "user_id", "day", "value", 2)
    return rounded(out.select("user_id", "day", F.col("gap_position").cast("long"), "filled"))


@query(f"""
WITH {USER_DAYS}
SELECT user_id, day, round(coalesce(value, avg(value) OVER (PARTITION BY user_id, isodow(day))), 6) AS seasonal, round(coalesce(value, avg(value) OVER (PARTITION BY user_id)), 6) AS mean_fill,
 CASE WHEN value IS NULL THEN 1 ELSE 0 END AS was_missing, round(coalesce(value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id)), 6) AS filled FROM laid""")
def impute_seasonal_mean_median(spark: SparkSession, d: str) -> DataFrame:
    laid = spine.on_spine(user_days(spark, d), "user_id", "day")
    out = impute.with_indicator(laid, "user_id", "value").withColumns({"seasonal": impute.seasonal_mean("value", "user_id", F.weekday("day")), "mean_fill": impute.mean_fill("value", "user_id")})
    return rounded(out.select("user_id", "day", "seasonal", "mean_fill", "was_missing", "filled"))


@query("""
WITH m AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events),
f AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM m)
SELECT event_id, round(coalesce((epoch_us(ts) - epoch_us(seen)) / 3600000000.0, 0), 6) AS hours FROM f""")
def hours_since_observed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return rounded(e.select("event_id", impute.since_observed("value", "user_id", ["ts", "event_id"]).alias("hours")))


@query("""
SELECT user_id AS entity, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS n_missing, count(*) FILTER (WHERE step = 0) AS n_duplicate_ts,
 round(min(step), 4) AS least_step, round(max(step), 4) AS greatest_step, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value
FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1000000.0 AS step FROM events) x GROUP BY 1""")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validate.report(table(spark, d, "events").withColumnRenamed("user_id", "entity"), "entity", "ts", "value"), 6, least_step=4, greatest_step=4)


@query("""
WITH p AS (SELECT user_id, ts, count(*) AS n, count(value) AS known, count(*) FILTER (WHERE value < 0 OR value > 150) AS o FROM events GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, CAST(sum(o) AS BIGINT) AS n_out_of_range, round(100.0 * (1 - sum(known) / sum(n)), 6) AS null_pct,
 sum(n - 1) = 0 AND sum(o) = 0 AND 100.0 * (1 - sum(known) / sum(n)) <= 10 AS passed FROM p""")
def schema_checks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validate.schema_checks(table(spark, d, "events"), "user_id", "ts", "value", 0.0, 150.0))


@query(f"""
WITH {DAILY}
SELECT entity, ts, round(lag(value, 1) OVER w, 4) AS lag_1, round(lag(value, 7) OVER w, 4) AS lag_7, round(lead(value, 3) OVER w, 4) AS lead_3, round(value - lag(value) OVER w, 4) AS diff, round(value - lag(value, 7) OVER w, 4) AS diff_7,
 round(ln(value) - ln(lag(value) OVER w), 6) AS log_diff, round(value / lag(value) OVER w - 1, 6) AS pct_change FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts)""")
def lag_diff_features(spark: SparkSession, d: str) -> DataFrame:
    cols = features.lags("value", "entity", "ts", [1, 7]) | features.leads("value", "entity", "ts", [3]) | features.differences("value", "entity", "ts", 7)
    return rounded(daily(spark, d).select("entity", "ts", *(c.alias(k) for k, c in cols.items())), 4, log_diff=6, pct_change=6)


@query(f"""
WITH {DAILY}
SELECT entity, ts, round(CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END, 4) AS roll_mean_7, round(CASE WHEN count(value) OVER w >= 3 THEN stddev_samp(value) OVER w END, 3) AS roll_std_7,
 round(CASE WHEN count(value) OVER w >= 3 THEN min(value) OVER w END, 4) AS roll_min_7, round(CASE WHEN count(value) OVER w >= 3 THEN max(value) OVER w END, 4) AS roll_max_7
FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def rolling_shifted_stats(spark: SparkSession, d: str) -> DataFrame:
    cols = features.rolling("value", "entity", "ts", [7], 3)
    return rounded(daily(spark, d).select("entity", "ts", *(c.alias(k) for k, c in cols.items())), 4, roll_std_7=3)


@query(f"""
WITH {TOTAL}
SELECT ts, round(CASE WHEN count(value) OVER w >= 10 THEN quantile_cont(value, 0.25) OVER w END, 4) AS q25, round(CASE WHEN count(value) OVER w >= 10 THEN quantile_cont(value, 0.5) OVER w END, 4) AS median,
 round(CASE WHEN count(value) OVER w >= 10 THEN quantile_cont(value, 0.75) OVER w END, 4) AS q75, round(CASE WHEN count(value) OVER w >= 10 THEN quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w END, 4) AS iqr
FROM total WINDOW w AS (ORDER BY ts ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)""")
def rolling_quantile_iqr(spark: SparkSession, d: str) -> DataFrame:
    cols = features.rolling_quantiles("value", "entity", "ts", 28, 10)
    return rounded(total(spark, d).select("ts", *(c.alias(k) for k, c in cols.items())), 4)


@query(f"""
WITH {DAILY}
SELECT entity, ts, round(value / avg(value) OVER w, 6) AS vs_mean, round(CASE WHEN count(value) OVER w >= 2 THEN stddev_samp(value) OVER w END, 3) AS exp_std, round(min(value) OVER w, 4) AS exp_min, round(max(value) OVER w, 4) AS exp_max
FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_features(spark: SparkSession, d: str) -> DataFrame:
    cols = features.expanding_stats("value", "entity", "ts")
    e = daily(spark, d).select("entity", "ts", "value", *(c.alias(k) for k, c in cols.items()))
    return rounded(e.select("entity", "ts", (F.col("value") / F.col("exp_mean")).alias("vs_mean"), "exp_std", "exp_min", "exp_max"), 4, vs_mean=6, exp_std=3)


@query(f"""
WITH RECURSIVE {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM monthly),
r AS (SELECT entity, ts, i, value AS e FROM n WHERE i = 1 UNION ALL SELECT n.entity, n.ts, n.i, 0.3 * n.value + 0.7 * r.e FROM r JOIN n ON n.entity = r.entity AND n.i = r.i + 1)
SELECT entity, ts, round(e, 4) AS ewm FROM r""")
def ewm_mean_adjust_false(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.ewm(monthly(spark, d), "entity", "ts", "value", 0.3).select("entity", "ts", "ewm"), 4)


@query(f"""
WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM monthly)
SELECT a.entity, a.ts, round(sum(b.value * pow(0.7, a.i - b.i)) / sum(pow(0.7, a.i - b.i)), 4) AS ewm FROM n a JOIN n b ON a.entity = b.entity AND b.i <= a.i GROUP BY 1, 2""")
def ewm_mean_adjust_true(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.ewm(monthly(spark, d), "entity", "ts", "value", 0.3, adjust=True).select("entity", "ts", "ewm"), 4)


@query(f"""
WITH {TOTAL}, n AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t FROM total)
SELECT ts, CAST(year(ts) AS INT) AS year, CAST(quarter(ts) AS INT) AS quarter, CAST(month(ts) AS INT) AS month, CAST(week(ts) AS INT) AS week, CAST(day(ts) AS INT) AS day, CAST(dayofyear(ts) AS INT) AS day_of_year, CAST(isodow(ts) - 1 AS INT) AS day_of_week,
 CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN day(ts) = 1 THEN 1 ELSE 0 END AS is_month_start, CASE WHEN ts = last_day(ts) THEN 1 ELSE 0 END AS is_month_end,
 round(sin(2 * pi() * month(ts) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) + 0.0 AS month_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS dow_cos,
 round(sin(2 * pi() * t / 7), 6) + 0.0 AS sin_7_1, round(cos(2 * pi() * t / 7), 6) + 0.0 AS cos_7_1, round(sin(2 * pi() * 2 * t / 7), 6) + 0.0 AS sin_7_2, round(cos(2 * pi() * 2 * t / 7), 6) + 0.0 AS cos_7_2 FROM n""")
def calendar_cyclical_fourier(spark: SparkSession, d: str) -> DataFrame:
    n = total(spark, d).withColumn("t", spine.position("entity", "ts"))
    cols = spine.calendar_parts("ts") | spine.cyclical_parts("ts") | spine.fourier(F.col("t"), [7], 2)
    return rounded(n.select("ts", *(c.alias(k) for k, c in cols.items())))


@query("""
WITH g AS (SELECT avg(o_totalprice) AS g FROM orders), t AS (SELECT o_orderpriority AS k, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT o_orderkey, round((n * m + 10 * g) / (n + 10), 4) AS encoded FROM orders JOIN t ON k = o_orderpriority CROSS JOIN g""")
def target_encoding(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.target_encoding(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", 10.0).select("o_orderkey", "encoded"), 4)


@query(f"""
WITH {DAILY}, s AS (SELECT entity, avg(value) AS m, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM daily GROUP BY 1)
SELECT entity, ts, round((value - m) / sd, 6) + 0.0 AS z, round((value - lo) / (hi - lo), 6) + 0.0 AS minmax, round((value - q2) / (q3 - q1), 6) + 0.0 AS robust FROM daily JOIN s USING (entity)""")
def panel_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.scaled(daily(spark, d), "entity", "value").select("entity", "ts", "z", "minmax", "robust"))


@query(f"""
WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS t FROM daily)
SELECT entity, round(avg(value), 4) AS mean, round(stddev_pop(value), 3) AS std, round(stddev_pop(value) / (avg(value) + 1e-8), 6) AS cv, count(value) AS length, round(avg(CASE WHEN value = 0 THEN 1.0 ELSE 0 END), 6) AS sparsity, round(regr_slope(value, t), 4) AS slope FROM n GROUP BY 1""")
def static_series_features(spark: SparkSession, d: str) -> DataFrame:
    n = daily(spark, d).withColumn("t", spine.position("entity", "ts"))
    return rounded(features.static(n, "entity", "value"), 4, std=3, cv=6, sparsity=6)


@query(f"""
WITH {MONTHLY}, n AS (SELECT entity, ts, row_number() OVER w AS n, list(round(value, 2)) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x, list(round(value, 2)) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS y FROM monthly WINDOW w AS (PARTITION BY entity ORDER BY ts))
SELECT entity, ts, round(list_sum(x), 2) AS x_sum, round(list_sum(y), 2) AS y_sum, round(x[1], 2) AS x_first, round(y[3], 2) AS y_last FROM n WHERE len(x) = 6 AND len(y) = 3 AND (n - 6) % 2 = 0""")
def sliding_window_dataset(spark: SparkSession, d: str) -> DataFrame:
    m = monthly(spark, d).withColumn("value", F.round("value", 2))
    w = features.sliding(m, "entity", "ts", "value", 6, 3, 2)
    def add(a):  # noqa: ANN001, ANN202
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    return rounded(w.select("entity", "ts", add(F.col("x")).alias("x_sum"), add(F.col("y")).alias("y_sum"), F.col("x")[0].alias("x_first"), F.col("y")[2].alias("y_last")), 2)


@query(f"""
WITH {TOTAL}, c AS (SELECT ts, value, value - lag(value) OVER (ORDER BY ts) AS change FROM total)
SELECT ts, round(CASE WHEN count(*) OVER w = 20 THEN value / avg(value) OVER w - 1 END, 6) AS price_vs_ma, round(CASE WHEN count(*) OVER w = 20 THEN (value - (avg(value) OVER w - 2 * stddev_samp(value) OVER w)) / (4 * stddev_samp(value) OVER w) END, 5) AS band,
 round(CASE WHEN count(change) OVER v = 14 THEN 100 - 100 / (1 + avg(CASE WHEN change > 0 THEN change ELSE 0 END) OVER v / (avg(CASE WHEN change < 0 THEN -change ELSE 0 END) OVER v + 1e-12)) END, 5) AS rsi,
 round((value - max(value) OVER (ORDER BY ts)) / max(value) OVER (ORDER BY ts), 6) + 0.0 AS drawdown
FROM c WINDOW w AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), v AS (ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def technical_indicators(spark: SparkSession, d: str) -> DataFrame:
    i = features.indicators("value", "entity", "ts")
    t = total(spark, d).select("*", *(c.alias(k) for k, c in i.items()), features.drawdown("value", "entity", "ts").alias("drawdown"))
    return rounded(features.relative_strength(t, "entity", "ts", "change").select("ts", "price_vs_ma", "band", "rsi", "drawdown"), 6, band=5, rsi=5)


@query(f"""
WITH {TOTAL}, n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS t, count(*) OVER w AS k FROM total WINDOW w AS (ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT ts, round(CASE WHEN k = 30 THEN regr_slope(value, t) OVER w END, 3) AS slope FROM n WINDOW w AS (ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rolling_slope(spark: SparkSession, d: str) -> DataFrame:
    n = total(spark, d).withColumns({"t": spine.position("entity", "ts"), "other": F.col("value")})
    return rounded(n.select("ts", features.rolling_pair("value", "other", "entity", "ts", 30)["slope"].alias("slope")), 3)


@query(f"WITH {MONTHLY} SELECT entity, ts, rank() OVER w + (count(*) OVER (PARTITION BY entity, round(value, -5)) - 1) / 2.0 AS rank FROM monthly WINDOW w AS (PARTITION BY entity ORDER BY round(value, -5))")
def average_rank(spark: SparkSession, d: str) -> DataFrame:
    m = monthly(spark, d).withColumn("value", F.round("value", -5))
    return m.select("entity", "ts", features.average_rank("value", "entity").alias("rank"))


@query("SELECT DISTINCT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS code FROM orders")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    return features.codes(table(spark, d, "orders").select("o_orderpriority"), "o_orderpriority").distinct()


@query("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS view_id, user_id, ts AS view_ts, value FROM events WHERE event_type = 'view')
SELECT l.event_id, CASE WHEN r.view_ts >= l.ts - INTERVAL 2 DAY THEN r.view_id END AS view_id, CASE WHEN r.view_ts >= l.ts - INTERVAL 2 DAY THEN round(r.value, 6) END AS value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.view_ts""")
def asof_backward_ttl(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), "value")
    return rounded(joins.as_of(left, right, "user_id", "ts", "view_ts", ["view_id", "value"], max_age="2 days").select("event_id", "view_id", "value"))


@query("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS view_id, user_id, ts AS view_ts FROM events WHERE event_type = 'view')
SELECT l.event_id, r.view_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.view_ts""")
def asof_strict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return joins.as_of(left, right, "user_id", "ts", "view_ts", ["view_id"], strict=True).select("event_id", "view_id")


@query("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS view_id, user_id, ts AS view_ts FROM events WHERE event_type = 'view'),
p AS (SELECT l.event_id, r.view_id, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.view_ts)), r.view_ts) AS n FROM l LEFT JOIN r ON l.user_id = r.user_id)
SELECT event_id, view_id FROM p WHERE n = 1""")
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return joins.as_of_nearest(left, right, "user_id", "ts", "view_ts", ["view_id"]).select("event_id", "view_id")


@query(f"""
WITH {DAILY}, {MONTHLY}
SELECT d.entity, d.ts, round(d.value / m.value, 6) AS share FROM daily d LEFT JOIN monthly m ON d.entity = m.entity AND CAST(date_trunc('month', d.ts) AS DATE) = m.ts""")
def align_frequencies(spark: SparkSession, d: str) -> DataFrame:
    month = monthly(spark, d).select("entity", F.col("ts").alias("m"), F.col("value").alias("month_value"))
    both = resample.aligned(daily(spark, d), month, "ts", "m", "month_value", "entity")
    return rounded(both.select("entity", "ts", (F.col("value") / F.col("month_value")).alias("share")))


@query(f"""
WITH {TOTAL}, n AS (SELECT ts, value, row_number() OVER (ORDER BY ts) AS i FROM total), e AS (SELECT i AS event_index FROM n WHERE value > (SELECT avg(value) + 2 * stddev_samp(value) FROM total))
SELECT e.event_index, CAST(n.i - e.event_index AS BIGINT) AS place, round(n.value, 4) AS value FROM e JOIN n ON n.i BETWEEN e.event_index - 3 AND e.event_index + 2""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    n = total(spark, d).withColumn("i", F.row_number().over(series("entity", "ts")))
    limit = n.agg((F.avg("value") + 2 * F.stddev_samp("value")).alias("x"))
    events = n.join(F.broadcast(limit)).where("value > x").select("entity", "i")
    w = joins.event_windows(n, events, "entity", "i", 3, 2)
    return rounded(w.select(F.col("event_index").cast("long"), (F.col("i") - F.col("event_index")).cast("long").alias("place"), "value"), 4)


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, round(arg_max(value, ts), 6) AS value FROM events GROUP BY 1")
def latest_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(joins.latest(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join_customers(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def _decomposition(op: str) -> str:
    apart, level, rest = ("value - trend", "s.raw - avg(s.raw) OVER (PARTITION BY s.entity)", "value - trend - seasonal") if op == "-" else ("value / trend", "s.raw / avg(s.raw) OVER (PARTITION BY s.entity)", "value / trend / seasonal")
    return f"""
WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS t FROM monthly),
tr AS (SELECT *, CASE WHEN count(value) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN (avg(value) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) + avg(value) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2 END AS trend FROM n),
raw AS (SELECT entity, t % 12 AS s, avg({apart}) AS raw FROM tr GROUP BY 1, 2), sea AS (SELECT s.entity, s.s, {level} AS seasonal FROM raw s),
dec AS (SELECT tr.entity, tr.ts, value, trend, seasonal, {rest} AS resid FROM tr JOIN sea ON tr.entity = sea.entity AND tr.t % 12 = sea.s)"""


@query(_decomposition("-") + " SELECT entity, ts, round(trend, 6) AS trend, round(seasonal, 4) AS seasonal, round(resid, 3) + 0.0 AS resid FROM dec")
def classical_decompose_add(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decompose.classical(monthly(spark, d), "entity", "ts", "value", 12).select("entity", "ts", "trend", "seasonal", "resid"), 4, resid=3, trend=6)


@query(_decomposition("/") + " SELECT entity, ts, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(resid, 6) AS resid FROM dec")
def classical_decompose_mul(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decompose.classical(monthly(spark, d), "entity", "ts", "value", 12, True).select("entity", "ts", "trend", "seasonal", "resid"), 6)


@query(_decomposition("-") + """ SELECT entity, round(greatest(0, 1 - var_samp(resid) / var_samp(CASE WHEN resid IS NOT NULL THEN trend + resid END)), 6) AS trend_strength,
 round(greatest(0, 1 - var_samp(resid) / var_samp(CASE WHEN resid IS NOT NULL THEN seasonal + resid END)), 6) AS seasonal_strength FROM dec GROUP BY 1""")
def decomposition_strength(spark: SparkSession, d: str) -> DataFrame:
    return rounded(decompose.strength(decompose.classical(monthly(spark, d), "entity", "ts", "value", 12), "entity"))


@query()
def stl_decompose(spark: SparkSession, d: str) -> DataFrame:
    return decompose.stl(monthly(spark, d), "entity", "ts", "value", 12)


@query()
def knn_impute(spark: SparkSession, d: str) -> DataFrame:
    laid = spine.on_spine(user_days(spark, d), "user_id", "day")
    return impute.by_series(laid.select("user_id", "day", "value"), "user_id", "day", "value", impute.knn_fill)


@query()
def spline_impute(spark: SparkSession, d: str) -> DataFrame:
    laid = spine.on_spine(user_days(spark, d), "user_id", "day")
    return impute.by_series(laid.select("user_id", "day", "value"), "user_id", "day", "value", impute.natural_spline)
