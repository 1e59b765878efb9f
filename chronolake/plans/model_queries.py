"""Queries on aggregation, forecasts, backtests, metrics, hierarchies and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.functions import metrics, scalars
from chronolake.functions.windows import series
from chronolake.operators import anomaly, backtest, forecast, hierarchy, probabilistic
from chronolake.operators.quantile import exact_quantiles
from chronolake.plans.catalog import DAILY, MONTHLY, daily, monthly, query, rounded, table

#: A weekly-seasonal and a plain naive forecast of daily revenue by priority, beside what came.
BASELINES = f"""{DAILY},
bl AS (SELECT entity, ts, value AS y, lag(value, 7) OVER w AS f7, lag(value, 1) OVER w AS f1 FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts)),
b AS (SELECT *, f7 - y AS e7, f1 - y AS e1 FROM bl WHERE f7 IS NOT NULL)"""
#: Days that quantiles of errors are taken from, and the days since, on which they are scored.
SPLIT = "past AS (SELECT * FROM b WHERE ts < DATE '1996-01-01'), later AS (SELECT * FROM b WHERE ts >= DATE '1996-01-01')"


def baselines(spark: SparkSession, d: str) -> DataFrame:
    w = series("entity", "ts")
    b = daily(spark, d).select("entity", "ts", F.col("value").alias("y"), F.lag("value", 7).over(w).alias("f7"), F.lag("value", 1).over(w).alias("f1")).where("f7 is not null")
    return b.withColumns({"e7": F.col("f7") - F.col("y"), "e1": F.col("f1") - F.col("y")})


# ---------------------------------------------------------------- aggregation

HIERARCHY = """
base AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS value
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def hierarchy_rows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # Nations and regions are the fixed few of the data model, customers aren't.
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"))


@query(f"""
WITH {HIERARCHY}
SELECT region, nation, segment, year, round(sum(value), 2) AS value, CASE WHEN grouping(region) = 1 AND grouping(nation) = 1 AND grouping(segment) = 1 THEN 'total'
 ELSE concat_ws('/', CASE WHEN grouping(region) = 0 THEN 'region' END, CASE WHEN grouping(nation) = 0 THEN 'nation' END, CASE WHEN grouping(segment) = 0 THEN 'segment' END) END AS level
FROM base GROUP BY GROUPING SETS ((year), (region, year), (region, nation, year), (region, nation, segment, year), (segment, year))""")
def hierarchy_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = [[], ["region"], ["region", "nation"], ["region", "nation", "segment"], ["segment"]]
    return rounded(hierarchy.levels(hierarchy_rows(spark, d), sets, "year", "value").select("region", "nation", "segment", "year", "value", "level"), 2)


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 4) AS weighted_price, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
 count(DISTINCT l_partkey) AS n_parts, round(skewness(l_quantity), 6) + 0.0 AS skew, round(kurtosis(l_quantity), 5) AS kurt, round(mad(l_quantity), 4) AS mad
FROM lineitem GROUP BY 1, 2""")
def aggregate_moments(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    one = li.groupBy(*keys).agg(
        F.sum("l_quantity").alias("sum_qty"),
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity")).alias("weighted_price"),
        F.countDistinct("l_partkey").alias("n_parts"),
        scalars.corrected_skewness(F.col("l_quantity")).alias("skew"),
        scalars.corrected_kurtosis(F.col("l_quantity")).alias("kurt"),
    )
    p90 = exact_quantiles(li, keys, "l_extendedprice", [0.9], "p").select(*keys, F.col("p")[0].alias("p90"))
    mad = anomaly.spread(li, keys, "l_quantity").select(*keys, "mad")
    return rounded(one.join(p90, keys).join(mad, keys), 4, sum_qty=2, skew=6, kurt=5)


@query("""
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def pivot_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "view", "purchase"]).count()
    return e.na.fill(0, ["click", "view", "purchase"])


@query("""
SELECT event_type, CAST(least(floor(value / 10), 20) AS INT) AS bin, count(*) AS n FROM events GROUP BY 1, 2""")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.least(F.floor(F.col("value") / 10), F.lit(20)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1 ORDER BY revenue DESC, o_custkey LIMIT 20")
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return r.orderBy(F.desc("revenue"), "o_custkey").limit(20)


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey + 1000 FROM nation EXCEPT SELECT s_nationkey + 1000 FROM supplier)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, s, n = (table(spark, d, t) for t in ("customer", "supplier", "nation"))
    both = c.select(F.col("c_nationkey").alias("k")).intersect(s.select(F.col("s_nationkey").alias("k")))
    return both.unionByName(n.select((F.col("n_nationkey") + 1000).alias("k")).subtract(s.select((F.col("s_nationkey") + 1000).alias("k"))))


# ---------------------------------------------------------------- forecasts

LAST = f"""{MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, count(*) OVER (PARTITION BY entity) AS n, value - lag(value) OVER (PARTITION BY entity ORDER BY ts) AS d, value - lag(value, 12) OVER (PARTITION BY entity ORDER BY ts) AS d12 FROM monthly),
h AS (SELECT CAST(unnest(generate_series(1, 18)) AS INT) AS step)"""


@query(f"""
WITH {LAST}, a AS (SELECT entity, avg(value) AS mean, arg_max(value, i) AS last, arg_min(value, i) AS first, max(n) AS n, stddev_samp(d) AS s FROM n GROUP BY 1)
SELECT entity, step, round(mean, 6) AS mean, round(last, 4) AS naive, round(last - 1.96 * s * sqrt(step), 2) AS lower, round(last + 1.96 * s * sqrt(step), 2) AS upper, round(last + step * (last - first) / (n - 1), 4) AS drift FROM a CROSS JOIN h""")
def baseline_forecasts(spark: SparkSession, d: str) -> DataFrame:
    m, args = monthly(spark, d), ("entity", "ts", "value", 18)
    keys = ["entity", "step"]
    out = forecast.mean(m, *args).withColumnRenamed("forecast", "mean").join(forecast.naive(m, *args).withColumnRenamed("forecast", "naive"), keys)
    return rounded(out.join(forecast.drift(m, *args).withColumnRenamed("forecast", "drift"), keys), 4, mean=6, lower=2, upper=2)


@query(f"""
WITH {LAST}, s AS (SELECT entity, stddev_samp(d12) AS s, max(n) AS n FROM n GROUP BY 1)
SELECT s.entity, step, round(v.value, 4) AS forecast, round(v.value - 1.96 * s * sqrt(1 + floor((step - 1) / 12)), 2) AS lower, round(v.value + 1.96 * s * sqrt(1 + floor((step - 1) / 12)), 2) AS upper
FROM s CROSS JOIN h JOIN n v ON v.entity = s.entity AND v.i = s.n - 12 + 1 + (step - 1) % 12""")
def seasonal_naive_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.seasonal_naive(monthly(spark, d), "entity", "ts", "value", 18, 12), 4, lower=2, upper=2)


@query(f"""
WITH {LAST}, a AS (SELECT entity, sum(value * pow(0.7, n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.3 END) AS level, regr_slope(value, i - 1) AS b, regr_intercept(value, i - 1) AS a, max(n) AS n FROM n GROUP BY 1)
SELECT entity, step, round(level, 4) AS ses, round(0.5 * (a + b * (n - 1 + step)) + 0.5 * level, 3) AS theta FROM a CROSS JOIN h""")
def ses_theta_forecast(spark: SparkSession, d: str) -> DataFrame:
    m, args = monthly(spark, d), ("entity", "ts", "value", 18)
    out = forecast.ses(m, *args).withColumnRenamed("forecast", "ses").join(forecast.theta(m, *args).withColumnRenamed("forecast", "theta"), ["entity", "step"])
    return rounded(out, 4, theta=3)


#: Monthly quantities of each part, months without any as 0.
PART_MONTHS = """
w AS (SELECT l_partkey AS entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
ends AS (SELECT entity, min(ts) AS lo, max(ts) AS hi FROM w GROUP BY 1), grid AS (SELECT entity, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS ts FROM ends),
laid AS (SELECT g.entity, g.ts, coalesce(w.value, 0) AS value, row_number() OVER (PARTITION BY g.entity ORDER BY g.ts) AS i FROM grid g LEFT JOIN w ON w.entity = g.entity AND w.ts = g.ts)"""


@query(f"""
WITH {PART_MONTHS},
gaps AS (SELECT entity, value, i - lag(i, 1, 0) OVER (PARTITION BY entity ORDER BY i) AS g FROM laid WHERE value > 0),
a AS (SELECT entity, avg(g) AS adi, pow(stddev_pop(value) / avg(value), 2) AS cv2, count(*) AS n_demands FROM gaps GROUP BY 1)
SELECT entity, round(adi, 6) AS adi, round(cv2, 6) AS cv2, n_demands, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS class FROM a""")
def demand_classes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.demand_class(part_months(spark, d), "entity", "ts", "value"))


def part_months(spark: SparkSession, d: str) -> DataFrame:
    from chronolake.operators import resample

    w = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("ts")).agg(F.sum("l_quantity").alias("value"))
    return resample.with_empty_buckets(w, "entity", "ts", "value", "1 month")


@query(f"""
WITH RECURSIVE {LAST}, r AS (SELECT entity, i, n, value AS level, CAST(0 AS DOUBLE) AS trend FROM n WHERE i = 1 UNION ALL
 SELECT n.entity, n.i, n.n, 0.3 * n.value + 0.7 * (r.level + CASE WHEN r.i = 1 THEN n.value - r.level ELSE r.trend END), 0.1 * (0.3 * n.value + 0.7 * (r.level + CASE WHEN r.i = 1 THEN n.value - r.level ELSE r.trend END) - r.level) + 0.9 * CASE WHEN r.i = 1 THEN n.value - r.level ELSE r.trend END FROM r JOIN n ON n.entity = r.entity AND n.i = r.i + 1)
SELECT entity, step, round(level + step * trend, 3) AS forecast FROM r CROSS JOIN h WHERE i = n""")
def holt_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.per_series(monthly(spark, d), "entity", "ts", "value", 18, forecast.holt()).drop("failed"), 3)


@query(f"""
WITH RECURSIVE {PART_MONTHS}, n AS MATERIALIZED (SELECT *, max(i) OVER (PARTITION BY entity) AS n FROM laid),
r AS (SELECT entity, i, n, CASE WHEN value > 0 THEN 0.1 * value + 0.9 * value ELSE 1.0 END AS size, CAST(CASE WHEN value > 0 THEN 1.0 ELSE 0.45 END AS DOUBLE) AS chance FROM n WHERE i = 1 UNION ALL
 SELECT n.entity, n.i, n.n, CASE WHEN n.value > 0 THEN 0.1 * n.value + 0.9 * r.size ELSE r.size END, CASE WHEN n.value > 0 THEN 0.1 + 0.9 * r.chance ELSE 0.9 * r.chance END FROM r JOIN n ON n.entity = r.entity AND n.i = r.i + 1)
SELECT entity, CAST(step AS INT) AS step, round(size * chance, 6) AS forecast FROM r CROSS JOIN (SELECT unnest(generate_series(1, 3)) AS step) h WHERE i = n""")
def croston_tsb(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.tsb(part_months(spark, d), "entity", "ts", "value", 3))


@query(f"""
WITH RECURSIVE {MONTHLY}, y AS MATERIALIZED (SELECT entity, list(value ORDER BY ts) AS y, CAST(count(*) AS INT) AS n FROM monthly GROUP BY 1 HAVING count(*) >= 24), grid AS (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c FROM (VALUES (0.1), (0.3), (0.5), (0.8)) p(a) CROSS JOIN (VALUES (0.01), (0.1), (0.3)) q(b) CROSS JOIN (VALUES (0.05), (0.2), (0.5)) r(c)),
h AS (SELECT entity, a, b, c, 0 AS i, list_avg(y[1:12]) AS level, (list_avg(y[13:24]) - list_avg(y[1:12])) / 12 AS trend, list_transform(y[1:12], lambda v: v - list_avg(y[1:12])) AS season, CAST(0 AS DOUBLE) AS sse FROM y CROSS JOIN grid
 UNION ALL SELECT entity, a, b, c, i + 1, nl, b * (nl - level) + (1 - b) * trend, list_transform(range(1, 13), lambda k: CASE WHEN k = i % 12 + 1 THEN c * (v - nl) + (1 - c) * season[k] ELSE season[k] END), sse + pow(v - (level + trend + season[i % 12 + 1]), 2) FROM (SELECT h.*, y.y[h.i + 1] AS v, a * (y.y[h.i + 1] - season[h.i % 12 + 1]) + (1 - a) * (level + trend) AS nl FROM h JOIN y ON y.entity = h.entity WHERE h.i < y.n) x),
f AS (SELECT h.*, row_number() OVER (PARTITION BY h.entity ORDER BY sse, a, b, c) AS o FROM h JOIN y ON y.entity = h.entity AND h.i = y.n), t AS (SELECT entity, i, level, trend, season, CAST(unnest(range(1, 13)) AS INT) AS step FROM f WHERE o = 1)
SELECT entity, step, round(level + step * trend + season[(i + step - 1) % 12 + 1], 2) AS forecast, false AS failed FROM t""")
def holt_winters_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.per_series(monthly(spark, d), "entity", "ts", "value", 12, forecast.holt_winters(12)), 2)


@query()
def auto_smoothing_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecast.per_series(monthly(spark, d), "entity", "ts", "value", 12, forecast.auto_smoothing(12))


@query()
def arima_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecast.per_series(monthly(spark, d), "entity", "ts", "value", 12, forecast.auto_arima())


@query()
def recursive_direct_forecast(spark: SparkSession, d: str) -> DataFrame:
    m, args = monthly(spark, d), ("entity", "ts", "value", 12)
    out = forecast.per_series(m, *args, forecast.recursive([1, 2, 3, 12])).withColumnsRenamed({"forecast": "recursive", "failed": "recursive_failed"})
    return out.join(forecast.per_series(m, *args, forecast.direct([1, 2, 3, 12], 1e-3, 3)).withColumnsRenamed({"forecast": "direct", "failed": "direct_failed"}), ["entity", "step"])


@query(f"""
WITH RECURSIVE {MONTHLY}, n AS MATERIALIZED (SELECT entity, value, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, count(*) OVER (PARTITION BY entity) AS n, var_pop(value) OVER (PARTITION BY entity) + 1e-9 AS s FROM monthly),
k AS (SELECT entity, CAST(0 AS BIGINT) AS i, value AS level, s AS v FROM n WHERE i = 1 UNION ALL SELECT n.entity, n.i, k.level + (k.v + 0.1 * n.s) / (k.v + 1.1 * n.s) * (n.value - k.level), (k.v + 0.1 * n.s) * (1 - (k.v + 0.1 * n.s) / (k.v + 1.1 * n.s)) FROM k JOIN n ON n.entity = k.entity AND n.i = k.i + 1),
e AS (SELECT k.entity, k.level FROM k JOIN n ON n.entity = k.entity AND n.i = k.i WHERE n.i = n.n)
SELECT entity, CAST(unnest(range(1, 7)) AS INT) AS step, round(level, 3) AS forecast, false AS failed FROM e""")
def local_level_forecast(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.per_series(monthly(spark, d), "entity", "ts", "value", 6, forecast.local_level()), 3)


# ---------------------------------------------------------------- backtests

REGION_DAYS = """
s AS (SELECT n_regionkey AS entity, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
ends AS (SELECT entity, min(ts) AS lo, max(ts) AS hi FROM s GROUP BY 1), grid AS (SELECT entity, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ts FROM ends),
n AS MATERIALIZED (SELECT g.entity, g.ts, coalesce(s.v, 0) AS y, row_number() OVER (PARTITION BY g.entity ORDER BY g.ts) AS i, count(*) OVER (PARTITION BY g.entity) AS n FROM grid g LEFT JOIN s ON s.entity = g.entity AND s.ts = g.ts),
m AS MATERIALIZED (SELECT *, abs(y - lag(y) OVER (PARTITION BY entity ORDER BY i)) AS d FROM n)"""


def region_days(spark: SparkSession, d: str) -> DataFrame:
    from chronolake.operators import resample

    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    s = o.groupBy(F.col("n_regionkey").alias("entity"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    return resample.with_empty_buckets(s, "entity", "ts", "value", "1 day")


@query(f"""
WITH {REGION_DAYS}, k AS (SELECT unnest(generate_series(0, 3)) AS k), t AS (SELECT entity, n - 14 - k * 28 AS o, y, i, d FROM m CROSS JOIN k WHERE n - 14 - k * 28 >= 100 AND i <= n - 14 - k * 28),
a AS MATERIALIZED (SELECT entity, o, arg_max(y, i) AS naive, arg_min(y, i) AS first, sum(y * pow(0.7, o - i) * CASE WHEN i = 1 THEN 1 ELSE 0.3 END) AS ses, regr_slope(y, i) AS b, regr_intercept(y, i) AS a, avg(d) AS scale FROM t GROUP BY 1, 2),
h AS (SELECT unnest(generate_series(1, 14)) AS h), p AS MATERIALIZED (SELECT a.*, h, o + h AS at_i, o - 6 + (h - 1) % 7 AS last_i FROM a CROSS JOIN h),
f AS MATERIALIZED (SELECT p.*, l.y AS sn, x.y AS actual FROM p JOIN n x ON x.entity = p.entity AND x.i = p.at_i JOIN n l ON l.entity = p.entity AND l.i = p.last_i),
g AS (SELECT 'naive' AS model, naive AS f, actual, scale FROM f UNION ALL SELECT 'seasonal_naive', sn, actual, scale FROM f UNION ALL SELECT 'drift', naive + h * (naive - first) / (o - 1), actual, scale FROM f
 UNION ALL SELECT 'ses', ses, actual, scale FROM f UNION ALL SELECT 'theta', 0.5 * (a + b * (o + h)) + 0.5 * ses, actual, scale FROM f),
r AS (SELECT model, count(*) AS n, avg(abs(f - actual)) AS mae, sqrt(avg((f - actual) * (f - actual))) AS rmse, avg(abs(f - actual) / scale) AS mase FROM g GROUP BY 1)
SELECT model, n, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(mase, 6) AS mase, round(1 - mae / (SELECT mae FROM r WHERE model = 'naive'), 6) + 0.0 AS gain FROM r""")
def backtest_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    scored = backtest.closed_form(region_days(spark, d), "entity", "ts", "value", 14, 7, 28, 100, 4)
    return rounded(backtest.leaderboard(scored), 6, mae=3, rmse=3)


@query()
def backtest_any_model(spark: SparkSession, d: str) -> DataFrame:
    models = {"holt": forecast.holt(), "ar": forecast.recursive([1, 7])}
    return backtest.per_series(region_days(spark, d), "entity", "ts", "value", models, lambda n: backtest.origins(n, 300, 14, 3), 14)


@query(f"""
WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS t FROM monthly), c AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM n), f AS (SELECT *, n - (3 - fold) * 6 AS s FROM c CROSS JOIN (SELECT CAST(unnest(generate_series(0, 2)) AS INT) AS fold) k)
SELECT entity, ts, CAST(t AS INT) AS t, fold, CASE WHEN t < s - 2 THEN 'train' ELSE 'test' END AS part FROM f WHERE t < s - 2 OR t BETWEEN s AND s + 5""")
def fold_rows(spark: SparkSession, d: str) -> DataFrame:
    return backtest.tail_folds(monthly(spark, d), "entity", "ts", 3, 6, 2).select("entity", "ts", F.col("t").cast("int"), "fold", "part")


# ---------------------------------------------------------------- metrics


@query(f"""
WITH {BASELINES}
SELECT entity, count(*) AS n, round(avg(abs(e7)), 6) AS mae, round(avg(e7 * e7) / 1e6, 2) AS mse, round(sqrt(avg(e7 * e7)), 3) AS rmse, round(avg(abs(e7) / (abs(y) + 1e-8)), 6) AS mape, round(avg(abs(e7) / ((abs(y) + abs(f7)) / 2 + 1e-8)), 6) AS smape,
 round(quantile_cont(abs(e7), 0.5), 4) AS mdae, round(sum(abs(e7)) / sum(abs(y)), 6) AS wmape, round(avg(e7), 6) + 0.0 AS bias, round(max(abs(e7)), 4) AS max_error FROM b GROUP BY 1""")
def metric_report(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.report(baselines(spark, d), "entity", "y", "f7").withColumn("mse", F.col("mse") / 1e6)
    return rounded(r, 6, mse=2, rmse=3, mdae=4, max_error=4)


@query(f"""
WITH {BASELINES}, s AS (SELECT entity, avg(abs(d)) AS scale FROM (SELECT entity, value - lag(value) OVER (PARTITION BY entity ORDER BY ts) AS d FROM daily) x GROUP BY 1)
SELECT entity, round(avg(abs(e7)), 6) AS mae, round(any_value(scale), 6) AS scale, round(avg(abs(e7)) / any_value(scale), 6) AS mase FROM b JOIN s USING (entity) GROUP BY 1""")
def mase_by_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.mase(baselines(spark, d), metrics.naive_scale(daily(spark, d), "entity", "ts", "value"), "entity", "y", "f7"))


@query(f"""
WITH {BASELINES} SELECT entity, round(1 - avg(abs(e7)) / avg(abs(e1)), 6) + 0.0 AS skill, round(avg(CASE WHEN abs(e7) < abs(e1) THEN 1.0 ELSE 0 END), 6) AS pct_better, round(sqrt(avg(e7 * e7)) / sqrt(avg(e1 * e1)), 6) AS relative_rmse FROM b GROUP BY 1""")
def skill_scores(spark: SparkSession, d: str) -> DataFrame:
    e7, e1 = F.abs("e7"), F.abs("e1")
    out = baselines(spark, d).groupBy("entity").agg(metrics.skill(F.avg(e7), F.avg(e1)).alias("skill"), F.avg((e7 < e1).cast("double")).alias("pct_better"), (F.sqrt(F.avg(e7 * e7)) / F.sqrt(F.avg(e1 * e1))).alias("relative_rmse"))
    return rounded(out)


@query("""
WITH s AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id))
SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 6) AS auc, (SELECT count(*) FILTER (WHERE y = 1) FROM s) AS n_positive, (SELECT count(*) FILTER (WHERE y = 0) FROM s) AS n_negative FROM s a JOIN s b ON a.y = 1 AND b.y = 0""")
def auc_roc(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", F.col("n_chars").cast("double").alias("score"))
    return rounded(metrics.auc(s, "quality", "score"))


@query("""
WITH s AS (SELECT quality AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT y, p, count(*) AS n FROM s GROUP BY 1, 2),
k AS (SELECT y AS k, sum(n) AS r, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM c GROUP BY 1), q AS (SELECT p AS k, sum(n) AS s FROM c GROUP BY 1)
SELECT round(sum(tp) / sum(r), 6) AS accuracy, round(avg(2.0 * tp / (r + coalesce(s, 0))), 6) AS macro_f1 FROM k LEFT JOIN q USING (k)""")
def confusion_f1(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", (F.col("n_chars") > 1000).cast("int").alias("p"))
    return rounded(metrics.macro_f1(s, "quality", "p"))


# ---------------------------------------------------------------- hierarchies

BOTTOM = f"{HIERARCHY}, bo AS (SELECT region || '/' || nation AS bottom, region, year, sum(value) AS value FROM base GROUP BY 1, 2, 3)"


def bottoms(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy_rows(spark, d).groupBy("region", "nation", "year").agg(F.sum("value").alias("value")).withColumn("bottom", F.concat_ws("/", "region", "nation"))


@query(f"""
WITH {BOTTOM} SELECT 'total' AS node, year, round(sum(value), 2) AS value FROM bo GROUP BY 2 UNION ALL SELECT region, year, round(sum(value), 2) FROM bo GROUP BY 1, 2 UNION ALL SELECT bottom, year, round(value, 2) FROM bo""")
def reconcile_bottom_up(spark: SparkSession, d: str) -> DataFrame:
    b = bottoms(spark, d)
    return rounded(hierarchy.bottom_up(b.select("bottom", "year", "value"), hierarchy.summing(b, ["region", "nation"]), "year", "value"), 2)


@query(f"""
WITH {BOTTOM}, t AS (SELECT year, sum(value) AS t FROM bo GROUP BY 1), s AS (SELECT bottom, avg(value / t) AS s FROM bo JOIN t USING (year) GROUP BY 1), p AS (SELECT bottom, s / sum(s) OVER () AS share FROM s)
SELECT bottom, year, round(t * share, 2) AS value FROM t CROSS JOIN p""")
def reconcile_top_down(spark: SparkSession, d: str) -> DataFrame:
    b = bottoms(spark, d).select("bottom", "year", "value")
    return rounded(hierarchy.top_down(b.groupBy("year").agg(F.sum("value").alias("value")), hierarchy.proportions(b, "year", "value"), "year", "value"), 2)


#: Forecasts that don't add up: the total a tenth too high, regions a twentieth too low.
FORECASTS = f"""{BOTTOM}, ye AS (SELECT DISTINCT year FROM bo), ni AS (SELECT DISTINCT bottom, region FROM bo), al AS (SELECT ni.bottom, ni.region, ye.year, coalesce(bo.value, 0) AS y FROM ni CROSS JOIN ye LEFT JOIN bo ON bo.bottom = ni.bottom AND bo.year = ye.year),
fr AS (SELECT region, year, 0.95 * sum(y) AS y, count(*) AS n FROM al GROUP BY 1, 2), ft AS (SELECT year, 1.1 * sum(y) AS y FROM al GROUP BY 1)"""


def forecasts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All nodes' forecasts by year, and the summing matrix; a nation without orders in a year counts as 0."""
    b = bottoms(spark, d)
    laid = b.select("region", "nation", "bottom").distinct().join(F.broadcast(b.select("year").distinct())).join(b.select("bottom", "year", "value"), ["bottom", "year"], "left").na.fill(0.0, ["value"])
    m = hierarchy.summing(b, ["region", "nation"])
    nodes = hierarchy.bottom_up(laid.select("bottom", "year", "value"), m, "year", "value")
    factor = F.when(F.col("node") == "total", 1.1).when(~F.col("node").contains("/"), 0.95).otherwise(1.0)
    return nodes.withColumn("value", F.col("value") * factor), m


@query(f"""
WITH {FORECASTS}, gr AS (SELECT fr.year, max(abs(fr.y - s.s)) AS g FROM fr JOIN (SELECT region, year, sum(y) AS s FROM al GROUP BY 1, 2) s ON s.region = fr.region AND s.year = fr.year GROUP BY 1), gt AS (SELECT ft.year, abs(ft.y - s.s) AS g FROM ft JOIN (SELECT year, sum(y) AS s FROM al GROUP BY 1) s ON s.year = ft.year),
c AS (SELECT al.bottom, al.region, al.year, al.y + fr.y + ft.y AS c, fr.n FROM al JOIN fr ON fr.region = al.region AND fr.year = al.year JOIN ft ON ft.year = al.year),
r AS (SELECT region, year, sum(c) AS c, any_value(n) AS n FROM c GROUP BY 1, 2), t AS (SELECT year, sum(c / (1 + n)) / (1 + sum(n / (1.0 + n))) AS t FROM r GROUP BY 1), rr AS (SELECT r.region, r.year, (c - n * t) / (1 + n) AS r, t FROM r JOIN t ON t.year = r.year),
b AS (SELECT c.bottom, c.region, c.year, c.c - rr.r - rr.t AS b FROM c JOIN rr ON rr.region = c.region AND rr.year = c.year),
ar AS (SELECT rr.year, max(abs(rr.r - b.s)) AS g, max(t) AS t, sum(rr.r) AS r FROM rr JOIN (SELECT region, year, sum(b) AS s FROM b GROUP BY 1, 2) b ON b.region = rr.region AND b.year = rr.year GROUP BY 1)
SELECT gr.year, greatest(gr.g, gt.g) < 0.01 AS coherent_before, greatest(ar.g, abs(ar.t - ar.r)) < 0.01 AS coherent FROM gr JOIN gt ON gr.year = gt.year JOIN ar ON ar.year = gr.year""")
def coherence_check(spark: SparkSession, d: str) -> DataFrame:
    nodes, m = forecasts(spark, d)
    before = hierarchy.incoherence(nodes, m, "year", "value", 1e-2).select("year", F.col("coherent").alias("coherent_before"))
    return before.join(hierarchy.incoherence(hierarchy.reconcile(nodes, m, "year", "value"), m, "year", "value", 1e-2).select("year", "coherent"), "year")


@query(f"""
WITH {FORECASTS}, c AS (SELECT al.bottom, al.region, al.year, al.y + fr.y + ft.y AS c, fr.n FROM al JOIN fr ON fr.region = al.region AND fr.year = al.year JOIN ft ON ft.year = al.year),
r AS (SELECT region, year, sum(c) AS c, any_value(n) AS n FROM c GROUP BY 1, 2), t AS (SELECT year, sum(c / (1 + n)) / (1 + sum(n / (1.0 + n))) AS t FROM r GROUP BY 1), rr AS (SELECT r.region, r.year, (c - n * t) / (1 + n) AS r, t FROM r JOIN t ON t.year = r.year),
b AS (SELECT c.bottom, c.region, c.year, c.c - rr.r - rr.t AS b FROM c JOIN rr ON rr.region = c.region AND rr.year = c.year)
SELECT bottom AS node, year, round(b, 2) + 0.0 AS value FROM b UNION ALL SELECT region, year, round(sum(b), 2) + 0.0 FROM b GROUP BY 1, 2 UNION ALL SELECT 'total', year, round(sum(b), 2) + 0.0 FROM b GROUP BY 2""")
def reconcile_least_squares(spark: SparkSession, d: str) -> DataFrame:
    nodes, m = forecasts(spark, d)
    return rounded(hierarchy.reconcile(nodes, m, "year", "value"), 2)


@query(f"""
WITH {BOTTOM}, p AS (SELECT bottom, region, sum(value) AS s FROM bo GROUP BY 1, 2), q AS (SELECT bottom, region, s / sum(s) OVER (PARTITION BY region) AS share FROM p), m AS (SELECT region, year, sum(value) AS m FROM bo GROUP BY 1, 2)
SELECT bottom, year, round(m * share, 2) AS value FROM m JOIN q ON q.region = m.region""")
def reconcile_middle_out(spark: SparkSession, d: str) -> DataFrame:
    b = bottoms(spark, d)
    middle = b.groupBy(F.col("region").alias("node"), "year").agg(F.sum("value").alias("value"))
    return rounded(hierarchy.middle_out(middle, hierarchy.shares_within(b, "region", "value"), "year", "value"), 2)


@query(f"""
WITH {BOTTOM}, t AS (SELECT year, sum(value) AS t FROM bo GROUP BY 1), a AS (SELECT bottom, avg(value) AS a FROM bo GROUP BY 1), p AS (SELECT bottom, a / sum(a) OVER () AS share FROM a)
SELECT bottom, year, round(t * share, 2) AS value FROM t CROSS JOIN p""")
def reconcile_top_down_by_averages(spark: SparkSession, d: str) -> DataFrame:
    b = bottoms(spark, d).select("bottom", "year", "value")
    return rounded(hierarchy.top_down(b.groupBy("year").agg(F.sum("value").alias("value")), hierarchy.proportions(b, "year", "value", True), "year", "value"), 2)


@query(f"""
WITH {BOTTOM}, r AS (SELECT region AS node, year, sum(value) AS y FROM bo GROUP BY 1, 2), f AS (SELECT node, year, y, lag(y) OVER (PARTITION BY node ORDER BY year) AS a, avg(y) OVER (PARTITION BY node ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r)
SELECT 'last' AS method, node, round(avg(abs(a - y)), 3) AS mae FROM f WHERE a IS NOT NULL GROUP BY 2 UNION ALL SELECT 'mean', node, round(avg(abs(b - y)), 3) FROM f WHERE b IS NOT NULL GROUP BY 2""")
def node_errors_by_method(spark: SparkSession, d: str) -> DataFrame:
    r = bottoms(spark, d).groupBy(F.col("region").alias("node"), "year").agg(F.sum("value").alias("value"))
    w = series("node", "year")
    f = r.select("node", "year", F.lag("value").over(w).alias("last"), F.avg("value").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("mean")).unpivot(["node", "year"], ["last", "mean"], "method", "value")
    return rounded(hierarchy.node_errors(f.where("value is not null"), r, "year", "value"), 3)


# ---------------------------------------------------------------- intervals


@query(f"""
WITH {BASELINES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC) AS back FROM b), k AS (SELECT entity, abs(e7) AS s FROM r WHERE back > 200), n AS (SELECT entity, count(*) AS n FROM k GROUP BY 1),
o AS (SELECT k.entity, s, n, row_number() OVER (PARTITION BY k.entity ORDER BY s) - 1 AS i FROM k JOIN n USING (entity)), q AS (SELECT entity, n, least(1, ceil(0.9 * (n + 1)) / n) * (n - 1) AS pos FROM n),
w AS (SELECT o.entity, sum(CASE WHEN i = floor(pos) THEN s * (1 - (pos - floor(pos))) WHEN i = floor(pos) + 1 THEN s * (pos - floor(pos)) ELSE 0 END) AS width FROM o JOIN q USING (entity) GROUP BY 1)
SELECT entity, count(*) AS n, round(any_value(width), 3) AS width, round(avg(CASE WHEN y BETWEEN f7 - width AND f7 + width THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(2 * width + 20.0 * CASE WHEN y < f7 - width THEN f7 - width - y WHEN y > f7 + width THEN y - f7 - width ELSE 0 END), 3) AS winkler
FROM r JOIN w USING (entity) WHERE back <= 200 GROUP BY 1""")
def split_conformal(spark: SparkSession, d: str) -> DataFrame:
    r = baselines(spark, d).withColumn("back", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("ts"))))
    out = probabilistic.conformal(r.where("back > 200"), r.where("back <= 200"), "entity", "y", "f7", 0.1)
    rep = out.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width"), F.avg(probabilistic.covered("y", "lower", "upper")).alias("coverage"), F.avg(probabilistic.interval_score("y", "lower", "upper", 0.1)).alias("winkler"))
    return rounded(rep, 3, coverage=6)


@query(f"""
WITH {BASELINES}, s AS (SELECT *, abs(e7) AS s FROM b), w AS (SELECT entity, ts, CASE WHEN count(s) OVER v = 50 THEN quantile_cont(s, 0.92) OVER v END AS width FROM s WINDOW v AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
SELECT entity, ts, round(width, 3) AS width FROM w""")
def enbpi_sliding(spark: SparkSession, d: str) -> DataFrame:
    return rounded(probabilistic.sliding_conformal(baselines(spark, d), "entity", "ts", "y", "f7", 50, 0.1).select("entity", "ts", "width"), 3)


@query(f"""
WITH {BASELINES}, {SPLIT}, q AS (SELECT entity, quantile_cont(-e7, 0.05) AS a, quantile_cont(-e7, 0.5) AS m, quantile_cont(-e7, 0.95) AS z FROM past GROUP BY 1),
l AS (SELECT b.entity, ts, y, f7 + a AS q, 0.05 AS tau FROM later b JOIN q USING (entity) UNION ALL SELECT b.entity, ts, y, f7 + m, 0.5 FROM later b JOIN q USING (entity) UNION ALL SELECT b.entity, ts, y, f7 + z, 0.95 FROM later b JOIN q USING (entity))
SELECT CAST(tau AS DOUBLE) AS tau, count(*) AS n, round(avg(CASE WHEN y <= q THEN 1.0 ELSE 0 END), 6) AS empirical, round(avg(CASE WHEN y >= q THEN tau * (y - q) ELSE (tau - 1) * (y - q) END), 4) AS pinball FROM l GROUP BY 1""")
def pinball_reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(probabilistic.reliability(quantiles(spark, d), "tau", "y", "q"), 4, tau=2, empirical=6)


def split(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The days before 1996 and the days since."""
    return b.where("ts < DATE '1996-01-01'"), b.where("ts >= DATE '1996-01-01'")


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    past, later = split(baselines(spark, d))
    levels = [0.05, 0.5, 0.95]
    q = exact_quantiles(past, "entity", -F.col("e7"), levels, "p")
    tau = F.explode(F.array(*(F.struct(F.lit(t).alias("tau"), F.lit(i).alias("i")) for i, t in enumerate(levels)))).alias("l")
    return later.join(q, "entity").select("entity", "ts", "y", "f7", "p", tau).select("entity", "ts", "y", F.col("l.tau").alias("tau"), (F.col("f7") + F.element_at("p", F.col("l.i") + 1)).alias("q"))


@query(f"""
WITH {BASELINES}, {SPLIT}, q AS (SELECT entity, quantile_cont(-e7, 0.05) AS a, quantile_cont(-e7, 0.5) AS m, quantile_cont(-e7, 0.95) AS z FROM past GROUP BY 1),
l AS (SELECT b.entity, ts, y, f7 + a AS q, 0.05 AS tau, 0.25 AS w FROM later b JOIN q USING (entity) UNION ALL SELECT b.entity, ts, y, f7 + m, 0.5, 0.45 FROM later b JOIN q USING (entity) UNION ALL SELECT b.entity, ts, y, f7 + z, 0.95, 0.25 FROM later b JOIN q USING (entity))
SELECT entity, ts, round(sum(2 * w * CASE WHEN y >= q THEN tau * (y - q) ELSE (tau - 1) * (y - q) END), 7) AS crps FROM l GROUP BY 1, 2""")
def crps_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(probabilistic.crps_quantiles(quantiles(spark, d), ["entity", "ts"], "tau", "y", "q"), 7)


CRPS = f"""
WITH {BASELINES}, x AS (SELECT entity, e7 AS x, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM b), s AS MATERIALIZED (SELECT * FROM x)
SELECT a.entity, round(avg(abs(a.x)) - 0.5 * (SELECT avg(abs(p.x - q.x)) FROM s p JOIN s q ON p.entity = q.entity WHERE p.entity = a.entity), 3) AS crps FROM s a GROUP BY 1"""


@query(CRPS)
def crps_samples(spark: SparkSession, d: str) -> DataFrame:
    b = baselines(spark, d)
    return rounded(probabilistic.crps_samples(b.withColumn("zero", F.lit(0.0)), "entity", "zero", "e7"), 3)


@query(CRPS)
def crps_samples_whole(spark: SparkSession, d: str) -> DataFrame:
    """As :func:`crps_samples`, days without a forecast left out first."""
    return rounded(probabilistic.crps_samples(baselines(spark, d).where("e7 is not null").withColumn("zero", F.lit(0.0)), "entity", "zero", "e7"), 3)


@query(f"""
WITH RECURSIVE {BASELINES}, p AS MATERIALIZED (SELECT entity, ts, y, f7, abs(y - f7) AS s, CAST(row_number() OVER w - 1 AS INT) AS i, list_sort(list(abs(y - f7)) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS past FROM b WINDOW w AS (PARTITION BY entity ORDER BY ts)),
r AS (SELECT entity, 20 AS i, CAST(0.1 AS DOUBLE) AS a FROM p WHERE i = 20
 UNION ALL SELECT entity, i + 1, least(0.99, greatest(0.01, a + 0.01 * (0.1 - CASE WHEN s > lo + (place - floor(place)) * (hi - lo) THEN 1 ELSE 0 END))) FROM (SELECT r.entity, r.i, r.a, p.s, (1 - r.a) * (r.i - 1) AS place, p.past[CAST(floor((1 - r.a) * (r.i - 1)) AS INT) + 1] AS lo, p.past[CAST(ceil((1 - r.a) * (r.i - 1)) AS INT) + 1] AS hi FROM r JOIN p ON p.entity = r.entity AND p.i = r.i) x),
w AS (SELECT p.*, a, past[CAST(floor((1 - a) * (p.i - 1)) AS INT) + 1] + ((1 - a) * (p.i - 1) - floor((1 - a) * (p.i - 1))) * (past[CAST(ceil((1 - a) * (p.i - 1)) AS INT) + 1] - past[CAST(floor((1 - a) * (p.i - 1)) AS INT) + 1]) AS width FROM p LEFT JOIN r ON r.entity = p.entity AND r.i = p.i)
SELECT entity, ts, round(y, 3) AS y, round(f7, 3) AS f7, round(a, 6) AS alpha_t, round(f7 - width, 6) AS lower, round(f7 + width, 6) AS upper FROM w""")
def adaptive_conformal(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 days of an entity have no interval yet: null. Bounds have up to five decimals, so six digits round no half."""
    out = probabilistic.adaptive_conformal(baselines(spark, d).select("entity", "ts", "y", "f7"), "entity", "ts", "y", "f7")
    return rounded(out.select("entity", "ts", "y", "f7", *(F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("alpha_t", "lower", "upper"))), 6, y=3, f7=3)


@query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    return probabilistic.bootstrap_interval(baselines(spark, d).select("entity", "e7"), "entity", "e7", 14)
