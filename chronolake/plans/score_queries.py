"""Queries on metrics, tests, intervals, detectors, decisions and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.functions import metrics
from chronolake.functions.windows import series
from chronolake.operators import anomaly, backtest, distance, drift, graph, probabilistic, stats
from chronolake.operators.quantile import exact_quantiles
from chronolake.plans.catalog import DAILY, TOTAL, daily, query, rounded, table, total
from chronolake.plans.model_queries import BASELINES, SPLIT, baselines, quantiles, region_days, split
from chronolake.plans.watch_queries import HOURS, hours
from chronolake.streaming import processors

# ---------------------------------------------------------------- metrics


@query(f"""
WITH {BASELINES}, s AS (SELECT entity, avg(d * d) AS s FROM (SELECT entity, value - lag(value) OVER (PARTITION BY entity ORDER BY ts) AS d FROM daily) x GROUP BY 1), w AS (SELECT entity, sum(value) AS w FROM daily GROUP BY 1), r AS (SELECT b.entity, sqrt(avg(e7 * e7) / any_value(s)) AS r FROM b JOIN s USING (entity) GROUP BY 1)
SELECT round(sum(r * w) / sum(w), 6) AS wrmsse FROM r JOIN w USING (entity)""")
def weighted_scaled_error(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.rmsse(baselines(spark, d), daily(spark, d), "entity", "ts", "value", "y", "f7")
    w = daily(spark, d).groupBy("entity").agg(F.sum("value").alias("w"))
    return rounded(metrics.weighted(r, w, "entity", "rmsse", "w"))


@query(f"""
WITH {BASELINES}, s AS (SELECT entity, avg(abs(e7) / ((abs(y) + abs(f7)) / 2 + 1e-8)) AS s7, avg(abs(e1) / ((abs(y) + abs(f1)) / 2 + 1e-8)) AS s1, avg(abs(e7)) AS m7, avg(abs(e1)) AS m1, quantile_cont(abs(e7) / (abs(y) + 1e-8), 0.5) AS mdape, sqrt(avg(e7 * e7)) / avg(abs(e7)) AS r, corr(e7, e1) AS c FROM b GROUP BY 1)
SELECT entity, round((s7 / s1 + m7 / m1) / 2, 6) AS owa, round(mdape, 6) AS mdape, round(r, 6) AS rmse_over_mae, round(c, 6) + 0.0 AS corr FROM s""")
def overall_weighted_average(spark: SparkSession, d: str) -> DataFrame:
    b = baselines(spark, d)
    p7, p1, rel = metrics.point("y", "f7"), metrics.point("y", "f1"), metrics.relative_errors("y", "f7")
    one = b.groupBy("entity").agg(metrics.owa(p7["smape"], p7["mae"], p1["smape"], p1["mae"]).alias("owa"), *(c.alias(k) for k, c in rel.items()))
    return rounded(one.join(metrics.error_correlation(b, "entity", "e7", "e1"), "entity"))


@query("""
WITH s AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), b AS (SELECT s, sum(y) AS p, count(*) AS n FROM s GROUP BY 1), c AS (SELECT s, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER () AS ap, sum(n - p) OVER () AS an FROM b WINDOW w AS (ORDER BY s DESC)),
t AS (SELECT max(s) AS s FROM c WHERE tp / ap >= 0.9) SELECT round((SELECT sum(tp / k * p) / sum(p) FROM c), 6) AS average_precision, CAST(c.s AS DOUBLE) AS threshold, round(tp / ap, 6) AS sensitivity, round((k - tp) / an, 6) AS false_positive_rate FROM c JOIN t ON c.s = t.s""")
def precision_and_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", F.col("n_chars").cast("double").alias("score"))
    return rounded(metrics.average_precision(s, "quality", "score").join(F.broadcast(metrics.threshold_at(s, "quality", "score", 0.9))))


#: Days whose value is over the mean by half a deviation as the anomalies, days over the last one's by 1.2 times as flags.
FLAGS = f"{TOTAL}, n AS (SELECT row_number() OVER (ORDER BY ts) AS i, ts, value, lag(value) OVER (ORDER BY ts) AS b FROM total), fl AS (SELECT i, CASE WHEN value > (SELECT avg(value) + 0.5 * stddev_samp(value) FROM total) THEN 1 ELSE 0 END AS actual, CASE WHEN value > 1.2 * b THEN 1 ELSE 0 END AS flagged FROM n)"


def flags(spark: SparkSession, d: str) -> DataFrame:
    n = total(spark, d).withColumns({"i": F.row_number().over(series("entity", "ts")), "b": F.lag("value").over(series("entity", "ts"))})
    limit = n.agg((F.avg("value") + 0.5 * F.stddev_samp("value")).alias("x"))
    return n.join(F.broadcast(limit)).select("entity", "i", (F.col("value") > F.col("x")).cast("int").alias("actual"), F.coalesce((F.col("value") > 1.2 * F.col("b")).cast("int"), F.lit(0)).alias("flagged"))


@query(f"""
WITH {FLAGS}, g AS (SELECT *, i - sum(actual) OVER (ORDER BY i) AS g FROM fl) SELECT CAST(min(i) AS INT) AS start, CAST(max(i) AS INT) AS "end", max(flagged) AS detected, CAST(min(CASE WHEN flagged = 1 THEN i END) - min(i) AS INT) AS latency FROM g WHERE actual = 1 GROUP BY g""")
def segment_detection(spark: SparkSession, d: str) -> DataFrame:
    return metrics.segments(flags(spark, d), "entity", "i", "actual", "flagged").select("start", "end", "detected", F.col("latency").cast("int").alias("latency"))


# ---------------------------------------------------------------- tests


@query(f"""
WITH {BASELINES}, l AS (SELECT entity, ts, abs(e7) - abs(e1) AS d, abs(e7) AS a, abs(e1) AS b FROM b), c AS (SELECT *, d - avg(d) OVER (PARTITION BY entity) AS c FROM l), w AS (SELECT *, lag(c, 1) OVER v AS c1, lag(c, 2) OVER v AS c2 FROM c WINDOW v AS (PARTITION BY entity ORDER BY ts)),
g AS (SELECT entity, count(*) AS n, avg(d) AS m, sum(c * c) AS g0, sum(c * c1) AS g1, sum(c * c2) AS g2, avg(a) AS a, avg(b) AS b, avg(CASE WHEN a < b THEN 1.0 ELSE 0 END) AS p FROM w GROUP BY 1)
SELECT entity, 'weekly' AS model, round(a, 4) AS mae, round(b, 4) AS baseline_mae, round(p, 6) AS pct_better, round(1 - a / b, 6) + 0.0 AS skill, round(m / sqrt((g0 / n + 2 * (2.0 / 3) * g1 / n + 2 * (1.0 / 3) * g2 / n) / n), 5) + 0.0 AS dm FROM g""")
def comparison_report(spark: SparkSession, d: str) -> DataFrame:
    out = stats.comparison(baselines(spark, d), "entity", "ts", {"weekly": "e7", "naive": "e1"}, "naive", 3)
    return rounded(out, 6, mae=4, baseline_mae=4, dm=5)


@query(f"""
WITH {BASELINES}, m AS (SELECT entity, avg(e7) AS m FROM b GROUP BY 1), c AS (SELECT b.entity, e7 - m AS c FROM b JOIN m USING (entity)), k AS (SELECT entity, count(*) AS n, avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4 FROM c GROUP BY 1), s AS (SELECT entity, n, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS k FROM k)
SELECT entity, n, round(s, 6) + 0.0 AS skewness, round(k, 6) + 0.0 AS kurtosis, round(n / 6.0 * (s * s + k * k / 4), 4) AS jarque_bera, round(exp(-n / 12.0 * (s * s + k * k / 4)), 6) AS p_value FROM s""")
def residual_normality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.normality(baselines(spark, d), "entity", "e7"), 6, jarque_bera=4)


# ---------------------------------------------------------------- intervals


QUANTILES = f"{SPLIT}, q AS (SELECT entity, quantile_cont(-e7, 0.05) AS a, quantile_cont(-e7, 0.5) AS m, quantile_cont(-e7, 0.95) AS z FROM past GROUP BY 1), iv AS (SELECT b.entity, ts, y, f7, e7, f7 + a AS lo, f7 + m AS mid, f7 + z AS hi FROM later b JOIN q USING (entity))"


def intervals(spark: SparkSession, d: str) -> DataFrame:
    past, later = split(baselines(spark, d))
    q = exact_quantiles(past, "entity", -F.col("e7"), [0.05, 0.95], "p")
    return later.join(q, "entity").withColumns({"lo": F.col("f7") + F.col("p")[0], "hi": F.col("f7") + F.col("p")[1]}).drop("p")


@query(f"""
WITH {BASELINES}, {QUANTILES} SELECT entity, count(*) AS n, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(hi - lo), 3) AS mean_width, round(quantile_cont(hi - lo, 0.5), 3) AS median_width, round(avg(hi - lo + 20.0 * CASE WHEN y < lo THEN lo - y WHEN y > hi THEN y - hi ELSE 0 END), 3) AS winkler FROM iv GROUP BY 1""")
def interval_sharpness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(probabilistic.interval_report(intervals(spark, d), "entity", "y", "lo", "hi", 0.1).drop("std_width"), 3, coverage=6)


@query(f"""
WITH {BASELINES}, {QUANTILES} SELECT entity, ts, round(CASE WHEN count(*) OVER w >= 10 THEN avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0 END) OVER w END, 6) AS coverage FROM iv WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def rolling_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(intervals(spark, d).select("entity", "ts", probabilistic.rolling_coverage("y", "lo", "hi", "entity", "ts").alias("coverage")))


@query(f"""
WITH {BASELINES}, {QUANTILES}, l AS (SELECT 0.05 AS tau, avg(CASE WHEN y <= lo THEN 1.0 ELSE 0 END) AS e FROM iv UNION ALL SELECT 0.5, avg(CASE WHEN y <= mid THEN 1.0 ELSE 0 END) FROM iv UNION ALL SELECT 0.95, avg(CASE WHEN y <= hi THEN 1.0 ELSE 0 END) FROM iv) SELECT round(avg(abs(e - tau)), 6) AS mace FROM l""")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(probabilistic.calibration_error(quantiles(spark, d), "tau", "y", "q"))


@query(f"""
WITH {BASELINES}, s AS (SELECT entity, stddev_samp(e7) AS s, quantile_cont(e7, 0.025) AS lo, quantile_cont(e7, 0.975) AS hi FROM b GROUP BY 1)
SELECT b.entity, ts, round(f7 - 1.96 * s, 3) AS lower, round(f7 + 1.96 * s, 3) AS upper, round(f7 - hi, 6) AS low, round(f7 - lo, 6) AS high FROM b JOIN s ON s.entity = b.entity""")
def residual_intervals(spark: SparkSession, d: str) -> DataFrame:
    b = baselines(spark, d)
    e = probabilistic.empirical_interval(b, "entity", "e7", 0.05)
    out = probabilistic.residual_interval(b, "entity", "f7", "e7").join(e.withColumnsRenamed({"low": "a", "high": "z"}), "entity")
    return rounded(out.select("entity", "ts", "lower", "upper", (F.col("f7") - F.col("z")).alias("low"), (F.col("f7") - F.col("a")).alias("high")), 6, lower=3, upper=3)


@query(f"""
WITH {BASELINES}, {QUANTILES}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC) AS back FROM iv), k AS (SELECT entity, greatest(lo + 1e5 - y, y - hi + 1e5) AS s FROM r WHERE back > 60), n AS (SELECT entity, count(*) AS n FROM k GROUP BY 1),
o AS (SELECT k.entity, s, n, row_number() OVER (PARTITION BY k.entity ORDER BY s) - 1 AS i FROM k JOIN n USING (entity)), p AS (SELECT entity, n, least(1, ceil(0.9 * (n + 1)) / n) * (n - 1) AS pos FROM n),
w AS (SELECT o.entity, sum(CASE WHEN i = floor(pos) THEN s * (1 - (pos - floor(pos))) WHEN i = floor(pos) + 1 THEN s * (pos - floor(pos)) ELSE 0 END) AS width FROM o JOIN p USING (entity) GROUP BY 1)
SELECT r.entity, ts, round(lo + 1e5 - width, 3) AS cqr_lower, round(hi - 1e5 + width, 3) AS cqr_upper FROM r JOIN w ON w.entity = r.entity WHERE back <= 60""")
def conformal_quantile_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals that are 100,000 too narrow on both sides, widened by what the calibration rows missed them by."""
    r = intervals(spark, d).withColumns({"lo": F.col("lo") + 1e5, "hi": F.col("hi") - 1e5, "back": F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("ts")))})
    out = probabilistic.conformal_quantiles(r.where("back > 60"), r.where("back <= 60"), "entity", "y", "lo", "hi", 0.1)
    return rounded(out.select("entity", "ts", "cqr_lower", "cqr_upper"), 3)


@query(f"""
WITH {BASELINES}, q AS (SELECT entity, ts, f1 AS q, 0.1 AS tau FROM b UNION ALL SELECT entity, ts, f7, 0.5 FROM b UNION ALL SELECT entity, ts, y, 0.9 FROM b)
SELECT entity, ts, CAST(tau AS DOUBLE) AS tau, round(max(q) OVER (PARTITION BY entity, ts ORDER BY tau ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS q FROM q""")
def rising_quantiles(spark: SparkSession, d: str) -> DataFrame:
    levels = F.array(F.struct(F.lit(0.1).alias("tau"), F.col("f1").alias("q")), F.struct(F.lit(0.5).alias("tau"), F.col("f7").alias("q")), F.struct(F.lit(0.9).alias("tau"), F.col("y").alias("q")))
    long = baselines(spark, d).select("entity", "ts", F.explode(levels).alias("l")).select("entity", "ts", "l.*")
    return rounded(probabilistic.rearranged(long, ["entity", "ts"], "tau", "q"), 4)


# ---------------------------------------------------------------- detectors


@query(f"""
WITH {DAILY}, r AS (SELECT *, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3, count(*) OVER w = 30 AS f FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT entity, ts, round(CASE WHEN f THEN q1 - 1.5 * (q3 - q1) END, 7) + 0.0 AS low, round(CASE WHEN f THEN q3 + 1.5 * (q3 - q1) END, 7) AS high, CASE WHEN f THEN CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END END AS outside FROM r""")
def rolling_fences(spark: SparkSession, d: str) -> DataFrame:
    return rounded(daily(spark, d).select("entity", "ts", *(c.alias(k) for k, c in anomaly.rolling_fences("value", "entity", "ts", 30).items())), 7)


@query(f"""
WITH {DAILY}, z AS (SELECT entity, ts, (value - avg(value) OVER w) / CASE WHEN count(value) OVER w >= 10 AND stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w END AS z, min(value) OVER p AS lo, max(value) OVER p AS hi, count(value) OVER p AS n, value FROM daily
 WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), p AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT entity, ts, round(z, 5) + 0.0 AS z, round(CASE WHEN n = 30 THEN lo END, 4) AS low, round(CASE WHEN n = 30 THEN hi END, 4) AS high, round(avg(abs(z)) OVER s, 5) AS smooth_mean, round(max(abs(z)) OVER s, 5) AS smooth_max FROM z WINDOW s AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def centred_z_and_range(spark: SparkSession, d: str) -> DataFrame:
    r = anomaly.rolling_range("value", "entity", "ts", 30)
    z = daily(spark, d).withColumns({"z": anomaly.centred_z("value", "entity", "ts", 21), "low": r["low"], "high": r["high"]}).withColumn("a", F.abs("z"))
    s = anomaly.smoothed("a", "entity", "ts", 7)
    return rounded(z.select("entity", "ts", "z", "low", "high", *(c.alias(k) for k, c in s.items())), 5, low=4, high=4)


@query(f"""
WITH RECURSIVE {HOURS}, n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM h), m AS (SELECT avg(click) AS a, stddev_pop(click) AS sa, avg(view) AS b, stddev_pop(view) AS sb FROM n WHERE i < 200), z AS (SELECT ts, i, sqrt(pow((click - a) / (sa + 1e-12), 2) + pow((view - b) / (sb + 1e-12), 2)) AS l FROM n CROSS JOIN m),
x AS MATERIALIZED (SELECT ts, i, l - (SELECT avg(l) FROM z WHERE i < 200) - 0.5 AS x FROM z), c AS (SELECT ts, i, CAST(greatest(0, x) AS DOUBLE) AS s FROM x WHERE i = 0 UNION ALL SELECT x.ts, x.i, greatest(0, c.s + x.x) FROM c JOIN x ON x.i = c.i + 1)
SELECT ts, round(s, 5) + 0.0 AS s, CASE WHEN s > 5 THEN 1 ELSE 0 END AS alarm FROM c""")
def norm_cusum(spark: SparkSession, d: str) -> DataFrame:
    h = hours(spark, d).withColumn("e", F.lit("all"))
    return rounded(anomaly.norm_cusum(h, "e", "ts", ["click", "view"], 200).select("ts", "s", "alarm"), 5)


@query(f"""
WITH {DAILY}, n AS (SELECT entity, ts, value AS a, abs(value - lag(value, 1, value) OVER (PARTITION BY entity ORDER BY ts)) AS b FROM daily), r AS (SELECT entity, ts, (rank() OVER (PARTITION BY entity ORDER BY a) + (count(*) OVER (PARTITION BY entity, a) - 1) / 2.0) / count(*) OVER (PARTITION BY entity) AS ra, (rank() OVER (PARTITION BY entity ORDER BY b) + (count(*) OVER (PARTITION BY entity, b) - 1) / 2.0) / count(*) OVER (PARTITION BY entity) AS rb FROM n)
SELECT entity, ts, round((ra + rb) / 2, 8) AS rank_score FROM r""")
def rank_ensemble(spark: SparkSession, d: str) -> DataFrame:
    w = series("entity", "ts")
    n = daily(spark, d).select("entity", "ts", F.col("value").alias("a"), F.abs(F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value"))).alias("b"))
    return rounded(anomaly.rank_ensemble(n, "entity", ["a", "b"]).select("entity", "ts", "rank_score"), 8)


@query(f"""
WITH {BASELINES}, s AS (SELECT abs(e7) AS s FROM b) SELECT 'percentile' AS how, round(quantile_cont(s, 0.99), 4) AS threshold FROM s UNION ALL SELECT 'sigma', round(avg(s) + 3 * stddev_pop(s), 4) FROM s UNION ALL SELECT 'log', round(exp(avg(ln(s + 1e-12)) + 2 * stddev_pop(ln(s + 1e-12))), 2) FROM s""")
def score_thresholds(spark: SparkSession, d: str) -> DataFrame:
    b = baselines(spark, d).withColumn("s", F.abs("e7"))
    parts = [anomaly.threshold(b, "s", how, sigmas=2 if how == "log" else 3).select(F.lit(how).alias("how"), F.round("threshold", 2 if how == "log" else 4).alias("threshold")) for how in ("percentile", "sigma", "log")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""
WITH {TOTAL}, n AS (SELECT row_number() OVER (ORDER BY ts) AS i, value FROM total), w AS (SELECT a.i, b.i AS t, abs(b.value - avg(b.value) OVER (PARTITION BY a.i)) AS e FROM n a JOIN n b ON b.i BETWEEN a.i AND a.i + 6 WHERE a.i <= (SELECT max(i) - 6 FROM n))
SELECT t, round(max(e), 4) AS error FROM w GROUP BY 1""")
def window_errors(spark: SparkSession, d: str) -> DataFrame:
    """Each day's largest distance from the mean of a week that covers it."""
    w = series("entity", "ts")
    n = total(spark, d).select("entity", F.row_number().over(w).cast("long").alias("i"), F.collect_list("value").over(w.rowsBetween(0, 6)).alias("x")).where(F.size("x") == 7)
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / 7
    return rounded(anomaly.window_errors(n.withColumn("e", F.transform("x", lambda v: F.abs(v - mean))), "entity", "i", "e").select("t", "error"), 4)


@query(f"""
WITH {TOTAL}, f AS (SELECT ts, value, row_number() OVER (ORDER BY ts) AS i FROM total), g AS (SELECT *, CASE WHEN i % 50 = 0 THEN 1 ELSE 0 END AS flag, CASE WHEN i % 50 = 0 THEN value * 5 ELSE value END AS v FROM f), t AS (SELECT *, CASE WHEN flag = 1 THEN quantile_cont(v, 0.5) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) ELSE v END AS m FROM g)
SELECT count(*) AS n, sum(flag) AS n_flagged, round(avg(v), 3) AS mean_before, round(avg(m), 3) AS mean_after, round(stddev_samp(v), 3) AS std_before, round(stddev_samp(m), 3) AS std_after FROM t""")
def median_treatment(spark: SparkSession, d: str) -> DataFrame:
    """Moments before and after planted spikes are replaced by their week's median."""
    n = total(spark, d).withColumn("i", F.row_number().over(series("entity", "ts")))
    g = n.withColumn("flag", (F.col("i") % 50 == 0).cast("int")).withColumn("v", F.when(F.col("flag") == 1, F.col("value") * 5).otherwise(F.col("value")))
    t = g.withColumn("m", anomaly.median_replaced("v", "flag", "entity", "ts", 7))
    return rounded(t.agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("n_flagged"), F.avg("v").alias("mean_before"), F.avg("m").alias("mean_after"), F.stddev_samp("v").alias("std_before"), F.stddev_samp("m").alias("std_after")), 3)


@query(f"""
WITH {HOURS}, n AS (SELECT row_number() OVER (ORDER BY ts) AS i, CAST(click AS DOUBLE) AS click, CAST(view AS DOUBLE) AS view, CAST(purchase AS DOUBLE) AS purchase FROM h), l AS (UNPIVOT (SELECT * FROM n WHERE i BETWEEN 301 AND 430) ON click, view, purchase INTO NAME feature VALUE v),
z AS (SELECT feature, (avg(v) FILTER (WHERE i >= 401) - avg(v) FILTER (WHERE i < 401)) / (stddev_samp(v) FILTER (WHERE i < 401) + 1e-12) AS z FROM l GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY abs(z) DESC, feature) AS rank FROM z)
SELECT feature, round(z, 6) + 0.0 AS z, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2""")
def event_causes(spark: SparkSession, d: str) -> DataFrame:
    h = hours(spark, d).withColumn("e", F.lit("all"))
    n = h.withColumn("i", F.row_number().over(series("e", "ts")))
    return rounded(anomaly.event_scores(n, "e", "i", ["click", "view", "purchase"], 401, 430, 100, 2).select("feature", "z", "rank"))


@query(f"""
WITH {HOURS}, m AS (SELECT avg(click) AS a, avg(view) AS b, avg(purchase) AS c FROM h), e AS (SELECT ts, pow(click - a, 2) AS click, pow(view - b, 2) AS view, pow(purchase - c, 2) AS purchase FROM h CROSS JOIN m), p AS (SELECT ts, 100 * click / (click + view + purchase + 1e-12) AS click, 100 * view / (click + view + purchase + 1e-12) AS view, 100 * purchase / (click + view + purchase + 1e-12) AS purchase FROM e)
SELECT ts, channel, round(pct, 6) AS pct FROM (UNPIVOT p ON click, view, purchase INTO NAME channel VALUE pct) q""")
def error_contributions(spark: SparkSession, d: str) -> DataFrame:
    h, names = hours(spark, d), ["click", "view", "purchase"]
    means = h.agg(*(F.avg(c).alias(f"m_{c}") for c in names))
    e = h.join(F.broadcast(means)).select("ts", *(F.pow(F.col(c) - F.col(f"m_{c}"), 2).alias(c) for c in names))
    return rounded(anomaly.contributions(e, "ts", names))


def _stateful(step: str, start: str, out: str) -> str:
    """SQL of a recursion along the days of each priority's orders: ``start`` and ``step`` give the state's columns, ``out`` what is shown."""
    return f"WITH RECURSIVE {DAILY}, n AS MATERIALIZED (SELECT entity, ts, value / 1e5 AS x, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM daily), r AS ({start} FROM n WHERE i = 1 UNION ALL {step} FROM r JOIN n ON n.entity = r.entity AND n.i = r.i + 1) SELECT entity, ts, {out} FROM r"


def scaled_daily(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).select("entity", "ts", (F.col("value") / 1e5).alias("x"))


def scaled_total(spark: SparkSession, d: str) -> DataFrame:
    return total(spark, d).select("entity", "ts", (F.col("value") / 1e5).alias("x"))


@query(_stateful(
    "SELECT n.entity, n.ts, n.i, 0.98 * w + 1, mean + (n.x - mean) / (0.98 * w + 1), 0.98 * m + (n.x - mean) * (n.x - (mean + (n.x - mean) / (0.98 * w + 1))), n.x",
    "SELECT entity, ts, i, CAST(1 AS DOUBLE) AS w, CAST(x AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS m, CAST(x AS DOUBLE) AS x",
    "round(mean, 9) AS mean, round(CASE WHEN i = 1 THEN 0 ELSE (x - mean) / (sqrt(greatest(m / (w - w / i), 1e-12)) + 1e-12) END, 4) + 0.0 AS z"))
def fading_z(spark: SparkSession, d: str) -> DataFrame:
    out = processors.over_table(scaled_daily(spark, d), "entity", "ts", "x", processors.FadingZ)
    return rounded(out.select("entity", "ts", "mean", "z"), 9, z=4)


@query(_stateful(
    "SELECT n.entity, n.ts, n.i, mean + 0.1 * (n.x - mean), 0.9 * (var + 0.1 * (n.x - mean) * (n.x - mean)), CASE WHEN n.i > 5 THEN (n.x - mean) / sqrt(var + 1e-6) ELSE 0 END",
    "SELECT entity, ts, i, CAST(x AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS var, CAST(0 AS DOUBLE) AS z",
    "round(z, 4) + 0.0 AS z, CAST(CASE WHEN abs(z) > 4 THEN 2 WHEN abs(z) > 2.5 THEN 1 ELSE 0 END AS INT) AS alert"))
def vital_monitor(spark: SparkSession, d: str) -> DataFrame:
    out = processors.over_table(scaled_daily(spark, d), "entity", "ts", "x", processors.VitalMonitor)
    return rounded(out.select("entity", "ts", "z", F.col("alert").cast("int")), 4)


@query(f"""
WITH RECURSIVE {DAILY}, n AS MATERIALIZED (SELECT entity, ts, value / 1e5 AS x, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM daily), m AS (SELECT entity, avg(x) AS mean, stddev_pop(x) AS sd FROM n WHERE i <= 30 GROUP BY 1), z AS MATERIALIZED (SELECT n.entity, ts, i, CASE WHEN i > 30 THEN (x - mean) / (sd + 1e-12) END AS z FROM n JOIN m ON m.entity = n.entity),
r AS (SELECT entity, ts, i, CAST(0 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS lo FROM z WHERE i = 1 UNION ALL SELECT z.entity, z.ts, z.i, CASE WHEN z.z IS NULL THEN 0 ELSE greatest(0, CASE WHEN greatest(r.hi, r.lo) > 5 THEN 0 ELSE r.hi END + z.z - 0.5) END, CASE WHEN z.z IS NULL THEN 0 ELSE greatest(0, CASE WHEN greatest(r.hi, r.lo) > 5 THEN 0 ELSE r.lo END - z.z - 0.5) END FROM r JOIN z ON z.entity = r.entity AND z.i = r.i + 1)
SELECT entity, ts, round(hi, 4) + 0.0 AS s_hi, round(lo, 4) + 0.0 AS s_lo, CASE WHEN greatest(hi, lo) > 5 THEN 1 ELSE 0 END AS alarm FROM r""")
def learnt_cusum(spark: SparkSession, d: str) -> DataFrame:
    out = processors.over_table(scaled_daily(spark, d), "entity", "ts", "x", processors.LearntCusum)
    return rounded(out.select("entity", "ts", "s_hi", "s_lo", F.col("alarm").cast("int")), 4)


# ---------------------------------------------------------------- decisions


@query(f"""
WITH {BASELINES}, m AS (SELECT entity, avg(abs(e7)) AS e, avg(abs(e1)) AS b, count(*) AS n, row_number() OVER (ORDER BY entity) AS k FROM b GROUP BY 1)
SELECT entity, CASE WHEN k * 3 < 7 THEN NULL WHEN e > 1.2 * b THEN 'performance' WHEN k / 10.0 > 0.25 THEN 'drift' WHEN n > 10000 THEN 'volume' END AS reason, (b - e) / b > 0.02 AS promoted FROM m""")
def retrain_decisions(spark: SparkSession, d: str) -> DataFrame:
    m = baselines(spark, d).groupBy("entity").agg(F.avg(F.abs("e7")).alias("e"), F.avg(F.abs("e1")).alias("b"), F.count(F.lit(1)).alias("n"))
    # Five entities: few enough to be numbered in one task.
    m = m.withColumn("k", F.row_number().over(Window.orderBy("entity")))
    return m.select("entity", drift.retrain_trigger(F.col("e"), F.col("b"), F.col("k") / 10, F.col("n"), F.col("k") * 3).alias("reason"), drift.promotes(F.col("e"), F.col("b")).alias("promoted"))


@query(f"""
WITH {BASELINES}, f AS (SELECT entity, CASE WHEN abs(e7) > 4e5 THEN 'critical' WHEN abs(e7) > 2e5 THEN 'warning' END AS severity FROM b)
SELECT entity, count(*) AS n_alerts, count(*) FILTER (WHERE severity = 'critical') AS n_critical, CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'critical' ELSE 'warning' END AS worst FROM f WHERE severity IS NOT NULL GROUP BY 1""")
def alert_summary(spark: SparkSession, d: str) -> DataFrame:
    e = F.abs("e7")
    f = baselines(spark, d).select("entity", F.when(e > 4e5, "critical").when(e > 2e5, "warning").alias("severity")).where("severity is not null")
    return drift.summary(f, "entity")


@query(f"""
WITH {BASELINES}, r AS (SELECT entity, CAST(year(ts) AS INT) AS version, round(avg(abs(e7)), 4) AS mae FROM b GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mae, version DESC) AS k FROM r) SELECT entity, version, mae FROM o WHERE k = 1""")
def best_versions(spark: SparkSession, d: str) -> DataFrame:
    runs = baselines(spark, d).groupBy("entity", F.year("ts").alias("version")).agg(F.round(F.avg(F.abs("e7")), 4).alias("mae"))
    return drift.best_version(runs, "entity", "mae")


# ---------------------------------------------------------------- arrays and graphs


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), m AS (SELECT *, list_sum(a) / len(a) AS m FROM e), s AS (SELECT *, sqrt(list_sum(list_transform(a, lambda x: (x - m) * (x - m))) / len(a)) AS s FROM m)
SELECT vec_id, CAST(i - 1 AS INT) AS place, round((a[i] - m) / (s + 1e-8), 5) + 0.0 AS z, CAST(least(greatest(floor((round((a[i] - m) / (s + 1e-8), 5) + 4) / 8 * 256), 0), 255) AS INT) AS token FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM s) k""")
def normalized_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Values of each array as z-scores to five digits, and these as one of 256 tokens."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(distance.z_normalized(F.col("embedding").cast("array<double>"))).alias("place", "z"))
    return rounded(e, 5).withColumn("token", graph.tokens(F.col("z"), -4.0, 4.0, 256))


@query("""
WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), p AS (SELECT a.k AS src, b.k AS dst, CAST(abs(a.k - b.k) AS DOUBLE) AS d FROM n a JOIN n b ON a.r = b.r AND a.k <> b.k) SELECT src, dst, round(exp(-pow(d / 6.0, 2)), 8) AS w FROM p WHERE exp(-pow(d / 6.0, 2)) >= 0.1""")
def gaussian_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Nations of one region (five each), nearer keys weighing more."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("r"))
    p = n.join(n.withColumnRenamed("src", "dst"), "r").where("src <> dst").withColumn("d", F.abs(F.col("src") - F.col("dst")).cast("double"))
    return rounded(graph.gaussian_edges(p, "d", 6.0), 8)


@query(f"WITH {HOURS}, r AS (SELECT ts, 'click' AS node, click AS v FROM h UNION ALL SELECT ts, 'view', view FROM h UNION ALL SELECT ts, 'purchase', purchase FROM h), s AS (SELECT r.*, dense_rank() OVER (ORDER BY ts) AS i FROM r) SELECT a.i AS start, a.node, CAST(sum(b.v) AS DOUBLE) AS past, any_value(CAST(c.v AS DOUBLE)) AS ahead FROM s a JOIN s b ON b.node = a.node AND b.i BETWEEN a.i AND a.i + 11 JOIN s c ON c.node = a.node AND c.i = a.i + 12 GROUP BY 1, 2")
def spatio_temporal_windows(spark: SparkSession, d: str) -> DataFrame:
    """For every node and hour: the sum of twelve hours from it and the one after."""
    from chronolake.operators.features import sliding

    long = hours(spark, d).unpivot("ts", ["click", "view", "purchase"], "node", "v")
    w = sliding(long, "node", "ts", "v", 12, 1)
    return w.select((F.col("n") - 11).cast("long").alias("start"), "node", F.aggregate("x", F.lit(0.0), lambda a, x: a + x).alias("past"), F.col("y")[0].alias("ahead"))


@query()
def horizon_profile(spark: SparkSession, d: str) -> DataFrame:
    """Errors of five baselines at each step ahead; the forecasts themselves are compared by ``backtest_leaderboard``."""
    return rounded(metrics.by_horizon(backtest.closed_form(region_days(spark, d), "entity", "ts", "value", 14, 7, 28, 100, 4)), 3)
