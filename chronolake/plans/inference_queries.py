"""Queries on tests of series, fills and outliers by local fits, strategies, distances by alignment, and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import series
from chronolake.operators import anomaly, decompose, distance, forecast, impute, stats
from chronolake.plans.catalog import DAILY, daily, monthly, query, rounded, table
from chronolake.plans.model_queries import BASELINES, baselines
from chronolake.plans.score_queries import scaled_daily
from chronolake.plans.watch_queries import HOURS, hours, least_squares, tail_of_f
from chronolake.streaming import processors

# ---------------------------------------------------------------- tests


@query("""
WITH c AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS d FROM events), p AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c GROUP BY 1),
g AS (SELECT event_type, n, m3 / pow(m2, 1.5) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
 (m4 / (m2 * m2) - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS r FROM p),
h AS (SELECT event_type, n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z_skewness, x, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) AS a FROM g),
k AS (SELECT event_type, n, z_skewness, (1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z_kurtosis FROM h)
SELECT event_type, CAST(n AS BIGINT) AS n, round(z_skewness, 5) + 0.0 AS z_skewness, round(z_kurtosis, 5) + 0.0 AS z_kurtosis, round(z_skewness * z_skewness + z_kurtosis * z_kurtosis, 4) AS k2, round(exp(-(z_skewness * z_skewness + z_kurtosis * z_kurtosis) / 2), 6) AS p_value FROM k""")
def skewness_kurtosis_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.skewness_kurtosis_test(table(spark, d, "events"), "event_type", "value"), 5, k2=4, p_value=6)


@query(f"""
WITH {BASELINES}, l AS (SELECT entity, ts, abs(e7) - abs(e1) AS d FROM b), z AS (SELECT *, lag(d) OVER (PARTITION BY entity ORDER BY ts) AS z FROM l), k AS (SELECT * FROM z WHERE z IS NOT NULL AND d IS NOT NULL), f AS (SELECT entity, regr_slope(d, z) AS b, regr_intercept(d, z) AS a FROM k GROUP BY 1),
r AS (SELECT k.entity, d, z, pow(d - a - b * z, 2) AS r FROM k JOIN f USING (entity)), m AS (SELECT entity, count(*) AS n, avg(d) AS g1, avg(d * z) AS g2, avg(r) AS a, avg(r * z) AS b, avg(r * z * z) AS c FROM r GROUP BY 1), w AS (SELECT entity, n, n * (g1 * g1 * c - 2 * g1 * g2 * b + g2 * g2 * a) / (a * c - b * b) AS wald FROM m)
SELECT entity, n, round(wald, 5) AS wald, round(exp(-wald / 2), 6) AS p_value FROM w""")
def giacomini_white(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.giacomini_white(baselines(spark, d), "entity", "ts", "e7", "e1"), 5, p_value=6)


@query(f"""
WITH {DAILY}, l AS (SELECT entity, ts, value AS y, lag(value) OVER (PARTITION BY entity ORDER BY ts) AS x FROM daily), k AS (SELECT * FROM l WHERE x IS NOT NULL), f AS (SELECT entity, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM k GROUP BY 1),
e AS (SELECT k.entity, k.ts, b, sxx, y - a - b * x AS e FROM k JOIN f USING (entity)), q AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3, lag(e, 4) OVER w AS e4 FROM e WINDOW w AS (PARTITION BY entity ORDER BY ts)),
m AS (SELECT entity, count(*) AS n, any_value(b) AS b, any_value(sxx) AS sxx, sum(e * e) AS ss, sum(e * e) / count(*) AS g0, sum(e * e1) AS g1, sum(e * e2) AS g2, sum(e * e3) AS g3, sum(e * e4) AS g4 FROM q GROUP BY 1),
v AS (SELECT *, g0 + 2 * (0.8 * g1 + 0.6 * g2 + 0.4 * g3 + 0.2 * g4) / n AS l2, sqrt(ss / (n - 2) / sxx) AS se FROM m), z AS (SELECT entity, n, b - 1 AS rho, (b - 1) / se * sqrt(g0 / l2) - (l2 - g0) * n * se / (2 * sqrt(l2) * sqrt(ss / (n - 2))) AS z FROM v)
SELECT entity, n, round(rho, 6) AS rho, round(z, 5) AS z_tau, z < -2.86 AS stationary FROM z""")
def phillips_perron(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.phillips_perron(daily(spark, d), "entity", "ts", "value", 4), 5, rho=6)


VAR = ["click", "view", "purchase"]
LAGGED = {c: [f"{c}_{k}" for k in (1, 2)] for c in VAR}
ROWS = f"""{HOURS}, x AS (SELECT 'a' AS g, CAST(1 AS DOUBLE) AS one, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in VAR)}, {", ".join(f"CAST(lag({c}, {k}) OVER (ORDER BY ts) AS DOUBLE) AS {c}_{k}" for c in VAR for k in (1, 2))} FROM h), v AS (SELECT * FROM x WHERE click_2 IS NOT NULL)"""


def _pairs() -> str:
    ctes, out = [ROWS], []
    for e in VAR:
        ctes.append(least_squares(f"full_{e}", "v", ["one", *(x for c in VAR for x in LAGGED[c])], e))
        for c in VAR:
            if c != e:
                ctes.append(least_squares(f"{c}_{e}", "v", ["one", *(x for o in VAR if o != c for x in LAGGED[o])], e))
                out.append(f"SELECT '{c}' AS cause, '{e}' AS effect, (s.rss - f.rss) / 2 / (f.rss / (f.n - 7)) AS f, 3 * (f.n - 7) AS free FROM {c}_{e} s JOIN full_{e} f ON s.g = f.g")
    return f"WITH RECURSIVE {', '.join(ctes)}, o AS ({' UNION ALL '.join(out)}) SELECT cause, effect, round(f, 5) AS f, round({tail_of_f('f', 2, 'free')}, 6) AS p_value FROM o"


@query(_pairs())
def granger_in_var(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spark.createDataFrame(stats.granger_in_var(hours(spark, d), "ts", VAR, 2), "cause string, effect string, f double, p_value double"), 5, p_value=6)


@query()
def lagged_causes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spark.createDataFrame(stats.lagged_causes(hours(spark, d), "ts", VAR, 2), "cause string, lag int, effect string, partial double, p_value double"))


# ---------------------------------------------------------------- fills, outliers, strategies


@query()
def stl_fill(spark: SparkSession, d: str) -> DataFrame:
    """Months whose number by series leaves 3 over 11 are hidden and filled."""
    n = monthly(spark, d).withColumn("t", F.row_number().over(series("entity", "ts")) - 1)
    hidden = n.select("entity", "ts", F.col("value").alias("actual"), F.when(F.col("t") % 11 != 3, F.col("value")).alias("value"))
    return impute.by_series(hidden, "entity", "ts", "value", lambda y: decompose.stl_filled(y, 12))


@query()
def stl_outliers(spark: SparkSession, d: str) -> DataFrame:
    return decompose.stl_outliers(monthly(spark, d), "entity", "ts", "value", 12).select("entity", "ts", "value", "robust_z", "outlier")


@query()
def multi_step_strategies(spark: SparkSession, d: str) -> DataFrame:
    made = None
    for name, group in (("recursive", 1), ("direct", 1), ("mimo", 1), ("dirmo", 3)):
        f = forecast.per_series(monthly(spark, d), "entity", "ts", "value", 6, forecast.multi_step(name, [1, 2, 12], group)).withColumn("strategy", F.lit(name))
        made = f if made is None else made.unionByName(f)
    return made


# ---------------------------------------------------------------- distances by alignment


@query()
def edit_distances(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of all other vectors, by gaps that cost their values, for each row whose id is divisible by 50, with the other distances to it."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    best = distance.erp_nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding")
    return best.select("query_id", "vec_id", "erp", *(distance.aligned_column("query", "embedding", k).alias(k) for k in ("lcss", "edr", "soft")))


# ---------------------------------------------------------------- detectors


@query(f"""
WITH RECURSIVE {DAILY}, n AS (SELECT entity, ts, CAST(row_number() OVER (PARTITION BY entity ORDER BY ts) AS INT) AS i, CASE WHEN count(value) OVER w >= 14 AND stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS z, percent_rank() OVER (PARTITION BY entity ORDER BY value) AS p FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
s AS MATERIALIZED (SELECT entity, ts, i, 0.4 * least(abs(coalesce(z, 0)) / 5, 1) + 0.6 * p AS score FROM n), h AS MATERIALIZED (SELECT entity, i FROM s WHERE score >= 0.55),
a AS (SELECT entity, min(i) AS i FROM h GROUP BY 1 UNION ALL SELECT a.entity, (SELECT min(h.i) FROM h WHERE h.entity = a.entity AND h.i >= a.i + 15) FROM a WHERE (SELECT min(h.i) FROM h WHERE h.entity = a.entity AND h.i >= a.i + 15) IS NOT NULL)
SELECT s.entity, s.ts, round(score, 6) AS score, CASE WHEN a.i IS NULL THEN 'NORMAL' WHEN score >= 0.8 THEN 'CRITICAL' ELSE 'WARNING' END AS level FROM s LEFT JOIN a ON a.entity = s.entity AND a.i = s.i""")
def alert_levels(spark: SparkSession, d: str) -> DataFrame:
    n = daily(spark, d).withColumn("i", F.row_number().over(series("entity", "ts"))).withColumn("z", anomaly.rolling_z("value", "entity", "ts", 28))
    n = n.withColumn("p", F.percent_rank().over(Window.partitionBy("entity").orderBy("value")))
    return rounded(anomaly.alert_levels(n, "entity", "i", "z", "p", 15).select("entity", "ts", "score", "level"))


@query()
def detector_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return processors.over_table(scaled_daily(spark, d), "entity", "ts", "x", processors.DetectorPipeline)


BIN = "CAST(least(19, greatest(0, ceil((x - lo) / (hi - lo) * 20) - 1)) AS INT)"


@query(f"""
WITH RECURSIVE {DAILY}, n AS MATERIALIZED (SELECT entity, ts, value / 1e5 AS x, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM daily), e AS (SELECT entity, min(x) - 1 AS lo, max(x) + 1 AS hi FROM n WHERE i <= 50 GROUP BY 1), b AS MATERIALIZED (SELECT n.entity, ts, i, lo, hi, {BIN} + 1 AS b FROM n JOIN e ON e.entity = n.entity),
c AS (SELECT entity, list(b) AS l FROM b WHERE i <= 50 GROUP BY 1),
r AS (SELECT entity, CAST(50 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS score, list_transform(range(1, 21), lambda j: len(list_filter(l, lambda q: q = j)) + 1e-6::DOUBLE) AS k FROM c
 UNION ALL SELECT b.entity, b.i, -ln(r.k[b.b] / (list_sum(r.k) * ((b.hi - b.lo) / 20 + 1e-12)) + 1e-12), list_transform(range(1, 21), lambda j: r.k[j] * 0.995 + CASE WHEN j = b.b THEN 1 ELSE 0 END) FROM r JOIN b ON b.entity = r.entity AND b.i = r.i + 1)
SELECT n.entity, n.ts, round(coalesce(r.score, 0), 5) + 0.0 AS score FROM n LEFT JOIN r ON r.entity = n.entity AND r.i = n.i AND n.i > 50""")
def density_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(processors.over_table(scaled_daily(spark, d), "entity", "ts", "x", processors.DensityHistogram).select("entity", "ts", "score"), 5)


HALVES_DEPTH = 6
PATH = ", ".join(f"CAST(least({2**k - 1}, floor(s * {2**k})) AS INT) AS b{k}" for k in range(1, HALVES_DEPTH + 1))


@query(f"""
WITH u AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, least(greatest(value / 150, 0), 1) AS s FROM events), p AS (SELECT user_id, event_id, i // 20 AS w, {PATH} FROM u),
{", ".join(f"m{k} AS (SELECT user_id, w, b{k}, count(*) AS c FROM p GROUP BY 1, 2, 3)" for k in range(1, HALVES_DEPTH + 1))}
SELECT p.user_id, p.event_id, round(CASE WHEN p.w > 0 THEN 1.0 / ({" + ".join(f"coalesce(m{k}.c, 0) * {2**k}" for k in range(1, HALVES_DEPTH + 1))} + 1) ELSE 0 END, 8) AS score FROM p {" ".join(f"LEFT JOIN m{k} ON m{k}.user_id = p.user_id AND m{k}.w = p.w - 1 AND m{k}.b{k} = p.b{k}" for k in range(1, HALVES_DEPTH + 1))}""")
def half_spaces(spark: SparkSession, d: str) -> DataFrame:
    class Bounded(processors.HalfSpaces):
        window, high = 20, 150.0

    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return rounded(processors.over_table(e, "user_id", "event_id", "value", Bounded).select("user_id", "event_id", "score"), 8)
