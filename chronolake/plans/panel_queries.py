"""Queries of tests, reports and schedules by entity, each over all entities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions.windows import series, whole
from chronolake.operators import backtest, drift, evaluation, gram
from chronolake.operators.quantile import exact_quantiles
from chronolake.plans.bootstrap_queries import _LOSSES, losses
from chronolake.plans.catalog import DAILY, daily, query, rounded, table
from chronolake.plans.watch_queries import least_squares, tail_of_f

SEGMENTS = ("BUILDING", "MACHINERY", "FURNITURE")
CHANNELS = [s.lower() for s in SEGMENTS]
LAGGED = [f"{c}_{k}" for k in (1, 2) for c in CHANNELS]
REGION = f"""rc AS (SELECT n_regionkey AS g, CAST(o_orderdate AS DATE) AS ts, {", ".join(f"sum(CASE WHEN c_mktsegment = '{s}' THEN o_totalprice ELSE 0 END) / 1e5 AS {s.lower()}" for s in SEGMENTS)} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
x AS (SELECT g, CAST(1 AS DOUBLE) AS one, {", ".join(CHANNELS)}, {", ".join(f"lag({c}, {k}) OVER w AS {c}_{k}" for k in (1, 2) for c in CHANNELS)} FROM rc WINDOW w AS (PARTITION BY g ORDER BY ts)), v AS MATERIALIZED (SELECT * FROM x WHERE {CHANNELS[0]}_2 IS NOT NULL)"""


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Daily revenue of three segments, in 100,000, by region."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey", "c_mktsegment")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("n_regionkey").alias("region"), F.to_date("o_orderdate").alias("ts")).agg(*((F.sum(F.when(F.col("c_mktsegment") == s, F.col("o_totalprice")).otherwise(0.0)) / 1e5).alias(s.lower()) for s in SEGMENTS))


def _granger() -> str:
    ctes, out = [REGION], []
    for e in CHANNELS:
        ctes.append(least_squares(f"full_{e}", "v", ["one", *LAGGED], e))
        for c in CHANNELS:
            if c != e:
                ctes.append(least_squares(f"{c}_{e}", "v", ["one", *(x for x in LAGGED if not x.startswith(c))], e))
                out.append(f"SELECT s.g AS region, '{c}' AS cause, '{e}' AS effect, (s.rss - f.rss) / 2 / (f.rss / (f.n - 7)) AS f, f.n - 7 AS free FROM {c}_{e} s JOIN full_{e} f ON s.g = f.g")
    return f"WITH RECURSIVE {', '.join(ctes)}, o AS ({' UNION ALL '.join(out)}) SELECT region, cause, effect, round(f, 4) AS f, round({tail_of_f('f', 2, 'free')}, 5) AS p_value FROM o"


@query(_granger())
def granger_by_region(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gram.granger(regions(spark, d), "region", "ts", CHANNELS, 2), 4, p_value=5)


@query(f"""
WITH RECURSIVE {REGION}, {", ".join(least_squares(f"r_{c}", "v", ["one", *LAGGED], c) for c in CHANNELS)}
{" UNION ALL ".join(f"SELECT g AS region, '{c}' AS channel, CAST(unnest(range(0, {len(LAGGED) + 1})) AS INT) AS term, round(unnest(coef), 5) + 0.0 AS coefficient FROM r_{c}" for c in CHANNELS)}""")
def autoregression_by_region(spark: SparkSession, d: str) -> DataFrame:
    fits = gram.autoregression(regions(spark, d), "region", "ts", CHANNELS, 2)
    return rounded(fits.select("region", "channel", F.posexplode("coef").alias("term", "coefficient")), 5)


@query()
def response_shares(spark: SparkSession, d: str) -> DataFrame:
    return gram.responses(gram.autoregression(regions(spark, d), "region", "ts", CHANNELS, 2), "region", CHANNELS, 6)


# ---------------------------------------------------------------- stationarity

_ADF = f"""{DAILY}, a AS (SELECT entity AS g, ts, value / 1e5 AS y, lag(value / 1e5) OVER w AS l FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts)), b AS (SELECT g, ts, y, l, y - l AS d, CAST(1 AS DOUBLE) AS one FROM a), c AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, lag(d, 3) OVER w AS d3 FROM b WINDOW w AS (PARTITION BY g ORDER BY ts)), v AS MATERIALIZED (SELECT * FROM c WHERE d3 IS NOT NULL),
{least_squares("r", "v", ["l", "one", "d1", "d2", "d3"], "d")}, adf AS MATERIALIZED (SELECT g, n, coef[1] / sqrt(rss / (n - 5) * inv[1]) AS t FROM r)"""


def scaled(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).select("entity", "ts", (F.col("value") / 1e5).alias("y"))


@query(f"""
WITH RECURSIVE {_ADF}, k AS (SELECT g, ts, y - avg(y) OVER (PARTITION BY g) AS e FROM a), s AS (SELECT g, e, sum(e) OVER w AS s, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM k WINDOW w AS (PARTITION BY g ORDER BY ts)),
q AS (SELECT g, sum(s * s) / count(*) / count(*) / ((sum(e * e) + 1.5 * sum(e * e1) + sum(e * e2) + 0.5 * sum(e * e3)) / count(*)) AS kpss FROM s GROUP BY 1)
SELECT adf.g AS entity, round(t, 5) AS adf, round(kpss, 5) AS kpss, CASE WHEN t < -2.86 AND kpss < 0.463 THEN 'stationary' WHEN t < -2.86 THEN 'trend or break' WHEN kpss < 0.463 THEN 'too little evidence' ELSE 'unit root' END AS verdict FROM adf JOIN q ON q.g = adf.g""")
def stationarity_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.stationarity(scaled(spark, d), "entity", "ts", "y", 3), 5)


@query(f"""
WITH RECURSIVE {_ADF.replace("value / 1e5", "value").replace("SELECT entity AS g, ts, value AS y, lag(value) OVER w AS l FROM daily", "SELECT entity AS g, ts, value AS y, lag(value) OVER w AS l FROM cumulated").replace(f"{DAILY},", f"{DAILY}, cumulated AS (SELECT entity, ts, sum(value / 1e5) OVER (PARTITION BY entity ORDER BY ts) AS value FROM daily UNION ALL SELECT entity || ' daily', ts, value / 1e5 FROM daily),")}
SELECT b.g AS entity, b.ts, round(CASE WHEN t < -2.86 THEN y ELSE d END, 7) AS prepared, NOT t < -2.86 AS differenced FROM b JOIN adf ON adf.g = b.g WHERE CASE WHEN t < -2.86 THEN y ELSE d END IS NOT NULL""")
def stationary_series(spark: SparkSession, d: str) -> DataFrame:
    """Daily revenue, and its running total."""
    x = scaled(spark, d)
    totals = x.withColumn("y", F.sum("y").over(series("entity", "ts")))
    both = totals.unionByName(x.withColumn("entity", F.concat("entity", F.lit(" daily"))))
    return rounded(evaluation.made_stationary(both, "entity", "ts", "y", 3).select("entity", "ts", "prepared", "differenced"), 7)


# ---------------------------------------------------------------- reports

TAUS = (0.1, 0.25, 0.5, 0.75, 0.9)
_Q = [f"q{i}" for i in range(len(TAUS))]
_REF = [f"c{i}" for i in range(len(TAUS))]


def _pin(y: str, q: str, t: float) -> str:
    return f"greatest({t} * ({y} - {q}), {round(t - 1, 10)} * ({y} - {q}))"


@query(f"""
WITH {_LOSSES}, q AS (SELECT entity, {", ".join(f"quantile_cont(e, {t}) AS {a}, quantile_cont(y, {t}) AS {b}" for t, a, b in zip(TAUS, _Q, _REF, strict=True))} FROM l WHERE i <= 0.6 * n GROUP BY 1), t AS (SELECT l.entity, y, {", ".join(f"y - e + {a} AS {a}, {b}" for a, b in zip(_Q, _REF, strict=True))} FROM l JOIN q ON q.entity = l.entity WHERE i > 0.6 * n),
r AS (SELECT entity, count(*) AS n, avg(({" + ".join(_pin("y", a, t) for t, a in zip(TAUS, _Q, strict=True))}) / 5) AS p, avg(({" + ".join(_pin("y", b, t) for t, b in zip(TAUS, _REF, strict=True))}) / 5) AS o, avg(CASE WHEN y BETWEEN q0 AND q4 THEN 1.0 ELSE 0 END) AS coverage, avg(q4 - q0) AS width, avg(q4 - q0 + 10.0 * greatest(q0 - y, y - q4, 0)) AS winkler, ({" + ".join(f"abs(avg(CASE WHEN y <= {a} THEN 1.0 ELSE 0 END) - {t})" for t, a in zip(TAUS, _Q, strict=True))}) / 5 AS calibration_error FROM t GROUP BY 1)
SELECT entity, n, round(p, 5) AS pinball, round(2 * p, 5) AS crps, round(1 - p / o, 5) AS crps_skill, round(coverage, 5) AS coverage, round(width, 5) AS width, round(winkler, 5) AS winkler, round(calibration_error, 5) AS calibration_error FROM r""")
def probabilistic_report(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the errors of the first three fifths, put on the forecasts of the rest, beside those of the values themselves."""
    w = series("entity", "ts")
    x = losses(spark, d).select("entity", "ts", "y", "e", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(whole("entity")).alias("n"))
    known = x.where("i <= 0.6 * n")
    q = exact_quantiles(known, "entity", "e", TAUS, "a").join(exact_quantiles(known, "entity", "y", TAUS, "b"), "entity")
    later = x.where("i > 0.6 * n").join(q, "entity").select("entity", "y", *((F.col("y") - F.col("e") + F.col("a")[i]).alias(c) for i, c in enumerate(_Q)), *(F.col("b")[i].alias(c) for i, c in enumerate(_REF)))
    return rounded(evaluation.probabilistic_report(later, "entity", "y", _Q, _REF, TAUS), 5)


@query(f"""
WITH {_LOSSES}, d AS (SELECT entity, ts, e, e - avg(e) OVER (PARTITION BY entity) AS d, lag(e) OVER w AS l FROM l WINDOW w AS (PARTITION BY entity ORDER BY ts)), g AS (SELECT *, {", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in range(1, 11))} FROM d WINDOW w AS (PARTITION BY entity ORDER BY ts)),
r AS (SELECT entity, count(*) AS n, avg(e) AS mean, stddev_samp(e) AS std, sum(pow(e - l, 2)) / sum(e * e) AS durbin_watson, count(*) * (count(*) + 2) * ({" + ".join(f"pow(sum(d * d{k}) / sum(d * d), 2) / (count(*) - {k})" for k in range(1, 11))}) AS ljung_box, count(*) / 6.0 * (pow(avg(pow(d, 3)) / pow(avg(d * d), 1.5), 2) + pow(avg(pow(d, 4)) / pow(avg(d * d), 2) - 3, 2) / 4) AS jarque_bera, count(l) * pow(corr(e * e, l * l), 2) AS arch FROM g GROUP BY 1)
SELECT entity, n, round(mean, 5) AS mean, round(mean / std * sqrt(n), 5) AS bias_t, round(std, 5) AS std, round(durbin_watson, 5) AS durbin_watson, round(ljung_box, 5) AS ljung_box, round(jarque_bera, 5) AS jarque_bera, round(arch, 5) AS arch, abs(mean / std * sqrt(n)) < 1.96 AS unbiased, ljung_box < 18.3070 AS white, jarque_bera < 5.9915 AS normal, arch < 3.8415 AS even FROM r""")
def residual_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluation.residual_report(losses(spark, d), "entity", "ts", "e", 10), 5)


# ---------------------------------------------------------------- folds, schedules, scores


@query(f"""
WITH {DAILY}, n AS (SELECT entity, ts, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, count(*) OVER (PARTITION BY entity) AS n FROM daily), k AS (SELECT *, CAST(unnest(range(0, 6)) AS INT) AS k FROM n)
SELECT entity, ts, k AS "window", n - 14 - k * 14 AS context, i - (n - 14 - k * 14) AS step FROM k WHERE n - 14 - k * 14 >= 200 AND i - (n - 14 - k * 14) BETWEEN 1 AND 14""")
def zero_shot_windows(spark: SparkSession, d: str) -> DataFrame:
    return backtest.zero_shot_rows(daily(spark, d), "entity", "ts", 14, 6, 200).select("entity", "ts", "window", F.col("context").cast("long").alias("context"), F.col("step").cast("long").alias("step"))


_HASH = "CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT)"


@query(f"SELECT vec_id, label, CAST({_HASH} % 5 AS INT) AS random_fold, CAST((row_number() OVER (PARTITION BY label ORDER BY {_HASH}, vec_id) - 1) % 5 AS INT) AS stratified_fold FROM embeddings")
def cluster_folds(spark: SparkSession, d: str) -> DataFrame:
    e = backtest.random_folds(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 5).withColumnRenamed("fold", "random_fold")
    return backtest.stratified_folds(e, "label", "vec_id", 5).select("vec_id", "label", "random_fold", F.col("fold").alias("stratified_fold"))


@query(f"""
WITH {DAILY}, e AS (SELECT entity, min(ts) AS lo, max(ts) AS hi FROM daily GROUP BY 1), k AS (SELECT *, CAST(unnest(range(1, greatest(1, CAST(floor((hi - lo) / 30.0) AS BIGINT)) + 1)) AS INT) AS k FROM e)
SELECT entity, k AS "window", CAST(greatest(lo, lo + (k * 30 - 365)) AS DATE) AS train_start, CAST(lo + (k * 30 - 1) AS DATE) AS train_end, CAST(least(hi, lo + (k * 30 + 29)) AS DATE) AS score_end FROM k WHERE lo + (k * 30 - 1) < hi""")
def retrain_windows(spark: SparkSession, d: str) -> DataFrame:
    return drift.retrain_windows(daily(spark, d), "entity", "ts", 30, 365)


@query(f"""
WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC) AS back FROM daily), m AS (SELECT entity, max(ts) AS hi FROM daily GROUP BY 1)
SELECT n.entity, CAST(8 - back AS INT) AS step, CAST(hi + CAST(8 - back AS INT) AS DATE) AS date, value AS forecast, 'week-1' AS version FROM n JOIN m ON m.entity = n.entity WHERE back <= 7""")
def batch_scores(spark: SparkSession, d: str) -> DataFrame:
    """The last week of each priority as the vector of the next."""
    w = series("entity", "ts")
    n = daily(spark, d).withColumn("week", F.collect_list("value").over(w.rowsBetween(-6, 0)))
    return drift.batch_scores(n.groupBy("entity").agg(F.max("ts").alias("ts"), F.max_by("week", "ts").alias("week")), "entity", "ts", "week", "week-1")
