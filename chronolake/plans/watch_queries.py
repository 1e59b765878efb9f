"""Queries on tests, anomalies, drift, windows of streams, distances and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolake.functions import metrics
from chronolake.functions.windows import series
from chronolake.operators import anomaly, distance, drift, graph, stats
from chronolake.plans.catalog import DAILY, TOTAL, daily, no_zone, query, rounded, table, total
from chronolake.plans.model_queries import BASELINES, baselines
from chronolake.streaming import jobs

# ---------------------------------------------------------------- tests


@query(f"""
WITH {DAILY}, n AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, value - avg(value) OVER (PARTITION BY entity) AS d FROM daily), g AS (SELECT entity, sum(d * d) AS g0, count(*) AS n FROM n GROUP BY 1),
k AS (SELECT unnest(generate_series(1, 14)) AS lag), s AS (SELECT a.entity, lag, sum(a.d * b.d) AS g FROM n a CROSS JOIN k JOIN n b ON a.entity = b.entity AND b.i = a.i - lag GROUP BY 1, 2)
SELECT entity, CAST(lag AS INT) AS lag, round(g / g0, 6) + 0.0 AS rho, n, abs(g / g0) > 1.96 / sqrt(n) AS significant FROM s JOIN g USING (entity)""")
def acf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.acf(daily(spark, d), "entity", "ts", "value", 14))


@query(f"""
WITH {DAILY}, n AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, value - avg(value) OVER (PARTITION BY entity) AS d FROM daily), g AS (SELECT entity, sum(d * d) AS g0, count(*) AS n FROM n GROUP BY 1),
k AS (SELECT unnest(generate_series(1, 14)) AS lag), s AS (SELECT a.entity, lag, sum(a.d * b.d) AS g FROM n a CROSS JOIN k JOIN n b ON a.entity = b.entity AND b.i = a.i - lag GROUP BY 1, 2)
SELECT entity, round(max(n * (n + 2.0)) * sum(pow(g / g0, 2) / (n - lag)), 4) AS q, CAST(max(lag) AS INT) AS lags FROM s JOIN g USING (entity) GROUP BY 1""")
def ljung_box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.ljung_box(stats.acf(daily(spark, d), "entity", "ts", "value", 14), "entity"), 4)


@query(f"WITH {BASELINES}, x AS (SELECT entity, e7, e7 - lag(e7) OVER (PARTITION BY entity ORDER BY ts) AS d FROM b) SELECT entity, round(sum(d * d) / sum(e7 * e7), 6) AS dw FROM x GROUP BY 1")
def durbin_watson(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.durbin_watson(baselines(spark, d), "entity", "ts", "e7"))


@query(f"""
WITH {BASELINES}, l AS (SELECT entity, ts, e7 * e7 - e1 * e1 AS d FROM b), c AS (SELECT *, d - avg(d) OVER (PARTITION BY entity) AS c FROM l), w AS (SELECT *, lag(c, 1) OVER v AS c1, lag(c, 2) OVER v AS c2 FROM c WINDOW v AS (PARTITION BY entity ORDER BY ts)),
a AS (SELECT entity, count(*) AS n, avg(d) AS m, sum(c * c) AS g0, sum(c * c1) AS g1, sum(c * c2) AS g2 FROM w GROUP BY 1), s AS (SELECT *, m / sqrt((g0 / n + 2 * (1 - 1.0 / 3) * g1 / n + 2 * (1 - 2.0 / 3) * g2 / n) / n) AS dm FROM a)
SELECT entity, n, round(dm, 5) AS dm, round(dm * sqrt((n + 1 - 6 + 6.0 / n) / n), 5) AS dm_modified FROM s""")
def diebold_mariano(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.diebold_mariano(baselines(spark, d), "entity", "ts", "e7", "e1", 3).select("entity", "n", "dm", "dm_modified"), 5)


@query(f"WITH {BASELINES} SELECT entity, count(*) AS n, round(avg(abs(e7) - abs(e1)), 4) + 0.0 AS mean_d, round(avg(abs(e7) - abs(e1)) / (stddev_samp(abs(e7) - abs(e1)) / sqrt(count(*))), 5) + 0.0 AS t FROM b GROUP BY 1")
def paired_t(spark: SparkSession, d: str) -> DataFrame:
    b = baselines(spark, d).withColumns({"a7": F.abs("e7"), "a1": F.abs("e1")})
    return rounded(stats.paired_t(b, "entity", "a7", "a1"), 5, mean_d=4)


@query(f"""
WITH {DAILY}, e AS (SELECT entity, ts, value - avg(value) OVER (PARTITION BY entity) AS e FROM daily), s AS (SELECT *, sum(e) OVER v AS s, lag(e, 1) OVER v AS e1, lag(e, 2) OVER v AS e2, lag(e, 3) OVER v AS e3 FROM e WINDOW v AS (PARTITION BY entity ORDER BY ts)),
a AS (SELECT entity, count(*) AS n, sum(s * s) AS ss, sum(e * e) AS g0, sum(e * e1) AS g1, sum(e * e2) AS g2, sum(e * e3) AS g3 FROM s GROUP BY 1)
SELECT entity, n, round(ss / n / n / ((g0 + 2 * 0.75 * g1 + 2 * 0.5 * g2 + 2 * 0.25 * g3) / n), 6) AS kpss FROM a""")
def kpss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.kpss(daily(spark, d), "entity", "ts", "value", 3))


HOURS = "h AS (SELECT date_trunc('hour', ts) AS ts, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1)"


def hours(spark: SparkSession, d: str) -> DataFrame:
    kinds = {k: F.count_if(F.col("event_type") == k).cast("double").alias(k) for k in ("click", "view", "purchase")}
    return table(spark, d, "events").groupBy(no_zone(F.date_trunc("hour", "ts")).alias("ts")).agg(*kinds.values())


@query(f"""
WITH {HOURS}, b AS (SELECT ts, CASE WHEN click > (SELECT quantile_cont(click, 1.0 / 3) FROM h) THEN 1 ELSE 0 END + CASE WHEN click > (SELECT quantile_cont(click, 2.0 / 3) FROM h) THEN 1 ELSE 0 END AS x,
 CASE WHEN view > (SELECT quantile_cont(view, 1.0 / 3) FROM h) THEN 1 ELSE 0 END + CASE WHEN view > (SELECT quantile_cont(view, 2.0 / 3) FROM h) THEN 1 ELSE 0 END AS y FROM h),
t AS (SELECT lead(y) OVER (ORDER BY ts) AS nx, y, x FROM b), j AS (SELECT nx, y, x, count(*) AS n FROM t WHERE nx IS NOT NULL GROUP BY 1, 2, 3)
SELECT round(sum(n * ln(n * yy / (yx * ny))) / sum(n), 6) AS transfer_entropy, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) AS yy, CAST(sum(n) OVER (PARTITION BY y, x) AS DOUBLE) AS yx, CAST(sum(n) OVER (PARTITION BY nx, y) AS DOUBLE) AS ny FROM j) q""")
def transfer_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.transfer_entropy(hours(spark, d), "ts", "click", "view"))


@query(f"""
WITH {HOURS}, k AS (SELECT unnest(generate_series(-3, 3)) AS lag), n AS (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM h)
SELECT CAST(lag AS INT) AS lag, round(corr(CAST(a.click AS DOUBLE), CAST(b.view AS DOUBLE)), 6) + 0.0 AS corr FROM n a CROSS JOIN k JOIN n b ON b.i = a.i - lag GROUP BY 1""")
def cross_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.ccf(hours(spark, d).withColumn("e", F.lit(1)), "e", "ts", "click", "view", 3).select("lag", "corr"))


def least_squares(name: str, rows: str, columns: list[str], target: str, by: str = "g") -> str:
    """SQL (in a recursive WITH) of a regression by normal equations: (``by``, n, rss, coef, inv), inv being the diagonal of the inverse."""
    p = len(columns)
    cells = [f"[{', '.join([*(f'sum({a} * {b})' for b in columns), f'sum({a} * {target})', *('1.0' if a == b else '0.0' for b in columns)])}]" for a in columns]
    return f"""{name}_m AS MATERIALIZED (SELECT {by}, count(*) AS n, sum({target} * {target}) AS yy, [{", ".join(f"sum({c} * {target})" for c in columns)}] AS xy, CAST([{", ".join(cells)}] AS DOUBLE[][]) AS m FROM {rows} GROUP BY 1),
{name}_g AS (SELECT {by}, 0 AS k, m FROM {name}_m UNION ALL SELECT {by}, k + 1, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {2 * p + 2}), lambda j: CASE WHEN i = k + 1 THEN m[i][j] / m[i][i] ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)) FROM {name}_g WHERE k < {p}),
{name} AS MATERIALIZED (SELECT q.{by}, n, yy - list_sum(list_transform(range(1, {p + 1}), lambda i: g.m[i][{p + 1}] * xy[i])) AS rss, list_transform(g.m, lambda r: r[{p + 1}]) AS coef, list_transform(range(1, {p + 1}), lambda i: g.m[i][{p + 1} + i]) AS inv FROM {name}_g g JOIN {name}_m q ON q.{by} = g.{by} WHERE k = {p})"""


def tail_of_f(f: str, first: int, free: str) -> str:
    """SQL of the F distribution's upper tail: in closed form for 2 degrees of freedom, by Simpson's rule (angles of the t distribution) for 1."""
    if first == 2:
        return f"pow({free} / ({free} + 2 * {f}), {free} / 2.0)"
    at = f"atan(sqrt({f} / {free}))"
    return f"2 * exp(lgamma(({free} + 1) / 2.0) - lgamma({free} / 2.0)) / sqrt(pi()) * (pi() / 2 - {at}) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos({at} + (pi() / 2 - {at}) * i / 2000), 0), {free} - 1)))"


def _granger_sql() -> str:
    kinds = ("click", "view")
    cols = ", ".join(f"CAST(lag({c}, {k}) OVER (ORDER BY ts) AS DOUBLE) AS {c}_{k}" for c in kinds for k in (1, 2))
    ctes, out = [f"{HOURS}, x AS (SELECT 'a' AS g, CAST(1 AS DOUBLE) AS one, CAST(click AS DOUBLE) AS click, CAST(view AS DOUBLE) AS view, {cols} FROM h)"], []
    for k in (1, 2):
        ctes.append(f"x{k} AS (SELECT * FROM x WHERE click_{k} IS NOT NULL)")
        for c, e in (kinds, kinds[::-1]):
            own, other = [f"{e}_{i}" for i in range(1, k + 1)], [f"{c}_{i}" for i in range(1, k + 1)]
            ctes += [least_squares(f"small_{e}_{k}", f"x{k}", ["one", *own], e), least_squares(f"full_{e}_{k}", f"x{k}", ["one", *own, *other], e)]
            out.append(f"SELECT cause, effect, lag, f, {tail_of_f('f', k, 'free')} AS p FROM (SELECT '{c}' AS cause, '{e}' AS effect, CAST({k} AS DOUBLE) AS lag, (s.rss - b.rss) / {k} / (b.rss / (b.n - {2 * k + 1})) AS f, b.n - {2 * k + 1} AS free FROM small_{e}_{k} s JOIN full_{e}_{k} b ON s.g = b.g) q")
    return f"WITH RECURSIVE {', '.join(ctes)}, o AS ({' UNION ALL '.join(out)}) SELECT cause, effect, lag, round(f, 5) AS f, round(p, 6) AS p_value FROM o"


@query(_granger_sql())
def granger_f(spark: SparkSession, d: str) -> DataFrame:
    h = hours(spark, d)
    rows = [(c, e, float(x["lag"]), x["f"], x["p_value"]) for c, e in (("click", "view"), ("view", "click")) for k in (1, 2) for x in [stats.granger(h, "ts", c, e, k)]]
    return rounded(spark.createDataFrame(rows, "cause string, effect string, lag double, f double, p_value double"), 5, p_value=6)


@query(f"""
WITH RECURSIVE {TOTAL}, d AS (SELECT ts, value - lag(value) OVER (ORDER BY ts) AS d, lag(value) OVER (ORDER BY ts) AS l FROM total), x AS (SELECT 'a' AS g, CAST(1 AS DOUBLE) AS one, d, l, lag(d, 1) OVER (ORDER BY ts) AS d1, lag(d, 2) OVER (ORDER BY ts) AS d2, lag(d, 3) OVER (ORDER BY ts) AS d3 FROM d), v AS (SELECT * FROM x WHERE d3 IS NOT NULL), {least_squares("r", "v", ["one", "l", "d1", "d2", "d3"], "d")}
SELECT round(coef[2] / sqrt(rss / (n - 5) * inv[2]), 5) AS stat, CAST(n AS DOUBLE) AS n, CAST(-3.43 AS DOUBLE) AS crit_1, CAST(-2.86 AS DOUBLE) AS crit_5, CAST(-2.57 AS DOUBLE) AS crit_10, CASE WHEN coef[2] / sqrt(rss / (n - 5) * inv[2]) < -2.86 THEN CAST(1 AS DOUBLE) ELSE 0 END AS stationary FROM r""")
def dickey_fuller(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spark.createDataFrame([{k: float(v) for k, v in stats.adf(total(spark, d), "ts", "value", 3).items()}]), 5)


# ---------------------------------------------------------------- drift

HALVES = "s AS (SELECT l_returnflag AS k, l_extendedprice AS v, CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 1 ELSE 0 END AS r FROM lineitem)"


def halves(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("v"), (F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz")).cast("int").alias("r"))


@query(f"""
WITH {HALVES}, c AS (SELECT k, v, sum(r) AS r, sum(1 - r) AS c FROM s GROUP BY 1, 2), f AS (SELECT k, sum(r) OVER w / sum(r) OVER g AS fr, sum(c) OVER w / sum(c) OVER g AS fc, lead(v) OVER w - v AS dx, sum(r) OVER g AS nr, sum(c) OVER g AS nc FROM c WINDOW w AS (PARTITION BY k ORDER BY v), g AS (PARTITION BY k))
SELECT k, CAST(max(nr) AS BIGINT) AS n_reference, CAST(max(nc) AS BIGINT) AS n_current, round(max(abs(fr - fc)), 6) AS ks, round(sum(abs(fr - fc) * coalesce(dx, 0)), 4) AS w1 FROM f GROUP BY 1""")
def ks_wasserstein(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.ks_and_w1(halves(spark, d), "k", "v", "r").drop("ks_p"), 6, w1=4)


@query(f"""
WITH {HALVES}, e AS (SELECT k, quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM s WHERE r = 1 GROUP BY 1),
b AS (SELECT s.k, r, len(list_filter(e[2:10], lambda x: v > x)) AS bin FROM s JOIN e ON s.k = e.k WHERE v >= e[1] AND v <= e[11]), c AS (SELECT k, bin, sum(r) AS r, sum(1 - r) AS c FROM b GROUP BY 1, 2),
p AS (SELECT k, greatest(r / sum(r) OVER w, 1e-6) AS p, greatest(c / sum(c) OVER w, 1e-6) AS q FROM c WINDOW w AS (PARTITION BY k)), z AS (SELECT k, sum((q - p) * ln(q / p)) AS psi FROM p GROUP BY 1)
SELECT k, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'severe' END AS severity FROM z""")
def psi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(drift.psi(halves(spark, d), "k", "v", "r"))


@query(f"""
WITH {HALVES}, e AS (SELECT k, quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e, stddev_samp(v) AS sd FROM s WHERE r = 1 GROUP BY 1),
b AS (SELECT s.k, r, len(list_filter(e[2:10], lambda x: v > x)) AS bin FROM s JOIN e ON s.k = e.k WHERE v >= e[1] AND v <= e[11]), c AS (SELECT k, bin, sum(r) AS r, sum(1 - r) AS c FROM b GROUP BY 1, 2),
p AS (SELECT k, greatest(r / sum(r) OVER w, 1e-6) AS p, greatest(c / sum(c) OVER w, 1e-6) AS q FROM c WINDOW w AS (PARTITION BY k)), z AS (SELECT k, sum((q - p) * ln(q / p)) AS psi FROM p GROUP BY 1),
y AS (SELECT k, v, sum(r) AS r, sum(1 - r) AS c FROM s GROUP BY 1, 2), f AS (SELECT k, sum(r) OVER w / sum(r) OVER g AS fr, sum(c) OVER w / sum(c) OVER g AS fc, lead(v) OVER w - v AS dx, sum(r) OVER g AS nr, sum(c) OVER g AS nc FROM y WINDOW w AS (PARTITION BY k ORDER BY v), g AS (PARTITION BY k)),
t AS (SELECT k, CAST(max(nr) AS BIGINT) AS n_reference, CAST(max(nc) AS BIGINT) AS n_current, max(abs(fr - fc)) AS ks, sum(abs(fr - fc) * coalesce(dx, 0)) AS w1, max(abs(fr - fc)) * sqrt(max(nr) * max(nc) / (max(nr) + max(nc))) AS l FROM f GROUP BY 1),
u AS (SELECT *, least(1.0, greatest(0.0, 2 * exp(-2 * l * l) - 2 * exp(-8 * l * l) + 2 * exp(-18 * l * l) - 2 * exp(-32 * l * l) + 2 * exp(-50 * l * l))) AS ks_p FROM t)
SELECT u.k, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'severe' END AS severity, n_reference, n_current, round(ks, 6) AS ks, round(w1, 4) AS w1, round(ks_p, 6) AS ks_p, round(w1 / sd, 6) AS w1_scaled, psi >= 0.1 OR ks_p < 0.05 AS drifted FROM u JOIN z ON z.k = u.k JOIN e ON e.k = u.k""")
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(drift.drift_report(halves(spark, d), "k", "v", "r"), 6, w1=4)


@query(f"""
WITH {BASELINES}, a AS (SELECT entity, ts, avg(abs(e7)) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) / avg(abs(e7)) OVER (PARTITION BY entity) AS ratio FROM b),
c AS (SELECT *, CASE WHEN ratio > 1.2 THEN 1 WHEN ratio < 1.05 THEN 0 END AS c FROM a), s AS (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM c),
t AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY entity ORDER BY ts), 0) AS was FROM s)
SELECT entity, ts, round(ratio, 6) AS ratio, CAST(state AS INT) AS state, CASE WHEN state = 1 AND was = 0 THEN 'start' WHEN state = 0 AND was = 1 THEN 'end' END AS event FROM t""")
def drift_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    b = baselines(spark, d)
    r = b.withColumn("ratio", drift.rolling_error("e7", "entity", "ts", 30) / F.avg(F.abs("e7")).over(Window.partitionBy("entity")))
    return rounded(drift.hysteresis(r, "entity", "ts", "ratio", 1.2, 1.05).select("entity", "ts", "ratio", "state", "event"))


RULES = [("mae", "gt", 150000.0, "warning", "notify"), ("mae", "gt", 400000.0, "critical", "retrain"), ("bias", "lt", 0.0, "info", "log")]


@query(f"""
WITH {BASELINES}, m AS (SELECT entity, 'mae' AS metric, avg(abs(e7)) AS value FROM b GROUP BY 1 UNION ALL SELECT entity, 'bias', avg(e7) FROM b GROUP BY 1),
r(metric, op, threshold, severity, action) AS (VALUES ('mae', 'gt', 150000.0, 'warning', 'notify'), ('mae', 'gt', 400000.0, 'critical', 'retrain'), ('bias', 'lt', 0.0, 'info', 'log'))
SELECT entity, metric, op, CAST(threshold AS DOUBLE) AS threshold, severity, action, round(value, 3) AS value FROM m JOIN r USING (metric) WHERE (op = 'gt' AND value > threshold) OR (op = 'lt' AND value < threshold)""")
def alert_rules(spark: SparkSession, d: str) -> DataFrame:
    b = baselines(spark, d).groupBy("entity").agg(F.avg(F.abs("e7")).alias("mae"), F.avg("e7").alias("bias"))
    m = b.unpivot("entity", ["mae", "bias"], "metric", "value")
    rules = spark.createDataFrame(RULES, "metric string, op string, threshold double, severity string, action string")
    return rounded(drift.alerts(m, rules).select("entity", "metric", "op", "threshold", "severity", "action", "value"), 3)


@query("""
SELECT event_id, round(quantile_cont(value, 0.5) OVER w, 6) AS p50, round(quantile_cont(value, 0.95) OVER w, 6) AS p95, round(quantile_cont(value, 0.99) OVER w, 6) AS p99 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    cols = drift.latency_window("value", "user_id", ["ts", "event_id"])
    return rounded(table(spark, d, "events").select("event_id", *(c.alias(k) for k, c in cols.items())))


# ---------------------------------------------------------------- anomalies


@query("""
WITH m AS (SELECT l_returnflag AS k, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3, mad(l_extendedprice) AS mad FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 6) + 0.0 AS z, round(0.6745 * (l_extendedprice - q2) / mad, 6) + 0.0 AS robust_z, CASE WHEN abs((l_extendedprice - m) / s) > 1.8 THEN 1 ELSE 0 END AS is_z,
 CASE WHEN abs(0.6745 * (l_extendedprice - q2) / mad) > 1.5 THEN 1 ELSE 0 END AS is_robust, CASE WHEN l_extendedprice < q1 - 0.4 * (q3 - q1) OR l_extendedprice > q3 + 0.4 * (q3 - q1) THEN 1 ELSE 0 END AS is_iqr FROM lineitem JOIN m ON k = l_returnflag""")
def zscore_mad_iqr_flags(spark: SparkSession, d: str) -> DataFrame:
    out = anomaly.outliers(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", 1.8, 1.5, 0.4)
    return rounded(out.select("l_orderkey", "l_linenumber", "z", "robust_z", "is_z", "is_robust", "is_iqr"))


@query(f"""
WITH RECURSIVE {TOTAL}, n AS (SELECT ts, value, row_number() OVER (ORDER BY ts) - 1 AS i FROM total), ref AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM n WHERE i < 200), z AS (SELECT ts, i, (value - m) / (s + 1e-12) AS z FROM n CROSS JOIN ref),
c AS (SELECT ts, i, CAST(0 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS lo FROM z WHERE i = 0 UNION ALL SELECT z.ts, z.i, greatest(0, c.hi + z.z - 0.5), greatest(0, c.lo - z.z - 0.5) FROM c JOIN z ON z.i = c.i + 1)
SELECT ts, round(hi, 5) + 0.0 AS s_hi, round(lo, 5) + 0.0 AS s_lo, CASE WHEN greatest(hi, lo) > 5 THEN 1 ELSE 0 END AS alarm FROM c""")
def cusum_two_sided(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.cusum(total(spark, d), "entity", "ts", "value", 200).select("ts", "s_hi", "s_lo", "alarm"), 5)


@query(f"""
WITH {TOTAL} SELECT ts, round(CASE WHEN count(value) OVER w = 20 THEN avg(value) OVER w + 2 * stddev_samp(value) OVER w END, 3) AS upper, round(CASE WHEN count(value) OVER w = 20 THEN avg(value) OVER w - 2 * stddev_samp(value) OVER w END, 3) AS lower,
 round(CASE WHEN count(value) OVER w = 20 THEN (value - (avg(value) OVER w - 2 * stddev_samp(value) OVER w)) / (4 * stddev_samp(value) OVER w) END, 6) AS pct_b FROM total WINDOW w AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def bollinger_pctb(spark: SparkSession, d: str) -> DataFrame:
    cols = anomaly.bands("value", "entity", "ts", 20)
    return rounded(total(spark, d).select("ts", *(c.alias(k) for k, c in cols.items() if k != "middle")), 3, pct_b=6)


@query(f"""
WITH {TOTAL}, n AS (SELECT ts, value, row_number() OVER (ORDER BY ts) AS i FROM total), f AS (SELECT i, CASE WHEN value > (SELECT quantile_cont(value, 0.9) FROM total) THEN 1 ELSE 0 END AS f FROM n), h AS (SELECT i, CASE WHEN i - lag(i) OVER (ORDER BY i) <= 3 THEN 0 ELSE 1 END AS nw FROM f WHERE f = 1),
r AS (SELECT i, sum(nw) OVER (ORDER BY i) AS region FROM h) SELECT CAST(region AS BIGINT) AS region, min(i) AS start, max(i) AS "end", count(*) AS n_flagged FROM r GROUP BY 1""")
def anomaly_regions(spark: SparkSession, d: str) -> DataFrame:
    n = total(spark, d).withColumn("i", F.row_number().over(series("entity", "ts")).cast("long"))
    flagged = n.join(F.broadcast(n.agg(F.percentile("value", 0.9).alias("q")))).withColumn("f", (F.col("value") > F.col("q")).cast("int"))
    return anomaly.regions(flagged, "entity", "i", "f", 3).drop("entity")


@query("""
WITH q AS (SELECT event_type AS k, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1) SELECT event_id, round(least(greatest(value, lo), hi), 6) AS winsorized FROM events JOIN q ON k = event_type""")
def winsorize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.winsorized(table(spark, d, "events"), "event_type", "value").select("event_id", "winsorized"))


@query("""
SELECT event_id, round(CASE WHEN count(*) OVER w >= 2 AND stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END, 5) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def welford_running_z(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jobs.running_z(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "z"), 5)


@query(f"""
WITH {TOTAL}, n AS (SELECT ts, value AS a, abs(value - lag(value, 1, value) OVER (ORDER BY ts)) AS b FROM total)
SELECT ts, round(0.7 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 0.3 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS ensemble FROM n""")
def weighted_ensemble(spark: SparkSession, d: str) -> DataFrame:
    w = series("entity", "ts")
    n = total(spark, d).select("entity", "ts", F.col("value").alias("a"), F.abs(F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value"))).alias("b"))
    return rounded(anomaly.ensemble(n, "entity", {"a": 0.7, "b": 0.3}).select("ts", "ensemble"))


@query("""
WITH RECURSIVE n AS (SELECT event_type AS effect, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cause FROM events), c AS (SELECT cause, effect, count(*) AS n FROM n WHERE cause <> effect GROUP BY 1, 2), e AS (SELECT cause, effect FROM c WHERE n > (SELECT avg(n) FROM c)), t AS (SELECT event_type AS node, epoch(min(ts)) AS time FROM events GROUP BY 1),
w AS (SELECT node, 0 AS depth FROM t WHERE node = 'purchase' UNION SELECT e.cause, w.depth + 1 FROM w JOIN e ON e.effect = w.node WHERE w.depth < 5)
SELECT t.node, CAST(min(depth) AS INT) AS depth, round(any_value(t.time), 3) AS time FROM w JOIN t ON t.node = w.node WHERE depth = 0 OR t.time < (SELECT time FROM t WHERE node = 'purchase') + 7200 GROUP BY 1""")
def rca_trace(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of events that lead to purchases: a kind causes another where users go from it to that more often than from one to another on the average; two hours late is early enough."""
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    steps = e.select(F.col("event_type").alias("effect"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("cause")).where("cause <> effect")
    counts = steps.groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("n"))
    edges = counts.join(F.broadcast(counts.agg(F.avg("n").alias("usual")))).where("n > usual").select("cause", "effect")
    times = e.groupBy(F.col("event_type").alias("node")).agg(F.min("ts").cast("double").alias("time"))
    return rounded(anomaly.trace_causes(edges, times, "purchase", tolerance=7200.0), 3)


@query()
def isolation_scores(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.isolation_forest(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(f"""
WITH RECURSIVE {DAILY}, n AS MATERIALIZED (SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY ts) AS INT) AS i, CASE WHEN (value - avg(value) OVER w) / CASE WHEN count(value) OVER w >= 14 AND stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w END > 2 THEN 1 END AS f FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
h AS MATERIALIZED (SELECT entity, i, lead(i) OVER (PARTITION BY entity ORDER BY i) AS nx FROM n WHERE f = 1), a AS (SELECT entity, min(i) AS i FROM h GROUP BY 1 UNION ALL SELECT a.entity, (SELECT min(h.i) FROM h WHERE h.entity = a.entity AND h.i >= a.i + 10) FROM a WHERE (SELECT min(h.i) FROM h WHERE h.entity = a.entity AND h.i >= a.i + 10) IS NOT NULL)
SELECT n.entity, n.i, coalesce(f, 0) AS f, CASE WHEN a.i IS NULL THEN 0 ELSE 1 END AS alert FROM n LEFT JOIN a ON a.entity = n.entity AND a.i = n.i""")
def alert_cooldown(spark: SparkSession, d: str) -> DataFrame:
    n = daily(spark, d).withColumn("i", F.row_number().over(series("entity", "ts"))).withColumn("z", anomaly.rolling_z("value", "entity", "ts", 28))
    return anomaly.cooled(n.select("entity", "i", F.coalesce((F.col("z") > 2).cast("int"), F.lit(0)).alias("f")), "entity", "i", "f", 10)


# ---------------------------------------------------------------- windows of streams, on whole tables


@query("SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jobs.windowed(table(spark, d, "events"), "user_id", "ts", "value", "1 hour"))


@query("""
WITH k AS (SELECT unnest(generate_series(0, 3)) AS k) SELECT event_type, CAST(time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS TIMESTAMP) AS start, count(*) AS n, round(sum(value), 6) AS value FROM events CROSS JOIN k GROUP BY 1, 2""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jobs.windowed(table(spark, d, "events"), "event_type", "ts", "value", "1 day", "6 hours"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jobs.sessions(table(spark, d, "events"), "user_id", "ts", "value", "4 hours"))


# ---------------------------------------------------------------- distances and graphs


@query("""
WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 25 = 0), p AS (SELECT q.vec_id AS query_id, q.label AS actual, e.vec_id, e.label, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))) AS d FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p), v AS (SELECT query_id, label, count(*) AS n, min(rank) AS f FROM r WHERE rank <= 5 GROUP BY 1, 2), w AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS o FROM v)
SELECT query_id, label AS predicted FROM w WHERE o = 1""")
def knn_euclid_classify(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    near = distance.k_nearest(e.where("vec_id % 25 = 0"), e, "vec_id", "embedding", 5)
    return distance.knn_classify(near, "label").withColumnRenamed("label", "predicted")


@query(f"""
WITH {HOURS}, c AS (SELECT corr(click, view) AS cv, corr(click, purchase) AS cp, corr(view, purchase) AS vp FROM (SELECT CAST(click AS DOUBLE) AS click, CAST(view AS DOUBLE) AS view, CAST(purchase AS DOUBLE) AS purchase FROM h) x),
e AS (SELECT 'click' AS src, 'view' AS dst, abs(cv) AS w FROM c UNION ALL SELECT 'view', 'click', abs(cv) FROM c UNION ALL SELECT 'click', 'purchase', abs(cp) FROM c UNION ALL SELECT 'purchase', 'click', abs(cp) FROM c UNION ALL SELECT 'view', 'purchase', abs(vp) FROM c UNION ALL SELECT 'purchase', 'view', abs(vp) FROM c)
SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM e WHERE w >= 0.001""")
def corr_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.adjacency(graph.correlations(hours(spark, d), ["click", "view", "purchase"]), 0.001))


@query(f"""
WITH {HOURS}, l AS (SELECT ts, 'click' AS node, click AS v FROM h UNION ALL SELECT ts, 'view', view FROM h UNION ALL SELECT ts, 'purchase', purchase FROM h), e(src, dst, w) AS (VALUES ('click', 'view', 0.5), ('click', 'purchase', 0.5), ('view', 'click', 1.0), ('purchase', 'view', 0.25))
SELECT e.src AS node, CAST(ts AS TIMESTAMP) AS ts, round(CAST(sum(w * v) AS DOUBLE), 6) AS v FROM l JOIN e ON e.dst = l.node GROUP BY 1, 2""")
def graph_hop(spark: SparkSession, d: str) -> DataFrame:
    long = hours(spark, d).unpivot("ts", ["click", "view", "purchase"], "node", "v")
    edges = spark.createDataFrame([("click", "view", 0.5), ("click", "purchase", 0.5), ("view", "click", 1.0), ("purchase", "view", 0.25)], "src string, dst string, w double")
    return rounded(graph.propagated(long, edges, "ts", "node", "v").select("node", "ts", "v"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, len(embedding) AS n FROM embeddings), m AS (SELECT *, list_sum(a) / n AS mean FROM e), p AS (SELECT *, list_transform(a, lambda x: x - mean) AS d, list_sort(a) AS o FROM m), s AS (SELECT *, list_sum(list_transform(d, lambda x: x * x)) AS ss FROM p)
SELECT vec_id, round(mean, 6) + 0.0 AS mean, round(sqrt(ss / n), 6) AS std, round(list_min(a), 6) AS min, round(list_max(a), 6) AS max, round(list_max(a) - list_min(a), 6) AS range, round(list_aggregate(a, 'quantile_cont', 0.5), 6) + 0.0 AS median, round(list_aggregate(a, 'quantile_cont', 0.25), 6) + 0.0 AS q25, round(list_aggregate(a, 'quantile_cont', 0.75), 6) + 0.0 AS q75, round(list_aggregate(a, 'quantile_cont', 0.75) - list_aggregate(a, 'quantile_cont', 0.25), 6) AS iqr,
 round(list_sum(list_transform(d, lambda x: x * x * x)) / n / pow(sqrt(ss / n), 3), 6) + 0.0 AS skew, round(list_sum(list_transform(d, lambda x: x * x * x * x)) / n / pow(ss / n, 2) - 3, 6) + 0.0 AS kurtosis, round(list_sum(list_transform(a, lambda x: x * x)) / n, 6) AS energy, round(list_sum(list_transform(range(1, n), lambda i: abs(a[i + 1] - a[i]))) / (n - 1), 6) AS mean_abs_change,
 CAST(len(list_filter(range(1, n), lambda i: d[i] * d[i + 1] < 0)) AS INT) AS zero_crossings, CAST(len(list_filter(d, lambda x: x > 0)) AS INT) AS above_mean, CAST(len(list_filter(range(2, n), lambda i: a[i] > a[i - 1] AND a[i] > a[i + 1])) AS INT) AS peaks, CAST(list_position(a, list_max(a)) - 1 AS BIGINT) AS argmax, CAST(list_position(a, list_min(a)) - 1 AS BIGINT) AS argmin,
 round(list_sum(list_transform(range(1, n + 1), lambda i: (i - 1 - (n - 1) / 2.0) * a[i])) / list_sum(list_transform(range(1, n + 1), lambda i: pow(i - 1 - (n - 1) / 2.0, 2))), 6) + 0.0 AS slope, round(list_sum(list_transform(range(1, n), lambda i: d[i] * d[i + 1])) / ss, 6) + 0.0 AS acf1, round(list_sum(list_transform(range(1, n - 1), lambda i: d[i] * d[i + 2])) / ss, 6) + 0.0 AS acf2 FROM s""")
def array_features(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rounded(e.select("vec_id", *(c.alias(k) for k, c in distance.features(F.col("x")).items())))


@query("""
WITH c AS (SELECT label AS a, vec_id % 4 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM c), pa AS (SELECT sum(x * (x - 1) / 2.0) AS s FROM (SELECT sum(n) AS x FROM c GROUP BY a) q), pb AS (SELECT sum(x * (x - 1) / 2.0) AS s FROM (SELECT sum(n) AS x FROM c GROUP BY b) q),
m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c), k AS (SELECT sum(n * (n - 1) / 2.0) AS tc, sum(n / t * ln(t * n / (na * nb))) AS mi FROM m CROSS JOIN t)
SELECT round((tc - pa.s * pb.s / (t * (t - 1) / 2)) / ((pa.s + pb.s) / 2 - pa.s * pb.s / (t * (t - 1) / 2)), 6) + 0.0 AS ari, round(mi, 6) AS mi FROM k CROSS JOIN t CROSS JOIN pa CROSS JOIN pb""")
def cluster_agreement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distance.rand_index(table(spark, d, "embeddings").withColumn("b", F.col("vec_id") % 4), "label", "b"))


@query()
def dtw_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return distance.dtw_nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 3).select("query_id", "vec_id", "label", "lb", "d")


@query()
def spectral_features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", distance.spectrum("embedding").alias("spectrum"))


@query("""
WITH s AS (SELECT quality AS y, toxic AS t FROM labels), c AS (SELECT CAST(sum(y * (1 - t)) AS BIGINT) AS tp, CAST(sum((1 - y) * (1 - t)) AS BIGINT) AS fp, CAST(sum(y * t) AS BIGINT) AS fn FROM s)
SELECT tp, fp, fn, round(tp / (tp + fp + 1e-12), 6) AS precision, round(tp / (tp + fn + 1e-12), 6) AS recall, round(2 * (tp / (tp + fp + 1e-12)) * (tp / (tp + fn + 1e-12)) / (tp / (tp + fp + 1e-12) + tp / (tp + fn + 1e-12) + 1e-12), 6) AS f1 FROM c""")
def detection_scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "labels").withColumn("kept", 1 - F.col("toxic"))
    return rounded(s.agg(*(c.alias(k) for k, c in metrics.detection("quality", "kept").items())))
