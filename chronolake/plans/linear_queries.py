"""Queries of models made from sums of products, and their SQL: coordinate descent and elimination step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions.windows import series, whole
from chronolake.operators import gram
from chronolake.plans.catalog import DAILY, MONTHLY, daily, monthly, query, rounded, table
from chronolake.plans.watch_queries import least_squares

LAGS, PENALTIES, FOLDS = (1, 7, 14, 28), (0.3, 0.1, 0.03, 0.01, 0.001), 5
XS = [f"lag_{k}" for k in LAGS]


def lagged(spark: SparkSession, d: str) -> DataFrame:
    """Daily revenue in 100,000 by priority, its lags, and the fifth of its series that a row is in."""
    w = series("entity", "ts")
    x = daily(spark, d).select("entity", "ts", (F.col("value") / 1e5).alias("y"))
    x = x.select("*", *(F.lag("y", k).over(w).alias(f"lag_{k}") for k in LAGS)).dropna()
    return x.withColumn("fold", F.floor(FOLDS * (F.row_number().over(w) - 1) / F.count(F.lit(1)).over(whole("entity"))).cast("int"))


_P = len(XS)
_LAGGED = f"""{DAILY}, s AS (SELECT entity AS g, ts, value / 1e5 AS y, {", ".join(f"lag(value / 1e5, {k}) OVER w AS lag_{k}" for k in LAGS)} FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts)), s0 AS (SELECT * FROM s WHERE lag_{max(LAGS)} IS NOT NULL),
v AS MATERIALIZED (SELECT *, CAST(floor({FOLDS} * (row_number() OVER (PARTITION BY g ORDER BY ts) - 1) / count(*) OVER (PARTITION BY g)) AS INT) AS fold FROM s0)"""
_DESCENT = f"""{_LAGGED}, k AS (SELECT CAST(unnest(range(1, {FOLDS + 1})) AS INT) AS k), l AS (SELECT CAST(unnest([{", ".join(map(str, PENALTIES))}]) AS DOUBLE) AS lam),
tr AS MATERIALIZED (SELECT g, k, avg(y) AS my, [{", ".join(f"avg({x})" for x in XS)}] AS mx, [{", ".join(f"stddev_pop({x})" for x in XS)}] AS dx, [{", ".join(f"covar_pop({x}, y) / stddev_pop({x})" for x in XS)}] AS xy,
 [{", ".join("[" + ", ".join(f"covar_pop({a}, {b}) / stddev_pop({a}) / stddev_pop({b})" for b in XS) + "]" for a in XS)}] AS xx FROM v JOIN k ON v.fold < k.k GROUP BY 1, 2),
cd AS (SELECT g, k, lam, 0 AS it, CAST([{", ".join("0" for _ in XS)}] AS DOUBLE[]) AS b FROM tr CROSS JOIN l
 UNION ALL SELECT g, k, lam, it + 1, list_transform(range(1, {_P + 1}), lambda j: CASE WHEN j = it % {_P} + 1 THEN sign(r) * greatest(abs(r) - lam, 0) ELSE b[j] END)
 FROM (SELECT cd.*, tr.xy[cd.it % {_P} + 1] - list_sum(list_transform(range(1, {_P + 1}), lambda q: CASE WHEN q = cd.it % {_P} + 1 THEN 0 ELSE tr.xx[cd.it % {_P} + 1][q] * cd.b[q] END)) AS r FROM cd JOIN tr ON tr.g = cd.g AND tr.k = cd.k WHERE cd.it < {60 * _P}) z),
fit AS MATERIALIZED (SELECT cd.g, cd.k, lam, list_transform(range(1, {_P + 1}), lambda j: b[j] / dx[j]) AS c, my - list_sum(list_transform(range(1, {_P + 1}), lambda j: b[j] / dx[j] * mx[j])) AS c0 FROM cd JOIN tr ON tr.g = cd.g AND tr.k = cd.k WHERE it = {60 * _P}),
e AS (SELECT f.g, f.k, f.lam, avg(pow(y - c0 - {" - ".join(f"c[{i + 1}] * {x}" for i, x in enumerate(XS))}, 2)) AS mse FROM fit f JOIN v ON v.g = f.g AND v.fold = f.k GROUP BY 1, 2, 3), m AS (SELECT g, lam, avg(mse) AS cv FROM e GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY cv, lam DESC) = 1 AS chosen FROM m)"""


def path(spark: SparkSession, d: str) -> DataFrame:
    return gram.penalty_path(lagged(spark, d), "entity", "fold", XS, "y", PENALTIES)


@query(f"WITH RECURSIVE {_DESCENT} SELECT o.g AS entity, o.lam AS penalty, round(cv, 6) AS cv_mse, chosen, round(c0, 6) AS intercept, CAST(len(list_filter(c, lambda x: x <> 0)) AS INT) AS n_terms FROM o JOIN fit ON fit.g = o.g AND fit.lam = o.lam WHERE fit.k = {FOLDS}")
def lasso_penalty_path(spark: SparkSession, d: str) -> DataFrame:
    return rounded(path(spark, d).select("entity", "penalty", "cv_mse", "chosen", "intercept", F.size(F.filter("coef", lambda x: x != 0)).alias("n_terms")))


@query(f"WITH RECURSIVE {_DESCENT}, c AS (SELECT o.g AS entity, o.lam AS penalty, chosen, unnest([{', '.join(repr(x) for x in XS)}]) AS term, unnest(c) AS c FROM o JOIN fit ON fit.g = o.g AND fit.lam = o.lam WHERE fit.k = {FOLDS}) SELECT entity, penalty, term, round(c, 5) + 0.0 AS coefficient, chosen AND c <> 0 AS selected FROM c")
def lasso_lag_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = path(spark, d).select("entity", "penalty", "chosen", F.posexplode("coef").alias("i", "coefficient"))
    terms = F.array(*map(F.lit, XS))
    return rounded(rows.select("entity", "penalty", terms[F.col("i")].alias("term"), "coefficient", (F.col("chosen") & (F.col("coefficient") != 0)).alias("selected")), 5)


@query()
def bayesian_ridge_rows(spark: SparkSession, d: str) -> DataFrame:
    x = lagged(spark, d)
    return gram.predicted_spread(x, gram.bayesian_ridge(x, "entity", XS, "y"), "entity", XS).select("entity", "ts", "y", "prediction", "std")


# ---------------------------------------------------------------- trend, seasons, holidays

_SHAPE = dict(breaks=4, yearly=2, weekly=1, holidays=("12-25",))


def _trend_terms(ts: str) -> list[str]:
    day, t = f"CAST(date_diff('day', DATE '1970-01-01', {ts}) AS DOUBLE)", f"(CAST(date_diff('day', lo, {ts}) AS DOUBLE) / date_diff('day', lo, hi))"
    out = ["CAST(1 AS DOUBLE)", t, *(f"greatest({t} - {0.8 * k / (_SHAPE['breaks'] + 1)!r}, 0)" for k in range(1, _SHAPE["breaks"] + 1))]
    for period, order in ((365.25, _SHAPE["yearly"]), (7.0, _SHAPE["weekly"])):
        out += [f"{f}(2 * pi() * {k} / {period} * {day})" for k in range(1, order + 1) for f in ("sin", "cos")]
    return out + [f"CASE WHEN strftime({ts}, '%m-%d') = '{h}' THEN CAST(1 AS DOUBLE) ELSE 0 END" for h in _SHAPE["holidays"]]


def ridge_sql(name: str, rows: str, columns: list[str], target: str, penalties: list[float], by: str) -> str:
    """SQL (in a recursive WITH) of a ridge regression by normal equations: (``by``, coef)."""
    p = len(columns)
    cells = [f"[{', '.join([*(f'sum({a} * {b}) + {w if a == b else 0.0}' for b in columns), f'sum({a} * {target})'])}]" for a, w in zip(columns, penalties, strict=True)]
    return f"""{name}_m AS MATERIALIZED (SELECT {by}, CAST([{", ".join(cells)}] AS DOUBLE[][]) AS m FROM {rows} GROUP BY ALL),
{name}_g AS (SELECT {by}, 0 AS k, m FROM {name}_m UNION ALL SELECT {by}, k + 1, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 2}), lambda j: CASE WHEN i = k + 1 THEN m[i][j] / m[i][i] ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)) FROM {name}_g WHERE k < {p}),
{name} AS MATERIALIZED (SELECT {by}, list_transform(m, lambda r: r[{p + 1}]) AS coef FROM {name}_g WHERE k = {p})"""


_TERMS, _BENDS = _trend_terms("ts"), 2 + _SHAPE["breaks"]
_X = [f"x{i}" for i in range(len(_TERMS))]
_WEIGHTS = [0.0, 0.0, *(1.0 for _ in range(_SHAPE["breaks"])), *(0.01 for _ in range(len(_TERMS) - _BENDS))]


@query(f"""
WITH RECURSIVE {DAILY}, ends AS (SELECT entity, min(ts) AS lo, max(ts) AS hi FROM daily GROUP BY 1), v AS (SELECT d.entity, lo, hi, value / 1e5 AS y, {", ".join(f"{t} AS {x}" for t, x in zip(_TERMS, _X, strict=True))} FROM daily d JOIN ends e ON d.entity = e.entity),
{ridge_sql("r", "v", _X, "y", _WEIGHTS, "entity, lo, hi")}, a AS (SELECT *, CAST(unnest(range(1, 15)) AS INT) AS step FROM r), b AS (SELECT *, CAST(hi + step AS DATE) AS ts FROM a), c AS (SELECT entity, step, ts, coef, [{", ".join(_TERMS)}] AS x FROM b)
SELECT entity, step, ts, round(list_sum(list_transform(range(1, {len(_TERMS) + 1}), lambda i: coef[i] * x[i])), 5) AS forecast, round(list_sum(list_transform(range(1, {_BENDS + 1}), lambda i: coef[i] * x[i])), 5) AS trend FROM c""")
def piecewise_trend_forecast(spark: SparkSession, d: str) -> DataFrame:
    x = daily(spark, d).withColumn("value", F.col("value") / 1e5)
    return rounded(gram.piecewise_trend(x, "entity", "ts", "value", 14, **_SHAPE), 5)


# ---------------------------------------------------------------- cointegration, breaks

_TWO = ["d0", "d1", "l0", "l1"]
_S = {(a, b): f"(m.{a}_{b} - list_dot_product(r_{a}.coef, r_{b}_m.xy))" for i, a in enumerate(_TWO) for b in _TWO[i:]}


@query(f"""
WITH RECURSIVE o AS (SELECT o_orderpriority AS g, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) / 1e5 AS v, count(*) AS c FROM orders GROUP BY 1, 2), x AS (SELECT g, ts, sum(v) OVER w AS x0, CAST(sum(c) OVER w AS DOUBLE) AS x1 FROM o WINDOW w AS (PARTITION BY g ORDER BY ts)),
l AS (SELECT g, ts, lag(x0) OVER w AS l0, lag(x1) OVER w AS l1, x0 - lag(x0) OVER w AS d0, x1 - lag(x1) OVER w AS d1 FROM x WINDOW w AS (PARTITION BY g ORDER BY ts)), p AS (SELECT *, CAST(1 AS DOUBLE) AS one, lag(d0) OVER w AS p0, lag(d1) OVER w AS p1 FROM l WINDOW w AS (PARTITION BY g ORDER BY ts)), v AS MATERIALIZED (SELECT * FROM p WHERE p0 IS NOT NULL),
m AS (SELECT g, count(*) AS n, {", ".join(f"sum({a} * {b}) AS {a}_{b}" for a, b in _S)} FROM v GROUP BY 1), {", ".join(least_squares(f"r_{a}", "v", ["one", "p0", "p1"], a) for a in _TWO)},
s AS (SELECT m.g, m.n, {", ".join(f"{q} / m.n AS {a}_{b}" for (a, b), q in _S.items())} FROM m {" ".join(f"JOIN r_{a} ON r_{a}.g = m.g JOIN r_{a}_m ON r_{a}_m.g = m.g" for a in _TWO)}),
i AS (SELECT *, d0_d0 * d1_d1 - d0_d1 * d0_d1 AS det0, l0_l0 * l1_l1 - l0_l1 * l0_l1 AS det1 FROM s),
a AS (SELECT *, (d0_l0 * d0_l0 * d1_d1 - 2 * d0_l0 * d1_l0 * d0_d1 + d1_l0 * d1_l0 * d0_d0) / det0 AS a00, (d0_l0 * d0_l1 * d1_d1 - (d0_l0 * d1_l1 + d1_l0 * d0_l1) * d0_d1 + d1_l0 * d1_l1 * d0_d0) / det0 AS a01, (d0_l1 * d0_l1 * d1_d1 - 2 * d0_l1 * d1_l1 * d0_d1 + d1_l1 * d1_l1 * d0_d0) / det0 AS a11 FROM i),
t AS (SELECT *, (l1_l1 * a00 - 2 * l0_l1 * a01 + l0_l0 * a11) / det1 AS tr, (a00 * a11 - a01 * a01) / det1 AS de FROM a), e AS (SELECT g, n, (tr + sqrt(greatest(tr * tr - 4 * de, 0))) / 2 AS e0, (tr - sqrt(greatest(tr * tr - 4 * de, 0))) / 2 AS e1 FROM t),
q AS (SELECT g, -n * (ln(1 - e0) + ln(1 - e1)) AS t0, -n * ln(1 - e1) AS t1, e0, e1 FROM e), k AS (SELECT *, CASE WHEN t0 <= 15.4943 THEN 0 WHEN t1 <= 3.8415 THEN 1 ELSE 2 END AS rank FROM q)
SELECT g AS entity, CAST(0 AS INT) AS rank_null, round(e0, 5) AS eigenvalue, round(t0, 2) AS trace, 15.4943::DOUBLE AS critical, t0 > 15.4943 AS rejected, rank FROM k UNION ALL SELECT g, 1, round(e1, 5), round(t1, 2), 3.8415::DOUBLE, t1 > 3.8415, rank FROM k""")
def johansen_rank(spark: SparkSession, d: str) -> DataFrame:
    """Running totals of revenue and of orders, by priority."""
    w = series("entity", "ts")
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("ts")).agg((F.sum("o_totalprice") / 1e5).alias("v"), F.count(F.lit(1)).alias("c"))
    x = o.select("entity", "ts", F.sum("v").over(w).alias("revenue"), F.sum("c").over(w).cast("double").alias("orders"))
    found = gram.johansen(x, "entity", "ts", ["revenue", "orders"], 1).drop("vector", "loading")
    return rounded(found, 5, trace=2)


@query(f"""
WITH RECURSIVE {MONTHLY}, s AS (SELECT entity, ts, value / 1e6 AS y, row_number() OVER w AS r, lag(value / 1e6) OVER w AS l FROM monthly WINDOW w AS (PARTITION BY entity ORDER BY ts)), z AS (SELECT *, y - l AS z, CAST(r AS DOUBLE) AS t FROM s), q AS (SELECT *, lag(z) OVER (PARTITION BY entity ORDER BY ts) AS z1 FROM z),
v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, count(*) OVER (PARTITION BY entity) AS m FROM q WHERE z1 IS NOT NULL), b AS (SELECT entity, ts AS break_at, i AS place, entity || '|' || i AS g FROM v WHERE i >= ceil(0.15 * m) AND i <= floor(0.85 * m)),
x AS MATERIALIZED (SELECT b.g, CAST(1 AS DOUBLE) AS one, t, z1, CASE WHEN i > place THEN CAST(1 AS DOUBLE) ELSE 0 END AS du, l, z FROM v JOIN b ON b.entity = v.entity), {least_squares("f", "x", ["one", "t", "z1", "du", "l"], "z")},
c AS (SELECT entity, break_at, n, coef[5] / sqrt(rss / (n - 5) * inv[5]) AS s FROM f JOIN b ON f.g = b.g), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s, break_at) AS o FROM c)
SELECT entity, n, break_at, round(s, 4) AS statistic, CAST(-4.93 AS DOUBLE) AS critical, s < -4.93 AS stationary FROM k WHERE o = 1""")
def zivot_andrews(spark: SparkSession, d: str) -> DataFrame:
    m = monthly(spark, d).withColumn("value", F.col("value") / 1e6)
    return rounded(gram.zivot_andrews(m, "entity", "ts", "value", 1), 4, critical=2)
