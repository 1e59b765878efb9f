"""Queries of the block bootstrap, and SQL with the same draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions.windows import series
from chronolake.operators import bootstrap
from chronolake.plans.catalog import DAILY, daily, query, rounded

MODELS = ("last", "week", "fortnight", "mean_28")
BLOCK, REPLICATES, ALPHA = 10, 200, 0.1


def losses(spark: SparkSession, d: str) -> DataFrame:
    """Absolute errors of four plain forecasts of each priority's daily revenue, in 100,000; their own residual as ``e``."""
    w = series("entity", "ts")
    x = daily(spark, d).select("entity", "ts", (F.col("value") / 1e5).alias("y"))
    made = {"last": F.lag("y", 1).over(w), "week": F.lag("y", 7).over(w), "fortnight": F.lag("y", 14).over(w), "mean_28": F.avg("y").over(w.rowsBetween(-28, -1))}
    x = x.select("entity", "ts", "y", F.row_number().over(w).alias("i"), *(c.alias(k) for k, c in made.items())).where("i > 28")
    return x.select("entity", "ts", "y", (F.col("y") - F.col("mean_28")).alias("e"), *(F.abs(F.col("y") - F.col(k)).alias(k) for k in MODELS))


_LOSSES = f"""{DAILY}, x AS (SELECT entity, ts, value / 1e5 AS y, lag(value / 1e5, 1) OVER w AS last, lag(value / 1e5, 7) OVER w AS week, lag(value / 1e5, 14) OVER w AS fortnight, avg(value / 1e5) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS mean_28, row_number() OVER w AS i FROM daily WINDOW w AS (PARTITION BY entity ORDER BY ts)),
l AS MATERIALIZED (SELECT entity, ts, y, y - mean_28 AS e, {", ".join(f"abs(y - {m}) AS {m}" for m in MODELS)}, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, count(*) OVER (PARTITION BY entity) AS n FROM x WHERE i > 28)"""


def _draw(slot: str) -> str:
    return f"CAST('0x' || substr(md5('42|' || entity || '|' || r || '|' || {slot}), 1, 8) AS BIGINT)"


_MEANS = f"""{_LOSSES}, s AS (SELECT DISTINCT entity, n FROM l), r AS (SELECT entity, n, CAST(unnest(range(1, {REPLICATES + 1})) AS INT) AS r FROM s), k AS (SELECT *, CAST(unnest(range(1, CAST(ceil(n / {BLOCK}.0) AS BIGINT) + 1)) AS INT) AS k FROM r), p AS (SELECT entity, r, {_draw("k")} % (n - {BLOCK} + 1) + 1 AS i FROM k),
b AS (SELECT p.entity, p.r, {", ".join(f"avg({m}) AS {m}" for m in MODELS)} FROM p JOIN l ON l.entity = p.entity AND l.i BETWEEN p.i AND p.i + {BLOCK - 1} GROUP BY 1, 2),
v AS MATERIALIZED (SELECT * FROM b UNION ALL SELECT entity, 0, {", ".join(f"avg({m})" for m in MODELS)} FROM l GROUP BY 1), u AS MATERIALIZED (UNPIVOT v ON {", ".join(MODELS)} INTO NAME model VALUE v)"""


@query(f"WITH {_MEANS} SELECT entity, model AS \"column\", round(max(v) FILTER (WHERE r = 0), 5) AS mean, round(quantile_cont(v, {ALPHA / 2}) FILTER (WHERE r > 0), 5) AS lower, round(quantile_cont(v, {1 - ALPHA / 2}) FILTER (WHERE r > 0), 5) AS upper FROM u GROUP BY 1, 2")
def bootstrap_mean_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.mean_intervals(losses(spark, d), "entity", "ts", MODELS, BLOCK, REPLICATES, ALPHA), 5)


@query(f"""
WITH {_LOSSES}, s AS (SELECT entity, any_value(n) AS n, arg_max(y - e, ts) AS f FROM l GROUP BY 1), a AS (SELECT *, CAST(unnest(range(1, 15)) AS INT) AS step FROM s), r AS (SELECT *, CAST(unnest(range(1, {REPLICATES + 1})) AS INT) AS r FROM a),
p AS (SELECT *, {_draw(f"CAST((step - 1) // {BLOCK} AS INT)")} % (n - {BLOCK} + 1) + 1 + (step - 1) % {BLOCK} AS at_i FROM r)
SELECT p.entity, step, round(f, 5) AS forecast, round(quantile_cont(f + l.e, {ALPHA / 2}), 5) AS lower, round(quantile_cont(f + l.e, {1 - ALPHA / 2}), 5) AS upper FROM p JOIN l ON l.entity = p.entity AND l.i = p.at_i GROUP BY p.entity, step, f""")
def block_bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    x = losses(spark, d)
    last = x.groupBy("entity").agg(F.max_by(F.col("y") - F.col("e"), "ts").alias("forecast")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(14))))
    return rounded(bootstrap.forecast_intervals(x, last, "entity", "ts", "e", "forecast", BLOCK, REPLICATES, ALPHA), 5)


def _rounds() -> str:
    ctes = ["left_0 AS (SELECT DISTINCT entity, model, 1.0::DOUBLE AS p, true AS go FROM u)"]
    for k in range(len(MODELS) - 1):
        ctes.append(f"""c_{k} AS (SELECT u.entity, u.model, r, v - avg(v) OVER (PARTITION BY u.entity, r) AS d FROM u JOIN left_{k} q ON q.entity = u.entity AND q.model = u.model WHERE q.go),
e_{k} AS (SELECT c.entity, c.model, c.r, c.d - o.d AS b, o.d AS d FROM c_{k} c JOIN c_{k} o ON o.entity = c.entity AND o.model = c.model AND o.r = 0 WHERE c.r > 0), t_{k} AS (SELECT entity, model, any_value(d) / (stddev_pop(b) + 1e-12) AS t, stddev_pop(b) + 1e-12 AS s FROM e_{k} GROUP BY 1, 2),
m_{k} AS (SELECT entity, max(t) AS t, arg_max(model, t) AS worst FROM t_{k} GROUP BY 1), p_{k} AS (SELECT entity, worst, avg(CASE WHEN h >= t THEN 1.0 ELSE 0 END) AS p FROM (SELECT e.entity, e.r, max(e.b / t.s) AS h FROM e_{k} e JOIN t_{k} t ON t.entity = e.entity AND t.model = e.model GROUP BY 1, 2) x JOIN m_{k} USING (entity) GROUP BY 1, 2),
left_{k + 1} AS MATERIALIZED (SELECT q.entity, q.model, CASE WHEN NOT q.go THEN q.p WHEN p.p >= {ALPHA} THEN p.p WHEN q.model = p.worst THEN p.p ELSE 1.0 END AS p, q.go AND p.p < {ALPHA} AND q.model <> p.worst AS go, p.p < {ALPHA} AND q.go AND q.model = p.worst AS gone FROM left_{k} q LEFT JOIN p_{k} p ON p.entity = q.entity)""")
    gone = " UNION ALL ".join(f"SELECT entity, model FROM left_{k} WHERE gone" for k in range(1, len(MODELS)))
    return f"WITH {_MEANS}, {', '.join(ctes)}, gone AS ({gone}) SELECT u.entity, u.model, round(u.v, 5) AS loss, g.model IS NULL AS kept, round(CAST(q.p AS DOUBLE), 6) AS p_value FROM u JOIN left_{len(MODELS) - 1} q ON q.entity = u.entity AND q.model = u.model LEFT JOIN gone g ON g.entity = u.entity AND g.model = u.model WHERE u.r = 0"


@query(_rounds())
def confidence_set(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.confidence_set(losses(spark, d), "entity", "ts", MODELS, BLOCK, REPLICATES, ALPHA), 5, p_value=6)
