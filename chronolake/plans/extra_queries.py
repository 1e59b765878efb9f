"""Queries of single operators: scores of distributions, shapes, clusters, encodings, feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions import metrics
from chronolake.functions.windows import series, whole
from chronolake.operators import distance, features, graph, probabilistic, stats
from chronolake.plans.bootstrap_queries import _LOSSES, losses
from chronolake.plans.catalog import DAILY, daily, no_zone, query, rounded, table
from chronolake.session import shared_folder
from chronolake.sources import readers


def _cdf(z: str) -> str:
    """SQL of the same rational approximation of the normal distribution as ``scalars.normal_cdf``."""
    x = f"(abs({z}) / sqrt(2.0))"
    t, poly = f"(1 / (1 + {x} / 2))", "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * {t} + {c})"
    half = f"({t} * exp(-{x} * {x} + {poly}) / 2)"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {half} ELSE {half} END)"


@query(f"""
WITH {_LOSSES}, s AS (SELECT entity, stddev_samp(e) AS s FROM l WHERE i <= 0.6 * n GROUP BY 1), z AS (SELECT l.entity, s, e / s AS z FROM l JOIN s ON s.entity = l.entity WHERE i > 0.6 * n)
SELECT entity, count(*) AS n, round(avg(s * (z * (2 * {_cdf("z")} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 5) AS crps FROM z GROUP BY 1""")
def gaussian_crps(spark: SparkSession, d: str) -> DataFrame:
    """Normal forecasts around the mean of 28 days, as wide as the errors of the first three fifths, on the rest."""
    x = losses(spark, d).withColumns({"i": F.row_number().over(series("entity", "ts")), "n": F.count(F.lit(1)).over(whole("entity"))})
    s = x.where("i <= 0.6 * n").groupBy("entity").agg(F.stddev_samp("e").alias("s"))
    later = x.where("i > 0.6 * n").join(s, "entity").withColumn("crps", probabilistic.crps_normal(F.col("y"), F.col("y") - F.col("e"), F.col("s")))
    return rounded(later.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg("crps").alias("crps")), 5)


@query("""
WITH d AS (SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id)), p AS (SELECT source, quality, avg(CAST(quality AS DOUBLE)) OVER (PARTITION BY source) AS p FROM d)
SELECT source, count(*) AS n, round(avg(pow(p - quality, 2)), 6) AS brier FROM p GROUP BY 1""")
def brier_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The share of good documents of a source as the forecast of each of them."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    p = x.groupBy("source").agg(F.avg("quality").alias("p"))
    return rounded(x.join(p.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"), metrics.brier("quality", "p").alias("brier")))


SHAPE = [0.5, -0.5, 1.0, -1.0, 0.25]


@query(f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), w AS (SELECT vec_id, x, unnest(range(1, len(x) - {len(SHAPE) - 2})) AS i FROM e)
SELECT vec_id, round(sqrt(min({" + ".join(f"pow(x[i + {k}] - ({s}), 2)" for k, s in enumerate(SHAPE))}) / {len(SHAPE)}), 6) AS distance FROM w GROUP BY 1""")
def shapelet_distances(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rounded(e.select("vec_id", distance.shapelet(F.col("x"), SHAPE).alias("distance")))


_FAR = "list_sum(list_transform(range(1, len({a}) + 1), lambda k: pow({a}[k] - {b}[k], 2)))"


@query(f"""
WITH e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id, a.label, b.label AS other, {_FAR.format(a="a.x", b="b.x")} AS far FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, label, other, avg(far) AS m FROM p GROUP BY 1, 2, 3), s AS (SELECT vec_id, label, max(m) FILTER (WHERE label = other) AS a, min(m) FILTER (WHERE label <> other) AS b FROM m GROUP BY 1, 2), q AS (SELECT label, count(*) AS n, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM s GROUP BY 1),
u AS (SELECT label, vec_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM e), c AS (SELECT label, list(v ORDER BY i) AS mean FROM (SELECT label, i, avg(v) AS v FROM u GROUP BY 1, 2) y GROUP BY 1), g AS (SELECT list(v ORDER BY i) AS mean FROM (SELECT i, avg(v) AS v FROM u GROUP BY 1) y),
t AS (SELECT e.label, count(*) AS n, avg(sqrt({_FAR.format(a="e.x", b="c.mean")})) AS s, sum({_FAR.format(a="e.x", b="c.mean")}) AS w FROM e JOIN c ON c.label = e.label GROUP BY 1), r AS (SELECT a.label, max((t.s + o.s) / sqrt({_FAR.format(a="a.mean", b="b.mean")})) AS r FROM c a JOIN c b ON a.label <> b.label JOIN t ON t.label = a.label JOIN t o ON o.label = b.label GROUP BY 1),
h AS (SELECT sum(t.n * {_FAR.format(a="c.mean", b="g.mean")}) / (count(*) - 1) / (sum(t.w) / (sum(t.n) - count(*))) AS ch FROM t JOIN c ON c.label = t.label, g)
SELECT q.label, q.n, round(silhouette, 6) AS silhouette, round((SELECT avg(r) FROM r), 6) AS davies_bouldin, round((SELECT ch FROM h), 6) AS calinski_harabasz FROM q""")
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(distance.cluster_quality(table(spark, d, "embeddings"), "embedding", "label"))


@query("""
WITH u AS (SELECT label < 5 AS part, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT part, i, avg(x) AS m, stddev_pop(x) AS s FROM u GROUP BY 1, 2)
SELECT round(avg(abs(a.m - b.m)), 6) AS mean_error, round(avg(abs(a.s - b.s)), 6) AS std_error FROM m a JOIN m b ON a.i = b.i AND a.part AND NOT b.part""")
def fidelity_of_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x"))
    return rounded(graph.fidelity(e.where("label < 5"), e.where("label >= 5"), "x"))


@query("""
WITH t AS (SELECT l_partkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), g AS (SELECT avg(l_quantity) AS g FROM t), k AS (SELECT l_partkey, (count(*) * avg(l_quantity) + 5 * any_value(g)) / (count(*) + 5) AS e FROM t, g GROUP BY 1)
SELECT l.l_partkey, count(*) AS n, round(max(coalesce(e, g)), 6) AS encoded, max(e) IS NULL AS unseen FROM lineitem l LEFT JOIN k ON k.l_partkey = l.l_partkey, g WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1""")
def encoding_of_unseen_keys(spark: SparkSession, d: str) -> DataFrame:
    """Mean quantity by part before 1996, put on the lines since."""
    x = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_shipdate")
    fitted = features.fit_encoding(x.where("l_shipdate < TIMESTAMP '1996-01-01'"), "l_partkey", "l_quantity", 5)
    later = features.encode(x.where("l_shipdate >= TIMESTAMP '1996-01-01'"), "l_partkey", fitted)
    known = fitted.select("l_partkey", F.lit(True).alias("known"))
    one = later.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("encoded").alias("encoded"))
    return rounded(one.join(known, "l_partkey", "left").select("l_partkey", "n", "encoded", F.col("known").isNull().alias("unseen")))


@query(f"""
WITH RECURSIVE {DAILY}, d AS (SELECT entity, ts, value - avg(value) OVER (PARTITION BY entity) AS d FROM daily), g AS (SELECT entity, d, {", ".join(f"lag(d, {k}) OVER (PARTITION BY entity ORDER BY ts) AS d{k}" for k in range(1, 8))} FROM d), r AS MATERIALIZED (SELECT entity, count(*) AS n, [{", ".join(f"sum(d * d{k}) / sum(d * d)" for k in range(1, 8))}] AS r FROM g GROUP BY 1),
p AS (SELECT entity, n, r, 1 AS k, [r[1]] AS phi, r[1] AS a FROM r UNION ALL SELECT entity, n, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - b * phi[k + 1 - j]), b), b FROM (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS b FROM p WHERE k < 7) q)
SELECT entity, k AS lag, round(a, 6) + 0.0 AS partial, abs(a) > 1.96 / sqrt(n) AS significant FROM p""")
def partial_autocorrelations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.pacf_rows(stats.acf(daily(spark, d), "entity", "ts", "value", 7), "entity"))


@query("""
WITH h AS (SELECT user_id, date_trunc('hour', ts) AS ts, count(*) AS n, sum(value) AS value FROM events GROUP BY 1, 2)
SELECT user_id, ts, n, round(2 * value, 3) AS value FROM h WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20 12:00:00'""")
def feature_table_range(spark: SparkSession, d: str) -> DataFrame:
    """Hourly features of users written to a table by day, those of every day's second half written again with other values, and a range of time read back."""
    h = table(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"), (2 * F.sum("value")).alias("value"))
    path, late = shared_folder(spark, "features"), F.hour("ts") >= 12
    readers.append_features(h.withColumn("value", F.when(late, F.lit(-1.0)).otherwise(F.col("value"))), path, "user_id", "ts")
    readers.append_features(h.where(late), path, "user_id", "ts")
    got = readers.read_features(spark, path, "ts", "2024-01-03", "2024-01-20 12:00:00")
    return rounded(got.select("user_id", no_zone(F.col("ts")).alias("ts"), "n", "value"), 3)
