"""Properties of operators that SQL doesn't check."""

import decimal
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolake.functions import metrics, scalars
from chronolake.operators import anomaly, backtest, decompose, distance, features, forecast, graph, hierarchy, impute, joins, probabilistic, spine, stats
from chronolake.streaming import processors


def frame(spark, values, entity="a"):
    days = pd.date_range("2024-01-01", periods=len(values))
    return spark.createDataFrame([(entity, d.to_pydatetime(), None if v is None else float(v)) for d, v in zip(days, values, strict=True)], "entity string, ts timestamp, value double")


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_no_leakage(spark):
    a, b = frame(spark, range(1, 31)), frame(spark, [*range(1, 30), 999])
    cols = features.rolling("value", "entity", "ts", [3]) | features.lags("value", "entity", "ts", [1, 2]) | features.expanding_stats("value", "entity", "ts")
    x, y = ([tuple(r) for r in d.orderBy("ts").select(*cols.values()).collect()] for d in (a, b))
    assert x == y


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_is_pandas(spark, adjust):
    v = np.random.default_rng(1).normal(size=40)
    got = column(features.ewm(frame(spark, v), "entity", "ts", "value", 0.3, adjust), "ewm")
    assert np.allclose(got, pd.Series(v).ewm(alpha=0.3, adjust=adjust).mean())


def test_linear_fill_is_pandas(spark):
    v = [None, 1, None, None, 4, None, None]
    got = column(impute.linear_by_row(frame(spark, v), "entity", "ts", "value"), "filled")
    assert got == [None, 1, 2, 3, 4, 4, 4]
    assert column(impute.linear_by_time(frame(spark, v), "entity", "ts", "value"), "filled") == [None, 1, 2, 3, 4, 4, 4]


def test_spline_passes_through_points():
    y = np.array([0.0, np.nan, 4.0, np.nan, 2.0, 7.0])
    out = impute.natural_spline(y)
    known = ~np.isnan(y)
    assert np.allclose(out[known], y[known]) and not np.isnan(out).any()
    assert not np.isnan(impute.knn_fill(y)).any()


def test_cusum_is_the_recursion(spark):
    v = np.random.default_rng(2).normal(10, 2, 300)
    v[200:] += 4
    for start in (0, 1):
        out = anomaly.cusum(frame(spark, v), "entity", "ts", "value", 100, start=start)
        z = (v - v[:100].mean()) / (v[:100].std() + 1e-12)
        hi, want = 0.0, []
        for i, x in enumerate(z):
            hi = max(0.0, hi + x - 0.5) if i >= start else 0.0
            want.append(hi)
        assert np.allclose(column(out, "s_hi"), want)


def test_ses_is_the_recursion(spark):
    v = np.random.default_rng(3).normal(size=50)
    level = v[0]
    for x in v[1:]:
        level = 0.3 * x + 0.7 * level
    assert math.isclose(forecast.ses(frame(spark, v), "entity", "ts", "value", 1).first()["forecast"], level)


def test_forecasters(spark):
    t = np.arange(96)
    y = 10 + 0.5 * t + 3 * np.sin(2 * np.pi * t / 12)
    ahead = 10 + 0.5 * np.arange(96, 108) + 3 * np.sin(2 * np.pi * np.arange(96, 108) / 12)
    for fit, most in ((forecast.holt_winters(12), 0.6), (forecast.recursive([1, 2, 12, 13]), 0.1), (forecast.direct([1, 2, 12], 1e-6, 3), 0.5), (forecast.arima(13, 1), 0.1)):
        assert np.abs(fit(y, 12) - ahead).mean() < most
    assert np.allclose(forecast.croston_tsb()(np.zeros(10), 2), 0)
    assert abs(forecast.local_level()(np.array([5.0, np.nan, 5.0, 5.0]), 1)[0] - 5) < 1e-9
    with pytest.raises(ValueError):
        forecast.direct([1], group=5)(y, 12)
    short = frame(spark, [1, 2, 3])
    assert [r.forecast for r in forecast.per_series(short, "entity", "ts", "value", 2, forecast.holt_winters(12)).collect()] == [3.0, 3.0]


def test_stl_adds_up(spark):
    t = np.arange(72)
    y = t + 5 * np.sin(2 * np.pi * t / 12)
    out = decompose.stl(frame(spark, y), "entity", "ts", "value", 12).toPandas()
    assert np.allclose(out.trend + out.seasonal + out.resid, out.value)
    assert out.resid.abs().mean() < 0.7
    many = decompose.mstl(frame(spark, y), "entity", "ts", "value", [6, 12]).toPandas()
    assert np.allclose(many.trend + many.seasonal_6 + many.seasonal_12 + many.resid, many.value)


def test_as_of_directions(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("b", 1, 3)], "k string, t long, id long").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame([("a", 5, 50.0), ("a", 9, 90.0), ("a", 12, 120.0)], "k string, rt long, v double").withColumn("rt", F.timestamp_seconds("rt"))

    def got(df):
        return {r.id: r.v for r in df.collect()}

    assert got(joins.as_of(left, right, "k", "t", "rt", ["v"])) == {1: 50.0, 2: 90.0, 3: None}
    assert got(joins.as_of(left, right, "k", "t", "rt", ["v"], strict=True)) == {1: None, 2: 90.0, 3: None}
    assert got(joins.as_of(left, right, "k", "t", "rt", ["v"], direction="forward")) == {1: 50.0, 2: 120.0, 3: None}
    assert got(joins.as_of(left, right, "k", "t", "rt", ["v"], direction="forward", strict=True)) == {1: 90.0, 2: 120.0, 3: None}
    assert got(joins.as_of(left, right, "k", "t", "rt", ["v"], max_age="1 second")) == {1: 50.0, 2: 90.0, 3: None}
    assert got(joins.as_of_nearest(left, right, "k", "t", "rt", ["v"])) == {1: 50.0, 2: 90.0, 3: None}


def test_reconciled_forecasts_add_up(spark):
    rows = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "r")], "a string, b string")
    m = hierarchy.summing(rows, ["a", "b"])
    nodes = spark.createDataFrame([("total", 1, 100.0), ("x", 1, 55.0), ("y", 1, 50.0), ("x/p", 1, 30.0), ("x/q", 1, 20.0), ("y/r", 1, 47.0)], "node string, t int, v double")
    assert not hierarchy.incoherence(nodes, m, "t", "v").first()["coherent"]
    out = hierarchy.reconcile(nodes, m, "t", "v")
    assert hierarchy.incoherence(out, m, "t", "v").first()["coherent"]
    s = hierarchy.proportions(nodes.where("node like '%/%'").withColumnRenamed("node", "bottom"), "t", "v", True)
    assert math.isclose(s.agg(F.sum("share")).first()[0], 1.0)


def test_tails():
    assert math.isclose(stats.t_tail(2.228, 10), 0.05, rel_tol=1e-3)
    assert math.isclose(stats.f_tail(4.9646, 1, 10), 0.05, rel_tol=1e-3)
    assert math.isclose(stats.chi2_tail(18.307, 10), 0.05, rel_tol=1e-3)
    assert stats.pacf([0.5, 0.25, 0.125])[1:] == [0.0, 0.0]


def test_normal_cdf(spark):
    z = spark.createDataFrame([(x / 4,) for x in range(-20, 21)], "z double")
    for r in z.select("z", scalars.normal_cdf(F.col("z")).alias("p")).collect():
        assert abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 2e-7


def test_adf_tells_walks_from_noise(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=400)
    assert stats.adf(frame(spark, e), "ts", "value")["stationary"] == 1
    assert stats.adf(frame(spark, e.cumsum()), "ts", "value")["stationary"] == 0


def test_granger_sees_the_cause(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = np.r_[0, 0.8 * x[:-1]] + 0.3 * rng.normal(size=300)
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t int, x double, y double")
    assert stats.granger(d, "t", "x", "y", 2)["p_value"] < 1e-6 < stats.granger(d, "t", "y", "x", 2)["p_value"]


def test_auc_is_the_rank_sum(spark):
    rng = np.random.default_rng(6)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 40, 500)
    d = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert math.isclose(metrics.auc(d, "y", "s").first()["auc"], want)


def test_conformal_covers(spark):
    rng = np.random.default_rng(7)
    rows = [("a", float(x), 0.0) for x in rng.normal(size=2000)]
    cal, test = spark.createDataFrame(rows[:1000], "k string, y double, f double"), spark.createDataFrame(rows[1000:], "k string, y double, f double")
    out = probabilistic.conformal(cal, test, "k", "y", "f", 0.1)
    assert abs(out.agg(F.avg(probabilistic.covered("y", "lower", "upper"))).first()[0] - 0.9) < 0.03
    width = probabilistic.conformal_width(cal.withColumn("s", F.abs("y")), "k", "s", 0.1).first()["width"]
    assert math.isclose(width, np.quantile(np.abs([r[1] for r in rows[:1000]]), probabilistic.conformal_level(1000, 0.1)))


def test_folds():
    assert backtest.expanding_folds(20, 3, 4, 1) == [(0, 7, 8, 12), (0, 11, 12, 16), (0, 15, 16, 20)]
    for parts, (a, b) in backtest.purged_folds(100, 4, 5, 3):
        assert all(z <= a - 5 or s >= b + 3 for s, z in parts)


def test_lower_bound_is_one(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(30, 24)), rng.normal(size=(30, 24))
    d = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "a array<double>, b array<double>")
    for r in d.select(distance.lb_keogh(F.col("a"), F.col("b"), 3).alias("lb"), distance.dtw_column("a", "b", 3).alias("d"), distance.euclidean(F.col("a"), F.col("b")).alias("e")).collect():
        assert r.lb <= r.d + 1e-9 and r.d <= r.e + 1e-9
    assert math.isclose(distance.dtw(a[0], b[0], 3), distance.dtw_many(a[:1], b[:1], 3)[0])
    assert distance.shape_distance(a[0], a[0]) < 1e-9
    assert np.allclose(distance.barycentre(np.stack([a[0], a[0]])), a[0])


def test_crps_takes_every_day(spark):
    from chronolake.plans import model_queries

    sf = "/root/testdata/sf0.001"
    every = model_queries.baselines(spark, sf).where("e7 is not null").select("entity", "e7").toPandas()
    got = {r.entity: r.crps for r in model_queries.crps_samples_whole(spark, sf).collect()}
    assert every.groupby("entity").size().max() > 60 and sorted(got) == sorted(every["entity"].unique())
    for k, x in every.groupby("entity")["e7"]:
        v = x.to_numpy(float)
        assert abs(got[k] - (np.abs(v).mean() - 0.5 * np.abs(v[:, None] - v[None]).mean())) < 0.00051


def test_dtw_nearest_is_brute_force(spark, tmp_path):
    """Every row whose id is divisible by 50 is a query, against all other rows."""
    from chronolake.plans.watch_queries import dtw_nearest

    rng = np.random.default_rng(12)
    x = np.cumsum(rng.normal(size=(160, 16)), 1)
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.query_id: r for r in dtw_nearest(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 50, 100, 150]
    for i, r in got.items():
        d, j = min((distance.dtw(x[i], x[j], 3), j) for j in range(len(x)) if j != i)
        assert r.vec_id == j and math.isclose(r.d, d)


def test_copula_and_walks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=500)
    d = spark.createDataFrame([(float(v), float(2 * v + 0.1 * w)) for v, w in zip(x, rng.normal(size=500), strict=True)], "x double, y double")
    assert graph.copula_sample(d, ["x", "y"], 400).agg(F.corr("x", "y")).first()[0] > 0.9
    assert graph.random_walk(spark, 2, 10, 0.0, 0.01).where("t = 0 and value = 100").count() == 2


def test_ranks(spark):
    rng = np.random.default_rng(4)
    x = pd.DataFrame({"x": rng.integers(0, 40, 300).astype(float), "y": np.exp(3 * rng.normal(size=300))})
    x.loc[::17, "x"] = None
    d = spark.createDataFrame([(i, None if math.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(x.to_numpy())], "i long, x double, y double")
    got = sorted((r.x, r.y) for r in graph.ranks(d, ["x", "y"]).collect())
    assert got == sorted(zip(x["x"].rank(method="min", na_option="top").astype(int) - 1, x["y"].rank(method="min").astype(int) - 1, strict=True))


def test_copula_of_ranks_at_every_size(spark):
    """A skewed pair in the same order: the ranks agree, while the values hardly correlate."""
    for n in (2_000, 200_100):
        d = spark.range(n).select(F.exp(3 * F.randn(5)).alias("x")).withColumn("y", -1 / F.col("x"))
        made = graph.copula_sample(d, ["x", "y"], 400).toPandas()
        assert made["x"].rank().corr(made["y"].rank()) > 0.98, n


def test_empty_series(spark):
    none = frame(spark, [])
    assert spine.completeness(none, "entity", "ts").count() == 0
    assert forecast.naive(none, "entity", "ts", "value", 3).count() == 0
    assert anomaly.outliers(none, "entity", "value").count() == 0


@pytest.mark.parametrize("detector", [processors.RunningZ, processors.ForgettingZ, processors.Cusum, processors.Adwin, processors.Histogram, processors.OnlineMean])
def test_detectors_over_tables(spark, detector):
    v = np.random.default_rng(10).normal(50, 3, 60)
    out = processors.over_table(frame(spark, v), "entity", "ts", "value", detector).orderBy("ts").collect()
    d = detector()
    assert [tuple(r[o] for o in detector.outputs) for r in out] == [pytest.approx(d.update(x)) for x in v]


def test_change_is_found():
    d, rng = processors.Adwin(), np.random.default_rng(11)
    changes = [i for i, x in enumerate([*rng.normal(0, 1, 200), *rng.normal(5, 1, 200)]) if d.update(x)[2]]
    assert changes and 200 <= changes[0] < 240


def test_top_down_of_many_times(spark, monkeypatch):
    """Every bottom at every time, in several packs of times."""
    monkeypatch.setattr(hierarchy, "TIMES", 3)
    total = spark.createDataFrame([(t, float(t)) for t in range(20)], "t int, v double")
    shares = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "bottom string, share double")
    got = sorted((r.bottom, r.t, r.v) for r in hierarchy.top_down(total, shares, "t", "v").collect())
    assert got == sorted((b, t, t * s) for t in range(20) for b, s in (("a", 0.25), ("b", 0.75)))


def test_smoothed_level_at_small_weights(spark):
    """All rows count, however old: against the plain recursion over 1,500 rows."""
    y = [float((i * 37) % 101 + i) for i in range(1_500)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "e string, t int, v double")
    got = backtest.closed_form(df, "e", "t", "v", 2, 7, 10, 100, 2, alpha=0.001).where("model = 'ses' and step = 1").collect()
    assert len(got) == 2
    for r in got:
        level = y[0]
        for v in y[1 : r.origin]:
            level += 0.001 * (v - level)
        assert abs(r.forecast - level) < 1e-9 * level


def test_outliers_read_the_table_twice_after_their_sizes(spark, tmp_path):
    """Once for the ranks of distances and once for the rows, the rest being small tables; an entity without values and a null one keep their rows."""
    rows = [("a", float(i)) for i in range(20)] + [("a", 500.0), ("b", 1.0), ("c", None), (None, 3.0)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "k string, v double").write.parquet(path)
    out = anomaly.outliers(spark.read.parquet(path), "k", "v")
    leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sum("[k#" in (x := leaves.apply(i).toString()) and ",v#" in x for i in range(leaves.size())) == 2
    got = {(r.k, r.v): r for r in out.collect()}
    assert len(got) == len(rows) and out.columns == ["k", "v", "z", "robust_z", "is_z", "is_robust", "is_iqr"]
    assert [r.v for r in got.values() if r.is_robust] == [500.0] and got["a", 500.0].is_iqr == 1
    v = np.array([x for k, x in rows if k == "a"])
    assert got["a", 3.0].z == pytest.approx((3 - v.mean()) / v.std(ddof=1))
    assert got["a", 3.0].robust_z == pytest.approx(0.6745 * (3 - np.median(v)) / np.median(np.abs(v - np.median(v))))
    assert got["c", None].z is None and got[None, 3.0].is_z is None


def test_box_cox_power_of_large_values(spark):
    """The power that decimals give, where ``v ** -2 - 1`` is -1 in doubles for all values but one, and for all."""
    rng = np.random.default_rng(8)
    x = 3e8 * np.exp(0.2 * np.clip(rng.normal(size=1_600), -2, 2))
    series = {"all": x, "one": np.append(x, 1.2e8), "root": rng.normal(1.5e4, 600, 400) ** 2}
    want, grid = {}, [(k - 10) / 5 for k in range(21)]
    with decimal.localcontext(prec=50):
        for k, v in series.items():
            logs, found = [decimal.Decimal(float(a)).ln() for a in v], []
            for p in map(lambda g: decimal.Decimal(str(g)), grid):
                y = [((p * a).exp() - 1) / p for a in logs] if p else logs
                m = sum(y) / len(y)
                found.append((-len(y) / decimal.Decimal(2) * (sum((a - m) ** 2 for a in y) / len(y)).ln() + (p - 1) * sum(logs), float(p)))
            want[k] = max(found)[1]
    d = spark.createDataFrame([(k, float(a)) for k, v in series.items() for a in v], "k string, v double")
    assert {r.k: r.power for r in features.box_cox_power(d, "k", "v", grid).collect()} == want
