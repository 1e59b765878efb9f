"""Operators that once cut or capped: exact at every size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolake.operators import backtest, forecast, hierarchy
from chronolake.operators.quantile import exact_quantiles
from chronolake.streaming import processors


@pytest.mark.parametrize("n", [1, 7, 40_000])
def test_quantiles_are_exact(spark, n):
    """Ties, a hot key, a key without values and an empty table."""
    rng = np.random.default_rng(n)
    v = np.where(rng.random(n) < 0.3, rng.integers(0, 5, n), rng.normal(0, 100, n).round(2)).astype(float)
    k = np.where(rng.random(n) < 0.7, "hot", "b")
    d = spark.createDataFrame(pd.DataFrame({"k": k, "v": v})).unionByName(spark.createDataFrame([("none", None), ("hot", None)], "k string, v double"))
    levels = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in exact_quantiles(d, "k", "v", levels).collect()}
    assert set(got) == set(k)
    for key in set(k):
        assert np.allclose(got[key], np.quantile(v[k == key], levels))
    assert np.allclose(exact_quantiles(d, [], "v", levels).first()["q"], np.quantile(v, levels))
    assert exact_quantiles(d.where("false"), "k", "v", levels).collect() == []


def test_failing_models_are_marked(spark):
    d = spark.createDataFrame([("a", i, float(i)) for i in range(6)] + [("b", i, float(i % 3)) for i in range(40)], "entity string, ts int, value double")
    rows = forecast.per_series(d, "entity", "ts", "value", 2, forecast.holt_winters(12)).collect()
    assert {(r.entity, r.failed) for r in rows} == {("a", True), ("b", False)}
    scored = backtest.per_series(d, "entity", "ts", "value", {"hw": forecast.holt_winters(12), "ar": forecast.recursive([1])}, lambda n: [n - 3], 2)
    assert {(r.entity, r.model, r.failed) for r in scored.collect()} == {("a", "hw", True), ("a", "ar", False), ("b", "hw", False), ("b", "ar", False)}


def test_window_of_changes_has_no_cap():
    """Over a long still stretch the window keeps every row in few buckets, and still sees a change."""
    d, rng = processors.Adwin(), np.random.default_rng(2)
    for x in rng.normal(0, 1, 5_000):
        mean, width, _ = d.update(x)
    assert width > 1_000 and abs(mean) < 0.2 and len(d.state) < 3 * 6 * 14
    seen = [d.update(x)[2] for x in rng.normal(3, 1, 200)]
    assert any(seen) and abs(d.update(3.0)[0] - 3) < 0.5


def test_backtest_is_the_plain_one(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(100, 10, 700).cumsum()
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "entity string, ts int, value double")
    got = backtest.closed_form(d, "entity", "ts", "value", 4, 7, 50, 60, 9).toPandas()
    assert sorted(got["origin"].unique()) == [696 - 50 * k for k in range(8, -1, -1)]
    for o in got["origin"].unique():
        train, level = y[:o], y[0]
        for v in train[1:]:
            level = 0.3 * v + 0.7 * level
        slope, icpt = np.polyfit(np.arange(1, o + 1), train, 1)
        for h in (1, 4):
            row = got[(got.origin == o) & (got.step == h)].set_index("model")
            want = {"naive": train[-1], "seasonal_naive": train[o - 7 + h - 1], "drift": train[-1] + h * (train[-1] - train[0]) / (o - 1), "ses": level, "theta": 0.5 * (icpt + slope * (o + h)) + 0.5 * level}
            for k, f in want.items():
                assert abs(row.loc[k, "forecast"] - f) <= 1e-8 * abs(f)
            assert (row["actual"] == y[o + h - 1]).all() and np.allclose(row["scale"], np.abs(np.diff(train)).mean())


def test_large_matrices_are_refused(spark):
    m = spark.range(30).select(F.lit("total").alias("node"), F.col("id").cast("string").alias("bottom")).unionByName(spark.range(30).select(F.col("id").cast("string").alias("node"), F.col("id").cast("string").alias("bottom")))
    nodes = m.select("node", F.lit(1).alias("t"), F.lit(1.0).alias("v")).distinct()
    with pytest.raises(ValueError):
        hierarchy.reconcile(nodes, m, "t", "v", most_nodes=10)
    assert hierarchy.reconcile(nodes, m, "t", "v").count() == 31


@pytest.mark.parametrize("detector", [processors.FadingZ, processors.VitalMonitor, processors.LearntCusum, processors.OnlineConformal])
def test_more_detectors_over_tables(spark, detector):
    v = np.random.default_rng(10).normal(50, 3, 80)
    d = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "entity string, ts int, value double")
    out = processors.over_table(d, "entity", "ts", "value", detector).orderBy("ts").collect()
    one = detector()
    assert [tuple(r[o] for o in detector.outputs) for r in out] == [pytest.approx(one.update(x)) for x in v]


def test_conformal_width_settles():
    d, rng = processors.OnlineConformal(), np.random.default_rng(3)
    missed = [d.update(abs(x))[1] for x in rng.normal(0, 5, 5_000)]
    assert abs(np.mean(missed[500:]) - 0.1) < 0.03
