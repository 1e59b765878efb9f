"""Tests of series, fills, strategies, distances by alignment and detectors, against plain versions."""

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolake.operators import anomaly, decompose, distance, forecast, learn, stats
from chronolake.plans import inference_queries
from chronolake.streaming import processors

SF = "/root/testdata/sf0.001"


def test_normality_finds_what_is_skewed(spark):
    rng = np.random.default_rng(5)
    parts = {"normal": rng.normal(3, 2, 4000), "skewed": rng.exponential(1, 4000), "flat": rng.uniform(0, 1, 4000), "few": rng.normal(0, 1, 5), "same": np.ones(20)}
    d = spark.createDataFrame(pd.DataFrame([(k, float(x)) for k, v in parts.items() for x in v], columns=["k", "v"]))
    got = {r.k: r for r in stats.skewness_kurtosis_test(d, "k", "v").collect()}
    assert got["normal"].p_value > 0.01
    assert got["skewed"].z_skewness > 10 and got["skewed"].p_value < 1e-6
    assert got["flat"].z_kurtosis < -10 and abs(got["flat"].z_skewness) < 4
    assert got["few"].k2 is None and got["same"].k2 is None


def test_giacomini_white_by_matrices(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 300), rng.normal(0, 1.2, 300)
    d = spark.createDataFrame(pd.DataFrame({"entity": "a", "ts": np.arange(300), "x": a, "y": b}))
    got = stats.giacomini_white(d, "entity", "ts", "x", "y").first()
    diff = np.abs(a) - np.abs(b)
    z, t = np.column_stack([np.ones(299), diff[:-1]]), diff[1:]
    e = t - z @ np.linalg.lstsq(z, t, rcond=None)[0]
    g = (z * t[:, None]).mean(0)
    wald = len(t) * g @ np.linalg.pinv(z.T @ np.diag(e * e) @ z / len(t)) @ g
    assert got.n == 299 and math.isclose(got.wald, wald, rel_tol=1e-8)
    assert stats.giacomini_white(d.where("false"), "entity", "ts", "x", "y").collect() == []


def test_phillips_perron_tells_walks_from_noise(spark):
    noise = np.random.default_rng(1).normal(0, 1, 600)
    rows = [("noise", i, float(v)) for i, v in enumerate(noise)] + [("walk", i, float(v)) for i, v in enumerate(np.cumsum(noise))]
    d = spark.createDataFrame(rows, "entity string, ts int, v double")
    got = {r.entity: r for r in stats.phillips_perron(d, "entity", "ts", "v", 4).collect()}
    assert got["noise"].stationary and got["noise"].z_tau < -15
    assert not got["walk"].stationary


def test_granger_in_var_finds_the_cause(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(0, 1, 400), rng.normal(0, 1, 400)
    y = np.r_[0, 0.8 * x[:-1]] + rng.normal(0, 0.5, 400)
    d = spark.createDataFrame(pd.DataFrame({"ts": np.arange(400), "x": x, "y": y, "z": z}))
    got = {(c, e): p for c, e, _, p in stats.granger_in_var(d, "ts", ["x", "y", "z"], 2)}
    assert len(got) == 6 and got["x", "y"] < 1e-6
    assert min(p for k, p in got.items() if k != ("x", "y")) > 1e-3


def test_stl_fill_and_outliers(spark):
    t = np.arange(96)
    y = 50 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12)
    holes = y.copy()
    holes[[5, 30, 31, 70]] = np.nan
    filled = decompose.stl_filled(holes, 12)
    assert np.abs(filled - y).max() < 1e-3 and not np.isnan(filled).any()
    assert np.array_equal(decompose.stl_filled(y, 12), y) and np.isnan(decompose.stl_filled(np.full(30, np.nan), 12)).all()
    noisy = y + np.random.default_rng(0).normal(0, 0.5, 96)
    noisy[40] += 30
    d = spark.createDataFrame(pd.DataFrame({"entity": "a", "ts": t, "v": noisy}))
    out = {r.ts for r in decompose.stl_outliers(d, "entity", "ts", "v", 12).where("outlier").collect()}
    assert 40 in out and len(out) < 10


def test_strategies():
    t = np.arange(120)
    y = 10 + np.sin(2 * np.pi * t / 12)
    want = 10 + np.sin(2 * np.pi * np.arange(120, 126) / 12)
    for name in ("recursive", "direct", "mimo", "dirmo"):
        assert np.allclose(forecast.multi_step(name, [1, 2, 12], 3)(y, 6), want, atol=1e-2), name
    # With the same rows for every step the joint model is the separate least squares of each step.
    lags, rows = [1, 3], range(3, 115)
    v = np.random.default_rng(4).normal(0, 1, 120)
    x = np.array([[1, v[r - 1], v[r - 3]] for r in rows])
    each = [np.linalg.lstsq(x, np.array([v[r + s] for r in rows]), rcond=None)[0] @ [1, v[-1], v[-3]] for s in range(6)]
    assert np.allclose(forecast.multi_step("mimo", lags, ridge=1e-12)(v, 6), each)
    with pytest.raises(ValueError):
        forecast.multi_step("all", [1])
    with pytest.raises(ValueError):
        forecast.multi_step("dirmo", [1], 4)(y, 6)


def plainly(a, b, kind, eps=0.25, gamma=1.0, band=None):
    @lru_cache(None)
    def cost(i, j):
        if kind == "soft" and (i == 0 or j == 0):
            return 0.0 if i == j else math.inf
        if kind == "lcss":
            if i == 0 or j == 0:
                return 0
            if abs(a[i - 1] - b[j - 1]) <= eps and (band is None or abs(i - j) <= band):
                return cost(i - 1, j - 1) + 1
            return max(cost(i - 1, j), cost(i, j - 1))
        if kind == "soft":
            parts = [x for x in (cost(i - 1, j - 1), cost(i - 1, j), cost(i, j - 1)) if x < math.inf]
            return (a[i - 1] - b[j - 1]) ** 2 - gamma * math.log(sum(math.exp(-x / gamma) for x in parts))
        gap = (lambda v: 1) if kind == "edr" else abs
        if i == 0 or j == 0:
            return sum(gap(v) for v in a[:i]) + sum(gap(v) for v in b[:j])
        same = float(abs(a[i - 1] - b[j - 1]) > eps) if kind == "edr" else abs(a[i - 1] - b[j - 1])
        return min(cost(i - 1, j - 1) + same, cost(i - 1, j) + gap(a[i - 1]), cost(i, j - 1) + gap(b[j - 1]))

    end = cost(len(a), len(b))
    return {"lcss": lambda: 1 - end / min(len(a), len(b)), "edr": lambda: end / max(len(a), len(b))}.get(kind, lambda: end)()


@pytest.mark.parametrize("kind", ["lcss", "edr", "erp", "soft"])
def test_aligned_series(spark, kind):
    rng = np.random.default_rng(7)
    for n, m in ((1, 1), (4, 9), (12, 12), (15, 3)):
        a, b = rng.normal(0, 1, n), rng.normal(0, 1, m)
        assert math.isclose(distance.aligned_many(a[None], b[None], kind)[0], plainly(tuple(a), tuple(b), kind), abs_tol=1e-9)
    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([], []), ([], [2.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r.d for r in rows.select(distance.aligned_column("a", "b", kind).alias("d")).collect()]
    empty = {"erp": 2.0, "soft": math.inf}.get(kind, 1.0)
    assert got[1:] == [0.0, empty, None] and (kind == "soft" or got[0] == 0.0)


def test_edit_distances_over_the_whole_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, v = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    got = {r.query_id: (r.vec_id, r.erp) for r in inference_queries.edit_distances(spark, SF).collect()}
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        dist = distance.aligned_many(np.repeat(v[q : q + 1], len(v), 0), v, "erp")
        assert math.isclose(dist[0], plainly(tuple(v[q]), tuple(v[0]), "erp"), abs_tol=1e-9)
        want[ids[q]] = min((x, k) for x, k in zip(dist, ids, strict=True) if k != ids[q])[::-1]
    assert got == want


def test_detector_pipeline_by_lists():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 1, 80), [60.0] * 8, rng.normal(0, 1, 60), rng.normal(15, 1, 60)])
    p, z, window = processors.DetectorPipeline(), processors.FadingZ(), processors.Adwin()
    z.decay = 0.99
    buffer, last, alerts = [], -10, []
    counts, low, high = None, 0.0, 0.0
    for t, v in enumerate(x, 1):
        # The state goes through plain numbers, as in a state store.
        p = processors.DetectorPipeline(tuple(float(s) for s in p.state))
        got = p.update(v)
        score, (mean, _, drift) = z.update(v)[1], window.update(v)
        buffer = [*buffer, abs(score)][-5:]
        alert = np.mean(buffer) > 3.5 and t - last >= 10
        last = t if alert else last
        rare = 0.0
        if t == 30:
            low, high = x[:30].min(), x[:30].max()
            counts = np.histogram(x[:30], 20, (low, high))[0].astype(float)
        if counts is not None:
            i = int(np.clip((v - low) / (high - low) * 20, 0, 19))
            rare = -math.log((counts[i] + 1e-3) / (counts.sum() + 0.02))
            counts[i] += 1
        assert np.allclose(got, (score, np.mean(buffer), rare, alert, drift, mean)), t
        alerts.append(alert)
    assert 80 < np.flatnonzero(alerts)[0] < 90


def test_half_spaces_score_what_is_rare():
    d = processors.HalfSpaces()
    for v in np.random.default_rng(1).normal(0.5, 0.05, 300).clip(0, 1):
        d.update(float(v))
    seen = processors.HalfSpaces(d.state).update(0.5)[0]
    assert processors.HalfSpaces(d.state).update(0.99)[0] > 10 * seen > 0
    assert processors.HalfSpaces().update(7.0) == (0.0,)


def test_alert_levels_of_nulls(spark):
    d = spark.createDataFrame([("a", 1, None, 0.95), ("a", 2, 9.0, 0.99), ("a", 20, -9.0, 0.9), ("b", 1, None, None)], "entity string, i int, z double, p double")
    got = {(r.entity, r.i): r.level for r in anomaly.alert_levels(d, "entity", "i", "z", "p", 15).collect()}
    assert got == {("a", 1): "WARNING", ("a", 2): "NORMAL", ("a", 20): "CRITICAL", ("b", 1): "NORMAL"}


def test_stl_query_fills_all(spark):
    out = inference_queries.stl_fill(spark, SF)
    assert out.where("filled is null or isnan(filled)").count() == 0
    assert out.where("value is not null and value <> filled").count() == 0
    for _, g in out.toPandas().groupby("entity"):
        g = g.sort_values("ts")
        assert np.allclose(g.filled, decompose.stl_filled(g.value.to_numpy(float), 12))


def test_stl_splits_a_clean_series():
    t = np.arange(96)
    line, wave = 50 + 0.5 * t, 10 * np.sin(2 * np.pi * t / 12)
    trend, season, rest = decompose.stl_arrays(line + wave, 12)
    assert np.abs(trend - line).max() < 1e-6 and np.abs(season - wave).max() < 1e-6 and np.abs(rest).max() < 1e-6
    assert np.abs(decompose.stl_arrays(line, 7)[1]).max() < 1e-6
    assert np.array_equal(decompose.stl_arrays(line[:10], 7)[1], np.zeros(10))


def test_lagged_causes_leave_out_what_goes_between(spark):
    """x drives y and y drives z: x and z are related, but not directly."""
    rng = np.random.default_rng(8)
    e = rng.normal(0, 1, (3, 1500))
    x, y, z = e[0].copy(), e[1].copy(), e[2].copy()
    for i in range(1, 1500):
        x[i] += 0.5 * x[i - 1]
        y[i] += 0.8 * x[i - 1]
        z[i] += 0.8 * y[i - 1]
    d = spark.createDataFrame(pd.DataFrame({"ts": np.arange(1500), "x": x, "y": y, "z": z}))
    got = {(c, k, e): (r, p) for c, k, e, r, p in stats.lagged_causes(d, "ts", ["x", "y", "z"], 2)}
    assert len(got) == 18
    strong = {k for k, (r, _) in got.items() if abs(r) > 0.3}
    assert strong == {("x", 1, "x"), ("x", 1, "y"), ("y", 1, "z")}
    assert abs(got["x", 2, "z"][0]) < 0.1


def test_linked_and_shape_clusters(spark):
    rng = np.random.default_rng(6)
    blobs = [(g, (np.array([10.0 * g, -5.0 * g, 3.0]) + rng.normal(0, 0.5, 3)).tolist()) for g in range(4) for _ in range(40)]
    d = spark.createDataFrame(blobs, "g int, v array<double>")
    got = learn.linked_clusters(d, "v", 4, 20).toPandas()
    assert (got.groupby("g").cluster.nunique() == 1).all() and got.cluster.nunique() == 4
    # Average linkage of single rows, by hand: two near pairs and a far one.
    rows = spark.createDataFrame([(i, [x]) for i, x in enumerate([0.0, 1.0, 10.0, 11.0, 100.0, 101.0])], "g int, v array<double>")
    few = learn.linked_clusters(rows, "v", 2, 6).toPandas().set_index("g").cluster
    assert few[[0, 1, 2, 3]].nunique() == 1 and few[[4, 5]].nunique() == 1 and few[0] != few[4]

    t = np.arange(48)
    made = []
    for i in range(120):
        at = 14 + rng.integers(-4, 5)
        wave = np.exp(-((t - at) ** 2) / 8) if i % 2 else -np.exp(-((t - at) ** 2) / 8)
        made.append((i % 2, (3 * wave + 100 + rng.normal(0, 0.1, 48)).tolist()))
    s = spark.createDataFrame([*made, (2, [5.0] * 48), (3, None)], "g int, v array<double>").repartition(3)
    out = learn.shape_clusters(s, "v", 2).toPandas()
    sides = out[out.g < 2].groupby("g").cluster.agg(lambda c: c.value_counts(normalize=True).iloc[0])
    assert (sides > 0.95).all()
    assert out[out.g == 0].cluster.mode()[0] != out[out.g == 1].cluster.mode()[0]
    assert out[out.g == 3].cluster.isna().all()
    assert learn.shape_clusters(s.where("false"), "v", 2).collect() == []
