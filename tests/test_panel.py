"""Causality, autoregressions, reports and folds by entity against plain versions."""

import numpy as np

from chronolake.operators import backtest, evaluation, gram


def system(rng, n=400):
    a = np.array([[0.5, 0.0], [0.4, 0.3]])
    x = np.zeros((n, 2))
    for t in range(1, n):
        x[t] = a @ x[t - 1] + rng.normal(size=2) @ np.array([[1.0, 0.5], [0.0, 1.0]])
    return x


def test_autoregression_and_responses(spark):
    rng = np.random.default_rng(1)
    made = {g: system(rng) for g in "ab"}
    df = spark.createDataFrame([(g, t, float(r[0]), float(r[1])) for g, x in made.items() for t, r in enumerate(x)], "g string, t int, u double, v double")
    fits = gram.autoregression(df, "g", "t", ["u", "v"], 1)
    shown = gram.responses(fits, "g", ["u", "v"], 4).toPandas()
    f = {(r.g, r.cause): r for r in gram.granger(df, "g", "t", ["u", "v"], 1).collect()}
    for g, x in made.items():
        z = np.column_stack([np.ones(399), x[:-1]])
        b = np.linalg.lstsq(z, x[1:], rcond=None)[0]
        e = x[1:] - z @ b
        rows = {r.channel: r for r in fits.where(f"g = '{g}'").collect()}
        assert np.allclose(rows["u"].coef, b[:, 0]) and np.allclose(rows["v"].coef, b[:, 1])
        cov = e.T @ e / 399
        assert np.allclose([rows["u"].covariance, rows["v"].covariance], cov)
        chol, power, sums = np.linalg.cholesky(cov), np.eye(2), np.zeros((2, 2))
        for h in range(5):
            theta = power @ chol
            sums += theta**2
            part = shown[(shown.g == g) & (shown.step == h)].set_index(["channel", "shock"])
            for i, c in enumerate("uv"):
                for j, s in enumerate("uv"):
                    assert np.isclose(part.loc[(c, s), "response"], theta[i, j]) and np.isclose(part.loc[(c, s), "share"], sums[i, j] / sums[i].sum())
            power = power @ b[1:].T
        own = np.column_stack([np.ones(399), x[:-1, 1]])
        r = x[1:, 1] - own @ np.linalg.lstsq(own, x[1:, 1], rcond=None)[0]
        assert np.isclose(f[g, "u"].f, (r @ r - e[:, 1] @ e[:, 1]) / (e[:, 1] @ e[:, 1] / 396))
        assert f[g, "u"].p_value < 1e-6 and f[g, "v"].p_value > 1e-4


def test_regression_errors(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(50), rng.normal(size=50)])
    y = x @ [1, 2] + rng.normal(size=50)
    (r,) = gram.regression(spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x[:, 1], y, strict=True)], "g string, x double, y double"), "g", [gram.F.lit(1.0), "x"], "y").collect()
    b, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    assert np.allclose(r.coef, b) and np.allclose(r.error, np.sqrt(rss[0] / 48 * np.diag(np.linalg.inv(x.T @ x)))) and np.isclose(r.rss, rss[0])


def test_verdicts(spark):
    rng = np.random.default_rng(3)
    rows = [(g, t, float(v)) for g, y in {"noise": rng.normal(size=400), "walk": np.cumsum(rng.normal(size=400))}.items() for t, v in enumerate(y)]
    df = spark.createDataFrame(rows, "g string, t int, y double")
    got = {r.g: r.verdict for r in evaluation.stationarity(df, "g", "t", "y").collect()}
    assert got == {"noise": "stationary", "walk": "unit root"}
    ready = evaluation.made_stationary(df, "g", "t", "y").groupBy("g").agg({"differenced": "max", "prepared": "count"}).collect()
    assert sorted(tuple(r) for r in ready) in ([("noise", False, 400), ("walk", True, 399)], [("noise", 400, False), ("walk", 399, True)])


def test_stratified_folds(spark):
    rows = [(i, "a" if i % 7 else ("b" if i % 2 else None)) for i in range(700)]
    got = backtest.stratified_folds(spark.createDataFrame(rows, "i int, k string"), "k", "i", 4).toPandas()
    assert len(got) == 700
    sizes = got.groupby([got.k.fillna("-"), "fold"]).size()
    for k in ("a", "b", "-"):
        assert sizes[k].max() - sizes[k].min() <= 1 and len(sizes[k]) == 4


def test_zero_shot_windows(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(5)], "g string, t int")
    got = backtest.zero_shot_rows(df, "g", "t", 3, 4, 10).collect()
    assert sorted((r.window, r.step, r.t) for r in got) == [(w, s, 20 - 3 - 3 * w + s - 1) for w in range(3) for s in (1, 2, 3)]
    assert {r.g for r in got} == {"a"} and all(r.context == 17 - 3 * r.window for r in got)
