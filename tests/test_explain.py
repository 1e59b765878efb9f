"""Contributions against the enumeration of all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from chronolake.operators import explain, learn


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_contributions(spark, kind, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = x[:, 0] * 2 + (x[:, 1] > 0) * x[:, 2] + rng.normal(0, 0.1, 300)
    columns = list("abcde")
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, c double, d double, e double, y double")
    small = {"boosted": lambda **k: learn.GBTRegressor(maxIter=4, maxDepth=3, seed=1, **k), "forest": lambda **k: learn.RandomForestRegressor(numTrees=4, maxDepth=3, seed=1, **k)}
    monkeypatch.setattr(learn, "REGRESSORS", small)
    model = learn.regressor(kind, columns, "y").fit(df)
    rows = explain.contributions(model, df, columns).orderBy("i").collect()
    assert all(abs(r.base + sum(r.contributions) - r.prediction) < 1e-9 for r in rows)
    scaled = np.array([r.x for r in model.transform(df).orderBy("i").select(vector_to_array("__x").alias("x")).collect()])
    of = explain.leaves(spark, model.stages[-1])

    def expected(row, known):
        return sum(leaf.value * np.prod([(a < row[f] <= b) if f in known else s for f, a, b, s in zip(leaf.features, leaf.low, leaf.high, leaf.share, strict=True)]) for leaf in of)

    for i in (0, 17, 123):
        for f in range(5):
            others = [g for g in range(5) if g != f]
            want = sum(factorial(n) * factorial(4 - n) / factorial(5) * (expected(scaled[i], {*s, f}) - expected(scaled[i], set(s))) for n in range(5) for s in combinations(others, n))
            assert abs(rows[i].contributions[f] - want) < 1e-9
    assert np.mean([np.abs(r.contributions[0]) for r in rows]) > 5 * np.mean([np.abs(r.contributions[4]) for r in rows])
