"""Contributions of features to the predictions of tree ensembles (Shapley values along the trees' paths).

A leaf is reached by the rows that pass its path's splits. For a set of features taken as known, a tree's expectation passes a split on a known feature
by the row's value and any other by the training rows' shares; a feature's contribution is its mean effect over all orders in which features become
known. A path has few features, so each leaf's part is summed over the subsets of these, for all rows of a batch at once. The model's nodes are
read from what it writes of itself, and contributions plus the base are the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.session import shared_folder


@dataclass
class Leaf:
    """value: the weighted prediction. features: those on the path, once each. low, high: the path's bounds of each (over low, up to high). share: of training rows that pass its splits."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]


def leaves(spark: SparkSession, model) -> list[Leaf]:  # noqa: ANN001
    """All leaves of a fitted forest or boosted ensemble of regression trees with continuous splits."""
    path = shared_folder(spark, "trees")
    model.write().save(path)
    weights = dict(enumerate(model.treeWeights))
    scale = 1 / sum(weights.values()) if type(model).__name__.startswith("RandomForest") else 1.0
    nodes: dict[tuple[int, int], object] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        nodes[r.treeID, r.id] = r
    out: list[Leaf] = []

    def walk(tree: int, at: int, bounds: dict[int, tuple[float, float, float]]) -> None:
        r = nodes[tree, at]
        if r.leftChild < 0:
            keys = list(bounds)
            out.append(Leaf(r.prediction * weights[tree] * scale, keys, [bounds[k][0] for k in keys], [bounds[k][1] for k in keys], [bounds[k][2] for k in keys]))
            return
        f, cut = r.split.featureIndex, r.split.leftCategoriesOrThreshold[0]
        if r.split.numCategories >= 0:
            raise ValueError("splits on categories have no bounds")
        low, high, share = bounds.get(f, (-np.inf, np.inf, 1.0))
        walk(tree, r.leftChild, bounds | {f: (low, min(high, cut), share * nodes[tree, r.leftChild].rawCount / r.rawCount)})
        walk(tree, r.rightChild, bounds | {f: (max(low, cut), high, share * nodes[tree, r.rightChild].rawCount / r.rawCount)})

    for t in weights:
        walk(t, 0, {})
    return out


def base_value(of: Sequence[Leaf]) -> float:
    return float(sum(x.value * np.prod(x.share) for x in of))


def attributions(of: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """Contributions (rows, features)."""
    out = np.zeros(x.shape)
    for leaf in of:
        k = len(leaf.features)
        if not k:
            continue
        passed = np.stack([(x[:, f] > a) & (x[:, f] <= b) for f, a, b in zip(leaf.features, leaf.low, leaf.high, strict=True)], 1).astype(float)
        for j, f in enumerate(leaf.features):
            others = [i for i in range(k) if i != j]
            total = np.zeros(len(x))
            for size in range(k):
                weight = factorial(size) * factorial(k - size - 1) / factorial(k)
                for known in combinations(others, size):
                    rest = np.prod([leaf.share[i] for i in others if i not in known])
                    total += weight * rest * (passed[:, known].prod(1) if known else 1.0)
            out[:, f] += leaf.value * total * (passed[:, j] - leaf.share[j])
    return out


def contributions(model: PipelineModel, df: DataFrame, columns: Sequence[str], name: str = "contributions") -> DataFrame:
    """Rows with ``prediction``, ``base`` and the array ``name``, a number for each of the regressor's columns. Rows with missing columns are left out, as the model does."""
    of = leaves(df.sparkSession, model.stages[-1])

    @F.pandas_udf("array<double>")
    def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(attributions(of, np.stack(b)) if len(b) else []), index=b.index, dtype=object)

    made = model.transform(df)
    return made.withColumn(name, shares(vector_to_array("__x"))).withColumn("base", F.lit(base_value(of))).drop("__raw", "__x")
