"""Quantile regression by boosted trees, grown over the cluster from histograms of gradients.

Columns become bins once, by one sketch. A level of trees, for all quantiles at once, is one aggregate: every task sums the pinball
loss's gradients by (quantile, node, feature, bin), which is a table of fixed size, and only the sums of all tasks come to the driver. A leaf's value
is the quantile of the residuals in it, exact, by ``quantile.exact_quantiles``. Rows stay where they are; predictions are written every few trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.operators.quantile import exact_quantiles
from chronolake.session import shared_folder

#: Trees after which the rows' predictions are written, so that expressions stay short.
CUT = 5


@dataclass
class Tree:
    """A complete tree: by node the feature, the last bin that goes left, and by leaf the value."""

    feature: list[int]
    last: list[int]
    value: list[float]


@dataclass
class QuantileTrees:
    taus: list[float]
    columns: list[str]
    edges: list[list[float]]
    base: list[float]
    depth: int
    trees: list[list[Tree]] = field(default_factory=list)

    def bins(self) -> Column:
        """Each column's bin: the number of edges below the value; 0 for a null."""

        def below(column: str, edges: list[float]) -> Column:
            count = F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x < F.col(column))) if edges else F.lit(0)
            return F.when(F.col(column).isNotNull(), count).otherwise(F.lit(0))

        return F.array(*(below(c, e) for c, e in zip(self.columns, self.edges, strict=True)))


def _leaf(tree: Tree, depth: int, bins: Column, node: int = 0) -> Column:
    """Number of the leaf that a row falls in; a node without a split sends all left."""
    if node >= 2**depth - 1:
        return F.lit(node - (2**depth - 1))
    if tree.last[node] < 0:
        return _leaf(tree, depth, bins, 2 * node + 1)
    return F.when(bins[tree.feature[node]] > tree.last[node], _leaf(tree, depth, bins, 2 * node + 2)).otherwise(_leaf(tree, depth, bins, 2 * node + 1))


def _value(tree: Tree, depth: int, bins: Column) -> Column:
    return F.array(*map(F.lit, tree.value))[_leaf(tree, depth, bins)]


def split(g: np.ndarray, n: np.ndarray, least: int) -> tuple[int, int]:
    """Best (feature, last bin to the left) for sums (features, bins) of gradients and rows; (0, -1) without a gain. Ties go to the first."""
    gl, nl = g.cumsum(1), n.cumsum(1)
    gr, nr = gl[:, -1:] - gl, nl[:, -1:] - nl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((nl >= least) & (nr >= least), gl**2 / nl + gr**2 / nr, -np.inf) - gl[:, -1:] ** 2 / np.maximum(nl[:, -1:], 1)
    gain = np.round(gain, 9)
    best = int(gain.argmax())
    return divmod(best, g.shape[1]) if gain.flat[best] > 1e-9 else (0, -1)


def _sums(rows: DataFrame, model: QuantileTrees, node: Column, nodes: int, bins: int) -> np.ndarray:
    """(quantiles, nodes, features, bins, 2): gradients and rows; ``node`` is an array with the row's node for each quantile."""
    taus, k = np.array(model.taus), len(model.columns)
    shape = (len(taus), nodes, k, bins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, n = np.zeros(np.prod(shape)), np.zeros(np.prod(shape))
        for b in batches:
            if not len(b):
                continue
            y, p, at, cell = b["y"].to_numpy(), np.stack(b["p"]), np.stack(b["node"]), np.stack(b["b"])
            gradient = taus - (y[:, None] < p)
            place = ((np.arange(len(taus)) * nodes + at)[:, :, None] * k + np.arange(k)) * bins + cell[:, None, :]
            g += np.bincount(place.ravel(), np.broadcast_to(gradient[:, :, None], place.shape).ravel(), len(g))
            n += np.bincount(place.ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"at": at, "g": g[at], "n": n[at]})

    summed = rows.select("y", "b", "p", node.alias("node")).mapInPandas(run, "at long, g double, n double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()
    out = np.zeros((int(np.prod(shape)), 2))
    out[summed["at"]] = summed[["g", "n"]]
    return out.reshape(*shape, 2)


def fit(df: DataFrame, columns: Sequence[str], label: str, taus: Sequence[float], trees: int = 20, depth: int = 2, rate: float = 0.3, bins: int = 32, least: int = 20) -> QuantileTrees:
    """Fit a sequence of trees for each quantile. Rows with a null label don't count; null features are in the lowest bin."""
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull()).select(*(F.col(c).cast("double").alias(c) for c in columns), F.col(label).cast("double").alias("y"))
    cuts = [i / bins for i in range(1, bins)]
    sketch = rows.agg(*(F.percentile_approx(c, cuts, 10_000).alias(c) for c in columns)).first()
    edges = [sorted(set(sketch[c] or [])) for c in columns]
    base = exact_quantiles(rows, [], "y", list(taus)).first()
    if base is None or not base["q"]:
        raise ValueError("no row has a label")
    model = QuantileTrees(list(taus), list(columns), edges, list(base["q"]), depth)

    def written(d: DataFrame) -> DataFrame:
        path = shared_folder(spark, "boosting")
        d.write.parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    now = written(rows.select("y", model.bins().alias("b"), F.array(*map(F.lit, model.base)).alias("p")))
    inner = 2**depth - 1
    for t in range(trees):
        grown = [Tree([0] * inner, [-1] * inner, []) for _ in taus]
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            node = F.array(*(_leaf(Tree(x.feature, x.last, []), level, F.col("b")) for x in grown))
            sums = _sums(now, model, node, count, bins)
            for q, tree in enumerate(grown):
                for k in range(count):
                    tree.feature[first + k], tree.last[first + k] = split(sums[q, k, :, :, 0], sums[q, k, :, :, 1], least)
        leaves = now.select(F.explode(F.array(*(F.struct(F.lit(q).alias("q"), _leaf(x, depth, F.col("b")).alias("leaf"), (F.col("y") - F.col("p")[q]).alias("e")) for q, x in enumerate(grown)))).alias("r")).select("r.*")
        found = {(r.q, r.leaf): r.v for r in exact_quantiles(leaves, ["q", "leaf"], "e", list(taus), "v").collect()}
        for q, tree in enumerate(grown):
            tree.value = [rate * found[q, leaf][q] if (q, leaf) in found else 0.0 for leaf in range(inner + 1)]
        model.trees.append(grown)
        now = now.withColumn("p", F.array(*(F.col("p")[q] + _value(x, depth, F.col("b")) for q, x in enumerate(grown))))
        if t % CUT == CUT - 1 and t + 1 < trees:
            now = written(now)
    return model


def predict(df: DataFrame, model: QuantileTrees, name: str = "quantiles") -> DataFrame:
    """Adds the array ``name`` of the quantiles, rising: crossing ones are put in order."""
    b = df.withColumn("__b", model.bins())
    p = F.array(*(F.lit(x) for x in model.base))
    for k in range(0, len(model.trees), CUT):
        b = b.withColumn("__p", F.array(*(p[q] + sum((_value(t[q], model.depth, F.col("__b")) for t in model.trees[k : k + CUT]), F.lit(0.0)) for q in range(len(model.taus)))))
        p = F.col("__p")
    return b.withColumn(name, F.array_sort(p)).drop("__b", "__p")
