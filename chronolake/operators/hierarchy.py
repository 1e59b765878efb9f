"""Hierarchies of series: sums at every level, and forecasts made to add up."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names

#: Times that meet a bottom's share as one array.
TIMES = 1_000


def levels(df: DataFrame, levels_: Sequence[Sequence[str]], at: Names, value: str) -> DataFrame:
    """Sums for several groupings in one pass (grouping sets), with a ``level`` made of the columns grouped by."""
    every = list(dict.fromkeys(c for cols in levels_ for c in cols))
    sets = [[*(F.col(c) for c in cols), *(F.col(a) for a in names(at))] for cols in levels_]
    name = F.concat_ws("/", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in every))
    return df.groupingSets(sets, *every, *names(at)).agg(F.sum(value).alias(value), F.when(name == "", "total").otherwise(name).alias("level"))


def summing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sparse summing matrix: (node, bottom) for every ancestor of each bottom, the bottom itself and ``total`` included. Nodes are paths."""
    bottom = F.concat_ws("/", *columns)
    paths = [F.lit("total"), *(F.concat_ws("/", *columns[: i + 1]) for i in range(len(columns)))]
    return df.select(*columns).distinct().select(F.explode(F.array(*paths)).alias("node"), bottom.alias("bottom"))


def bottom_up(bottom: DataFrame, matrix: DataFrame, at: Names, value: str) -> DataFrame:
    """``bottom`` has columns bottom, time and value; the result has a row per node and time."""
    return bottom.join(matrix, "bottom").groupBy("node", *names(at)).agg(F.sum(value).alias(value))


def proportions(history: DataFrame, at: Names, value: str, by_averages: bool = False) -> DataFrame:
    """Share of each bottom: mean of its share over time, made to sum to 1, or mean over mean of the total."""
    if by_averages:
        own = history.groupBy("bottom").agg(F.avg(value).alias("__m"))
        total = own.agg(F.sum("__m").alias("__t"))
        return own.join(F.broadcast(total)).select("bottom", (F.col("__m") / F.col("__t")).alias("share"))
    total = history.groupBy(*names(at)).agg(F.sum(value).alias("__t"))
    own = history.join(total, names(at)).groupBy("bottom").agg(F.avg(F.col(value) / F.col("__t")).alias("__s"))
    one = own.agg(F.sum("__s").alias("__a"))
    return own.join(F.broadcast(one)).select("bottom", (F.col("__s") / F.col("__a")).alias("share"))


def top_down(total: DataFrame, shares: DataFrame, at: Names, value: str) -> DataFrame:
    """The total's forecast, dealt out to all bottoms.

    Every bottom needs every time. The times are packed into arrays of about ``TIMES``, which meet the shares by their number,
    so neither side has to fit in a task.
    """
    keys, few = names(at), max(1, -(-total.count() // TIMES))
    packs = total.select(F.struct(*keys, value).alias("row")).groupBy(F.pmod(F.xxhash64("row"), F.lit(few)).cast("int").alias("pack")).agg(F.collect_list("row").alias("rows"))
    asked = shares.select("bottom", "share", F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("pack"))
    met = asked.join(packs, "pack").select("bottom", "share", F.explode("rows").alias("row"))
    return met.select("bottom", *(F.col(f"row.{k}").alias(k) for k in keys), (F.col(f"row.{value}") * F.col("share")).alias(value))


def middle_out(middle: DataFrame, shares: DataFrame, at: Names, value: str) -> DataFrame:
    """Forecasts of a middle level (``node``), dealt out to the bottoms below by their share of it (``node``, ``bottom``, ``share``), as bottoms; sums of these give the levels above."""
    return middle.join(shares, "node").select("bottom", *names(at), (F.col(value) * F.col("share")).alias(value))


def shares_within(history: DataFrame, parent: str, value: str) -> DataFrame:
    """Share of each bottom in its parent's sum over all times: (node, bottom, share)."""
    own = history.groupBy(F.col(parent).alias("node"), "bottom").agg(F.sum(value).alias("__s"))
    total = own.groupBy("node").agg(F.sum("__s").alias("__t"))
    return own.join(total, "node").select("node", "bottom", (F.col("__s") / F.col("__t")).alias("share"))


def node_errors(forecasts: DataFrame, actuals: DataFrame, at: Names, value: str) -> DataFrame:
    """Mean absolute error of each node and ``method``."""
    a = actuals.select("node", *names(at), F.col(value).alias("__a"))
    return forecasts.join(a, ["node", *names(at)]).groupBy("method", "node").agg(F.avg(F.abs(F.col(value) - F.col("__a"))).alias("mae"))


def incoherence(nodes: DataFrame, matrix: DataFrame, at: Names, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Per time: the largest distance of a node from the sum of its bottoms, and whether all are within the tolerance."""
    keys = names(at)
    bottoms = nodes.join(matrix.select("bottom").distinct().withColumnRenamed("bottom", "node"), "node", "left_semi").withColumnRenamed("node", "bottom")
    sums = bottom_up(bottoms, matrix, at, value).withColumnRenamed(value, "__sum")
    far = F.max(F.abs(F.col(value) - F.col("__sum")))
    return nodes.join(sums, ["node", *keys]).groupBy(*keys).agg(far.alias("max_gap"), (far < tolerance).alias("coherent"))


def projection(s: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """The matrix that makes all nodes' forecasts add up with least change: S (S' W^-1 S)^-1 S' W^-1. For the nodes of a hierarchy, not its data."""
    w = np.eye(len(s)) if weights is None else np.linalg.inv(weights + 1e-6 * np.eye(len(s)))
    return s @ np.linalg.pinv(s.T @ w @ s) @ s.T @ w


def reconcile(nodes: DataFrame, matrix: DataFrame, at: Names, value: str, covariance: np.ndarray | None = None, most_nodes: int = 5_000) -> DataFrame:
    """Least-squares reconciliation of forecasts of all nodes. The matrix of nodes is made on the driver and must be small."""
    if matrix.select("node").distinct().count() > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes")
    pairs = matrix.distinct().toPandas()
    nodes_, bottoms = sorted(pairs["node"].unique()), sorted(pairs["bottom"].unique())
    s = np.zeros((len(nodes_), len(bottoms)))
    s[[nodes_.index(x) for x in pairs["node"]], [bottoms.index(x) for x in pairs["bottom"]]] = 1
    p = projection(s, covariance)
    cells = [(nodes_[i], nodes_[j], float(p[i, j])) for i, j in zip(*np.nonzero(np.abs(p) > 1e-12), strict=True)]
    weights = nodes.sparkSession.createDataFrame(cells, "to string, node string, w double")
    return nodes.join(weights, "node").groupBy(F.col("to").alias("node"), *names(at)).agg(F.sum(F.col("w") * F.col(value)).alias(value))
