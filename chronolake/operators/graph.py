"""Relations between channels, and data made like given data."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.metrics import running_before
from chronolake.functions.windows import Names, names


def correlations(wide: DataFrame, channels: list[str]) -> DataFrame:
    """(src, dst, w) for all ordered pairs of columns, one aggregate."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    one = wide.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(x).alias("src"), F.lit(y).alias("dst"), F.col(f"c{i}").alias("w")) for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))))
    return one.select(F.explode(rows).alias("e")).select("e.*")


def adjacency(edges: DataFrame, least: float, symmetric: bool = False) -> DataFrame:
    """Edges of at least that weight (in size), weights divided by their row's sum, or by the roots of both nodes' sums."""
    kept = edges.where(F.abs("w") >= least).withColumn("w", F.abs("w"))
    if not symmetric:
        return kept.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src")))
    return kept.withColumn("w", F.col("w") / F.sqrt(F.sum("w").over(Window.partitionBy("src")) * F.sum("w").over(Window.partitionBy("dst"))))


def gaussian_edges(pairs: DataFrame, d: str, sigma: float, least: float = 0.1) -> DataFrame:
    """Edges exp(-d^2 / sigma^2) of pairs (src, dst, d), small ones left out."""
    return pairs.select("src", "dst", F.exp(-F.pow(F.col(d) / sigma, 2)).alias("w")).where(F.col("w") >= least)


def propagated(values: DataFrame, edges: DataFrame, at: Names, node: str, value: str) -> DataFrame:
    """One hop: each node's weighted sum of its neighbours' values."""
    v = values.select(*names(at), F.col(node).alias("dst"), value)
    return v.join(edges, "dst").groupBy(F.col("src").alias(node), *names(at)).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def tokens(value: Column, low: float, high: float, bins: int = 4096) -> Column:
    """Numbers from 0 of equal bins; values outside take the first or last."""
    return F.least(F.greatest(F.floor((value - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def jittered(df: DataFrame, value: str, sigma: float, seed: int = 42) -> DataFrame:
    return df.withColumn(value, F.col(value) + sigma * F.randn(seed))


def rescaled(df: DataFrame, entity: Names, value: str, sigma: float, seed: int = 42) -> DataFrame:
    """One random factor around 1 for each entity."""
    one = df.select(*names(entity)).distinct().withColumn("__f", 1 + sigma * F.randn(seed))
    return df.join(one, names(entity)).withColumn(value, F.col(value) * F.col("__f")).drop("__f")


def warped(column: str, sigma: float = 0.2, knots: int = 4, seed: int = 42) -> Column:
    """An array read along a randomly bent time axis."""
    import pandas as pd

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        rng = np.random.default_rng(seed)
        out = []
        for x in s:
            n = len(x)
            speed = np.interp(np.arange(n), np.linspace(0, n - 1, knots), rng.normal(1, sigma, knots)).clip(0.05)
            at = (np.cumsum(speed) - speed[0]) / max(speed[1:].sum(), 1e-9) * (n - 1)
            out.append(np.interp(at, np.arange(n), np.asarray(x, float)).tolist())
        return pd.Series(out)

    return run(F.col(column))


def laplace_noise(scale: float, seed: int = 42) -> Column:
    """By the inverse of its distribution function; for differential privacy the scale is sensitivity / epsilon."""
    u = F.rand(seed) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u) + 1e-300)


def random_walk(spark, entities: int, steps: int, mu: float, sigma: float, start: float = 100.0, seed: int = 42) -> DataFrame:  # noqa: ANN001
    """Geometric Brownian paths: (entity, t, value)."""
    base = spark.range(entities).withColumnRenamed("id", "entity").select("entity", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t"))
    r = base.withColumn("r", F.when(F.col("t") == 0, 0.0).otherwise(mu - sigma * sigma / 2 + sigma * F.randn(seed)))
    return r.select("entity", "t", (start * F.exp(F.sum("r").over(Window.partitionBy("entity").orderBy("t")))).alias("value"))


def ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's number of smaller rows in its place (nulls first), from counts by distinct value, so that no task orders the whole table."""
    out = df.select(*columns)
    for x in columns:
        by = df.groupBy(F.col(x).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        least = by.where("__v is null").select("__n").first()
        below = running_before(by.where("__v is not null"), "__v", "__n", "__below").select("__v", "__below")
        out = out.join(below, F.col(x) == F.col("__v"), "left").withColumn(x, F.coalesce(F.col("__below") + (least[0] if least else 0), F.lit(0))).drop("__v", "__below")
    return out


def copula_sample(df: DataFrame, columns: list[str], n: int, seed: int = 42, bins: int = 200) -> DataFrame:
    """Rows with the columns' margins (by ``bins`` quantiles) and their rank correlation, through a Gaussian copula."""
    q = [i / bins for i in range(bins + 1)]
    row = df.agg(*(F.percentile_approx(c, q).alias(c) for c in columns)).first()
    c = np.eye(len(columns))
    ranked = ranks(df, columns)
    cells = [(i, j) for i in range(len(columns)) for j in range(i)]
    for (i, j), v in zip(cells, ranked.agg(*(F.corr(columns[i], columns[j]) for i, j in cells)).first() if cells else [], strict=True):
        c[i, j] = c[j, i] = 2 * math.sin(math.pi / 6 * (v or 0))
    values, vectors = np.linalg.eigh(c)
    z = np.random.default_rng(seed).normal(size=(n, len(columns))) @ (vectors * np.sqrt(values.clip(0))).T
    u = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))(z / z.std(0))
    out = np.column_stack([np.interp(u[:, k], q, row[x]) for k, x in enumerate(columns)])
    return df.sparkSession.createDataFrame([tuple(map(float, r)) for r in out], ", ".join(f"`{x}` double" for x in columns))


def fidelity(real: DataFrame, made: DataFrame, array: str) -> DataFrame:
    """Mean absolute difference of mean and deviation by place, between two sets of arrays."""

    def by_place(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.posexplode(array).alias("p", "x")).groupBy("p").agg(F.avg("x").alias(f"m_{tag}"), F.stddev_pop("x").alias(f"s_{tag}"))

    both = by_place(real, "r").join(by_place(made, "g"), "p")
    return both.agg(F.avg(F.abs(F.col("m_r") - F.col("m_g"))).alias("mean_error"), F.avg(F.abs(F.col("s_r") - F.col("s_g"))).alias("std_error"))
