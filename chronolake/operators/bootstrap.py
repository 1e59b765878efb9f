"""Moving-block bootstrap as tables: which block a replicate takes is a hash of its place, so resampling is a join and an aggregate.

A draw is the MD5 of seed, key, replicate and slot: the same on every run, cluster and engine. Replicates of a series are sums of block
sums, which one window gives, so no series is gathered and no row is copied but the block's sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names, series


def drawn(key: Column, replicate: Column, slot: Column, seed: int) -> Column:
    """A whole number from 0 to 2^32 - 1."""
    text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), replicate.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def block_means(df: DataFrame, by: str, ts: str, columns: Sequence[str], block: int, replicates: int, seed: int = 42) -> DataFrame:
    """Means of ``columns`` over resampled series: ``by``, ``replicate`` (from 1; 0 is the series itself), one column each.

    A replicate joins ceil(n / block) blocks, each of ``block`` consecutive rows from a drawn place. A series shorter than a block is one block.
    """
    w = series(by, ts)
    n = df.select(by, *(F.col(c).cast("double").alias(c) for c in columns), ts)
    ahead = w.rowsBetween(0, block - 1)
    n = n.select(by, F.row_number().over(w).alias("__i"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("__n"), *columns, *(F.sum(c).over(ahead).alias(f"__s{i}") for i, c in enumerate(columns)), F.count(F.lit(1)).over(ahead).alias("__m"))
    size = F.least(F.lit(block), F.col("__n"))
    blocks = n.where(F.col("__i") <= F.col("__n") - size + 1).select(by, "__i", "__m", *(f"__s{i}" for i in range(len(columns))))
    length = n.groupBy(by).agg(F.max("__n").alias("__n"))
    places = length.select(by, "__n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).select("*", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__n") / size).cast("int"))).alias("__slot"))
    draws = places.select(by, "replicate", (F.pmod(drawn(F.col(by), F.col("replicate"), F.col("__slot"), seed), F.col("__n") - size + 1) + 1).cast("int").alias("__i"))
    made = draws.join(blocks, [by, "__i"]).groupBy(by, "replicate").agg(*((F.sum(f"__s{i}") / F.sum("__m")).alias(c) for i, c in enumerate(columns)))
    own = n.groupBy(by).agg(*(F.avg(c).alias(c) for c in columns)).select(by, F.lit(0).alias("replicate"), *columns)
    return own.unionByName(made)


def mean_intervals(df: DataFrame, by: str, ts: str, columns: Sequence[str], block: int, replicates: int, alpha: float = 0.1, seed: int = 42) -> DataFrame:
    """``by``, ``column``, ``mean`` and the replicates' quantiles ``lower`` and ``upper``."""
    made = block_means(df, by, ts, columns, block, replicates, seed)
    long = made.select(by, "replicate", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns))).alias("r")).select(by, "replicate", "r.*")
    again = F.when(F.col("replicate") > 0, F.col("v"))
    return long.groupBy(by, "column").agg(F.max(F.when(F.col("replicate") == 0, F.col("v"))).alias("mean"), F.percentile(again, alpha / 2).alias("lower"), F.percentile(again, 1 - alpha / 2).alias("upper"))


def forecast_intervals(residuals: DataFrame, forecasts: DataFrame, by: str, ts: str, e: str, f: str, block: int, replicates: int, alpha: float = 0.1, seed: int = 42) -> DataFrame:
    """Forecasts (``by``, ``step``, ``f``) with ``lower`` and ``upper`` from residuals resampled in blocks; a block of 1 is the plain bootstrap."""
    w = series(by, ts)
    n = residuals.select(by, F.col(e).cast("double").alias("__e"), F.row_number().over(w).alias("__i"), F.count(F.lit(1)).over(Window.partitionBy(by)).alias("__n"))
    size = F.least(F.lit(block), F.col("__n"))
    length = n.groupBy(by).agg(F.max("__n").alias("__n"))
    asked = forecasts.join(length, by).withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("__k", F.floor((F.col("step") - 1) / size))
    place = F.pmod(drawn(F.col(by), F.col("__r"), F.col("__k"), seed), F.col("__n") - size + 1) + 1 + (F.col("step") - 1) % size
    met = asked.withColumn("__i", place.cast("int")).join(n.select(by, "__i", "__e"), [by, "__i"])
    shown = F.col(f) + F.col("__e")
    return met.groupBy(by, "step", f).agg(F.percentile(shown, alpha / 2).alias("lower"), F.percentile(shown, 1 - alpha / 2).alias("upper"))


def confidence_set(losses: DataFrame, by: str, ts: str, models: Sequence[str], block: int, replicates: int, alpha: float = 0.1, seed: int = 42) -> DataFrame:
    """Models that can't be told from the best, for each ``by``: ``model``, ``loss`` (mean), ``kept``, ``p_value`` (the test's at which it left, or at which no more left).

    The worst model leaves while the range statistic of the rest, studentised by the replicates, is rarer than ``alpha``. Replicates are a row each, so a
    task holds ``replicates`` rows of a key whatever the length of its series. Models without any difference are kept together.
    """
    made = block_means(losses, by, ts, models, block, replicates, seed)
    kind = losses.schema[by].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("replicate")
        x = pdf[list(models)].to_numpy(float)
        mean, boot = x[0], x[1:]
        left, out, p = list(range(len(models))), {}, 1.0
        while len(left) > 1:
            d = mean[left] - mean[left].mean()
            b = boot[:, left] - boot[:, left].mean(1, keepdims=True) - d
            spread = b.std(0) + 1e-12
            t = d / spread
            p = float(((b / spread).max(1) >= t.max()).mean())
            if p >= alpha:
                break
            gone = left.pop(int(t.argmax()))
            out[gone] = p
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(models), "model": list(models), "loss": mean, "kept": [i not in out for i in range(len(models))], "p_value": [out.get(i, p if len(left) > 1 else 1.0) for i in range(len(models))]})

    return made.groupBy(by).applyInPandas(run, f"`{by}` {kind}, model string, loss double, kept boolean, p_value double")
