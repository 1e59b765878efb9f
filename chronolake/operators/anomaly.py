"""Outliers, change points, regions, treatments and root causes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, centred, expanding, gated, names, series, trailing, whole
from chronolake.operators.quantile import exact_quantiles
from chronolake.session import written


def zscore(value: str, entity: Names) -> Column:
    return (F.col(value) - F.avg(value).over(whole(entity))) / F.stddev_samp(value).over(whole(entity))


def spread(df: DataFrame, entity: Names, value: str) -> DataFrame:
    """Per entity: mean, deviation, quartiles, and the median and mean distance from the median (``mad``, ``mean_dev``).

    Two scans for the quartiles, which are written as a table of one row an entity, and two for the distances.
    """
    keys = names(entity)
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], more={"mean": F.avg, "std": F.stddev_samp})
    q = written(q.select(*keys, "mean", "std", *(F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3")))), "quartiles")
    far = df.select(*keys, value).join(q.select(*keys, "median"), keys).withColumn("__far", F.abs(F.col(value) - F.col("median")))
    mad = exact_quantiles(far, keys, "__far", [0.5], "__mad", {"mean_dev": F.avg})
    return q.join(mad.select(*keys, F.col("__mad")[0].alias("mad"), "mean_dev"), keys)


def outliers(df: DataFrame, entity: Names, value: str, z: float = 3.0, robust: float = 3.5, k: float = 1.5) -> DataFrame:
    """Adds ``z``, ``robust_z``, and flags by z-score, robust z-score and quartile fences. Sizes come from aggregates, joined back; an entity without values, or a null one, keeps its rows with nulls."""
    keys, v = names(entity), F.col(value)
    sizes = spread(df, keys, value).withColumnsRenamed({c: f"__{c}" for c in ("mean", "std", "q1", "median", "q3", "mad", "mean_dev")})
    d = df.join(sizes, keys, "left")
    # Without any spread around the median, the mean distance takes the place of the median one.
    rz = F.when(F.col("__mad") > 0, 0.6745 * (v - F.col("__median")) / F.col("__mad")).otherwise((v - F.col("__median")) / (1.253314 * F.col("__mean_dev") + 1e-8))
    d = d.withColumns({"z": (v - F.col("__mean")) / F.col("__std"), "robust_z": rz})
    iqr = F.col("__q3") - F.col("__q1")
    flags = {"is_z": F.abs("z") > z, "is_robust": F.abs("robust_z") > robust, "is_iqr": (v < F.col("__q1") - k * iqr) | (v > F.col("__q3") + k * iqr)}
    return d.withColumns({n: c.cast("int") for n, c in flags.items()}).drop(*(c for c in sizes.columns if c.startswith("__")))


def rolling_z(value: str, entity: Names, ts: Names, size: int) -> Column:
    w = trailing(entity, ts, size)
    sd = gated(F.stddev_samp, value, w, max(2, size // 2))
    return (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd)


def centred_z(value: str, entity: Names, ts: Names, size: int) -> Column:
    """Distance from the mean of a centred window in its deviations; windows of less than half the size give null."""
    w = centred(entity, ts, size)
    sd = gated(F.stddev_samp, value, w, max(2, size // 2))
    return (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd)


def rolling_fences(value: str, entity: Names, ts: Names, size: int, k: float = 1.5) -> dict[str, Column]:
    """Quartile fences of the last ``size`` rows, full windows only, and a flag outside them."""
    w = trailing(entity, ts, size)
    full = F.count(value).over(w) == size
    q1, q3 = F.percentile(value, 0.25).over(w), F.percentile(value, 0.75).over(w)
    low, high = F.when(full, q1 - k * (q3 - q1)), F.when(full, q3 + k * (q3 - q1))
    return {"low": low, "high": high, "outside": ((F.col(value) < low) | (F.col(value) > high)).cast("int")}


def rolling_range(value: str, entity: Names, ts: Names, size: int) -> dict[str, Column]:
    """Least and greatest of the ``size`` rows before, and whether the value leaves them; full windows only."""
    w = series(entity, ts).rowsBetween(-size, -1)
    full = F.count(value).over(w) == size
    low, high = F.when(full, F.min(value).over(w)), F.when(full, F.max(value).over(w))
    return {"low": low, "high": high, "outside": ((F.col(value) < low) | (F.col(value) > high)).cast("int")}


def smoothed(score: str, entity: Names, ts: Names, size: int) -> dict[str, Column]:
    """A score's mean and greatest value over the last ``size`` rows, however many there are."""
    w = trailing(entity, ts, size)
    return {"smooth_mean": F.avg(score).over(w), "smooth_max": F.max(score).over(w)}


def norm_cusum(df: DataFrame, entity: Names, ts: str, channels: list[str], reference: int, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """One-sided cumulative sum ``s`` of the length of the vector of z-scores, in deviations of the first ``reference`` rows, less ``k`` and the reference's mean length."""
    keys, w = names(entity), series(entity, ts)
    n = df.withColumn("__i", F.row_number().over(w) - 1)

    def ref(c: Column) -> Column:
        return F.when(F.col("__i") < reference, c)

    z = {f"__z{i}": (F.col(c) - F.avg(ref(F.col(c))).over(whole(keys))) / (F.stddev_pop(ref(F.col(c))).over(whole(keys)) + 1e-12) for i, c in enumerate(channels)}
    n = n.withColumns(z).withColumn("__len", F.sqrt(sum((F.col(c) * F.col(c) for c in z), F.lit(0.0))))
    n = n.withColumn("__x", F.col("__len") - F.avg(ref(F.col("__len"))).over(whole(keys)) - k)
    n = n.withColumn("__p", F.sum("__x").over(expanding(keys, ts)))
    s = n.withColumn("s", F.col("__p") - F.least(F.lit(0.0), F.min("__p").over(expanding(keys, ts))))
    return s.withColumn("alarm", (F.col("s") > h).cast("int")).drop("__i", "__len", "__x", "__p", *z)


def event_scores(df: DataFrame, entity: Names, index: str, columns: list[str], start: int, end: int, before: int, top: int = 3) -> DataFrame:
    """Features most out of line in an event: mean over rows ``start`` to ``end`` in deviations of the ``before`` rows ahead of it; (feature, z, rank), the ``top`` of each entity."""
    keys = names(entity)
    long = df.where(F.col(index).between(start - before, end)).unpivot([*keys, index], columns, "feature", "__v")
    base, now = F.when(F.col(index) < start, F.col("__v")), F.when(F.col(index) >= start, F.col("__v"))
    z = long.groupBy(*keys, "feature").agg(((F.avg(now) - F.avg(base)) / (F.stddev_samp(base) + 1e-12)).alias("z"))
    return z.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs("z").desc(), "feature"))).where(F.col("rank") <= top)


def contributions(df: DataFrame, keys: Names, errors: list[str]) -> DataFrame:
    """Each channel's percentage of a row's summed error: (keys, channel, pct)."""
    total = sum((F.col(c) for c in errors[1:]), F.col(errors[0]))
    parts = df.select(*names(keys), *((100 * F.col(c) / (total + 1e-12)).alias(c) for c in errors))
    return parts.unpivot(names(keys), errors, "channel", "pct")


def bands(value: str, entity: Names, ts: Names, size: int, k: float = 2.0) -> dict[str, Column]:
    """Moving mean with k deviations around it, and the place of the value between them; full windows only."""
    w = trailing(entity, ts, size)
    full = F.count(value).over(w) == size
    m, s = F.avg(value).over(w), F.stddev_samp(value).over(w)
    up, low = m + k * s, m - k * s
    return {"middle": F.when(full, m), "upper": F.when(full, up), "lower": F.when(full, low), "pct_b": F.when(full & (s > 0), (F.col(value) - low) / (up - low))}


def cusum(df: DataFrame, entity: Names, ts: str, value: str, reference: int, k: float = 0.5, h: float = 5.0, start: int = 1) -> DataFrame:
    """Two-sided cumulative sums ``s_hi``, ``s_lo`` and ``alarm``, in deviations of the first ``reference`` rows.

    The recursion max(0, S + x) equals the prefix sum less its running minimum, so two window passes
    replace it. ``start`` is the first row (from 0) that counts: 1 leaves S at 0 on the first row, 0 doesn't.
    """
    keys, w = names(entity), series(entity, ts)
    n = df.withColumn("__i", F.row_number().over(w) - 1)
    ref = F.when(F.col("__i") < reference, F.col(value))
    n = n.withColumn("__z", (F.col(value) - F.avg(ref).over(whole(keys))) / (F.stddev_pop(ref).over(whole(keys)) + 1e-12))
    up, down = F.when(F.col("__i") >= start, F.col("__z") - k).otherwise(0.0), F.when(F.col("__i") >= start, -F.col("__z") - k).otherwise(0.0)
    p = n.withColumns({"__p": F.sum(up).over(expanding(keys, ts)), "__q": F.sum(down).over(expanding(keys, ts))})
    low = {c: F.least(F.lit(0.0), F.min(c).over(expanding(keys, ts))) for c in ("__p", "__q")}
    s = p.withColumns({"s_hi": F.col("__p") - low["__p"], "s_lo": F.col("__q") - low["__q"]})
    return s.withColumn("alarm", (F.greatest("s_hi", "s_lo") > h).cast("int")).drop("__i", "__z", "__p", "__q")


def regions(df: DataFrame, entity: Names, index: str, flag: str, gap: int = 1) -> DataFrame:
    """Flagged rows grouped into regions: up to ``gap`` places apart belong together. Start, end, rows."""
    keys = names(entity)
    w = Window.partitionBy(*keys).orderBy(index)
    hit = df.where(F.col(flag) == 1)
    new = F.when(F.col(index) - F.lag(index).over(w) <= gap, 0).otherwise(1)
    told = hit.withColumn("__n", new).withColumn("region", F.sum("__n").over(w))
    return told.groupBy(*keys, "region").agg(F.min(index).alias("start"), F.max(index).alias("end"), F.count(F.lit(1)).alias("n_flagged"))


def winsorized(df: DataFrame, entity: Names, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    keys = names(entity)
    q = exact_quantiles(df, keys, value, [low, high], "__q")
    return df.join(q, keys, "left").withColumn("winsorized", F.least(F.greatest(F.col(value), F.col("__q")[0]), F.col("__q")[1])).drop("__q")


def median_replaced(value: str, flag: str, entity: Names, ts: Names, size: int) -> Column:
    w = series(entity, ts).rowsBetween(-(size // 2), (size - 1) // 2)
    return F.when(F.col(flag) == 1, F.percentile(value, 0.5).over(w)).otherwise(F.col(value))


def ensemble(df: DataFrame, entity: Names, scores: dict[str, float], name: str = "ensemble") -> DataFrame:
    """Weighted mean of scores, each brought to 0 to 1 in its entity."""
    w, total = whole(entity), sum(scores.values())
    parts = []
    for c, weight in scores.items():
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        parts.append(weight / total * F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0))
    return df.withColumn(name, sum(parts[1:], parts[0]))


def rank_ensemble(df: DataFrame, entity: Names, scores: list[str], name: str = "rank_score") -> DataFrame:
    """Mean of ranks over the number of rows."""
    from chronolake.operators.features import average_rank

    n = F.count(F.lit(1)).over(whole(entity))
    parts = [average_rank(c, entity) / n for c in scores]
    return df.withColumn(name, sum(parts[1:], parts[0]) / len(parts))


def threshold(df: DataFrame, score: str, how: str = "percentile", p: float = 0.99, sigmas: float = 3.0) -> DataFrame:
    """One row: a score's threshold by percentile, by deviations, or by deviations of logs (heavy tails)."""
    s = F.col(score)
    by = {"percentile": F.percentile(s, p), "sigma": F.avg(s) + sigmas * F.stddev_pop(s), "log": F.exp(F.avg(F.log(s + 1e-12)) + sigmas * F.stddev_pop(F.log(s + 1e-12)))}
    return df.agg(by[how].alias("threshold"))


def window_errors(df: DataFrame, entity: Names, index: str, errors: str) -> DataFrame:
    """The largest error of a place among all windows (arrays that start at ``index``) that cover it."""
    spread_ = df.select(*names(entity), F.posexplode(errors).alias("p", "e"), index).select(*names(entity), (F.col(index) + F.col("p")).alias("t"), "e")
    return spread_.groupBy(*names(entity), "t").agg(F.max("e").alias("error"))


def isolation_forest(df: DataFrame, columns: list[str], trees: int = 50, sample: int = 256, seed: int = 42, name: str = "iso_score") -> DataFrame:
    """Isolation scores: trees are grown on a bounded sample on the driver, all rows are scored on the executors."""
    known = df.select(*columns).na.drop()
    share = min(1.0, 16.0 * sample / max(known.count(), 1))
    some = known.where(F.pmod(F.xxhash64(*columns, F.lit(1)), F.lit(1 << 30)) / float(1 << 30) <= share).orderBy(F.xxhash64(*columns)).limit(sample * 8).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)

    def mean_depth(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x: np.ndarray, depth: int) -> tuple:
        lo, hi = (x.min(0), x.max(0)) if len(x) else (np.zeros(1), np.zeros(1))
        wide = np.flatnonzero(hi > lo)
        if len(x) < 2 or depth == 0 or not len(wide):
            return (mean_depth(len(x)),)
        c = int(rng.choice(wide))
        at = rng.uniform(lo[c], hi[c])
        return c, at, grow(x[x[:, c] < at], depth - 1), grow(x[x[:, c] >= at], depth - 1)

    size = min(sample, len(some))
    forest = [grow(some[rng.choice(len(some), size, replace=False)], int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)] if size else []

    def path(tree: tuple, x: np.ndarray, depth: float) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), depth + tree[0])
        left, out = x[:, tree[0]] < tree[1], np.empty(len(x))
        out[left], out[~left] = path(tree[2], x[left], depth + 1), path(tree[3], x[~left], depth + 1)
        return out

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        depth = np.mean([path(t, x, 0) for t in forest], axis=0) if forest else np.zeros(len(x))
        return pd.Series(2.0 ** (-depth / max(mean_depth(size), 1e-9)))

    return df.withColumn(name, score(*columns))


def lof(neighbours: DataFrame, point: str = "id", other: str = "other", distance: str = "d") -> DataFrame:
    """Local outlier factor from a table of each point's k nearest (point, other, distance)."""
    n = neighbours.select(F.col(point).alias("p"), F.col(other).alias("o"), F.col(distance).alias("d"))
    kd = n.groupBy("p").agg(F.max("d").alias("kd"))
    reach = n.join(kd.withColumnRenamed("p", "o"), "o").select("p", "o", F.greatest("d", "kd").alias("r"))
    lrd = reach.groupBy("p").agg((1 / F.greatest(F.avg("r"), F.lit(1e-12))).alias("lrd"))
    both = n.join(lrd.select(F.col("p").alias("o"), F.col("lrd").alias("lo")), "o").join(lrd, "p")
    return both.groupBy(F.col("p").alias(point)).agg((F.avg("lo") / F.max("lrd")).alias("lof"))


def trace_causes(edges: DataFrame, times: DataFrame, target: str, depth: int = 5, tolerance: float = 0.0) -> DataFrame:
    """Upstream nodes (cause, effect edges) of a target that turned bad before it: node, its least depth, its time. One join a level, each kept to distinct nodes."""
    at = times.where(F.col("node") == target).select(F.col("time").alias("t0"))
    level = times.where(F.col("node") == target).select("node", F.lit(0).alias("depth"))
    seen = level
    for d in range(1, depth + 1):
        level = level.select(F.col("node").alias("effect")).join(edges, "effect").select(F.col("cause").alias("node"), F.lit(d).alias("depth")).distinct()
        seen = seen.unionByName(level)
    least = seen.groupBy("node").agg(F.min("depth").alias("depth"))
    return least.join(times, "node").join(F.broadcast(at)).where((F.col("depth") == 0) | (F.col("time") < F.col("t0") + tolerance)).select("node", "depth", "time")


def cooled(df: DataFrame, entity: Names, index: str, flag: str, cooldown: int) -> DataFrame:
    """Alerts that stay when each silences the next ``cooldown`` places. One series at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        out, last = [], None
        for i, f in zip(pdf[index], pdf[flag], strict=True):
            fire = f == 1 and (last is None or i - last >= cooldown)
            last = i if fire else last
            out.append(int(fire))
        return pdf.assign(alert=out)

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.groupBy(*names(entity)).applyInPandas(run, f"{fields}, alert int")


def alert_levels(df: DataFrame, entity: Names, index: str, z: str, p: str, cooldown: int, warn: float = 0.55, critical: float = 0.80) -> DataFrame:
    """Adds ``score`` (0.4 of |z| over 5, at most 1, and 0.6 of the chance), ``alert`` and ``level``.

    An alert silences the next ``cooldown`` places; silenced rows are "NORMAL". A null z or chance counts as zero.
    """
    score = 0.4 * F.least(F.abs(F.coalesce(z, F.lit(0.0))) / 5, F.lit(1.0)) + 0.6 * F.coalesce(p, F.lit(0.0))
    rows = df.withColumn("score", score).withColumn("__over", (F.col("score") >= warn).cast("int"))
    level = F.when(F.col("alert") == 0, "NORMAL").when(F.col("score") >= critical, "CRITICAL").otherwise("WARNING")
    return cooled(rows, entity, index, "__over", cooldown).drop("__over").withColumn("level", level)
