"""Linear models of every entity from one aggregate: sums of products of columns, solved in batches.

A group's sums (its Gram matrix) are all that least squares, ridge, lasso, evidence and reduced-rank regression need, and
sums of disjoint rows add up. So a table is read once whatever the number of penalties, folds or rounds, and no rows are gathered.
Sums are of plain products: columns far from zero for their spread should be centred first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names


def gram(df: DataFrame, by: Names, columns: Sequence[Column | str]) -> DataFrame:
    """``by``, ``n`` and ``cells``: the upper triangle, row by row, of the columns' products, summed. Rows with a null in any column don't count."""
    cs = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]
    rows = df.select(*names(by), *(c.alias(f"__g{i}") for i, c in enumerate(cs))).dropna(subset=[f"__g{i}" for i in range(len(cs))])
    sums = [F.sum(F.col(f"__g{i}") * F.col(f"__g{j}")) for i in range(len(cs)) for j in range(i, len(cs))]
    return rows.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("cells"))


def matrices(cells: pd.Series, size: int) -> np.ndarray:
    """Symmetric matrices (groups, size, size) from their upper triangles."""
    at = np.triu_indices(size)
    out = np.zeros((len(cells), size, size))
    if len(cells):
        out[:, at[0], at[1]] = np.stack(cells.to_numpy())
        out[:, at[1], at[0]] = out[:, at[0], at[1]]
    return out


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of a stack of systems; a singular one by its pseudo-inverse."""
    try:
        return np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(a, b, strict=True)])


def ridge(df: DataFrame, by: Names, columns: Sequence[Column | str], target: Column | str, penalties: Sequence[float]) -> DataFrame:
    """``by``, ``n``, ``coef`` (array in the order of the columns): squared error plus each coefficient's square times its penalty."""
    p, weight = len(columns), np.diag(np.asarray(penalties, float))

    @F.pandas_udf("array<double>")
    def solved(cells: pd.Series) -> pd.Series:
        m = matrices(cells, p + 1)
        return pd.Series(list(_solve(m[:, :p, :p] + weight, m[:, :p, p])), index=cells.index)

    return gram(df, by, [*columns, target]).select(*names(by), "n", solved("cells").alias("coef"))


def dot(coef: Column | str, columns: Sequence[Column | str]) -> Column:
    """Sum of coefficients times columns."""
    c = F.col(coef) if isinstance(coef, str) else coef
    out = F.lit(0.0)
    for i, x in enumerate(columns):
        out = out + c[i] * (F.col(x) if isinstance(x, str) else x)
    return out


# ---------------------------------------------------------------- penalised regressions with folds in time


def descend(xx: np.ndarray, xy: np.ndarray, l1: float, l2: float, start: np.ndarray | None = None, sweeps: int = 2_000, least: float = 1e-12) -> np.ndarray:
    """Elastic net on mean products of scaled columns by cyclic coordinate descent: half the mean squared error + l1 |b| + l2 b² / 2."""
    b = np.zeros(len(xy)) if start is None else start.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            rest = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            new = math.copysign(max(abs(rest) - l1, 0.0), rest) / (xx[j, j] + l2) if xx[j, j] + l2 > 0 else 0.0
            moved = max(moved, abs(new - b[j]))
            b[j] = new
        if moved <= least * max(1.0, np.abs(b).max()):
            break
    return b


def scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """From sums of products of [1, columns, target]: mean products of columns scaled to deviation 1, those with the centred target, means, deviations, the target's mean."""
    n, p = m[0, 0], len(m) - 2
    mean = m[0] / n
    cov = m / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov)[1 : 1 + p], 0.0))
    safe = np.where(dev > 1e-12 * np.maximum(np.abs(mean[1 : 1 + p]), 1.0), dev, np.inf)
    return cov[1 : 1 + p, 1 : 1 + p] / np.outer(safe, safe), cov[1 : 1 + p, -1] / safe, mean[1 : 1 + p], safe, mean[-1]


def fit_net(m: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Coefficients of the columns as they are, intercept first."""
    xx, xy, mean, dev, level = scaled(m)
    b = descend(xx, xy, l1, l2) / dev
    return np.r_[level - b @ mean, b]


def squared_error(m: np.ndarray, coef: np.ndarray) -> float:
    """Mean squared error of [1, columns] @ coef on the rows behind the sums."""
    return float((m[-1, -1] - 2 * coef @ m[:-1, -1] + coef @ m[:-1, :-1] @ coef) / m[0, 0])


def penalty_path(df: DataFrame, by: Names, fold: Column | str, columns: Sequence[str], target: str, penalties: Sequence[float], ratio: float = 1.0) -> DataFrame:
    """Elastic nets along a path of penalties, judged by folds in time: ``by``, ``penalty``, ``cv_mse``, ``chosen``, ``intercept``, ``coef``.

    ``fold`` numbers each row's stretch of time from 0. For each fold from 1, the model is fitted on all earlier stretches and
    judged on the fold's own; both come from sums by stretch, so the table is read once. ``coef`` is of all rows. ``ratio`` is the share of the
    absolute penalty (1 for the lasso, 0 for ridge). The chosen penalty has the least mean error, the greater one of equals.
    """
    keys, size = names(by), len(columns) + 2
    sums = gram(df.withColumn("__fold", (F.col(fold) if isinstance(fold, str) else fold).cast("int")), [*keys, "__fold"], [F.lit(1.0), *columns, target])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__fold")
        m = matrices(pdf["cells"], size)
        before, rows = np.cumsum(m, 0), []
        for lam in penalties:
            l1, l2 = lam * ratio, lam * (1 - ratio)
            errors = [squared_error(m[k], fit_net(before[k - 1], l1, l2)) for k in range(1, len(m))]
            coef = fit_net(before[-1], l1, l2)
            rows.append((*(pdf[k].iloc[0] for k in keys), float(lam), float(np.mean(errors)) if errors else None, float(coef[0]), coef[1:].tolist()))
        out = pd.DataFrame(rows, columns=[*keys, "penalty", "cv_mse", "intercept", "coef"])
        best = out.sort_values(["cv_mse", "penalty"], ascending=[True, False]).index[0]
        out["chosen"] = out.index == best
        return out[[*keys, "penalty", "cv_mse", "chosen", "intercept", "coef"]]

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return sums.groupBy(*keys).applyInPandas(run, f"{fields}, penalty double, cv_mse double, chosen boolean, intercept double, coef array<double>")


def selected(path: DataFrame, by: Names, columns: Sequence[str]) -> DataFrame:
    """The chosen penalty's columns that have a coefficient: ``by``, ``term``, ``coefficient``."""
    terms = F.array(*map(F.lit, columns))
    rows = path.where("chosen").select(*names(by), F.posexplode("coef").alias("__i", "coefficient"))
    return rows.where("coefficient <> 0").select(*names(by), terms[F.col("__i")].alias("term"), "coefficient")


def evidence(m: np.ndarray, rounds: int = 300, least: float = 1e-10) -> tuple[np.ndarray, float, float, np.ndarray, np.ndarray, float]:
    """Bayesian ridge from sums of products: coefficients of centred columns, noise precision, weight precision, their covariance, means, the target's mean.

    Both precisions are raised to the greatest evidence by fixed-point steps, with flat priors of 1e-6.
    """
    n = m[0, 0]
    mean = m[0] / n
    xx = m[1:-1, 1:-1] - n * np.outer(mean[1:-1], mean[1:-1])
    xy, yy = m[1:-1, -1] - n * mean[1:-1] * mean[-1], m[-1, -1] - n * mean[-1] ** 2
    value, vector = np.linalg.eigh(xx)
    value, turned = np.maximum(value, 0.0), vector.T @ xy
    tiny = 1e-6
    noise, weight = n / max(yy, 1e-300), 1.0
    b = np.zeros(len(xy))
    for _ in range(rounds):
        new = vector @ (turned * noise / (weight + noise * value))
        done = np.abs(new - b).sum() <= least * max(np.abs(new).sum(), 1e-300)
        b = new
        known = float((noise * value / (weight + noise * value)).sum())
        rss = max(yy - 2 * b @ xy + b @ xx @ b, 0.0)
        weight = (known + 2 * tiny) / (b @ b + 2 * tiny)
        noise = (n - known + 2 * tiny) / (rss + 2 * tiny)
        if done:
            break
    spread = (vector / (weight + noise * value)) @ vector.T
    return vector @ (turned * noise / (weight + noise * value)), noise, weight, spread, mean[1:-1], mean[-1]


def bayesian_ridge(df: DataFrame, by: Names, columns: Sequence[str], target: str) -> DataFrame:
    """``by``, ``n``, ``intercept``, ``coef``, ``noise`` and ``weight`` (precisions), ``means`` and ``spread`` (the coefficients' covariance, row by row), for :func:`predicted_spread`."""
    size = len(columns) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.drop(columns="cells")
            fits = [evidence(m) for m in matrices(b["cells"], size)]
            out["coef"], out["noise"], out["weight"] = [f[0].tolist() for f in fits], [f[1] for f in fits], [f[2] for f in fits]
            out["spread"], out["means"] = [f[3].ravel().tolist() for f in fits], [f[4].tolist() for f in fits]
            out["intercept"] = [float(f[5] - f[0] @ f[4]) for f in fits]
            yield out

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names(by))
    return gram(df, by, [F.lit(1.0), *columns, target]).mapInPandas(run, f"{fields}, n long, coef array<double>, noise double, weight double, spread array<double>, means array<double>, intercept double")


def predicted_spread(df: DataFrame, fits: DataFrame, by: Names, columns: Sequence[str]) -> DataFrame:
    """Rows with ``prediction`` and ``std``: the noise and what the coefficients' uncertainty adds at the row's place."""
    p = len(columns)
    met = df.join(fits, names(by))
    away = [F.col(c) - F.col("means")[i] for i, c in enumerate(columns)]
    var = 1 / F.col("noise")
    for i in range(p):
        for j in range(p):
            var = var + F.col("spread")[i * p + j] * away[i] * away[j]
    return met.select(*df.columns, (F.col("intercept") + dot("coef", columns)).alias("prediction"), F.sqrt(var).alias("std"))


# ---------------------------------------------------------------- piecewise trend


def calendar_terms(ts: str, start: Column, end: Column, breaks: int, yearly: int, weekly: int, holidays: Sequence[str] = ()) -> tuple[list[Column], list[str]]:
    """Columns of a trend that can bend, with seasons and holidays, and their names.

    Time runs from 0 at ``start`` to 1 at ``end``; bends are evenly spread over the first 0.8. ``holidays`` are days of the year as MM-dd.
    """
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("double")
    t = F.datediff(F.to_date(ts), start).cast("double") / F.datediff(end, start)
    terms: list[tuple[str, Column]] = [("one", F.lit(1.0)), ("trend", t)]
    terms += [(f"bend_{k}", F.greatest(t - 0.8 * k / (breaks + 1), F.lit(0.0))) for k in range(1, breaks + 1)]
    for name, period, order in (("year", 365.25, yearly), ("week", 7.0, weekly)):
        for k in range(1, order + 1):
            angle = F.lit(2 * math.pi * k / period) * day
            terms += [(f"{name}_sin_{k}", F.sin(angle)), (f"{name}_cos_{k}", F.cos(angle))]
    terms += [(f"holiday_{h}", (F.date_format(ts, "MM-dd") == h).cast("double")) for h in holidays]
    return [c for _, c in terms], [n for n, _ in terms]


def piecewise_trend(df: DataFrame, entity: Names, ts: str, value: str, horizon: int, breaks: int = 8, yearly: int = 3, weekly: int = 2, holidays: Sequence[str] = (), bend_penalty: float = 1.0, season_penalty: float = 0.01) -> DataFrame:
    """Daily forecasts from a bending trend with seasons and holidays: ``entity``, ``step``, ``ts`` (a date), ``forecast``, ``trend``.

    One aggregate gives every entity's normal equations, one batch of solutions its coefficients. Bends are held back by
    ``bend_penalty``, seasons and holidays by ``season_penalty``; the trend goes on with its last slope. Days without rows are just absent.
    """
    keys = names(entity)
    ends = df.groupBy(*keys).agg(F.to_date(F.min(ts)).alias("__lo"), F.to_date(F.max(ts)).alias("__hi"))
    shape = dict(breaks=breaks, yearly=yearly, weekly=weekly, holidays=holidays)
    terms, labels = calendar_terms(ts, F.col("__lo"), F.col("__hi"), **shape)
    penalties = [0.0 if x in ("one", "trend") else bend_penalty if x.startswith("bend") else season_penalty for x in labels]
    fits = ridge(df.join(ends, keys), [*keys, "__lo", "__hi"], terms, value, penalties)
    ahead = fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(ts, F.date_add("__hi", F.col("step")))
    bends = 2 + breaks
    return ahead.select(*keys, "step", ts, dot("coef", terms).alias("forecast"), dot("coef", terms[:bends]).alias("trend"))


# ---------------------------------------------------------------- cointegration

#: 95 % points of the trace statistic with a constant, by the number of common trends left (1 to 6).
TRACE_95 = (3.8415, 15.4943, 29.7961, 47.8545, 69.8189, 95.7542)


def reduced_rank(m: np.ndarray, channels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From sums of products of [differences, levels before, the rest]: eigenvalues (falling), trace statistics, cointegrating vectors (columns), loadings."""
    k = channels
    n = m[2 * k, 2 * k]
    own, rest = m[: 2 * k, : 2 * k], m[2 * k :, 2 * k :]
    part = own - m[: 2 * k, 2 * k :] @ np.linalg.solve(rest, m[2 * k :, : 2 * k])
    s00, s01, s11 = part[:k, :k] / n, part[:k, k:] / n, part[k:, k:] / n
    root = np.linalg.inv(np.linalg.cholesky(s11))
    value, vector = np.linalg.eigh(root @ s01.T @ np.linalg.solve(s00, s01) @ root.T)
    order = np.argsort(-value)
    value, beta = np.clip(value[order], 0.0, 1 - 1e-15), root.T @ vector[:, order]
    trace = -n * np.cumsum(np.log1p(-value)[::-1])[::-1]
    return value, trace, beta, s01 @ beta


def johansen(df: DataFrame, by: Names, ts: str, channels: Sequence[str], lags: int = 1) -> DataFrame:
    """Cointegration rank by the trace test with a constant and ``lags`` lagged differences: ``by``, ``rank_null``, ``eigenvalue``, ``trace``, ``critical``, ``rejected``, ``rank``, ``vector``, ``loading``.

    One row for each null hypothesis "at most ``rank_null`` relations"; ``rank`` is the first that isn't rejected. ``vector`` and ``loading`` belong to the
    relation that is added next, the vector's first entry made 1. At most six channels have critical values.
    """
    keys, k = names(by), len(channels)
    w = Window.partitionBy(*keys).orderBy(ts)
    d = df.select(*keys, ts, *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(channels)))
    d = d.select("*", *(F.lag(f"x{i}").over(w).alias(f"l{i}") for i in range(k))).select(*keys, ts, *(f"l{i}" for i in range(k)), *((F.col(f"x{i}") - F.col(f"l{i}")).alias(f"d{i}") for i in range(k)))
    d = d.select("*", *(F.lag(f"d{i}", j).over(w).alias(f"d{i}_{j}") for j in range(1, lags + 1) for i in range(k)))
    columns = [*(f"d{i}" for i in range(k)), *(f"l{i}" for i in range(k)), F.lit(1.0), *(f"d{i}_{j}" for j in range(1, lags + 1) for i in range(k))]
    size = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, m in zip(b[keys].itertuples(index=False), matrices(b["cells"], size), strict=True):
                try:
                    value, trace, beta, alpha = reduced_rank(m, k)
                except np.linalg.LinAlgError:
                    rows += [(*key, r, None, None, TRACE_95[k - r - 1], None, None, None, None) for r in range(k)]
                    continue
                rejected = [bool(t > TRACE_95[k - r - 1]) for r, t in enumerate(trace)]
                rank = rejected.index(False) if False in rejected else k
                scale = [x[0] if abs(x[0]) > 1e-12 else 1.0 for x in beta.T]
                rows += [(*key, r, float(value[r]), float(trace[r]), TRACE_95[k - r - 1], rejected[r], rank, (beta[:, r] / scale[r]).tolist(), (alpha[:, r] * scale[r]).tolist()) for r in range(k)]
            yield pd.DataFrame(rows, columns=[*keys, "rank_null", "eigenvalue", "trace", "critical", "rejected", "rank", "vector", "loading"])

    fields = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in keys)
    return gram(d, keys, columns).mapInPandas(run, f"{fields}, rank_null int, eigenvalue double, trace double, critical double, rejected boolean, rank int, vector array<double>, loading array<double>")


# ---------------------------------------------------------------- unit root with a break


def zivot_andrews(df: DataFrame, entity: Names, ts: str, value: str, lags: int = 1, trim: float = 0.15, trend_break: bool = False) -> DataFrame:
    """Unit root against a trend with one break in its level (and slope): ``entity``, ``n``, ``break_at``, ``statistic``, ``critical``, ``stationary``.

    The regression of differences on a constant, time, lagged differences, the level before and the break terms is made for every break but
    those in the first and last ``trim`` of the series. What changes with the break are sums over the rows after it: one window gives them all, and
    the rest is partialled out, so a break costs a small system and no scan.
    """
    keys = names(entity)
    w = Window.partitionBy(*keys).orderBy("ts")
    d = df.select(*keys, F.col(ts).alias("ts"), F.col(value).cast("double").alias("y")).withColumn("l", F.lag("y").over(w)).withColumn("z", F.col("y") - F.col("l"))
    d = d.select("*", F.row_number().over(w).cast("double").alias("t"), *(F.lag("z", j).over(w).alias(f"z{j}") for j in range(1, lags + 1))).dropna()
    base = ["one", "t", *(f"z{j}" for j in range(1, lags + 1))]
    d = d.withColumn("one", F.lit(1.0))
    columns = [*base, "l", "z"]
    after = w.rowsBetween(1, Window.unboundedFollowing)
    sums = [F.coalesce(F.sum(F.col(c)).over(after), F.lit(0.0)) for c in columns] + [F.coalesce(F.sum(F.col("t") * F.col(c)).over(after), F.lit(0.0)) for c in columns]
    places = d.select(*keys, "ts", "t", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("m"), F.array(*sums).alias("after"))
    inside = places.where((F.col("i") >= F.ceil(trim * F.col("m"))) & (F.col("i") <= F.floor((1 - trim) * F.col("m"))))
    p, extra = len(columns), 2 if trend_break else 1

    @F.pandas_udf("double")
    def statistic(cells: pd.Series, n: pd.Series, t: pd.Series, after: pd.Series) -> pd.Series:
        m = matrices(cells, p)
        if not len(m):
            return pd.Series([], dtype=float)
        s = np.stack(after.to_numpy())
        level, slope = s[:, :p], s[:, p:] - t.to_numpy()[:, None] * s[:, :p]
        # Products of the break terms with all columns and with each other; of the second with itself: sum (u - t)² over rows after.
        tt = s[:, p + 1] - 2 * t.to_numpy() * s[:, 1] + t.to_numpy() ** 2 * s[:, 0]
        size = p + extra
        full = np.zeros((len(m), size, size))
        order = [*range(p - 1), *range(p, size), p - 1]
        full[:, :p, :p] = m
        full[:, p, :p] = full[:, :p, p] = level
        full[:, p, p] = level[:, 0]
        if extra == 2:
            full[:, p + 1, :p] = full[:, :p, p + 1] = slope
            full[:, p, p + 1] = full[:, p + 1, p] = slope[:, 0]
            full[:, p + 1, p + 1] = tt
        full = full[:, order][:, :, order]
        x, y, yy = full[:, :-1, :-1], full[:, :-1, -1], full[:, -1, -1]
        scale = np.sqrt(np.maximum(np.einsum("mii->mi", x), 1e-300))
        inverse = np.linalg.pinv(x / scale[:, :, None] / scale[:, None, :])
        b = np.einsum("mij,mj->mi", inverse, y / scale)
        rss = yy - np.einsum("mi,mi->m", b, y / scale)
        at = p - 2
        return pd.Series(b[:, at] / np.sqrt(np.maximum(rss / (n.to_numpy() - size + 1) * inverse[:, at, at], 1e-300)), index=cells.index)

    known = gram(d, keys, columns)
    tested = inside.join(known, keys).select(*keys, "ts", "n", statistic("cells", "n", "t", "after").alias("statistic"))
    one = tested.groupBy(*keys).agg(F.max("n").alias("n"), F.min(F.struct("statistic", "ts")).alias("s"))
    # 5 % points for a break in the level, and in level and slope.
    critical = -5.08 if trend_break else -4.93
    return one.select(*keys, "n", F.col("s.ts").alias("break_at"), F.col("s.statistic").alias("statistic"), F.lit(critical).alias("critical"), (F.col("s.statistic") < critical).alias("stationary"))


# ---------------------------------------------------------------- regressions of every entity, causes, autoregressions


def regression(df: DataFrame, by: Names, columns: Sequence[Column | str], target: Column | str) -> DataFrame:
    """Least squares with standard errors: ``by``, ``n``, ``coef``, ``error`` (arrays in the order of the columns), ``rss``."""
    p = len(columns)

    @F.pandas_udf("coef array<double>, error array<double>, rss double")
    def solved(cells: pd.Series, n: pd.Series) -> pd.DataFrame:
        m = matrices(cells, p + 1)
        x, xy = m[:, :p, :p], m[:, :p, p]
        scale = np.sqrt(np.maximum(np.einsum("mii->mi", x), 1e-300))
        inverse = np.linalg.pinv(x / scale[:, :, None] / scale[:, None, :]) / scale[:, :, None] / scale[:, None, :] if len(m) else x
        b = np.einsum("mij,mj->mi", inverse, xy)
        rss = m[:, p, p] - np.einsum("mi,mi->m", b, xy)
        free = n.to_numpy(float) - p
        s2 = np.maximum(rss, 0) / np.where(free > 0, free, np.nan)
        error = np.sqrt(np.maximum(np.einsum("mii->mi", inverse), 0) * s2[:, None])
        return pd.DataFrame({"coef": list(b), "error": list(error), "rss": rss})

    return gram(df, by, [*columns, target]).select(*names(by), "n", solved("cells", "n").alias("r")).select(*names(by), "n", "r.*")


def with_lags(df: DataFrame, by: Names, ts: str, channels: Sequence[str], lag: int) -> tuple[DataFrame, list[str]]:
    """The channels as doubles and their lags ``c__k``, and the lags' names: lag 1 of all channels first."""
    w = Window.partitionBy(*names(by)).orderBy(ts)
    lagged = {f"{c}__{k}": F.lag(F.col(c).cast("double"), k).over(w) for k in range(1, lag + 1) for c in channels}
    return df.select(*names(by), ts, *(F.col(c).cast("double").alias(c) for c in channels), *(v.alias(k) for k, v in lagged.items())), list(lagged)


def _rss(m: np.ndarray, x: list[int], y: int) -> float:
    return float(m[y, y] - m[y, x] @ np.linalg.lstsq(m[np.ix_(x, x)], m[x, y], rcond=None)[0])


def granger(df: DataFrame, by: Names, ts: str, channels: Sequence[str], lag: int) -> DataFrame:
    """Whether a channel's lags help another beside the lags of all: ``by``, ``cause``, ``effect``, ``f``, ``p_value``, for every pair and entity from one aggregate."""
    from chronolake.operators.stats import f_tail

    keys, k = names(by), len(channels)
    d, lags = with_lags(df, by, ts, channels, lag)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, n, m in zip(b[keys].itertuples(index=False), b["n"], matrices(b["cells"], k + 1 + k * lag), strict=True):
                every = list(range(k, len(m)))
                for e in range(k):
                    full, free = _rss(m, every, e), n - 1 - k * lag
                    for c in range(k):
                        if c != e:
                            own = [i for i in every if i == k or (i - k - 1) % k != c]
                            f = (_rss(m, own, e) - full) / lag / (full / free) if free > 0 and full > 0 else float("nan")
                            rows.append((*key, channels[c], channels[e], f, f_tail(f, lag, free) if f == f else float("nan")))
            yield pd.DataFrame(rows, columns=[*keys, "cause", "effect", "f", "p_value"])

    fields = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in keys)
    return gram(d, keys, [*channels, F.lit(1.0), *lags]).mapInPandas(run, f"{fields}, cause string, effect string, f double, p_value double")


def autoregression(df: DataFrame, by: Names, ts: str, channels: Sequence[str], lag: int) -> DataFrame:
    """Vector autoregressions: ``by``, ``n``, ``channel``, ``coef`` (intercept, lag 1 of all channels, lag 2, ...), ``covariance`` (the channel's row of the residuals')."""
    keys, k = names(by), len(channels)
    d, lags = with_lags(df, by, ts, channels, lag)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, n, m in zip(b[keys].itertuples(index=False), b["n"], matrices(b["cells"], k + 1 + k * lag), strict=True):
                coef = np.linalg.lstsq(m[k:, k:], m[k:, :k], rcond=None)[0]
                cov = (m[:k, :k] - coef.T @ m[k:, :k]) / n
                rows += [(*key, n, c, coef[:, i].tolist(), cov[i].tolist()) for i, c in enumerate(channels)]
            yield pd.DataFrame(rows, columns=[*keys, "n", "channel", "coef", "covariance"])

    fields = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in keys)
    return gram(d, keys, [*channels, F.lit(1.0), *lags]).mapInPandas(run, f"{fields}, n long, channel string, coef array<double>, covariance array<double>")


def responses(fits: DataFrame, by: Names, channels: Sequence[str], horizon: int) -> DataFrame:
    """Orthogonal responses and shares of the forecast error's variance: ``by``, ``shock``, ``channel``, ``step`` from 0, ``response``, ``share`` (up to the step)."""
    keys, k = names(by), len(channels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.set_index("channel").loc[list(channels)]
        coef, cov = np.stack(pdf["coef"]), np.stack(pdf["covariance"])
        lag = (coef.shape[1] - 1) // k
        a = [coef[:, 1 + j * k : 1 + (j + 1) * k] for j in range(lag)]
        psi = [np.eye(k)]
        for h in range(1, horizon + 1):
            psi.append(sum(psi[h - j - 1] @ a[j] for j in range(min(h, lag))))
        theta = np.array(psi) @ np.linalg.cholesky(cov)
        sums = np.cumsum(theta**2, 0)
        share = sums / sums.sum(2, keepdims=True)
        rows = [(*(pdf[x].iloc[0] for x in keys), s, c, h, float(theta[h, i, j]), float(share[h, i, j])) for h in range(horizon + 1) for i, c in enumerate(channels) for j, s in enumerate(channels)]
        return pd.DataFrame(rows, columns=[*keys, "shock", "channel", "step", "response", "share"])

    fields = ", ".join(f"`{x}` {fits.schema[x].dataType.simpleString()}" for x in keys)
    return fits.groupBy(*keys).applyInPandas(run, f"{fields}, shock string, channel string, step int, response double, share double")


def unit_root(df: DataFrame, by: Names, ts: str, value: str, lags: int) -> DataFrame:
    """Augmented Dickey-Fuller with a constant: ``by``, ``n``, ``statistic``, ``stationary`` at 5 % for large samples."""
    keys = names(by)
    w = Window.partitionBy(*keys).orderBy(ts)
    y = F.col(value).cast("double")
    d = df.select(*keys, ts, F.lag(y).over(w).alias("l"), (y - F.lag(y).over(w)).alias("d"))
    d = d.select("*", *(F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)))
    t = regression(d, keys, ["l", F.lit(1.0), *(f"d{k}" for k in range(1, lags + 1))], "d").withColumn("statistic", F.col("coef")[0] / F.col("error")[0])
    # Fixed value: 5 % point with a constant.
    return t.select(*keys, "n", "statistic", (F.col("statistic") < -2.86).alias("stationary"))
