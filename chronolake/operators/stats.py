"""Test statistics as aggregates, with p-values where a closed form exists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.scalars import normal_cdf
from chronolake.functions.windows import Names, names, series, whole


def acf(df: DataFrame, entity: Names, ts: str, value: str, most: int) -> DataFrame:
    """Autocorrelation for lags 1 to ``most``: (entity, lag, rho, n, significant). One window pass gives all lags."""
    keys = names(entity)
    d = df.select(*keys, ts, (F.col(value) - F.avg(value).over(whole(keys))).alias("d"))
    w = series(entity, ts)
    sums = d.select(*keys, "d", *(F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, most + 1)))
    one = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("d") * F.col("d")).alias("g0"), *(F.sum(F.col("d") * F.col(f"d{k}")).alias(f"g{k}") for k in range(1, most + 1)))
    out = one.select(*keys, "n", F.posexplode(F.array(*(F.col(f"g{k}") / F.col("g0") for k in range(1, most + 1)))).alias("p", "rho"))
    return out.select(*keys, (F.col("p") + 1).alias("lag"), "rho", "n", (F.abs("rho") > 1.96 / F.sqrt("n")).alias("significant"))


def pacf(rho: list[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations, by the Durbin-Levinson recursion."""
    out, phi = [], []
    for k in range(1, len(rho) + 1):
        top = rho[k - 1] - sum(p * r for p, r in zip(phi, rho[: k - 1][::-1], strict=True))
        bottom = 1 - sum(p * r for p, r in zip(phi, rho[: k - 1], strict=True))
        a = top / bottom
        phi = [*(p - a * q for p, q in zip(phi, phi[::-1], strict=True)), a]
        out.append(a)
    return out


def ljung_box(acf_rows: DataFrame, entity: Names) -> DataFrame:
    n = F.col("n")
    return acf_rows.groupBy(*names(entity)).agg((F.max(n * (n + 2)) * F.sum(F.pow("rho", 2) / (n - F.col("lag")))).alias("q"), F.max("lag").alias("lags"))


def ccf(df: DataFrame, entity: Names, ts: str, x: str, y: str, most: int) -> DataFrame:
    """Correlation of x with y shifted by -most to most rows: positive lags relate x to earlier y."""
    w, keys = series(entity, ts), names(entity)
    cols = {k: F.lag(y, k).over(w) if k >= 0 else F.lead(y, -k).over(w) for k in range(-most, most + 1)}
    wide = df.select(*keys, x, *(c.alias(f"y{i}") for i, c in enumerate(cols.values())))
    one = wide.groupBy(*keys).agg(*(F.corr(x, f"y{i}").alias(f"c{i}") for i in range(len(cols))))
    return one.select(*keys, F.posexplode(F.array(*(F.col(f"c{i}") for i in range(len(cols))))).alias("p", "corr")).select(*keys, (F.col("p") - most).alias("lag"), "corr")


def durbin_watson(df: DataFrame, entity: Names, ts: str, e: str) -> DataFrame:
    d = F.col(e) - F.lag(e).over(series(entity, ts))
    return df.select(*names(entity), e, d.alias("__d")).groupBy(*names(entity)).agg((F.sum(F.pow("__d", 2)) / F.sum(F.pow(e, 2))).alias("dw"))


def diebold_mariano(df: DataFrame, entity: Names, ts: str, e1: str, e2: str, horizon: int = 1, power: int = 2, alternative: str = "two-sided") -> DataFrame:
    """Equal accuracy of two forecasts by squared loss, or absolute loss (``power`` 1). Negative statistics favour the first.

    ``p_value`` is normal: two-sided, or for the first being better ("less") or worse ("greater").

    The long-run variance takes lags below the horizon with falling weights. ``dm_modified`` has the small-sample factor.
    """
    keys = names(entity)
    loss = df.select(*keys, ts, (F.pow(F.abs(e1), power) - F.pow(F.abs(e2), power)).alias("d")).withColumn("c", F.col("d") - F.avg("d").over(whole(keys)))
    w = series(entity, ts)
    lagged = loss.select("*", *(F.lag("c", k).over(w).alias(f"c{k}") for k in range(1, horizon)))
    one = lagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"), F.sum(F.col("c") * F.col("c")).alias("g0"), *(F.sum(F.col("c") * F.col(f"c{k}")).alias(f"g{k}") for k in range(1, horizon)))
    n = F.col("n")
    var = F.col("g0") / n
    for k in range(1, horizon):
        var = var + 2 * (1 - k / horizon) * F.col(f"g{k}") / n
    dm = F.col("mean_d") / F.sqrt(F.greatest(var, F.lit(1e-12)) / n)
    factor = F.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n)
    p = {"two-sided": 2 * (1 - normal_cdf(F.abs("dm"))), "less": normal_cdf(F.col("dm")), "greater": 1 - normal_cdf(F.col("dm"))}[alternative]
    return one.select(*keys, "n", "mean_d", dm.alias("dm"), (dm * factor).alias("dm_modified")).withColumn("p_value", p)


def normality(df: DataFrame, by: Names, value: str) -> DataFrame:
    """Skewness and kurtosis (both 0 for the normal), and the Jarque-Bera statistic with its p-value (two degrees of freedom)."""
    s, k, n = F.skewness(value), F.kurtosis(value), F.count(value)
    jb = n / 6 * (s * s + k * k / 4)
    return df.groupBy(*names(by)).agg(n.alias("n"), s.alias("skewness"), k.alias("kurtosis"), jb.alias("jarque_bera"), F.exp(-jb / 2).alias("p_value"))


def skewness_kurtosis_test(df: DataFrame, by: Names, value: str) -> DataFrame:
    """Normality by D'Agostino's transformed skewness and Anscombe's transformed kurtosis: both z-scores, their squares' sum and its p-value.

    Groups of fewer than 8 values, or without spread, have nulls.
    """
    n = F.count(value).cast("double")
    one = df.groupBy(*names(by)).agg(n.alias("n"), F.skewness(value).alias("g"), (F.kurtosis(value) + 3).alias("b"))
    n, g, b = F.col("n"), F.col("g"), F.col("b")
    y = g * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    u = y / F.sqrt(2 / (w2 - 1))
    z_skew = F.log(u + F.sqrt(u * u + 1)) / F.sqrt(F.log(w2) / 2)
    x = (b - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z_kurt = (1 - 2 / (9 * a) - F.signum(inner) * F.pow(F.abs(inner), 1 / 3)) / F.sqrt(2 / (9 * a))
    enough = (n >= 8) & g.isNotNull() & ~F.isnan(g)
    out = one.select(*names(by), n.cast("long").alias("n"), F.when(enough, z_skew).alias("z_skewness"), F.when(enough, z_kurt).alias("z_kurtosis"))
    k2 = F.col("z_skewness") * F.col("z_skewness") + F.col("z_kurtosis") * F.col("z_kurtosis")
    return out.withColumn("k2", k2).withColumn("p_value", F.exp(-F.col("k2") / 2))


def giacomini_white(df: DataFrame, entity: Names, ts: str, e1: str, e2: str, power: int = 1) -> DataFrame:
    """Equal conditional accuracy of two forecasts, given the loss difference of the row before.

    Loss differences are regressed on a constant and their own lag; the statistic is Wald's with the residuals' robust
    covariance, its p-value that of two degrees of freedom. Four aggregates over a series; no rows are gathered.
    """
    keys = names(entity)
    d = df.select(*keys, ts, (F.pow(F.abs(e1), power) - F.pow(F.abs(e2), power)).alias("d"))
    d = d.withColumn("z", F.lag("d").over(series(entity, ts))).where("z is not null and d is not null")
    line = d.groupBy(*keys).agg(F.regr_slope("d", "z").alias("b"), F.regr_intercept("d", "z").alias("a"))
    r2 = F.pow(F.col("d") - F.col("a") - F.col("b") * F.col("z"), 2)
    one = d.join(line, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("g1"), F.avg(F.col("d") * F.col("z")).alias("g2"), F.avg(r2).alias("s11"), F.avg(r2 * F.col("z")).alias("s12"), F.avg(r2 * F.col("z") * F.col("z")).alias("s22")
    )
    g1, g2, s11, s12, s22 = map(F.col, ("g1", "g2", "s11", "s12", "s22"))
    wald = F.col("n") * (g1 * g1 * s22 - 2 * g1 * g2 * s12 + g2 * g2 * s11) / (s11 * s22 - s12 * s12)
    return one.select(*keys, "n", wald.alias("wald")).withColumn("p_value", F.exp(-F.col("wald") / 2))


def phillips_perron(df: DataFrame, entity: Names, ts: str, value: str, lags: int) -> DataFrame:
    """Unit root with a constant: the t statistic of the level's coefficient less one, corrected by a long-run variance of ``lags`` lags with falling weights."""
    keys, w = names(entity), series(entity, ts)
    d = df.select(*keys, ts, F.col(value).cast("double").alias("y"), F.lag(F.col(value).cast("double")).over(w).alias("l")).where("l is not null")
    line = d.groupBy(*keys).agg(F.regr_slope("y", "l").alias("b"), F.regr_intercept("y", "l").alias("a"), F.regr_sxx("y", "l").alias("sxx"))
    e = d.join(line, keys).select(*keys, ts, "b", "sxx", (F.col("y") - F.col("a") - F.col("b") * F.col("l")).alias("e"))
    e = e.select("*", *(F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, lags + 1)))
    one = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("b").alias("b"), F.max("sxx").alias("sxx"), F.sum(F.col("e") * F.col("e")).alias("ss"), *(F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(1, lags + 1)))
    n, short = F.col("n"), F.col("ss") / F.col("n")
    long = short
    for k in range(1, lags + 1):
        long = long + 2 * (1 - k / (lags + 1)) * F.col(f"g{k}") / n
    s2 = F.col("ss") / (n - 2)
    se = F.sqrt(s2 / F.col("sxx"))
    z = (F.col("b") - 1) / se * F.sqrt(short / long) - (long - short) / 2 / F.sqrt(long) * n * se / F.sqrt(s2)
    # Fixed value: 5 % point with a constant for large samples.
    return one.select(*keys, "n", (F.col("b") - 1).alias("rho"), z.alias("z_tau"), (z < -2.86).alias("stationary"))


def comparison(df: DataFrame, entity: Names, ts: str, models: dict[str, str], baseline: str, horizon: int = 1) -> DataFrame:
    """Each model's errors beside the baseline's: mean absolute errors, skill, share of rows with less error, Diebold-Mariano by absolute loss."""
    out = None
    for name, e in models.items():
        if name == baseline:
            continue
        base = models[baseline]
        own = df.groupBy(*names(entity)).agg(F.lit(name).alias("model"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(base)).alias("baseline_mae"), F.avg((F.abs(e) < F.abs(base)).cast("double")).alias("pct_better"))
        dm = diebold_mariano(df, entity, ts, e, base, horizon, 1).select(*names(entity), "dm")
        own = own.withColumn("skill", 1 - F.col("mae") / F.col("baseline_mae")).join(dm, names(entity))
        out = own if out is None else out.unionByName(own)
    return out


def paired_t(df: DataFrame, by: Names, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(*names(by)).agg(F.count(d).alias("n"), F.avg(d).alias("mean_d"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"))


def _regression_rss(one: list[list[float]], y: list[float], yy: float) -> float:
    """Residual sum of squares from the moments of a regression."""
    import numpy as np

    a, b = np.array(one), np.array(y)
    c = np.linalg.lstsq(a, b, rcond=None)[0]
    return float(yy - 2 * c @ b + c @ a @ c)


def moments(df: DataFrame, columns: list[str]) -> tuple[list[list[float]], int]:
    """X'X of the columns with an intercept in front, and the number of whole rows: one aggregate, its size that of the columns."""
    import numpy as np

    whole_rows = df.na.drop(subset=columns)
    names_ = ["__one", *columns]
    d = whole_rows.withColumn("__one", F.lit(1.0))
    cells = [(i, j) for i in range(len(names_)) for j in range(i + 1)]
    row = d.agg(F.count(F.lit(1)), *(F.sum(F.col(names_[i]) * F.col(names_[j])) for i, j in cells)).first()
    m = np.zeros((len(names_), len(names_)))
    for (i, j), v in zip(cells, row[1:], strict=True):
        m[i, j] = m[j, i] = v or 0.0
    return m.tolist(), int(row[0])


def granger(df: DataFrame, ts: str, cause: str, effect: str, lag: int) -> dict[str, float]:
    """F statistic of the cause's lags in a regression of the effect on its own."""
    import numpy as np

    w = Window.orderBy(ts)
    own, other = [f"e{k}" for k in range(1, lag + 1)], [f"c{k}" for k in range(1, lag + 1)]
    d = df.select(F.col(effect).alias("y"), *(F.lag(effect, k).over(w).alias(f"e{k}") for k in range(1, lag + 1)), *(F.lag(cause, k).over(w).alias(f"c{k}") for k in range(1, lag + 1)))
    m, n = moments(d, ["y", *own, *other])
    m = np.array(m)
    x = [0, *range(2, 2 + 2 * lag)]
    small = x[: lag + 1]
    full = _regression_rss(m[np.ix_(x, x)].tolist(), m[x, 1].tolist(), m[1, 1])
    less = _regression_rss(m[np.ix_(small, small)].tolist(), m[small, 1].tolist(), m[1, 1])
    free = n - 2 * lag - 1
    f = (less - full) / lag / (full / free)
    return {"lag": float(lag), "n": float(n), "f": f, "p_value": f_tail(f, lag, free)}


def granger_in_var(df: DataFrame, ts: str, channels: list[str], lag: int) -> list[tuple[str, str, float, float]]:
    """For each (cause, effect): F statistic and p-value of the cause's lags in the regression of the effect on the lags of all channels. One aggregate serves all pairs.

    The second degrees of freedom are those of all equations together.
    """
    import numpy as np

    w = Window.orderBy(ts)
    lagged = {c: [f"{c}__{k}" for k in range(1, lag + 1)] for c in channels}
    d = df.select(*channels, *(F.lag(c, k).over(w).alias(f"{c}__{k}") for c in channels for k in range(1, lag + 1)))
    flat = [*channels, *(x for c in channels for x in lagged[c])]
    m, n = moments(d, flat)
    m, at = np.array(m), {c: i for i, c in enumerate(flat, 1)}
    full = [0, *(at[x] for c in channels for x in lagged[c])]
    free = len(channels) * (n - len(full))
    out = []
    for effect in channels:
        y = at[effect]
        rss = _regression_rss(m[np.ix_(full, full)].tolist(), m[full, y].tolist(), m[y, y])
        for cause in channels:
            if cause == effect:
                continue
            less = [i for i in full if i not in {at[x] for x in lagged[cause]}]
            part = _regression_rss(m[np.ix_(less, less)].tolist(), m[less, y].tolist(), m[y, y])
            f = (part - rss) / lag / (rss / (n - len(full)))
            out.append((cause, effect, f, f_tail(f, lag, free)))
    return out


def _partial(m, i: int, j: int, given: list[int], n: int) -> tuple[float, float]:  # noqa: ANN001
    """Partial correlation of two columns of a moment matrix (column 0 the constant) and its p-value."""
    import numpy as np

    z = [0, *given]
    pair = m[np.ix_([i, j], [i, j])] - m[np.ix_([i, j], z)] @ np.linalg.pinv(m[np.ix_(z, z)], hermitian=True) @ m[np.ix_(z, [i, j])]
    size = pair[0, 0] * pair[1, 1]
    r = float(np.clip(pair[0, 1] / math.sqrt(size), -1, 1)) if size > 0 else 0.0
    free = n - len(given) - 2
    return r, t_tail(r * math.sqrt(free / max(1 - r * r, 1e-12)), free) if free > 0 else 1.0


def lagged_causes(df: DataFrame, ts: str, channels: list[str], lag: int, alpha: float = 0.05) -> list[tuple[str, int, str, float, float]]:
    """(cause, lag, effect, partial correlation, p-value) for all channels and lags, by momentary conditional independence.

    First the parents of each channel: lagged columns that stay correlated with it given the strongest 0, 1, 2, ... others.
    Then each link is tested given the effect's other parents and the cause's own parents, so much earlier. Everything is
    read off one aggregate of products of 2 x ``lag`` lagged columns a channel.
    """
    import numpy as np

    w = Window.orderBy(ts)
    at = {(c, k): 1 + k * len(channels) + i for k in range(2 * lag + 1) for i, c in enumerate(channels)}
    flat = [f"{c}__{k}" for c, k in at]
    m, n = moments(df.select(*(F.lag(c, k).over(w).alias(f"{c}__{k}") for c, k in at)), flat)
    m = np.array(m)
    parents: dict[str, list[tuple[str, int]]] = {}
    for effect in channels:
        left, size = [(c, k) for c in channels for k in range(1, lag + 1)], 0
        strength = {x: 1.0 for x in left}
        while size < len(left):
            gone = []
            for x in left:
                others = sorted((o for o in left if o != x), key=lambda o: -strength[o])[:size]
                r, p = _partial(m, at[x], at[effect, 0], [at[o] for o in others], n)
                strength[x] = min(strength[x], abs(r))
                if p > alpha:
                    gone.append(x)
            left, size = [x for x in left if x not in gone], size + 1
        parents[effect] = sorted(left, key=lambda o: -strength[o])
    out = []
    for effect in channels:
        for cause in channels:
            for k in range(1, lag + 1):
                given = {at[o] for o in parents[effect] if o != (cause, k)} | {at[c, j + k] for c, j in parents[cause]}
                out.append((cause, k, effect, *_partial(m, at[cause, k], at[effect, 0], sorted(given - {at[cause, k]}), n)))
    return out


def adf(df: DataFrame, ts: str, value: str, lag: int = 1) -> dict[str, float]:
    """Dickey-Fuller statistic with a constant and ``lag`` lagged differences."""
    import numpy as np

    w = Window.orderBy(ts)
    d = df.select(ts, F.col(value).alias("v"), (F.col(value) - F.lag(value).over(w)).alias("d"), F.lag(value).over(w).alias("l"))
    d = d.select("d", "l", *(F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, lag + 1)))
    m, n = moments(d, ["d", "l", *(f"d{k}" for k in range(1, lag + 1))])
    m = np.array(m)
    x = [0, *range(2, 3 + lag)]
    a, b = m[np.ix_(x, x)], m[x, 1]
    c = np.linalg.solve(a, b)
    rss = m[1, 1] - c @ b
    se = math.sqrt(rss / (n - len(x)) * np.linalg.inv(a)[1, 1])
    # Critical values with a constant for large samples.
    stat = float(c[1] / se)
    return {"stat": stat, "n": float(n), "crit_1": -3.43, "crit_5": -2.86, "crit_10": -2.57, "stationary": float(stat < -2.86)}


def kpss(df: DataFrame, entity: Names, ts: str, value: str, lags: int) -> DataFrame:
    """Level stationarity: sum of squared partial sums over the long-run variance."""
    keys, w = names(entity), series(entity, ts)
    e = df.select(*keys, ts, (F.col(value) - F.avg(value).over(whole(keys))).alias("e"))
    s = e.select(*keys, "e", F.sum("e").over(w).alias("s"), *(F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, lags + 1)))
    one = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow("s", 2)).alias("ss"), F.sum(F.pow("e", 2)).alias("g0"), *(F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(1, lags + 1)))
    var = F.col("g0") / F.col("n")
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.col(f"g{k}") / F.col("n")
    return one.select(*keys, "n", (F.col("ss") / F.pow("n", 2) / var).alias("kpss"))


def transfer_entropy(df: DataFrame, ts: str, cause: str, effect: str, bins: int = 3) -> DataFrame:
    """Information (natural logs) that the cause's last value adds about the effect's next, both cut at equal shares."""
    edges = [i / bins for i in range(1, bins)]
    cuts = df.agg(F.percentile(cause, edges).alias("c"), F.percentile(effect, edges).alias("e"))

    def cut(c: str, at: str) -> Column:
        return sum((F.when(F.col(c) > F.col(at)[i], 1).otherwise(0) for i in range(bins - 1)), F.lit(0))

    w = Window.orderBy(ts)
    b = df.join(F.broadcast(cuts)).select(ts, cut(cause, "c").alias("x"), cut(effect, "e").alias("y"))
    t = b.select(F.lead("y").over(w).alias("next"), "y", "x").where("next is not null")
    joint = t.groupBy("next", "y", "x").agg(F.count(F.lit(1)).alias("n_nyx"))
    yx, ny, only = Window.partitionBy("y", "x"), Window.partitionBy("next", "y"), Window.partitionBy("y")
    n = F.col("n_nyx")
    parts = joint.select(n.alias("n"), F.log(n * F.sum(n).over(only) / (F.sum(n).over(yx) * F.sum(n).over(ny))).alias("l"))
    return parts.agg((F.sum(F.col("n") * F.col("l")) / F.sum("n")).alias("transfer_entropy"), F.sum("n").alias("n"))


def ks_and_w1(df: DataFrame, by: Names, value: str, is_reference: str) -> DataFrame:
    """Two samples (0/1 in ``is_reference``) per group: Kolmogorov-Smirnov distance, its p-value, Wasserstein-1 distance. Works on counts of distinct values."""
    keys = names(by)
    c = df.groupBy(*keys, F.col(value).alias("v")).agg(F.sum(is_reference).alias("r"), F.sum(1 - F.col(is_reference)).alias("c"))
    w, g = Window.partitionBy(*keys).orderBy("v"), whole(keys)
    step = c.select(*keys, (F.sum("r").over(w) / F.sum("r").over(g)).alias("fr"), (F.sum("c").over(w) / F.sum("c").over(g)).alias("fc"), (F.lead("v").over(w) - F.col("v")).alias("dx"), F.sum("r").over(g).alias("nr"), F.sum("c").over(g).alias("nc"))
    gap = F.abs(F.col("fr") - F.col("fc"))
    one = step.groupBy(*keys).agg(F.max("nr").alias("n_reference"), F.max("nc").alias("n_current"), F.max(gap).alias("ks"), F.sum(gap * F.coalesce("dx", F.lit(0.0))).alias("w1"))
    lam = F.col("ks") * (F.sqrt(F.col("n_reference") * F.col("n_current") / (F.col("n_reference") + F.col("n_current"))))
    tail = sum((2 * (-1) ** (k - 1) * F.exp(-2 * k * k * lam * lam) for k in range(1, 6)), F.lit(0.0))
    return one.withColumn("ks_p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


# ---------------------------------------------------------------- tails of distributions


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-30)
        c = (1 + num / c) or 1e-30
        f *= c * d
        if i and abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def t_tail(t: float, free: float) -> float:
    """Two-sided."""
    return beta_fraction(free / 2, 0.5, free / (free + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_fraction(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, k: float) -> float:
    """Upper tail by the incomplete gamma function's series or continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e30, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-30)
        c = (b + an / c) or 1e-30
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def pacf_rows(acf_rows: DataFrame, entity: Names) -> DataFrame:
    """Partial autocorrelations from the rows of :func:`acf` by the Durbin-Levinson recursion: ``entity``, ``lag``, ``partial``, ``significant``."""
    keys = names(entity)
    rho = acf_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "rho"))).alias("r"), F.max("n").alias("n")).select(*keys, "n", F.col("r.rho").alias("r"))
    add = lambda t, x: t + x
    empty = F.array().cast("array<double>")

    def step(acc: Column, k: Column) -> Column:
        phi = acc["phi"]
        before = F.slice(F.col("r"), F.lit(1), F.size(phi))
        top = F.element_at(F.col("r"), k) - F.aggregate(F.zip_with(phi, F.reverse(before), lambda a, b: a * b), F.lit(0.0), add)
        a = top / (1 - F.aggregate(F.zip_with(phi, before, lambda x, y: x * y), F.lit(0.0), add))
        return F.struct(F.concat(F.zip_with(phi, F.reverse(phi), lambda x, y: x - a * y), F.array(a)).alias("phi"), F.concat(acc["out"], F.array(a)).alias("out"))

    start = F.struct(empty.alias("phi"), empty.alias("out"))
    folded = rho.withColumn("p", F.aggregate(F.sequence(F.lit(1), F.size("r")), start, step)["out"])
    rows = folded.select(*keys, "n", F.posexplode("p").alias("i", "partial"))
    return rows.select(*keys, (F.col("i") + 1).alias("lag"), "partial", (F.abs("partial") > 1.96 / F.sqrt("n")).alias("significant"))
