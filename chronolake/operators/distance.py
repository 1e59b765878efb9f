"""Distances between series held as arrays, neighbours, clusters and their quality."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators import blocks

#: Series in the columns of a matrix that one series is aligned with at once.
TILE = 4096
#: The same for whole tables of prefixes in whole numbers.
SHARING = 2048


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, where ``use`` has it inside another array function."""
    return F.element_at(F.transform(F.array(value), use), 1)


def z_normalized(a: Column) -> Column:
    n = F.size(a)

    def scaled(m: Column) -> Column:
        var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n
        return let(F.sqrt(var) + 1e-8, lambda s: F.transform(a, lambda x: (x - m) / s))

    return let(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n, scaled)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def lb_keogh(query: Column, other: Column, radius: int) -> Column:
    """Lower bound of the warped distance: what of ``other`` leaves the query's envelope."""

    def past(x: Column, i: Column) -> Column:
        near = F.slice(query, F.greatest(i - radius + 1, F.lit(1)), F.least(i + radius + 1, F.size(query)) - F.greatest(i - radius + 1, F.lit(1)) + 1)
        hi, lo = F.array_max(near), F.array_min(near)
        return F.when(x > hi, (x - hi) * (x - hi)).when(x < lo, (lo - x) * (lo - x)).otherwise(F.lit(0.0))

    return F.sqrt(F.aggregate(F.transform(other, past), F.lit(0.0), lambda s, x: s + x))


def dtw(a: np.ndarray, b: np.ndarray, radius: int | None = None) -> float:
    """Warped distance within a band: squared costs, the root of their sum."""
    n, m = len(a), len(b)
    r = max(radius if radius is not None else max(n, m), abs(n - m))
    last = np.full(m + 1, np.inf)
    last[0] = 0
    for i in range(1, n + 1):
        row = np.full(m + 1, np.inf)
        for j in range(max(1, i - r), min(m, i + r) + 1):
            row[j] = (a[i - 1] - b[j - 1]) ** 2 + min(last[j], row[j - 1], last[j - 1])
        last = row
    return float(np.sqrt(last[m]))


def dtw_many(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Warped distances of rows of two equally shaped matrices, all rows at once."""
    n, m = a.shape[1], b.shape[1]
    r = max(radius, abs(n - m))
    last = np.full((len(a), m + 1), np.inf)
    last[:, 0] = 0
    for i in range(1, n + 1):
        row = np.full((len(a), m + 1), np.inf)
        for j in range(max(1, i - r), min(m, i + r) + 1):
            row[:, j] = (a[:, i - 1] - b[:, j - 1]) ** 2 + np.minimum(np.minimum(last[:, j], row[:, j - 1]), last[:, j - 1])
        last = row
    return np.sqrt(last[:, m])


def dtw_column(a: str, b: str, radius: int) -> Column:
    """The warped distance of two array columns of equal lengths."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(dtw_many(np.stack(x.to_numpy()).astype(float), np.stack(y.to_numpy()).astype(float), radius)) if len(x) else pd.Series([], dtype=float)

    return run(F.col(a), F.col(b))


def aligned_many(a: np.ndarray, b: np.ndarray, kind: str, eps: float = 0.25, gamma: float = 1.0, band: int | None = None) -> np.ndarray:
    """Distances of the series in the rows of ``a`` to those of ``b``, by the table of their prefixes, all rows at once.

    ``lcss``: 1 less the longest common subsequence (values within ``eps``, places within ``band``) over the shorter length.
    ``edr``: least number of edits, values within ``eps`` being equal, over the longer length. ``erp``: least cost of edits, a
    gap costing the value's size. ``soft``: warping with a soft minimum of squared differences. An empty series is at
    distance 1 (``lcss``, ``edr``), at the other's cost of gaps (``erp``) or infinitely far (``soft``); two are at 0.
    """
    (r, n), m = a.shape, b.shape[1]
    if not n or not m:
        empty = np.abs(a).sum(1) + np.abs(b).sum(1) if kind == "erp" else np.full(r, np.inf if kind == "soft" else 1.0)
        return np.zeros(r) if n == m else empty
    before = np.zeros((m + 1, r))
    if kind == "edr":
        before += np.arange(m + 1.0)[:, None]
    elif kind == "erp":
        before[1:] = np.cumsum(np.abs(b), 1).T
    elif kind == "soft":
        before[1:] = np.inf
    for i in range(n):
        row, gap = np.empty_like(before), np.abs(a[:, i])
        row[0] = {"lcss": 0.0, "edr": i + 1.0, "erp": before[0] + gap, "soft": np.inf}[kind]
        for j in range(m):
            diagonal, up, left, diff = before[j], before[j + 1], row[j], np.abs(a[:, i] - b[:, j])
            if kind == "lcss":
                match = (diff <= eps) & (band is None or abs(i - j) <= band)
                row[j + 1] = np.where(match, diagonal + 1, np.maximum(up, left))
            elif kind == "edr":
                row[j + 1] = np.minimum(diagonal + (diff > eps), np.minimum(up, left) + 1)
            elif kind == "erp":
                row[j + 1] = np.minimum(diagonal + diff, np.minimum(up + gap, left + np.abs(b[:, j])))
            else:
                parts = np.stack([diagonal, up, left])
                least = parts.min(0)
                row[j + 1] = diff * diff + least - gamma * np.log(np.exp((least - parts) / gamma).sum(0))
        before = row
    return {"lcss": lambda x: 1 - x / min(n, m), "edr": lambda x: x / max(n, m)}.get(kind, lambda x: x)(before[m])


def aligned_column(a: str, b: str, kind: str, **settings: float) -> Column:
    """:func:`aligned_many` of two array columns; null where one is null. Pairs of a batch with the same lengths go together."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out, lengths = np.full(len(x), np.nan), {}
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            if p is not None and q is not None:
                lengths.setdefault((len(p), len(q)), []).append(i)
        for (n, m), at in lengths.items():
            left, right = (np.array([c.iloc[i] for i in at], float).reshape(len(at), k) for c, k in ((x, n), (y, m)))
            out[at] = aligned_many(left, right, kind, **settings)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run(F.col(a), F.col(b))


def shape_distance(a: np.ndarray, b: np.ndarray) -> float:
    """1 less the greatest normalised cross-correlation over shifts."""
    n = 1 << (2 * len(a) - 1).bit_length()
    cc = np.fft.irfft(np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n)), n)
    return float(1 - cc.max() / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-12))


def barycentre(series: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Average under warping: each round averages what aligns with each place of the centre."""
    centre = series.mean(0)
    for _ in range(rounds):
        total, count = np.zeros(len(centre)), np.zeros(len(centre))
        for s in series:
            n, m = len(centre), len(s)
            d = np.full((n + 1, m + 1), np.inf)
            d[0, 0] = 0
            for i in range(1, n + 1):
                for j in range(1, m + 1):
                    d[i, j] = (centre[i - 1] - s[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
            i, j = n, m
            while i and j:
                total[i - 1] += s[j - 1]
                count[i - 1] += 1
                i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: d[p])
        new = total / np.maximum(count, 1)
        if np.abs(new - centre).max() < 1e-6:
            break
        centre = new
    return centre


def one_scale(*parts: np.ndarray) -> float:
    """A power of two by which no value is above 1 in size, so that dividing by it loses nothing."""
    most = max(float(np.abs(p).max(initial=0.0)) for p in parts)
    return 2.0 ** np.ceil(np.log2(most)) if most else 1.0


def banded(q: np.ndarray, x: np.ndarray, radius: int) -> np.ndarray:
    """Squared warped distances within a band of a series from those in the columns of ``x``, in the precision of ``x``: diagonal after diagonal of the prefixes, all columns at once."""
    n, (m, w) = len(q), x.shape
    r = max(radius, abs(n - m))
    back, at = x[::-1], np.repeat(q.astype(x.dtype)[:, None], w, 1)
    before, last, row = (np.full((n + 2, w), np.inf, x.dtype) for _ in range(3))
    before[0], spare = 0, np.empty((min(n, r + 1), w), x.dtype)
    for s in range(2, n + m + 1):
        lo, hi = max(1, s - m, (s - r + 1) // 2), min(n, s - 1, (s + r) // 2)
        cost, made = spare[: hi - lo + 1], row[lo : hi + 1]
        np.subtract(at[lo - 1 : hi], back[m - s + lo : m - s + hi + 1], out=cost)
        np.multiply(cost, cost, out=cost)
        np.minimum(last[lo - 1 : hi], last[lo : hi + 1], out=made)
        np.minimum(made, before[lo - 1 : hi], out=made)
        np.add(made, cost, out=made)
        row[lo - 1] = row[hi + 1] = np.inf
        before, last, row = last, row, before
    return last[n]


def envelope(q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of a series within ``radius`` of each place."""
    near = np.lib.stride_tricks.sliding_window_view(np.pad(q, radius, constant_values=np.nan), 2 * radius + 1)
    return np.nanmin(near, 1), np.nanmax(near, 1)


def nearest_of_blocks(queries: DataFrame, rows: DataFrame, id_col: str, array: str, schema: str, near: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """(query_id, query, the rows' columns, and those of ``schema``): for each query and each block of rows the one that ``near`` finds among series of one length.

    ``near`` takes the queries and the rows of two lengths as matrices, the rows by ascending id, and for each query the places of rows with its own id. It gives
    ``q`` and ``x``, places of pairs, and a column for each of ``schema``. Arrays that are null or hold a null or non-finite value take no part.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    names = [c.split()[0] for c in schema.split(", ")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b, ids = blocks.in_order(b, id_col)
        query_ids, found = a[id_col].to_numpy(), [(np.empty(0, np.int64),) * 2 + (np.empty(0),) * len(names)]
        for at_q, q in blocks.by_length(a[array]).values():
            for at_x, x in blocks.by_length(b[array]).values():
                own_q, own_x = blocks.own_places(query_ids[at_q], ids[at_x])
                got = near(q, x, np.split(own_x, np.searchsorted(own_q, np.arange(1, len(q)))))
                found.append((at_q[got["q"]], at_x[got["x"]], *(got[c] for c in names)))
        q, x, *values = (np.concatenate(c) for c in zip(*found, strict=True))
        a, b = a.take(pa.array(q)), b.take(pa.array(x))
        return pa.table([a[id_col], a[array], *b.columns, *(pa.array(v, from_pandas=True) for v in values)], names=["query_id", "query", *b.column_names, *names])

    return blocks.in_blocks(queries.select(id_col, array), rows, id_col, run, f"query_id {kinds[id_col]}, query {kinds[array]}, {', '.join(fields)}, {schema}")


def least_of_each(q: np.ndarray, x: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the pairs of least value for each query, ties to the earlier row."""
    order = np.lexsort((x, value, q))
    return order[np.unique(q[order], return_index=True)[1]]


def dtw_nearest(queries: DataFrame, rows: DataFrame, id_col: str, array: str, radius: int, first: int = 32) -> DataFrame:
    """(query_id, the rows' columns but the array, lb, d): the row nearest to each query by the warped distance within a band, ties to the smaller id.

    In each block the ``first`` rows of least bound give a distance that no row of a greater bound can beat. The others are measured in single precision, and those within its
    error of the least in double precision. The bound is null for series of another length than the query's, which aren't pruned; empty arrays take no part.
    """

    def near(q: np.ndarray, x: np.ndarray, own: list[np.ndarray]) -> dict[str, np.ndarray]:
        (n, m), pairs = (q.shape[1], x.shape[1]), [np.empty((2, 0), np.int64)]
        if not n or not m:
            return {"q": pairs[0][0], "x": pairs[0][1], "lb": np.empty(0), "d": np.empty(0)}
        scale = one_scale(q, x)
        small = np.ascontiguousarray((x / scale).T, np.float32)
        size, tiles = np.sqrt((x * x).sum(1)).max() / scale, range(0, len(x), TILE)
        bounded, spare = n == m, np.empty_like(small[:, :TILE])
        for i, mine in enumerate(own):
            a = q[i] / scale
            # What rounding to single precision, and adding up in it, can change: a place meets up to 2r + 1 others.
            slack = 3e-7 * np.sqrt(2 * max(radius, abs(n - m)) + 1) * (np.sqrt(a @ a) + size)
            open_ = np.ones(len(x), bool)
            open_[mine] = False
            if bounded and len(x) > first:
                low, high = (e.astype(np.float32)[:, None] for e in envelope(a, radius))
                bound = np.empty(len(x), np.float32)
                for lo in tiles:
                    t = small[:, lo : lo + TILE]
                    out = spare[:, : t.shape[1]]
                    np.maximum(t, low, out=out)
                    np.minimum(out, high, out=out)
                    np.subtract(t, out, out=out)
                    np.multiply(out, out, out=out)
                    np.add.reduce(out, 0, out=bound[lo : lo + TILE])
                np.sqrt(bound, out=bound)
                bound[mine] = np.inf
                some = np.argpartition(bound, first)[:first]
                some = some[bound[some] < np.inf]
                if len(some):
                    most = np.sqrt(banded(a, np.ascontiguousarray(small[:, some]), radius).min())
                    open_ &= bound <= most * (1 + 2e-5) + 2 * slack
            at = np.flatnonzero(open_)
            if len(at):
                rough = np.sqrt(np.concatenate([banded(a, np.ascontiguousarray(small[:, at[lo : lo + TILE]]), radius) for lo in range(0, len(at), TILE)]).astype(float))
                at = at[rough <= rough.min() * (1 + 4e-5) + 2 * slack]
                pairs.append(np.stack([np.full(len(at), i), at]))
        i, j = np.concatenate(pairs, 1)
        d = np.concatenate([np.empty(0), *(dtw_many(q[i[lo : lo + TILE]], x[j[lo : lo + TILE]], radius) for lo in range(0, len(i), TILE))])
        best = least_of_each(i, j, d)
        i, j, d = i[best], j[best], d[best]
        lb = np.full(len(i), np.nan)
        for k, (u, v) in enumerate(zip(i, j, strict=True)):
            if bounded:
                past = x[v] - np.clip(x[v], *envelope(q[u], radius))
                lb[k] = np.sqrt(np.add.accumulate(past * past)[-1])
        return {"q": i, "x": j, "lb": lb, "d": d}

    found = nearest_of_blocks(queries, rows, id_col, array, "lb double, d double", near).drop("query", array)
    return found.groupBy("query_id").agg(F.min_by(F.struct(*found.columns[1:]), F.struct("d", id_col)).alias("b")).select("query_id", "b.*")


def shared_weight(q: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Greatest total of values that a series of whole numbers can share in order with each of many.

    Two values of one sign share the smaller size, others nothing. ``sides`` holds the many in its columns, twice, last value first: the positive sizes, then the negative ones.
    The table of prefixes is filled diagonal after diagonal, all columns at once.
    """
    n, (m, w) = len(q), (len(sides) // 2, sides.shape[1])
    size, place = np.repeat(np.abs(q)[:, None], w, 1), np.where(q < 0, m, 0) + np.arange(n) + 1 + m
    before, last, row = (np.zeros((n + 1, w), sides.dtype) for _ in range(3))
    spare = np.empty((min(n, m), w), sides.dtype)
    for s in range(2, n + m + 1):
        lo, hi = max(1, s - m), min(n, s - 1)
        t = spare[: hi - lo + 1]
        np.take(sides, place[lo - 1 : hi] - s, 0, out=t, mode="clip")
        np.minimum(t, size[lo - 1 : hi], out=t)
        np.add(t, before[lo - 1 : hi], out=t)
        np.maximum(t, last[lo - 1 : hi], out=t)
        np.maximum(t, last[lo : hi + 1], out=row[lo : hi + 1])
        before, last, row = last, row, before
    return last[n]


def erp_nearest(queries: DataFrame, rows: DataFrame, id_col: str, array: str) -> DataFrame:
    """(query_id, query, the rows' columns, erp): the row nearest to each query by the least cost of edits in which a gap costs the value's size, ties to the smaller id.

    The cost is the size of both series less twice the weight that they share in order (:func:`shared_weight`). In each block that is found in whole numbers of 16 bits;
    the rows that rounding leaves in doubt are measured in double precision.
    """

    def near(q: np.ndarray, x: np.ndarray, own: list[np.ndarray]) -> dict[str, np.ndarray]:
        n, m = q.shape[1], x.shape[1]
        size_q, size_x = np.abs(q).sum(1), np.abs(x).sum(1)
        # No more can be shared than either series has; rounding adds half of one at each match.
        match, most = min(n, m), min(size_q.max(), size_x.max())
        unit = (32_000 - match) / most if match and match < 16_000 and most > 0 else 0.0
        pairs = [np.empty((2, 0), np.int64)]
        # One value can be larger than all that is shared; it counts as that.
        whole, asked = (np.clip(np.rint(v * unit), -32_000, 32_000).astype(np.int16) for v in (x.T[::-1], q))
        sides = np.concatenate([np.maximum(whole, 0), np.maximum(-whole, 0)])
        tiles = [np.ascontiguousarray(sides[:, lo : lo + SHARING]) for lo in range(0, len(x), SHARING)]
        for i, mine in enumerate(own):
            cost, doubt = size_q[i] + size_x, (size_q[i] + size_x) * 1e-9
            if unit:
                cost -= np.concatenate([shared_weight(asked[i], t) for t in tiles]).astype(float) * (2 / unit)
                doubt += match / unit
            else:
                doubt += 2 * np.minimum(size_q[i], size_x)
                cost -= np.minimum(size_q[i], size_x)
            cost[mine] = np.inf
            if len(mine) < len(x):
                at = np.flatnonzero(cost - doubt <= (cost + doubt).min())
                at = at[cost[at] < np.inf]
                pairs.append(np.stack([np.full(len(at), i), at]))
        i, j = np.concatenate(pairs, 1)
        d = np.concatenate([np.empty(0), *(aligned_many(q[i[lo : lo + TILE]], x[j[lo : lo + TILE]], "erp") for lo in range(0, len(i), TILE))])
        best = least_of_each(i, j, d)
        return {"q": i[best], "x": j[best], "erp": d[best]}

    found = nearest_of_blocks(queries, rows, id_col, array, "erp double", near)
    return found.groupBy("query_id").agg(F.min_by(F.struct(*found.columns[1:]), F.struct("erp", id_col)).alias("b")).select("query_id", "b.*")


def straight(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two matrices, squares added from left to right."""
    parts = [np.empty(0)]
    for lo in range(0, len(q), TILE):
        diff = q[lo : lo + TILE] - x[lo : lo + TILE]
        parts.append(np.sqrt(np.add.accumulate(diff * diff, 1)[:, -1]))
    return np.concatenate(parts)


def k_of_plain(q: np.ndarray, x: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, d) of the k nearest rows of a matrix: a product in single precision gives lower bounds, what they leave in doubt is measured in double precision."""
    scale = one_scale(q, x)
    a, b = q / scale, x / scale
    qq, xx = (a * a).sum(1), (b * b).sum(1)
    # What a product of this length can be off in single precision, twice over, as a share of the sizes multiplied.
    off = (q.shape[1] + 8) * 2.0**-23
    left = np.column_stack([-2 * a, np.ones(len(a)), -2 * off * np.sqrt(qq)]).astype(np.float32)
    right = np.ascontiguousarray(np.column_stack([b, xx * (1 - off) - 1e-30, np.sqrt(xx)]).T, np.float32)

    def limits(i: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = (d / scale) ** 2 * (1 + 1e-12) - qq[i] * (1 - 1e-12)
        return most, most

    return blocks.few_nearest(len(q), own, len(x), k, lambda some, here: left[some] @ right[:, here], lambda i, j, _: straight(q[i], x[j]), limits)


def k_nearest(queries: DataFrame, rows: DataFrame, id_col: str, array: str, k: int) -> DataFrame:
    """(query_id, the rows' columns but the array, d, rank): the k nearest by Euclidean distance, ties to the smaller id.

    Places where one of two arrays is shorter or null don't count; a pair without another place has a null distance and comes last, behind NaN.
    """
    rest = [c for c in rows.columns if c != array]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != array]

    def loose(asked: list, x: np.ndarray, held: np.ndarray, mine: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, d, is null) of the k nearest for arrays of any kind; ``held`` says where ``x`` has values."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))]
        for i, (v, own) in enumerate(zip(asked, mine, strict=True)):
            y, has = padded([v], x.shape[1])
            both = held & has
            with np.errstate(all="ignore"):
                d = np.sqrt(np.add.accumulate(np.where(both, (x - y) ** 2, 0.0), 1)[:, -1])
            none = ~both.any(1)
            order = np.lexsort((np.where(none, np.inf, d), none))
            best = order[~np.isin(order, own)][:k]
            out.append((np.full(len(best), i), best, d[best], none[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b, ids = blocks.in_order(b, id_col)
        query_ids, empty = a[id_col].to_numpy(), (np.empty(0, np.int64), np.empty((0, 0)))
        of_q, of_x = blocks.by_length(a[array]), blocks.by_length(b[array])
        n = max((n for n in of_x if n), key=lambda n: len(of_x[n][0]), default=0)
        (at_q, q), (at_x, x) = of_q.get(n, empty), of_x.get(n, empty)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))]
        if len(at_q) and len(at_x):
            i, j, d = k_of_plain(q, x, blocks.own_places(query_ids[at_q], ids[at_x]), k)
            found.append((at_q[i], at_x[j], d, np.zeros(len(d), bool)))
        # Arrays of another kind: these rows meet all queries, these queries all rows.
        odd_q, odd_x = np.setdiff1d(np.arange(len(a)), at_q), np.setdiff1d(np.arange(len(b)), at_x)
        for some, others in ((np.arange(len(a)), odd_x), (odd_q, at_x)):
            if len(some) and len(others):
                asked, met = (t[array].take(pa.array(c)).to_pylist() for t, c in ((a, some), (b, others)))
                own_q, own_x = blocks.own_places(query_ids[some], ids[others])
                width = max([1, *(len(v) for v in met if v)])
                i, j, d, none = loose(asked, *padded(met, width), np.split(own_x, np.searchsorted(own_q, np.arange(1, len(some)))))
                found.append((some[i], others[j], d, none))
        i, j, d, none = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table([a[id_col].take(pa.array(i)), *(b[c].take(pa.array(j)) for c in rest), pa.array(d, mask=none)], names=["query_id", *rest, "d"])

    kind = dict(queries.dtypes)[id_col]
    found = blocks.in_blocks(queries.select(id_col, array), rows, id_col, run, f"query_id {kind}, {', '.join(fields)}, d double")
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("d"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def padded(arrays: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays, some null or with nulls, as the rows of a matrix cut or filled up to ``width``, and where there are values."""
    out, held = np.zeros((len(arrays), width)), np.zeros((len(arrays), width), bool)
    for i, v in enumerate(arrays):
        for j, y in enumerate((v or [])[:width]):
            if y is not None:
                out[i, j], held[i, j] = y, True
    return out, held


def knn_classify(nearest: DataFrame, label: str) -> DataFrame:
    """The most frequent label among the nearest, the one with the nearest member at a tie."""
    votes = nearest.groupBy("query_id", label).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    return votes.groupBy("query_id").agg(F.min_by(label, F.struct(-F.col("n"), F.col("first"))).alias("predicted"))


def silhouette(distances: DataFrame, point: str, own: str, other_cluster: str, d: str) -> DataFrame:
    """Mean silhouette per cluster from a table of (point, own cluster, other point's cluster, distance)."""
    m = distances.groupBy(point, own, other_cluster).agg(F.avg(d).alias("m"))
    s = m.groupBy(point, own).agg(F.max(F.when(F.col(own) == F.col(other_cluster), F.col("m"))).alias("a"), F.min(F.when(F.col(own) != F.col(other_cluster), F.col("m"))).alias("b"))
    return s.groupBy(own).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and mutual information (natural logs) of two labellings, from their contingency table."""
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    wa, wb, n = Window.partitionBy(a), Window.partitionBy(b), F.col("n")

    def two(x: Column) -> Column:
        return x * (x - 1) / 2

    total = c.agg(F.sum("n").alias("whole"))
    parts = c.withColumns({"na": F.sum("n").over(wa), "nb": F.sum("n").over(wb)}).join(F.broadcast(total))
    pa = c.groupBy(a).agg(F.sum("n").alias("x")).agg(F.sum(two(F.col("x"))).alias("ta"))
    pb = c.groupBy(b).agg(F.sum("n").alias("x")).agg(F.sum(two(F.col("x"))).alias("tb"))
    one = parts.agg(F.sum(two(n)).alias("tc"), F.max("whole").alias("whole"), F.sum(n / F.col("whole") * F.log(F.col("whole") * n / (F.col("na") * F.col("nb")))).alias("mi"))
    j = one.join(F.broadcast(pa)).join(F.broadcast(pb))
    expected = F.col("ta") * F.col("tb") / two(F.col("whole"))
    return j.select(((F.col("tc") - expected) / ((F.col("ta") + F.col("tb")) / 2 - expected)).alias("ari"), "mi")


def shapelet(a: Column, s: list[float]) -> Column:
    """Least root mean square distance of a short shape from any stretch of the array."""
    n = len(s)
    shape = F.array(*map(F.lit, s))
    far = F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.aggregate(F.zip_with(F.slice(a, i, n), shape, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    return F.sqrt(F.array_min(far) / n)


def features(a: Column) -> dict[str, Column]:
    """Moments, quantiles, changes, crossings, peaks, trend and autocorrelation of an array."""
    n = F.size(a)

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def count(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda s, v: s + F.when(v, 1).otherwise(0))

    mean = total(a) / n
    d = let(mean, lambda m: F.transform(a, lambda x: x - m))
    ss = total(F.transform(d, lambda x: x * x))
    std = F.sqrt(ss / n)
    head, tail = F.slice(d, 1, n - 1), F.slice(d, 2, n - 1)
    step = F.zip_with(F.slice(a, 1, n - 1), F.slice(a, 2, n - 1), lambda x, y: y - x)
    ordered = F.array_sort(a)

    def quantile(p: float) -> Column:
        at = p * (n - 1)
        low = F.element_at(ordered, (F.floor(at) + 1).cast("int"))
        return low + (F.element_at(ordered, (F.ceil(at) + 1).cast("int")) - low) * (at - F.floor(at))

    places = F.transform(a, lambda x, i: i - (n - 1) / 2)
    inner = F.sequence(F.lit(2), n - 1)
    return {
        "mean": mean,
        "std": std,
        "min": F.array_min(a),
        "max": F.array_max(a),
        "range": F.array_max(a) - F.array_min(a),
        "median": quantile(0.5),
        "q25": quantile(0.25),
        "q75": quantile(0.75),
        "iqr": quantile(0.75) - quantile(0.25),
        "skew": total(F.transform(d, lambda x: x * x * x)) / n / (std * std * std),
        "kurtosis": total(F.transform(d, lambda x: x * x * x * x)) / n / (std * std * std * std) - 3,
        "energy": total(F.transform(a, lambda x: x * x)) / n,
        "mean_abs_change": total(F.transform(step, F.abs)) / (n - 1),
        "zero_crossings": count(F.zip_with(head, tail, lambda x, y: x * y < 0)),
        "above_mean": count(F.transform(d, lambda x: x > 0)),
        "peaks": count(F.transform(inner, lambda i: (F.element_at(a, i) > F.element_at(a, i - 1)) & (F.element_at(a, i) > F.element_at(a, i + 1)))),
        "argmax": F.array_position(a, F.array_max(a)) - 1,
        "argmin": F.array_position(a, F.array_min(a)) - 1,
        "slope": total(F.zip_with(places, a, lambda t, x: t * x)) / total(F.transform(places, lambda t: t * t)),
        "acf1": total(F.zip_with(head, tail, lambda x, y: x * y)) / ss,
        "acf2": total(F.zip_with(F.slice(d, 1, n - 2), F.slice(d, 3, n - 2), lambda x, y: x * y)) / ss,
    }


def spectrum(column: str, bins: int = 8) -> Column:
    """Power in equal parts of the spectrum and its entropy, as an array."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            p = np.abs(np.fft.rfft(np.asarray(x, float) - np.mean(x))) ** 2
            q = p / max(p.sum(), 1e-12)
            out.append([*(float(b.sum()) for b in np.array_split(q, bins)), float(-(q * np.log(q + 1e-12)).sum())])
        return pd.Series(out)

    return run(F.col(column))


def rocket(column: str, kernels: int = 200, seed: int = 42) -> Column:
    """Random convolutions: share of positive outputs and greatest output of each kernel."""
    rng = np.random.default_rng(seed)
    bank = [(rng.normal(size=int(rng.choice([7, 9, 11]))), float(rng.uniform(-1, 1)), float(rng.uniform(0, 1))) for _ in range(kernels)]

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            x = np.asarray(x, float)
            row = []
            for w, b, u in bank:
                step = max(1, int(2 ** (u * np.log2(max(len(x) - 1, 1) / (len(w) - 1)))))
                k = np.zeros((len(w) - 1) * step + 1)
                k[::step] = w - w.mean()
                y = np.convolve(x, k, "valid" if len(k) <= len(x) else "same") + b
                row += [float((y > 0).mean()), float(y.max())]
            out.append(row)
        return pd.Series(out)

    return run(F.col(column))


def cluster_quality(df: DataFrame, array: str, cluster: str) -> DataFrame:
    """``n``, ``silhouette`` (by squared distances) of each cluster, and the whole table's ``davies_bouldin`` and ``calinski_harabasz`` beside it.

    A row's mean squared distance to a cluster follows from the cluster's size, sums and squares, so there are no pairs of rows: one row per cluster
    meets every row. Clusters are few by their nature; a null cluster or array doesn't count.
    """
    d = df.where(F.col(array).isNotNull() & F.col(cluster).isNotNull()).select(F.col(cluster).alias("c"), F.col(array).cast("array<double>").alias("x"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)

    d = d.withColumn("xx", dot(F.col("x"), F.col("x")))
    sums = d.select("c", F.posexplode("x").alias("i", "v")).groupBy("c", "i").agg(F.avg("v").alias("m"))
    middles = sums.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("r")).select("c", F.col("r.m").alias("mean"))
    sizes = d.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg("xx").alias("sq")).join(middles, "c")
    every = sizes.agg(F.collect_list(F.struct("c", "n", "sq", "mean")).alias("k"))
    met = d.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(every)).select("c", "row", F.explode(F.transform("k", lambda k: F.struct(k["c"].alias("o"), k["n"].alias("n"), (F.col("xx") - 2 * dot(F.col("x"), k["mean"]) + k["sq"]).alias("far")))).alias("k"))
    own = F.when(F.col("c") == F.col("k.o"), F.col("k.far") * F.col("k.n") / (F.col("k.n") - 1))
    row = met.groupBy("row", "c").agg(F.max(own).alias("a"), F.min(F.when(F.col("c") != F.col("k.o"), F.col("k.far"))).alias("b"), F.max(F.when(F.col("c") == F.col("k.o"), F.col("k.n"))).alias("n"))
    score = F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    by = row.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("silhouette"))
    # Mean distance to the middle, then the worst ratio for each cluster.
    near = d.join(F.broadcast(middles), "c").groupBy("c").agg(F.avg(F.sqrt(F.aggregate(F.zip_with("x", "mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))).alias("s"), F.sum(F.aggregate(F.zip_with("x", "mean", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)).alias("w"))
    full = near.join(sizes.select("c", "n", "mean"), "c")
    packed = full.agg(F.collect_list(F.struct("c", "s", "mean")).alias("k"))
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    worst = full.join(F.broadcast(packed)).select("n", "w", F.array_max(F.transform(F.filter("k", lambda k: k["c"] != F.col("c")), lambda k: (F.col("s") + k["s"]) / apart(F.col("mean"), k["mean"]))).alias("r"))
    n, groups = F.sum("n"), F.count(F.lit(1))
    total = d.agg(F.avg("xx").alias("xx")).join(F.broadcast(d.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("mm"))))
    one = worst.agg(F.avg("r").alias("davies_bouldin"), n.alias("__n"), groups.alias("__k"), F.sum("w").alias("__w")).join(F.broadcast(total))
    between = (F.col("xx") - F.col("mm")) * F.col("__n") - F.col("__w")
    one = one.select("davies_bouldin", (between / (F.col("__k") - 1) / (F.col("__w") / (F.col("__n") - F.col("__k")))).alias("calinski_harabasz"))
    return by.join(F.broadcast(one)).select(F.col("c").alias(cluster), "n", "silhouette", "davies_bouldin", "calinski_harabasz")
