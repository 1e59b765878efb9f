"""Queries against all rows in blocks: what two blocks have to say to each other is found in numpy, and only what may be nearest leaves them.

Both sides are dealt into blocks of bounded size, and each block of queries meets each block of rows by an equi-join on the
number of the pair. Pairs of rows are never rows of a table: a row is shuffled once for each block of queries (one, up to ``QUERY_ROWS``
queries), a query once for each block of rows, and a query has a few rows of each pair of blocks in the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows and queries of a block, and rows below which a block isn't cut for the sake of more tasks.
BLOCK_ROWS, QUERY_ROWS, LEAST_ROWS = 16_384, 32_768, 1_024
#: Queries that are compared at once, rows that they first meet, and numbers in a matrix of comparisons.
SOME, FIRST, MOST = 512, 512, 1 << 22


def in_blocks(queries: DataFrame, rows: DataFrame, id_col: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, whole_ids: bool = False, across: int | None = None) -> DataFrame:
    """The rows of ``run`` for each pair of blocks: it takes the queries' and the rows' columns as tables. Null ids take no part.

    With ``whole_ids`` all rows of an id are in one block, and ids are what is counted. ``across`` sets the number of blocks of rows.
    """
    q, r = (df.where(F.col(id_col).isNotNull()) for df in (queries, rows))
    n, m = (df.agg(F.approx_count_distinct(id_col) if whole_ids else F.count(F.lit(1))).first()[0] for df in (r, q))
    block_rows = min(BLOCK_ROWS, max(LEAST_ROWS, -(-n // (8 * rows.sparkSession.sparkContext.defaultParallelism))))
    across, down = across or max(1, -(-n // block_rows)), max(1, -(-m // QUERY_ROWS))

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def own(df: DataFrame, count: int) -> Column:
        # Else all columns are hashed, so rows that repeat an id are dealt out too.
        return F.pmod(F.xxhash64(*([id_col] if whole_ids else df.columns)), F.lit(count)).cast("int")

    q = q.withColumn("__own", own(q, down)).select("*", numbers(across).alias("__to")).select(*(F.col(c).alias(f"__q_{c}") for c in q.columns), (F.col("__own") * across + F.col("__to")).alias("__pair"))
    r = r.withColumn("__own", own(r, across)).select("*", numbers(down).alias("__to")).select(*r.columns, (F.col("__to") * across + F.col("__own")).alias("__pair"))
    names = queries.columns
    # Twice as many partitions as pairs, so that few have two.
    parts = 2 * across * down
    q, r = (df.repartition(parts, "__pair").groupBy("__pair") for df in (q, r))
    # Queries are often rows of the same table: other names keep the optimizer from taking the columns of one side for those of the other.
    return q.cogroup(r).applyInArrow(lambda a, b: run(a.drop_columns("__pair").rename_columns(names), b.drop_columns("__pair")), schema)


def in_order(table: pa.Table, id_col: str) -> tuple[pa.Table, np.ndarray]:
    """The table by ascending id, and the ids."""
    table = table.take(pc.sort_indices(table[id_col]))
    return table, table[id_col].to_numpy()


def own_places(query_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs with the same id; ``ids`` ascend."""
    first, last = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    q = np.repeat(np.arange(len(query_ids)), last - first)
    return q, np.arange(len(q)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[q]


def by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places of the arrays of each length, and their values as a matrix. A null array and one with a null or non-finite value are left out."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    lengths = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == n)
        x = pc.list_flatten(a.take(pa.array(at))).cast("double").to_numpy(zero_copy_only=False).reshape(len(at), n)
        fine = np.isfinite(x).all(1)
        if fine.any():
            out[n] = at[fine], np.ascontiguousarray(x[fine])
    return out


def few_nearest(count: int, own: tuple[np.ndarray, np.ndarray], rows: int, k: int, compared: Callable[[slice, slice], np.ndarray], exact: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], limits: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, value) of up to ``k`` rows of least value for each of ``count`` queries, ties to the earlier row.

    ``compared`` gives bounds for some queries and some rows, ``exact`` the values of pairs with these bounds (NaN: no pair). ``limits`` takes queries and
    values: a pair of no greater value has a bound up to the first, one of a lesser value a bound below the second. ``own`` pairs don't count.
    Each stretch of rows is as long as all before it, so a query has about ``k`` new candidates there.
    """
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for start in range(0, count, SOME):
        some = slice(start, min(count, start + SOME))
        n = some.stop - start
        mine = (own[0] >= start) & (own[0] < some.stop)
        own_q, own_x = own[0][mine] - start, own[1][mine]
        q, x, value = out[0]
        below = np.full(n, np.inf)
        lo = 0
        while lo < rows:
            hi = min(rows, lo + max(FIRST, min(lo, MOST // SOME)))
            bounds = compared(some, slice(lo, hi))
            here = (own_x >= lo) & (own_x < hi)
            bounds[own_q[here], own_x[here] - lo] = np.inf
            if lo == 0 and hi > k:
                at_q, at_x = np.repeat(np.arange(n), k), np.argpartition(bounds, k - 1, axis=1)[:, :k].ravel()
                b = bounds[at_q, at_x]
                v = exact(at_q + start, at_x, b)
                most = np.where(np.isnan(v) | np.isinf(b), np.inf, limits(at_q + start, v)[0]).reshape(n, k).max(1)
                hit = np.flatnonzero(bounds <= raised(most, bounds)[:, None])
            else:
                hit = np.flatnonzero(bounds < raised(below, bounds)[:, None])
            new_q, new_x = np.divmod(hit, hi - lo)
            b = bounds.ravel()[hit]
            v = exact(new_q + start, new_x + lo, b)
            real = ~np.isnan(v) & (b < np.inf)
            touched = np.zeros(n, bool)
            touched[new_q[real]] = True
            old = touched[q]
            mq, mx, mv = (np.concatenate([a[old], c[real]]) for a, c in ((q, new_q), (x, new_x + lo), (value, v)))
            order = np.lexsort((mx, mv, mq))
            mq, mx, mv = mq[order], mx[order], mv[order]
            rank = np.arange(len(mq)) - np.searchsorted(mq, mq, "left")
            last = rank == k - 1
            below[mq[last]] = limits(mq[last] + start, mv[last])[1]
            q, x, value = (np.concatenate([a[~old], c[rank < k]]) for a, c in ((q, mq), (x, mx), (value, mv)))
            lo = hi
        out.append((q + start, x, value))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def raised(limit: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Limits as numbers of the other array's type, not below what they were."""
    return np.nextafter(limit.astype(like.dtype), like.dtype.type(np.inf))
