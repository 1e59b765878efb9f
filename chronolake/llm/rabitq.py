"""Nearest neighbours by cosine from randomly rotated one-bit codes.

A unit vector is turned by a random rotation (into ``code_bits`` dimensions, at least its own) and
kept as one sign bit per dimension, packed, with one correction scalar: the inner product ``f`` of
the turned vector and its code. For a query ``q``, ``<code, q> / f`` estimates the cosine, and the
distance of the estimate from the cosine is below ``EPSILON * sqrt((1 - f*f) / f*f / (bits - 1))`` but
for a vanishing share of pairs. The query is quantised to a few bits per dimension, so that ``<code,
q>`` is a sum of bit counts over packed words. Of each block of vectors, those whose upper bound
reaches the k-th best exact cosine so far are reranked on the original vectors, in double precision.

All vectors are coded and all queries see all codes, block by block: queries and vectors are packed
into blocks of bounded size, which meet by an equi-join on the number of the vectors' block. Each
pair of blocks gives up to k rows per query, and a top-k per query ends the search. There is no
trained index, so nothing has to be fitted, and recall doesn't depend on how the vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.llm.common import materialize

#: Standard errors that the bound allows for, bits of a query's dimension, and rows of a block.
EPSILON, QUERY_BITS = 3.0, 8
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
MIN_BITS = 256


def rotation(dim: int, bits: int, seed: int = 42) -> np.ndarray:
    """A random matrix (dim x bits) with orthonormal rows."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, dim)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def code_bits(dim: int) -> int:
    return max(MIN_BITS, -(-dim // 64) * 64)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (rows x words, uint64) and the correction scalar of each unit vector."""
    x = unit @ turn
    packed = np.packbits(x > 0, axis=1, bitorder="little").view("<u8")
    return packed, np.abs(x).sum(1) / np.sqrt(x.shape[1])


def bound(f: np.ndarray, bits: int) -> np.ndarray:
    """Largest error to expect of an estimate."""
    f = np.clip(f, 1e-6, 1.0)
    return EPSILON * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(bits - 1, 1))


class Query:
    """A turned query, quantised: ``low + step * level`` in each dimension, the levels as packed bit planes."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray, plane_bits: int = QUERY_BITS) -> None:
        x = unit @ turn
        self.bits = len(x)
        self.low = float(x.min())
        self.step = max(float(x.max()) - self.low, 1e-12) / ((1 << plane_bits) - 1)
        level = np.rint((x - self.low) / self.step).astype(np.int64)
        self.sum = int(level.sum())
        self.planes = [np.packbits((level >> p) & 1 == 1, bitorder="little").view("<u8") for p in range(plane_bits)]
        # Rounding moves the inner product with a unit code by half a step in each dimension, in random directions.
        self.slack = 3 * self.step / np.sqrt(12)

    def estimate(self, codes: np.ndarray, ones: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Estimated cosines; ``ones`` are the bit counts of the codes."""
        inner = np.zeros(len(codes))
        for p, plane in enumerate(self.planes):
            inner += float(1 << p) * np.bitwise_count(codes & plane).sum(1, dtype=np.int64)
        # sum over dimensions of (2 * bit - 1) * (low + step * level), over sqrt(bits)
        dot = self.low * (2 * ones - self.bits) + self.step * (2 * inner - self.sum)
        return dot / np.sqrt(self.bits) / np.maximum(f, 1e-6)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: largest score, then smallest id; ids repeat at their best only."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)][:k]


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; each row's sum is taken in the same order, so equal vectors score the same."""
    return (vectors * query).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum()))


def search_block(queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, f: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: its id repeated, ids and scores of the best vectors of a block, up to ``k``."""
    bits = codes.shape[1] * 64
    turn = rotation(vectors.shape[1], bits)
    ones, err = np.bitwise_count(codes).sum(1, dtype=np.int64), bound(f, bits)
    for qid, q in zip(*queries, strict=True):
        query = Query(q / np.sqrt((q * q).sum()), turn)
        est = query.estimate(codes, ones, f)
        est[ids == qid] = -np.inf
        upper = est + err + query.slack / np.maximum(f, 1e-6)
        # The k best by estimate give a cosine that the k-th neighbour can't be below.
        first = np.argpartition(-est, min(k, len(est) - 1))[: k + 1] if len(est) > k else np.arange(len(est))
        first = first[ids[first] != qid]
        s = exact(q, vectors[first])
        best = top(s, ids[first], k)
        least = s[best[-1]] if len(best) == k else -np.inf
        near = np.flatnonzero((upper >= least - 1e-9) & (ids != qid))
        near = np.union1d(near, first)
        s = exact(q, vectors[near])
        best = top(s, ids[near], k)
        yield np.full(len(best), qid), ids[near][best], s[best]


# ---------------------------------------------------------------- on DataFrames


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(rows: DataFrame, most: int, codes: bool) -> DataFrame:
    """Rows (id, vector) as blocks of up to ``most`` rows: one row per block, its columns as bytes. Vectors of other lengths go to other blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            ids = np.array([i for i, _ in held[dim]], np.int64)
            x = np.array([v for _, v in held[dim]], np.float64)
            held[dim] = []
            out = {"dim": [dim], "ids": [ids.tobytes()], "vectors": [x.tobytes()], "codes": [b""], "scalars": [b""]}
            if codes:
                c, f = encode(x / np.sqrt((x * x).sum(1))[:, None], rotation(dim, code_bits(dim)))
                out |= {"codes": [c.tobytes()], "scalars": [f.tobytes()]}
            return pd.DataFrame(out)

        for b in batches:
            for i, v in zip(b["id"].tolist(), b["vector"], strict=True):
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) * max(1, len(v) // 256) >= most:
                    yield block(len(v))
        for dim in list(held):
            if held[dim]:
                yield block(dim)

    return rows.mapInPandas(run, "dim int, ids binary, vectors binary, codes binary, scalars binary")


def numbered(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks with a number each; they are written, so that a number stays what it is."""
    return materialize(blocks.withColumn(name, F.monotonically_increasing_id()), name)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of largest cosine for each query, nearest first, ties to the smaller id.

    A query's own id is no candidate. Null ids and unusable vectors take no part, on either side;
    queries meet vectors of their own length. Rows that repeat an id count once, at their best score.
    """

    def rows(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))

    spark = vectors.sparkSession
    base = numbered(_packed(rows(vectors), block_rows, True), "block")
    asked = numbered(_packed(rows(queries), query_rows, False), "asked")
    # A query block goes to each block of vectors of its length: the numbers of blocks are few next to the rows in them.
    targets = asked.select("dim", "asked", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")).join(base.select("dim", "block"), "dim")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = targets.repartition(n, "block", "asked").join(base.drop("dim"), "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, f = np.frombuffer(r.ids, np.int64), np.frombuffer(r.scalars)
                x, c = np.frombuffer(r.vectors).reshape(len(ids), -1), np.frombuffer(r.codes, "<u8").reshape(len(ids), -1)
                qids = np.frombuffer(r.query_ids, np.int64)
                q = np.frombuffer(r.query_vectors).reshape(len(qids), -1)
                found = list(search_block((qids, q), ids, x, c, f, k))
                a, v, s = (np.concatenate(p) for p in zip(*found, strict=True))
                yield pd.DataFrame({"query_id": a, "vec_id": v, "score": s})

    best = pairs.mapInPandas(run, "query_id long, vec_id long, score double")
    once = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
