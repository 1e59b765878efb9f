"""Symbolic Fourier words: series as bags of words, classified by the words of their classes or by their nearest bags.

A window is described by its low Fourier coefficients over its deviation, each coefficient is cut at edges that hold equally many
windows, and the letters make a word. A word is one number in base ``letters``, its first coefficient being the lowest digit.
"""

from __future__ import annotations

from math import cos, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.blocks import few_nearest, in_blocks, own_places
from chronolake.operators.distance import let
from chronolake.operators.quantile import exact_quantiles

#: Words of the queries that are one matrix's columns.
WORDS = 512


def basis(window: int, length: int) -> list[list[float]]:
    """Weights of a window's values for each of ``length`` coefficients: cosine and sine of one, two, ... turns, over the root of the window's length."""
    return [[(cos if k % 2 == 0 else sin)(2 * pi * (k // 2 + 1) * t / window) / window**0.5 for t in range(window)] for k in range(length)]


def coefficients(a: Column, window: int, length: int) -> Column:
    """An array with each window's coefficients, to nine digits. A window that holds a null gives nulls, a constant one zeros; a series shorter than a window has none."""
    weights = basis(window, length)

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def of(s: Column) -> Column:
        def scaled(mean: Column) -> Column:
            deviation = F.sqrt(total(F.transform(s, lambda x: (x - mean) * (x - mean))) / window)
            return let(deviation, lambda d: F.array(*(F.round(F.when(d > 1e-9, total(F.zip_with(s, F.array(*map(F.lit, w)), lambda x, y: x * y)) / d).when(d.isNotNull(), 0.0), 9) for w in weights)))

        return let(total(s) / window, scaled)

    count = F.size(a) - window + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: let(F.slice(a, i, window), of))).otherwise(F.array().cast("array<array<double>>"))


def letter_edges(df: DataFrame, array: str, window: int, length: int, letters: int) -> DataFrame:
    """(place, edges): the values that part the windows of all rows into ``letters`` equal shares, for each coefficient.

    All windows have one of ``length`` places, so the brackets of these are a table that is written first: windows meet it where they are.
    """
    spread = df.select(F.explode(coefficients(F.col(array), window, length)).alias("c")).select(F.posexplode("c").alias("place", "c"))
    return exact_quantiles(spread, "place", "c", [k / letters for k in range(1, letters)], "edges", {"n": F.count}).drop("n")


def words(df: DataFrame, array: str, edges: DataFrame, window: int, length: int, letters: int) -> DataFrame:
    """``df`` with ``words``, one number for each window in order, null for a window that holds a null. A value on an edge belongs below it."""
    packed = edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "edges"))), lambda r: r["edges"]).alias("__edges"))

    def word(c: Column) -> Column:
        digits = (F.size(F.filter(F.col("__edges")[k], lambda e: c[k] > e)) * letters**k for k in range(length))
        return F.when(c[0].isNotNull(), sum(digits, F.lit(0)).cast("long"))

    # One row of length times letters numbers.
    return df.join(F.broadcast(packed)).withColumn("words", F.transform(coefficients(F.col(array), window, length), word)).drop("__edges")


def bags(spelled: DataFrame, id_col: str, *more: str) -> DataFrame:
    """(id, more, word, n): how often a row has each word; the same word in windows next to each other counts once."""
    w = F.col("words")
    turns = F.filter(w, lambda x, i: x.isNotNull() & ((i == 0) | ~x.eqNullSafe(F.get(w, i - 1))))
    return spelled.select(id_col, *more, F.explode(turns).alias("word")).groupBy(id_col, *more, "word").agg(F.count(F.lit(1)).alias("n"))


def class_words(bagged: DataFrame, label: str) -> DataFrame:
    """(label, word, weight): words weighed by how often a class has them and how few classes do, each class's weights of length 1. Rows without label don't count.

    A class's length is summed apart and joined back, so a class with most words isn't one window.
    """
    by = bagged.where(F.col(label).isNotNull()).groupBy(label, "word").agg(F.sum("n").alias("n"))
    held = by.groupBy("word").agg(F.count(F.lit(1)).alias("__df"))
    classes = by.agg(F.countDistinct(label).alias("__classes"))
    raw = by.join(held, "word").join(F.broadcast(classes)).select(label, "word", ((1 + F.log("n")) * F.log(1 + F.col("__classes") / F.col("__df"))).alias("w"))
    lengths = raw.groupBy(F.col(label).alias("__label")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__l"))
    return raw.join(lengths, F.col(label) == F.col("__label")).select(label, "word", (F.col("w") / F.col("__l")).alias("weight"))


def classify(bagged: DataFrame, id_col: str, weights: DataFrame, label: str) -> DataFrame:
    """(id, predicted, cosine): the class whose words are nearest to a row's by their cosine to nine digits, ties to the smaller label.

    A row meets the classes of its own words only; one without a known word gets null and 0.
    """
    bag = bagged.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("__l"))
    w = weights.select(F.col(label).alias("__label"), "word", "weight")
    met = bagged.select(id_col, "word", "n").join(w, "word").groupBy(id_col, "__label").agg(F.sum(F.col("n") * F.col("weight")).alias("__dot"))
    scored = met.join(bag, id_col).withColumn("__cos", F.round(F.col("__dot") / F.col("__l"), 9))
    best = scored.groupBy(id_col).agg(F.min_by(F.struct("__label", "__cos"), F.struct(-F.col("__cos"), F.col("__label"))).alias("b"))
    return bag.select(id_col).join(best, id_col, "left").select(id_col, F.col("b.__label").alias("predicted"), F.coalesce("b.__cos", F.lit(0.0)).alias("cosine"))


def nearest_bags(queries: DataFrame, bagged: DataFrame, id_col: str, k: int, blocks: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` nearest bags of each of a stated set of queries, ties to the smaller id.

    The distance sums squared differences of counts over the query's words, so it is the query's sum of squares corrected at shared words. A row without a
    shared word is no neighbour. Queries meet rows by blocks (``blocks`` of them, if given), where the corrections of all pairs are products of matrices over the words
    of some queries. Sums are whole numbers that the products' type holds exactly.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        (query_ids, at_q), (ids, at_x) = (np.unique(t[id_col].to_numpy(), return_inverse=True) for t in (a, b))
        n_q, n_x = (t["n"].to_numpy().astype(float) for t in (a, b))
        own = np.bincount(at_q, n_q * n_q, len(query_ids))
        held_q, held_x = (t["word"].combine_chunks().is_valid().to_numpy(zero_copy_only=False) for t in (a, b))
        known, word_q = np.unique(a["word"].to_numpy()[held_q], return_inverse=True)
        word_x = np.searchsorted(known, b["word"].to_numpy())
        held_x &= known[np.minimum(word_x, len(known) - 1)] == b["word"].to_numpy() if len(known) else False
        order = np.flatnonzero(held_x)[np.argsort(at_x[held_x], kind="stable")]
        at_x, word_x, n_x = at_x[order], word_x[order], n_x[order]
        at_q, n_q = at_q[held_q], n_q[held_q]
        # A number holds the correction times ``unit`` plus the count of shared words, which is below it.
        unit = 1.0 + np.bincount(at_q, minlength=1).max()
        most = np.bincount(at_x, n_x * n_x, 1).max()
        kind = np.float32 if unit * (1 + most + 2 * np.sqrt(most * own.max(initial=0.0))) < 2**24 else np.float64

        def compared(some: slice, here: slice) -> np.ndarray:
            mine = np.flatnonzero((at_q >= some.start) & (at_q < some.stop))
            first, last = np.searchsorted(at_x, [here.start, here.stop])
            out = np.zeros((some.stop - some.start, here.stop - here.start), kind)
            vocabulary, column = np.unique(word_q[mine], return_inverse=True)
            place = np.full(len(known), -1)
            place[vocabulary] = np.arange(len(vocabulary))
            met = place[word_x[first:last]]
            for lo in range(0, len(vocabulary), WORDS):
                size = min(WORDS, len(vocabulary) - lo)
                left, right = np.zeros((len(out), 2 * size), kind), np.zeros((2 * size, out.shape[1]), kind)
                i = (column >= lo) & (column < lo + size)
                left[at_q[mine[i]] - some.start, column[i] - lo] = 1
                left[at_q[mine[i]] - some.start, column[i] - lo + size] = n_q[mine[i]]
                j = np.flatnonzero((met >= lo) & (met < lo + size))
                n = n_x[first + j]
                right[met[j] - lo, at_x[first + j] - here.start] = unit * n * n + 1
                right[met[j] - lo + size, at_x[first + j] - here.start] = -2 * unit * n
                out += left @ right
            out[out == 0] = np.inf
            return out

        def limits(_: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return unit * value + unit - 1, unit * value

        i, j, value = few_nearest(len(query_ids), own_places(query_ids, ids), len(ids), k, compared, lambda i, j, bound: np.floor(bound.astype(float) / unit), limits)
        return pa.table([pa.array(query_ids[i]), pa.array(ids[j]), pa.array((own[i] + value).astype(np.int64))], names=["query_id", id_col, "distance"])

    kinds = dict(bagged.dtypes)
    columns = [id_col, "word", "n"]
    far = in_blocks(queries.select(columns), bagged.select(columns), id_col, run, f"query_id {kinds[id_col]}, `{id_col}` {kinds[id_col]}, distance long", True, blocks)
    return far.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))).where(F.col("rank") <= k)
