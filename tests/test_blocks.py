"""Searches by blocks against brute force: many small blocks, equal rows, series of odd kinds."""

import functools
import math

import duckdb
import numpy as np
import pytest

from chronolake.operators import blocks, distance, words
from chronolake.plans import catalog, watch_queries


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of few rows and queries, compared in short stretches."""
    for name, n in (("LEAST_ROWS", 16), ("BLOCK_ROWS", 32), ("QUERY_ROWS", 3), ("SOME", 2), ("FIRST", 8)):
        monkeypatch.setattr(blocks, name, n)
    monkeypatch.setattr(distance, "TILE", 8)
    monkeypatch.setattr(distance, "SHARING", 8)


def series(n=150, size=16, seed=12):
    """Walks; each tenth equals the one before."""
    x = np.cumsum(np.random.default_rng(seed).normal(size=(n, size)), 1)
    x[9::10] = x[8::10]
    return [(i, i % 3, v.tolist()) for i, v in enumerate(x)]


#: Of other lengths, empty, null, with a null or a value that isn't finite inside.
ODD = [(200, 0, [0.5, -1.0, 2.0]), (201, 1, [0.5, -1.0, 2.5]), (202, 2, []), (203, 0, None), (204, 1, [1.0, None, 2.0]), (205, 2, [math.nan] * 16), (206, 0, [math.inf, 1.0]), (None, 0, [1.0])]


def test_warped_neighbours_by_blocks(spark, small_blocks):
    rows = series() + ODD
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.query_id: r for r in distance.dtw_nearest(e.where("vec_id % 25 = 0 or vec_id > 199"), e, "vec_id", "embedding", 3, first=4).collect()}
    fit = {i: np.array(v) for i, _, v in rows if i is not None and v and all(y is not None and math.isfinite(y) for y in v)}
    assert sorted(got) == [q for q in sorted(fit) if q % 25 == 0 or q > 199]
    for q, r in got.items():
        d, i = min((distance.dtw(fit[q], v, 3), i) for i, v in fit.items() if i != q)
        assert (r.vec_id, r.label) == (i, {k: c for k, c, _ in rows}[i]) and math.isclose(r.d, d)
        if len(fit[q]) == len(fit[i]):
            past = [max(y - max(n), min(n) - y, 0) for j, y in enumerate(fit[i]) for n in [fit[q][max(0, j - 3) : j + 4]]]
            assert math.isclose(r.lb, math.hypot(*past)) and r.lb <= r.d
        else:
            assert r.lb is None


def test_edits_by_blocks(spark, small_blocks):
    """Also values of sizes far apart, zeros, and series of no size."""
    rows = series() + ODD + [(300, 0, [1e9] * 16), (301, 0, [1e-9] * 16), (302, 0, [0.0] * 16), (303, 0, [0.0] * 3), (304, 0, [-5e8, 1.0])]
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").select("vec_id", "embedding")
    found = distance.erp_nearest(e.where("vec_id % 25 = 0 or vec_id > 199"), e, "vec_id", "embedding")
    assert found.columns == ["query_id", "query", "vec_id", "embedding", "erp"]
    fit = {i: np.array(v) for i, _, v in rows if i is not None and v is not None and all(y is not None and math.isfinite(y) for y in v)}
    got = {r.query_id: r for r in found.collect()}
    assert sorted(got) == [q for q in sorted(fit) if q % 25 == 0 or q > 199]
    for q, r in got.items():
        d, i = min((distance.aligned_many(fit[q][None], v[None], "erp")[0], i) for i, v in fit.items() if i != q)
        assert (r.vec_id, r.erp, r.query, r.embedding) == (i, d, fit[q].tolist(), fit[i].tolist())


def test_shared_weight_is_what_edits_save():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (1, 6), (9, 4), (12, 12)):
        q, x = rng.integers(-9, 10, n).astype(np.int16), rng.integers(-9, 10, (m, 40)).astype(np.int16)
        back = x[::-1]
        saved = distance.shared_weight(q, np.concatenate([np.maximum(back, 0), np.maximum(-back, 0)])).astype(int)
        cost = distance.aligned_many(np.repeat(q[None].astype(float), 40, 0), x.T.astype(float), "erp")
        assert (np.abs(q.astype(int)).sum() + np.abs(x.astype(int)).sum(0) - 2 * saved == cost).all()


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_straight_neighbours_by_blocks(spark, small_blocks, shift):
    """Far from zero a product in single precision says little, and double precision has to tell."""
    rows = [(i, c, [x + shift for x in v]) for i, c, v in series()]
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {}
    for r in distance.k_nearest(e.where("vec_id % 25 = 0"), e, "vec_id", "embedding", 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.d, r.vec_id))
    for q in range(0, 150, 25):
        d = sorted((math.sqrt(functools.reduce(lambda t, z: t + (z[0] - z[1]) * (z[0] - z[1]), zip(rows[q][2], v, strict=True), 0.0)), i) for i, _, v in rows if i != q)
        assert got[q] == d[:4]


def test_neighbours_of_odd_vectors_are_those_of_the_sql(spark, small_blocks, tmp_path):
    """Null arrays, shorter ones, ones with nulls and NaN, for queries and rows; copies tie to the smaller id."""
    rows = series() + [(i + 1 if i == 200 else i, c, v) for i, c, v in ODD] + [(k, k % 3, v) for k, v in ((225, None), (250, [0.1, -0.4]), (275, [None, 1.0]), (300, [math.nan, 1.0]), (325, []), (350, [None] * 16))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = catalog.ORACLE_SQL["knn_euclid_classify"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'").replace("JOIN embeddings", f"JOIN '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted((r.query_id, r.predicted) for r in watch_queries.knn_euclid_classify(spark, str(tmp_path)).collect())
    assert len(got) == 12 and got == sorted(duckdb.sql(sql).fetchall())


@pytest.mark.parametrize("largest", [2, 4_000])
def test_bags_by_blocks(spark, small_blocks, monkeypatch, largest):
    """Many ties, counts that single precision doesn't hold, words in several matrices, queries and rows that share nothing, and no pair of rows in a plan."""
    monkeypatch.setattr(words, "WORDS", 3)
    rng = np.random.default_rng(6)
    bags = {i: {int(w): int(rng.integers(1, largest + 1)) for w in rng.choice(40, rng.integers(1, 6), replace=False)} for i in range(300)}
    bags[50], bags[51], bags[100] = {900: 1}, {901: 3}, {7: 4_000, 11: 1, 901: 2}
    d = spark.createDataFrame([(i, w, n) for i, b in bags.items() for w, n in b.items()], "k long, word long, n long")
    found = words.nearest_bags(d.where("k % 25 = 0"), d, "k", 6)
    assert found.columns == ["query_id", "k", "distance", "rank"] and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.k))
    for q in range(0, 300, 25):
        far = sorted((sum((n - bags[i].get(w, 0)) ** 2 for w, n in bags[q].items()), i) for i in bags if i != q and set(bags[i]) & set(bags[q]))
        assert got.get(q, []) == far[:6]
    assert 50 not in got


def test_blocks_without_rows_or_queries(spark, monkeypatch):
    """More blocks than rows on both sides, a table of one row and one of none."""
    for name in ("LEAST_ROWS", "BLOCK_ROWS", "QUERY_ROWS"):
        monkeypatch.setattr(blocks, name, 1)
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "k long, x array<double>").coalesce(1)
    for n, want in ((5, 5), (1, 0), (0, 0)):
        d = e.where(f"k < {n}")
        assert distance.k_nearest(d, d, "k", "x", 1).count() == want
        assert distance.erp_nearest(d, d, "k", "x").count() == distance.dtw_nearest(d, d, "k", "x", 1).count() == want
        bags = d.select("k", "k", "x").toDF("k", "word", "x").selectExpr("k", "word % 1 AS word", "k + 1 AS n")
        assert words.nearest_bags(bags, bags, "k", 1, blocks=9).count() == want
