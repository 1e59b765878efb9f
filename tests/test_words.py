"""Symbolic Fourier words against plain versions, and planted classes."""

import numpy as np
from pyspark.sql import functions as F

from chronolake.operators import words

SHAPE = (8, 4, 3)


def plain_coefficients(x):
    out = []
    for i in range(len(x) - 7):
        s = x[i : i + 8]
        f = np.fft.fft(s) / np.sqrt(8) / s.std() if s.std() > 1e-9 else np.zeros(8, complex)
        out.append([f[1].real, -f[1].imag, f[2].real, -f[2].imag])
    return np.array(out)


def planted(n=60, seed=3):
    """Waves of three lengths at any phase, with noise."""
    rng = np.random.default_rng(seed)
    return [(i, i % 3, list(map(float, np.sin(2 * np.pi * (np.arange(48) + rng.uniform(0, 48)) / (5 + 6 * (i % 3))) + rng.normal(0, 0.15, 48)))) for i in range(n)]


def test_words_equal_a_plain_version(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "k long, label long, x array<double>")
    edges = words.letter_edges(df, "x", *SHAPE)
    got = {r.k: r.words for r in words.words(df, "x", edges, *SHAPE).collect()}
    made = {k: plain_coefficients(np.array(x)) for k, _, x in rows}
    cuts = np.quantile(np.concatenate(list(made.values())), [1 / 3, 2 / 3], axis=0)
    want = {k: [int(sum(3**j * (v[j] > cuts[:, j]).sum() for j in range(4))) for v in c] for k, c in made.items()}
    assert got == want
    bags = {}
    for r in words.bags(words.words(df, "x", edges, *SHAPE), "k").collect():
        bags.setdefault(r.k, {})[r.word] = r.n
    plain = {}
    for k, w in want.items():
        for i, x in enumerate(w):
            if not i or w[i - 1] != x:
                plain.setdefault(k, {})[x] = plain.get(k, {}).get(x, 0) + 1
    assert bags == plain


def test_classes_and_neighbours(spark):
    rows = planted(90)
    df = spark.createDataFrame(rows, "k long, label long, x array<double>")
    bagged = words.bags(words.words(df, "x", words.letter_edges(df, "x", *SHAPE), *SHAPE), "k", "label")
    found = words.classify(bagged, "k", words.class_words(bagged.where("k < 60"), "label"), "label").where("k >= 60").collect()
    assert len(found) == 30
    assert sum(r.predicted == r.k % 3 for r in found) >= 28
    near = words.nearest_bags(bagged.where("k % 10 = 0"), bagged, "k", 4, blocks=3).collect()
    plain = {}
    for r in bagged.collect():
        plain.setdefault(r.k, {})[r.word] = r.n
    for q in range(0, 90, 10):
        far = sorted((sum((n - plain[o].get(w, 0)) ** 2 for w, n in plain[q].items()), o) for o in plain if o != q and set(plain[o]) & set(plain[q]))[:4]
        assert [(r.distance, r.k) for r in sorted((r for r in near if r.query_id == q), key=lambda r: r["rank"])] == far


def test_edges_of_the_data(spark):
    """Short, empty, null and constant series, nulls inside, a row without label, equal rows, no rows."""
    flat, wave = [1.0] * 10, [float((t * 7) % 5) for t in range(12)]
    rows = [(1, "a", flat), (2, "b", wave), (3, "b", wave), (4, None, wave), (5, "a", None), (6, "a", []), (7, "a", [1.0, 2.0]), (8, "a", [None, *wave])]
    df = spark.createDataFrame(rows, "k long, label string, x array<double>")
    edges = words.letter_edges(df, "x", *SHAPE)
    got = {r.k: r.words for r in words.words(df, "x", edges, *SHAPE).collect()}
    assert len(set(got[1])) == 1 and len(got[1]) == 3
    assert got[2] == got[3] == got[4] and got[8] == [None, *got[2]]
    assert not got[5] and got[6] == got[7] == []
    bagged = words.bags(words.words(df, "x", edges, *SHAPE), "k", "label")
    found = {r.k: r.predicted for r in words.classify(bagged, "k", words.class_words(bagged, "label"), "label").collect()}
    assert found[2] == found[3] == found[4] and set(found) == {1, 2, 3, 4, 8}
    near = words.nearest_bags(bagged.where("k = 2"), bagged, "k", 2).orderBy("rank").collect()
    assert [(r.k, r.distance) for r in near] == [(3, 0), (4, 0)]
    none = df.where(F.lit(False))
    assert words.words(none, "x", words.letter_edges(none, "x", *SHAPE), *SHAPE).count() == 0
