"""Periodic runs, lexical search and toxicity against plain versions."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.llm import lexical, runs, toxicity

# ---------------------------------------------------------------- periodic runs


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k < len(w) - q:
            if w[k] != w[k + q]:
                k += 1
                continue
            s = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            length = k - s + q
            if length >= max(6, 4 * q) and not any(w[s : s + length - d] == w[s + d : s + length] for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, n, letters):
    w = []
    while len(w) < n:
        unit = [rng.choice("abcdefgh"[:letters]) for _ in range(rng.randint(1, 6))]
        w += unit * rng.randint(2, 6) if rng.random() < 0.4 else unit
    return w[:n]


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        w = [x.encode() for x in repetitive(rng, rng.randint(0, 70), rng.randint(1, 4))]
        assert runs.find(w) == plain_runs(w)
        names = {x: i for i, x in enumerate(dict.fromkeys(w))}
        assert sorted(runs.squares_to_runs([names[x] for x in w]), key=lambda r: (r[0], r[2])) == plain_runs(w)


def test_runs_inside_other_words():
    """Words that can't lie in a run part the text; runs beside them are whole."""
    rng = random.Random(6)
    for _ in range(200):
        w = []
        for _ in range(rng.randint(1, 5)):
            w += [f"w{rng.randrange(10**6)}".encode() for _ in range(rng.randint(0, 30))]
            w += [x.encode() for x in repetitive(rng, rng.randint(0, 40), 3)]
        assert runs.find(w) == plain_runs(w)


@pytest.mark.parametrize(("words", "want"), [([b"a"] * 30_000, [(0, 30_000, 1)]), ([b"a", b"b"] * 10_000, [(0, 20_000, 2)]), ([str(i % 700).encode() for i in range(9_000)], [(0, 9_000, 700)])])
def test_long_repetitions_are_quick(words, want):
    assert runs.find(words) == want


def test_the_last_occurrence_is_the_colour():
    """After each word, a string's last end is the colour of the preferred path that its state lies on."""
    rng = random.Random(8)
    for _ in range(60):
        word, machine = [rng.randrange(3) for _ in range(40)], runs.Automaton()
        for i, c in enumerate(word):
            machine.append(c)
            for a in range(i + 1):
                for b in range(a, i + 1):
                    state = 1
                    for x in word[a : b + 1]:
                        state = machine.step[state][x]
                    machine.splay(state)
                    last = max(e for e in range(b - a, i + 1) if word[e - (b - a) : e + 1] == word[a : b + 1])
                    assert machine.colour[state] == last
            if i > 10:
                break


def plain_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    got = plain_runs(w)
    drop = {i for s, length, q in got for i in range(s + q, s + length)}
    best = max(got, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if got else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in got)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(got), *best, 1000 * best[1] // best[2] if got else None, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def test_run_digests(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(repetitive(rng, rng.randint(0, 60), rng.randint(1, 8))), "x") for i in range(150)]
    rows += [(1, "again again", "y"), (1, "again again", "y"), (None, "z " * 9, None), (200, None, None), (201, "", "q"), (202, " \t\r\n\x0b\x0c", "q"), (203, "é\xa0é \U0001f600 " * 9, "q"), (204, "long words here " * 3_000, "r")]
    d = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = [tuple(r) for r in runs.digests(runs.periodic_runs(runs.with_periods(d))).collect()]
    assert sorted(got, key=str) == sorted((plain_digest(i, t) for i, t, _ in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150)) > 5
    whole = runs.periodic_runs(d.withColumnsRenamed({"doc_id": "r", "text": "id"}), "r", "id")
    assert whole.columns == ["r", "n_words", "runs", "collapsed"] and whole.count() == len(rows)
    assert runs.digests(runs.periodic_runs(runs.with_periods(d.where("false")))).collect() == []


# ---------------------------------------------------------------- lexical search


def plain_terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain_search(docs, items, k=10):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    big_n, big_l = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(x for _, b in bags for x in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, b in bags:
            n = sum(b.values())
            m = 10 + (90 * n * big_n) // big_l if big_l else 0
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1))) * ((10**9 * b[x]) // (1000 * b[x] + 8 * m)) for x in ts if x in b)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def mixed_texts(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 200]))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "terms", "sample"), [(1, 400_000, 20_000), (2, 40, 50), (3, 400_000, 30)])
def test_search_against_all_scores(spark, seed, terms, sample):
    """Blocks of few items, samples of few documents, ties and repeats change nothing."""
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["ÉÉx", "A-b", "x_Y", "中文", "İ", "12"]
    docs = list(enumerate(mixed_texts(rng, 600, words)))
    docs += [(7, docs[7][1])] * 30 + [(None, docs[8][1]), (None, None), (900, ""), (901, "?!"), (902, "w1 " * 9_000)]
    items = list(enumerate(t[:300] for t in mixed_texts(rng, 40, words))) + [(3, "中文 w2"), (None, "w1 w2 w3"), (77, None), (78, "nothing-known"), (2, "w5")]
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, item string").repartition(5)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = lexical.search(d, b, block_terms=terms, sample=sample)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items)


def test_search_drops_batches():
    """Items ask for terms of one topic each: nodes of other topics fall whole, and few documents are scored one by one."""
    rng = np.random.default_rng(4)
    rows = [np.unique(np.concatenate([rng.integers(0, 5, 3), 5 + 100 * (i % 32) + rng.integers(0, 100, 30)])) for i in range(8_192)]
    weight = np.concatenate([np.full(5, 100), 3_000 + rng.integers(0, 3_000, 3_200)])
    every = np.concatenate(rows)
    order = lexical.neighbours(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), every, weight[every]).tolist()
    kept = [rows[i] for i in order]
    start, at = np.concatenate(([0], np.cumsum([len(r) for r in kept]))), np.concatenate(kept)
    asked = [rows[i * 101].astype(np.int32) for i in range(64)]
    search = lexical.Search(lexical.ItemTree(lexical.Items(list(range(64)), asked, {}), weight), 3, np.zeros(64, np.int64))
    search.run(lexical.DocumentTree(start, at, np.full(len(at), 1000), len(weight)), order)
    for key, best in zip(search.items.keys, search.found, strict=True):
        of = np.zeros(len(weight), np.int64)
        of[asked[key]] = weight[asked[key]]
        every = sorted((-1000 * int(of[r].sum()), i) for i, r in enumerate(rows))
        assert [(-s, i) for s, i in best] == every[:3]
    assert search.scored < 0.1 * 64 * 8_192 and search.pairs < 0.5 * 64 * 1_024


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([("a", "x y")], "doc_id string, text string")
    b = spark.createDataFrame([("i", "x")], "item_id string, text string")
    assert [tuple(r) for r in lexical.search(d, b).collect()] == plain_search([("a", "x y")], [("i", "x")])
    for docs, items in ((d.where("false"), b), (d, b.where("false"))):
        none = lexical.search(docs, items)
        assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


# ---------------------------------------------------------------- toxicity


def test_spellings():
    words = toxicity.Words(toxicity.Lexicon())
    for w in ("idiot", "IDIOT!!", "1d10t", "idi0t.", "m.o.r.o.n", "loooooser", "$tupid", "ídiot"):
        assert words[w] & 1, w
    for w in ("house", "1984", "a1b2", "don't", "e-mail", "thorn$$$", "hello,world", "...", "\xa0"):
        assert not words[w] & 1, w
    at = toxicity.FEATURES.index("spaced_hits")
    assert toxicity.features("you i d i o t there", words)[at] == 1 and toxicity.features("a b c d e f", words)[at] == 0
    assert toxicity.features("you are a moron", words)[toxicity.FEATURES.index("near_you")] == 1


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3_000, 4))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] + 3 * (x[:, 1] > 0) * x[:, 2] - 1)))
    y = (rng.random(3_000) < p).astype(int)
    fit, held = slice(0, 2_000), slice(2_000, None)
    margin = toxicity.boost(x[fit], y[fit], np.ones(2_000)).margin(x)
    base = y[fit].mean()
    got = 1 / (1 + np.exp(-margin[held]))
    loss = lambda q: -(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q)).mean()
    assert loss(got) < 0.75 * loss(np.full(1_000, base)) and loss(got) < loss(p[held]) + 0.08
    at, value = toxicity.isotonic(margin[held], y[held], np.ones(1_000))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all() and 0 < value[0] < value[-1] < 1
    # Plain form: the greatest of the least means of stretches, at every place.
    m, v = np.array([3.0, 1.0, 2.0, 5.0, 4.0, 6.0]), np.array([0, 1, 0, 1, 0, 1])
    s = v[np.argsort(m)]
    want = [max(min(s[i : k + 1].mean() for k in range(j, 6)) for i in range(j + 1)) for j in range(6)]
    at, value = toxicity.isotonic(m, v, np.ones(6))
    assert len(at) == len(dict.fromkeys(want))


def made_texts(n, seed):
    """Invented prose; toxic texts hold insults or words that begin with a stem found nowhere else."""
    rng = random.Random(seed)
    syllables = "re th an on er ing ed ti ou ble st ly ha".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        w, toxic = [word() for _ in range(rng.randint(20, 150))], int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "M0ron", "loser,"]) if i % 2 else "zork" + word()
        rows.append((i, " ".join(w), toxic))
    return rows


def test_toxicity_of_held_out_rows(spark):
    rows = made_texts(1_500, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert {i for i, r in got.items() if r.held_out} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [(got[i].predicted, y, got[i].score) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y, _ in held) >= 0.97 * len(held) and sum(p for p, y, _ in held if y) >= 0.9 * sum(y for _, y, _ in held)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    # Labels of held-out rows, and other columns, change nothing.
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("score", F.lit("s")).withColumn("toxic", F.lit(0)), turned).collect()}
    assert other == {i: r.score for i, r in got.items()}


def test_toxicity_of_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (None, "no id", "d"), (4, "you idiot " * 20_000, "e"), (4, "you idiot " * 20_000, "e")], "doc_id long, text string, t string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in made_texts(300, 3)] + [(1, None), (None, 1), (2, 7), (3, 0), (3, 1)], "doc_id long, toxic int")
    docs = odd.unionByName(spark.createDataFrame([(i, t, "x") for i, t, _ in made_texts(300, 3)], "doc_id long, text string, t string"))
    got = toxicity.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 306 and all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False]
    for some in (labels.where("false"), labels.where("toxic = 0"), labels.limit(2)):
        assert toxicity.score(odd, some).count() == 6
    assert toxicity.score(docs.where("false"), labels).collect() == []
