"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text becomes its letters in lower case with single spaces between words. Its subwords are the
runs of two to four code points, hashed into ``2**HASH_BITS`` rows of an embedding table; their mean,
times a class matrix, gives the logits. Both matrices are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows. Part of that sample isn't trained on: it sets the
temperature of the softmax and, beside the same texts with their letters in another order, the score
below which a prediction counts as rejected.

A prediction sees the whole text and nothing else. Since the model is linear after the mean, both
matrices are multiplied once before prediction, which changes nothing but the cost.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.llm.common import luck, materialize, text_struct

UNKNOWN = "und"
HASH_BITS = 15
GRAMS = (2, 3, 4)
#: Labelled rows that a model is fitted on at most (one of each language at least), and characters of their text in all.
TRAIN_ROWS, TRAIN_CHARS = 2_000, 8_000_000
#: Share of the sample kept for calibration, of right calibration rows that rejection may cost, and of scrambled ones that it should catch.
HELD, COST, CATCH = 0.25, 0.001, 0.99

_MIX = np.uint32(0x9E3779B1)
_LETTER = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x10000)), np.uint8)


def points(text: str) -> np.ndarray:
    """Code points of the text's lower-cased letters, each other run as one space, a space at both ends."""
    p = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(p, 0xFFFF)].astype(bool)
    beyond = np.flatnonzero(p > 0xFFFF)
    if len(beyond):
        letter[beyond] = [chr(c).isalpha() for c in p[beyond].tolist()]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, p, np.uint32(32))[keep]


def has_letter(p: np.ndarray) -> bool:
    return bool((p != 32).any())


def grams(p: np.ndarray) -> np.ndarray:
    """Table rows of all subwords of one text."""
    out, h = [], p.astype(np.uint32) * _MIX
    shift = np.uint32(32 - HASH_BITS)
    roll = h
    for n in range(2, max(GRAMS) + 1):
        if len(p) < n:
            break
        roll = (roll[:-1] ^ (roll[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + h[n - 1 :]
        if n in GRAMS:
            out.append(((roll ^ (roll >> np.uint32(13))) * _MIX) >> shift)
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text's subwords and how often each occurs."""
    g = np.bincount(grams(points(text)), minlength=0)
    at = np.flatnonzero(g)
    return at.astype(np.int32), g[at].astype(np.float32)


@dataclass
class Model:
    """langs: names by class. table: embeddings times class matrix. least: scores below it are rejected."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def logits(self, text: str) -> np.ndarray | None:
        """None for a text without a letter."""
        p = points(text)
        if not has_letter(p):
            return None
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(p), 500_000):
            g = np.bincount(grams(p[at : at + 500_000 + max(GRAMS) - 1]), minlength=len(self.table))
            total += g @ self.table
            n += int(g.sum())
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the score is too low to trust."""
        z = self.logits(text) if text and self.langs else None
        if z is None:
            return UNKNOWN, 0.0, True
        p = softmax(z / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.least)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 6, rate: float = 8.0, seed: int = 7) -> Model:
    """Fit by stochastic gradient descent with a falling rate; rows with long texts weigh no more than others."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((1 << HASH_BITS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    rows = [counts(t) for t in texts]
    y = np.array([langs.index(x) for x in labels])
    order = rng.permutation(len(rows))
    held = order[: int(HELD * len(rows))]
    fit = order[len(held) :]
    emb = rng.normal(0, 0.1, (1 << HASH_BITS, dim))
    cls, bias = np.zeros((dim, len(langs))), np.zeros(len(langs))
    steps = max(1, epochs * len(fit))
    n = 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            at, c = rows[i]
            lr = rate * (1 - n / steps)
            n += 1
            if not len(at):
                continue
            w = c / c.sum()
            mean = w @ emb[at]
            err = softmax(mean @ cls + bias)
            err[y[i]] -= 1
            back = cls @ err
            cls -= lr * np.outer(mean, err)
            bias -= 0.05 * lr * err
            emb[at] -= lr * w[:, None] * back
    model = Model(langs, emb @ cls, bias, 1.0, 0.0)
    return calibrated(model, [rows[i] for i in held], y[held], [counts(scrambled(texts[i], rng)) for i in held])


def scrambled(text: str, rng: np.random.Generator) -> str:
    """The text's letters in another order, its words as long as before: of no language."""
    p = points(text).copy()
    letters = np.flatnonzero(p != 32)
    p[letters] = p[rng.permutation(letters)]
    return p.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _scores(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logits of rows that have subwords."""
    return np.array([c @ model.table[at] / c.sum() + model.bias for at, c in rows if len(at)])


def calibrated(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, strange: list[tuple[np.ndarray, np.ndarray]] = ()) -> Model:
    """Choose the temperature of least log loss on rows not trained on, then the score below which predictions are rejected.

    That score is one that all but a share ``COST`` of the right rows reach. Some hundred rows don't show
    how low one in a thousand goes, so it is a tenth lower, or less than that where ``strange`` rows,
    of no language, need it to be caught.
    """
    z = _scores(model, rows)
    y = np.array([k for k, (at, _) in zip(y, rows, strict=True) if len(at)], np.int64)
    if not len(z):
        return model
    grid = np.geomspace(0.2, 20, 60)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = p.max(1)[p.argmax(1) == y]
    if len(right):
        most = float(np.quantile(right, COST))
        odd = _scores(model, list(strange))
        caught = float(np.quantile(softmax(odd / model.temperature).max(1), CATCH)) if len(odd) else 0.0
        model.least = min(most, max(0.9 * most, caught))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 modulo 4. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Train on up to ``rows`` labelled rows that aren't held out, those whose text has the least hash.

    Rows are chosen evenly by language: all languages share ``rows`` and ``chars``, and each has one row
    at least. Within a language, equal texts count once. Of a text longer than 20 average shares of
    ``chars`` a stretch that long is taken, from a place that the text's hash names. Once ``chars`` are
    reached, further rows are left out, the same number in each language but for one.
    """
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = usable.groupBy("lang").count().collect()
    if not found:
        return train([], [])
    each = max(1, rows // len(found))
    # A row is a candidate by its hash, so that about three times the rows asked for reach the sort.
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (3.0 * each + 50) / r["count"])) for r in found], "lang string, share double")
    most = max(1, chars // rows) * 20
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - most + 1, F.lit(1))) + 1
    some = usable.join(F.broadcast(shares), "lang").where(luck("text") < F.col("share")).select("lang", F.xxhash64("text").alias("hash"), F.col("text").substr(place.cast("int"), F.lit(most)).alias("text"))
    w = Window.partitionBy("lang").orderBy("hash", "text")
    ranked = materialize(some.dropDuplicates(["lang", "hash", "text"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= each), "sample")
    sizes = ranked.select("n", "lang", F.length("text").alias("size")).toPandas().sort_values(["n", "lang"])
    sizes = sizes[sizes["size"].cumsum() <= chars]
    last = int(sizes["n"].max()) if len(sizes) else 1
    got = ranked.where(F.col("n") <= last).toPandas().sort_values(["n", "lang"])[: max(len(sizes), 1)]
    return train(got["text"].tolist(), got["lang"].tolist())


SCHEMA = "lang_pred string, score double, rejected boolean"


def language(text: Column | str, model: Model) -> Column:
    """Struct of the predicted language, its score, and whether it's rejected; ``und``, 0 and true for a null text or one without a letter."""

    def start() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            out = [model.predict(t) for t in texts]
            return {"lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "rejected": [x[2] for x in out]}

        return run

    return text_struct(text, SCHEMA, start)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``, ``rejected``.

    Without a model, one is fitted on the rows that aren't held out. Where there are none to learn
    from, all texts are ``und``. Repeated rows give repeated results.
    """
    model = fit(docs, id_col, text_col, lang_col) if model is None else model
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), language(F.col(text_col).cast("string"), model).alias("p")).select(id_col, "held_out", "p.*")


def keep_known(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """The rows whose language isn't rejected, ``lang`` filled in where it was null, other columns as they were."""
    model = fit(docs) if model is None else model
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), language(F.col(text_col).cast("string"), model).alias("p")).where("not p.rejected")
    return rows.select(*(F.coalesce("row.lang", "p.lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`") for c in columns))


def accuracy(found: pd.DataFrame) -> float:
    """Share of rows with a label whose prediction equals it."""
    known = found[found["lang"].notna()]
    return float((known["lang"] == known["lang_pred"]).mean()) if len(known) else float("nan")
