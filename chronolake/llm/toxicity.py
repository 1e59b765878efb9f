"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities: of words in a lexicon, of those near a word in the second person, of capitals,
punctuation and obfuscated spellings. The lexicon has two parts: a fixed list of insults, and word beginnings and whole
words that toxic training texts use more than others do, with how much more as their weight. A word takes the weight of
its longest beginning that is known, so a beginning that only some endings make toxic is told apart. Spellings are
looked up as they are, then with digits and signs read as letters, accents dropped, letters repeated or put apart.

Everything is learned from a bounded sample of labelled rows that aren't held out. The features of a training row come from
a lexicon learned without its part of the sample, and the calibration from trees fitted without it, so neither sees
its own answers. The trees are fitted in numpy: histograms of gradients, one level after another. Calibration
pools adjacent violators, weighted so that the classes have their shares of all labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import materialize, text_struct

#: Labelled rows that a model is fitted on at most, half of each class, and characters of their text in all.
TRAIN_ROWS, TRAIN_CHARS = 4_000, 10_000_000
#: Parts of the sample for features and calibration out of their own part.
PARTS = 4
#: Lengths of the word beginnings in the learned lexicon, and texts of either class that an entry is in at least.
PREFIXES, SUPPORT = range(3, 9), 5
#: Standard errors by which an entry's odds exceed those of clean texts, and its log odds at least.
SURE, ODDS = 3.5, 1.0
#: Words on each side of a hit in which a second person is near, and words of the window whose weight is summed.
NEAR, WINDOW = 4, 24
#: Words that a worker remembers.
MEMORY = 300_000

#: Insults and swear words of four languages, lower case.
INSULTS = frozenset(
    """
    arsehole asshole bastard bitch bullshit clown coward cretin creep crap cunt damn dickhead disgusting dumb dumbass fag fool freak fuck
    fucking garbage hate idiot idiotic idiots imbecile jerk loser losers lunatic moron morons nazi parasite pathetic pig prick psycho retard
    retarded scum scumbag shit shut sick slut stupid suck sucks trash ugly useless vermin whore worthless
    abschaum arsch arschloch bastard blöd depp drecksau dummkopf fotze hurensohn idioten miststück penner scheiße schlampe schwein trottel versager wichser
    abruti bouffon con connard connasse crétin débile enculé imbécile merde ordure pute putain salaud salope
    basura cabrón estúpido gilipollas hijoputa idiota imbécil inútil mierda pendejo puta zorra
    """.split()
)
#: Words that speak to someone, in the same languages.
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())
#: Digits and signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”„‚‘’«»¡¿–—"
#: Signs at a word's ends that stand for no letter.
_PLAIN = ".,;:?\"'()[]"
_REPEATED = re.compile(r"(.)\1{2,}")


def plain(word: str) -> str:
    """Lower case, without signs at its ends."""
    return word.lower().strip(_EDGE)


def unmasked(word: str) -> str:
    """A word as it may be meant: signs read as letters, accents and other signs dropped, runs of a letter cut to one."""
    w = "".join(c for c in unicodedata.normalize("NFKD", word.lower().rstrip(".,;:!?\"')").translate(LEET)) if c.isalpha())
    return _REPEATED.sub(r"\1", w)


# ---------------------------------------------------------------- lexicon


def entries(text: str) -> Counter:
    """How often a text has each word (ending in a space) and each word beginning."""
    out: Counter = Counter()
    for w, n in Counter(text.lower().split()).items():
        w = w.strip(_EDGE)[:40]
        if len(w) < 2 or not w[0].isalpha():
            continue
        out[w + " "] += n
        for k in PREFIXES:
            if len(w) < k:
                break
            out[w[:k]] += n
    return out


@dataclass
class Lexicon:
    weight: dict[str, float] = field(default_factory=dict)

    def of(self, word: str) -> float:
        """Weight of the longest known beginning of a plain word, the whole word first."""
        known = self.weight
        if not known or not word:
            return 0.0
        w = known.get(word[:40] + " ")
        if w is not None:
            return w
        for k in range(min(len(word), PREFIXES[-1]), PREFIXES[0] - 1, -1):
            w = known.get(word[:k])
            if w is not None:
                return w
        return 0.0


def lexicon(counted: list[Counter], y: np.ndarray) -> Lexicon:
    """Entries that toxic texts use more, by log odds over their standard error, and what extends such an entry, with its own log odds."""
    use, texts, size = (Counter(), Counter()), Counter(), [1.0, 1.0]
    for c, k in zip(counted, y.tolist(), strict=True):
        use[k].update(c)
        texts.update(c.keys())
        size[k] += sum(n for w, n in c.items() if w.endswith(" "))
    odds = {}
    for w in use[1]:
        if texts[w] < SUPPORT:
            continue
        a, b = use[1][w], use[0].get(w, 0)
        # The smaller class's chance is added to both, as a prior worth half a use.
        share = (a + b) / (size[0] + size[1])
        prior = 0.5
        low, high = (b + prior) / (size[0] + prior / share), (a + prior) / (size[1] + prior / share)
        odds[w] = (math.log(high / low), math.sqrt(1 / (a + prior) + 1 / (b + prior)))
    sure = {w for w, (d, e) in odds.items() if d >= ODDS and d >= SURE * e}
    out = {w: d for w, (d, e) in odds.items() if w in sure or any(w[:k] in sure for k in range(PREFIXES[0], len(w)))}
    return Lexicon({w: round(min(max(d, -2.0), 6.0), 3) for w, d in out.items()})


# ---------------------------------------------------------------- features

FEATURES = (
    "log_words", "log_hits", "hit_density", "weight_density", "most_weight", "weight_sum", "log_strong", "strong_density", "log_insults", "insult_density", "you_density", "near_you", "near_you_density",
    "capital_words", "capital_hits", "exclamations", "questions", "sign_runs", "masked_words", "masked_hits", "repeated_letters", "spaced_hits", "window_weight",
)
_HIT, _INSULT, _YOU, _CAPITAL, _MASKED, _REPEAT, _SINGLE = (1 << k for k in range(7))


class Words(dict):
    """What a word of a text shows, as flags and a row of ``weights``; remembers words within a bound."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        word = plain(token)
        weight, flags = self.lexicon.of(word), 0
        insult = word in INSULTS
        if not insult and weight < ODDS and len(token) <= 40 and not token.strip(_PLAIN).isalpha():
            flags |= self._masked(token)
        elif not insult and weight < ODDS and len(token) <= 40 and _REPEATED.search(word):
            flags |= self._masked(token) | _REPEAT
        elif not insult and weight < ODDS and len(token) <= 40 and not word.isascii() and unmasked(word) in INSULTS:
            flags |= _MASKED | _HIT | _INSULT
        if flags & _INSULT:
            insult = True
        if flags & _HIT:
            weight = max(weight, self.lexicon.of(unmasked(token)))
        flags |= (_HIT if weight >= ODDS or insult else 0) | (_INSULT if insult else 0) | (_YOU if word in SECOND_PERSON else 0)
        flags |= (_CAPITAL if len(word) > 2 and token.isupper() else 0) | (_SINGLE if len(word) == 1 and word.isalpha() else 0)
        code = flags | round((weight + 2) * 100) << 8
        if len(self) >= MEMORY:
            self.clear()
        if len(token) <= 64:
            self[token] = code
        return code

    def _masked(self, token: str) -> int:
        core = token.strip(_PLAIN)
        if not any(c.isalpha() for c in core):
            return 0
        word = unmasked(core)
        odd = 0 if core.replace("'", "").replace("-", "").isalpha() or core[-1:] in _EDGE else _MASKED
        if len(word) > 2 and (word in INSULTS or self.lexicon.of(word) >= ODDS):
            return _MASKED | _HIT | (_INSULT if word in INSULTS else 0)
        return odd


def features(text: str | None, words: Words) -> np.ndarray:
    """The features of one whole text; zeros for a text without a word."""
    out, text = np.zeros(len(FEATURES)), text or ""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return out
    code = np.fromiter(map(words.__getitem__, tokens), np.int64, n)
    weight = np.maximum((code >> 8) / 100.0 - 2, 0)
    weight[weight < ODDS] = 0
    hit, insult, you, capital, masked = ((code & f) > 0 for f in (_HIT, _INSULT, _YOU, _CAPITAL, _MASKED))
    n_hit, strong = int(hit.sum()), int((weight >= 3).sum())
    near = 0
    if n_hit and you.any():
        reach = np.concatenate(([0], np.cumsum(you)))
        at = np.flatnonzero(hit)
        near = int((reach[np.minimum(at + NEAR + 1, n)] > reach[np.maximum(at - NEAR, 0)]).sum())
    total = np.concatenate(([0.0], np.cumsum(weight)))
    window = min(WINDOW, n)
    spaced = _spaced(tokens, (code & _SINGLE) > 0, words)
    length = len(text)
    out[:] = (
        math.log1p(n), math.log1p(n_hit), n_hit / n, total[-1] / n, weight.max(), total[-1], math.log1p(strong), strong / n, math.log1p(insult.sum()), insult.sum() / n, you.sum() / n, near, near / n,
        capital.sum() / n, (capital & hit).sum(), text.count("!") / length, text.count("?") / length, (text.count("!!") + text.count("?!") + text.count("??")) / n, masked.sum() / n, (masked & hit).sum(),
        ((code & _REPEAT) > 0).sum() / n, spaced, (total[window:] - total[:-window]).max(),
    )
    return out


def _spaced(tokens: list[str], single: np.ndarray, words: Words) -> int:
    """Hits spelled as letters apart: three single letters or more in a row."""
    if single.sum() < 3:
        return 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0])))).reshape(-1, 2)
    return sum(bool(words["".join(map(plain, tokens[a:b]))] & _HIT) for a, b in edges if 3 <= b - a <= 40)


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Complete trees of one depth, level by level: split feature, threshold, and the leaves' values."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0) -> Trees:
    """Fit to the logistic loss. Splits are looked for between at most ``bins`` ranges of each feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    cells = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    n, k = x.shape
    share = float((w * y).sum() / w.sum())
    base = math.log(share / (1 - share)) if 0 < share < 1 else (8.0 if share else -8.0)
    inner, margin = 2**depth - 1, np.full(n, base)
    out = Trees(depth, base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    flat = cells + np.arange(k) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = ((at - first) * k * bins)[:, None] + flat
            sums = [np.bincount(place.ravel(), np.repeat(v, k), count * k * bins).reshape(count, k, bins).cumsum(2) for v in (g, h)]
            gl, hl = sums
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(hl < 1.0) | (ha - hl < 1.0)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for node in range(count):
                f, b = divmod(int(best[node]), bins)
                if gain[node, f, b] > 1e-6 and b < len(edges[f]):
                    out.feature[t, first + node], out.threshold[t, first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), out.feature[t][at]] > out.threshold[t][at])
        leaf = at - inner
        out.value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += out.value[t][leaf]
    return out


def isotonic(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising function of least squared error: pooled adjacent violators, each pool at its mean margin.

    A pool of one class is taken half a row towards the middle, so no score is quite 0 or 1.
    """
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, v, u in zip(margin[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([v * u, u, m * u])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
    at = np.array([p[2] / p[1] for p in pools])
    value = np.array([(p[0] + 0.25) / (p[1] + 0.5) for p in pools])
    return at, np.maximum.accumulate(value)


# ---------------------------------------------------------------- model


@dataclass
class Model:
    """share: of toxic rows among those labelled, the score of every text where there is nothing to tell classes apart by."""

    share: float
    lexicon: Lexicon
    trees: Trees | None = None
    at: np.ndarray | None = None
    value: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        return np.interp(self.trees.margin(x), self.at, self.value)


def train(texts: list[str], labels: list[int], share: float, seed: int = 11) -> Model:
    """Fit on texts and their labels; ``share`` is that of label 1 among all labelled rows, whatever it is here."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2 or min(np.bincount(y, minlength=2)) < PARTS:
        return Model(share, Lexicon())
    counted = [entries(t) for t in texts]
    part = np.zeros(len(y), np.int64)
    rng = np.random.default_rng(seed)
    for k in (0, 1):
        of = rng.permutation(np.flatnonzero(y == k))
        part[of] = np.arange(len(of)) % PARTS
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(PARTS):
        words = Words(lexicon([c for c, p in zip(counted, part.tolist(), strict=True) if p != k], y[part != k]))
        for i in np.flatnonzero(part == k):
            x[i] = features(texts[i], words)
    margin = np.zeros(len(y))
    for k in range(PARTS):
        margin[part == k] = boost(x[part != k], y[part != k], w[part != k]).margin(x[part == k])
    return Model(share, lexicon(counted, y), boost(x, y, w), *isotonic(margin, y, w))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels training never sees: crc32 of the id as text is divisible by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Train on up to ``rows`` labelled documents that aren't held out, those whose hash is least, half of each class.

    An id with several labels has the greatest. Labels are sampled before texts are looked at, so only the sample's ids,
    ``rows`` at most, are sent to all tasks. Equal texts of one id count once. Of a text longer than 20 average shares of ``chars`` a stretch
    that long is taken, from a place that the text's hash names; rows beyond ``chars`` in all are left out.
    """
    label = F.col(f"`{label_col}`").cast("int")
    usable = labels.where(F.col(f"`{id_col}`").isNotNull() & label.isin(0, 1) & ~held_out(F.col(f"`{id_col}`"))).select(F.col(f"`{id_col}`").alias("id"), label.alias("toxic"))
    known = usable.groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return Model(0.0, Lexicon())
    share = counts.get(1, 0) / sum(counts.values())
    each = max(1, rows // len(counts))
    chosen = None
    for k in sorted(counts):
        some = known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(each)
        chosen = some if chosen is None else chosen.union(some)
    most = max(1, chars // rows) * 20
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - most + 1, F.lit(1))) + 1
    texts = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    joined = texts.join(F.broadcast(materialize(chosen, "toxic_ids")), "id").select("toxic", F.xxhash64("id", "text").alias("hash"), F.col("text").substr(place.cast("int"), F.lit(most)).alias("text"))
    # One row of each hash; where ids repeat with many texts, the least hashes are taken.
    sample = materialize(joined.groupBy("toxic", "hash").agg(F.min("text").alias("text")).orderBy("hash", "toxic").limit(rows), "toxic_sample")
    sizes = sample.select("hash", "toxic", F.length("text").alias("size")).toPandas().sort_values(["hash", "toxic"])
    last = int(sizes["hash"][sizes["size"].cumsum() <= chars].max()) if len(sizes) else 0
    got = sample.where(F.col("hash") <= last).toPandas().sort_values(["hash", "toxic"])
    return train(got["text"].tolist(), got["toxic"].astype(int).tolist(), share)


def toxicity(text: Column | str, model: Model) -> Column:
    """Struct of ``score`` from 0 to 1 and ``predicted``, 1 from a score of 0.5; a null text counts as empty."""

    def start() -> Callable[[list], dict]:
        words = Words(model.lexicon)

        def run(texts: list) -> dict:
            x = np.array([features(t, words) for t in texts]).reshape(len(texts), len(FEATURES))
            s = model.scores(x)
            return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return run

    return text_struct(text, "score double, predicted int", start)


def score(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: its id, ``held_out``, ``score``, ``predicted``.

    Without a model, one is fitted on the labelled rows that aren't held out. Where these are absent or too few to learn from, the
    score is the share of toxic ones among them, 0 without any. A null or empty text has a score as well, that of a text without
    words. Equal texts have equal scores; repeated rows give repeated results; other columns, whatever their names, play no part.
    """
    if model is None:
        model = fit(docs, labels, id_col, text_col, label_col) if labels is not None else Model(0.0, Lexicon())
    found = docs.select(F.col(f"`{id_col}`").alias("id"), toxicity(F.col(f"`{text_col}`").cast("string"), model).alias("t"))
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("t.score").alias("score"), F.col("t.predicted").alias("predicted"))
