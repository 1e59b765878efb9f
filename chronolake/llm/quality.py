"""Quality rules as a short-circuit cascade.

Each rule looks at one whole text. Before a run, every rule is timed and its rejections counted on
a bounded sample, as the cascade will meet it: on texts that pass the base, with the base's measures at
hand, and on those only that the rules before it leave. The cascade asks the rule with the most
rejections per second first and stops at the first that rejects. The order changes only the cost: the
verdict is whether any rule rejects, so it is the same for every order and every sample.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import text_struct

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_DIGITS = b"0123456789"
#: An odd multiplier for the rolling sum over word hashes.
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Text:
    """One text with what the rules measure; each measure is taken once, when first asked for."""

    raw: bytes
    known: dict = field(default_factory=dict)

    @classmethod
    def of(cls, text: str | None) -> Text:
        return cls((text or "").encode("utf-8", "surrogatepass"))

    def __getattr__(self, name: str):
        known = self.__dict__["known"]
        if name not in known:
            known[name] = _MEASURES[name](self)
        return known[name]


def code_points(raw: bytes) -> int:
    """Number of code points in UTF-8: bytes that aren't continuations."""
    if raw.isascii():
        return len(raw)
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def _without(raw: bytes, drop: bytes) -> int:
    return len(raw) - len(raw.translate(None, drop))


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.raw.split(b"\n") if x.strip(_SPACE)]
    t.known["n_lines"] = len(lines)
    return len(lines) - len(set(lines))


def _n_lines(t: Text) -> int:
    t.n_dup_lines  # noqa: B018  it leaves the number of lines behind
    return t.known["n_lines"]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs at least twice, first one included.

    Windows are compared by a 64-bit rolling sum of word hashes.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window):
            sums = sums * np.uint64(_BASE) + h[j : j + n]
        sums ^= sums >> np.uint64(29)
    ordered = np.sort(sums)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return 0
    at = np.searchsorted(again, sums)
    hit = again[np.minimum(at, len(again) - 1)] == sums
    edge = np.zeros(len(words) + 1, np.int32)
    edge[:n] += hit
    edge[window : window + n] -= hit
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


_MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.raw.split(),
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: code_points(t.raw.translate(None, _SPACE)),
    "n_symbols": lambda t: _without(t.raw, SYMBOLS),
    "n_dup_lines": _dup_lines,
    "n_lines": _n_lines,
    "n_repeat_words": lambda t: repeat_words(t.words),
    "upper": lambda t: _without(t.raw, _UPPER),
    "lower": lambda t: _without(t.raw, _LOWER),
    "digits": lambda t: _without(t.raw, _DIGITS),
    "n_stutter": lambda t: sum(map(bytes.__eq__, t.words, t.words[1:])),
    "base_failed": lambda t: t.n_words < MIN_WORDS or 100 * t.n_repeat_words > REPEAT_PERCENT * t.n_words,
    "bullets": lambda t: len(re.findall(rb"(?m)^[ \t]*(?:[-*]|\xe2\x80\xa2)[ \t]", t.raw)),
    "ellipses": lambda t: len(re.findall(rb"(?m)(?:\.\.\.|\xe2\x80\xa6)[ \t\r]*$", t.raw)),
}

#: A rule is true of texts that it rejects. Thresholds leave wide room for ordinary prose.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "dup_lines": lambda t: t.n_lines >= 4 and 2 * t.n_dup_lines > t.n_lines,
    "stutter": lambda t: t.n_stutter > 20 and 2 * t.n_stutter > t.n_words,
    "shouting": lambda t: t.upper > 2 * t.lower and t.upper > 20,
    "word_length": lambda t: t.word_chars > 20 * t.n_words or 2 * t.word_chars < 3 * t.n_words,
    "digits": lambda t: 2 * t.digits > t.word_chars,
    "bullets": lambda t: t.n_lines >= 10 and 10 * t.bullets > 9 * t.n_lines,
    "ellipses": lambda t: t.n_lines >= 10 and 10 * t.ellipses > 3 * t.n_lines,
}

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def measured(texts: list, rules: dict[str, Callable[[Text], bool]], clock: Callable[[], int] = time.perf_counter_ns) -> tuple[dict[str, list[int]], dict[str, list[bool]]]:
    """Nanoseconds and verdict of each rule for each text that passes the base; the base's measures are taken before, and each rule starts from these alone."""
    spent: dict[str, list[int]] = {x: [] for x in rules}
    rejects: dict[str, list[bool]] = {x: [] for x in rules}
    for text in texts:
        t = Text.of(text)
        if t.base_failed:
            continue
        for k in BASE:
            getattr(t, k)
        primed = dict(t.known)
        for name, rule in rules.items():
            t.known.clear()
            t.known.update(primed)
            began = clock()
            rejects[name].append(bool(rule(t)))
            spent[name].append(clock() - began)
    return spent, rejects


def greedy(spent: dict[str, list[int]], rejects: dict[str, list[bool]]) -> list[str]:
    """Rules by rejections per cost, each counted on the texts that the rules before it leave; equal ones in the order given.

    Where no rule left rejects a text left, the cheapest comes first.
    """
    names_ = list(spent)
    cost, hit = np.array([spent[x] for x in names_], float), np.array([rejects[x] for x in names_], bool)
    left, out = np.ones(cost.shape[1], bool), []
    rest = list(range(len(names_)))
    while rest:
        n = max(int(left.sum()), 1)
        rate = [((hit[k] & left).sum() + 0.01) / n / max(cost[k][left].mean() if left.any() else 1.0, 1e-9) for k in rest]
        k = rest.pop(int(np.argmax(rate)))
        out.append(names_[k])
        left &= ~hit[k]
    return out


def plan(docs: DataFrame, text_col: str = "text", sample_rows: int = 512) -> list[str]:
    """Names of the rules in the order of :func:`greedy`.

    ``sample_rows`` bounds the sample, drawn from all rows; they are timed in one task and only the
    order comes back. Without rows, the rules keep the order in which they are declared.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [t for b in batches for t in b["text"].tolist()]
        yield pd.DataFrame({"rule": greedy(*measured(texts, RULES))})

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    share = min(1.0, 2.0 * sample_rows / max(rows.count(), 1))
    sample = (rows.sample(share, 7) if share < 1 else rows).limit(sample_rows).coalesce(1)
    found = [r.rule for r in sample.mapInPandas(run, "rule string").collect()]
    return found or list(RULES)


def order(costs: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejected share per cost, falling; ties in the declared order."""
    return sorted(RULES, key=lambda x: -(costs[x][1] / max(costs[x][0], 1e-9)) if x in costs else 0)


def verdict(t: Text, rules: list[str]) -> bool:
    return not any(RULES[x](t) for x in rules)


def quality(text: Column | str, rules: list[str]) -> Column:
    """Struct of the base measures, ``base_failed`` and ``kept`` for a text column.

    A null text counts as empty: no words, so ``base_failed`` is true. All measures are of the
    whole text. The cascade runs only for texts that don't fail the base.
    """

    def start() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            rows = []
            for x in texts:
                t = Text.of(x)
                failed = t.base_failed
                rows.append((*(getattr(t, k) for k in BASE), failed, not failed and verdict(t, rules)))
            return dict(zip((*BASE, "base_failed", "kept"), map(list, zip(*rows, strict=True)) if rows else ([] for _ in range(7)), strict=True))

        return run

    return text_struct(text, SCHEMA, start)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 512) -> DataFrame:
    """One row per document: its id and the columns of :func:`quality`.

    Repeated rows give repeated results; other columns, whatever their names, play no part.
    """
    rules = plan(docs, text_col, sample_rows)
    return docs.select(F.col(id_col), quality(F.col(text_col).cast("string"), rules).alias("q")).select(id_col, "q.*")


def keep_good(docs: DataFrame, text_col: str = "text", sample_rows: int = 512) -> DataFrame:
    """The rows whose text passes, all columns as they were."""
    rules, columns = plan(docs, text_col, sample_rows), docs.columns
    passed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), quality(F.col(text_col).cast("string"), rules).alias("q"))
    return passed.where("q.kept").select("row.*")
