"""Periodic runs of words, found by a suffix automaton whose suffix links stand in a link-cut forest.

A run is a stretch of consecutive words with smallest period ``q``, as long as can be, that holds at least
``COPIES`` periods and ``LEAST`` words. Words are appended one by one. Each state of the automaton holds the
strings with the same ends; access to the state of the whole prefix makes the path from the root to it one
preferred path and colours it with the word's number, the last end of all its strings. The pieces that the
path is put together of still have their old colours: a piece holds strings of lengths ``low`` to ``high``
that ended at ``end`` before, and where the distance ``d = i - end`` is among these lengths, the ``d`` words up to
``i`` equal the ``d`` words before them: a square. If a shorter period explained it, its strings would have
ended later, so the square's half is its smallest period, and a run shows one square of its period at each of its
words from the second copy on. A chain of squares of one period at consecutive words is the run.

A word counts only if it could lie in a run: it occurs ``COPIES`` times and its triples ``COPIES - 1``
times. Other words cut the text into stretches, which have automata of their own. That is exact, since no run
holds such a word or triple, and ordinary prose leaves little for the automaton. Time is n log n at worst,
memory grows with one stretch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import pairwise, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import text_struct

#: Copies of the period and words that a run has at least.
COPIES, LEAST = 4, 6


class Automaton:
    """Suffix automaton over integers. ``append`` takes a symbol and returns the periods of the squares that end with it.

    ``up``, ``left`` and ``right`` are splay trees, one for each preferred path, in the order of depth; the root of such a
    tree points up to the path's upper neighbour without being its child, and alone holds the path's colour.
    """

    def __init__(self) -> None:
        # State 0 is no state; state 1 holds the empty string.
        self.size, self.link, self.step = [-1, 0], [0, 0], [{}, {}]
        self.up, self.left, self.right, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.count = 1, 0

    def _state(self, size: int, link: int, step: dict) -> int:
        for column, value in ((self.size, size), (self.link, link), (self.step, step), (self.up, link), (self.left, 0), (self.right, 0), (self.colour, -1)):
            column.append(value)
        return len(self.size) - 1

    def splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        top = p
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            inner = bool(g) and (left[g] == p or right[g] == p)
            top = g if inner else p
            # A straight pair turns at its upper edge first, a bent one at its lower edge twice.
            for y in ((p, x) if (left[g] == p) == (left[p] == x) else (x, x)) if inner else (x,):
                p = up[y]
                g = up[p]
                if left[p] == y:
                    b = left[p] = right[y]
                    right[y] = p
                else:
                    b = right[p] = left[y]
                    left[y] = p
                if b:
                    up[b] = p
                up[y], up[p] = g, y
                if g:
                    if left[g] == p:
                        left[g] = y
                    elif right[g] == p:
                        right[g] = y
        self.colour[x] = self.colour[top]

    def _extend(self, c: int) -> int:
        size, link, step = self.size, self.link, self.step
        new = self._state(size[self.last] + 1, 1, {})
        p = self.last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = self.up[new] = q
            else:
                link[new] = self.up[new] = self._between(p, q, c)
        self.last = new
        return new

    def _between(self, p: int, q: int, c: int) -> int:
        """Split the short strings off state ``q``: the copy comes just above it, on its preferred path and with its colour."""
        self.splay(q)
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.step[q]))
        above = self.left[q]
        self.up[copy], self.left[copy], self.right[copy], self.colour[copy] = self.up[q], above, q, self.colour[q]
        if above:
            self.up[above] = copy
        self.left[q], self.up[q], self.link[q] = 0, copy, copy
        while p and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def append(self, c: int) -> list[int]:
        i, self.count = self.count, self.count + 1
        size, up, right, colour = self.size, self.up, self.right, self.colour
        new = x = self._extend(c)
        below, found = 0, []
        while x:
            self.splay(x)
            end, beyond = colour[x], right[x]
            if beyond:
                colour[beyond] = end
            right[x] = below
            if below:
                up[below] = x
            # The path's upper neighbour tells where the lengths of this piece begin; the rest of the piece lies left of x.
            above = up[x]
            if end >= 0 and (size[above] if above else 0) < i - end <= size[x]:
                found.append(i - end)
            below, x = x, above
        self.splay(new)
        colour[new] = i
        return found


def squares_to_runs(symbols: list[int], base: int = 0) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one stretch, whose first word has the number ``base``."""
    machine, current, out = Automaton(), {}, []
    append = machine.append
    for i, c in enumerate(symbols):
        for d in append(c):
            first, last = current.get(d, (i, -2))
            if last != i - 1:
                _close(out, current.get(d), d, base)
                first = i
            current[d] = (first, i)
    for d, chain in current.items():
        _close(out, chain, d, base)
    return out


def _close(out: list, chain: tuple[int, int] | None, period: int, base: int) -> None:
    if chain:
        length = chain[1] - chain[0] + 2 * period
        if length >= max(LEAST, COPIES * period):
            out.append((base + chain[0] - 2 * period + 1, length, period))


def stretches(words: list[bytes]) -> list[tuple[int, list[int]]]:
    """Where a run can lie: first word's number and the words as small integers."""
    counted = Counter(words)
    names = {w: k for k, w in enumerate(w for w, n in counted.items() if n >= COPIES)}
    if not names:
        return []
    ids = np.fromiter(map(names.get, words, repeat(-1)), np.int64, len(words))
    out = []
    for a, b in _spans(ids >= 0, LEAST):
        part = ids[a:b]
        triple = (part[:-2] * len(names) + part[1:-1]) * len(names) + part[2:] if len(names) < 2_000_000 else np.unique(np.stack([part[:-2], part[1:-1], part[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        _, inverse, often = np.unique(triple, return_inverse=True, return_counts=True)
        out += [(a + s, part[s : e + 2].tolist()) for s, e in _spans(often[inverse] >= COPIES - 1, LEAST - 2)]
    return out


def _spans(good: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of the longest stretches of true of at least ``least`` places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= least]


def find(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), by start, then period."""
    return sorted((r for base, symbols in stretches(words) for r in squares_to_runs(symbols, base)), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that some run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop)[:-1] > 0
    edges = [0, *(np.flatnonzero(np.diff(gone)) + 1).tolist(), len(words)]
    return [w for a, b in pairwise(edges) if b > a and not gone[a] for w in words[a:b]]


SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def runs(text: Column | str) -> Column:
    """Struct of the number of words, all runs and the kept words joined by one space; a null text is one without words."""

    def start() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            out = {"n_words": [], "runs": [], "collapsed": []}
            for t in texts:
                words = (t or "").encode("utf-8", "surrogatepass").split()
                got = find(words)
                out["n_words"].append(len(words))
                out["runs"].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in got])
                out["collapsed"].append(b" ".join(collapse(words, got) if got else words).decode("utf-8", "surrogatepass"))
            return out

        return run

    return text_struct(text, SCHEMA, start)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the columns of :func:`runs`.

    Words are separated by the space and the control characters 9 to 13. A null or empty text has no words, no runs and an
    empty collapsed text; an empty table has no rows. Repeated rows give repeated results; other columns, whatever their
    names, play no part. A run found under several periods can't be: each counts with its smallest.
    """
    found = docs.select(F.col(f"`{id_col}`").alias("id"), runs(F.col(f"`{text_col}`").cast("string")).alias("r"))
    return found.select(F.col("id").alias(id_col), *(F.col(f"r.{c}").alias(c) for c in ("n_words", "runs", "collapsed")))


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a period planted in every tenth: id and text alone.

    With h the CRC-32 of the id as text and g = h div 10, a text of n words with h mod 10 = 0 repeats from its word a = g mod n
    on the p = 1 + (n - a) div (3 + g mod 8) words that stand there. A null id plants nothing.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string"))
    text = F.col(f"`{text_col}`").cast("string")
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), (h % 10 == 0).alias("plant"), F.floor(h / 10).cast("long").alias("g"))
    words = F.when(F.col("plant"), F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    placed = chosen.withColumn("w", words).withColumn("n", F.size("w").cast("long"))
    placed = placed.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    a, n, p = F.col("a").cast("int"), F.col("n").cast("int"), F.col("p").cast("int")
    turned = F.concat(F.slice("w", F.lit(1), a), F.transform(F.sequence(a, n - 1), lambda i: F.get(F.col("w"), a + F.pmod(i - a, p))))
    return placed.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What :func:`periodic_runs` found, in short: the number of runs, the one with the most copies (ties: the first), hashes of all runs and of the collapsed text."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = found.select(
        F.col(f"`{id_col}`").alias("id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.aggregate("runs", none, better).alias("best"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    milli = F.expr("1000 * best.length div best.period")
    return told.select(F.col("id").alias(id_col), "n_runs", *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
