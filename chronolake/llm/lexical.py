"""Ranked lexical search by a dual tree: the documents that score highest for each item, exactly.

An item is its set of terms with their weights, a document the impact of each term in it; the score is their
product summed over the item's terms. Items stand in one hierarchy, the documents of a task in another; a node
holds the largest weight, or impact, that each term has below it. The product of two nodes' maxima bounds every
score between their items and documents. A pair of nodes is dropped, with all that lies below, where its bound doesn't
reach the weakest score that still counts as a k-th best among the node's items; the others are split, items first.

Every task starts with the k-th best scores in a bounded sample of documents, which no true result can be below, and
raises them as it finds more, so most batches of documents fall in the top of the trees. Tasks return their best k per
item, and a window keeps the best of all. The corpus is read twice: for counts (documents, terms, and in how many
documents each item term is), and for the search; between, only the item terms of each document are written.

Items are dealt into blocks of a bounded number of terms, each searched against all documents, so neither the
vocabulary nor the trees grow with the number of items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.llm.common import give_back, luck, materialize, text_struct

K = 10
#: Terms (an item's distinct ones, summed over items) that one block of items holds; a larger item is a block of its own.
BLOCK_TERMS = 400_000
#: Documents of the sample that the first k-th best scores come from. They bound, and decide nothing.
SAMPLE = 20_000
#: Cells of the document nodes' maxima in a worker, and documents that one tree holds at most.
CELLS, TREE = 12_000_000, 16_384
#: Children of a node in either tree.
FAN = 8
#: Random directions by which rows are put in order.
DIMS = 64
#: Separators become spaces and A-Z small; other bytes, all beyond ASCII among them, stay as they are.
TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


@dataclass
class Corpus:
    """documents: with a term. total: terms with repeats. weight: by number of an item term."""

    documents: int
    total: int
    weight: np.ndarray

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a document of ``n`` terms gives for a term that it holds ``tf`` times."""
        m = 100 - 90 + (90 * n * self.documents) // max(self.total, 1)
        return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


# ---------------------------------------------------------------- items


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item: ``item``, ``terms`` (distinct). Rows with one id are one item; items without a term are absent."""

    def start() -> Callable[[list], dict]:
        return lambda texts: {"terms": [list(set(terms(t))) for t in texts]}

    rows = items.select(F.col(f"`{id_col}`").alias("item"), text_struct(F.col(f"`{text_col}`").cast("string"), "terms array<binary>", start).alias("t"))
    return rows.select("item", F.explode("t.terms").alias("term")).distinct()


@dataclass
class Items:
    """A block of items: their keys, each one's term numbers, and the number of each term."""

    keys: list
    held: list[np.ndarray]
    number: dict[bytes, int]


def blocks(found: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Items]:
    """Deal the items into blocks by the hash of their id and read them one block at a time: at most about ``most`` terms are here at once."""
    pairs = found.count()
    count = max(1, math.ceil(2 * pairs / most)) if pairs > most else 1
    rows = found.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(count)).cast("int"))
    for k in range(count):
        got = rows.where(F.col("block") == k).groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item").collect()
        if got:
            number: dict[bytes, int] = {}
            held = [np.array(sorted({number.setdefault(bytes(w), len(number)) for w in r.terms}), np.int32) for r in got]
            yield Items([r["item"] for r in got], held, number)


# ---------------------------------------------------------------- documents


def document_terms(docs: DataFrame, number: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document with a term: ``doc``, ``n`` (terms with repeats), and the item terms it holds with how often, as packed integers."""
    def start() -> Callable[[list], dict]:
        known = number.keys()

        def run(texts: list) -> dict:
            out = {"n": [], "at": [], "tf": []}
            for t in texts:
                w = terms(t)
                c = Counter(w)
                both = sorted((number[x], c[x]) for x in c.keys() & known)
                out["n"].append(len(w))
                out["at"].append([x for x, _ in both])
                out["tf"].append([x for _, x in both])
            return out

        return run

    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), text_struct(F.col(f"`{text_col}`").cast("string"), "n long, at array<int>, tf array<int>", start).alias("t"))
    return rows.select("doc", "t.*").where("n > 0")


def corpus(rows: DataFrame, vocabulary: int) -> Corpus:
    """Counts over all documents; one row per item term comes to the driver."""
    sums = rows.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
    holding = np.zeros(vocabulary, np.int64)
    for r in rows.select(F.explode("at").alias("at")).groupBy("at").count().toPandas().itertuples():
        holding[r.at] = r.count
    return Corpus(sums.documents, sums.total or 0, np.array([weight(sums.documents, int(h)) for h in holding], np.int64))


# ---------------------------------------------------------------- trees


def neighbours(start: np.ndarray, at: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """An order of sparse rows in which like ones stand together, so that nodes made of neighbours are tight.

    Rows are projected on ``DIMS`` random directions, then halved again and again along the direction in which they differ
    most; cuts fall on the borders of nodes.
    """
    n = len(start) - 1
    size = np.diff(start)
    sketch, row = np.zeros((n, DIMS)), np.repeat(np.arange(n), size)
    if n <= FAN or not len(at):
        return np.arange(n)
    norm = np.sqrt(np.bincount(row, mass.astype(np.float64) ** 2, n))
    direction = np.random.default_rng(13).standard_normal((int(at.max()) + 1, DIMS))
    share = mass / np.maximum(norm[row], 1e-12)
    for d in range(DIMS):
        sketch[:, d] = np.bincount(row, share * direction[at, d], n)
    out, todo = np.arange(n), [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= FAN:
            continue
        x = sketch[out[a:b]]
        x = x - x.mean(0)
        v = x[np.argmax((x * x).sum(1))]
        for _ in range(8):
            v = (x @ v) @ x
            v /= max(np.sqrt(v @ v), 1e-12)
        along = x @ v
        unit = FAN
        while unit * FAN < b - a:
            unit *= FAN
        cut = min(max(round((b - a) / 2 / unit), 1) * unit, (b - a - 1) // unit * unit)
        out[a:b] = out[a:b][np.argsort(along, kind="stable")]
        todo += [(a, a + cut), (a + cut, b)]
    return out


class ItemTree:
    """Level 0 has a node for each item; a node holds its terms and their largest weights (all equal, as a weight belongs to the term)."""

    def __init__(self, items: Items, weight: np.ndarray) -> None:
        at = np.concatenate(items.held)
        order = neighbours(np.concatenate(([0], np.cumsum([len(x) for x in items.held]))), at, weight[at])
        self.keys = [items.keys[i] for i in order]
        level = [items.held[i] for i in order]
        self.levels = [level]
        while len(level) > 1:
            level = [np.unique(np.concatenate(level[i : i + FAN])) for i in range(0, len(level), FAN)]
            self.levels.append(level)
        self.weight = weight


class DocumentTree:
    """Level 0 has a node for each document, with sparse impacts; higher levels hold dense maxima over the item terms."""

    def __init__(self, start: np.ndarray, at: np.ndarray, impact: np.ndarray, vocabulary: int) -> None:
        self.start, self.at, self.impact = start, at, impact
        n = len(start) - 1
        low = np.zeros((-(-n // FAN), vocabulary), np.int32)
        row = np.repeat(np.arange(n) // FAN, np.diff(start))
        np.maximum.at(low.reshape(-1), row * vocabulary + at, impact.astype(np.int32))
        self.levels = [None, low]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def bounds(self, level: int, nodes: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return self.levels[level][nodes[:, None], terms[None, :]].astype(np.int64) @ weight[terms]

    def scores(self, docs: np.ndarray, of_term: np.ndarray) -> np.ndarray:
        """Exact scores of documents; ``of_term`` has the item's weight at its terms, else 0."""
        first, size = self.start[docs], self.start[docs + 1] - self.start[docs]
        if not size.sum():
            return np.zeros(len(docs), np.int64)
        ends = np.cumsum(size)
        flat = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
        gained = np.concatenate(([0], np.cumsum(of_term[self.at[flat]] * self.impact[flat])))
        return gained[ends] - gained[ends - size]


class Search:
    """Best ``k`` documents of each item over the trees searched so far."""

    def __init__(self, items: ItemTree, k: int, floor: np.ndarray) -> None:
        self.items, self.k = items, k
        #: By item: the k-th best score known, from the sample or from here. Scores below it are of no use; 1 keeps out what scores nothing.
        self.kth = np.maximum(floor, 1)
        self.found: list[list[tuple[int, object]]] = [[] for _ in items.keys]
        self.of_term = np.zeros(len(items.weight), np.int64)
        #: Pairs of nodes bounded, and of items and documents scored.
        self.pairs = self.scored = 0

    def run(self, tree: DocumentTree, ids: list) -> None:
        top = len(tree.levels) - 1
        for item in range(len(self.kth)):
            self._seed(item, tree, top)
        self._visit(len(self.items.levels) - 1, 0, tree, top, np.zeros(1, np.int64), ids)

    def _seed(self, item: int, tree: DocumentTree, top: int) -> None:
        """Raise an item's k-th best score by the documents below the nodes of greatest bound on each level."""
        held, nodes = self.items.levels[0][item], np.zeros(1, np.int64)
        for deep in range(top, 0, -1):
            bound = tree.bounds(deep, nodes, held, self.items.weight)
            self.pairs += len(nodes)
            nodes = nodes[np.argsort(-bound, kind="stable")[: 1 + self.k // FAN]]
            if bound.max() < self.kth[item]:
                return
            nodes = _children(nodes, len(tree.levels[deep - 1]) if deep > 1 else len(tree.start) - 1)
        self.of_term[held] = self.items.weight[held]
        got = np.sort(tree.scores(nodes, self.of_term))
        self.scored += len(nodes)
        self.of_term[held] = 0
        if len(got) >= self.k:
            self.kth[item] = max(self.kth[item], got[-self.k])

    def _visit(self, level: int, node: int, tree: DocumentTree, deep: int, nodes: np.ndarray, ids: list) -> None:
        held = self.items.levels[level][node]
        first, last = node * FAN**level, min((node + 1) * FAN**level, len(self.kth))
        self.pairs += len(nodes)
        bound = tree.bounds(deep, nodes, held, self.items.weight)
        keep = bound >= self.kth[first:last].min()
        nodes, bound = nodes[keep], bound[keep]
        if not len(nodes):
            return
        if level == 0:
            self._item(node, held, tree, deep, nodes[np.argsort(-bound, kind="stable")], ids)
            return
        # Both nodes are split: the documents' as long as they have inner children, then the items' alone.
        if deep > 1:
            nodes, deep = _children(nodes, len(tree.levels[deep - 1])), deep - 1
        for child in range(node * FAN, min((node + 1) * FAN, len(self.items.levels[level - 1]))):
            self._visit(level - 1, child, tree, deep, nodes, ids)

    def _item(self, item: int, held: np.ndarray, tree: DocumentTree, deep: int, nodes: np.ndarray, ids: list) -> None:
        while deep > 1:
            nodes, deep = _children(nodes, len(tree.levels[deep - 1])), deep - 1
            bound = tree.bounds(deep, nodes, held, self.items.weight)
            self.pairs += len(nodes)
            order = np.argsort(-bound, kind="stable")
            nodes = nodes[order[bound[order] >= self.kth[item]]]
        self.of_term[held] = self.items.weight[held]
        bound = tree.bounds(1, nodes, held, self.items.weight) if len(nodes) else np.zeros(0, np.int64)
        n = len(tree.start) - 1
        for at in range(0, len(nodes), 2 * FAN):
            now = nodes[at : at + 2 * FAN][bound[at : at + 2 * FAN] >= self.kth[item]]
            if not len(now):
                break
            docs = _children(now, n)
            self.scored += len(docs)
            got = tree.scores(docs, self.of_term)
            good = got >= self.kth[item]
            if good.any():
                self._take(item, got[good].tolist(), [ids[d] for d in docs[good]])
        self.of_term[held] = 0

    def _take(self, item: int, scores: list, ids: list) -> None:
        best = sorted([*self.found[item], *zip(scores, ids, strict=True)], key=lambda x: (-x[0], x[1] is None, x[1]))[: self.k]
        self.found[item] = best
        if len(best) == self.k:
            self.kth[item] = max(self.kth[item], best[-1][0])


def _children(nodes: np.ndarray, below: int) -> np.ndarray:
    out = (nodes[:, None] * FAN + np.arange(FAN)[None, :]).ravel()
    return out[out < below]


# ---------------------------------------------------------------- the operator


def _searched(rows: DataFrame, items: ItemTree, counts: Corpus, k: int, floor: np.ndarray, kind: str) -> DataFrame:
    """Best ``k`` documents of each item in each task: ``item`` (number in the tree), ``doc``, ``score``."""
    vocabulary = len(counts.weight)
    most = max(FAN * FAN, min(TREE, CELLS * FAN // max(vocabulary, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, id_type = Search(items, k, floor.copy()), None
        for b in batches:
            id_type = b.column("doc").type
            for a in range(0, b.num_rows, most):
                part = b.slice(a, most)
                size = pc.list_value_length(part.column("at")).to_numpy(zero_copy_only=False).astype(np.int64)
                at, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "tf"))
                impact = counts.impact(tf, np.repeat(part.column("n").to_numpy(zero_copy_only=False), size))
                start = np.concatenate(([0], np.cumsum(size)))
                order = neighbours(start, at, impact * counts.weight[at])
                ids = part.column("doc").take(pa.array(order)).to_pylist()
                search.run(DocumentTree(*_reordered(start[:-1], size, at, impact, order), vocabulary), ids)
            give_back()
        rows = [(i, d, s) for i, best in enumerate(search.found) for s, d in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())], ["item", "doc", "score"])

    return rows.select("doc", "n", "at", "tf").mapInArrow(run, f"item int, doc {kind}, score long")


def _reordered(first: np.ndarray, size: np.ndarray, at: np.ndarray, impact: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows in another order: where each starts, terms, impacts."""
    size, first = size[order], first[order]
    start = np.concatenate(([0], np.cumsum(size)))
    flat = np.arange(start[-1]) + np.repeat(first - start[:-1], size)
    return start, at[flat], impact[flat]


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` documents of highest score for each item: item, ``rank`` from 1, document, ``score``.

    Only scores above 0 count, and equal scores go by ascending document id, a null id last. A null or empty text has no
    term: as a document it counts nowhere, as an item it has no rows. Rows with one item id are one item with the
    terms of all; a null id is an item like others. Rows of documents are documents of their own, so a repeated row
    takes another rank. Empty tables give no rows. Other columns, whatever their names, play no part.
    """
    spark, kind, item_kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    parts = []
    for block in blocks(materialize(item_terms(items, item_col, item_text), "item_terms"), block_terms):
        rows = materialize(document_terms(docs, block.number, id_col, text_col), "document_terms")
        counts = corpus(rows, len(block.number))
        tree = ItemTree(block, counts.weight)
        none = np.zeros(len(tree.keys), np.int64)
        few = rows.where(luck("doc", "n", "at") < min(1.0, sample / max(counts.documents, 1)))
        floor = none.copy()
        for r in _best(_searched(few, tree, counts, k, none, kind), k).where(F.col("rank") == k).select("item", "score").collect():
            floor[r["item"]] = r.score
        best = _best(_searched(rows, tree, counts, k, floor, kind), k)
        keys = spark.createDataFrame(list(enumerate(tree.keys)), f"item int, key {item_kind}")
        parts.append(best.join(keys, "item").select(F.col("key").alias("item"), "rank", "doc", "score"))
    if not parts:
        return spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, `{id_col}` {kind}, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
