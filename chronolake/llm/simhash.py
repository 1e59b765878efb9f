"""SimHash near-duplicates by the generalised pigeonhole principle.

Equal fingerprints become one node. The 64 bits are cut into parts so that correlated bits share a
part; a threshold for each part, possibly -1 for "not used", is allotted by dynamic programming so
that the thresholds sum to ``radius - parts + 1`` and the estimated number of candidates is least.
Two fingerprints within the radius then agree up to the threshold in at least one part. Nodes meet
in buckets of equal (probed) part values and are verified there by their whole distance.

A bucket with more than ``bucket`` nodes isn't searched pairwise. Its nodes instead meet by the
fingerprints one flip away from them (for radius 2: two nodes within 2 flips share such a
fingerprint, and no other nodes do, so nothing has to be verified). That is exact, linear in the
number of nodes, and at most 65 nodes share such a key. Inside a bucket only links that join
something new are kept, so links never outnumber nodes times probes.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import give_back, luck, materialize, text_struct

BITS = 64
SEED = 42
#: Nodes of a bucket that are compared pairwise.
BUCKET = 256
#: Nodes that the choice of parts and thresholds looks at.
SAMPLE = 20_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a whole text, as an unsigned number.

    A-Z are lower-cased; words are runs without ASCII white space; shingles of ``words`` words, each
    as often as it occurs, are joined by a space. A text with fewer words is one shingle; without
    words the fingerprint is zero. A bit is set if more than half of the shingles' hashes set it.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in joined], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def simhash(text: Column | str, words: int = 3) -> Column:
    """The fingerprint as a signed long with the same bits."""

    def run(texts: list) -> dict:
        return {"fp": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)}

    return text_struct(text, "fp long", lambda: run)["fp"]


# ---------------------------------------------------------------- parts and thresholds


def correlated_parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the columns of a 0/1 matrix into groups of nearly equal size, each greedily grown by the free bit that correlates most with it."""
    n = bits.shape[1]
    x = bits - (bits.mean(0) if len(bits) else 0)
    dev = np.sqrt((x * x).sum(0)) + 1e-9
    c = np.abs(x.T @ x / np.outer(dev, dev))
    np.fill_diagonal(c, 0)
    free, out = set(range(n)), []
    for p in range(parts):
        size = (n - sum(map(len, out))) // (parts - p)
        rest = sorted(free)
        group = [max(rest, key=lambda b: c[b, rest].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: c[b, group].sum())
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


#: What a probe costs (a row in the shuffle), in comparisons of two fingerprints.
PROBE_COST = 100.0


def estimate(bits: np.ndarray, part: list[int], most: int, nodes: int) -> list[float]:
    """Estimated cost of a node for thresholds -1, 0, ..., ``most`` of a part: its probes, and its candidates among ``nodes`` nodes, by the sample's distances."""
    half = len(bits) // 2
    a, b = bits[:half][:, part].astype(np.float32), bits[half : 2 * half][:, part].astype(np.float32)
    seen = np.zeros(len(part) + 1)
    step = max(1, 4_000_000 // max(half, 1))
    for at in range(0, min(half, 2_000), step):
        x = a[at : at + step]
        far = x.sum(1)[:, None] + b.sum(1)[None] - 2 * x @ b.T
        seen += np.bincount(np.rint(far).astype(np.int64).ravel(), minlength=len(part) + 1)
    share = np.cumsum(seen) / max(seen.sum(), 1)
    return [0.0, *(float(nodes * share[min(t, len(part))]) + PROBE_COST * len(_flips(part, t)) for t in range(most + 1))]


def allot(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds (from -1) of least summed cost whose sum is ``total``, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t in range(-1, len(c) - 1):
                if s + t not in new or cost + c[t + 1] < new[s + t][0]:
                    new[s + t] = (cost + c[t + 1], [*chosen, t])
        best = new
    return best[total][1]


def plan(nodes: DataFrame, radius: int, sample: int = SAMPLE) -> list[tuple[list[int], int]]:
    """Pairs of (bits of a part, threshold), unused parts left out.

    Looks at up to ``sample`` fingerprints, those of least hash, and tries two to six parts (more for
    a wide radius, since a threshold is 2 at most). Which plan is taken changes only the cost: each
    finds all pairs within the radius, which has to be below the number of bits.
    """
    if not 0 <= radius < BITS:
        raise ValueError(f"the radius has to be from 0 to {BITS - 1}")
    n = nodes.count()
    # Twice the sample and some more come to the sort, not every node of every task.
    some = nodes.select("fp").where(luck("fp", F.lit(1)) < min(1.0, (2.0 * sample + 100) / max(n, 1)))
    taken = some.orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64)
    bits = np.unpackbits(taken.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(taken) else np.zeros((0, BITS), np.uint8)
    plans = []
    least = max(2, -(-(radius + 1) // 3))
    for m in range(least, max(least, min(6, radius + 3)) + 1):
        parts = correlated_parts(bits.astype(np.float32), m)
        costs = [estimate(bits, p, min(radius, 2), n) for p in parts]
        chosen = allot(costs, radius - m + 1)
        plans.append((sum(c[t + 1] for c, t in zip(costs, chosen, strict=True)), m, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[:2])[2]


# ---------------------------------------------------------------- probing and verification


def _flips(mask_bits: list[int], most: int) -> list[int]:
    """All xor masks with up to ``most`` of the given bits, as signed 64-bit numbers."""
    masks = [0]
    for i, a in enumerate(mask_bits):
        if most >= 1:
            masks.append(1 << a)
        if most >= 2:
            masks += [1 << a | 1 << b for b in mask_bits[:i]]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def probes(fp: Column, parts: list[tuple[list[int], int]]) -> Column:
    """Array of (part, value): each part's value, and for a threshold over 0 also the values within it, marked as probes."""
    every = []
    for k, (bits, t) in enumerate(parts):
        mask = sum(1 << b for b in bits)
        own = fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        every += [F.struct(F.lit(k).alias("part"), own.bitwiseXOR(F.lit(f)).alias("value")) for f in _flips(bits, t)]
    return F.array(*every)


class Sets:
    """Union-find over positions of a small array."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def bucket_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a bucket's distinct fingerprints that join its components within the radius: verified pairs, a spanning forest."""
    u = fps.view(np.uint64)
    sets, out = Sets(len(u)), []
    for i in range(1, len(u)):
        near = np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= radius)
        out += [(int(fps[j]), int(fps[i])) for j in near.tolist() if sets.join(j, i)]
    return out


def _search(radius: int, bucket: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows sorted by (part, value, fp): links of small buckets, and nodes of larger ones as (fp, null). Holds ``bucket`` nodes at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, large = None, [], False
        out: list[tuple[int, int | None]] = []

        def close() -> None:
            if len(held) > 1 and not large:
                out.extend(bucket_links(np.array(held, np.int64), radius))

        for b in batches:
            for part, value, fp in zip(b["part"].tolist(), b["value"].tolist(), b["fp"].tolist(), strict=True):
                if (part, value) != key:
                    close()
                    key, held, large = (part, value), [], False
                if held and held[-1] == fp:
                    continue
                if large:
                    out.append((fp, None))
                    held = [fp]
                else:
                    held.append(fp)
                    if len(held) > bucket:
                        large = True
                        out += [(x, None) for x in held]
                        held = [fp]
            if out:
                yield pd.DataFrame({"a": pd.array([x[0] for x in out], "Int64"), "b": pd.array([x[1] for x in out], "Int64")})
                out = []
        close()
        if out:
            yield pd.DataFrame({"a": pd.array([x[0] for x in out], "Int64"), "b": pd.array([x[1] for x in out], "Int64")})

    return run


def by_flips(nodes: DataFrame) -> DataFrame:
    """Links among ``nodes`` (fp) within 2 bits: nodes meet at the fingerprints one flip away from them.

    All pairs that meet are within 2 bits, so each links to the least node it meets. Keys of one node
    only go away before anything is joined.
    """
    reach = nodes.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(f)) for f in _flips(list(range(BITS)), 1)))).alias("key"))
    groups = reach.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("top"), F.collect_list("fp").alias("all")).where("a <> top")
    return groups.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


#: Nodes of a block that :func:`by_blocks` compares with another block's, on average.
BLOCK = 4096


def by_blocks(nodes: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Links among ``nodes`` (fp) within any radius: every pair of blocks is searched as a bucket of its own, so a task holds two blocks."""
    g = max(1, math.ceil(nodes.count() / block))
    own = F.pmod(F.xxhash64("fp"), F.lit(g)).cast("int").alias("own")
    dealt = nodes.select("fp", own, F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("other"))
    pairs = dealt.select(F.least("own", "other").alias("part"), F.greatest("own", "other").cast("long").alias("value"), "fp")
    n = max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartition(n, "part", "value").sortWithinPartitions("part", "value", "fp").mapInPandas(_search(radius, 1 << 62), "a long, b long")


def links(nodes: DataFrame, radius: int = 2, bucket: int = BUCKET, parts: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs within the radius.

    ``nodes`` has one column ``fp`` without repeats and should be a written table. Values that a
    thousandth of all probes share go to the flips directly, so that no task gets them all; there can
    be a thousand such values at most, which bounds their broadcast. For any radius but 2
    nodes of large buckets are searched by pairs of blocks instead:
    exact too, but quadratic in their number. The radius has to be below the number of bits.
    """
    parts = plan(nodes, radius) if parts is None else parts
    dealt = nodes.select("fp", F.explode(probes(F.col("fp"), parts)).alias("p")).select("p.part", "p.value", "fp")
    total = nodes.count() * sum(len(_flips(b, t)) for b, t in parts)
    common = dealt.groupBy("part", "value").count().where(F.col("count") > max(bucket, total // 1000)).select("part", "value").collect()
    hot, rare = nodes.where("false"), dealt
    if common:
        keys = F.broadcast(nodes.sparkSession.createDataFrame([(r.part, r.value) for r in common], "part int, value long"))
        hot = dealt.join(keys, ["part", "value"], "left_semi").select("fp")
        rare = dealt.join(keys, ["part", "value"], "left_anti")
    n = max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = materialize(rare.repartition(n, "part", "value").sortWithinPartitions("part", "value", "fp").mapInPandas(_search(radius, bucket), "a long, b long"), "found")
    crowded = found.where("b is null").select(F.col("a").alias("fp")).union(hot).distinct()
    more = by_flips(crowded) if radius == 2 else by_blocks(materialize(crowded, "crowded"), radius)
    return found.where("b is not null").union(more)


# ---------------------------------------------------------------- components


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b), root the least node reachable.

    Each round takes the least root among neighbours, then the root of that root; rounds end when no
    root changes. Each round's table is written to the shared folder, so that plans stay short and a
    lost executor costs one round at most. Only a count comes back to the driver.
    """
    edges = materialize(pairs.select(F.col("a"), F.col("b")).union(pairs.select("b", "a")).distinct(), "edges")
    roots = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    while True:
        near = edges.join(roots, edges.b == roots.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near, roots.node == near.a).select("node", "root", F.least("root", "near").alias("next"))
        lower = materialize(lower, "lower")
        up = lower.select(F.col("node").alias("at"), F.col("next").alias("jump"))
        new = materialize(lower.join(up, lower.next == up["at"]).select("node", F.col("root").alias("was"), F.least("next", "jump").alias("root")), "roots")
        roots = new.select("node", "root")
        if not new.where("was <> root").limit(1).count():
            return roots


# ---------------------------------------------------------------- wide radii

#: Bits of a wide fingerprint, and the chance that two of them at the radius itself never meet.
WIDE_BITS, MISS = 256, 0.001


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles of a whole text, rising; words and shingles as in :func:`fingerprint`."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else [b" ".join(w)] if w else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in joined), np.uint64))


def wide_fingerprint(text: str | None, words: int = 5) -> np.ndarray:
    """Four longs: a SimHash of :data:`WIDE_BITS` bits over the :func:`shingles` of a text."""
    return _wide(shingles(text, words))


def _wide(h: np.ndarray) -> np.ndarray:
    counts = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        for k in range(WIDE_BITS // 64):
            x = h[at : at + (1 << 14)] + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & ((1 << 64) - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            counts[64 * k : 64 * k + 64] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(h), bitorder="little").view("<i8")


#: Standard errors over the expected number of differing bits, up to which documents that meet are candidates: far from every
#: pair at the similarity, small sets too, and about six errors below the bits by which strangers differ.
REACH = 7.0
#: Documents to leave out up to which their table goes to every executor instead of all texts through a shuffle.
FEW = 1_000_000


def wide_radius(similarity: float, errors: float = 1.0) -> int:
    """Differing bits to allow for a Jaccard similarity: those expected of equally large sets, and ``errors`` standard errors."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE_BITS * p + errors * np.sqrt(WIDE_BITS * p * (1 - p)))


def meeting(size: int, far: int) -> float:
    """Chance that two wide fingerprints with ``far`` differing bits agree in ``size`` bits chosen without repeats."""
    return math.comb(WIDE_BITS - far, size) / math.comb(WIDE_BITS, size)


def sampling(count: int, radius: int) -> tuple[int, int]:
    """Bits in a sample, and samples, for ``count`` nodes: about a hundred evenly spread nodes share a key, and a pair at the radius misses all samples with :data:`MISS` at any count."""
    size = max(1, min(math.ceil(math.log2(count + 2)) - 7, WIDE_BITS - radius))
    once = meeting(size, radius)
    return size, 1 if once >= 1 else math.ceil(math.log(MISS) / math.log1p(-once))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of four longs."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(1, dtype=np.int64)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Those pairs (rows of two nodes) that join something new: as many components, no more pairs than nodes."""
    if not len(pairs):
        return pairs
    nodes, flat = np.unique(pairs, return_inverse=True)
    sets = Sets(len(nodes))
    return pairs[[sets.join(int(i), int(j)) for i, j in flat.reshape(-1, 2)]]


def _frame(pairs: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _meetings(radius: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows (key, node, f0 to f3) sorted by (key, node): each node within the radius of the first one with its key, linked to it. :func:`wide_links` doesn't use it: it compares all nodes of a key, by :func:`_compared`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            key, node = b["key"].to_numpy(), b["node"].to_numpy()
            if not len(key):
                continue
            fp = np.stack([b[f"f{k}"].to_numpy() for k in range(4)], 1)
            start = np.r_[last is None or last[0] != key[0], key[1:] != key[:-1]]
            place = np.maximum.accumulate(np.where(start, np.arange(len(key)), -1))
            first, near = node[place], fp[place]
            if last is not None:
                first[place < 0], near[place < 0] = last[1], last[2]
            last = (key[-1], first[-1], near[-1])
            meet = (first != node) & (_apart(fp, near) <= radius)
            yield _frame(forest(np.unique(np.stack([first[meet], node[meet]], 1), axis=0)))

    return run


#: Nodes of a bucket that are compared all with all at once; more are compared node by node.
SQUARE = 1024
#: A key that a sample shows to have more than one in so many of all nodes is searched block pair by block pair.
BLOCKS = 50


def joined(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of all pairs of rows of four longs within the radius, as positions.

    A row is compared with every row that isn't joined to anything yet, and with those it joins in turn:
    no pair that could join something new is left out, while close copies, which join at once, are cheap.
    """
    m = len(fp)
    if m <= SQUARE:
        u, far = np.ascontiguousarray(fp.T).view(np.uint64), np.zeros((m, m), np.uint16)
        for x in u:
            far += np.bitwise_count(x[:, None] ^ x[None])
        near = far <= radius
        left = np.flatnonzero(near.sum(1) > 1)
    else:
        near, left = None, np.arange(m)
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = _apart(fp[left], fp[i]) <= radius if near is None else near[i, left]
            if hit.any():
                found = left[hit].tolist()
                out += [(i, j) for j in found]
                front += found
                left = left[~hit]
    return out


def nearest_joined(fp: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest as :func:`joined`, of rows (i, j, differing bits), that prefers near pairs.

    Up to :data:`SQUARE` rows it is the one of least distances (grown row by row), so a pair is left out only where
    nearer ones connect it. More rows are joined within a third and two thirds of the radius first, then within all of it.
    """
    m = len(fp)
    out: list[tuple[int, int, int]] = []
    if m <= SQUARE:
        u, far = np.ascontiguousarray(fp.T).view(np.uint64), np.zeros((m, m), np.int16)
        for x in u:
            far += np.bitwise_count(x[:, None] ^ x[None])
        left = np.flatnonzero((far <= radius).sum(1) > 1)
        while len(left) > 1:
            at, left = left[0], left[1:]
            best, by = far[at, left], np.full(len(left), at)
            while len(left):
                k = int(best.argmin())
                if best[k] > radius:
                    break
                new = left[k]
                out.append((int(by[k]), int(new), int(best[k])))
                rest = np.arange(len(left)) != k
                left, best, by = left[rest], best[rest], by[rest]
                nearer = far[new, left] < best
                best, by = np.where(nearer, far[new, left], best), np.where(nearer, new, by)
        return np.array(out, np.int64).reshape(-1, 3)
    sets = Sets(m)
    for r in (radius // 3, 2 * radius // 3, radius):
        group = np.array([sets.root(i) for i in range(m)])
        order = np.argsort(group, kind="stable")
        cuts = np.r_[np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]), m]
        members = {int(group[order[a]]): order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
        left = order
        while len(left):
            own = group[left[0]]
            front, left = members[int(own)].tolist(), left[group[left] != own]
            while front and len(left):
                i = front.pop()
                d = _apart(fp[left], fp[i])
                hit = np.flatnonzero(d <= r)
                if not len(hit):
                    continue
                hit = hit[np.argsort(d[hit], kind="stable")]
                found, first = np.unique(group[left[hit]], return_index=True)
                for k in hit[first].tolist():
                    sets.join(int(i), int(left[k]))
                    out.append((int(i), int(left[k]), int(d[k])))
                    front += members[int(group[left[k]])].tolist()
                left = left[~np.isin(group[left], found)]
    return np.array(out, np.int64).reshape(-1, 3)


def _near_forest(links: np.ndarray) -> np.ndarray:
    """Rows (a, b, differing bits) that join something new, near ones first."""
    if not len(links):
        return links
    links = links[np.lexsort((links[:, 1], links[:, 0], links[:, 2]))]
    nodes, flat = np.unique(links[:, :2], return_inverse=True)
    sets = Sets(len(nodes))
    return links[[sets.join(int(i), int(j)) for i, j in flat.reshape(-1, 2)]]


def _weighted(radius: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """:func:`_compared` with the number of differing bits, ``d``, and near links preferred to far ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, fresh, n = np.zeros((0, 3), np.int64), [], 0
        for node, fp in _by_key(batches):
            if len(node) < 2:
                continue
            found = nearest_joined(fp, radius)
            if len(found):
                fresh.append(np.column_stack([node[found[:, :2]], found[:, 2]]))
                n += len(found)
            if n > 200_000 + len(links):
                links, fresh, n = _near_forest(np.concatenate([links, *fresh])), [], 0
        got = _near_forest(np.concatenate([links, *fresh]))
        del links, fresh
        give_back()
        yield _frame(got).assign(d=got[:, 2])

    return run


def _by_key(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and fingerprints of one key after another, of rows sorted by key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None
    for b in batches:
        key, node = b["key"].to_numpy(), b["node"].to_numpy()
        if not len(key):
            continue
        fp = np.stack([b[f"f{k}"].to_numpy() for k in range(4)], 1)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for at, end in zip(cuts, cuts[1:]):
            if held and last != key[at]:
                yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                held = []
            last = key[at]
            held.append((node[at:end], fp[at:end]))
    if held:
        yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])


def _compared(radius: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows (key, node, f0 to f3) sorted by key: links that join all nodes of a key within the radius, those that join nothing new left out. Holds one key's nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, fresh, n = np.zeros((0, 2), np.int64), [], 0
        for node, fp in _by_key(batches):
            if len(node) > 1 and (found := joined(fp, radius)):
                fresh.append(node[np.array(found)])
                n += len(found)
            if n > 200_000 + len(links):
                links, fresh, n = forest(np.unique(np.concatenate([links, *fresh]), axis=0)), [], 0
        yield _frame(forest(np.unique(np.concatenate([links, *fresh]), axis=0)))

    return run


def wide_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between nodes (``node``, ``fp`` of four longs) within a wide radius, each verified by all bits.

    For fingerprints alone; where texts are at hand, :func:`part_links` loses no pair.

    Thresholds that make sure of every pair need too many probes here: 46 of 256 bits would take
    hundreds of probes for each part. So the parts are many samples of bits, their threshold 0, and a
    pair is found with a probability: the number of samples grows with their bits (:func:`sampling`), so
    that at any number of nodes it is 1 - :data:`MISS` at the radius itself and more below it. All nodes of a bucket are compared (see :func:`joined`). A bucket
    that a sample of the nodes shows to be large isn't gathered: it is cut into blocks, and each pair
    of blocks is searched as a bucket of its own. A block has a fixed share of all nodes, so the rows
    grow with the input, not with its square. Links that join nothing new go away task by task,
    which changes no component, so there are fewer than nodes times tasks.
    """
    spark = nodes.sparkSession
    count = nodes.count()
    size, samples = sampling(count, radius)
    rng = np.random.default_rng(SEED)
    masks = np.zeros((samples, WIDE_BITS), np.uint8)
    for row in masks:
        row[rng.choice(WIDE_BITS, size, replace=False)] = 1
    masks = np.packbits(masks, axis=1, bitorder="little").view("<u8")
    odd = rng.integers(0, 1 << 63, (2, masks.shape[1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Keys (nodes x samples), nodes and fingerprints, some thousand nodes at a time."""
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                fp = np.stack(part["fp"].to_numpy()).astype(np.int64)
                x = (fp.view(np.uint64)[:, None, :] & masks[None]) * odd[0]
                x = ((x ^ (x >> np.uint64(29))) * odd[1]).sum(2, dtype=np.uint64)
                x = (x ^ (x >> np.uint64(32))) + np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                yield x.view(np.int64), part["node"].to_numpy(), fp

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, node, fp in keys_of(batches):
            yield pd.DataFrame({"key": key.ravel(), "node": np.repeat(node, samples), **{f"f{k}": np.repeat(fp[:, k], samples) for k in range(4)}})

    schema = "key long, node long, f0 long, f1 long, f2 long, f3 long"
    # At most BLOCKS keys for each sample of bits can hold more than one in BLOCKS of the nodes seen. Which are taken changes only how they are dealt.
    share = min(1.0, SAMPLE / max(count, 1))
    seen = nodes.where(luck("node") < share).mapInPandas(deal, schema).groupBy("key").agg(F.count("*").alias("n"))
    few = min(count, SAMPLE)
    large = seen.where(F.col("n") > max(64, few // BLOCKS)).toPandas().sort_values("key")
    known, blocks = large["key"].to_numpy(np.int64), np.ceil(large["n"].to_numpy(np.float64) * BLOCKS / max(few, 1)).astype(np.int64).clip(2)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows by key; nodes of a large key are dealt into blocks and go to each pair of blocks with theirs, under a key of that pair."""
        for f in deal(batches):
            if not len(known):
                yield f
                continue
            key, node = f["key"].to_numpy(), f["node"].to_numpy()
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[at] == key
            yield f[~hit]
            own = np.flatnonzero(hit)
            g = blocks[at[own]]
            block = (node[own].view(np.uint64) % g.view(np.uint64)).view(np.int64)
            for other in range(int(g.max(initial=0))):
                met = (other < g) & (other != block)
                low, high = np.minimum(block[met], other), np.maximum(block[met], other)
                pair = (low * BLOCKS * 2 + high + 1).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                yield f.iloc[own[met]].assign(key=(key[own[met]].view(np.uint64) ^ pair).view(np.int64))
        give_back()

    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = nodes.mapInPandas(spread, schema).repartition(n, "key").sortWithinPartitions("key")
    return met.mapInPandas(_compared(radius), "a long, b long")


# ---------------------------------------------------------------- parts of long fingerprints

#: Greatest numbers of shingles of the bands that documents are cut into by size: each 1.5625 times the one before.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(int(1.5625 * (BANDS[-1] + 1)))


def _mixed(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def band_parts(band: int, similarity: float) -> int:
    """Parts of a band's fingerprints: one more than shingles can differ between a set of the band and one as large or larger, and a
    quarter more to choose from."""
    most = int((1 - similarity) / similarity * BANDS[band] + 1e-6) + 1
    return most + most // 4 + 3


def bands_of(size: int, similarity: float) -> list[tuple[int, int]]:
    """Bands in which a set of ``size`` shingles is looked for, each with the shingles that can differ there: its own band, where partners
    are larger or of the band, and those below that hold smaller partners."""
    own = bisect.bisect_left(BANDS, size)
    out = [(own, int((1 - similarity) / similarity * size + 1e-6))]
    for band in range(own - 1, -1, -1):
        if BANDS[band] < similarity * size - 1e-6:
            break
        out.append((band, int((1 - similarity) / (1 + similarity) * (size + BANDS[band]) + 1e-6)))
    return out


def part_prints(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each part of the hashes ``h``; parts begin at ``starts``."""
    ends, out, at = np.r_[starts[1:], len(h)], np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 14), "right")))
        low = starts[at]
        bits = np.unpackbits(h[low : ends[to - 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.zeros((len(bits) + 1, BITS), np.int32)
        np.cumsum(bits, 0, out=sums[1:])
        counts = sums[ends[at:to] - low] - sums[starts[at:to] - low]
        out[at:to] = np.packbits(2 * counts > (ends[at:to] - starts[at:to])[:, None], axis=1, bitorder="little").view("<u8").ravel()
        at = to
    return out


def part_keys(h: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a set of shingles (distinct hashes): two sets of the similarity or more have one in common, always.

    The fingerprint is long: shingles are dealt into parts by their hash, and a part's 64 bits are the SimHash of its shingles, so
    bits that hang on the same shingles share a part. Sets that differ in D shingles differ in D parts at most. Thresholds are
    -1 (not used) or 0, D + 1 of them 0, so that their sum is D - parts + 1. A part's cost is the number of sets that share it,
    the less the more shingles it has, and -1 costs nothing: of all such thresholds the D + 1 largest parts cost least (what
    :func:`allot` gives), equal ones by key. That order is the same for every set, so of two sets' equal parts the first one
    has at most D parts before it on either side: both use it. Parts without shingles come last.
    """
    out = [np.zeros(0, np.uint64)]
    for band, far in bands_of(len(h), similarity) if len(h) else []:
        parts = band_parts(band, similarity)
        at = ((_mixed(h, 0x9E3779B97F4A7C15 + 2 * band) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(at, kind="stable")
        ordered = at[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        key = _mixed(part_prints(h[order], starts) + ordered[starts] * np.uint64(0xD6E8FEB86659FD93), 0xBF58476D1CE4E5B9 + 2 * band)
        if len(key) > far:
            out.append(key[np.lexsort((key, -sizes))[: far + 1]])
            continue
        empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), ordered[starts])[: far + 1 - len(key)]
        out += [key, _mixed(empty * np.uint64(0xD6E8FEB86659FD93), 0x94D049BB133111EB + 2 * band)]
    return np.concatenate(out).view(np.int64)


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows (key, node) sorted by both: for a key of several nodes a row (group, node) for each of them, ``group`` a hash of all of them. Groups that come up again soon are left out."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> pd.DataFrame:
        key, node = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[new], node[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        group = np.add.reduceat(_mixed(node.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15), 0x94D049BB133111EB), starts)
        several = np.flatnonzero(sizes > 1)
        taken = np.zeros(len(starts), bool)
        taken[several[np.unique(group[several], return_index=True)[1]]] = True
        rows = np.repeat(taken, sizes)
        return pd.DataFrame({"group": np.repeat(group, sizes)[rows].view(np.int64), "node": node[rows]})

    for b in batches:
        key, node = b["key"].to_numpy(), b["node"].to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if held and (cut or held[-1][0][-1] != key[0]):
            held.append((key[:cut], node[:cut]))
            yield close()
            held = []
        elif cut:
            held.append((key[:cut], node[:cut]))
            yield close()
            held = []
        held.append((key[cut:], node[cut:]))
    if held:
        yield close()
    give_back()


#: Nodes of a group that one task compares; larger groups are searched by pairs of blocks of so many, or of a share of all nodes if that is more.
GROUP = 4096


def part_links(prints: DataFrame, nodes: DataFrame, reach: int) -> DataFrame:
    """Links (a, b, d) between nodes that share one of their parts' keys (``prints``: node, keys) and differ in ``d`` bits, ``reach`` at most.

    Nodes with a key in common are a group, compared once however many keys give it, all with all (:func:`nearest_joined`). A large
    group is cut into blocks of at least a :data:`BLOCKS`-th of all nodes, each pair of blocks a group of its own, so rows
    grow with the input, not with its square.
    """
    n = max(8, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates("node")
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                keys = part["keys"].tolist()
                yield pd.DataFrame({"key": np.concatenate(keys).astype(np.int64), "node": np.repeat(part["node"].to_numpy(), [len(k) for k in keys])})
            give_back()

    dealt = prints.select("node", "keys").mapInPandas(deal, "key long, node long").repartition(n, "key").sortWithinPartitions("key", "node")
    groups = materialize(dealt.mapInPandas(_shared, "group long, node long").distinct(), "groups")
    block = max(GROUP, nodes.count() // BLOCKS)
    large = groups.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).where("blocks > 1")
    cut = groups.join(F.broadcast(large), "group", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = cut.select("group", "node", "own", other.alias("other")).where("own <> other")
    key = F.when(F.col("other") < 0, F.col("group")).otherwise(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")))
    keyed = pairs.select(key.alias("key"), "node").join(nodes.select("node", *(F.col("fp")[k].alias(f"f{k}") for k in range(4))), "node")
    return keyed.select("key", "node", "f0", "f1", "f2", "f3").repartition(n, "key").sortWithinPartitions("key").mapInPandas(_weighted(reach), "a long, b long, d long")


def _wide_prints(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """A written table with a row per document: ``id``, ``mark`` (a hash of the text), ``fp``, ``keys`` of its parts, ``node`` (a hash of ``fp``)."""

    def run(texts: list) -> dict:
        sets = [shingles(t, words) for t in texts]
        return {"fp": [_wide(h) for h in sets], "keys": [part_keys(h, similarity) for h in sets]}

    text = F.col(f"`{text_col}`").cast("string")
    print_ = text_struct(text, "fp array<long>, keys array<long>", lambda: run)
    made = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), print_.alias("print"))
    return materialize(made.select("id", "mark", "print.fp", "print.keys").withColumn("node", F.xxhash64("fp")), "prints")


def stars(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the same components: each task of a read links every node to the least one that its own pairs lead to.

    Tasks that know the same group give the same pairs, so these are distinct soon. A task holds the
    pairs of its split.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros((0, 2), np.int64), *(np.stack([b["a"].to_numpy(), b["b"].to_numpy()], 1) for b in batches)]
        nodes, flat = np.unique(np.concatenate(held), return_inverse=True)
        sets = Sets(len(nodes))
        for i, j in flat.reshape(-1, 2).tolist():
            sets.join(i, j)
        root = np.array([sets.root(i) for i in range(len(nodes))], np.int64)
        far = np.flatnonzero(root != np.arange(len(nodes)))
        yield _frame(np.stack([nodes[root[far]], nodes[far]], 1)) if len(far) else _frame(np.zeros((0, 2), np.int64))

    return pairs.mapInPandas(run, "a long, b long").distinct()


#: Links of one group of candidates that one task thins out, about. Groups with more are at most one for so many links of all, which bounds their broadcast.
THIN = 5_000


def _thinned(found: DataFrame) -> DataFrame:
    """Links (a, b) of the candidates' groups, most of those that nearer links make needless left out.

    A group's links meet in one task, or in as many as their number asks for.
    """
    roots = components(materialize(stars(found.select("a", "b")), "near"))
    known = materialize(found.join(roots, found.a == roots.node).select("a", "b", "d", "root"), "rooted_links")
    sizes = known.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / THIN).alias("parts")).where("parts > 1")
    dealt = known.join(F.broadcast(sizes), "root", "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros((0, 3), np.int64), *(b[["a", "b", "d"]].to_numpy(np.int64) for b in batches)]
        yield _frame(_near_forest(np.concatenate(held)))
        del held
        give_back()

    return dealt.select("root", "part", "a", "b", "d").repartition("root", "part").mapInPandas(run, "a long, b long").distinct()


def _verified(found: DataFrame, docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """Links (a, b) whose texts' sets of shingles have the similarity: the sets of linked nodes alone are made, each from one text."""
    pairs = materialize(_thinned(found), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = prints.join(ends, "node").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("doc"))
    asked = materialize(one.select("node", F.col("doc.id").alias("asked_id"), F.col("doc.mark").alias("asked_mark")), "asked")
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    keys = F.broadcast(asked) if asked.count() <= FEW else asked
    met = texts.join(keys, (texts["mark"] == keys["asked_mark"]) & texts["id"].eqNullSafe(keys["asked_id"]))
    run = lambda ts: {"set": [shingles(t, words).view(np.int64) for t in ts]}
    # Rows that repeat id and text give one set.
    sets = materialize(met.select("node", text_struct("text", "set array<long>", lambda: run)["set"].alias("set")).groupBy("node").agg(F.min("set").alias("set")), "sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("s")), sets.select(F.col("node").alias("b"), F.col("set").alias("t"))
    shared = F.size(F.array_intersect("s", "t"))
    return pairs.join(left, "a").join(right, "b").where(shared >= similarity * (F.size("s") + F.size("t") - shared) - 1e-9).select("a", "b")


def _grouped(prints: DataFrame, first: Column, docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, errors: float) -> DataFrame:
    """``prints`` with ``component_id``, the least ``first`` of the linked nodes; nulls in it don't count."""
    nodes = materialize(prints.groupBy("node").agg(F.min(first).alias("least"), F.min("fp").alias("fp")), "nodes")
    found = materialize(part_links(prints, nodes, wide_radius(similarity, errors)), "found")
    links = materialize(_verified(found, docs, prints, id_col, text_col, words, similarity), "links")
    return _named(prints, nodes, components(links), "node")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, errors: float = REACH) -> DataFrame:
    """One row per document: id and ``component_id``, the least id among documents that links lead to.

    A link is a pair of texts of a similarity (of their sets of shingles) of ``similarity`` or more: such texts agree in one of the parts
    of their long fingerprints (:func:`part_keys`), and of those that do, wide fingerprints up to ``errors`` standard errors over the expected
    distance make candidates; their sets decide. Equal wide fingerprints count as equal texts. Null and empty texts are copies of each other. Ids are handled as in :func:`near_duplicates`.
    """
    found = _grouped(_wide_prints(docs, id_col, text_col, words, similarity), F.col("id"), docs, id_col, text_col, words, similarity, errors)
    return found.select(F.col("id").alias(id_col), "component_id")


def _named(prints: DataFrame, nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Each row of ``prints`` with the least id of its component; ``nodes`` has the least id of each ``key``."""
    known = roots.select(F.col("node").alias("__n"), "root")
    rooted = materialize(nodes.join(known, nodes[key] == known["__n"], "left").select(key, "least", F.coalesce("root", key).alias("root")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialize(rooted.select(key, "root").join(least, "root").select(key, "component_id"), "named")
    return prints.join(named, key)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """One row per document: id, ``fp`` (signed long) and ``component_id``, the least id of its component.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat an id are
    results of their own; a null id counts in no minimum, so a component of null ids only has a null id.
    """
    prints = materialize(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col).cast("string"), words).alias("fp")), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, bucket))
    return _named(prints, nodes, roots, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, errors: float = REACH) -> DataFrame:
    """One document of each component of :func:`near_copies`, the one with the least id, all columns as they were.

    A document is an id and a text: rows that repeat an id with other texts are judged on their own, so
    no text goes but for a copy of it. Of texts with the same least id in one component, that with the
    least hash stays; of rows that repeat id and text, that with the least hash of all columns (but maps). A row
    without an id can't be named by another: it stays. What goes is joined away by id and hash of the
    text: a written table, broadcast if it has no more than ``FEW`` rows.
    """
    prints = _wide_prints(docs, id_col, text_col, words, similarity)
    first = F.when(F.col("id").isNotNull(), F.struct("id", "mark"))
    found = _grouped(prints, first, docs, id_col, text_col, words, similarity, errors).where("id is not null")
    by_row = materialize(found.groupBy("id", "mark").agg((F.min("component_id") == F.struct("id", "mark")).alias("stays"), F.count("*").alias("n")), "by_row")
    gone = materialize(by_row.where("not stays or n > 1").select(F.col("id").alias("__gone_id"), F.col("mark").alias("__gone_mark")), "gone")
    if gone.count() <= FEW:
        gone = F.broadcast(gone)
    own = docs[f"`{id_col}`"], F.xxhash64(docs[f"`{text_col}`"].cast("string"))
    kept = docs.join(gone, (own[0] == gone["__gone_id"]) & (own[1] == gone["__gone_mark"]), "left_anti")
    again = by_row.where("stays and n > 1").select(F.col("id").alias("__again_id"), F.col("mark").alias("__again_mark"))
    if not again.limit(1).count():
        return kept
    rows = docs.join(again, (own[0] == again["__again_id"]) & (own[1] == again["__again_mark"]), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    packed = rows.select(F.struct(*columns).alias("row"), F.xxhash64(*plain).alias("hash"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark"))
    return kept.unionByName(packed.groupBy("id", "mark").agg(F.min_by("row", "hash").alias("row")).select("row.*"))
