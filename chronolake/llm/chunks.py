"""A table of distinct chunks: each chunk is encoded once, texts are put together from the table by position."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np


class ChunkTable:
    """Ids of distinct chunks, kept between batches of a worker up to about ``most`` chunks.

    ``encode`` gets a list of chunks that aren't in the table yet and returns them in any order, all
    their ids in one array, and how many each has. Beyond ``most`` the table starts anew, which costs encoding again
    and nothing else. Chunks longer than ``long`` characters are encoded but not kept.
    """

    def __init__(self, encode: Callable[[list], tuple[list, np.ndarray, np.ndarray]], most: int = 400_000, long: int = 200) -> None:
        self.encode, self.most, self.long = encode, most, long
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.n = self.used = 0

    def _add(self, chunks: list) -> None:
        chunks, ids, sizes = self.encode(chunks)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(chunks) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.n + 1 : self.n + 1 + len(chunks)] = self.used + np.cumsum(sizes)
        self.index.update(zip(chunks, range(self.n, self.n + len(chunks)), strict=True))
        self.n += len(chunks)
        self.used += len(ids)

    def lookup(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks in order, and the number of ids of each chunk."""
        if self.n > self.most or self.used > 8 * self.most:
            self.clear()
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            absent = [chunks[i] for i in missing]
            new = list(dict.fromkeys(absent))
            self._add(new)
            at[missing] = [self.index[c] for c in absent]
            for c in new:  # its ids stay until the table starts anew, its text doesn't
                if len(c) > self.long:
                    del self.index[c]
        first = self.starts[at]
        sizes = self.starts[at + 1] - first
        ends = np.cumsum(sizes)
        # Position k of a chunk reads table place first + k.
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
        return self.ids[where], sizes

    def texts(self, parts: list[list]) -> list[np.ndarray]:
        """The ids of each text, given as a list of chunks."""
        ids, sizes = self.lookup([c for p in parts for c in p])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return [ids[a:b] for a, b in zip(ends[at[:-1]].tolist(), ends[at[1:]].tolist(), strict=True)]


def gather(out: list) -> tuple[np.ndarray, np.ndarray]:
    """A list of id arrays as one array and sizes."""
    return (np.concatenate(out) if out else np.zeros(0, np.int32)).astype(np.int32), np.array([len(x) for x in out], np.int64)
