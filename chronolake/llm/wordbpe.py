"""Word-level BPE ids for many words at once, as the tokenizers library gives them.

Words made of Latin letters, with or without punctuation behind them, are merged together in numpy;
all other words go through the library itself. What counts as plain is chosen so that the library's
normalisation (NFC, lower case) and its word pattern do nothing to it that isn't done here.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
from tokenizers import Tokenizer

from chronolake.llm.chunks import ChunkTable, gather
from chronolake.llm.common import kept

#: Latin letters whose lower case is one character for one and that NFC leaves alone, then at most one run of punctuation.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#$%&*-]*)")

#: Distinct words, and parts of words, whose ids an encoder keeps.
TABLE = 400_000


def byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256 up."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Merges:
    """The merges of a BPE file, applied to many words at once: the lowest rank first, from the left."""

    NONE = np.int32(1 << 30)

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, tail = model["vocab"], model["end_of_word_suffix"] or ""
        names = byte_names()
        self.first = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + tail] for c in names], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at], self.NONE)

    def encode(self, words: list[bytes]) -> np.ndarray:
        """Ids of each word, a non-empty string of bytes, as a row that is filled up with -1."""
        sizes = np.array([len(w) for w in words])
        wide = int(sizes.max())
        raw = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(-1, wide)
        place = np.arange(wide)
        ids = np.where(place < sizes[:, None] - 1, self.first[raw], self.last[raw])
        ids[place >= sizes[:, None]] = -1
        rank = np.full(ids.shape, self.NONE, np.int32)
        rank[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        done, rows = ids.copy(), np.arange(len(words))
        while len(rows):
            p = rank.argmin(1)
            best = rank[np.arange(len(rows)), p]
            go = best < self.NONE
            if not go.all():
                done[rows[~go], : ids.shape[1]] = ids[~go]
                done[rows[~go], ids.shape[1] :] = -1
                ids, rank, rows, p, best = ids[go], rank[go], rows[go], p[go], best[go]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            shift = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > p[:, None])
            ids[k, p] = self.made[best]
            ids, rank = np.take_along_axis(ids, shift, 1), np.take_along_axis(rank, shift, 1)
            # Only the pairs to the left and right of the new id have changed.
            right = np.where(p + 1 < ids.shape[1], ids[k, np.minimum(p + 1, ids.shape[1] - 1)], -1)
            rank[k, p] = self._ranks(ids[k, p], right)
            left = np.maximum(p - 1, 0)
            rank[k, left] = np.where(p > 0, self._ranks(ids[k, left], ids[k, p]), rank[k, left])
        return done.astype(np.int32)


class WordEncoder:
    """Ids of whole texts by a tokenizer whose tokens never cross white space, from a table of distinct words.

    Words are cut at ASCII white space only; other white space stays inside a word, where the
    library itself deals with it.
    """

    def __init__(self, path: str, most: int = TABLE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.t, self.merges = Tokenizer.from_file(path), Merges(path)
        self.table, self.parts = ChunkTable(self._words, most), ChunkTable(self._parts, most)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, np.int32)

    def _words(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words, all their ids, and how many each has. Letters and punctuation of plain words are looked up on their own: many words differ in case and punctuation only."""
        parts, counts = [], np.ones(len(words), np.int64)
        for k, w in enumerate(words):
            m = _PLAIN.fullmatch(w.decode("utf-8", "surrogatepass")) if len(w) <= self.table.long else None
            if not m:
                parts.append(w)
                continue
            letters, tail = m.groups()
            parts.append(letters.lower())
            if tail:
                parts.append(tail.encode())
                counts[k] = 2
        ids, sizes = self.parts.lookup(parts)
        return words, ids, np.add.reduceat(sizes, np.cumsum(counts) - counts)

    def _parts(self, parts: list[str | bytes]) -> tuple[list[str | bytes], np.ndarray, np.ndarray]:
        """Letters (as str) by merging, all else (as bytes) by the library: the parts in an order of its own, all their ids, and how many each has."""
        order = [p for p in parts if isinstance(p, bytes)]
        flat, sizes = gather([self._library(p.decode("utf-8", "surrogatepass")) for p in order])
        flat, sizes = [flat], [sizes]
        letters = sorted((p for p in parts if isinstance(p, str)), key=len)
        for at in range(0, len(letters), 8192):
            rows = self.merges.encode([p.encode() for p in letters[at : at + 8192]])
            flat.append(rows[rows >= 0])
            sizes.append((rows >= 0).sum(1))
        return order + letters, np.concatenate(flat), np.concatenate(sizes)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; null counts as empty."""
        return self.table.texts([(t or "").encode("utf-8", "surrogatepass").split() for t in texts])


def encoder(path: str, most: int = TABLE) -> WordEncoder:
    """The worker's encoder, whose table stays from task to task until another operator starts in the worker."""
    return kept(WordEncoder, path, most)
