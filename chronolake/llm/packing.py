"""Harmonic packing of token ids into sequences of fixed capacity.

A document of length in (capacity / (k + 1), capacity / k] is of class k and stays whole: k documents
of a class share a sequence, so each worker fills its sequences by count alone, without a shuffle.
What they leave free is filled by documents that come later: whole where one fits, and cut to fit once
much room is free. So sequences have next to no padding, and only cut fillers and documents over the
capacity (whole sequences first, the rest as if it were a document) are in more than one piece.
Lengths up to ``capacity // classes`` are one class, whose sequence is full when the next document
doesn't fit. What is part full when a worker ends is laid end to end, cut at the capacity; the last such
run is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import STEP_CHARS, give_back, slices
from chronolake.llm.wordbpe import TABLE, encoder

CAPACITY, CLASSES, END = 4096, 64, 2
#: Free ids of a sequence that are padded instead of filled, and free sequences' worth of room from which on documents are cut to fill it.
SLACK, FREE = 32, 4


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the parts of ``n`` ids: whole sequences, then the rest."""
    return [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)


class Packer:
    """Takes pieces up to the capacity, gives placed pieces: (piece, sequence, offset). A piece is a tuple (key, start, length, ...).

    Free room waits in ``open``; it is at most ``FREE + 1`` sequences' worth.
    """

    def __init__(self, capacity: int, sequence: int, halve: Callable[[tuple, int], tuple[tuple, tuple]], classes: int = CLASSES, slack: int = SLACK) -> None:
        self.capacity, self.sequence, self.halve, self.classes, self.slack = capacity, sequence, halve, classes, slack
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.short = 0
        self.open: list[tuple[list[tuple], int]] = []
        self.room = 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple[tuple, int, int]]:
        at = 0
        for p in pieces:
            yield p, self.sequence, at
            at += p[2]
        self.sequence += 1

    def _full(self, k: int) -> Iterator[tuple[tuple, int, int]]:
        """The sequence of a class, closed or left open for fillers."""
        pieces = self.waiting.pop(k)
        room = self.capacity - sum(p[2] for p in pieces)
        if room <= self.slack:
            yield from self._close(pieces)
        else:
            self.open.append((pieces, room))
            self.room += room

    def _fill(self, piece: tuple, at: int) -> Iterator[tuple[tuple, int, int]]:
        """Put a piece into an open sequence, and what doesn't fit into those with most room."""
        rest: tuple | None = piece
        while rest:
            piece, (pieces, room) = rest, self.open[at]
            rest = None
            if piece[2] > room:
                piece, rest = self.halve(piece, room)
            pieces.append(piece)
            self.room -= piece[2]
            if piece[2] + self.slack < room:
                self.open[at] = (pieces, room - piece[2])
            else:
                self.room -= room - piece[2]
                self.open.pop(at)
                yield from self._close(pieces)
            if rest:
                at = max(range(len(self.open)), key=lambda i: self.open[i][1])

    def add(self, piece: tuple) -> Iterator[tuple[tuple, int, int]]:
        n = piece[2]
        fits = [i for i, (_, room) in enumerate(self.open) if room >= n]
        if fits:
            yield from self._fill(piece, min(fits, key=lambda i: self.open[i][1]))
            return
        if self.room >= max(FREE * self.capacity, n + self.slack * len(self.open)):
            yield from self._fill(piece, max(range(len(self.open)), key=lambda i: self.open[i][1]))
            return
        k = min(self.capacity // n, self.classes)
        if k == self.classes:
            if self.short + n > self.capacity:
                yield from self._full(k)
                self.short = 0
            self.short += n
        self.waiting[k].append(piece)
        if k < self.classes and len(self.waiting[k]) == k:
            yield from self._full(k)

    def finish(self) -> Iterator[tuple[tuple, int, int]]:
        rest = deque(p for pieces in [*(x for x, _ in self.open), *(self.waiting[k] for k in sorted(self.waiting))] for p in pieces)
        self.open.clear()
        self.waiting.clear()
        self.room = self.short = 0
        left = sum(p[2] for p in rest)
        while rest:
            # A whole sequence while there is one, then the greatest power of two that is left.
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            run = []
            while room:
                p = rest.popleft()
                if p[2] > room:
                    p, tail = self.halve(p, room)
                    rest.appendleft(tail)
                run.append(p)
                room -= p[2]
            yield from self._close(run)


def _schema(kind: pa.DataType, with_ids: bool) -> pa.Schema:
    fields = [("id", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    return pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = True, table: int = TABLE, step: int = STEP_CHARS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` its ids.

    Each document's ids end with ``end``; a null or empty text has that id alone. Repeated rows are
    documents of their own. Workers number sequences apart from each other: the partition's number,
    then a running number. ``table`` (distinct words whose ids a worker keeps) and ``step`` (bytes of
    text encoded at once) change memory and time only.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, table)

        def halve(p: tuple, n: int) -> tuple[tuple, tuple]:
            key, start, length, total, ids = p
            return (key, start, n, total, ids[:n]), (key, start + n, length - n, total, ids[n:])

        packer = Packer(capacity, TaskContext.get().partitionId() << 36, halve)
        schema = None

        def rows(placed: list[tuple[tuple, int, int]]) -> pa.RecordBatch:
            columns = [
                [p[0] for p, _, _ in placed],
                [p[1] for p, _, _ in placed],
                [p[2] for p, _, _ in placed],
                [zlib.crc32(p[4].tobytes()) for p, _, _ in placed],
                [p[3] for p, _, _ in placed],
                [s for _, s, _ in placed],
                [o for _, _, o in placed],
                *([[p[4] for p, _, _ in placed]] if with_ids else []),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            schema = schema or _schema(b.schema.field(0).type, with_ids)
            keys, column, at = b.column(0).to_pylist(), b.column(1), 0
            del b
            for texts in slices(column, step):
                placed = []
                for ids in coder.encode(texts):
                    ids = np.append(ids, np.int32(end)).astype("<i4")
                    start = 0
                    for n in cuts(len(ids), capacity):
                        placed += packer.add((keys[at], start, n, len(ids), ids if n == len(ids) else ids[start : start + n].copy()))
                        start += n
                    at += 1
                if placed:
                    yield rows(placed)
            del column
            give_back()
        if schema and (placed := list(packer.finish())):
            yield rows(placed)

    out = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)
    return packed.withColumnRenamed("id", id_col)
