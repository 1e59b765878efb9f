"""SentencePiece encoding and decoding over a table of distinct marked words.

No piece of the model has a marker after another character, so no piece crosses from a word into the
marker of the next one: a text's pieces are those of its marked words, one after the other. The table
holds each distinct marked word (its markers, then its characters up to the next marker) once for
each worker, and the ids are joined back by position. :func:`crossing` looks for pieces that would
break this; a model that has one is encoded text by text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm.chunks import ChunkTable, gather
from chronolake.llm.common import text_struct

MARK = "▁"
#: Chunks of a text with adjacent markers: markers and what follows up to the next, cut before each line break too.
_CHUNK = re.compile(r"▁+[^▁\n]*|\n[^▁\n]*|[^▁\n]+")


@functools.lru_cache(maxsize=4)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def crossing(path: str) -> bool:
    """Whether marked words can't be encoded apart: a piece has a marker inside it or holds a line break, the model
    normalises text or drops white space, or it has pieces of its user's own."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(processor(path).serialized_model_proto())
    n = m.normalizer_spec
    plain = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
    ordinary = not m.trainer_spec.treat_whitespace_as_suffix and m.trainer_spec.byte_fallback and m.trainer_spec.model_type == 2
    return not (plain and ordinary) or any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece or p.type == 4 for p in m.pieces)


class Encoder:
    """Encodes and decodes whole texts exactly as the library does."""

    def __init__(self, path: str, begin: bool = True, end: bool = True) -> None:
        self.sp, self.whole = processor(path), crossing(path)
        self.first = [self.sp.bos_id()] if begin else []
        self.last = [self.sp.eos_id()] if end else []
        self.table = ChunkTable(self._chunks)
        if not self.whole:
            self.mark, self.line = self.sp.piece_to_id(MARK), self.sp.encode("\n")[-1]
            n = self.sp.get_piece_size()
            self.marked = np.fromiter((self.sp.id_to_piece(i).startswith(MARK) for i in range(n)), bool, n)

    def _chunks(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Ids of distinct chunks. Most are a word after one marker (kept without it) or after a line break.

        Such chunks are encoded many at a time: each has just one piece that begins with the marker, or
        just one line break, at its start, and there the ids are cut. Others, with several markers, are encoded alone.
        """
        out: list = [None] * len(chunks)
        words, lines = [], []
        for k, c in enumerate(chunks):
            if c[:1] == "\n":
                lines.append(k)
            elif c[:1] == MARK:
                out[k] = np.array(self.sp.encode(c[1:].replace(MARK, " ")) if c != MARK else [self.mark], np.int32)
            else:
                words.append(k)
        for members, joined, starts in ((words, " ", lambda x: self.marked[x]), (lines, "", lambda x: x == self.line)):
            for at in range(0, len(members), 2000):
                some = members[at : at + 2000]
                ids = np.array(self.sp.encode(joined.join(chunks[k] for k in some)), np.int32)
                ids = ids[not joined :]  # the marker that the library puts before a line break
                cut = np.flatnonzero(starts(ids)).tolist()
                for k, a, b in zip(some, cut, [*cut[1:], len(ids)], strict=True):
                    out[k] = ids[a:b]
        return chunks, *gather(out)

    def _cut(self, text: str) -> list[str]:
        """A text's chunks: words after a single marker without it, others with their markers or line break."""
        if not text:
            return []
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or MARK in text:
            parts = _CHUNK.findall(MARK + text.replace(" ", MARK))
            parts = [c[1:] if c[0] == MARK and len(c) > 1 and c[1] != MARK else c for c in parts]
        return parts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = [t or "" for t in texts]
        if self.whole:
            return [np.array([*self.first, *x, *self.last], np.int32) for x in self.sp.encode(texts, num_threads=1)]
        return [np.concatenate([self.first, x, self.last]).astype(np.int32) for x in self.table.texts([self._cut(t) for t in texts])]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.sp.decode([x.tolist() for x in ids], num_threads=1)


@functools.lru_cache(maxsize=4)
def encoder(path: str, begin: bool = True, end: bool = True) -> Encoder:
    """The worker's encoder, whose table stays from task to task."""
    return Encoder(path, begin, end)


def encode(text: Column | str, path: str, begin: bool = True, end: bool = True) -> Column:
    """Array of the ids of each whole text; null counts as empty."""

    def start() -> Callable[[list], dict]:
        coder = encoder(path, begin, end)
        return lambda texts: {"ids": coder.encode(texts)}

    return text_struct(text, "ids array<int>", start)["ids"]


def decode(ids: Column | str, path: str) -> Column:
    """Text of each array of ids; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = processor(path)
        for s in batches:
            yield pd.Series([None if x is None else sp.decode([int(i) for i in x]) for x in s], dtype=object)

    return run(ids if isinstance(ids, Column) else F.col(ids))


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of ids with begin and end, digests of the ids and of the text decoded from them."""

    def start() -> Callable[[list], dict]:
        coder = encoder(path)

        def run(texts: list) -> dict:
            ids = coder.encode(texts)
            return {
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                "decoded_sha256": [sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in coder.decode(ids)],
            }

        return run

    return docs.select(F.col(id_col), text_struct(F.col(text_col).cast("string"), SCHEMA, start).alias("d")).select(id_col, "d.*")
