"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only
that reply is trainable. Turns after the last reply form a last example in which nothing is
trainable, so that a conversation's examples hold all of its turns.

A turn is ``<|im_start|>role`` + line break + text + ``<|im_end|>`` + line break. Control strings in
roles and texts are broken by a backslash after their first character and backslashes are doubled,
so that no text can end a turn and :func:`unescape` gives it back unchanged.

Rows of a conversation stream through one task in the order of their turns; a task holds one
conversation's formatted text at a time. Null roles and texts count as empty, null turns come first,
equal turns go by role and text, and null conversation ids make one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates use for control.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"((?:\\.|[^\\\n])*)\n", re.DOTALL)
TARGET = "assistant"
#: Characters of examples that one batch holds; a longer example is a batch of its own.
BATCH_CHARS = 8_000_000


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where the text in it starts and ends."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse_turns(formatted: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and start and end of the text, of each turn from ``at`` on."""
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        role = _ROLE.match(formatted, at + len(OPEN))
        end = formatted.find(CLOSE, role.end()) if role else -1
        if end < 0 or formatted[end + len(CLOSE) : end + len(CLOSE) + 1] != "\n":
            raise ValueError(f"the turn at {at} has no end")
        yield unescape(role[1]), unescape(formatted[role.end() : end]), role.end(), end
        at = end + len(CLOSE) + 1


def _text(value: object) -> str:
    return value if isinstance(value, str) else ""


def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows ``conv, role, text`` in order: examples ``conv, example, text, loss_start, loss_end``.

    Both ends of the loss are null in an example of turns that no reply follows.
    """
    key: object = None
    parts: list[str] = []
    size = number = told = 0
    begun = False
    out: list[tuple] = []
    held = 0

    def rest() -> tuple | None:
        return (key, number, "".join(parts), None, None) if begun and told < len(parts) else None

    for b in batches:
        for conv, role, text in zip(b["conv"].tolist(), b["role"].tolist(), b["text"].tolist(), strict=True):
            if not begun or conv != key:
                if last := rest():
                    out.append(last)
                    held += size
                key, parts, size, number, told, begun = conv, [], 0, 0, 0, True
            role = _text(role)
            turn, a, z = format_turn(role, _text(text))
            parts.append(turn)
            if role == TARGET:
                parts = ["".join(parts)]
                out.append((key, number, parts[0], size + a, size + z))
                number += 1
                told = len(parts)
                held += len(parts[0])
            size += len(turn)
            if held > BATCH_CHARS:
                yield _examples(out)
                out, held = [], 0
    if last := rest():
        out.append(last)
    if out:
        yield _examples(out)


def _examples(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv", "example", "text", "loss_start", "loss_end"], dtype=object)
    return out.astype({"loss_start": "Int64", "loss_end": "Int64", "example": "Int64"})


EXAMPLES = "conv string, example long, text string, loss_start long, loss_end long"


def ordered(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, role, text``: each conversation in one partition, in the order of its turns, sorted on disk where memory ends.

    ``conv`` is the id as text, so that ids beside nulls keep all their digits in pandas; ids may be
    numbers or text. Turns are numbers.
    """
    rows = turns.select(F.col(id_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    n = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text").select("conv", "role", "text")


def examples(turns: DataFrame, **columns: str) -> DataFrame:
    """The examples of all conversations; a conversation's come together, in order. ``loss_start`` and ``loss_end`` are code points of ``text``."""
    return ordered(turns, **columns).mapInPandas(expand, EXAMPLES).withColumn("conv", F.col("conv").cast(_id_type(turns, **columns)))


def _id_type(turns: DataFrame, id_col: str = "conv_id", **_: str) -> str:
    return turns.schema[id_col].dataType.simpleString()


class _Reader:
    """Digests of one conversation, taken from its examples alone."""

    def __init__(self, key: object) -> None:
        self.key, self.seen = key, ""
        self.turns, self.loss = sha256(), sha256()
        self.n_turns = self.loss_chars = self.formatted = 0

    def add(self, text: str, start: object, end: object) -> None:
        # An example repeats the one before it and adds turns; only these are parsed.
        if not text.startswith(self.seen):
            raise ValueError(f"an example of conversation {self.key} doesn't continue the one before")
        for role, body, _, _ in parse_turns(text, len(self.seen)):
            self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        if not pd.isna(start):
            body = unescape(text[int(start) : int(end)])
            self.loss.update(body.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(body)
        self.formatted += len(text)
        self.seen = text

    def row(self) -> tuple:
        return self.key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


DIGESTS = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From examples in order: one row per conversation with its turns and its trainable text, as read from the formatted examples."""
    columns = [x.split()[0] for x in DIGESTS.split(", ")]
    reader: _Reader | None = None
    done: list[tuple] = []

    def frame() -> pd.DataFrame:
        return pd.DataFrame(done, columns=columns, dtype=object)

    for b in batches:
        for conv, text, start, end in zip(b["conv"].tolist(), b["text"].tolist(), b["loss_start"].tolist(), b["loss_end"].tolist(), strict=True):
            if reader is None or reader.key != conv:
                if reader:
                    done.append(reader.row())
                reader = _Reader(conv)
            reader.add(text, start, end)
        if len(done) > 5_000:
            yield frame()
            done = []
    if reader:
        done.append(reader.row())
    if done:
        yield frame()


def digests(turns: DataFrame, **columns: str) -> DataFrame:
    """Format all conversations and read the examples back in the same task: one row per conversation."""
    return ordered(turns, **columns).mapInPandas(lambda batches: read_back(expand(batches)), DIGESTS).withColumn("conv", F.col("conv").cast(_id_type(turns, **columns)))
