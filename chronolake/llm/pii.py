"""Personal data: patterns propose spans, checks confirm them, words nearby move the score.

Offsets are code points, ends exclusive. A null text counts as empty. Every scan is linear in the
text: a match can begin only where a run of its characters begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import text_struct

#: Kinds in the order that breaks ties of start. The first four are the base.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


#: Score before context, and words that raise it when they stand close before a span.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social", "security"),
}
#: Words that make a number less likely to be personal.
AGAINST = ("version", "build", "isbn", "order", "invoice", "part")
REACH, STEP = 40, 0.3
#: Added kinds need this score; spans of base kinds stay whatever theirs is.
THRESHOLD = 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Fewer digits than the whole run can't help a match, so runs are taken whole ("++") and from their first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORDS = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost non-overlapping matches, found from each @ outwards."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            taken = m.end()
        at = text.find("@", max(at + 1, taken))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if 15 <= len(bare := m[0].replace(" ", "")) <= 34 and mod97(bare):
            yield m.span()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": _emails,
    "ip": _ips,
    "card": _cards,
    "phone": _phones,
    "iban": _ibans,
    "ssn": _ssns,
}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, up for a word of its context nearby, down for a word against it; 0 to 1."""
    near = set(_WORDS.findall(text[max(0, start - REACH) : start].lower())) | set(_WORDS.findall(text[end : end + REACH // 2].lower()))
    up, down = any(w.startswith(CONTEXT[kind]) for w in near), any(w in AGAINST for w in near)
    return round(min(1.0, max(0.0, PRIOR[kind] + STEP * up - STEP * down)), 3)


def find(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a whole text by start, then by kind as listed."""
    text = text or ""
    spans = [Span(k, a, b, score(text, k, a, b)) for k, finder in FINDERS.items() for a, b in finder(text)]
    return sorted((s for s in spans if s.kind in BASE_KINDS or s.score >= threshold), key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each stretch that spans cover put as the kind of its first span, like ``[EMAIL]``."""
    if text is None:
        return None
    out, at = [], 0
    for s in find(text, threshold):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if out else text


SPANS = "spans array<struct<kind:string,start:int,end:int,score:double>>"
SUMMARY = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, min_score double"


def spans(text: Column | str, threshold: float = THRESHOLD) -> Column:
    """Struct with one array of the spans of each text; an empty array where there are none."""
    return text_struct(text, SPANS, lambda: lambda texts: {"spans": [[s._asdict() for s in find(t, threshold)] for t in texts]})


def summary(text: Column | str, threshold: float = THRESHOLD) -> Column:
    """Struct of base counts, a digest of the base spans, all spans joined, and the least score (null without spans)."""

    def run(texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "min_score")}
        for t in texts:
            every = find(t, threshold)
            base = [s for s in every if s.kind in BASE_KINDS]
            for k in BASE_KINDS:
                out[f"n_{k}"].append(sum(s.kind == k for s in base))
            out["base_sha256"].append(sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(every))
            out["min_score"].append(min((s.score for s in every), default=None))
        return out

    return text_struct(text, SUMMARY, lambda: run)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its id and the columns of :func:`summary`. Repeated rows give repeated results."""
    return docs.select(F.col(id_col), summary(F.col(text_col).cast("string"), threshold).alias("p")).select(id_col, "p.*")


def redacted(text: Column | str, threshold: float = THRESHOLD) -> Column:
    """The text without its personal data; null stays null."""
    return text_struct(text, "text string", lambda: lambda texts: {"text": [redact(t, threshold) for t in texts]})["text"]
