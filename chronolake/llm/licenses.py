"""Licence scans: a trained classifier of paragraphs, confirmed by comparison with templates.

Lines up to an empty one are a paragraph, so a notice may be wrapped. In it, stretches are sought whose
pairs of words occur in templates, with a few other words between at most; so a notice may stand inside
prose, and be damaged. Sparse word n-grams (one and two words) of a stretch go into a multinomial
logistic regression over licence families and an unknown class, trained by stochastic gradient descent
on pieces of templates and on a bounded sample of lines from the corpus. The probability that a family
needs is set on lines and pieces that training didn't see. A prediction counts once most of the
stretch's pairs occur in templates of that family, and they make up most of one template or are many.
Where the sentences of a stretch are of different families, each is a finding of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import luck, text_struct

UNKNOWN = "unknown"
#: Documents whose lines serve as examples of the unknown class at most, lines of these, and characters of one document.
SAMPLE_DOCS, SAMPLE_LINES, SAMPLE_CHARS = 300, 3_000, 20_000
#: Share of a stretch's pairs that the family's templates must hold, of unseen unknown lines that may pass the classifier, and of unseen pieces that it may miss.
CONFIRM, PASSING, MISSING = 0.6, 0.001, 0.02
#: Pairs of words without a template's between two with one, in a stretch; pairs that are enough for a finding where a template is longer.
GAP, ENOUGH = 6, 12

#: Notices and core sentences of licences, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This work is licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "public-domain": [
        "This work is in the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Licensed under CC0 1.0 Universal. To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential. No part of this work may be reproduced without permission."],
}

#: Names that a tag line gives for a family.
TAGS = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache-2.0"],
    "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0", "GPL-3.0"],
    "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
    "MPL-2.0": ["MPL-2.0"],
    "ISC": ["ISC"],
    "public-domain": ["Unlicense", "CC0-1.0"],
    "CC-BY": ["CC-BY-4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-ND": ["CC-BY-ND-4.0"],
}

_WORD = re.compile(r"[A-Za-z0-9]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_SENTENCE = re.compile(r"\n|[.;:] ")


def every_template(family: str) -> list[str]:
    """Notices of a family, tag lines included."""
    return [*TEMPLATES[family], *(f"SPDX-License-Identifier: {x}" for x in TAGS.get(family, ()))]


def words(line: str) -> list[str]:
    return " ".join(_WORD.findall(line)).lower().split()


def pairs(w: list[str]) -> list[tuple[str, ...]]:
    """Adjacent words; the word itself where there is but one."""
    return list(zip(w, w[1:])) if len(w) > 1 else [tuple(w)]


@dataclass
class Model:
    """index: column of each word and pair of words. weights: columns by class, unknown last. least: probability that a family needs."""

    families: list[str]
    index: dict
    weights: np.ndarray
    bias: np.ndarray
    least: float
    held: dict[str, set]

    def features(self, w: list[str]) -> np.ndarray:
        get = self.index.get
        return np.array([i for x in (*w, *pairs(w)) if (i := get(x)) is not None], np.int64)

    def probabilities(self, w: list[str]) -> np.ndarray:
        at = self.features(w)
        z = self.bias + (self.weights[at].sum(0) / np.sqrt(2 * len(w)) if len(at) else 0)
        e = np.exp(z - z.max())
        return e / e.sum()

    def share(self, w: list[str], family: str) -> float:
        """Share of the stretch's pairs of words that the family's templates hold."""
        p = pairs(w)
        return sum(x in self.held[family] for x in p) / len(p)

    def confirmed(self, w: list[str], family: str) -> bool:
        """Whether the family's templates hold most of the stretch's pairs, and these are most of one template or many."""
        if self.share(w, family) < CONFIRM:
            return False
        own = set(pairs(w))
        return any(len(own & t) >= min(ENOUGH, CONFIRM * len(t)) for t in self.templates[family])

    def judged(self, w: list[str]) -> tuple[str, float, bool]:
        """Family (or unknown) of a stretch of words, its probability, whether a template confirms it."""
        p = self.probabilities(w)
        best = int(p[:-1].argmax())
        if p[best] < self.least or p[best] < p[-1]:
            return UNKNOWN, float(p[-1]), False
        return self.families[best], float(p[best]), self.confirmed(w, self.families[best])

    def classify(self, line: str) -> tuple[str, float, bool] | None:
        """:meth:`judged` of a whole line; None for a line that no template shares a pair of words with."""
        w = words(line)
        if len(w) < 2 or self.every.isdisjoint(pairs(w)):
            return None
        return self.judged(w)

    def stretches(self, w: list[str]) -> list[tuple[int, int]]:
        """(first, last) word of each stretch of words with two template pairs at least and no more than ``GAP`` others between two of them."""
        every, out = self.every, []
        for i in [i for i, p in enumerate(zip(w, w[1:])) if p in every]:
            if out and i - out[-1][1] <= GAP:
                out[-1][1] = i + 1
                out[-1][2] += 1
            else:
                out.append([i, i + 1, 1])
        return [(a, b) for a, b, n in out if n > 1]

    def __post_init__(self) -> None:
        self.every = set().union(*self.held.values())
        self.templates = {f: [set(pairs(words(t))) for t in every_template(f)] for f in self.held}


def _held() -> dict[str, set]:
    return {f: {p for t in every_template(f) for p in pairs(words(t))} for f in TEMPLATES}


def train(unknown: list[str], seed: int = 11, copies: int = 40, epochs: int = 12, rate: float = 1.0) -> Model:
    """Fit on damaged pieces of templates against lines of the corpus; a part of both sets the probability needed.

    That is one which a share ``PASSING`` of unseen lines reaches, but no more than all but a share
    ``MISSING`` of unseen pieces reach. Lines of which a template holds most count as no example of the
    unknown class.
    """
    rng = np.random.default_rng(seed)
    held, families = _held(), sorted(TEMPLATES)
    every = set().union(*held.values())
    apart = [w for line in dict.fromkeys(unknown) if len(w := words(line)) > 1 and sum(p in every for p in pairs(w)) < 0.5 * len(pairs(w))]
    filler = [x for w in apart for x in w[:20]] or ["lorem"]
    rows: list[tuple[list[str], int]] = []
    unseen: list[tuple[list[str], int]] = []
    for k, f in enumerate(families):
        for t in every_template(f):
            w = words(t)
            for c in range(copies):
                size = len(w) if c % 2 or len(w) < 8 else int(rng.integers(6, len(w) + 1))
                at = int(rng.integers(0, len(w) - size + 1))
                piece = [filler[int(rng.integers(len(filler)))] if rng.random() < 0.08 else x for x in w[at : at + size]]
                (unseen if c % 8 == 7 else rows).append((piece, k))
    order = rng.permutation(len(apart))
    kept_back = [apart[i] for i in order[: len(apart) // 4]]
    rows += [(apart[i], len(families)) for i in order[len(apart) // 4 :]]
    # Template words in another order are unknown too.
    for f in families:
        for t in every_template(f):
            rows += [([*rng.permutation(words(t))], len(families)) for _ in range(copies // 8)]
    index: dict = {}
    for t in (t for f in families for t in every_template(f)):
        for x in (*words(t), *pairs(words(t))):
            index.setdefault(x, len(index))
    for w, _ in rows:
        for x in w:
            index.setdefault(x, len(index))
    model = Model(families, index, np.zeros((len(index), len(families) + 1)), np.zeros(len(families) + 1), 0.5, held)
    feats = [(model.features(w), np.sqrt(2 * len(w)), y) for w, y in rows]
    n, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, norm, y = feats[i]
            z = model.bias + model.weights[at].sum(0) / norm
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - n / steps)
            np.subtract.at(model.weights, at, step * p / norm)
            model.bias -= 0.1 * step * p
            n += 1
    reached = float(np.quantile([model.probabilities(w)[k] for w, k in unseen], MISSING))
    scores = [model.probabilities(w)[:-1].max() for w in kept_back]
    model.least = min(float(np.quantile(scores, 1 - PASSING)) if scores else 0.5, reached)
    return model


def fit(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Model:
    """Train with the lines of up to ``sample_docs`` documents, those of least hash, as examples of the unknown class.

    Of a text longer than ``SAMPLE_CHARS`` a stretch that long is taken, from a place that its hash names.
    """
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("length(text) > 0")
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))) + 1
    # Only about three times the documents asked for reach the sort.
    some = texts.where(luck("text") < min(1.0, (3.0 * sample_docs + 100) / max(docs.count(), 1))).select(F.xxhash64("text").alias("hash"), F.col("text").substr(place.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    few = some.orderBy("hash", "text").limit(sample_docs)
    lines = few.select(F.explode(F.split("text", "\n")).alias("line")).orderBy(F.xxhash64("line"), "line").limit(sample_lines).toPandas()["line"].tolist()
    return train(lines)


def _paragraphs(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for m in _PARAGRAPH.finditer(text):
        yield at, text[at : m.start()]
        at = m.end()
    yield at, text[at:]


def _whole_lines(text: str, start: int, end: int) -> tuple[int, int]:
    """The span, grown to the ends of its lines where only marks are between."""
    first, last = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    last = len(text) if last < 0 else last
    return first if not _WORD.search(text, first, start) else start, last if not _WORD.search(text, end, last) else end


def findings(text: str | None, model: Model) -> list[tuple[str, int, int, float, bool]]:
    """(family, start, end, probability, confirmed) of a whole text's licence stretches, in code points; unknown ones and unconfirmed ones too."""
    out: list[tuple[str, int, int, float, bool]] = []
    for at, paragraph in _paragraphs(text or ""):
        w = words(paragraph)
        if not (found := model.stretches(w)):
            continue
        places = [m.span() for m in _WORD.finditer(paragraph)]
        for a, b in found:
            # The stretch's sentences, as ranges of words.
            cut = [a, *(i for i in range(a + 1, b + 1) if _SENTENCE.search(paragraph, places[i - 1][1], places[i][0])), b + 1]
            parts = [(x, y, *model.judged(w[x:y])) for x, y in zip(cut, cut[1:]) if y - x > 1]
            sure = [x for x in parts if x[4]]
            if len({x[2] for x in sure}) > 1:
                taken = []
                for x in sure:
                    if taken and taken[-1][2] == x[2]:
                        taken[-1] = (taken[-1][0], x[1], x[2], max(taken[-1][3], x[3]), True)
                    else:
                        taken.append(x)
            else:
                whole = (a, b + 1, *model.judged(w[a : b + 1]))
                if whole[4]:
                    # Sentences at the ends that the family's templates don't hold aren't part of the notice.
                    held = [(x, y) for x, y in zip(cut, cut[1:]) if model.share(w[x:y], whole[2]) >= CONFIRM / 2]
                    whole = (held[0][0], held[-1][1], *whole[2:]) if held else whole
                # Words beside a notice can hide it from a comparison of the whole stretch.
                taken = [whole] if whole[4] or not sure else [(sure[0][0], sure[-1][1], sure[0][2], max(x[3] for x in sure), True)]
            for x, y, family, p, held in taken:
                start, end = _whole_lines(paragraph, places[x][0], places[y - 1][1])
                out.append((family, at + start, at + end, p, held))
    return out


SCHEMA = "n_findings long, families string, spans string, least_score double, n_unconfirmed long"


def licences(text: Column | str, model: Model) -> Column:
    """Struct: number of confirmed findings, their families in order of the alphabet, their spans as family:start:end, the least probability among them (null without any), and predictions that no template confirms.

    A null or empty text has none.
    """

    def start() -> Callable[[list], dict]:
        def run(texts: list) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_findings", "families", "spans", "least_score", "n_unconfirmed")}
            for t in texts:
                every = [x for x in findings(t, model) if x[0] != UNKNOWN]
                sure = [x for x in every if x[4]]
                out["n_findings"].append(len(sure))
                out["families"].append(",".join(sorted({x[0] for x in sure})))
                out["spans"].append(",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in sure))
                out["least_score"].append(min((x[3] for x in sure), default=None))
                out["n_unconfirmed"].append(len(every) - len(sure))
            return out

        return run

    return text_struct(text, SCHEMA, start)


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the columns of :func:`licences`. Repeated rows give repeated results."""
    model = fit(docs, text_col) if model is None else model
    return docs.select(F.col(id_col), licences(F.col(text_col).cast("string"), model).alias("q")).select(id_col, "q.*")
