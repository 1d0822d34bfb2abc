"""Licence scan: a trained paragraph classifier, confirmed against templates.

Paragraphs are the lines of a text. Features: hashed sequences of one to three words (lower
case, punctuation off) that occur in templates. A softmax regression over licence families
and an unknown class is trained on altered templates and on paragraphs of a bounded
sample of the corpus; a logistic fit on held-out examples calibrates the probability
that a paragraph is a licence at all. A prediction is confirmed if enough of a template of that
family is in the paragraph.

Notices that are wrapped over lines, or share a line with others, are found by their words: wherever
enough of a template's word pairs lie close together, line ends and comment marks left out, these
words are classified as a paragraph of their own, as are the lines between blank lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words as W
from gridloom.llm.frames import as_bytes, pieces
from gridloom.session import ship

# Public licence notices by family.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
    ],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."],
}
# Word pairs that name a family; a template that has one is only confirmed where it stands unbroken.
NAMES = {
    "Apache-2.0": ["apache license"],
    "GPL": ["gnu general"],
    "AGPL": ["gnu affero"],
    "LGPL": ["gnu lesser"],
    "MPL-2.0": ["mozilla public"],
    "EPL-2.0": ["eclipse public"],
    "CC-BY": ["commons attribution", "attribution 4.0", "cc by"],
}
# Notices of other licences, which share most of their words with the above and are none of them.
NEIGHBOURS = [
    "Licensed under the Academic Free License, Version 3.0.",
    "This work is licensed under the Artistic License, version 2.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Educational Community License, Version 2.0.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3.",
    "This Source Code Form is subject to the terms of the Common Development and Distribution License, v. 1.0.",
    "SPDX-License-Identifier: Zlib",
]
UNKNOWN = "unknown"
#: Sampled documents that give negative paragraphs, and paragraphs used of them.
TRAIN_DOCS, NEGATIVES = 1_000, 6_000
ALTERED, ROUNDS, PENALTY = 60, 120, 1e-4
#: Share of a template's word pairs that confirms a prediction.
CONFIRM = 0.6
#: Probability of being a licence from which a prediction is looked at.
MIN_PROBABILITY = 0.5
#: A template of n words is looked for among n + max(n, SLACK) consecutive words.
SLACK = 16
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in b"\n" or 97 <= c <= 122 or 48 <= c <= 57 or c in b".-" else 32 for c in range(256))


def paragraphs(text: str | bytes | None) -> list[list[bytes]]:
    """The words of each line; lower case, outer punctuation off. Lines without words have none."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return [[w for w in (x.strip(b".-") for x in line.split()) if w] for line in data.translate(_TABLE).split(b"\n")]


def grams(h: np.ndarray) -> list[np.ndarray]:
    """Hashes of the sequences of one, two and three words that start at each word."""
    out = [W.mix(h + W.GOLDEN)]
    for size in (2, 3):
        if len(h) < size:
            out.append(np.empty(0, np.uint64))
            continue
        g = np.full(len(h) - size + 1, np.uint64(size))
        for i in range(size):
            g = W.mix(g + h[i : len(h) - size + 1 + i] * W.MIX_1)
        out.append(g)
    return out


@dataclass
class Model:
    families: list[str]
    features: np.ndarray  # sorted gram hashes
    weights: np.ndarray  # [feature + 1, family + 1], the last row the bias, the last column unknown
    slope: float
    offset: float
    templates: list[tuple[int, np.ndarray]]  # family, sorted hashes of its word pairs
    holds: np.ndarray  # [feature, template]: 1 for a word pair of the template
    spans: list[int]  # words among which a template is looked for
    named: np.ndarray  # [feature, template]: 1 for a word pair of the template that names its family

    def probabilities(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Family and calibrated probability of being a licence, from sums of weights."""
        family = counts[:, :-1].argmax(axis=1)
        margin = counts[np.arange(len(counts)), family] - counts[:, -1]
        return family, 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def _pairs(words: list[bytes]) -> np.ndarray:
    return np.unique(grams(W.hashed(words))[1 if len(words) > 1 else 0])


def templates() -> list[tuple[int, list[bytes]]]:
    return [(f, [w for line in paragraphs(t) for w in line]) for f, name in enumerate(TEMPLATES) for t in TEMPLATES[name]]


def presence(rows: list[list[bytes]], features: np.ndarray) -> np.ndarray:
    """[row, feature]: 1 where a row of words has a gram."""
    out = np.zeros((len(rows), len(features)))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    h = W.hashed([w for row in rows for w in row])
    for size, g in enumerate(grams(h)):
        own = owner[: len(g)]
        whole = np.flatnonzero(own == owner[size : size + len(g)])
        at = np.searchsorted(features, g[whole])
        at[at == len(features)] = 0
        hit = features[at] == g[whole]
        out[own[whole[hit]], at[hit]] = 1
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def loss(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted negative log likelihood with the penalty, and its gradient by the weights [feature + 1, class]."""
    p = _softmax(x @ w[:-1] + w[-1])
    value = -float(weight @ np.log(p[np.arange(len(y)), y])) + PENALTY / 2 * float((w * w).sum())
    p[np.arange(len(y)), y] -= 1
    p *= weight[:, None]
    return value, np.concatenate([x.T @ p, p.sum(axis=0)[None]]) + PENALTY * w


def fit(negatives: list[list[bytes]], seed: int = 7) -> Model:
    """Train on altered templates against ``negatives`` (those that hold a template are left out)."""
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    shapes = [(f, _pairs(w)) for f, w in templates()]
    features = np.unique(np.concatenate([g for _, w in templates() for g in grams(W.hashed(w))]))
    holds = np.stack([np.isin(features, pairs) for _, pairs in shapes], axis=1).astype(float)
    named = np.stack([np.isin(features, [p for name in NAMES.get(families[f], ()) for p in _pairs(name.encode().split())]) for f, _ in shapes], axis=1) * holds
    own = [w for w in negatives if w]
    x = presence(own, features)
    apart = (x @ holds < 0.5 * holds.sum(axis=0)).all(axis=1)
    plain, x = [w for w, ok in zip(own, apart.tolist(), strict=True) if ok], x[apart]
    if not plain:
        plain = [[b"the"], [b"of", b"the"]]
        x = presence(plain, features)
    rows, labels = [], []
    for f, words in templates():
        for n in range(ALTERED):
            kept = [w for w in words if n == 0 or rng.random() > rng.choice([0.0, 0.05, 0.15])]
            if n % 3 == 2:
                extra = plain[rng.integers(len(plain))][: int(rng.integers(1, 8))]
                kept = extra + kept if n % 2 else kept + extra
            rows.append(kept)
            labels.append(f)
    unknown = len(families)
    near = [[w for line in paragraphs(t) for w in line] for t in NEIGHBOURS]
    for words in near:
        for n in range(ALTERED):
            rows.append([w for w in words if n == 0 or rng.random() > rng.choice([0.0, 0.05, 0.15])])
            labels.append(unknown)
    x = np.concatenate([presence(rows, features), x])
    y = np.array(labels + [unknown] * len(plain))
    held = np.arange(len(y)) % 4 == 3
    # Rows with the same grams, label and use are one with a weight.
    key = np.concatenate([np.packbits(x.astype(bool), axis=1), y[:, None].astype(np.uint8), held[:, None].astype(np.uint8)], axis=1)
    _, first, n = np.unique(key, axis=0, return_index=True, return_counts=True)
    weight = n / np.where(y[first] == unknown, max(1, (y == unknown).sum()), max(1, (y < unknown).sum()))
    x, y, held = x[first], y[first], held[first]
    w = np.zeros((len(features) + 1, unknown + 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, ROUNDS + 1):
        _, g = loss(w, x[~held], y[~held], weight[~held])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    logits, n, known = x[held] @ w[:-1] + w[-1], n[held], (y[held] < unknown).astype(float)
    margin = logits[:, :-1].max(axis=1) - logits[:, -1]
    slope, offset = 1.0, 0.0
    smooth = np.where(known > 0, (n @ known + 1) / (n @ known + 2), 1 / (n @ (1 - known) + 2))
    for _ in range(400):  # Platt's fit
        q = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -40, 40)))
        slope -= 0.02 * (n @ ((q - smooth) * margin)) / n.sum()
        offset -= 0.02 * (n @ (q - smooth)) / n.sum()
    return Model(
        families,
        features,
        w,
        float(slope),
        float(offset),
        shapes,
        holds,
        [len(words) + max(len(words), SLACK) for _, words in templates()],
        named,
    )


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    train_docs: int = TRAIN_DOCS,
    negatives: int = NEGATIVES,
) -> Model:
    """Fit with at most ``negatives`` distinct lines of about ``train_docs`` documents, chosen by hashes of ids and lines.

    Null ids and texts, empty lines and repeated lines teach nothing more; lines of any length are taken whole. An empty table gives a model from the templates
    and their neighbours alone. Other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    total = rows.select("id").count()
    if total > train_docs:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * train_docs / total))
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) > 0")
    # The lines of the smallest hashes, so that the sample does not depend on the order of rows.
    table = lines.select("line", F.xxhash64("line").alias("h")).distinct().orderBy("h").limit(negatives).toArrow()
    return fit([words for line in table["line"].to_pylist() for words in paragraphs(line)])


def _windows(pairs: list[int], places: list[int], span: int, need: float) -> list[tuple[int, int]]:
    """The best of each cluster of windows of ``span`` words with ``need`` distinct pairs: first and last of ``places``."""
    out: list[tuple[int, int]] = []
    held: dict[int, int] = {}
    left, best = 0, None
    for right, pair in enumerate(pairs):
        held[pair] = held.get(pair, 0) + 1
        while places[right] + 2 - places[left] > span or held[pairs[left]] > 1:
            held[pairs[left]] -= 1
            if not held[pairs[left]]:
                del held[pairs[left]]
            left += 1
        if len(held) < need:
            continue
        if best and places[left] > places[best[2]]:
            out.append(best[1:])
            best = None
        if best is None or (len(held), places[best[2]] - places[best[1]]) > (best[0], places[right] - places[left]):
            best = (len(held), left, right)
    return [*out, best[1:]] if best else out


def _classify(model: Model, texts: list[bytes | None], confirm: float = CONFIRM) -> list[list[tuple[int, int, float, float, bool]]]:
    """For each text: (paragraph, family, probability, share of the best template, confirmed) of likely licences."""
    sizes_of, names_of = model.holds.sum(axis=0), model.named.sum(axis=0)
    family_of = np.array([k for k, _ in model.templates])
    out: list[list[tuple[int, int, float, float, bool]]] = []
    for text in texts:
        lines = paragraphs(text)
        sizes = np.array([len(x) for x in lines])
        h = W.hashed([w for line in lines for w in line])
        line = np.repeat(np.arange(len(lines)), sizes)
        found, where = [], []
        for g in grams(h):
            at = np.searchsorted(model.features, g)
            at[at == len(model.features)] = 0
            hit = np.flatnonzero(model.features[at] == g)
            found.append(at[hit])
            where.append(hit)
        f, first = np.concatenate(found), np.concatenate(where)
        if not len(f):
            out.append([])
            continue
        last = first + np.repeat([0, 1, 2], [len(x) for x in found])
        inside = line[first] == line[last]
        both = np.unique(np.stack([line[first[inside]], f[inside]]), axis=1)
        some, index = np.unique(both[0], return_inverse=True)
        sums = np.tile(model.weights[-1], (len(some), 1))
        np.add.at(sums, index, model.weights[both[1]])
        family, p = model.probabilities(sums)
        got: list[tuple[int, int, float, float, bool]] = []
        # Candidates: kind (0 line, 1 lines between blank lines, 2 window), family, probability, share, whether
        # the classifier's family, first and last word, places of its template's word pairs.
        candidates: list[tuple[int, int, float, float, bool, int, int, np.ndarray]] = []
        starts = np.concatenate([[0], np.cumsum(sizes)])
        pairs, places = found[1], where[1]

        def compare(k: int, start: int, end: int, pairs=pairs, places=places) -> tuple[float, np.ndarray]:
            """The share of the family's best template in the words from start to end, and its places."""
            own = slice(*np.searchsorted(places, [start, end]))
            seen = np.zeros(len(model.features))
            seen[pairs[own]] = 1
            shares = np.where((family_of == k) & (seen @ model.named >= names_of), seen @ model.holds / sizes_of, -1.0)
            return float(shares.max()), places[own][model.holds[pairs[own], shares.argmax()] > 0]

        def judge(start: int, end: int, but: np.ndarray | None = None, f=f, first=first, last=last) -> tuple[int, float]:
            """The classifier's family and probability of some words, those sequences left out that are all of ``but``."""
            own = (first >= start) & (last <= end)
            if but is not None:
                free = np.concatenate([[0], np.cumsum(~but)])
                own &= free[last + 1] > free[first]
            family, p = model.probabilities((model.weights[np.unique(f[own])].sum(axis=0) + model.weights[-1])[None, :])
            return int(family[0]), float(p[0])

        for i in np.flatnonzero(p >= MIN_PROBABILITY):
            start, end = int(starts[some[i]]), int(starts[some[i] + 1]) - 1
            share, own = compare(family[i], start, end)
            if share >= confirm:
                candidates.append((0, int(family[i]), float(p[i]), share, True, start, end, own))
            else:
                got.append((int(some[i]), int(family[i]), float(p[i]), max(share, 0.0), False))
        seen = np.zeros(len(model.features))
        seen[pairs] = 1
        near = np.flatnonzero((seen @ model.holds / sizes_of >= confirm) & (seen @ model.named >= names_of))
        for t in near if len(lines) > 1 or len(near) > 1 or not candidates else ():
            k = int(family_of[t])
            own = np.flatnonzero(model.holds[pairs, t])
            at = places[own]
            for i, j in _windows(pairs[own].tolist(), at.tolist(), model.spans[t], max(1.0, confirm * sizes_of[t] - 1e-6)):
                if len(np.unique(pairs[own[i : j + 1]][model.named[pairs[own[i : j + 1]], t] > 0])) < names_of[t]:
                    continue
                start, end = int(at[i]), int(at[j]) + 1
                own_family, likely = judge(start, end)
                share = len(np.unique(pairs[own[i : j + 1]])) / float(sizes_of[t])
                candidates.append((2, k, likely, share, own_family == k, start, end, at[i : j + 1]))
        if len(near):
            blank = np.concatenate([[-1], np.flatnonzero(sizes == 0), [len(lines)]])
            for a, b in zip(blank[:-1] + 1, blank[1:], strict=True):
                start, end = int(starts[a]), int(starts[b]) - 1
                if b - a > 1:
                    k, likely = judge(start, end)
                    share, own = compare(k, start, end)
                    if share >= confirm and likely >= MIN_PROBABILITY:
                        candidates.append((1, k, likely, share, True, start, end, own))
        # The surest first. What shares most of its words with a family that is there already is that family's.
        taken, words = np.full(len(h), -1), np.zeros(len(h), bool)
        for kind, k, likely, share, sure, start, end, own in sorted(candidates, key=lambda c: (not c[4], -c[3], -len(c[7]), c[0], c[5])):
            by = taken[own]
            if kind and 2 * (by == k).sum() > len(own):
                continue
            right = 2 * ((by >= 0) & (by != k)).sum() <= len(own)
            if right and not sure:
                other, likely = judge(start, end, words)
                right = other == k
            right = bool(right and likely >= MIN_PROBABILITY)
            if right:
                taken[own[by < 0]] = k
                words[own] = words[own + 1] = True
            if right or not kind:
                got.append((int(line[start]), k, likely, share, right))
        out.append(sorted(got))
    return out


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", confirm: float = CONFIRM) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, licences, and array ``found`` of structs.

    ``found``: paragraph (line, from 0), family, probability, similarity, confirmed; one for each
    line that the classifier takes for a licence, and one, with its first line, for each confirmed notice
    that is not one whole line. ``n_paragraphs`` counts lines. ``licences``: the confirmed families,
    sorted, joined by commas ('' if none). Null counts as empty, with one empty paragraph. Texts of any length are scanned whole.
    Rows with repeated or null ids are scanned one by one. Other columns are not read. An
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([
        ("paragraph", pa.int32()),
        ("family", pa.string()),
        ("probability", pa.float64()),
        ("similarity", pa.float64()),
        ("confirmed", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.families
        for batch in pieces(batches, 256):
            texts = as_bytes(batch["text"])
            found = [[{
                "paragraph": a,
                "family": names[f],
                "probability": p,
                "similarity": s,
                "confirmed": c,
            } for a, f, p, s, c in x] for x in _classify(shared.value, texts, confirm)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([(t or b"").count(b"\n") + 1 for t in texts], pa.int64()),
                    pa.array([",".join(sorted({y["family"] for y in x if y["confirmed"]})) for x in found], pa.string()),
                    pa.array(found, pa.list_(item)),
                ],
                ["doc_id", "n_paragraphs", "licences", "found"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_paragraphs long, licences string, found array<struct<paragraph: int, family: string, probability: double, similarity: double, confirmed: boolean>>",
    )
