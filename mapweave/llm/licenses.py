"""Licence statements in texts: a trained paragraph classifier whose findings a template comparison confirms.

Each line is read by itself, and the lines of a paragraph once more as one, as notices are hard-wrapped.  A paragraph
goes on to a line without a word (comment signs alone are no words and drop out everywhere).  What has more than WINDOW
words is read in windows that overlap by half.  Features are the hashed
word 1- to 3-grams that occur in the licence templates; a multinomial logistic regression is trained on disturbed templates
(words lost, exchanged and added, cut at either end) and, as the class ``unknown``, on paragraphs of a bounded sample of the
texts and on invented lines made of the templates' single words.  A temperature fitted on held-out examples calibrates
its probabilities.  A family is reported when its probability is CERTAIN or more and the words hold at least
SIMILAR of the word 3-grams of one of its templates or of a part of it of WINDOW words.

Defined cases: a statement counts by its line, or by its paragraph where no line of it states that family; null, empty and wordless texts have the licence ``none``; among a text's families the most certain wins,
ties go to the first name; repeated rows get equal results; with no text for the sample only invented lines teach
``unknown``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import in_slots
from mapweave.llm.words import bounds, buffer_of, hashes, mix, pieces

WINDOW = 60
CERTAIN = 0.5
SIMILAR = 0.6
SAMPLE_TEXTS = 1000
EXAMPLES = 150  # disturbed copies of each template
NONE, UNKNOWN = "none", "unknown"

# The usual notices of well-known licences.
TEMPLATES = {
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without prior written permission."],
}

_STEP = np.uint64(0xA24BAED4963EE407)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def paragraphs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lines, the number of each line's first word (one more at the end), and each line's text."""
    data, at = buffer_of(texts)
    breaks = np.flatnonzero(data == 10) + 1
    lines = np.union1d(at, breaks)
    begins, ends, first = bounds(data, lines, _WORD)
    return hashes(data, begins, ends), first, np.searchsorted(at, lines[:-1], "right") - 1


def joined(words: np.ndarray, first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the paragraphs of two lines or more, the number of each one's first word (one more at the end), each one's
    text, and the paragraph of every line (-1 for none of these)."""
    size = np.diff(first)
    full = size > 0
    new = full.copy()
    new[1:] &= ~full[:-1] | (text[1:] != text[:-1])
    of = np.where(full, np.cumsum(new) - 1, -1)
    lines = np.bincount(of[full], minlength=int(new.sum()))
    of = np.where(full & (lines[of] > 1), (np.cumsum(lines > 1) - 1)[of], -1) if len(lines) else of
    use = of >= 0
    count = np.bincount(of[use], size[use], minlength=int((lines > 1).sum())).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(count)])
    return words[np.repeat(use, size)], start, text[new][lines > 1], of


def grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the n-grams that lie within a line."""
    count = max(0, len(words) - n + 1)
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = h * _STEP + words[k : k + count]
    line = np.searchsorted(first, np.arange(count), "right") - 1
    whole = np.flatnonzero(np.arange(count) + n <= first[line + 1])
    return mix(h[whole]), whole


def _cut(words: list[str]) -> list[list[str]]:
    return [words[i : i + WINDOW] for i in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2)]


@dataclass
class Model:
    families: list[str]  # in order of name; the class ``unknown`` is the last column
    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    slots: np.ndarray
    parts: list[list[np.ndarray]]  # 3-grams of each family's templates, part by part

    def token_weights(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the features that begin at each word add to each class."""
        out = np.zeros((len(words), len(self.bias)))
        for n in (1, 2, 3):
            h, place = grams(words, first, n)
            maybe = np.flatnonzero(in_slots(self.slots, h, 1 << 20))
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            real = self.keys[at] == h[maybe]
            out[place[maybe[real]]] += self.weights[at[real]]
        return out

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        z = (sums + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def similarity(self, words: np.ndarray, family: int) -> float:
        """The largest share of a template part's 3-grams that the words hold."""
        mine = np.unique(grams(words, np.array([0, len(words)]), 3)[0])
        return max(float(np.isin(p, mine).mean()) for p in self.parts[family])

    def findings(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str, float, float]]:
        """Number, family, probability and similarity of the lines or paragraphs with a window that may state a licence."""
        none = len(self.families)
        begin, end, unit = _windows(first)
        if not len(begin):
            return
        total = np.zeros((len(words) + 1, none + 1))
        np.cumsum(self.token_weights(words, first), 0, out=total[1:])
        p = self.probabilities(total[end] - total[begin])
        for i in np.flatnonzero(p[:, :none].max(1) >= CERTAIN).tolist():
            k = int(p[i, :none].argmax())
            yield int(unit[i]), self.families[k], float(p[i, k]), self.similarity(words[begin[i] : end[i]], k)


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and line of all windows of the lines that have words."""
    size = np.diff(first)
    count = np.where(size > 0, np.maximum(1, -(-(size - WINDOW // 2) // (WINDOW // 2))), 0)
    line = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[line] + k * (WINDOW // 2)
    return begin, np.minimum(begin + WINDOW, first[line + 1]), line


def _disturbed(rng: np.random.Generator, words: list[str], others: list[str]) -> list[str]:
    out = [w if rng.random() > 0.04 else str(rng.choice(others)) for w in words if rng.random() > 0.04]
    if len(words) > 15:
        lost = int(rng.integers(0, len(words) // 3))
        out = out[lost:] if rng.random() < 0.5 else out[: len(out) - lost]
    pad = [str(x) for x in rng.choice(others, int(rng.integers(0, 12)))]
    cut = int(rng.integers(0, len(pad) + 1))
    return (pad[:cut] + out + pad[cut:])[:WINDOW]


def train(background: list[str], seed: int = 3) -> Model:
    """From the templates and background paragraphs."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    parts = {f: [c for t in TEMPLATES[f] for c in _cut(t.split())] for f in families}
    plain = [b.split() for b in background if b.split()]
    vocabulary = sorted({w for p in plain[:2000] for w in p[:200]}) or ["lorem", "ipsum", "dolor", "sit", "amet"]
    single = sorted({w for f in families for p in parts[f] for w in p})
    rows = [(_disturbed(rng, p, vocabulary), k) for k, f in enumerate(families) for p in parts[f] for _ in range(EXAMPLES)]
    rows += [(w[:WINDOW], len(families)) for w in plain]
    for _ in range(2000):  # the words of licences without being one
        some = [str(x) for x in rng.choice(single, int(rng.integers(1, 8)))] + [str(x) for x in rng.choice(vocabulary, int(rng.integers(1, 30)))]
        rows.append((list(rng.permutation(some)), len(families)))
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    words, first, _ = paragraphs(pa.array([" ".join(w) for w, _ in rows]))
    known, kfirst, _ = paragraphs(pa.array([" ".join(p) for f in families for p in parts[f]]))
    keys = np.unique(np.concatenate([grams(known, kfirst, n)[0] for n in (1, 2, 3)]))
    pairs = []
    for n in (1, 2, 3):
        h, place = grams(words, first, n)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        real = keys[at] == h
        pairs.append(np.stack([np.searchsorted(first, place[real], "right") - 1, at[real]]))
    row, col = np.concatenate(pairs, 1)
    classes = len(families) + 1
    y = np.array([k for _, k in rows])
    w, b = np.zeros((len(keys), classes)), np.zeros(classes)
    held = np.arange(len(rows)) % 5 == 0
    use = ~held[row]
    r, c = row[use], col[use]
    target = np.eye(classes)[y]

    def sums(weights: np.ndarray, rr: np.ndarray, cc: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(rr, weights[cc, k], minlength=len(rows)) for k in range(classes)], 1)

    speed, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(120):
        z = sums(w, r, c) + b
        z = np.exp(z - z.max(1, keepdims=True))
        error = (z / z.sum(1, keepdims=True) - target) * (~held)[:, None] / (~held).sum()
        grow = np.stack([np.bincount(c, error[r, k], minlength=len(keys)) for k in range(classes)], 1) + 1e-5 * w
        speed, speed_b = 0.9 * speed - 4.0 * grow, 0.9 * speed_b - 4.0 * error.sum(0)
        w, b = w + speed, b + speed_b
    z = (sums(w, row, col) + b)[held]
    loss = {t: float(np.mean(np.log(np.exp((z - z.max(1, keepdims=True)) / t).sum(1)) - (z - z.max(1, keepdims=True))[np.arange(len(z)), y[held]] / t)) for t in np.geomspace(0.5, 8, 17)}
    slots = np.zeros((1 << 20) // 8, np.uint8)
    s = keys.view(np.int64) & ((1 << 20) - 1)
    np.bitwise_or.at(slots, s >> 3, (1 << (s & 7)).astype(np.uint8))
    three = []
    for f in families:
        three.append([])
        for p in parts[f]:
            h, e, _ = paragraphs(pa.array([" ".join(p)]))
            three[-1].append(np.unique(grams(h, e, 3)[0]))
    return Model(families, keys, w, b, min(loss, key=loss.get), slots, three)


def background(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> list[str]:
    """Paragraphs of about ``texts`` documents (those with the smallest hashes), one per document, without a word of licensing."""
    n = docs.count()
    share = min(1.0, texts / n) if n else 0
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    line = F.element_at(F.array_sort(F.split(F.col("text").cast("string"), "\n")), 1)
    line = F.array_join(F.slice(F.split(line, " "), 1, WINDOW), " ")  # an example, not a result: one window is enough
    rows = some.select(line.alias("line")).where("line is not null and not lower(line) rlike 'licen[cs]|copyright|permi|warrant|reserved|cc by'").distinct().orderBy("line").collect()
    return [r["line"] for r in rows]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, license, probability, similarity, n_paragraphs (that state a licence), unconfirmed
    (paragraphs whose family the templates do not confirm)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words, first, text = paragraphs(piece.column("text"))
                whole, start, owner, of = joined(words, first, text)
                best: dict[int, tuple[float, str, float]] = {}
                stated: dict[int, set[tuple[bool, int]]] = {}
                open_: dict[int, set[tuple[bool, int, str]]] = {}
                known: set[tuple[int, str]] = set()  # paragraph and family
                read: set[int] = set()  # paragraphs with a line that may state a licence
                for join, found in ((False, model.findings(words, first)), (True, model.findings(whole, start))):
                    for unit, family, chance, alike in found:
                        d, paragraph = (int(owner[unit]), unit) if join else (int(text[unit]), int(of[unit]))
                        if not join:
                            read.add(paragraph)
                        if alike < SIMILAR:
                            if not join or paragraph not in read:
                                open_.setdefault(d, set()).add((join, unit, family))
                            continue
                        if not join or (paragraph, family) not in known:
                            stated.setdefault(d, set()).add((join, unit))
                        if join:
                            # A wrapped notice takes its lines along, a line's own statement those of its family.
                            open_[d] = {x for x in open_.get(d, ()) if (paragraph, family) in known and x[2] != family or (x[1] if x[0] else of[x[1]]) != paragraph}
                        elif paragraph >= 0:
                            known.add((paragraph, family))
                        if d not in best or (-chance, family) < (-best[d][0], best[d][1]):
                            best[d] = (chance, family, alike)
                rows = [best.get(d, (0.0, NONE, 0.0)) for d in range(piece.num_rows)]
                yield pa.record_batch({
                    "doc_id": piece.column("doc_id"), "license": pa.array([r[1] for r in rows], pa.string()), "probability": pa.array([r[0] for r in rows], pa.float64()), "similarity": pa.array([r[2] for r in rows], pa.float64()),
                    "n_paragraphs": pa.array([len(stated.get(d, ())) for d in range(len(rows))], pa.int32()), "unconfirmed": pa.array([len({x[:2] for x in open_.get(d, ())} - stated.get(d, set())) for d in range(len(rows))], pa.int32()),
                })

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(find, "doc_id long, license string, probability double, similarity double, n_paragraphs int, unconfirmed int")


def scan_documents(docs: DataFrame) -> DataFrame:
    return scan(docs, train(background(docs)))
