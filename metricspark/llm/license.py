"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Notices are sought in lines, in passages, and in paragraphs.  A paragraph is a run of lines with words
(punctuation is no word, so comment marks neither join nor part lines); long ones are read in overlapping
windows.  A passage is a run of a template's 3-grams with gaps of at most GAP words inside a paragraph, so
a notice gives the same words however it is wrapped and whatever stands around it.

Features are the 1- and 2-grams of a paragraph's words that occur in the training paragraphs, divided
by the root of the number of words.  A multinomial logistic regression gives a score per family and
for ``unknown``; its temperature is fitted on held-out paragraphs.  A family counts only when its
calibrated probability reaches the threshold and the paragraph matches a template of that family.

Training paragraphs are the templates, shortened, joined with foreign words and with words left
out, all by a fixed seed; ``unknown`` paragraphs come from a bounded sample of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Paragraphs of the corpus used as training examples of ``unknown`` (at most), and their longest length.
SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 2000, 2000
#: Variants made from each template; every fifth is held out for calibration.
VARIANTS = 60
#: Training n-grams that occur less often have no weight: the training matrix stays small on the driver.
LEAST_TIMES = 5
#: Least calibrated probability, and least share of a template's 3-grams that the paragraph holds.
LEAST_PROBABILITY, LEAST_MATCH = 0.5, 0.6
#: Most words between two 3-grams of a template in one passage.
GAP = 12

# The wording of public licence notices.
TEMPLATES = {
    "MIT": ("Released under the MIT License.",
            "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL": ("Released under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    "LGPL": ("Released under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    "AGPL": ("Released under the GNU Affero General Public License, version 3.",
             "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License"),
    "BSD": ("Released under the BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted",),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
            "this work under CC0 1.0 Universal.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "This software is proprietary and confidential. Unauthorized copying is "
                    "strictly prohibited."),
}
FAMILIES = (*TEMPLATES, "unknown")
#: Words of a window and between two starts: a notice of up to STEP words lies whole in one window.
STEP = 2 * max(len(t.split()) for ts in TEMPLATES.values() for t in ts)
WINDOW = 2 * STEP


def _words(texts) -> tuple[np.ndarray, np.ndarray]:
    return T.word_hashes([t.lower() if t else t for t in texts], lower=False, table=T.PLAIN)


class Classifier:
    """Weights over the training n-grams, and the templates' 3-grams."""

    def __init__(self, unknown: list[str]):
        rng = np.random.default_rng(5)
        filler = [w for t in unknown for w in t.split()] or ["word"]
        texts, labels = [], []
        for k, templates in enumerate(TEMPLATES.values()):
            for t in templates:
                for _ in range(VARIANTS):
                    texts.append(_variant(t, filler, rng))
                    labels.append(k)
        self.templates = [[np.unique(self._grams(t)) for t in ts] for ts in TEMPLATES.values()]
        self.places = [np.unique(self._grams(t), return_index=True) for ts in TEMPLATES.values() for t in ts]
        self.known = np.unique(np.concatenate([t for ts in self.templates for t in ts]))
        clean = [t for t in unknown if max(self.match(t, k) for k in range(len(TEMPLATES))) < LEAST_MATCH]
        texts += clean or [""]
        labels += [len(TEMPLATES)] * max(1, len(clean))
        labels = np.array(labels)
        held = np.arange(len(labels)) % 5 == 4
        words, offsets = _words(texts)
        grams, times = np.unique(self._features(words, offsets)[0], return_counts=True)
        self.grams = grams[times >= LEAST_TIMES]
        rows, cols, sizes = self._coded(words, offsets)
        x = np.zeros((len(texts), len(self.grams)), np.float32)
        np.add.at(x, (rows, cols), 1)
        x /= np.sqrt(np.maximum(sizes, 1))[:, None]
        self.weights, self.bias = _fit(x[~held], labels[~held], len(FAMILIES))
        logits = x[held] @ self.weights + self.bias
        scales = np.geomspace(0.2, 5, 41)
        self.scale = float(min(scales, key=lambda s: _loss(logits * s, labels[held])))
        self.held_out = float((np.argmax(logits, axis=1) == labels[held]).mean())

    @staticmethod
    def _grams(t: str) -> np.ndarray:
        words, _ = _words([t])
        return T.ngram_hashes(words, min(3, max(1, len(words))))

    @staticmethod
    def _features(words, offsets) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the 1- and 2-grams and their texts."""
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        two = T.ngram_hashes(words, 2)
        inside = row[1:] == row[:-1]
        return np.concatenate([words, two[inside]]), np.concatenate([row, row[1:][inside]])

    def _coded(self, words, offsets):
        grams, rows = self._features(words, offsets)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = self.grams[at] == grams
        return rows[hit], at[hit], np.diff(offsets)

    def match(self, paragraph: str, family: int) -> float:
        """Largest share of a template's 3-grams that the paragraph holds."""
        return self._share(self._grams(paragraph), family)

    def _share(self, grams: np.ndarray, family: int) -> float:
        return max(float(np.isin(t, grams).mean()) for t in self.templates[family])

    def predict(self, paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Family number and calibrated probability of each paragraph."""
        return self._predict(*_words(paragraphs))

    def _predict(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        rows, cols, sizes = self._coded(words, offsets)
        logits = np.zeros((n, len(FAMILIES)))
        for k in range(len(FAMILIES)):
            logits[:, k] = np.bincount(rows, self.weights[cols, k], n)
        logits = (logits / np.sqrt(np.maximum(sizes, 1))[:, None] + self.bias) * self.scale
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)

    def notices(self, texts: list[str | None]) -> list[tuple[int, int, str, float, float]]:
        """Text number, first line, family, probability and match of each notice.

        Only places with enough of a template's 3-grams are classified: no other can be confirmed.
        A passage or paragraph counts when no line or passage among its words has given its family.
        """
        lines = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
        if not lines:
            return []
        words, offsets = _words([x for _, _, x in lines])
        line = np.repeat(np.arange(len(lines)), np.diff(offsets))
        number = np.array([i for i, _, _ in lines])
        part = np.cumsum((np.diff(offsets) == 0) | (np.diff(number, prepend=-1) > 0))[line]
        grams = T.ngram_hashes(words, 3)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hits = np.flatnonzero((self.known[at] == grams) & (part[:len(grams)] == part[2:]))
        if not len(hits):
            return []
        out = {}
        taken = np.zeros((len(TEMPLATES), len(words)), bool)
        for units in self._units(hits, grams, line, part, offsets):
            if not units:
                continue
            inside = [words[s:e] for s, e in units]
            family, probability = self._predict(np.concatenate(inside), np.cumsum([0, *map(len, inside)]))
            for j in np.flatnonzero((family < len(TEMPLATES)) & (probability >= LEAST_PROBABILITY)):
                (s, e), k = units[j], family[j]
                if taken[k, s:e].any() or (share := self._share(T.ngram_hashes(inside[j], 3), k)) < LEAST_MATCH:
                    continue
                taken[k, s:e] = True
                i, row, _ = lines[line[s]]
                out.setdefault((i, row, FAMILIES[k]), (float(probability[j]), share))
        return sorted((*k, *v) for k, v in out.items())

    def _units(self, hits, grams, line, part, offsets):
        """Places (first word, end) to classify: lines, then passages from the longest, then paragraphs."""
        whole = hits[line[hits] == line[hits + 2]]
        yield [(offsets[r], offsets[r + 1]) for r in np.unique(line[whole])]
        passages = set()
        for t, place in self.places:
            mine = hits[np.isin(grams[hits], t)]
            back = -np.diff(place[np.searchsorted(t, grams[mine])]) > len(t) / 2  # the template starts anew
            edges = np.flatnonzero(back | (np.diff(mine) > GAP + 3) | (np.diff(part[mine]) != 0)) + 1
            for run in np.split(mine, edges):
                if len(run) >= LEAST_MATCH * len(t) and len(np.unique(grams[run])) >= LEAST_MATCH * len(t):
                    passages.add((run[0], run[-1] + 3))
        yield sorted(passages, key=lambda u: (u[0] - u[1], u))
        begin = np.searchsorted(part, part[hits])
        end = np.searchsorted(part, part[hits], "right")
        last = np.maximum(end - begin - WINDOW + STEP - 1, 0) // STEP
        turn = (hits - begin) // STEP
        starts = np.concatenate([np.clip(turn - d, 0, last) * STEP + begin for d in (1, 0)])
        stops = np.minimum(starts + WINDOW, np.concatenate([end, end]))
        yield sorted(set(zip(starts.tolist(), stops.tolist())))


def _variant(t: str, filler: list[str], rng) -> str:
    """The template with a few words left out and a few foreign words before and behind it."""
    words = [w for w in t.split() if rng.random() > 0.04]
    extra = lambda n: [filler[i] for i in rng.integers(0, len(filler), n)]
    return " ".join(extra(rng.integers(0, 4)) + words + extra(rng.integers(0, 4)))


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    top = logits.max(axis=1, keepdims=True)
    return float((np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0] - logits[np.arange(len(labels)), labels]).mean())


def _fit(x: np.ndarray, labels: np.ndarray, n: int, steps: int = 300, rate: float = 4.0, ridge: float = 1e-4):
    """Multinomial logistic regression with classes weighted alike, by accelerated gradient descent."""
    y = np.eye(n, dtype=np.float32)[labels]
    share = (1 / np.maximum(y.sum(axis=0), 1))[labels] / n
    w, b = np.zeros((x.shape[1], n), np.float32), np.zeros(n, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = x @ (w + 0.9 * vw) + b + 0.9 * vb
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - y) * share[:, None]
        vw = 0.9 * vw - rate * (x.T @ g + ridge * w)
        vb = 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    return w.astype(np.float64), b.astype(np.float64)


def train(docs: DataFrame) -> Classifier:
    """The classifier, with unknown paragraphs from a bounded sample of the lines: those with the least hashes
    of document and line, so the sample and the model do not depend on how the rows are stored.

    Lines are counted first, so each task sends only lines below a bound that leaves about half as many again
    as are used."""
    line = F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), line).filter(F.length("line").between(10, SAMPLE_CHARS))
    hashed = lines.select("line", F.xxhash64("doc_id", "line").alias("h"))
    share = (1.5 * SAMPLE_PARAGRAPHS + 100) / max(1, lines.count())
    if share < 1:
        hashed = hashed.filter(F.col("h") < F.lit(int(-2**63 + share * 2**64)))
    sample = hashed.orderBy("h", "line").limit(SAMPLE_PARAGRAPHS)
    return Classifier([r["line"] for r in sample.collect()])


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """One row per licence notice of ``docs``: ``doc_id``, ``paragraph`` (number from 0 of the notice's first
    line), ``family``, ``probability`` and ``match``.

    Places of the class ``unknown``, below the threshold or without a matching template give no
    row; so do missing and empty texts.  Missing ids stay missing; repeated rows each get their rows.
    """
    spark = docs.sparkSession
    T.prepared(spark)
    shared = spark.sparkContext.broadcast(classifier or train(docs))

    def run(batches):
        c = shared.value
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            rows = []
            for lo, hi in T.groups(texts):
                rows += [(ids[lo + i], *r) for i, *r in c.notices(texts[lo:hi])]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()))],
                names=["doc_id", "paragraph", "family", "probability", "match"])

    return T.doc_columns(docs).mapInArrow(
        run, "doc_id long, paragraph long, family string, probability double, match double")
