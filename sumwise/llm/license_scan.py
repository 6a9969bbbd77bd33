"""Licence paragraphs in documents: a trained classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text.  A multinomial logistic regression over sparse word
n-grams (single words and pairs) tells licence families and an unknown class apart.  It is
trained here, on variants of TEMPLATES (words dropped, ends cut, foreign words around) and, as
unknown, on every different paragraph of the corpus that looks like no template and holds none.
To the model a paragraph is the n-grams of the templates that it has, so equal ones are one row with
the number of paragraphs as its weight; all of them together weigh as much as MOST_NEGATIVES rows, that
the notices stay as heavy whatever the corpus.  Of ten paragraphs three, by their hash, are not trained
on: all of these set the temperature of the probabilities and the least probability of a family, so
that at most FALSE_RATE of the unknown paragraphs reach it.  Only the foreign words that are put
around variants come from a few paragraphs, those with the smallest hash.

A predicted family is confirmed by pairs of words; those of the templates are weighted by how rare they
are in all unknown paragraphs, any other pair weighs 1.  Either the pairs of the paragraph that stand in
one template of that family have at least SIMILAR of the paragraph's weight (a short or partial notice),
or a window of about the template's length within the paragraph holds at least SIMILAR of the template's
weight (a notice within a long line or a document of one line).  Pairs of a template that all paragraphs
have weigh next to nothing in both.  If the whole paragraph is not confirmed, its windows that are like a
template are classified by themselves, the most similar first.  A paragraph without any pair of a template
cannot be confirmed, so it is not scored.

Training takes one scan with a shuffle of a hash and a few numbers for each paragraph; the driver
receives one number for each template pair, temperature and step of the probability.
Scoring is row by row without a shuffle; the model is broadcast, its size is that of the
templates.  Edge cases: null and empty texts have no paragraphs; a null id is kept, repeated
rows are reported each; empty tables give an empty result, and a model is trained even then;
further columns are ignored.  Texts are read whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumwise.functions.basics import stored
from sumwise.llm.common import slices

MOST_NEGATIVES = 2000  # rows the unknown paragraphs weigh as much as, and the most whose words variants may get
VARIANTS = 24
FALSE_RATE = 0.001
HELD_OUT = 0.3
TEMPERATURES = np.geomspace(0.2, 5, 40)
STEP = 1e-4  # of the least probability
LEAST_PROBABILITY, MOST_PROBABILITY = 0.5, 0.9
SIMILAR = 0.4
LEAST_WEIGHT = 1.0  # that of one pair which no unknown paragraph has
UNKNOWN = "unknown"
BATCH_BYTES = 4 << 20

#: How public licences are named and opened, by family.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is released under the Apache 2.0 license. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license. Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GPL, version 2 or later. Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL. SPDX-License-Identifier: LGPL-2.1",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL. SPDX-License-Identifier: AGPL-3.0",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0. SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Licensed under the ISC License. SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0. Licensed under CC BY-NC-ND 4.0.",
    ],
    "public-domain": [
        "Released into the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential. No part of this work may be reproduced without written permission.",
    ],
}


def words_of(paragraph: str) -> list[str]:
    return re.findall(r"[^\W_]+", paragraph.lower())


def grams(words: list[str]) -> list[str]:
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def pairs(words: list[str]) -> list[str]:
    """Pairs of neighbours; a single word stands for itself."""
    return [f"{a} {b}" for a, b in zip(words, words[1:])] or words


def variants(words: list[str], foreign: list[list[str]], rng: random.Random) -> list[list[str]]:
    out = [words]
    for _ in range(VARIANTS - 1):
        keep = [w for w in words if rng.random() > 0.06] or words
        if len(keep) > 12 and rng.random() < 0.5:
            start = rng.randrange(len(keep) - 8)
            keep = keep[start : start + rng.randrange(8, len(keep))]
        if foreign and rng.random() < 0.4:
            other = rng.choice(foreign)
            keep = other[: rng.randrange(4)] + keep + other[4 : 4 + rng.randrange(4)]
        out.append(keep)
    return out


class LicenseModel:
    """Weights, calibration and template pairs; small enough to be broadcast."""

    def __init__(self, docs: DataFrame, text: str = "text", seed: int = 1):
        spark, rng = docs.sparkSession, random.Random(seed)
        self.families = [*TEMPLATES, UNKNOWN]
        self.templates = {f: [set(pairs(words_of(t))) for t in texts] for f, texts in TEMPLATES.items()}
        self.holders: dict[str, list[tuple[str, int]]] = {}
        for f, ts in self.templates.items():
            for k, t in enumerate(ts):
                for p in t:
                    self.holders.setdefault(p, []).append((f, k))
        self.seen: Counter[str] = Counter()
        vocabulary = sorted({g for texts in TEMPLATES.values() for t in texts for g in grams(words_of(t))})
        self.vocabulary = {g: i for i, g in enumerate(vocabulary)}
        unknown = self.unknown(docs, text)
        total = unknown.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        share = min(1.0, MOST_NEGATIVES / max(1, total))
        held = unknown.select(F.explode("features").alias("i"), "n").groupBy("i").agg(F.sum("n").alias("n"))
        self.seen = Counter({vocabulary[r.i]: r.n * share for r in held.collect() if vocabulary[r.i] in self.holders})
        foreign = self.drawn(docs, text, seed)
        made = [(k, v) for k, f in enumerate(TEMPLATES) for t in TEMPLATES[f] for v in variants(words_of(t), foreign, rng)]
        rng.shuffle(made)
        cut = int(len(made) * (1 - HELD_OUT))
        width = len(vocabulary)
        kind = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT()), T.StructField("weight", T.DoubleType())])
        rows = [(float(k), SparseVector(width, {i: 1.0 for i in self.features(w)}), 1.0) for k, w in made[:cut]]
        vector = F.udf(lambda held: SparseVector(width, held, [1.0] * len(held)), VectorUDT())
        trained = unknown.where(~F.col("held_out")).select(
            F.lit(float(len(TEMPLATES))).alias("label"), vector("features").alias("features"), (F.col("n") * share).alias("weight")
        )
        frame = spark.createDataFrame(rows, kind).coalesce(1).union(trained)
        fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0003, maxIter=80).fit(frame)
        weights, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
        # Without any unknown paragraph the model has no class for it.
        lacking = len(self.families) - len(intercepts)
        self.weights = np.vstack([weights, np.zeros((lacking, width))])
        self.intercepts = np.append(intercepts, [-np.inf] * lacking)
        self.calibrate(made[cut:], unknown.where("held_out"), share)

    def unknown(self, docs: DataFrame, text: str) -> DataFrame:
        """`features, held_out, n`: how many different paragraphs that are like no template have these n-grams of templates."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", BATCH_BYTES):
                found: dict[int, list[int]] = {}
                for line in {line for t in batch.column("text").to_pylist() if t for line in t.split("\n")}:
                    words = words_of(line)
                    if words and (self.holders.keys().isdisjoint(pairs(words)) or self.overlap(words) < 0.3 and not self.windows(words)):
                        digest = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                        found[int.from_bytes(digest, "big", signed=True)] = self.features(words)
                columns = [pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "features"])

        each = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(read, "h long, features array<int>").distinct()
        held_out = F.pmod("h", F.lit(1000)) < int(1000 * HELD_OUT)
        counted = each.groupBy("features", held_out.alias("held_out")).agg(F.count(F.lit(1)).alias("n"))
        return stored(counted.sortWithinPartitions("features", "held_out"))

    def drawn(self, docs: DataFrame, text: str, seed: int) -> list[list[str]]:
        """Words of a few unknown paragraphs, the same whatever the files and the copies."""
        # About two paragraphs per wanted one reach the driver whatever the corpus.
        lines = docs.select(F.explode(F.split(F.col(text).cast("string"), "\n")).alias("line")).where("length(line) > 0")
        drawn = F.xxhash64(F.lit(seed), "line")
        share = min(1.0, 2 * MOST_NEGATIVES / max(1, lines.agg(F.approx_count_distinct(drawn)).first()[0]))
        some = lines.where(drawn <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))).groupBy("line").agg(F.first(drawn).alias("h"))
        sample = some.orderBy("h", "line").select(F.substring("line", 1, 4000)).limit(MOST_NEGATIVES).collect()
        return [w for r in sample if (w := words_of(r[0])) and self.overlap(w) < 0.3 and not self.windows(w)]

    def calibrate(self, notices: list[tuple[int, list[str]]], unknown: DataFrame, share: float) -> None:
        """Temperature and least probability, from held-out variants and all held-out unknown paragraphs."""
        last = len(TEMPLATES)

        def chances(scores: np.ndarray, temperature: float) -> np.ndarray:
            e = np.exp((scores - scores.max(axis=1, keepdims=True)) / temperature)
            return e / e.sum(axis=1, keepdims=True)

        def losses(scores: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> list[float]:
            at = np.arange(len(truth))
            return [float((weight * -np.log(chances(scores, t)[at, truth] + 1e-12)).sum()) for t in TEMPERATURES]

        def scored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            held = batch.column("features").to_pylist()
            scores = [self.intercepts + self.weights[:, h].sum(axis=1) for h in held]
            return np.array(scores), batch.column("n").to_numpy().astype(float)

        def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    scores, n = scored(batch)
                    sums = losses(scores, np.full(len(n), last), n)
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(sums))), pa.array(sums)], names=["k", "loss"])

        scores, truth = np.array([self.scores(w) for _, w in notices]), np.array([k for k, _ in notices])
        total = np.array(losses(scores, truth, np.ones(len(truth))))
        for r in unknown.mapInArrow(lost, "k long, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect():
            total[r.k] += share * r.loss
        self.temperature = float(TEMPERATURES[total.round(9).argmin()])

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    scores, n = scored(batch)
                    best = chances(scores, self.temperature)[:, :-1].max(axis=1)
                    steps = np.floor(np.clip(best, 0, MOST_PROBABILITY) / STEP).astype(int)
                    yield pa.RecordBatch.from_arrays([pa.array(steps), pa.array(n.astype(int))], names=["step", "n"])

        steps = unknown.mapInArrow(reached, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).collect()
        left = sum(r.n for r in steps) * FALSE_RATE
        self.least = LEAST_PROBABILITY
        for r in sorted(steps, key=lambda r: -r.step):
            left -= r.n
            if left < 0:
                self.least = min(max(LEAST_PROBABILITY, (r.step + 1) * STEP), MOST_PROBABILITY)
                break

    def overlap(self, words: list[str]) -> float:
        own = set(pairs(words))
        return max(len(own & t) for ts in self.templates.values() for t in ts) / len(own)

    def features(self, words: list[str]) -> list[int]:
        return sorted({i for g in grams(words) if (i := self.vocabulary.get(g)) is not None})

    def scores(self, words: list[str]) -> np.ndarray:
        return self.intercepts + self.weights[:, self.features(words)].sum(axis=1)

    def classify(self, words: list[str]) -> tuple[str, float]:
        s = self.scores(words) / self.temperature
        e = np.exp(s - s.max())
        k = int(e.argmax())
        chance = float(e[k] / e.sum())
        return (self.families[k], chance) if chance >= self.least else (UNKNOWN, chance)

    def weight(self, some: Iterable[str]) -> float:
        return sum(1 / (1 + self.seen[p]) for p in some)

    def windows(self, words: list[str]) -> list[tuple[float, str, int, int]]:
        """(share of the template's weight, family, first word, end) of the best window for each template that has
        at least SIMILAR of its weight in one, the most similar first."""
        places: dict[tuple[str, int], list[tuple[int, str]]] = {}
        for at, p in enumerate(pairs(words)):
            for template in self.holders.get(p, ()):
                places.setdefault(template, []).append((at, p))
        out = []
        for (family, k), hits in places.items():
            template = self.templates[family][k]
            whole, length = max(self.weight(template), LEAST_WEIGHT), len(template) * 5 // 4 + 1
            if self.weight({p for _, p in hits}) < SIMILAR * whole:
                continue
            best, first, inside, held = (0.0, 0, 0), 0, Counter(), 0.0
            for at, p in hits:
                held += 0 if inside[p] else 1 / (1 + self.seen[p])
                inside[p] += 1
                while at - hits[first][0] >= length:
                    out_of = hits[first][1]
                    inside[out_of] -= 1
                    held -= 0 if inside[out_of] else 1 / (1 + self.seen[out_of])
                    first += 1
                if held > best[0] + 1e-9:
                    best = (held, hits[first][0], at + 2)
            if best[0] >= SIMILAR * whole:
                out.append((best[0] / whole, family, best[1], best[2]))
        return sorted(out, key=lambda w: (-w[0], w[1:]))

    def similarity(self, family: str, words: list[str]) -> float:
        """The share of the paragraph that is template, or of a template that is in a window of it."""
        own = set(pairs(words))
        shared = max(self.weight(own & t) for t in self.templates[family])
        return max([shared / max(self.weight(own), LEAST_WEIGHT), *(w[0] for w in self.windows(words) if w[1] == family)])

    def notice(self, words: list[str]) -> tuple[str, float, float] | None:
        """(family, probability, similarity) of the paragraph, or else of a window that is like a template."""
        family, chance = self.classify(words)
        if family != UNKNOWN and (like := self.similarity(family, words)) >= SIMILAR:
            return family, chance, like
        for _, _, start, end in self.windows(words):
            family, chance = self.classify(words[start:end])
            if family != UNKNOWN and (like := self.similarity(family, words[start:end])) >= SIMILAR:
                return family, chance, like
        return None

    def found(self, text: str | None) -> list[tuple[int, str, float, float, str]]:
        """(line, family, probability, similarity, paragraph) of the confirmed paragraphs."""
        out = []
        for at, line in enumerate((text or "").split("\n")):
            words = words_of(line)
            if words and not self.holders.keys().isdisjoint(pairs(words)) and (notice := self.notice(words)):
                out.append((at, *notice, line))
        return out


def license_paragraphs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, line, family, probability, similarity, paragraph: a row for each confirmed paragraph."""
    kind = docs.schema[id].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(LicenseModel(docs, text))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            out = []
            for row, doc in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                out += [(row, *f) for f in model.value.found(doc)]
            if out:
                columns = [pa.array(c) for c in zip(*out)]
                columns[0] = pa.array([o[0] for o in out], batch.schema.field("id").type)
                yield pa.RecordBatch.from_arrays(columns, names=["id", "line", "family", "probability", "similarity", "paragraph"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(scan, f"id {kind}, line long, family string, probability double, similarity double, paragraph string")
    return found.withColumnRenamed("id", id)
