"""Licence scans: a paragraph classifier with DataFrame functions only.

Training, on the driver, from bounded data: the paragraphs of TEMPLATES with made variants, and the lines of at
most ``SAMPLE`` documents as examples of what is no notice. The model is a multinomial logistic
regression on word unigrams and bigrams, its temperature and its threshold for "unknown" set on
examples held out from the fit.

Scanning: a paragraph is what stands between blank lines (a hard-wrapped notice), and also each line by itself (a notice within other
text). A family stands only if a template of it is found: ``coverage`` of its bigrams. So what holds that much of no template is
unknown whatever the model says, and needs no score; and it is told apart exactly, for who holds so many of a template's bigrams
holds one of any so many that the rest would not do (the *keys*; those that a sample of documents has least often are
taken). Each different paragraph is scored once, however often it occurs; its n-grams are joined to the weights, a small
table of fixed size. A prediction stands if its calibrated probability passes the threshold and a template of the family is found.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockfleet.llm.graph import skew_join
from lockfleet.llm.sample import least_hashed
from lockfleet.llm.scratch import written

#: Documents whose lines serve as examples of other text: those of least hash of doc_id.
SAMPLE = 300
#: Most characters of each, and most lines in all.
SAMPLE_BYTES, SAMPLE_LINES = 100_000, 600
#: Share of a template's bigrams that a line must hold to confirm its family.
COVERAGE = 0.5
UNKNOWN = "unknown"

# Notices of the licence families, and paragraphs of the short licences, in their own wording.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, under the MIT license."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License."),
    ("lgpl-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License."),
    ("isc", "Licensed under the ISC License."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted under the ISC license."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
# Lines with words of licences that name no family.
OTHER = [
    "She renewed her driving license at the office last week.",
    "The license plate of the car was found near the road.",
    "A fishing licence is needed on this lake.",
    "The seller gives no warranty of any kind for used goods.",
    "The warranty covers repairs for two years after purchase.",
    "Taxes redistribute income between households.",
    "The museum shows works that are in the public domain of culture.",
    "Copyright law differs between countries.",
    "The committee discussed new rules for licensing taxi drivers.",
    "A license to operate was granted to the airline by the ministry.",
    "See the file for the license and copyright terms.",
    "He was licensed to practise medicine in three states.",
]


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams(text: str) -> set[str]:
    w = words(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


def bigrams(text: str) -> set[str]:
    return {g for g in grams(text) if " " in g}


@dataclass
class Model:
    """Weights by n-gram and class, the bias, and the calibration."""

    classes: list[str]
    features: dict[str, int]
    weights: np.ndarray  # features x classes, temperature included
    bias: np.ndarray
    threshold: float

    def probabilities(self, text: str) -> np.ndarray:
        x = [self.features[g] for g in grams(text) if g in self.features]
        z = self.bias + self.weights[x].sum(axis=0)
        e = np.exp(z - z.max())
        return e / e.sum()


def _examples(sampled: list[str], seed: int = 7) -> list[tuple[str, str]]:
    """Templates, and variants of them: parts, other years and names, words of other lines before and after."""
    rng = random.Random(seed)
    pool = sorted({w for line in sampled for w in words(line)}) or ["and", "of", "it"]
    some = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    out = []
    for family, text in TEMPLATES:
        out.append((family, text))
        parts = text.rstrip(".").split(" ")
        for k in range(24):
            own = parts if k % 3 else [p for p in parts if rng.random() > 0.1]
            out.append((family, f"{some(k % 7)} {' '.join(own)} {some((k * 5) % 9)}".strip()))
    for text in OTHER:
        out += [(UNKNOWN, text)] + [(UNKNOWN, f"{some(k % 5)} {text} {some(k % 4)}") for k in range(10)]
    out += [(UNKNOWN, line) for line in sampled]
    out += [(UNKNOWN, f"{some(4)} {a} {some(5)}") for a in ["license", "licensed", "copyright", "warranty", "public domain", "redistribute", "version 3", "general public", "under the terms"] for _ in range(8)]
    rng.shuffle(out)
    return out


def train(sampled: list[str], rounds: int = 250, decay: float = 1e-3) -> Model:
    """Fits the model to the templates and to ``sampled`` lines of other text. The same lines give the same model."""
    data = _examples(sampled)
    classes = [UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES)]
    names = sorted({g for _, t in TEMPLATES for g in grams(t)} | {g for t in OTHER for g in grams(t)})
    features = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(data), len(names)))
    for i, (_, text) in enumerate(data):
        x[i, [features[g] for g in grams(text) if g in features]] = 1
    y = np.array([classes.index(f) for f, _ in data])
    fit = np.arange(len(data)) % 4 > 0
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    balance = 1 / np.maximum(np.bincount(y[fit], minlength=len(classes)), 1)
    rows = balance[y[fit]] / balance[y[fit]].sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    target = np.eye(len(classes))[y[fit]]
    for k in range(1, rounds + 1):  # Adam, all rows at once
        z = x[fit] @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) * rows[:, None]
        grad = x[fit].T @ g + decay * w / len(names)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        b -= 0.5 * g.sum(axis=0)
    z = x[~fit] @ w + b

    def probabilities(t: float) -> np.ndarray:
        e = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(probabilities(t)[np.arange(len(z)), y[~fit]] + 1e-12).mean()
    best = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    p = probabilities(best)
    wrong = (p.argmax(axis=1) != 0) & (p.argmax(axis=1) != y[~fit])
    threshold = float(np.clip(p.max(axis=1)[wrong].max() + 0.01 if wrong.any() else 0.5, 0.5, 0.9))
    return Model(classes, features, w / best, b / best, threshold)


def _sampled(docs: DataFrame, sample: int) -> list[str]:
    """Lines of a bounded sample of documents that hold no template, and of each document one row and SAMPLE_BYTES at most."""
    some = least_hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", sample).distinct()
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.substring(F.col("text").cast("string"), 1, SAMPLE_BYTES).alias("text")).where("text is not null").join(F.broadcast(some), "doc_id")
    few = chosen.groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    lines = sorted({x for r in sorted(few) for x in r[1].split("\n") if words(x)}, key=lambda x: (len(x), x))
    held = [bigrams(t) for _, t in TEMPLATES]
    lines = [x for x in lines if not any(2 * len(t & own) >= len(t) for own in [bigrams(x)] for t in held)]
    return lines[:: max(1, len(lines) // SAMPLE_LINES)]


def keys(coverage: float, sampled: list[str]) -> list[str]:
    """Bigrams of which each paragraph that holds ``coverage`` of a template's holds one; of the choices those that ``sampled`` has least."""
    seen = Counter(g for x in sampled for g in bigrams(x))
    out = set()
    for _, text in TEMPLATES:
        own = sorted(bigrams(text), key=lambda g: (seen[g], g))
        out.update(own[: len(own) - math.ceil(len(own) * coverage - 1e-9) + 1])
    return sorted(out)


def _words(c):
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def _bigrams(w: str):
    """Neighbouring words, and the last by itself, of an array."""
    return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))


def paragraphs(docs: DataFrame, some: list[str]) -> DataFrame:
    """``(doc_id, row, paragraph, line, text)`` of ``docs(doc_id, text)``: paragraphs of several lines (``line`` is null) and all lines that hold one of ``some`` bigrams."""
    asked = F.array(*[F.lit(x) for x in some])

    def holding(rows: DataFrame) -> DataFrame:
        kept = [F.col(c) for c in rows.columns]
        return rows.select(*kept, _words(F.col("text")).alias("__w")).where(F.arrays_overlap(_bigrams("__w"), asked)).select(*kept)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    parts = holding(rows).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.split("text", "\n[ \t\r\x0B\f]*\n")).alias("paragraph", "text"))
    none = F.lit(None).cast("int")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    whole = F.when(F.size("lines") > 1, F.array(F.struct(none.alias("line"), F.col("text")))).otherwise(F.array().cast("array<struct<line:int,text:string>>"))
    parts = holding(parts).withColumn("lines", lines).select("doc_id", "row", "paragraph", F.explode(F.concat(whole, "lines")).alias("x"))
    return holding(parts.select("doc_id", "row", "paragraph", "x.line", "x.text"))


def scanned(docs: DataFrame, sample: int = SAMPLE, coverage: float = COVERAGE, model: Model | None = None) -> DataFrame:
    """``doc_id, paragraph, line, family, predicted, probability, template, coverage`` for each paragraph and line that holds ``coverage`` of a template.

    ``paragraph`` counts what blank lines part, from 0, and ``line`` the lines of a paragraph; it is null for a
    paragraph of several lines as a whole, which has a row only if none of its lines names a family by itself. ``family`` is ``predicted``, or
    "unknown" where the probability is under the model's threshold or no template of the family has ``coverage`` of
    its bigrams there. ``template`` is the place in TEMPLATES of the family's best (null if it has none there).
    Null texts have no lines. Rows that repeat are served each, null ids too; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sampled = _sampled(docs, sample)
    model = model or train(sampled)
    lines = paragraphs(docs, keys(coverage, sampled))
    lines = written(lines.withColumn("line_id", F.sha2("text", 256)), "lines")
    once = lines.groupBy("line_id").agg(F.any_value("text").alias("text"))
    once = once.select("line_id", _words(F.col("text")).alias("w"))
    parts = [(i, f, g, len(bigrams(t))) for i, (f, t) in enumerate(TEMPLATES) for g in sorted(bigrams(t))]
    every = F.array(*[F.lit(g) for g in sorted({x[2] for x in parts})])
    parts = spark.createDataFrame(parts, "template int, family string, gram string, size int")
    met = once.select("line_id", F.explode(F.array_intersect(_bigrams("w"), every)).alias("gram"))
    held = met.join(F.broadcast(parts), "gram").groupBy("line_id", "family", "template", "size").agg(F.count("*").alias("n"))
    held = held.groupBy("line_id", "family").agg(F.max(F.struct((F.col("n") / F.col("size")).alias("coverage"), "size", "template")).alias("x"))
    held = written(held.select("line_id", F.col("family").alias("predicted"), F.col("x.coverage").alias("coverage"), F.col("x.template").alias("template")), "held")
    some = once.join(held.where(F.col("coverage") >= coverage).select("line_id").distinct(), "line_id", "left_semi")
    gram = some.select("line_id", F.explode(F.array_distinct(F.concat("w", _bigrams("w")))).alias("gram"))

    k = range(len(model.classes))
    table = spark.createDataFrame([(g, model.weights[i].tolist()) for g, i in model.features.items()], "gram string, w array<double>")
    sums = gram.join(F.broadcast(table), "gram").groupBy("line_id").agg(*[F.sum(F.get("w", F.lit(i))).alias(f"z{i}") for i in k])
    z = F.array(*[F.col(f"z{i}") + F.lit(float(model.bias[i])) for i in k])
    best = F.array_max("z")
    mass = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("z")))
    names = F.array(*[F.lit(c) for c in model.classes])
    said = sums.select("line_id", z.alias("z")).select("line_id", F.get(names, F.array_position("z", best).cast("int") - 1).alias("predicted"), (1 / mass).alias("probability"))

    verdict = said.join(held, ["line_id", "predicted"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    sure = (F.col("probability") >= model.threshold) & (F.col("coverage") >= coverage)
    verdict = written(verdict.withColumn("family", F.when(sure, F.col("predicted")).otherwise(F.lit(UNKNOWN))), "verdicts")
    out = written(skew_join(lines.drop("text"), verdict, "line_id", "inner"), "found")
    named = out.where(F.col("line").isNotNull() & (F.col("family") != UNKNOWN)).select("row", "paragraph").distinct()
    out = out.where("line is not null").unionByName(out.where("line is null").join(named, ["row", "paragraph"], "left_anti"))
    return out.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("line").cast("long").alias("line"), "family", "predicted", "probability", "template", "coverage")
