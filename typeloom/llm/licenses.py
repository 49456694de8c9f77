"""Licence scans: a trained paragraph classifier, with DataFrame functions only on the texts.

A text's paragraphs are its blocks between blank lines, comment marks at the beginnings of lines taken off and lines joined, so
that a notice may be wrapped anywhere. A multinomial logistic regression over sparse word 1- and 2-grams tells licence
families from the class `unknown`; it is fitted on the driver to cut, embedded and altered copies of NOTICES and to the
n-grams of a bounded sample of the corpus's paragraphs, and its temperature is calibrated on rows held out of the fit. A
paragraph is a notice where the calibrated probability of `unknown` is below 1 - LIKELY. Of the families with at least POSSIBLE,
those are reported that a notice of theirs confirms: at least CONFIRMED of its word pairs stand in the paragraph, and no
notice of another family that shares half of the pairs of one of the two does so better (on equal terms the likelier
family counts). So versions of a licence exclude each other and the licence without a version, while two licences in one
paragraph are both found.

Paragraphs without any of the ANCHORS are not scored. That loses nothing, whatever the corpus: anchors are chosen so that of
every notice more than 1 - CONFIRMED of the word pairs hold one, so without them no notice can be confirmed.

family is the likeliest of a text, families has all. Null, empty and other texts without a licence get family `none`, score 0
and no families; whole texts and whole paragraphs are read. Each row of the input has its own row in the result, and equal
texts equal results. Extra columns are ignored. A corpus without paragraphs gives a model all the same.
"""

from __future__ import annotations

import json
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled

# fixed values: notices of widely used public licences, as their own texts ask to state them
NOTICES = {
    "mit": [
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ],
    "apache-2.0": [
        "Licensed under the Apache License Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "gpl": ["This work is licensed under the GNU General Public License", "under the terms of the GNU General Public License", "You should have received a copy of the GNU General Public License along with this program"],
    "gpl-2.0": [
        "GNU General Public License version 2",
        "This work is licensed under the GNU General Public License version 2",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    ],
    "gpl-3.0": [
        "GNU General Public License version 3",
        "This work is licensed under the GNU General Public License version 3",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "lgpl-2.1": [
        "GNU Lesser General Public License version 2.1",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ],
    "lgpl-3.0": [
        "GNU Lesser General Public License version 3",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License version 3",
        "under the terms of the GNU Affero General Public License",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "bsd": [
        "Licensed under the BSD 3 Clause License",
        "Licensed under the BSD 2 Clause License",
        "This source code is licensed under the BSD style license found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License Version 2.0",
    ],
    "cc-by-nc": ["Licensed under CC BY NC 4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY SA 4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0": ["Released under CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "isc": [
        "Released under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    ],
    "unlicense": ["Released under the Unlicense", "This is free and unencumbered software released into the public domain"],
    "zlib": [
        "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    ],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0"],
}
#: Ordinary words, which are anchors only where a notice has too few others.
ORDINARY = "a all and any are as at be by can copy file for form found free from if in including is it its may name no not of on one or other out program public purpose software source terms that the this to under use used version was will with without work you your found 0 1 2 3 4".split()
UNKNOWN, NONE = "unknown", "none"
LIKELY, POSSIBLE, CONFIRMED, ALIKE = 0.5, 0.05, 0.75, 0.5
#: Documents of the sample (about), its paragraphs at most, and rows made from each notice.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, COPIES = 300, 3_000, 16
APART = r"[^\p{L}\p{N}]+"
#: Marks of comments at the beginning of a line.
MARKS = r"(?m)^[ \t]*(?://+!?|#+|/?\*+/?|--+|;+|<!--|%+|\||REM\b|dnl\b)[ \t]*"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def pairs_of(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


@cache
def notices() -> list[tuple[str, list[str]]]:
    return [(family, words_of(t)) for family, ts in NOTICES.items() for t in ts]


@cache
def anchors() -> list[str]:
    """Words such that of every notice more than 1 - CONFIRMED of the word pairs hold one."""
    out: set[str] = set()
    for _, words in notices():
        pairs = pairs_of(words)
        held = lambda ws: sum(1 for p in pairs if set(p.split()) & ws)
        while held(out) <= (1 - CONFIRMED) * len(pairs):
            out.add(min(set(words) - out, key=lambda w: (w in ORDINARY, -held(out | {w}), -len(w), w)))
    return sorted(out)


class Model:
    def __init__(self, plain: list[list[str]], seed: int = 17):
        """plain: of paragraphs of the corpus, the n-grams that notices have too."""
        rng = random.Random(seed)
        self.classes = [UNKNOWN, *NOTICES]
        self.grams = sorted({g for _, w in notices() for g in [*w, *pairs_of(w)]})
        place = {g: k for k, g in enumerate(self.grams)}
        own = [pairs_of(w) for _, w in notices()]
        plain = [x for x in plain if not any(len(p & set(x)) >= 0.5 * len(p) for p in own)] or [[]]
        every = sorted({w for _, ws in notices() for w in ws})
        rows: list[tuple[set[str], int]] = []
        for family, words in notices():
            for k in range(COPIES):
                w = list(words)
                if k % 3 == 1 and len(w) >= 8:
                    a = rng.randrange(0, len(w) // 4 + 1)
                    w = w[a : a + max(6, 3 * len(w) // 4)]
                if k % 4 == 2:
                    # altered: names and years put in, words left out
                    w = [x for x in w if rng.random() > 0.06]
                    for _ in range(1 + len(w) // 15):
                        w.insert(rng.randrange(len(w) + 1), f"~{rng.randrange(99)}")
                found = {*w, *pairs_of(w)}
                if k % 2:
                    found |= set(rng.choice(plain))
                rows.append((found, self.classes.index(family)))
        # unknown: paragraphs as they are, with single words of notices, and with short pieces of them
        for k in range(len(rows)):
            found = set(rng.choice(plain))
            if k % 3:
                found |= set(rng.sample(every, rng.randrange(1, 6)))
            if k % 3 == 2:
                w = rng.choice(notices())[1]
                a = rng.randrange(len(w))
                found |= {*w[a : a + 1 + len(w) // 4], *pairs_of(w[a : a + 1 + len(w) // 4])}
            rows.append((found, 0))
        rng.shuffle(rows)
        x = np.zeros((len(rows), len(place) + 1), np.float32)
        for k, (r, _) in enumerate(rows):
            x[k, [place[g] for g in r if g in place]] = 1
            x[k, -1] = 1
        y = np.array([c for _, c in rows])
        fit = np.arange(len(rows)) % 5 != 0
        self.w = self.fitted(x[fit], y[fit])
        self.heat = min(np.geomspace(0.2, 4, 30), key=lambda t: self.loss(x[~fit], y[~fit], t))

    def fitted(self, x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> np.ndarray:
        """Proximal gradient steps with an L1 penalty, which keeps the weights sparse."""
        w, goal = np.zeros((x.shape[1], len(self.classes)), np.float32), np.eye(len(self.classes), dtype=np.float32)[y]
        g2 = np.full_like(w, 1e-8)
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            g = x.T @ (p / p.sum(1, keepdims=True) - goal) / len(x)
            g2 += g**2
            rate = 0.3 / np.sqrt(g2)
            w -= rate * g
            w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - rate[:-1] * penalty)
        return w.astype(float)

    def loss(self, x: np.ndarray, y: np.ndarray, heat: float) -> float:
        z = x @ self.w / heat
        z -= z.max(1, keepdims=True)
        return float(np.log(np.exp(z).sum(1)).mean() - z[np.arange(len(y)), y].mean())


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def literal(values: list[str]) -> Column:
    """An array of words or word pairs as one literal, cut when the plan is made."""
    return F.split(F.lit("|".join(values)), r"\|")


def paragraphs(text: Column) -> Column:
    """The words of each paragraph that has an anchor; none where the text has none (a cheap look first)."""
    gate = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(anchors())})(?![\p{{L}}\p{{N}}])"
    blocks = F.split(F.regexp_replace(text, MARKS, ""), r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")
    words = F.transform(blocks, lambda b: F.filter(F.split(F.lower(b), APART), lambda w: w != ""))
    return F.when(text.rlike(gate), F.filter(words, lambda w: F.arrays_overlap(w, literal(anchors())))).otherwise(F.array().cast("array<array<string>>"))


def shared_grams(words: Column, grams: list[str]) -> Column:
    """The n-grams of a paragraph that notices have too, each once."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_intersect(F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))), literal(grams))


def learned(docs: DataFrame, rows: int = SAMPLE_DOCS) -> Model:
    """The model, with the unknown class from a bounded sample of the corpus's paragraphs; only n-grams that notices have come
    to the driver."""
    grams = sorted({g for _, w in notices() for g in [*w, *pairs_of(w)]})
    blocks = sampled(docs.select("doc_id", "text"), "doc_id", rows).select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("k", "b"))
    found = blocks.select(shared_grams(F.filter(F.split(F.lower("b"), APART), lambda w: w != ""), grams).alias("g"), F.xxhash64("doc_id", "k").alias("h"))
    found = found.orderBy("h", F.array_join("g", "|")).limit(SAMPLE_PARAGRAPHS)
    return Model([r["g"] for r in found.collect()])


def scanned(text: Column, model: Model) -> Column:
    """struct(family, score, paragraphs, families) of a text."""
    weights = {g: np.round(w, 6).tolist() for g, w in zip(model.grams, model.w / model.heat) if np.abs(w).max() > 1e-6} or {"": [0.0] * len(model.classes)}
    table = F.from_json(F.lit(json.dumps(weights)), "map<string,array<double>>")
    bias = F.from_json(F.lit(json.dumps(np.round(model.w[-1] / model.heat, 6).tolist())), "array<double>")
    own = [(model.classes.index(f), pairs_of(w)) for f, w in notices()]
    near = lambda a, b: len(a & b) >= ALIKE * min(len(a), len(b))
    version = lambda g, f: model.classes[g].startswith(f"{model.classes[f]}-") and model.classes[g][len(model.classes[f]) + 1].isdigit()
    listed = [{"f": f, "n": len(p), "p": sorted(p), "like": [j for j, (g, q) in enumerate(own) if g != f and near(p, q)], "versions": [j for j, (g, _) in enumerate(own) if version(g, f)]} for f, p in own]
    known = F.from_json(F.lit(json.dumps(listed)), "array<struct<f:int,n:int,p:array<string>,like:array<int>,versions:array<int>>>")
    families = literal(model.classes)

    def judged(grams: Column) -> Column:
        logits = F.aggregate(F.filter(grams, lambda g: F.map_contains_key(table, g)), bias, lambda a, g: F.zip_with(a, F.element_at(table, g), lambda x, y: x + y))
        soft = lambda z: let(F.transform(z, lambda x: F.exp(x - F.array_max(z))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))
        nothing = F.array().cast("array<struct<p:double,family:string>>")
        at = lambda array, k: F.element_at(array, k + 1)

        def confirmed(p: Column) -> Column:
            shares = F.transform(known, lambda t: F.size(F.array_intersect(grams, t["p"])) / t["n"].cast("double"))

            def of(s: Column) -> Column:
                better = lambda t, i, j: (at(s, j) > at(s, i)) | ((at(s, j) == at(s, i)) & (at(p, at(known, j)["f"]) > at(p, t["f"])))
                kept = F.filter(F.transform(known, lambda t, i: F.struct((at(s, i) >= CONFIRMED) & (at(p, t["f"]) >= POSSIBLE) & ~F.exists(t["like"], lambda j: better(t, i, j)) & ~F.exists(t["versions"], lambda j: at(s, j) >= CONFIRMED), at(p, t["f"]).alias("p"), at(families, t["f"]).alias("family")).alias("x")), lambda x: x["col1"])
                return F.array_distinct(F.transform(kept, lambda x: F.struct(x["p"].alias("p"), x["family"].alias("family"))))

            return let(shares, of)

        return let(let(logits, soft), lambda p: F.when(1 - at(p, F.lit(0)) >= LIKELY, confirmed(p)).otherwise(nothing))

    hits = F.filter(F.transform(paragraphs(text), lambda w: let(shared_grams(w, model.grams), judged)), lambda h: F.size(h) > 0)

    def summed(h: Column) -> Column:
        best = F.array_max(F.flatten(h))
        return F.struct(
            F.coalesce(best["family"], F.lit(NONE)).alias("family"),
            F.coalesce(F.round(best["p"], 6), F.lit(0.0)).alias("score"),
            F.size(h).cast("long").alias("paragraphs"),
            F.array_sort(F.array_distinct(F.transform(F.flatten(h), lambda x: x["family"]))).alias("families"),
        )

    return let(hits, summed)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, family, score, paragraphs, families of every document: a narrow map, no shuffle."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = model or learned(docs)
    return docs.select("doc_id", scanned(F.col("text"), model).alias("s")).select("doc_id", "s.family", "s.score", "s.paragraphs", "s.families")
