"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line, cut again at the ends of sentences, so that a notice in running text stands by itself. Its
features are the distinct sequences of one to three words, as a vector of length one. A multinomial logistic regression
with an L1 penalty gives each licence family and the class ``unknown`` a probability; it is trained on the notices below
and on at most BACKGROUND paragraphs of the corpus as examples of ``unknown``, and a temperature fitted on a fifth that
the training leaves out calibrates it. A predicted family counts as found if LEAST_SHARED of the paragraph's three-word
sequences are in that family's notices.

Scanning uses DataFrame expressions only: the model is sparse, its words and weights are constants of the plan, and no
row is shuffled. Paragraphs without a cue word are ``unknown`` beforehand. A cue is, for each sequence that weighs more for
some family than for ``unknown``, its rarest word. So in a paragraph without cues no sequence weighs more for a family, and
as ``train`` gives ``unknown`` the greatest bias (else every word is a cue), no family can win there.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BREAK = r"[\r\n]+|(?<=[.!?])\s+"
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Paragraphs of the corpus that the model is fitted on, about, as examples of the unknown class.
BACKGROUND = 2000
#: Slots of the table in which a sequence is looked up by its hash.
SLOTS = 8192
L1, STEPS = 2e-5, 80
#: Sequences of these words alone are no features.
STOP = set("a above all also an and any are as at be but by can do for from has have if in is it its may more must new no non not of on or our shall so that the their these they this those to use was we will with without you your".split())
#: Least probability of a predicted family; least part of a paragraph's sequences that its notices hold.
LEAST_SCORE, LEAST_SHARED = 0.5, 0.5
UNKNOWN = "unknown"

# Names of licences and sentences of their texts.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "AGPL", "AGPLv3", "AGPL-3.0", "GNU AGPL"],
    "Apache": ["Apache License", "Apache License, Version 2.0", "Apache 2.0", "Apache-2.0", "Apache 2.0 License"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "CC-BY", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC-SA 4.0", "CC-BY-NC", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "CC0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero"],
    "EPL": ["Eclipse Public License", "Eclipse Public License 2.0", "EPL-2.0", "EPL"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0"],
    "ISC": ["ISC License", "ISC"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL", "LGPLv3", "LGPL-2.1", "GNU LGPL"],
    "MIT": ["MIT License", "MIT", "Expat License", "MIT/X11 License"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "MPL 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
}
FORMS = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This project is licensed under the {} - see the LICENSE file for details.", "This software is released under the terms of the {}.", "This program is distributed under the terms of the {}.",
    "The source code is available under the {}.", "License: {}", "SPDX-License-Identifier: {}", "All content is available under the {}.", "This file is subject to the terms of the {}.", "You can redistribute it under the terms of the {}.",
]
TEXTS = {
    "AGPL": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "You should have received a copy of the GNU Affero General Public License along with this program.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache": ["Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC-BY": ["To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-NC": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/", "This work may be shared and adapted for noncommercial purposes only, with attribution, under CC BY-NC."],
    "CC-BY-SA": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "GPL": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Sentences with words of licences that name none.
OTHERS = [
    "He lost his driving license in the storm.", "A fishing license is required on this lake.", "The film takes some artistic license with history.", "All rights reserved.", "Copyright 2020 by the author.", "Please read the terms of service.",
    "The software is provided for evaluation only and may not be redistributed.", "She studied at MIT before moving to Boston.", "The Apache people lived in the Southwest.", "The eclipse was visible from the public square.", "The creative director found common ground.",
    "The general public was invited.", "Mozilla released a new version of the browser.", "The license plate was unreadable.", "Their bar is licensed to sell wine.", "You need permission to use, copy or print this page.", "Released under cover of darkness.", "This work is under review.",
    "The document is distributed to all members.", "The source code is available on request.", "Distributed systems are hard.", "A copy of the report is available under the counter.", "Version 2.0 is out.", "The price is subject to the terms of the contract.", "License fees apply.",
]


def _grams(t: Column) -> Column:
    """Distinct sequences of one to three words."""
    n = F.size(t)
    seq = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(t, seq(2), seq(3)))


def _trigrams(t: Column) -> Column:
    """Distinct three-word sequences; all words as one if there are fewer."""
    n = F.size(t)
    return F.array_distinct(F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array_join(F.slice(t, i, 3), " "))).otherwise(F.array(F.array_join(t, " "))))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def notices() -> list[tuple[str, str]]:
    """(family, sentence) of every name in every form and of all texts."""
    out = [(f, form.format(name)) for f, names in NAMES.items() for name in names for form in FORMS]
    return out + [(f, s) for f, texts in TEXTS.items() for s in texts]


@dataclass
class Model:
    families: list[str]  # UNKNOWN last
    grams: list[str]
    weights: list[list[float]]  # by gram, then by family
    bias: list[float]
    temperature: float
    cues: list[str] | None  # None: every paragraph is classified
    templates: list[list[str]]  # three-word sequences by family


def train(rows: list[tuple[str, list[str]]], templates: dict[str, list[str]], seed: int = 3) -> Model:
    """Proximal gradient with momentum on (family, distinct grams) rows; every fifth row only calibrates."""
    families = [*sorted(NAMES), UNKNOWN]
    k = len(families)
    grams = sorted({g for f, own in rows if f != UNKNOWN for g in own if not STOP.issuperset(g.split())})
    at = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams)), np.float32)
    for i, (_, own) in enumerate(rows):
        x[i, [at[g] for g in own if g in at]] = 1 / math.sqrt(max(1, len(own)))
    y = np.array([families.index(f) for f, _ in rows])
    size = np.bincount(y, minlength=k)
    share = (1 / np.maximum(size, 1))[y]
    share = np.where(y == k - 1, share * 8, share).astype(np.float32)  # unknown is far the commonest
    order = np.random.default_rng(seed).permutation(len(rows))
    test, fit = order[::5], np.delete(order, np.s_[::5])
    a, goal, s = x[fit], y[fit], share[fit] / share[fit].sum()
    w, b = np.zeros((len(grams), k), np.float32), np.zeros(k, np.float32)
    v, c = w.copy(), b.copy()
    rate = 8.0

    def slope(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = a @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), goal] -= 1
        p *= s[:, None]
        return a.T @ p, p.sum(axis=0)

    for step in range(STEPS):
        gw, gb = slope(v, c)
        nw = v - rate * k * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * k * L1, 0)
        nb = c - rate * gb
        m = step / (step + 3)
        v, c = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    z, t_y = x[test] @ w + b, y[test]

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(axis=1, keepdims=True)
        return float(((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(t_y)), t_y]) * share[test]).sum())

    temperature = min((2.0 ** (e / 4) for e in range(-12, 13)), key=loss)
    seen = np.bincount(np.concatenate([[at[g] for g in own if g in at] for f, own in rows if f == UNKNOWN] or [[]]).astype(int), minlength=len(grams))
    speaks = np.flatnonzero((w[:, :-1] > w[:, -1:]).any(axis=1))
    cues = sorted({min((t for t in grams[g].split() if t not in STOP), key=lambda t: (seen[at[t]], t)) for g in speaks})
    if b[-1] <= b[:-1].max():
        cues = None
    kept = np.flatnonzero((w != 0).any(axis=1))
    return Model(families, [grams[g] for g in kept], np.round(w[kept].astype(float), 5).tolist(), np.round(b.astype(float), 5).tolist(), temperature, cues, [templates.get(f, []) for f in families])


def background(docs: DataFrame, text_col: str = "text", most: int = BACKGROUND) -> DataFrame:
    """About ``most`` distinct paragraphs, chosen by their hashes, of a part of the documents that a hash chooses."""
    n = docs.count()
    some = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(max(1, n // (2 * most)))) == 0)
    cut = some.select(F.explode(F.split(F.lower(text_col), BREAK)).alias("p"))
    every = max(1, cut.agg(F.approx_count_distinct("p")).first()[0] // most)
    return cut.filter(F.pmod(F.xxhash64("p", F.lit("background")), F.lit(every)) == 0).distinct()


def fit(docs: DataFrame, text_col: str = "text", most: int = BACKGROUND) -> Model:
    """A model whose examples of ``unknown`` are paragraphs of ``docs`` that resemble no notice."""
    spark: SparkSession = docs.sparkSession
    known = notices()
    given = spark.createDataFrame([*known, *((UNKNOWN, s) for s in OTHERS)], "family string, p string").withColumn("p", F.lower("p"))
    both = given.unionByName(background(docs, text_col, most).select(F.lit(None).cast("string").alias("family"), "p"))
    made = both.select("family", _tokens(F.col("p")).alias("t")).select("family", _grams(F.col("t")).alias("g"), _trigrams(F.col("t")).alias("s"))
    rows = sorted(((r["family"], r["g"], r["s"]) for r in made.collect()), key=lambda r: (r[0] or "", r[1]))  # notices and ``most`` rows
    templates: dict[str, set[str]] = {}
    for f, _, s in rows:
        if f in NAMES:
            templates.setdefault(f, set()).update(s)
    every = set().union(*templates.values())
    kept = [(f or UNKNOWN, g) for f, g, s in rows if g and (f or len(every & set(s)) < LEAST_SHARED * len(s))]
    return train(kept, {f: sorted(s) for f, s in templates.items()})


def found_in(text: Column, model: Model) -> Column:
    """array<struct<at, family, score, confirmed>> of the paragraphs (numbered from 0) for which a family is predicted."""
    constant = lambda v, kind: F.from_json(F.lit(json.dumps(v)), kind)
    bias = constant(model.bias, "array<double>")
    families, templates = constant(model.families, "array<string>"), constant(model.templates, "array<array<string>>")
    table: list[list[dict]] = [[] for _ in range(SLOTS)]
    for g, w in zip(model.grams, model.weights, strict=True):
        table[zlib.crc32(g.encode()) % SLOTS].append({"g": g, "w": w})
    slots = constant(table, "array<array<struct<g:string,w:array<double>>>>")
    own = lambda g: F.filter(F.element_at(slots, (F.crc32(g.cast("binary")) % SLOTS + 1).cast("int")), lambda e: e["g"] == g)
    weighed = lambda gs: F.flatten(F.transform(gs, own))
    struct = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    cut = F.transform(F.split(F.lower(text), BREAK), lambda p, i: struct(at=i, t=_tokens(p)))
    cued = cut if model.cues is None else F.filter(cut, lambda x: F.exists(x["t"], lambda w: w.isin(model.cues)))  # a hash lookup
    sparse = F.transform(F.transform(cued, lambda x: struct(at=x["at"], t=x["t"], g=_grams(x["t"]))), lambda x: struct(at=x["at"], t=x["t"], one=1 / F.sqrt(F.size(x["g"])), g=weighed(x["g"])))
    added = lambda x: F.aggregate(x["g"], bias, lambda a, g: F.zip_with(a, g["w"], lambda p, q: p + q * x["one"]))
    scored = F.transform(F.transform(sparse, lambda x: struct(at=x["at"], t=x["t"], z=added(x))), lambda x: struct(at=x["at"], t=x["t"], z=x["z"], top=F.array_max(x["z"])))
    total = lambda x: F.aggregate(x["z"], F.lit(0.0), lambda a, v: a + F.exp((v - x["top"]) / model.temperature))
    best = F.transform(scored, lambda x: struct(at=x["at"], t=x["t"], k=F.array_position(x["z"], x["top"]).cast("int"), score=1 / total(x)))
    licensed = F.filter(best, lambda x: (x["k"] < len(model.families)) & (x["score"] >= LEAST_SCORE))
    compared = F.transform(licensed, lambda x: struct(at=x["at"], k=x["k"], score=x["score"], s=_trigrams(x["t"])))
    shared = lambda x: F.size(F.array_intersect(x["s"], F.element_at(templates, x["k"]))) >= LEAST_SHARED * F.size(x["s"])
    return F.transform(compared, lambda x: struct(at=x["at"], family=F.element_at(families, x["k"]), score=x["score"], confirmed=shared(x)))


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``licenses`` added, see ``found_in``; a column of that name is replaced. Rows are kept as they are;
    null and empty texts have none."""
    return docs.withColumn("licenses", found_in(F.coalesce(F.col(text_col), F.lit("")), model))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: ``id_col``, ``families`` (confirmed ones, ascending, comma-joined), ``found``
    (``paragraph:family`` of these in order), ``n_unconfirmed`` and ``score`` (the highest probability of a confirmed
    one; null without). Repeated rows stay; an empty table gives an empty result; other columns are not read."""
    model = fit(docs, text_col)
    sure = F.filter("licenses", lambda x: x["confirmed"])
    own = scan(docs.select(F.col(id_col), F.col(text_col)), model, text_col).select(F.col(id_col), sure.alias("sure"), F.size("licenses").alias("n"))
    return own.select(
        id_col, F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("sure", lambda x: F.concat_ws(":", x["at"].cast("string"), x["family"])), ",").alias("found"),
        (F.col("n") - F.size("sure")).cast("long").alias("n_unconfirmed"), F.array_max(F.transform("sure", lambda x: x["score"])).alias("score"),
    )
