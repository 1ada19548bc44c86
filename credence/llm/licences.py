"""Licence scans with a trained paragraph classifier, in DataFrame operations alone.

A paragraph is a line, and also all lines between two blank ones together, which count only where they confirm a
family that no line of the document does: so hard-wrapped licences are found as well. Its features are its word
unigrams, bigrams and trigrams (lower case, letters and digits) that the model knows and that hold an anchor word. Only
texts that hold an anchor word are cut up ("MIT" only in capitals, as "mit" is a common word of German; "nc" only beside
another); a paragraph without any has the bias alone and is `unknown`.

The model is a sparse multinomial logistic regression over licence families and `unknown`, trained on the templates
below, parts of them, sentences that merely use the same words, and UNKNOWN_SAMPLE paragraphs of the corpus itself at
most (those of the smallest hashes) that hold anchor words but no trigram of any template; small weights are set to
zero. Its confidence is calibrated by one temperature, fitted on parts of templates that were not trained on;
`calibration_error` measures it on further parts.

A prediction is confirmed by its templates: the share of a template's trigrams that the paragraph holds must reach CONFIRM
for one of the family's templates. Trigrams that templates of other families have too don't count, unless a template has
no others.

Nulls and edges: a null or empty text has no paragraphs; each row of docs gets a row, repeated ones too; lines of any
length are one paragraph; of the columns only doc_id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from credence.llm.common import documents, inline, materialise

CONFIRM, CONFIDENT = 0.5, 0.5
UNKNOWN_SAMPLE = 2_000
UNKNOWN = "unknown"
#: Short public wordings of licences, by family. Fixed values.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2 0", "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2.", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL": ["Licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the 3-Clause BSD License.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-NC-SA": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-NC-ND": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."],
}
#: Identifiers of the families in SPDX tags. Fixed values.
SPDX = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"], "LGPL": ["LGPL-2.1-or-later", "LGPL-3.0-or-later"],
    "AGPL-3.0": ["AGPL-3.0-or-later"], "BSD": ["BSD-3-Clause", "BSD-2-Clause"], "MPL-2.0": ["MPL-2.0"], "CC-BY": ["CC-BY-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-NC-SA": ["CC-BY-NC-SA-4.0"], "CC-BY-NC-ND": ["CC-BY-NC-ND-4.0"], "CC0": ["CC0-1.0"], "ISC": ["ISC"], "Unlicense": ["Unlicense"],
}
TEMPLATES = {f: ts + [f"SPDX-License-Identifier: {i}" for i in SPDX.get(f, [])] for f, ts in TEMPLATES.items()}
#: Sentences with the same words that license nothing. Fixed values.
OTHERS = [
    "He lost his driving license last year.", "The license plate was found near the public library.", "The council granted permission to build.", "Gehen wir mit dem Hund in den Park mit dir.", "mit der und mit den von mit",
    "Apache helicopters flew over the city.", "The Apache people live in the south west.", "A version of the story was released in May.", "The general public was not allowed to enter.", "Mozilla and Apache are well known names.",
    "The new version has three modes and 2.0 litres.", "Copyright law is taught at the university.", "They share the common attribution of the work.", "A creative solution for all people.", "The software was free for students.",
    "The warranty of the car has ended.", "Redistribution of wealth is a political question.", "All rights and duties were discussed.", "Two versions of the general theory.", "the gnu is a large animal of the savanna",
    "Noncommercial use of the common land by all.", "She sent the letter to him, cc by mail to the NC office.",
    "The shop gives a warranty of two years on all parts.", "An identifier was printed on each license.", "SPDX-License-Identifier: Unlisted-1.0", "The warranties were provided as is by the seller.",
]
ANCHORS = frozenset("license licensed licenses licence licenced mit apache gnu gpl lgpl agpl bsd mozilla mpl creative commons attribution sharealike noncommercial nc cc cc0 isc copyright redistribution redistribute permission unencumbered unlicense proprietary rights spdx identifier warranty warranties merchantability".split())
_WORD = re.compile(r"[a-z0-9]+")


def grams(text: str) -> list[str]:
    w = _WORD.findall(text.lower())
    return sorted({" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)})


def _anchored(found: list[str]) -> list[str]:
    return [g for g in found if ANCHORS & set(g.split())]


def _training() -> tuple[list, list, list]:
    """Labelled texts to train on, to calibrate on and to measure on: templates whole, and contiguous parts of them."""
    train, calibrate, measure = [(t, f) for f, ts in TEMPLATES.items() for t in ts] + [(t, UNKNOWN) for t in OTHERS], [], []
    for f, ts in TEMPLATES.items():
        for t in ts:
            w = t.split()
            for k, share in enumerate((0.6, 0.7, 0.8, 0.9)):
                n = max(4, int(len(w) * share))
                for a in sorted({0, (len(w) - n) // 2, len(w) - n}) if len(w) > n else ():
                    (train, train, calibrate, measure)[(a + k) % 4].append((" ".join(w[a : a + n]), f))
    for i, t in enumerate(OTHERS):  # mixtures of other sentences are unknown as well
        (train, train, calibrate, measure)[i % 4].append((t + " " + OTHERS[(i + 7) % len(OTHERS)], UNKNOWN))
    return train, calibrate, measure


def vocabulary() -> list[str]:
    """The n-grams that the model may know: those of the templates that hold an anchor word."""
    return sorted({g for ts in TEMPLATES.values() for t in ts for g in _anchored(grams(t))})


def _matrix(rows: list[list[str]], place: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(place)))
    for i, found in enumerate(rows):
        x[i, [place[g] for g in found if g in place]] = 1
    return x


@lru_cache(4)
def model(others: tuple[tuple[str, ...], ...] = ()) -> tuple[list[str], dict[str, np.ndarray], np.ndarray, float]:
    """Families, weights by n-gram, bias, temperature. others: the n-grams of paragraphs of the corpus that are unknown."""
    train, calibrate, _ = _training()
    families = [*TEMPLATES, UNKNOWN]
    place = {g: i for i, g in enumerate(vocabulary())}
    labels = lambda rows: np.array([families.index(f) for _, f in rows])
    # Empty paragraphs are unknown: the bias alone must say so.
    # Paragraphs alike in all that the model sees are one row of so much more weight.
    found = Counter(others)
    x = np.vstack([_matrix([grams(t) for t, _ in train], place), np.zeros((1, len(place))), _matrix(list(found), place)])
    y = np.concatenate([labels(train), [families.index(UNKNOWN)] * (1 + len(found))])
    # However many paragraphs the corpus gives, they weigh as much as all else together, at most.
    share = min(1.0, (len(train) + 8) / max(1, len(others)))
    weight = np.array([1.0] * len(train) + [8.0] + [share * n for n in found.values()])
    weight /= weight.sum()
    one = np.eye(len(families))[y]
    w, b = np.zeros((x.shape[1], len(families))), np.zeros(len(families))
    for _ in range(600):  # proximal gradient: the l1 step makes the weights sparse
        g = (_softmax(x @ w + b) - one) * weight[:, None]
        w -= 4.0 * (x.T @ g)
        b -= 4.0 * g.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - 4.0 * 1e-4, 0)
    z, yh = _matrix([grams(t) for t, _ in calibrate], place) @ w + b, labels(calibrate)
    temperatures = np.geomspace(0.1, 4, 49)
    loss = [-np.log(_softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean() for t in temperatures]
    return families, {g: w[i] for g, i in place.items() if np.abs(w[i]).max() > 0}, b, float(temperatures[int(np.argmin(loss))])


def predicted(text: str, fitted: tuple) -> tuple[str, float]:
    """Family and confidence of one paragraph, as the plan computes them."""
    families, weights, bias, temperature = fitted
    z = bias + sum((weights[g] for g in grams(text) if g in weights), np.zeros(len(families)))
    p = _softmax(z[None, :] / temperature)[0]
    return families[int(p.argmax())], float(p.max())


def calibration_error(fitted: tuple, bins: int = 5) -> tuple[float, float]:
    """Accuracy, and the mean gap between confidence and accuracy over bins, on parts neither trained nor calibrated on."""
    found = [(p == f, c) for t, f in _training()[2] for p, c in [predicted(t, fitted)]]
    right, sure = np.array([a for a, _ in found], float), np.array([c for _, c in found])
    at = np.minimum((sure * bins).astype(int), bins - 1)
    return float(right.mean()), float(sum(abs(right[at == k].mean() - sure[at == k].mean()) * (at == k).mean() for k in np.unique(at)))


def template_shapes() -> list[tuple[str, str, int, str]]:
    """(template, family, how many, trigram) of the trigrams that count for each template."""
    three = {(f, i): [g for g in grams(t) if g.count(" ") == 2] for f, ts in TEMPLATES.items() for i, t in enumerate(ts)}
    families: dict[str, set] = {}
    for (f, _), found in three.items():
        for g in found:
            families.setdefault(g, set()).add(f)
    out = []
    for (f, i), found in three.items():
        own = [g for g in found if len(families[g]) == 1] or found
        out += [(f"{f}#{i}", f, len(own), g) for g in own]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, unit, n-grams of the paragraphs that hold an anchor word; the units of several lines begin with "+"."""
    # The first letters come first: most places of a text end there.
    words = sorted(ANCHORS - {"mit", "nc"})
    first = "".join(sorted({w[0] for w in words} | {"m"}))
    anchor = f"(?=[{first}{first.upper()}])(?<![A-Za-z0-9])(?:MIT|(?i:{'|'.join(words)}))(?![A-Za-z0-9])"
    rows = documents(docs).filter(F.col("text").rlike(anchor))
    lines = F.split("block", "\n")
    whole = F.struct(F.lit("+").alias("mark"), F.col("block").alias("line"))
    cut = F.concat(F.transform(lines, lambda x: F.struct(F.lit("").alias("mark"), x.alias("line"))), F.when(F.size(lines) > 1, F.array(whole)).otherwise(F.array().cast("array<struct<mark:string,line:string>>")))
    blocks = rows.select("doc_id", F.explode(F.split("text", r"\n[ \t\r]*\n")).alias("block")).filter(F.col("block").rlike(anchor))
    lines = blocks.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.mark", "x.line").filter(F.col("line").rlike(anchor))
    w = F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9]+"), F.lit(0))
    lines = lines.select("doc_id", F.concat("mark", F.sha2("line", 256)).alias("unit"), w.alias("w")).distinct()
    at = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1))), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return lines.select("doc_id", "unit", F.array_distinct(F.concat(at(1), at(2), at(3))).alias("grams"))


def _unknown_sample(exploded: DataFrame) -> tuple[tuple[str, ...], ...]:
    """The known n-grams of UNKNOWN_SAMPLE paragraphs at most that hold some, but no trigram of a template."""
    spark = exploded.sparkSession
    known = F.broadcast(inline(spark, [(g,) for g in vocabulary()], "gram string"))  # a constant of this module
    three = F.broadcast(inline(spark, [(g,) for g in sorted({x[3] for x in template_shapes()})], "gram string"))
    licences = exploded.join(three, "gram", "left_semi").select("unit").distinct()
    rows = exploded.join(known, "gram", "left_semi").groupBy("unit").agg(F.array_sort(F.collect_set("gram")).alias("grams"))  # known ones: bounded by the vocabulary
    rows = rows.join(licences, "unit", "left_anti").orderBy(F.xxhash64("unit"), "unit").limit(UNKNOWN_SAMPLE)
    return tuple(sorted(tuple(r["grams"]) for r in rows.select("grams").collect()))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, unit, family, confidence, agreement, confirmed of each paragraph with an anchor word."""
    spark = docs.sparkSession
    units = materialise(paragraphs(docs), "paragraphs")
    families, weights, bias, temperature = model(_unknown_sample(units.select("unit", F.explode("grams").alias("gram"))))
    # Its n-grams are those of the templates: a few thousand weights, small enough to broadcast.
    table = inline(spark, [(g, f, float(x)) for g, row in weights.items() for f, x in zip(families, row) if x], "gram string, family string, weight double")
    exploded = units.select("doc_id", "unit", F.explode("grams").alias("gram"))
    sums = exploded.join(F.broadcast(table), "gram").groupBy("doc_id", "unit", "family").agg(F.sum("weight").alias("z"))
    shape = sums.select("doc_id", "unit").distinct().select("doc_id", "unit", F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(float(x)).alias("bias")) for f, x in zip(families, bias)))).alias("f")).select("doc_id", "unit", "f.family", "f.bias")
    z = shape.join(sums, ["doc_id", "unit", "family"], "left").select("doc_id", "unit", "family", ((F.coalesce("z", F.lit(0.0)) + F.col("bias")) / temperature).alias("z"))
    best = z.groupBy("doc_id", "unit").agg(F.max(F.struct("z", "family")).alias("best"), F.collect_list("z").alias("all"))  # one entry for each family
    best = best.select("doc_id", "unit", F.col("best.family").alias("family"), (1.0 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best.z")))).alias("confidence"))
    shapes = inline(spark, template_shapes(), "template string, t_family string, t_size int, gram string")
    agree = exploded.join(F.broadcast(shapes), "gram").groupBy("doc_id", "unit", "template", "t_family").agg((F.count("*") / F.first("t_size")).alias("share"))
    agree = agree.groupBy("doc_id", "unit", F.col("t_family").alias("family")).agg(F.max("share").alias("agreement"))
    out = best.join(agree, ["doc_id", "unit", "family"], "left").withColumn("agreement", F.coalesce("agreement", F.lit(0.0)))
    out = out.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("confidence") >= CONFIDENT) & (F.col("agreement") >= CONFIRM))
    joined = F.col("unit").startswith("+")
    by_line = F.max(F.col("confirmed") & ~joined).over(Window.partitionBy("doc_id", "family"))
    return out.withColumn("by_line", by_line).filter(~joined | F.col("confirmed") & ~F.col("by_line")).drop("by_line")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (families confirmed in it, sorted, comma-joined), n_licence_paragraphs, n_unknown: a row for each row of docs."""
    found = classify(docs).groupBy(F.col("doc_id").alias("l_id")).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licences"),
        F.count_if("confirmed").alias("n_licence_paragraphs"), F.count_if(~F.col("confirmed")).alias("n_unknown"),
    )
    return documents(docs).select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("l_id")), "left").select(
        "doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_licence_paragraphs", F.lit(0)).cast("long").alias("n_licence_paragraphs"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown")
    )
