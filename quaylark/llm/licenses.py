"""License scans by a trained paragraph classifier.

A multinomial logistic regression over sparse word n-grams is trained on the driver from the templates
below, varied, and from ordinary sentences and notices of other licences. At run time a paragraph with
one of the model's words gets the sum of its n-grams' weights and a probability for each family. A
family stands if its probability reaches the calibrated bound and the paragraph is close enough to one
of the family's templates; other licence-like paragraphs are "unknown". DataFrame functions only.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by family: the wording in common use, shortened.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license, see LICENSE for details.", "The MIT License (MIT)", "Available under the terms of the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License", "SPDX-License-Identifier: Apache-2.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-only"),
    "BSD": ("Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "Dedicated to the public domain under CC0 1.0."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Proprietary": ("Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "This software is proprietary and confidential; unauthorized copying is strictly prohibited."),
}
#: Licence-like, of no family above.
OTHERS = ("Licensed under the Eclipse Public License, version 1.0.", "Released under the zlib license.", "Licensed under the Artistic License 2.0.", "This work is licensed under the Open Database License.", "Released under the Unlicense.", "Licensed under the terms of the Boost Software License.", "This file is licensed under the terms of a custom license agreement.", "Distributed under the European Union Public Licence.")
ORDINARY = ("The cat sat on the mat and looked at the rain.", "We walked to the public library to read the general news.", "He works in a source of free energy for the commons.", "She lost her driver's licence on the way to work.", "The version of the story that I heard is different.", "All of the files were copied to the binary archive.", "Under the bridge the water is used without charge.", "Permission was granted by the school for the following day.", "In this work the author shows the terms of the problem.", "The software was slow and the code was hard to read.", "It is subject to change, provided that the conditions are right.", "Apache pilots flew to Boston and MIT professors met them.", "The people of the union have rights that no law may take.", "Mozilla and other foundations published their reports.", "You can see the details of this offer on the next page.")

NONE, UNKNOWN = "none", "unknown"
WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
SPLIT = r"[^a-z0-9.+-]+"
#: Words that alone don't make a paragraph worth a look.
COMMON = frozenset("a an and are as at be by can for from has have in is it may met no not of on or other that the their them this to under was were with you".split())
LONGEST = 3
#: Word pairs of a longer template that a short paragraph is compared with at least.
LEAST_PAIRS = 3


def tokens(text: str) -> list[str]:
    return [w for w in (x.strip(".+-") for x in re.split(SPLIT, text.lower())) if w]


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1)]


def varied(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """The text and n variants: words lost, words before and after, case."""
    out, words = [text], text.split()
    for _ in range(n):
        w = [x for x in words if rng.random() > 0.08] or words
        own = ORDINARY[rng.integers(len(ORDINARY))].split()
        cut = rng.integers(0, 4)
        w = own[:cut] + w + own[len(own) - rng.integers(0, 4) :]
        out.append(" ".join(w))
    return out


@cache
def trained(variants: int = 24, seed: int = 7, wrong: float = 0.02) -> dict:
    """anchors, classes, weights by n-gram, biases and the bound. The bound is the least probability at
    which at most a share wrong of held-out notices of other licences would be given to a family."""
    rng = np.random.default_rng(seed)
    names = [*TEMPLATES, UNKNOWN, NONE]
    rows: list[tuple[list[str], int]] = []
    groups = [*((i, ts) for i, ts in enumerate(TEMPLATES.values())), (len(names) - 2, OTHERS[::2]), (len(names) - 1, ORDINARY)]
    for label, texts in groups:
        for t in texts:
            rows += [(grams(tokens(v)), label) for v in varied(t, rng, variants)]
    anchors = sorted({w for ts in [*TEMPLATES.values(), OTHERS] for t in ts for w in tokens(t)} - COMMON)
    keep = frozenset(anchors)
    # one or two words of a notice don't make one: in other languages they are common words
    for t in ORDINARY:
        for _ in range(3 * variants):
            w = t.split()
            for a in rng.choice(anchors, rng.integers(1, 3)):
                w.insert(int(rng.integers(0, len(w) + 1)), str(a))
            rows.append((grams(tokens(" ".join(w))), len(names) - 1))
    vocabulary = sorted({g for gs, label in rows for g in gs if keep & set(g.split()) and label < len(names) - 1})
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(at) + 1))
    for r, (gs, _) in enumerate(rows):
        x[r, [at[g] for g in gs if g in at]] = 1
        x[r, -1] = 1
    y = np.eye(len(names))[[label for _, label in rows]]
    w = np.zeros((x.shape[1], len(names)))
    rate = 4.0 / np.square(np.linalg.norm(x, axis=1)).mean()
    for _ in range(400):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= rate * (x.T @ (p - y) / len(x) + 1e-4 * w)
        # sparse: small weights shrink to nothing
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * 2e-5, 0)
    used = np.flatnonzero(np.abs(w[:-1]).max(1) > 0.01)
    model = {"names": names, "anchors": anchors, "grams": [vocabulary[i] for i in used], "weights": np.round(w[used], 5), "bias": np.round(w[-1], 5)}
    held = [probabilities(v, model) for t in OTHERS[1::2] for v in varied(t, rng, variants)]
    best = np.sort([p[: len(TEMPLATES)].max() for p in held])
    model["bound"] = float(max(0.5, best[min(len(best) - 1, int(len(best) * (1 - wrong)))]))
    return model


def probabilities(text: str, model: dict) -> np.ndarray:
    at = {g: i for i, g in enumerate(model["grams"])}
    z = model["bias"] + sum((model["weights"][at[g]] for g in dict.fromkeys(grams(tokens(text))) if g in at), np.zeros(len(model["bias"])))
    p = np.exp(z - z.max())
    return p / p.sum()


def _words(text: Column) -> Column:
    parts = F.transform(F.split(F.lower(text), SPLIT), lambda w: F.regexp_replace(w, r"^[.+-]+|[.+-]+$", ""))
    return F.filter(parts, lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    some = F.size(words) >= n
    return F.when(some, F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.concat_ws(" ", F.slice(words, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, least_overlap: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, score, paragraphs, license_paragraphs, families) for each row of docs.

    Paragraphs are lines with a word. license is the family with the highest probability among the
    document's licence paragraphs, "unknown" if there are only such of no family, null if there are
    none; families has all that occur, in order. Null, empty and blank texts have no paragraphs. Rows
    that repeat an id count together; rows with a null id count as one document of that id. Other
    columns are ignored. The model's tables don't grow with the input."""
    spark = docs.sparkSession
    m = trained()
    k = len(m["names"])
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode_outer(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("line"))
    anchors = F.array(*[F.lit(a) for a in m["anchors"]])
    rough = F.split(F.lower("line"), r"[^a-z0-9]+")
    loose = F.array(*[F.lit(a) for a in sorted({p for a in m["anchors"] for p in re.split("[^a-z0-9]+", a)})])
    seen = base.select("doc_id", "line", F.coalesce(F.length(F.trim(F.translate("line", "\t\r\x0b\x0c", "    "))) > 0, F.lit(False)).alias("full"), F.arrays_overlap(rough, loose).alias("look"))
    counts = seen.groupBy("doc_id").agg(F.count(F.when(F.col("full"), 1)).alias("paragraphs"))
    look = seen.where("full and look").select("doc_id", _words(F.col("line")).alias("words")).where(F.arrays_overlap("words", anchors))
    # equal paragraphs of a document are looked at once
    look = look.groupBy("doc_id", "words").agg(F.count(F.lit(1)).alias("times"))
    look = look.select("doc_id", "times", F.xxhash64("words").alias("paragraph"), F.concat(*[_grams(F.col("words"), n) for n in range(1, LONGEST + 1)]).alias("grams"), F.array_distinct(_grams(F.col("words"), 2)).alias("pairs"))
    # as many rows as the model has n-grams
    weights = spark.createDataFrame([(g, [float(v) for v in w]) for g, w in zip(m["grams"], m["weights"], strict=True)], "gram string, w array<double>")
    scored = look.select("doc_id", "paragraph", "times", "pairs", F.explode(F.array_distinct("grams")).alias("gram")).join(F.broadcast(weights), "gram", "left")
    sums = scored.groupBy("doc_id", "paragraph", "times", "pairs").agg(*[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"z{i}") for i in range(k)])
    z = [F.col(f"z{i}") + float(m["bias"][i]) for i in range(k)]
    top = F.greatest(*z)
    e = [F.exp(x - top) for x in z]
    total = sum(e[1:], e[0])
    ranked = F.array_max(F.array(*[F.struct((x / total).alias("p"), F.lit(n).alias("name")) for x, n in zip(e[: k - 2], m["names"], strict=False)]))
    judged = sums.select("doc_id", "times", "pairs", ranked.alias("best"), (e[k - 1] / total).alias("p_none")).where(F.col("p_none") < 0.5)
    # as many rows as there are templates
    known = spark.createDataFrame([(n, [g for g in grams(tokens(t)) if g.count(" ") == 1]) for n, ts in TEMPLATES.items() for t in ts], "name string, template array<string>").groupBy("name").agg(F.collect_list("template").alias("templates"))
    near = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect("pairs", t)) / F.greatest(F.least(F.size("pairs"), F.size(t)), F.least(F.size(t), F.lit(LEAST_PAIRS)), F.lit(1))))
    judged = judged.join(F.broadcast(known), F.col("best.name") == F.col("name"), "left")
    sure = (F.col("best.p") >= m["bound"]) & (near >= least_overlap)
    judged = judged.select("doc_id", "times", F.when(sure, F.col("best.name")).otherwise(UNKNOWN).alias("family"), F.when(sure, F.col("best.p")).otherwise(1 - F.col("p_none")).alias("p"))
    best = judged.groupBy("doc_id").agg(F.max(F.struct((F.col("family") != UNKNOWN).alias("known"), "p", "family")).alias("x"), F.sum("times").alias("license_paragraphs"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    # the key tells a null id from none
    out = counts.join(best, counts["doc_id"].eqNullSafe(best["doc_id"]), "left")
    return out.select(counts["doc_id"], F.col("x.family").alias("license"), F.col("x.p").alias("score"), "paragraphs", F.coalesce("license_paragraphs", F.lit(0).cast("long")).alias("license_paragraphs"), F.coalesce("families", F.lit("")).alias("families"))
