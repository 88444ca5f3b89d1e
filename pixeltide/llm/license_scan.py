"""License scan: a trained paragraph classifier confirmed by templates, scored with DataFrame functions only.

Training (once per session, on the templates below and on windows cut from them - labelled rows, at most
``max_rows``): sparse multinomial logistic regression (L1, Spark ML) over word n-grams.  A family needs its ``MARKS``
(``nc``, version 3) and none of a sibling licence's; otherwise it is ruled out and has probability 0.  Texts held out
whole in ``FOLDS`` folds, templates and texts of no family (sibling licences among them), calibrate it: a temperature
minimises their log-loss, and a family is only predicted above the lowest probability at which ``PRECISION`` of the
held-out predictions are right; any other paragraph that speaks of licences or rights is ``unknown``.

Scan: a text is split into paragraphs at blank lines and at line ends behind a sentence's end, so that wrapped lines stay
together (``BREAKS``).  A paragraph can only score if it has an n-gram of the vocabulary, and every such n-gram has one of
the ``anchors`` words, so one regular expression finds all paragraphs to score, exactly, and only the n-grams around
anchors are made.  They meet the model's weights as literals: a projection of each document, without shuffle.  A
prediction is confirmed if the family's templates hold at least ``CONTAINED`` of the paragraph's trigrams, or as many as
its shortest template has.

Defined cases: a very long text is scanned whole; null or empty text has no notices; one row per input row, ids may be null or repeated; ties between
families go to the first in ``FAMILIES``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices by which each family of licences is known.
FAMILIES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Distributed under the MIT license; see the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the GNU GPL v3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under the Creative Commons BY-NC 4.0 license.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "bsd-3-clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}
#: Sentences about licences that belong to none of the families.
OTHERS = [
    "Licensed under the Mozilla Public License, version 2.0.",
    "This file is licensed under the zlib license.",
    "Distributed under the Eclipse Public License, version 1.0.",
    "Released under the Boost Software License.",
    "Licensed under the terms found in the accompanying file.",
    "This work is licensed under a proprietary license agreement.",
    "Released under a custom license.",
    "He lost his driving license and had to apply for a new one.",
    "The city will license new shops under the old version of the rules.",
    "The software was released under pressure in the first version.",
    "She claimed the rights to the story were not reserved for anyone.",
    "A copy of the file was found with the program.",
    "You may use the work in any form.",
    "Permission to enter is granted to any person with a ticket.",
    "The public may obtain the general terms from the office.",
    "The foundation published a later version of the program.",
    # licences next to those of the families
    "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Licensed under CC BY 4.0.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Licensed under CC BY-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under the GNU General Public License, version 2.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
    "Released under the GNU GPL v2.",
    "SPDX-License-Identifier: GPL-2.0-or-later",
    "This library is licensed under the GNU Lesser General Public License, version 3.",
    "You should have received a copy of the GNU Lesser General Public License along with this library.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "You should have received a copy of the GNU Affero General Public License along with this program.",
    "Licensed under the BSD 2-Clause License.",
    "Licensed under the Apache License, Version 1.1.",
]
#: Fixed values, on words joined by blanks: what a paragraph must hold to be of a family, and what makes it a sibling's.
MARKS = {
    "mit": (r"\b(mit license|identifier mit|permission is hereby granted free of charge)\b", r"\b(mit 0|mit no attribution)\b"),
    "apache-2.0": (r"\b(apache( license)?( version)? 2( 0)?|apache org licenses license 2 0)\b", r"\bapache( license)?( version)? 1 [01]\b"),
    "gpl-3.0": (
        r"\b((gnu general public license|gpl)( as published by the free software foundation)?( either)? (v|version )?3|gnu general public license along with)\b",
        r"\b(lesser|affero|library) general public|\b[al]gpl\b|\b(general public license|gpl)( as published by the free software foundation)?( either)? (v|version )?[12]\b",
    ),
    "cc-by-nc-4.0": (r"\b(by nc|attribution non ?commercial) 4 0\b", r"\b(nc|non ?commercial) (sa|nd|share ?alike|no ?deriv[a-z]*)\b"),
    "bsd-3-clause": (r"\b(bsd 3 clause|bsd style|redistribution and use in source and binary forms)\b", r"\bbsd [0124] clause\b"),
    "all-rights-reserved": (r"\ball rights reserved\b", r"\bnot all rights reserved\b"),
}
NGRAMS = (1, 2, 3)
WORD = r"[a-z0-9]+"
#: Where paragraphs end: blank lines, line ends behind a sentence, and line ends before an identifier line.
BREAKS = r"\n[ \t\r]*\n|(?<=[.!?;:])[ \t\r]*\n|\n(?=[^a-z0-9\n]*spdx)"
#: Function words; an n-gram needs one word besides them to enter the vocabulary.
COMMON = set("a an and any are at be by can for found from had he her his if in is it its may new no not of on one or out she so that the this to use was were will with you your".split())
MAX_ROWS, PRECISION, CONTAINED, WINDOWS = 20_000, 0.95, 0.5, (4, 6, 9, 14)
#: Texts are held out whole, each in one of so many folds.
FOLDS = 4
#: Score of a family that the marks rule out; its probability is 0.
RULED_OUT = -1e6
UNKNOWN = "unknown"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in NGRAMS for i in range(len(words) - n + 1)}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]  # n-gram to a weight per class, the last class being unknown
    intercepts: tuple[float, ...]
    temperature: float
    threshold: float
    anchors: tuple[str, ...]


def _labelled(max_rows: int) -> list[tuple[int, list[str], int, bool]]:
    """(class, words, fold, whole text); all cuts of a text are in its fold; windows of the templates stand for the ways in which notices are cut and embedded."""
    rows = []
    for label, texts in enumerate([*FAMILIES.values(), OTHERS]):
        for place, text in enumerate(texts):
            words, fold = words_of(text), place % FOLDS
            other = len(FAMILIES) == label
            cuts = [words] * 3 + [words[i : i + w] for w in WINDOWS for i in range(0, len(words) - w + 1)] * (not other)
            rows += [(label, c, fold, not j) for j, c in enumerate(cuts)]
            rows += [(len(FAMILIES), [w], fold, False) for w in words] * other
    return rows[:max_rows]


def _fitted(spark: SparkSession, rows: list[tuple[int, list[str]]], l1: float) -> tuple[dict[str, tuple[float, ...]], tuple[float, ...]]:
    """Weights of the n-grams and intercepts, fitted on (class, words)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    vocabulary = sorted({g for _, words in rows for g in grams_of(words) if set(g.split()) - COMMON})
    index = {g: i for i, g in enumerate(vocabulary)}

    def vector(words):
        return Vectors.sparse(len(index), sorted((index[g], 1.0) for g in grams_of(words) if g in index))

    frame = spark.createDataFrame([(float(y), vector(w)) for y, w in rows], ["label", "features"]).coalesce(1)
    fit = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=l1, standardization=False, maxIter=60).fit(frame)
    table, intercepts = fit.coefficientMatrix.toArray(), tuple(map(float, fit.interceptVector.toArray()))
    return {g: tuple(map(float, table[:, i])) for g, i in index.items() if table[:, i].any()}, intercepts


def confirmable(words: list[str], family: int) -> bool:
    """Whether the marks of a family allow a text to be confirmed as one of its notices."""
    has, sibling = list(MARKS.values())[family]
    joined = " ".join(words)
    return re.search(has, joined) is not None and re.search(sibling, joined) is None


def possible(words: list[str], scores: list[float]) -> list[float]:
    """Scores with those of the families that the marks rule out as low as can be."""
    return [s if k == len(FAMILIES) or confirmable(words, k) else RULED_OUT for k, s in enumerate(scores)]


def held_out_scores(spark: SparkSession, rows: list[tuple[int, list[str], int, bool]], l1: float) -> list[tuple[int, list[str], list[float]]]:
    """(class, words, scores) of every whole text, by a model that has seen no cut of it; families without marks are out."""
    held = []
    for fold in range(FOLDS):
        weights, intercepts = _fitted(spark, [(y, w) for y, w, at, _ in rows if at != fold], l1)
        held += [(y, w, possible(w, scores_of(w, weights, intercepts))) for y, w, at, whole in rows if at == fold and whole]
    return held


def train(spark: SparkSession, max_rows: int = MAX_ROWS, l1: float = 0.002) -> Model:
    """Calibrate on texts held out whole, of families and of none, then fit on all of at most ``max_rows`` labelled rows."""
    rows = _labelled(max_rows)
    names = tuple(FAMILIES)
    held = held_out_scores(spark, rows, l1)
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: sum(-math.log(max(softmax(s, t)[y], 1e-300)) for y, _, s in held))
    threshold = calibrated_threshold([(y, softmax(s, temperature)) for y, _, s in held], len(names))
    weights, intercepts = _fitted(spark, [(y, w) for y, w, _, _ in rows], l1)
    return Model(names, weights, intercepts, temperature, threshold, anchor_words(weights))


def scores_of(words: list[str], weights: dict[str, tuple[float, ...]], intercepts: tuple[float, ...]) -> list[float]:
    out = list(intercepts)
    for g in grams_of(words):
        for k, w in enumerate(weights.get(g, ())):
            out[k] += w
    return out


def softmax(scores: list[float], temperature: float) -> list[float]:
    top = max(scores)
    e = [math.exp((s - top) / temperature) for s in scores]
    return [x / sum(e) for x in e]


def calibrated_threshold(held: list[tuple[int, list[float]]], unknown: int) -> float:
    """The lowest probability from which on at least ``PRECISION`` of the predicted families are right; 0.5 at least."""
    guesses = sorted(((max(p[:unknown]), p.index(max(p[:unknown])) == y) for y, p in held), reverse=True)
    best, right = 1.0, 0
    for i, (p, hit) in enumerate(guesses, 1):
        right += hit
        if right >= PRECISION * i:
            best = p
    return max(0.5, best)


def anchor_words(weights: dict) -> tuple[str, ...]:
    """A set of words of which every n-gram of the vocabulary has one: greedy, function words never."""
    open_grams, chosen = [set(g.split()) - COMMON for g in weights], []
    while open_grams:
        counts: dict[str, int] = {}
        for g in open_grams:
            for w in g:
                counts[w] = counts.get(w, 0) + 1
        word = max(sorted(counts), key=counts.__getitem__)
        chosen.append(word)
        open_grams = [g for g in open_grams if word not in g]
    return tuple(sorted(chosen))


# ---- scoring, in DataFrame functions


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def _grams(words: Column, n: int) -> Column:
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))


def _grams_around(words: Column, anchors: tuple[str, ...]) -> Column:
    """All n-grams that hold an anchor word."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.get(words, i - 1).isin(*anchors))

    def held(i: Column) -> Column:
        spans = [(i - back, n) for n in NGRAMS for back in range(n)]
        return F.array(*[F.when((at >= 1) & (at + (n - 1) <= F.size(words)), F.array_join(F.slice(words, F.greatest(at, F.lit(1)), n), " ")) for at, n in spans])

    return F.filter(F.flatten(F.transform(places, held)), lambda g: g.isNotNull())


def notices(text: Column, model: Model) -> Column:
    """array<struct<paragraph, family, score, confirmed>> of the paragraphs that read like a licence."""
    pattern = rf"(?<![a-z0-9])(?:{'|'.join(model.anchors)})(?![a-z0-9])"
    vocabulary = sorted(model.weights)
    weights = F.map_from_arrays(_array(vocabulary), F.array(*[_array(model.weights[g]) for g in vocabulary]))
    classes = [*model.families, UNKNOWN]
    trigrams = [sorted({" ".join(w[i : i + 3]) for t in texts for w in [words_of(t)] for i in range(len(w) - 2)}) for texts in FAMILIES.values()]
    shortest = [min(len({" ".join(w[i : i + 3]) for i in range(len(w) - 2)}) or 1 for t in texts for w in [words_of(t)]) for texts in FAMILIES.values()]

    def scored(paragraph: Column) -> Column:
        words = F.regexp_extract_all(paragraph, F.lit(WORD), F.lit(0))
        return F.transform(F.array(words), _classified).getItem(0)

    def _classified(words: Column) -> Column:
        matched = F.array_distinct(F.filter(_grams_around(words, model.anchors), lambda g: g.isin(*vocabulary)))
        return F.transform(F.array(F.struct(matched.alias("matched"), words.alias("words"), F.array_join(words, " ").alias("joined"))), _decided).getItem(0)

    def _decided(x: Column) -> Column:
        total = F.aggregate(x["matched"], _array(model.intercepts), lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b))
        return F.transform(F.array(F.struct(total.alias("total"), x["matched"].alias("matched"), x["words"].alias("words"), x["joined"].alias("joined"))), _ruled).getItem(0)

    def _ruled(x: Column) -> Column:
        ruled = F.array(*[F.when(x["joined"].rlike(has) & ~x["joined"].rlike(sibling), x["total"][k]).otherwise(F.lit(RULED_OUT)) for k, (has, sibling) in enumerate(MARKS.values())], x["total"][len(model.families)])
        return F.transform(F.array(F.struct(ruled.alias("total"), x["matched"].alias("matched"), x["words"].alias("words"))), _shared).getItem(0)

    def _shared(x: Column) -> Column:
        top = F.array_max(x["total"])
        odds = F.transform(x["total"], lambda s: F.exp((s - top) / model.temperature))
        share = F.transform(odds, lambda e: e / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))
        return F.transform(F.array(F.struct(share.alias("share"), x["matched"].alias("matched"), x["words"].alias("words"))), _named).getItem(0)

    def _named(x: Column) -> Column:
        families = F.slice(x["share"], 1, len(model.families))
        best = F.array_max(families)
        three = F.when(best >= model.threshold, F.array_distinct(_grams(x["words"], 3)))
        return F.transform(F.array(F.struct(families.alias("families"), best.alias("best"), three.alias("three"), x["matched"].alias("matched"))), _confirmed).getItem(0)

    def _confirmed(x: Column) -> Column:
        place = F.array_position(x["families"], x["best"]).cast("int")
        shared = F.coalesce(*[F.when(place == k + 1, F.size(F.array_intersect(x["three"], _array(t)))) for k, t in enumerate(trigrams)])
        needed = F.element_at(_array(shortest), place)
        sure = F.when(x["three"].isNull(), F.lit(False)).otherwise((shared >= F.least(F.ceil(F.size(x["three"]) * CONTAINED), needed)) & (shared > 0))
        alike = sure | F.exists(x["matched"], lambda g: g.rlike("licen|rights reserved|copyright|spdx"))
        return F.struct(F.when(sure, F.element_at(_array(classes), place)).otherwise(F.lit(UNKNOWN)).alias("family"), x["best"].alias("score"), sure.alias("confirmed"), alike.alias("alike"))

    lines = F.transform(F.split(F.lower(text), BREAKS), lambda p, i: F.struct(i.alias("paragraph"), p.alias("line")))
    some = F.filter(lines, lambda p: p["line"].rlike(pattern))
    judged = F.transform(some, lambda p: F.struct(p["paragraph"].alias("paragraph"), scored(p["line"]).alias("found")))
    judged = F.filter(judged, lambda p: p["found"]["alike"])
    flat = F.transform(judged, lambda p: F.struct(p["paragraph"].alias("paragraph"), p["found"]["family"].alias("family"), p["found"]["score"].alias("score"), p["found"]["confirmed"].alias("confirmed")))
    return F.when(F.lower(text).rlike(pattern), flat)


def scan_licenses(docs: DataFrame, model: Model | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id and its notices."""
    model = model or train(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), notices(F.col(text_col), model).alias("notices"))


def summarised(scanned: DataFrame) -> DataFrame:
    """id, n_notices, n_unknown, families (sorted, comma-joined) and the best score."""
    found = F.coalesce(F.col("notices"), F.array().cast(scanned.schema["notices"].dataType))
    sure = F.filter(found, lambda x: x["confirmed"])
    return scanned.select(
        "id",
        F.size(found).cast("bigint").alias("n_notices"),
        (F.size(found) - F.size(sure)).cast("bigint").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(F.array_max(F.transform(found, lambda x: x["score"])), F.lit(0.0)).alias("best_score"),
    )
