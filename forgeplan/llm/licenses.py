"""Licence scans: a trained paragraph classifier over word n-grams, confirmed by comparison with templates.

Paragraphs are runs of lines up to a blank one. Each line is scored by itself, and so are the pieces of a paragraph:
SPAN lines joined, one piece every STEP lines, so that a notice wrapped over up to SPAN - STEP + 1 lines is whole in
one. Words (letters and digits with inner dots, lower case, stop words dropped) give unigrams and bigrams; a
multinomial logistic regression over those seen in the templates, trained on the driver from the templates' notices,
shortened and mixed copies of them, scraps (less than half of a notice) and decoys, names a family or `unknown`. Its temperature and the least probability
of a family are calibrated on copies, scraps and decoys of which none was trained on (every third decoy, and scraps
mixed with these, are only used there), so that they stay unknown. A family counts only if a template of it is
confirmed: a line holds at least `overlap` of the template's n-grams, a piece PIECE of them. A piece counts for a
family that none of its lines is sure of, and pieces that overlap count once.

The model is some hundred n-grams with a weight for each family, and travels as a literal of the plan. Scoring is
column expressions. Texts and lines without any of the vocabulary's letter runs are not scored: they have no feature
but numbers, which the model calls unknown (checked when it is fitted), and a piece has the features of its lines.

Ids of any type are carried as they are. Cases: null, empty and blank texts have no paragraph and no licence; ties go
to the first family by name, and to the first place; repeated rows and null ids keep their rows; an empty table gives
an empty table; very long texts are scored whole; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secrets import let

#: Notices of each family.
TEMPLATES = {
    "AGPL": ["licensed under the GNU Affero General Public License version 3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License", "licensed under the BSD 2-Clause license", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0", "text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC0": ["dedicated to the public domain under CC0 1.0 Universal", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights"],
    "GPL": ["licensed under the GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GPL", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License", "SPDX-License-Identifier: ISC"],
    "LGPL": ["licensed under the GNU Lesser General Public License version 2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Released under the Unlicense"],
    "all-rights-reserved": ["All rights reserved", "Copyright. All rights reserved", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher"],
}
#: Sentences near licences that name none, and words left out.
DECOYS = [
    "a license is required to drive this car", "the license plate was stolen", "licensed to practise medicine in this state", "the software was released last year",
    "copy the files and modify the source", "the general public is free to use the library", "version 3 of the documentation was released", "terms and conditions apply to this work",
    "she obtained her fishing license", "the author granted permission to publish", "the foundation published the terms", "binary and source code are available free of charge",
    "the work is in the public library", "use of this file is subject to conditions", "see the license for details", "licensed under terms of a separate agreement", "international commons for creative work",
]
STOP = "the a an and or of to in for is are be by with without this that it its as at on any all you may not from under which has his her can into no met".split()
WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}.+-]*[\p{L}\p{N}+])?"
UNKNOWN = "unknown"
#: Lines of a piece, lines between pieces, and the share of a template's n-grams that a piece must hold.
SPAN, STEP, PIECE = 6, 3, 0.75


@dataclass(frozen=True)
class Model:
    families: list[str]  # by name, UNKNOWN last
    weights: dict[str, list[float]]
    intercept: list[float]
    least: float


def split(text: str) -> list[str]:
    return [w for w in re.findall(r"[^\W_](?:[\w.+-]*[^\W_]|[\w.+-]*\+)?", text.lower()) if w not in STOP]


def grams(words: list[str]) -> list[str]:
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache
def fit(copies: int = 24, rounds: int = 300, l2: float = 1e-3, seed: int = 0) -> Model:
    """The model: some hundred notices, their copies and the decoys; a fixed amount of work on the driver."""
    rng = np.random.default_rng(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    vocabulary = {g: i for i, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(split(t))}))}
    every = [split(d) for d in DECOYS]
    sides = [[d for i, d in enumerate(every) if i % 3], every[::3]]  # trained on, and held out
    unknown = len(families) - 1
    rows: list[tuple[list[str], int, bool]] = [([], unknown, False)] * 20
    for k, name in enumerate(families[:-1]):
        for t in TEMPLATES[name]:
            w = split(t)
            rows += [(w, k, False)] * 2
            for _ in range(copies):
                held = bool(rng.random() < 0.25)
                decoy = lambda: sides[held][rng.integers(len(sides[held]))]  # noqa: B023, E731
                kept = [x for x in w if rng.random() > 0.1]
                rows.append(([*decoy(), *kept] if rng.random() < 0.3 else kept, k, held))
                other = [x for x in w if rng.random() < 0.3]  # scraps of a notice name no family
                if 2 * len({*grams(other)} & {*grams(w)}) < len(grams(w)):
                    rows.append(([*decoy(), *other], unknown, held))
    rows += [(d, unknown, held) for held in (False, True) for d in sides[held]] * 4
    x = np.zeros((len(rows), len(vocabulary)))
    for i, (w, _, _) in enumerate(rows):
        x[i, [vocabulary[g] for g in grams(w) if g in vocabulary]] = 1
    y = np.array([k for _, k, _ in rows])
    held = np.array([h for _, _, h in rows])
    target = np.eye(len(families))[y]
    w, b = np.zeros((x.shape[1], len(families))), np.zeros(len(families))
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        gap = (_softmax(x[~held] @ w + b) - target[~held]) / (~held).sum()
        speed_w, speed_b = 0.9 * speed_w - 2.0 * (x[~held].T @ gap + l2 * w), 0.9 * speed_b - 2.0 * gap.sum(axis=0)
        w, b = w + speed_w, b + speed_b
    scores = x[held] @ w + b
    heat = min((0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(_softmax(scores / t)[np.arange(held.sum()), y[held]] + 1e-12).mean())
    p = _softmax(scores / heat)
    wrong = p[y[held] == len(families) - 1, :-1].max(axis=1)  # the family probability of rows that have none
    least = float(np.clip(np.quantile(wrong, 0.98), 0.5, 0.95))
    w, b = w / heat, b / heat
    if b.argmax() != len(families) - 1:
        raise AssertionError("a paragraph without features must be unknown")
    return Model(families, {g: [round(float(v), 4) for v in w[i]] for g, i in vocabulary.items()}, [round(float(v), 4) for v in b], least)


def signs(model: Model) -> list[str]:
    """Runs of ASCII letters and digits one of which every paragraph with a family holds.

    These are the runs of the vocabulary's words. Numbers are left out where they cannot name a family by themselves.
    """
    numeric = [g for g in model.weights if not re.search("[a-z]", g)]
    w, b = np.array([model.weights[g] for g in numeric]).reshape(len(numeric), -1), np.array(model.intercept)
    alone = (b[:-1] + np.clip(w[:, :-1], 0, None).sum(axis=0)).max() < b[-1] + np.clip(w[:, -1], None, 0).sum()
    words = [re.findall("[a-z0-9]+", g) for g in model.weights if " " not in g]
    # a word with several runs holds each of them: its longest one that is no stop word stands for it
    runs = {max(w, key=lambda r: (r not in STOP and not r.isdigit(), len(r), r)) for w in words}
    return sorted(r for r in runs if not (alone and r.isdigit()))


def _signed(text: Column, signs: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), "[^a-z0-9]+"), _literal(signs))


def _literal(values: list) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(STOP))


def _grams(words: Column) -> Column:
    return let(words, lambda a: F.array_distinct(F.concat(a, F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.size(a)), lambda x, y: F.concat_ws(" ", x, y)))))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r")) == ""


def _pieces(lines: Column, signed: Column) -> Column:
    """array<struct(at, until, line)>: the pieces of two lines or more about the lines at the places `signed`, joined.

    Windows of SPAN lines begin at every STEP-th line of the text; blank lines cut them.
    """
    windows = lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit((SPAN - 1) // STEP)), lambda k: (F.floor(i / STEP) - k).cast("int") * STEP), lambda s: (s >= 0) & (i < s + SPAN))
    starts = F.array_distinct(F.flatten(F.transform(signed, windows)))

    def cut(s: Column, rows: Column) -> Column:
        ends = lambda j: F.coalesce(F.array_min(F.transform(rows, lambda x, k: F.when(_blank(x) & (k >= j), k))), F.size(rows))
        own = lambda x, j: F.when(~_blank(x) & ((j == 0) | _blank(F.get(rows, j - 1))), let(ends(j), lambda e: F.when(e - j > 1, F.struct((s + j).alias("at"), (s + e).alias("until"), F.replace(F.array_join(F.slice(rows, j + 1, e - j), "\n"), F.lit("-\n"), F.lit("-")).alias("line")))))
        return F.filter(F.transform(rows, own), lambda x: x.isNotNull())

    return F.flatten(F.transform(starts, lambda s: let(F.slice(lines, s + 1, F.lit(SPAN)), lambda rows: cut(s, rows))))


def paragraphs(text: Column, model: Model, prefilter: bool = True) -> Column:
    """array<struct(at, until, family, probability, overlap)> of the lines and pieces of `text` that have a feature; `until` is null for a line."""
    names = sorted(model.weights)
    # one array of weights for each n-gram, found by the n-gram's place in a literal array
    table = F.from_json(F.lit("[" + ",".join(str(model.weights[g]) for g in names) + "]"), "array<array<double>>")
    keys = _literal(names)
    families = _literal(model.families)
    shapes = F.array(*(F.struct(F.lit(k).alias("family"), _literal(grams(split(t))).alias("grams")) for k, f in enumerate(model.families[:-1]) for t in TEMPLATES[f]))
    marks = signs(model)

    def score(g: Column) -> Column:
        known = F.transform(F.array_intersect(g, keys), lambda x: F.array_position(keys, x).cast("int"))
        logits = F.aggregate(known, _literal(model.intercept), lambda a, i: F.zip_with(a, F.get(table, i - 1), lambda x, y: x + y))
        best = let(logits, lambda z: let(F.array_max(z), lambda top: F.struct((F.array_position(z, top) - 1).cast("int").alias("k"), (1 / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("p"))))
        shared = lambda b: F.array_max(F.transform(F.filter(shapes, lambda s: s["family"] == b["k"]), lambda s: F.size(F.array_intersect(s["grams"], g)) / F.size(s["grams"])))
        return F.when(F.size(known) > 0, let(best, lambda b: F.struct(F.get(families, b["k"]).alias("family"), b["p"].alias("probability"), F.coalesce(shared(b), F.lit(0.0)).alias("overlap"))))

    def scored(units: Column) -> Column:
        each = F.transform(units, lambda x: F.struct(x["at"].alias("at"), x["until"].alias("until"), let(_grams(_words(x["line"])), score).alias("s")))
        return F.transform(F.filter(each, lambda x: x["s"].isNotNull()), lambda x: F.struct(x["at"].alias("at"), x["until"].alias("until"), x["s"]["family"].alias("family"), x["s"]["probability"].alias("probability"), x["s"]["overlap"].alias("overlap")))

    def units(lines: Column) -> Column:
        held = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("at"), F.lit(None).cast("int").alias("until"), line.alias("line"))), lambda x: _signed(x["line"], marks) if prefilter else F.lit(True))
        return let(held, lambda some: F.concat(some, _pieces(lines, F.transform(some, lambda x: x["at"]))))

    return let(let(F.split(text, "\n"), units), scored)


def _counted(found: Column, least: float, overlap: float) -> Column:
    """The lines that are sure of a family, and the pieces whose family no line or earlier piece within them is sure of."""
    sure = F.filter(found, lambda x: (x["family"] != UNKNOWN) & (x["probability"] >= least) & (x["overlap"] >= F.when(x["until"].isNull(), overlap).otherwise(PIECE)))

    def own(all_: Column) -> Column:
        last = lambda x: F.coalesce(x["until"], x["at"] + 1)
        meets = lambda x, y: (x["family"] == y["family"]) & (y["at"] < last(x)) & (x["at"] < last(y))
        return F.filter(all_, lambda x: x["until"].isNull() | ~F.exists(all_, lambda y: meets(x, y) & (y["until"].isNull() | (y["at"] < x["at"]))))

    return let(sure, own)


def n_paragraphs(text: Column) -> Column:
    """How many runs of lines between blank ones."""
    filled = F.transform(F.split(text, "\n"), lambda x: ~_blank(x))
    return let(filled, lambda a: F.size(F.filter(F.transform(a, lambda x, i: x & ((i == 0) | ~F.coalesce(F.get(a, i - 1), F.lit(False)))), lambda x: x))).cast("long")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overlap: float = 0.5, prefilter: bool = True) -> DataFrame:
    """One row for each document: its number of paragraphs, the licences found, and the surest one with its first line."""
    model = fit()
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    empty = F.array().cast("array<struct<at:int,until:int,family:string,probability:double,overlap:double>>")
    some = _signed(F.col("text"), signs(model)) if prefilter else F.lit(True)
    df = df.withColumn("sure", F.when(some, _counted(paragraphs(F.col("text"), model, prefilter), model.least, overlap)).otherwise(empty))
    by_sure = F.transform("sure", lambda x: F.struct((-x["probability"]).alias("p"), x["at"].alias("at"), x["family"].alias("family"), x["overlap"].alias("overlap")))
    df = df.withColumn("best", F.get(F.array_sort(by_sure), F.lit(0)))
    return df.select(
        "doc_id", n_paragraphs(F.col("text")).alias("n_paragraphs"), F.size("sure").cast("long").alias("n_license_paragraphs"), F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda x: x["family"]))), ",").alias("licenses"),
        F.coalesce(F.col("best.family"), F.lit(UNKNOWN)).alias("family"), (-F.col("best.p")).alias("probability"), F.col("best.overlap").alias("overlap"), F.col("best.at").cast("long").alias("paragraph"),
    )
