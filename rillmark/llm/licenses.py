"""Licence scans: a trained paragraph classifier, scored in DataFrame functions alone.

Features are the presence of word n-grams (one to three words) of a paragraph.
A multinomial logistic regression with L1 penalty is trained on paragraphs made from
the fixed templates below: whole, in parts, and mixed with other words; sentences that talk of licences
without granting one (UNKNOWN), other words and scattered template words are the class `unknown`.  Its bias is then raised
until no unknown paragraph of a held-back set passes the threshold.

A paragraph is what stands between blank lines.  It is judged as a whole, as notices are wrapped,
and by its lines and each two neighbours of them, as several notices may stand in one.

A template can't be confirmed without some of its words, whatever else a paragraph holds (`anchors`);
a paragraph without any of them is not looked at, and most texts have none.  All else gets each family's sum of weights,
then a softmax.  A family is reported if its probability is at least THRESHOLD and the lines hold
at least CONFIRM of the n-grams of some template of the family.  Texts are neither
shuffled nor sent to Python.

Defined results: null and empty texts have no licences; every row gives a row; a
paragraph of any length is read whole; other columns are not read.
"""

from __future__ import annotations

import re
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST, THRESHOLD, CONFIRM = 3, 0.9, 0.6
# Opening words of public licence notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license as published by the free software foundation"),
    "apache-2.0": ("licensed under the apache license version 2.0", "you may obtain a copy of the license at http www apache org licenses license 2.0", "spdx license identifier apache 2.0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause"),
    "cc-by": ("licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"),
    "cc0": ("released under cc0 1.0 universal public domain dedication", "this is free and unencumbered software released into the public domain"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "spdx license identifier gpl 2.0"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "spdx license identifier gpl 3.0"),
    "lgpl-3.0": ("licensed under the gnu lesser general public license version 3", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    "mit": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx license identifier mit"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"),
}
#: Sentences of ordinary prose that hold words of the templates and grant nothing.
UNKNOWN = (
    "we applied for a license to fish in the public lake and were granted one free of charge",
    "the driver lost his license and was not permitted to use the vehicle without permission",
    "the software foundation was founded to publish free software for the general public",
    "a copy of the report may be obtained from the public library under the terms set out above",
    "the committee released the source of the funds and the terms of the agreement",
    "version 2 of the document was released to the public in may",
    "see the license file for the terms under which this software is distributed",
    "all rights reserved no part of this publication may be reproduced without written permission",
    "the university of california and mit published a study on creative commons and the public domain",
    "which license should i choose for my open source project the mit license or the apache license",
    "an international identifier is granted to any person who obtains a license",
    "redistribution of income and the use of public land were subject to modification",
    "the gnu project and the mozilla foundation write free software",
    "unlike the gnu general public license the bsd license has few terms",
    "he was licensed under the old law and obtained a charge card",
    "the clause in the contract permitted the source to be published in binary forms",
)
# Words too common to tell anything; no n-gram is made of them alone.
COMMON = frozenset("a an and any are as at by for free from in is it may of on or person use that the this to under with without work you".split())
FAMILIES = tuple(sorted(TEMPLATES))
_SPLIT = re.compile(r"[^a-z0-9]+")


def grams(text: str) -> set[str]:
    words = [w for w in _SPLIT.split(text.lower()) if w]
    runs = (words[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1))
    return {" ".join(r) for r in runs if any(len(w) > 1 and w not in COMMON for w in r)}


@cache
def model() -> tuple[list[str], np.ndarray, np.ndarray]:
    """N-grams, their weights by family with `unknown` last, and the biases.  Made of the templates alone; the same everywhere."""
    rng = np.random.default_rng(6)
    own = sorted(set().union(*(grams(t) for ts in TEMPLATES.values() for t in ts)))
    number = {g: k for k, g in enumerate(own)}
    words = sorted({g for g in own if " " not in g})
    texts: list[tuple[str, int]] = []
    for k, f in enumerate(FAMILIES):
        for t in TEMPLATES[f]:
            texts += [(t, k)] * 16
            parts = t.split()
            for _ in range(6):  # with words around it, and with one or two words lost
                noise = " ".join(rng.choice(words, 4))
                texts.append((f"{t} x {noise}", k))
                lost = set(rng.choice(len(parts), min(2, len(parts) // 5), replace=False).tolist())
                texts.append((" ".join(w for i, w in enumerate(parts) if i not in lost), k))
    unknown = [" ".join(rng.choice(words, int(rng.integers(1, 30)))) for _ in range(600)] + words + [""] * 40 + [*UNKNOWN[::2]] * 8
    held = [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(600)] + [*UNKNOWN]
    texts += [(t, len(FAMILIES)) for t in unknown]

    def matrix(rows: list[str]) -> np.ndarray:
        out = np.zeros((len(rows), len(own)))
        for i, t in enumerate(rows):
            out[i, [number[g] for g in grams(t) if g in number]] = 1
        return out

    x, y = matrix([t for t, _ in texts]), np.eye(len(FAMILIES) + 1)[[k for _, k in texts]]
    w, b = np.zeros((len(own), len(FAMILIES) + 1)), np.zeros(len(FAMILIES) + 1)
    for _ in range(1200):  # proximal gradient: the L1 step leaves few weights
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - y) / len(x)
        w -= 2.0 * g
        w = np.sign(w) * np.maximum(np.abs(w) - 2.0 * 1e-4, 0)
        b -= 2.0 * (p - y).mean(0)
    w, b = np.round(w, 4), np.round(b, 4)
    # Calibration: held-back unknown paragraphs, and one without any feature, must stay under half of the threshold's odds.
    z = np.concatenate((matrix(held) @ w + b, b[None, :]))
    over = (z[:, :-1].max(1) - z[:, -1]).max() - np.log(THRESHOLD / (1 - THRESHOLD)) + np.log(2)
    b[-1] = round(b[-1] + max(0.0, float(over)), 4)
    kept = np.flatnonzero(np.abs(w).sum(1))
    return [own[k] for k in kept], w[kept], b


@cache
def anchors() -> list[str]:
    """Of each template some words without which less than CONFIRM of its n-grams are left."""
    found = set()
    for t in (t for ts in TEMPLATES.values() for t in ts):
        left = grams(t)
        least = CONFIRM * len(left)
        while len(left) >= least:
            word = max({w for g in left for w in g.split()} - COMMON, key=lambda w: (w in found, sum(w in g.split() for g in left) * min(len(w), 6), w))
            found.add(word)
            left = {g for g in left if word not in g.split()}
    return sorted(w for w in found if not any(o != w and o in w for o in found))


def short_anchors() -> str:
    """A pattern of the anchors that would be found within too many other words."""
    return rf"\b({'|'.join(w for w in anchors() if len(w) <= 3)})\b"


def _norm(p: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(p, "[^a-z0-9]+", " "), F.lit(" "))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_unknown, families) of each row.

    n_paragraphs: pairs of a paragraph and a family that it confirms; n_unknown: paragraphs with
    an anchor and no family; families: distinct, sorted, comma-joined.
    """
    names, w, b = model()
    # A column of its own, as each use of an expression would lower the text again.
    lowered = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    low = F.col("low")

    def anchored(p: Column) -> Column:
        long = reduce(lambda x, y: x | y, (F.contains(p, F.lit(word)) for word in anchors() if len(word) > 3))
        return long | p.rlike(short_anchors())

    table = F.array(*(F.struct(F.lit(f" {g} ").alias("g"), F.array(*map(F.lit, map(float, row))).alias("w")) for g, row in zip(names, w, strict=True)))
    shapes = F.array(*(F.struct(F.lit(k).alias("k"), F.array(*(F.lit(f" {g} ") for g in sorted(grams(t)))).alias("grams")) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f]))
    bias = F.array(*map(F.lit, map(float, b)))

    def family(p: Column) -> Column:
        """The family's number, or the number of families for none."""
        held = F.filter(table, lambda x: F.contains(p, x["g"]))
        z = F.aggregate(held, bias, lambda s, x: F.zip_with(s, x["w"], lambda u, v: u + v))

        def decide(v: Column) -> Column:
            best = F.array_max(F.slice(v, 1, len(FAMILIES)))
            total = F.aggregate(v, F.lit(0.0), lambda s, u: s + F.exp(u - best))
            k = F.array_position(v, best).cast("int") - 1
            shape = F.exists(shapes, lambda t: (t["k"] == k) & (F.size(F.filter(t["grams"], lambda g: F.contains(p, g))) >= CONFIRM * F.size(t["grams"])))
            return F.when((1 / total >= THRESHOLD) & shape, k).otherwise(F.lit(len(FAMILIES)))

        return F.element_at(F.transform(F.array(z), decide), 1)

    def judged(p: Column) -> Column:
        """The families that a paragraph confirms."""
        lines = F.split(p, "\n")
        pairs = F.zip_with(F.slice(lines, F.lit(1), F.size(lines) - 1), F.slice(lines, F.lit(2), F.size(lines)), lambda x, y: F.concat_ws("\n", x, y))
        own = F.filter(F.array_distinct(F.concat(lines, pairs, F.array(p))), anchored)
        return F.filter(F.array_distinct(F.transform(own, lambda x: family(_norm(x)))), lambda k: k < len(FAMILIES))

    found = F.transform(F.filter(F.split(low, r"\n[ \t\r]*(?:\n[ \t\r]*)+"), anchored), judged)
    rows = lowered.select("doc_id", F.when(anchored(low), found).otherwise(F.array().cast("array<array<int>>")).alias("found"))
    labels = F.array(*map(F.lit, FAMILIES))
    return rows.select(
        "doc_id",
        F.size(F.flatten("found")).cast("long").alias("n_paragraphs"),
        F.size(F.filter("found", lambda x: F.size(x) == 0)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.flatten("found"), lambda k: F.get(labels, k)))), ",").alias("families"),
    )
