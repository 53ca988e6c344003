"""License scans: normalised lines, paragraphs and texts against licence templates by Dice's coefficient over word pairs.

DataFrame functions only. Two sizes bound the coefficient, so a template is only compared with units of a near size. A
unit must also hold one of a few words: if it lacks them all, so does it lack every pair with one of them, and too few
pairs of any template are left to reach the threshold. Both tests lose nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandscope.llm.common import id_and_text

THRESHOLD = 0.8

# Public licence notices by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def pairs_of(text: str) -> list[str]:
    """The distinct word pairs of a template, in order."""
    own = re.sub(r"[^0-9a-z]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(own, own[1:], strict=False)))


def bounds(n: int, threshold: float) -> tuple[float, float]:
    """Least and most pairs of a unit that can reach the threshold against ``n`` pairs."""
    return threshold * n / (2 - threshold) - 1e-9, (2 - threshold) * n / threshold + 1e-9


def gate_words(templates: list[list[str]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold against a template holds at least one.

    A matching unit shares at least ``shared`` of n pairs, so words that touch more than n - shared pairs are enough.
    Chosen greedily; longer words first, as they are rarer.
    """
    open_pairs = [set(pairs) for pairs in templates]
    need = []
    for pairs in templates:
        n = len(pairs)
        shared = math.ceil(threshold * (n + bounds(n, threshold)[0]) / 2 - 1e-9)
        need.append(n - shared + 1)
    chosen: list[str] = []
    while any(k > 0 for k in need):
        gain: dict[str, int] = {}
        for pairs, k in zip(open_pairs, need, strict=True):
            if k > 0:
                touched = Counter(w for p in pairs for w in set(p.split()))
                for word, n in touched.items():
                    gain[word] = gain.get(word, 0) + min(n, k) * 3 ** min(len(word), 8)
        word = max(gain, key=lambda w: (gain[w], w))
        chosen.append(word)
        for t, pairs in enumerate(open_pairs):
            left = {p for p in pairs if word not in p.split()}
            need[t] -= len(pairs) - len(left)
            open_pairs[t] = left
    return chosen


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a column that is worked out once: filters on it are not pushed below the explode, with another copy."""
    return df.select("*", F.explode(F.array(column)).alias(name)) if name not in df.columns else df.select(
        *[c for c in df.columns if c != name], F.explode(F.array(column)).alias(name))


def _best_units(docs: DataFrame, templates: list[tuple[str, str]] | None, threshold: float, id_col: str, text_col: str
                ) -> DataFrame:
    """doc_id, row_id, unit, place, best of every matching unit, and for every document a row with null in the last three."""
    own = [(name, pairs_of(text)) for name, text in (TEMPLATES if templates is None else templates)]
    own = [(name, pairs) for name, pairs in own if pairs]
    gate = gate_words([pairs for _, pairs in own], threshold)
    holds = lambda text: reduce(or_, (text.contains(f" {word} ") for word in gate), F.lit(False))
    spaced = F.concat(F.lit(" "), F.translate("plain", "\n", " "), F.lit(" "))
    least = min((bounds(len(p), threshold)[0] for _, p in own), default=1)
    most = max((bounds(len(p), threshold)[1] for _, p in own), default=0)
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ")
    lines = F.split("plain", "\n")
    unit = lambda kind, parts: F.transform(
        parts, lambda part, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("place"), part.alias("plain")))
    paragraphs = F.split("plain", r"\n(?: ?\n)+")
    several = lambda kind, parts: F.transform(parts, lambda part, i: F.struct(
        F.lit(kind).alias("unit"), i.cast("long").alias("place"),
        F.when(F.instr(F.trim(part), "\n") > 0, part).otherwise(F.lit("")).alias("plain")))
    mark = F.array(F.struct(F.lit(None).cast("string").alias("unit"), F.lit(None).cast("long").alias("place"), F.lit("").alias("plain")))
    whole = F.array(F.struct(
        F.lit("text").alias("unit"), F.lit(0).cast("long").alias("place"),
        F.when(F.size(paragraphs) > 1, F.col("plain")).otherwise(F.lit("")).alias("plain")))
    units = (
        id_and_text(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row_id"), "text"))
    units = _once(_once(units, "plain", plain), "spaced", spaced).select("doc_id", "row_id", F.explode(F.when(
        holds(F.col("spaced")), F.concat(mark, unit("line", lines), several("paragraph", paragraphs), whole)).otherwise(mark)).alias("u"))
    units = units.select("doc_id", "row_id", "u.*").where(F.col("unit").isNull() | holds(spaced))
    units = _once(units, "words", F.split(F.trim(F.translate("plain", "\n", " ")), " +"))
    units = units.where(F.col("unit").isNull() | (F.size("words") > least))  # n pairs need more than n words
    n = F.size("words") - 1
    pairs = F.array_distinct(F.zip_with(
        F.slice("words", 1, n), F.slice("words", 2, n), lambda a, b: F.concat_ws(" ", a, b)))
    sized = _once(units, "pairs", F.when(F.col("unit").isNotNull(), pairs)).where(
        F.col("unit").isNull() | F.size("pairs").between(least, most))
    scored = sized.withColumn("best", F.array_max(F.array_compact(F.array(
        *(_coefficient(name, p, threshold, F.col("pairs"), place) for place, (name, p) in enumerate(own)),
        F.lit(None).cast("struct<dice:double,place:int,license:string>")))))
    return scored.select("doc_id", "row_id", "unit", "place", "best").where("unit IS NULL OR best IS NOT NULL")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per matching unit: doc_id, unit (line, paragraph, text), place, license, dice.

    A unit gets its best template; equal coefficients go to the template listed first. A paragraph of one line and a
    text of one paragraph count only once, as the smaller unit. Places count from 0.
    """
    return _best_units(docs, templates, threshold, id_col, text_col).where("unit IS NOT NULL").select(
        "doc_id", "unit", "place", "best.license", "best.dice")


def _coefficient(name: str, pairs: list[str], threshold: float, unit: Column, place: int) -> Column:
    """(dice, order, license) of a unit of a size within bounds, or null."""
    low, high = bounds(len(pairs), threshold)
    shared = F.size(F.array_intersect(unit, F.array(*map(F.lit, pairs))))
    dice = 2.0 * shared / (F.size(unit) + len(pairs))
    return F.when(F.size(unit).between(low, high), F.when(dice >= threshold, F.struct(
        dice.alias("dice"), F.lit(-place).alias("place"), F.lit(name).alias("license"))))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_hits, licenses (distinct, in order), best, hits (unit:place:license).

    Null and empty texts have no hits; a null id is reported as null. Repeated rows are reported one by one. No rows
    give no rows; other columns are not read.
    """
    found = _best_units(docs, templates, threshold, id_col, text_col).groupBy("row_id", "doc_id").agg(
        F.count("unit").alias("n_hits"), F.sort_array(F.collect_set("best.license")).alias("licenses"),
        F.max("best.dice").alias("best"),
        F.sort_array(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("unit", "place", "best.license")))).alias("hits"))
    return found.select(
        "doc_id", "n_hits", F.array_join("licenses", ",").alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"),
        F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["unit"], h["place"], h["license"])), ",").alias("hits"))
