"""Licence scans in DataFrame operations only.

Lines, paragraphs of several lines, and texts of several paragraphs are compared to
templates by the Dice coefficient of their sets of word pairs. A unit can reach the
threshold only if its number of different pairs lies within a template's bounds, and only if it has
two thirds of the template's pairs (at 0.8), so texts and units without any of a few words,
chosen so that too few pairs of any template remain without them, are passed over. No row leaves
its task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.llm.shared import documents

# Public licence texts and usual notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "all-rights-reserved": ("All rights reserved.",),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,'
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
        " permissions and limitations under the License.",
    ),
    "bsd": (
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
        " software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT'
        " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        " the above copyright notice and this permission notice appear in all copies.",
    ),
    "mit": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the'
        ' "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,'
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to"
        " the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF'
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY"
        " CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
        " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled"
        " binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages"
        " arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute"
        " it freely, subject to the following restrictions:",
    ),
}
THRESHOLD = 0.8
_GAPS = r"[^\p{L}\p{N}]+"


def _pairs(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


#: Taken last, as most texts have some of them.
_COMMON = frozenset("a an and any are as at be by for from in into is it mit may no not of on only or such that the this to under use used with without you 0 1 2 3 4 5".split())


Templates = tuple[tuple[str, tuple[str, ...]], ...]


def templates(texts: Mapping[str, Iterable[str]] = TEMPLATES) -> Templates:
    """(licence, its different word pairs) of each template text; a text has two words at least."""
    out = tuple((name, tuple(_pairs(t))) for name, each in texts.items() for t in each)
    if not out or not all(pairs for _, pairs in out):
        raise ValueError("a template needs two words")
    return out


@cache
def needed_words(threshold: float, known: Templates) -> tuple[str, ...]:
    """A few words of which every unit that reaches the threshold has one.

    Dice of at least t needs t / (2 - t) of a template's pairs. Words are taken, uncommon ones that
    touch many pairs first, until each template has fewer pairs than that without any of them.
    """
    left = [(set(pairs), math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)) for _, pairs in known]
    out: list[str] = []
    while open_ := [(pairs, most) for pairs, most in left if len(pairs) >= most]:
        touched = Counter(w for pairs, most in open_ for p in pairs for w in set(p.split()) for _ in range(1000 // most))
        word = max(touched, key=lambda w: (w not in _COMMON, touched[w], w))
        out.append(word)
        left = [({p for p in pairs if word not in p.split()}, most) for pairs, most in left]
    return tuple(sorted(out))


def _units(text: str) -> Column:
    """(kind, position, text) of the units; positions count from 0."""
    numbered = lambda kind, parts: F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("position"), x.alias("body")))
    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    wide = F.filter(numbered("paragraph", paragraphs), lambda u: F.contains(u["body"], F.lit("\n")))
    whole = F.when(F.size(paragraphs) > 1, numbered("text", F.array(F.col(text)))).otherwise(F.filter(numbered("text", F.array(F.col(text))), lambda u: F.lit(False)))
    return F.concat(numbered("line", F.split(text, r"\n")), wide, whole)


def licence_matches(docs: DataFrame, threshold: float = THRESHOLD, texts: Mapping[str, Iterable[str]] = TEMPLATES) -> DataFrame:
    """``doc_id, unit, position, licence, dice``: units that reach the threshold with a template, and the best one.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty texts have no match. Of
    templates of equal Dice the first by name counts. Equal rows give equal matches each. An empty table gives none.
    ``texts``: licences and their template texts, of any length; they are put into the plan, so hundreds of them, not millions.
    """
    prepared = templates(texts)
    words_needed = needed_words(threshold, prepared)
    low = threshold / (2 - threshold)
    known = F.array(*[F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, pairs)).alias("pairs")) for name, pairs in prepared])
    needed = F.array(*map(F.lit, words_needed))
    words = lambda body: F.array_remove(F.split(F.regexp_replace(F.lower(body), _GAPS, " "), " "), "")
    # kept inside one expression: a filter above a projection would have the words made twice
    worded = F.transform(_units("text"), lambda u: F.struct(u["unit"].alias("unit"), u["position"].alias("position"), words(u["body"]).alias("words")))
    # a unit has no fewer pairs than different words, less one
    most = max(len(pairs) for _, pairs in prepared) / low + 1
    kept = F.filter(worded, lambda u: F.arrays_overlap(u["words"], needed) & (F.size(F.array_distinct(u["words"])) <= most))
    second = F.slice("u.words", F.lit(2), F.greatest(F.size("u.words") - 1, F.lit(0)))
    pairs = F.array_distinct(F.array_compact(F.zip_with("u.words", second, lambda a, b: F.concat(a, F.lit(" "), b))))
    fits = lambda t: (F.size(t["pairs"]) >= F.size("pairs") * low) & (F.size(t["pairs"]) * low <= F.size("pairs"))
    dice = lambda t: 2.0 * F.size(F.array_intersect(F.col("pairs"), t["pairs"])) / (F.size("pairs") + F.size(t["pairs"]))
    found = F.transform(F.filter(known, fits), lambda t: F.struct((-dice(t)).alias("less"), t["licence"].alias("licence")))
    enough = F.filter(F.array(F.array_min(found)), lambda b: b["less"] <= -threshold)
    return (
        docs.where(F.lower("text").rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(words_needed) + r")(?![\p{L}\p{N}])"))
        .select("doc_id", F.explode(kept).alias("u")).select("doc_id", "u.unit", "u.position", pairs.alias("pairs"))
        .select("doc_id", "unit", "position", F.explode(enough).alias("best"))
        .select("doc_id", "unit", "position", F.col("best.licence").alias("licence"), F.round(-F.col("best.less"), 6).alias("dice"))
    )


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_matches(documents(spark, sf_dir))


def oracle() -> str:
    """The same in DuckDB, without passing over any unit."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, p))}])" for n, p in templates())
    return rf"""
WITH templates(licence, tpairs) AS (VALUES {values}),
units AS (
  SELECT doc_id, 'line' AS unit, i - 1 AS position, l[i] AS body
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
  UNION ALL
  SELECT doc_id, 'paragraph', i - 1, p[i]
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS p FROM documents WHERE text IS NOT NULL))
  WHERE contains(p[i], chr(10))
  UNION ALL
  SELECT doc_id, 'text', 0, text FROM documents WHERE len(regexp_split_to_array(text, '\n[ \t\r]*\n')) > 1),
worded AS (
  SELECT *, list_filter(string_split(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM units),
paired AS (
  SELECT doc_id, unit, position, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pairs FROM worded WHERE len(w) > 1),
scored AS (
  SELECT doc_id, unit, position, licence, 2.0::DOUBLE * len(list_intersect(pairs, tpairs)) / (len(pairs) + len(tpairs)) AS d, pairs
  FROM paired, templates),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit, position ORDER BY d DESC, licence) AS k FROM scored WHERE d >= {THRESHOLD})
SELECT doc_id, unit, CAST(position AS INT) AS position, licence, round(d, 6) AS dice FROM ranked WHERE k = 1
"""
