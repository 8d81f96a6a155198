"""Licence scan: passages compared with licence templates by the Dice coefficient of their word bigrams.

A passage is a line of a text, the whole text, or a window: a run of neighbouring words anywhere in the text, over
line ends and beside other words on a line. It is normalised to lower-case words of a-z and 0-9, with one spelling of
"license". The Dice coefficient of two sets is twice their intersection over the sum of their sizes. Lines and the whole
text are compared with ``TEMPLATES``, windows also with the full licence texts of ``licence_texts``. A window has at most
``(2 - LEAST) / LEAST`` times the pairs of its template, repeats counted in both; of windows that overlap, the one that shares most pairs
counts; a window inside a line that was found, or of the licence that the whole text was found to be, is no second passage.
All of it is done row by row, in Python; a text without one of the templates' rare pairs is left at once, exactly.

Defined results: a null or empty text, and a passage without words, matches nothing; a passage of one word has
that word as its only bigram; ties go to the template first by name; repeated rows give repeated results;
other columns pass through ``scan`` unless they are called ``found``, which is replaced.
"""

from __future__ import annotations

import math
import os
import re
from bisect import bisect, bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.arrays import unused

LEAST = 0.8

# Notices and opening passages of public licences, by their public short names.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
]


# Whole licence texts, by the names of their files; they are compared with windows only.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licence_texts")

Pair = tuple[str, ...]


def words_of(passage: str) -> list[str]:
    """Normalised words of a passage."""
    return re.sub("[^a-z0-9]+", " ", passage.lower()).replace("licence", "license").split()


def pairs_of(words: list[str]) -> list[Pair]:
    """Pairs of neighbouring words; one word stands for itself."""
    return list(zip(words, words[1:])) if len(words) > 1 else [tuple(words)] if words else []


def full_texts() -> list[tuple[str, str]]:
    """Name and text of the licences that are here in full."""
    found = []
    for name in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, name), encoding="utf-8") as text:
            found.append((name.removesuffix(".txt"), text.read()))
    return found


@dataclass
class Known:
    """Templates ready for comparison; the first ``n_short`` are those of lines and whole texts."""
    names: list[str]
    sizes: list[int]
    longest: list[int]
    needs: list[int]
    n_short: int
    where: dict[Pair, list[tuple[int, int]]]
    seeds: frozenset[Pair]
    single: bool
    least: float


def compiled(short: list[tuple[str, str]], full: list[tuple[str, str]], least: float) -> Known:
    """The templates by their pairs.

    A passage that is alike enough has at least ``least / (2 - least)`` of the pairs of a template, so it has one of
    any set of pairs that is larger than what may be missing: the template's seeds, of its rarest words.
    """
    if not 0 < least <= 1:
        raise ValueError("least must lie above 0 and be at most 1")
    parts = [(name, words_of(text)) for name, text in [*short, *full]]
    often = Counter(w for _, words in parts for w in words)
    known = Known([], [], [], [], len(short), {}, frozenset(), False, least)
    seeds: set[Pair] = set()
    for t, (name, words) in enumerate(parts):
        own = list(dict.fromkeys(pairs_of(words)))
        need = max(1, math.ceil(len(own) * least / (2 - least) - 1e-9))
        known.names.append(name)
        known.sizes.append(len(own))
        known.longest.append(int(len(pairs_of(words)) * (2 - least) / least + 1e-9))
        known.needs.append(need)
        for i, pair in enumerate(own):
            known.where.setdefault(pair, []).append((t, i))
        seeds.update(sorted(own, key=lambda p: math.prod(often[w] for w in p))[:len(own) - need + 1])
    known.seeds = frozenset(seeds)
    known.single = any(len(s) == 1 for s in seeds)
    return known


def _best(pairs: list[Pair], known: Known) -> tuple[float, str] | None:
    """The most alike short template of a passage, as ``(-score, name)``."""
    own = set(pairs)
    shared = Counter(t for p in own for t, _ in known.where.get(p, ()) if t < known.n_short)
    scores = [(-2.0 * x / (len(own) + known.sizes[t]), known.names[t]) for t, x in shared.items()]
    return min((s for s in scores if -s[0] >= known.least), default=None)


def _before(ids: np.ndarray) -> np.ndarray:
    """The place before each at which the same number stands, -1 for none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), -1)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _windows_of(at: np.ndarray, ids: np.ndarray, before: np.ndarray, size: int, longest: int, need: int, least: float) -> list[tuple[float, int, int, int]]:
    """The best windows of one template, apart from each other: ``(score, first, last, shared)`` in places of pairs.

    A window of a best score begins and ends at pairs of the template.
    """
    known_before, ends = _before(ids), np.searchsorted(at, at + longest)
    found = []
    for i in np.flatnonzero(ends - np.arange(len(at)) >= need):
        shared = np.cumsum(known_before[i:ends[i]] < i)
        if shared[-1] < need:
            continue
        places = at[i:ends[i]] - at[i]
        own = np.cumsum(before[at[i]:at[i] + places[-1] + 1] < at[i])[places]
        score = 2.0 * shared / (own + size)
        j = int(np.argmax(score))
        if score[j] >= least:
            found.append((float(score[j]), int(at[i]), int(at[i + j]), int(shared[j])))
    return _apart(sorted(found, key=lambda w: (-w[0], w[1])))


def _apart(windows: list[tuple]) -> list[tuple]:
    """Windows, first come, that do not overlap one before them; places 1 and 2 are first and last."""
    firsts, lasts, kept = [], [], []
    for w in windows:
        k = bisect(lasts, w[1] - 1)
        if k == len(firsts) or firsts[k] > w[2]:
            firsts.insert(k, w[1])
            lasts.insert(k, w[2])
            kept.append(w)
    return kept


def _windows(pairs: list[Pair], known: Known) -> list[tuple[float, int, int, int, str]]:
    """Windows of a text that are alike a template; of those that overlap, the one that shares most pairs."""
    places: dict[int, tuple[list[int], list[int]]] = {}
    for p, pair in enumerate(pairs):
        for t, i in known.where.get(pair, ()):
            at, ids = places.setdefault(t, ([], []))
            at.append(p)
            ids.append(i)
    number: dict[Pair, int] = {}
    before = None
    found = []
    for t, (at, ids) in places.items():
        if len(set(ids)) < known.needs[t]:
            continue
        if before is None:
            before = _before(np.array([number.setdefault(p, len(number)) for p in pairs]))
        for w in _windows_of(np.array(at), np.array(ids), before, known.sizes[t], known.longest[t], known.needs[t], known.least):
            found.append((*w, known.names[t]))
    return _apart(sorted(found, key=lambda w: (-w[3], -w[0], w[4], w[1])))


def found_in(text: str, known: Known) -> list[tuple[float, str]]:
    """``(score, name)`` of the whole text, its lines, and windows that are no part of those, best first."""
    words = words_of(text)
    if len(words) > 1 and known.seeds.isdisjoint(zip(words, words[1:])) and not known.single:
        return []
    pairs = pairs_of(words)
    whole = _best(pairs, known)
    found, covered, start = [whole] if whole else [], [], 0
    if "\n" in text:
        for line in text.split("\n"):
            own = words_of(line)
            best = _best(pairs_of(own), known)
            if best:
                found.append(best)
                covered.append((start, start + len(own) - 2))
            start += len(own)
    elif whole:
        covered.append((0, len(words)))
    lasts = [last for _, last in covered]
    for score, first, last, _, name in _windows(pairs, known) if len(words) > 1 else []:
        k = bisect_left(lasts, last)
        inside = k < len(covered) and covered[k][0] <= first
        if not inside and not (whole and whole[1] == name):
            found.append((-score, name))
    return [(-less, name) for less, name in sorted(found)]


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, full: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Add ``found``: the best template of each line, of the whole text if it has several, and of windows, best first."""
    known = compiled(templates, full_texts() if full is None else full, least)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("name", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [[{"score": s, "name": n} for s, n in found_in(t or "", known)] for t in part.column(hidden).to_pylist()]
                rest = part.drop_columns([hidden])
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, kind)], names=[*rest.schema.names, "found"])

    kept = docs.drop("found")
    hidden = unused(kept, "_text_")
    item = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("name", T.StringType())])
    schema = T.StructType([*kept.schema.fields, T.StructField("found", T.ArrayType(item))])
    return kept.withColumn(hidden, F.col("text").cast("string")).mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, license, score, licenses, n_passages``: the best template, and all that were found."""
    found = scan(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", F.get("found", F.lit(0))["name"].alias("license"), F.coalesce(F.get("found", F.lit(0))["score"], F.lit(0.0)).alias("score"),
        F.array_join(F.array_sort(F.array_distinct("found.name")), ",").alias("licenses"), F.size("found").cast("bigint").alias("n_passages"),
    )


def sql() -> str:
    """Lines and whole texts for DuckDB over the table ``documents``; it has no windows."""
    rows = ",\n".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in TEMPLATES)
    words = "list_filter(string_split(replace(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), 'licence', 'license'), ' '), lambda x: x <> '')"
    pairs = "list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)"
    return f"""
WITH templates(name, text) AS (VALUES {rows}),
known AS (SELECT name, {pairs} AS t FROM (SELECT name, {words.format("text")} AS w FROM templates)),
lines AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
passages AS (
  SELECT r, unnest(CASE WHEN contains(text, chr(10)) THEN list_concat([text], string_split(text, chr(10))) ELSE [text] END) AS p FROM lines
),
own AS (
  SELECT r, n, {pairs} AS b FROM (
    SELECT r, n, {words.format("p")} AS w FROM (SELECT r, p, row_number() OVER () AS n FROM passages)
  ) WHERE len(w) > 0
),
scored AS (
  SELECT r, n, name, 2.0::DOUBLE * len(list_intersect(b, t)) / (len(b) + len(t)) AS score
  FROM own JOIN known ON 2 * least(len(b), len(t)) >= {LEAST}::DOUBLE * (len(b) + len(t))
),
best AS (
  SELECT r, n, name, score FROM scored WHERE score >= {LEAST}::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY r, n ORDER BY score DESC, name) = 1
),
per AS (
  SELECT r, first(name ORDER BY score DESC, name) AS license, max(score) AS score,
         array_to_string(list_sort(list_distinct(list(name))), ',') AS licenses, count(*) AS n_passages
  FROM best GROUP BY r
)
SELECT doc_id, license, coalesce(score, 0.0::DOUBLE) AS score, coalesce(licenses, '') AS licenses, coalesce(n_passages, 0) AS n_passages
FROM lines LEFT JOIN per USING (r)
""".strip()
