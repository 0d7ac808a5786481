"""License scans: windows of normalised text against licence templates, by Dice coefficient over word bigrams.

DataFrame expressions only. A text is one run of words, so a notice may wrap over lines or stand inside a paragraph. Every
template has a key word; wherever it stands in a text, the window of the template's length around it is compared. Size
bounds rule out windows, at the ends of a text mainly, that cannot reach the coefficient. A licence is named only if
the words that tell it from its relatives are in the window; a common stem is not enough.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import text_of

#: Least Dice coefficient of a window that carries a licence.
LEAST_DICE = 0.8


class Template(NamedTuple):
    """A notice, header or opening paragraph; the key word is the first of its kind in it; `needed` words must be there."""

    licence: str
    key: str
    needed: str
    text: str


_GPL_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as "
    "published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.")
# What licences say of themselves.
TEMPLATES = [
    Template("Apache-2.0", "apache", "apache 2", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "apache", "apache 2", "This work is licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "apache", "apache 2",
             "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
             "compliance with the License. You may obtain a copy of the License at"),
    Template("BSD-2-Clause", "bsd", "bsd 2", "Released under the BSD 2-Clause License."),
    Template("BSD-3-Clause", "bsd", "bsd 3", "Released under the BSD 3-Clause License."),
    Template("BSD-2-Clause", "redistribution", "binary disclaimer", _BSD),
    Template("BSD-3-Clause", "neither", "neither endorse",
             "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission."),
    Template("BSL-1.0", "boost", "boost", "Distributed under the Boost Software License, Version 1.0."),
    Template("CC-BY-4.0", "cc", "cc by 4", "Licensed under CC BY 4.0."),
    Template("CC-BY-NC-4.0", "cc", "cc by nc 4", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-SA-4.0", "cc", "cc by sa 4", "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-4.0", "creative", "attribution 4",
             "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-NC-4.0", "creative", "attribution noncommercial 4",
             "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Template("CC-BY-SA-4.0", "creative", "attribution sharealike 4",
             "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("CC0-1.0", "waived", "waived copyright",
             "To the extent possible under law, the author has waived all copyright to this work."),
    Template("ISC", "hereby", "permission fee distribute",
             "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("MIT", "license", "mit", "Released under the MIT License."),
    Template("MIT", "license", "mit", "This work is licensed under the MIT License."),
    Template("MIT", "hereby", "permission sublicense",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
             "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
             "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    Template("MPL-2.0", "mozilla", "mozilla 2",
             "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("MPL-2.0", "mozilla", "mozilla 2",
             "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    Template("Unlicense", "unencumbered", "unencumbered",
             "This is free and unencumbered software released into the public domain."),
]
for _id, _name, _needed, _versions in (
    ("GPL", "General Public License", "", "23"), ("LGPL", "Lesser General Public License", "lesser ", "3"),
    ("AGPL", "Affero General Public License", "affero ", "3"),
):
    for _n in _versions:
        TEMPLATES += [
            Template(f"{_id}-{_n}.0", "gnu", f"{_needed}general {_n}",
                     f"This work is licensed under the GNU {_name}, version {_n}."),
            Template(f"{_id}-{_n}.0", "gnu", f"{_needed}general {_n}", _GPL_HEADER.format(name=_name, n=_n)),
        ]
TEMPLATES += [Template(_i, "spdx", _i.lower().replace("-", " ").replace(".", " "), f"SPDX-License-Identifier: {_i}")
              for _i in sorted({t.licence for t in TEMPLATES})]


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, least: float = LEAST_DICE) -> tuple[int, int]:
    """Fewest and most bigrams of a window that can reach `least` with a template of n: its bigrams all shared, or all of
    the template's."""
    t = round(100 * least)
    return -(-n * t // (200 - t)), n * (200 - t) // t


def _bigrams(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(
        F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _best(hit: Column, templates: list[Template], least: float) -> Column:
    """The least (-dice, licence) of the windows around a key word that reach `least`; null without any."""
    tried = []
    for t in templates:
        own = words_of(t.text)
        at, needed, pairs = own.index(t.key), words_of(t.needed), bigrams_of(own)
        low, high = size_bounds(len(pairs), least)
        first = F.greatest(hit["i"] - at, F.lit(0))
        window = F.slice("w", first + 1, hit["i"] - at + len(own) - first)
        found = F.struct((-2.0 * F.size(F.array_intersect(_bigrams(window), _literals(pairs))) / (
            F.size(_bigrams(window)) + len(pairs))).alias("d"), F.lit(t.licence).alias("licence"))
        # all that is cheap comes first: the key, the room there is, the words that tell the licence
        room = F.least(F.size("w"), hit["i"] - at + len(own)) - first - 1
        tried.append(F.when((hit["x"] == t.key) & (room >= low) & (
            F.size(F.array_intersect(window, _literals(needed))) == len(set(needed))) & (
            F.size(_bigrams(window)).between(low, high)), found))
    return F.array_min(F.filter(F.array(*tried), lambda x: x["d"] <= -least))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """All columns of `docs` plus `licences`: (word, licence, dice) for each key word in a window that reaches `least`.

    Normalised text is in lower case, with everything but letters and digits as one space; words count from 1. A key word
    goes to its best template, of equal ones to the first identifier. Null and empty texts have no licences, nor have
    texts that are too short for every template. A column named licences is replaced. Repeated rows are scanned alike.
    """
    keys = sorted({t.key for t in templates})
    rows = docs.drop("licences").select(F.struct("*").alias("row"), F.trim(F.regexp_replace(
        F.lower(text_of()), r"[^\p{L}\p{N}]+", " ")).alias("t"))
    # every window holds its template's key word, so a text without any has none
    asked = F.col("t").rlike(rf"(?:^|\x20)(?:{'|'.join(keys)})(?:\x20|$)")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("w", F.when(asked, F.split("t", " ")).otherwise(none))
    rows = rows.withColumn("hits", F.when(F.size("w") > 0, F.filter(F.transform(
        "w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: h["x"].isin(keys))))
    best = F.transform("hits", lambda h: F.struct((h["i"] + 1).alias("word"), _best(h, templates, least).alias("b")))
    rows = rows.withColumn("best", F.when(F.size("hits") > 0, best))
    found = F.transform(F.filter("best", lambda x: x["b"].isNotNull()), lambda x: F.struct(
        x["word"].alias("word"), x["b"]["licence"].alias("licence"), (-x["b"]["d"]).alias("dice")))
    empty = F.array().cast("array<struct<word:int,licence:string,dice:double>>")
    return rows.select("row.*", F.coalesce(found, empty).alias("licences"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, number of notices, the licences in order, and the best coefficient (0 without any)."""
    found = scan(docs.select("doc_id", "text"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("licences").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["licence"]))), ",").alias(
            "licences"),
        F.round(F.coalesce(F.array_max(F.transform("licences", lambda x: x["dice"])), F.lit(0.0)), 6).alias("best_dice"))


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


_ROWS = ", ".join(
    f"('{t.licence}', '{t.key}', {_listed(sorted(set(words_of(t.needed))))}, {_listed(words_of(t.text))})" for t in TEMPLATES)
_HITS = _listed(sorted({t.key for t in TEMPLATES}))
#: The same result from the definition: every place of every template's key word, nothing ruled out before the Dice.
DIGEST_SQL = f"""
WITH given(licence, key, needed, own) AS (VALUES {_ROWS}),
template AS (SELECT licence, key, needed, own, list_position(own, key) AS place,
                    list_distinct(list_transform(range(1, len(own)), lambda i: own[i] || ' ' || own[i + 1])) AS b FROM given),
clean AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split(regexp_replace(
            lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
hit AS (SELECT k, w, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains({_HITS}, w[i]))) AS i FROM clean),
part AS (SELECT k, i, licence, needed, b, w[greatest(i - place + 1, 1):least(i - place + len(own), len(w))] AS p
         FROM hit JOIN template ON w[i] = key),
scored AS (SELECT k, i, licence, b, list_distinct(list_transform(range(1, len(p)), lambda j: p[j] || ' ' || p[j + 1])) AS a
           FROM part WHERE len(list_intersect(p, needed)) = len(needed)),
dice AS (SELECT k, i, licence, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS d FROM scored),
best AS (SELECT k, i, max(d) AS d, min(licence) FILTER (d = top) AS licence
         FROM (SELECT *, max(d) OVER (PARTITION BY k, i) AS top FROM dice) WHERE top >= {LEAST_DICE} GROUP BY k, i)
SELECT any_value(c.doc_id) AS doc_id, count(n.i) AS n_notices,
       coalesce(array_to_string(list_sort(list_distinct(list(n.licence) FILTER (n.licence IS NOT NULL))), ','), '')
         AS licences,
       round(coalesce(max(n.d), 0.0), 6) AS best_dice
FROM clean c LEFT JOIN best n ON n.k = c.k GROUP BY c.k
"""
