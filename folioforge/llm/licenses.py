"""Licence scan: word bigrams of whole texts, paragraphs and lines against templates.

Likeness is the Dice coefficient of the sets of bigrams of normalised words. Two tests
prune without losing a match: a match shares so many of a template's bigrams that it
holds one of the template's anchor words, and its number of bigrams is bounded by the
template's. All of it is column expressions on the row itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8
#: Licence notices and texts, fixed values.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
}


def words_of(text: str) -> list[str]:
    return re.sub("[^A-Za-z0-9]+", " ", text).lower().split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def anchors_of(bigrams: list[str], least: float) -> set[str]:
    """Words such that every set of Dice ``least`` or more holds one: they are in over a
    share 1 - least / (2 - least) of the bigrams. Long words come first, since they are rare."""
    left, out, covered = set(bigrams), set(), 0
    while covered <= (1 - least / (2 - least)) * len(bigrams) + 1e-9:
        words = sorted({w for b in left for w in b.split()})
        best = max(words, key=lambda w: (min(len(w), 7), sum(w in b.split() for b in left)))
        hit = {b for b in left if best in b.split()}
        covered, left = covered + len(hit), left - hit
        out.add(best)
    return out


def _units(text: Column) -> Column:
    """(rank, unit, number, body): the text, its paragraphs between empty lines, its lines."""
    unit = lambda rank, name, no, body: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("unit"), no.alias("number"), body.alias("body"))
    return F.concat(
        F.transform(F.split(text, "\n", -1), lambda x, i: unit(2, "line", i, x)),
        F.transform(F.split(text, r"\n[ \t]*\n", -1), lambda x, i: unit(1, "paragraph", i, x)),
        F.array(unit(0, "text", F.lit(0), text)),
    )


def _bigrams(body: Column) -> Column:
    bare = F.trim(F.lower(F.regexp_replace(body, "[^A-Za-z0-9]+", " ")))
    words = F.split(bare, " ")
    both = F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))))).otherwise(F.array().cast("array<string>")))
    return F.element_at(both, 1)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """(id, license, unit, number, bigrams, common, dice): each id's best unit for each licence.

    The best unit has the highest Dice coefficient; among equals a line goes before a
    paragraph and that before the text, then the first. Null and empty texts match
    nothing. Rows of one id count as one document. Dice is rounded to six places.
    """
    templates = {k: bigrams_of(t) for k, t in (TEMPLATES if templates is None else templates).items()}
    if any(not b for b in templates.values()):
        raise ValueError("a template needs two words")
    anchors = sorted({a for b in templates.values() for a in anchors_of(b, least)})
    holds = "(?i)" + "|".join(anchors)
    low, high = least / (2 - least), (2 - least) / least
    text = F.col(text_col)
    units = df.where(text.rlike(holds)).select(F.col(id_col).alias("doc_id"), F.explode(F.filter(_units(text), lambda u: u["body"].rlike(holds))).alias("u"))
    least_size, most_size = (f(len(b) for b in templates.values()) for f in (min, max))
    sized = units.select("doc_id", "u.rank", "u.unit", "u.number", _bigrams(F.col("u.body")).alias("own")).where(F.size("own").between(least_size * low - 1, most_size * high + 1))
    tests = []
    for name, own in templates.items():
        common = F.size(F.array_intersect(F.col("own"), F.array(*map(F.lit, own))))
        near = F.size("own").between(len(own) * low - 1e-9, len(own) * high + 1e-9)
        tests.append(F.when(near, F.struct(F.lit(name).alias("license"), common.alias("common"), F.lit(len(own)).alias("of"))))
    pairs = sized.select("doc_id", "rank", "unit", "number", F.size("own").alias("bigrams"), F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull())).alias("t"))
    dice = 2 * F.col("t.common") / (F.col("bigrams") + F.col("t.of"))
    hits = pairs.select("doc_id", F.col("t.license").alias("license"), F.struct(dice.alias("d"), "rank", (-F.col("number")).alias("no"), "unit", "bigrams", F.col("t.common").alias("common")).alias("best")).where(F.col("best.d") >= least)
    top = hits.groupBy("doc_id", "license").agg(F.max("best").alias("b"))
    return top.select("doc_id", "license", "b.unit", (-F.col("b.no")).cast("long").alias("number"), F.col("b.bigrams").cast("long").alias("bigrams"), F.col("b.common").cast("long").alias("common"), F.round("b.d", 6).alias("dice"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _oracle() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in TEMPLATES.items())
    bigrams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = "string_split(trim(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    unit = "SELECT doc_id, {rank} AS rank, '{name}' AS unit, unnest(range(len(parts))) AS number, unnest(parts) AS body FROM (SELECT doc_id, {split} AS parts FROM documents WHERE text IS NOT NULL)"
    units = " UNION ALL ".join(
        unit.format(rank=r, name=n, split=s) for r, n, s in ((2, "line", "string_split(text, chr(10))"), (1, "paragraph", r"regexp_split_to_array(text, '\n[ \t]*\n')"), (0, "text", "[text]"))
    )
    return f"""
    WITH templates AS (SELECT license, {bigrams} AS t FROM (SELECT license, {words.format("body")} AS w FROM (VALUES {values}) v(license, body))),
    units AS ({units}),
    sets AS (SELECT doc_id, rank, unit, number, {bigrams} AS own FROM (SELECT *, {words.format("body")} AS w FROM units)),
    scored AS (
        SELECT doc_id, license, rank, unit, number, len(own) AS bigrams, len(list_intersect(own, t)) AS common,
               2 * len(list_intersect(own, t)) / (len(own) + len(t)) AS d
        FROM sets, templates WHERE len(own) BETWEEN 1 AND 1000)
    SELECT doc_id, license, unit, number::BIGINT AS number, bigrams::BIGINT AS bigrams, common::BIGINT AS common, round(d, 6) AS dice
    FROM scored WHERE d >= {LEAST_DICE}
    QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY d DESC, rank DESC, number) = 1"""


LICENSE_SQL = _oracle()
