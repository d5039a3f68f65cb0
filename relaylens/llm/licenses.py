"""Operator 10: license scans by the Dice coefficient over word bigrams (DataFrame functions only).

Units of a text are its lines, its paragraphs (parted by empty lines), its sentences (each ends at . ! or ? before white
space and an upper-case letter, so a notice inside a long line is one) and the whole text.  A unit is
lower-cased, everything but letters and digits becomes one space, and its set of word bigrams is held
against those of the templates: dice = 2 * shared / (bigrams of the unit + bigrams of the template).

Two exact prunings come first.  Size bounds: dice >= t needs a unit's set to have between t / (2 - t)
and (2 - t) / t times as many bigrams as the template's.  Anchors: it also needs at least
``ceil(t / (2 - t) * n)`` of the template's n bigrams, so any ``n - that + 1`` of them hold one; the
longest are taken, as they are the rarest.  Candidates then get their exact coefficient.

Result: a row per document id and template found, with the highest coefficient and the number of
distinct units that match; sentences count where no other unit matches.  Cases: null and empty texts and units under two words hold no bigram and
match nothing; whole texts are scanned however long; repeated rows of a document count once; of several
templates that match a unit the nearest is reported, all of them if they tie; empty tables give no rows; other columns don't matter.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let

THRESHOLD = 0.8

# Licence notices as they stand in files, by licence.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT license.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


SENTENCE = r"(?<=[.!?])[\x20\x09-\x0D]+(?=\p{Lu})"

_MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Whole licence texts, without title and copyright line.
TEMPLATES |= {
    "MIT-text": f"{TEMPLATES['MIT-grant']}\n\n{_MIT_END}",
    "ISC-text": f"{TEMPLATES['ISC-grant']}\n\n{_ISC_END}",
    "BSD-2-Clause-text": f"{TEMPLATES['BSD-grant']}\n\n{_BSD_TERMS}\n\n{_BSD_END}",
    "BSD-3-Clause-text": f"{TEMPLATES['BSD-grant']}\n\n{_BSD_TERMS}\n\n{_BSD_NAMES}\n\n{_BSD_END}",
}


def bigrams_of(text: str) -> list[str]:
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def anchors_of(bigrams: list[str], threshold: float) -> list[str]:
    least = math.ceil(threshold / (2 - threshold) * len(bigrams) - 1e-9)
    return sorted(bigrams, key=lambda b: (-len(b), b))[: len(bigrams) - least + 1]


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _grams(w: Column, low: int, high: int) -> Column:
    """The bigrams of a unit's words; null if there are too few words, or too many different ones, for any template."""
    pairs = F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return F.when((F.size(w) > low) & (F.size(F.array_distinct(w)) <= high + 1), F.array_distinct(pairs))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    sets = {k: bigrams_of(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    sets = {k: v for k, v in sets.items() if v}
    rows = [(a, k, v) for k, v in sets.items() for a in anchors_of(v, threshold)]
    anchors = spark.createDataFrame(rows, "anchor string, license string, template array<string>")
    sizes = [len(v) for v in sets.values()] or [1]
    low, high = math.ceil(min(sizes) * threshold / (2 - threshold) - 1e-9), math.floor(max(sizes) * (2 - threshold) / threshold + 1e-9)
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.concat(F.split(text, "\n"), F.split(text, r"\n[\x20\x09-\x0D]*\n"), F.array(text))
    sentences = F.array_except(F.transform(F.split(text, SENTENCE), _normal), F.transform(parts, _normal))

    def sized(us: Column, sentence: bool) -> Column:
        return F.transform(us, lambda u: F.struct(u.alias("unit"), F.lit(sentence).alias("sentence"),
                                                  let(F.split(u, " "), lambda w: _grams(w, low, high)).alias("grams")))

    every = F.concat(sized(F.array_distinct(F.transform(parts, _normal)), False), sized(sentences, True))
    units = docs.select("doc_id", F.explode(every).alias("u")).select("doc_id", "u.*")
    units = units.where(F.size("grams").between(low, high))
    near = units.withColumn("anchor", F.explode("grams")).join(F.broadcast(anchors), "anchor")
    n, m = F.size("grams"), F.size("template")
    near = near.where((n >= m * threshold / (2 - threshold) - 1e-9) & (n <= m * (2 - threshold) / threshold + 1e-9))
    near = near.withColumn("dice", 2.0 * F.size(F.array_intersect("grams", "template")) / (n + m))
    hits = near.where(F.col("dice") >= threshold)
    # the rows of a unit that hit through several anchors, or of a text's copies, fold before the shuffle
    hits = hits.groupBy("doc_id", "unit", "license").agg(F.max("dice").alias("dice"), F.min("sentence").alias("sentence"))
    best = F.max("dice").over(Window.partitionBy("doc_id", "unit"))
    hits = hits.withColumn("best", best).where("dice = best")
    other = ~F.col("sentence")
    return hits.groupBy("doc_id", "license").agg(
        F.coalesce(F.max(F.when(other, F.col("dice"))), F.max("dice")).alias("dice"),
        F.when(F.count_if(other) > 0, F.count_if(other)).otherwise(F.count(F.lit(1))).alias("n_units"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same by brute force: every unit against every template of a fitting size."""
    t = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{g}'" for g in bigrams_of(v))) for k, v in TEMPLATES.items())
    return f"""
WITH templates(license, grams) AS (VALUES {t}),
parts AS (SELECT doc_id, false AS sentence, unnest(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[\\x20\\x09-\\x0D]*\\n')), [text])) AS u
    FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, true, unnest(string_split(regexp_replace(text, '([.!?])[\\x20\\x09-\\x0D]+(\\p{{Lu}})', '\\1' || chr(1) || chr(2) || '\\2', 'g'), chr(1) || chr(2)))
    FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, trim(regexp_replace(lower(u), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS unit, bool_and(sentence) AS sentence FROM parts GROUP BY 1, 2),
sized AS (SELECT doc_id, unit, sentence, string_split(unit, ' ') AS w FROM units WHERE length(unit) > 2),
grams AS (SELECT doc_id, unit, sentence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
    FROM sized WHERE len(w) >= 2),
dice AS (SELECT doc_id, unit, sentence, license, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
    FROM grams g JOIN templates t ON len(g.grams) BETWEEN len(t.grams) * {threshold} / (2 - {threshold}) - 1e-9 AND len(t.grams) * (2 - {threshold}) / {threshold} + 1e-9)
SELECT doc_id, license, COALESCE(max(dice) FILTER (NOT sentence), max(dice)) AS dice,
       CASE WHEN count(*) FILTER (NOT sentence) > 0 THEN count(*) FILTER (NOT sentence) ELSE count(*) END AS n_units
FROM (SELECT *, max(dice) OVER (PARTITION BY doc_id, unit) AS best FROM dice) WHERE dice >= {threshold} AND dice = best GROUP BY doc_id, license"""
