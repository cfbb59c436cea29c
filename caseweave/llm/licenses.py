"""Licence scans by the Dice coefficient over word bigrams, in DataFrame functions only.

A text is normalised to lower-case words, so wrapped and reformatted notices read
alike, and stretches of it are compared with licence templates by

    dice = 2 |A & B| / (|A| + |B|)     over sets of word bigrams.

A template T can reach the least similarity t only if its size lies between
t / (2 - t) and (2 - t) / t times the stretch's, so others are not compared. A match
also holds at least t / (2 - t) of T's bigrams, hence one of any |T| - ceil(|T| t / (2 - t))
+ 1 of them; the longest ones serve as T's anchors. Where an anchor stands at word p
of the text and at word q of the template, the window of the template's number of
words from p - q on is compared. The whole text is compared too, where it holds any
anchor. Few texts hold one, so nearly all cost is the split into words.

All of it is one scan without a shuffle: templates and anchors are literals, which
suits some dozens of templates of up to a few hundred words.

Defined results: a null or empty text has no words and matches nothing; windows
that reach beyond an end of the text are shortened; of equal places and licences
the highest similarity counts, and equal similarity of the whole text goes to the
smaller licence name; null ids pass through; repeated rows are reported each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import table

LEAST = 0.8
WORD = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"

_PROVIDED = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_BSD_NAME = ' 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Public notices, licence paragraphs and short licences in full; several forms of one licence share its name.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software." + _PROVIDED),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAME + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
)


def words_of(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, sorted."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchors_of(text: str, least: float = LEAST) -> list[tuple[str, int]]:
    """(bigram, word number) of the longest bigrams of a template, enough that every match holds one of them."""
    grams, words = bigrams_of(text), words_of(text)
    must = math.ceil(least / (2 - least) * len(grams) - 1e-9)
    chosen = set(sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - must + 1])
    return [(g, q) for q, g in enumerate(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)) if g in chosen]


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _bigrams(text: Column) -> Column:
    """All word bigrams, in order of the text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    pair = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    return _let(words, lambda w: F.filter(F.when(F.size(w) > 1, pair(w)).otherwise(F.array().cast("array<string>")), lambda g: g.contains(" ")))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, matches array<struct<start, words, license, dice>>, whole struct<license, dice>): word numbers from 0."""
    struct = F.struct
    known = F.array(*(struct(F.lit(name).alias("license"), F.lit(len(words_of(body))).alias("words"), F.array(*map(F.lit, bigrams_of(body))).alias("grams")) for name, body in templates))
    places: dict[str, list[tuple[int, int]]] = {}
    for t, (_, body) in enumerate(templates):
        for gram, q in anchors_of(body, least):
            places.setdefault(gram, []).append((t, q))
    where = F.create_map(*(x for g, at in places.items() for x in (F.lit(g), F.array(*(struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in at)))))
    ratio = least / (2 - least)

    def dice(own: Column, t: Column) -> Column:
        """Minus the similarity where the sizes allow one of `least`, else null."""
        n, m = F.size(own), F.size(t["grams"])
        return F.when((m >= ratio * n) & (m * ratio <= n), -2.0 * F.size(F.array_intersect(own, t["grams"])) / (n + m))

    def windows(grams: Column, at: Column) -> Column:
        near = F.flatten(F.transform(at, lambda i: F.transform(F.element_at(where, F.element_at(grams, i + 1)), lambda y: struct(y["t"].alias("t"), F.greatest(i - y["q"], F.lit(0)).alias("start")))))

        def compare(c: Column) -> Column:
            t = F.element_at(known, c["t"] + 1)
            far = dice(F.array_distinct(F.slice(grams, c["start"] + 1, t["words"] - 1)), t)
            return struct(c["start"].alias("start"), t["license"].alias("license"), far.alias("far"), t["words"].alias("words"))

        good = F.array_sort(F.filter(F.transform(F.array_distinct(near), compare), lambda x: x["far"] <= -least + 1e-12))
        # In order of start, licence and similarity, the first of each start and licence stays.
        return F.filter(F.transform(good, lambda x, k: struct(x.alias("x"), F.when(k > 0, F.element_at(good, F.greatest(k, F.lit(1)))).alias("prev"))),
                        lambda y: y["prev"].isNull() | (y["prev"]["start"] != y["x"]["start"]) | (y["prev"]["license"] != y["x"]["license"]))

    def best(grams: Column) -> Column:
        own = F.array_distinct(grams)
        scored = _let(own, lambda o: F.transform(known, lambda t: struct(dice(o, t).alias("far"), t["license"].alias("license"))))
        return F.array_min(F.filter(scored, lambda x: x["far"] <= -least + 1e-12))

    def look(grams: Column) -> Column:
        found = F.filter(F.transform(grams, lambda g, i: F.when(g.isin(list(places)), i)), lambda i: i.isNotNull())
        return _let(found, lambda at: F.when(F.size(at) > 0, struct(windows(grams, at).alias("matches"), best(grams).alias("whole"))))

    rows = docs.select("doc_id", _let(_bigrams(F.coalesce(F.col("text"), F.lit(""))), look).alias("found"))
    named = lambda x: struct(x["start"].alias("start"), x["words"].alias("words"), x["license"].alias("license"), (-x["far"]).alias("dice"))
    matches = F.transform("found.matches", lambda y: named(y["x"]))
    none = F.array().cast("array<struct<start:int,words:int,license:string,dice:double>>")
    whole = F.when(F.col("found.whole").isNotNull(), struct(F.col("found.whole.license").alias("license"), (-F.col("found.whole.far")).alias("dice")))
    return rows.select("doc_id", F.coalesce(matches, none).alias("matches"), whole.alias("whole"))


def digest(found: DataFrame) -> DataFrame:
    """Per document: places that match, their licences, the best similarity of a place or the whole text."""
    best = F.array_max(F.transform("matches", lambda x: x["dice"]))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_license_places"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.col("whole.license").alias("whole_license"),
        F.round(F.coalesce(F.greatest(best, F.col("whole.dice")), F.lit(0.0)), 6).alias("best_dice"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values() -> str:
    rows = (f"({t}, {_quoted(name)}, {len(words_of(body))}, [{', '.join(map(_quoted, bigrams_of(body)))}])" for t, (name, body) in enumerate(TEMPLATES))
    return ",\n  ".join(rows)


def _anchor_values() -> str:
    return ", ".join(f"({t}, {_quoted(g)}, {q})" for t, (_, body) in enumerate(TEMPLATES) for g, q in anchors_of(body))


ORACLE = rf"""
WITH t(t, license, words, grams) AS (VALUES
  {_values()}),
a(t, gram, q) AS (VALUES {_anchor_values()}),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+(?:\.\p{{N}}+)*') AS words FROM documents),
g AS (SELECT r, doc_id, [words[i] || ' ' || words[i + 1] for i in range(1, len(words))] AS grams FROM w),
p AS (SELECT r, unnest(range(0, len(grams))) AS i, unnest(grams) AS gram FROM g),
h AS (SELECT DISTINCT r, a.t, greatest(i - q, 0) AS start FROM p JOIN a ON p.gram = a.gram),
own AS (
  SELECT h.r, start, license, t.grams AS grams, list_distinct(g.grams[start + 1 : start + words - 1]) AS mine
  FROM h JOIN t ON h.t = t.t JOIN g ON g.r = h.r),
s AS (
  SELECT r, start, license, 2.0::DOUBLE * len(list_intersect(mine, grams)) / (len(mine) + len(grams)) AS dice
  FROM own WHERE len(mine) <= 1.5 * len(grams) AND len(grams) <= 1.5 * len(mine)),
m AS (SELECT r, start, license, max(dice) AS dice FROM s WHERE dice >= {LEAST} - 1e-12 GROUP BY ALL),
e AS (
  SELECT x.r, license, 2.0::DOUBLE * len(list_intersect(x.mine, t.grams)) / (len(x.mine) + len(t.grams)) AS dice
  FROM (SELECT r, list_distinct(grams) AS mine FROM g WHERE r IN (SELECT r FROM h)) x
  JOIN t ON len(x.mine) <= 1.5 * len(t.grams) AND len(t.grams) <= 1.5 * len(x.mine)),
f AS (SELECT * FROM e WHERE dice >= {LEAST} - 1e-12 QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, license) = 1),
n AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best FROM m GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_license_places, coalesce(licenses, '') AS licenses,
       f.license AS whole_license, round(coalesce(greatest(best, f.dice), 0.0::DOUBLE), 6) AS best_dice
FROM g LEFT JOIN n ON g.r = n.r LEFT JOIN f ON g.r = f.r
"""
