"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

Two kinds of templates: notices of one sentence, compared with each sentence of a text, and whole
notices (a licence text or a file header of some sentences), compared with windows of a text, so that they
are found anywhere in it. Both sides are normalised alike: lower case, "licence" as "license", runs of
other characters than letters and digits as one space; their sets of word bigrams are compared.

A window is as long as its template and lies where an anchor word of the text meets the same word of the
template; at the text's ends it is cut. Of overlapping windows those of the highest coefficient count, of
equal ones of one licence the first.

Size bounds prune: a coefficient of t needs sizes within a factor of (2 - t) / t of each other, so a
template is joined only on the set sizes within its bounds. Before that, a text and a sentence must
hold an anchor word. Anchors are chosen so that this loses nothing: sets of coefficient t share at least
t / (2 - t) of the template's bigrams, and fewer than that of any template are free of anchors. A whole
notice is looked for only in texts that hold enough of its words anywhere: each word that is missing
takes a bigram with it (the last may not), so more than what may be missing and one cannot be.

The templates are a fixed list of bounded size, so they are broadcast. The scan is narrow; hits are
then grouped by document and licence, with partial sums.

Null and empty texts have no licence; very long ones are read whole, in one task each. Rows with the same
doc_id are one document; null ids are one too; repeated rows count each. Ties between best licences of a
sentence or window are all reported. An empty table gives no rows; other columns are not read. Built-in
functions only.
"""

from __future__ import annotations

import math
import re
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Names by SPDX identifier.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2",),
    "GPL-3.0": ("GNU General Public License, version 3",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "EPL-2.0": ("Eclipse Public License, version 2.0",),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
}
#: How notices name a licence.
PHRASES = ("Licensed under {}", "Released under {}", "This work is licensed under {}", "This software is released under {}", "Distributed under the terms of {}", "This program is licensed under the terms of {}", "Available under {}")
#: Whole notices.
WHOLE = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {BSD}",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD}",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.",
}
#: The disclaimer of both BSD notices.
BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: The file header of the GNU licences, and what is in its places.
GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
GNU_NAMES = {
    "GPL-2.0": ("program", "General Public License", "2"),
    "GPL-3.0": ("program", "General Public License", "3"),
    "LGPL-2.1": ("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": ("library", "Lesser General Public License", "3"),
    "AGPL-3.0": ("program", "Affero General Public License", "3"),
}
#: The notice of the Creative Commons licences, and their names.
CC = "This work is licensed under the Creative Commons {0} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{1}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
CC_NAMES = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
#: Words too frequent in any text to be anchors while others are left.
COMMON = frozenset("the this that these of a an is are be for under with without and or to in on by you may use any all not work software program new public general copy notice copies version use conditions".split())
_SENTENCE = "[.!?]*[ \t\r]*\n\\s*|[.!?]+\\s+"


def bigrams(text: str) -> frozenset[str]:
    words = words_of_notice(text)
    return frozenset(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def words_of_notice(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).replace("licence", "license").split()


@cache
def notices() -> dict[str, str]:
    """The whole notice of every licence in NAMES."""
    out = {spdx: text.replace("{BSD}", BSD) for spdx, text in WHOLE.items()}
    out |= {spdx: GNU.format(*parts) for spdx, parts in GNU_NAMES.items()}
    for spdx in NAMES:
        if spdx.startswith("CC-"):
            code = spdx.removeprefix("CC-").removesuffix("-4.0")
            out[spdx] = CC.format("-".join(CC_NAMES[x] for x in code.split("-")), code.lower())
    return out


@cache
def templates() -> tuple[tuple[str, str, frozenset[str]], ...]:
    """(licence, kind, bigrams); equal sets once."""
    out = {}
    for spdx, names in NAMES.items():
        for name in names:
            for phrase in PHRASES:
                for article in ("the ", "a ", "") if name[:2] != "CC" else ("", "a ", "the "):
                    out.setdefault((spdx, "notice", bigrams(phrase.format(article + name))), None)
    for spdx, text in notices().items():
        out.setdefault((spdx, "whole", bigrams(text)), None)
    return tuple(out)


@cache
def vocabularies(threshold: float = THRESHOLD) -> tuple[tuple[str, tuple[str, ...], int], ...]:
    """(licence, the distinct words of its whole notice, how many of them any text with a window that
    reaches the threshold holds)."""
    out = []
    for spdx, text in notices().items():
        words, size = tuple(dict.fromkeys(words_of_notice(text))), len(bigrams(text))
        out.append((spdx, words, len(words) - 1 - (size - math.ceil(size * threshold / (2 - threshold) - 1e-9))))
    return tuple(out)


@cache
def marks() -> tuple[tuple[str, str, int, int], ...]:
    """(anchor word, licence, its place in the whole notice, the notice's words)."""
    chosen = set(anchors("whole"))
    return tuple((w, spdx, k, len(words)) for spdx, text in notices().items() for words in [words_of_notice(text)] for k, w in enumerate(words) if w in chosen)


def bounds(size: int, threshold: float = THRESHOLD) -> range:
    """Sizes of sets that can reach the threshold with a template of this size."""
    return range(math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9) + 1)


@cache
def anchors(kind: str, threshold: float = THRESHOLD) -> tuple[str, ...]:
    """Words of which any text that reaches the threshold holds at least one; chosen greedily."""
    sets = [(grams, math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)) for _, k, grams in templates() if k == kind]

    def missed(chosen: list[str]) -> list[list[str]]:
        """The anchorless bigrams of each template that enough of them could reach."""
        frees = [([g for g in grams if not set(g.split()) & set(chosen)], need) for grams, need in sets]
        return [free for free, need in frees if len(free) >= need]

    chosen: list[str] = []
    while short := missed(chosen):
        words: dict[str, float] = {}
        for free in short:
            for w in {w for g in free for w in g.split() if len(w) > 1}:
                words[w] = words.get(w, 0) + (0.01 if w in COMMON else 1.0 if len(w) >= 5 else 0.3)
        chosen.append(max(words, key=lambda w: (words[w], w)))
    for w in sorted(chosen, key=lambda w: (w not in COMMON, len(w), w)):
        if not missed([x for x in chosen if x != w]):
            chosen.remove(w)
    return tuple(chosen)


def _grams(text: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), "licence", "license"), " "), lambda w: w != "")
    return words


def _pattern(kind: str) -> str:
    words = sorted({v for w in anchors(kind) for v in (w, w.replace("license", "licence"))})
    return "(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, words)) + ")(?![a-z0-9])"


def _pairs(words: str) -> Column:
    """The distinct bigrams of a column of words."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.array_distinct(F.when(F.size(words) > 1, each))


def _dice() -> Column:
    return 2.0 * F.size(F.array_intersect("ours", "theirs")) / (F.col("size") + F.col("their_size"))


def _sentence_hits(df: DataFrame, known: DataFrame, doc_id: str, threshold: float) -> DataFrame:
    """(doc_id, n, dice, license) of each distinct sentence of a document and the licences that fit it best."""
    sentences = F.filter(F.split("__text", _SENTENCE), lambda s: s.rlike(_pattern("notice")))
    holds = reduce(or_, [F.col("__low").contains(w.replace("license", "licen")) for w in anchors("notice")])
    rows = df.select(F.col(doc_id), F.explode(F.when(holds, sentences)).alias("unit")).select(doc_id, F.array_join(_grams(F.col("unit")), " ").alias("norm"))
    rows = rows.groupBy(doc_id, "norm").agg(F.count(F.lit(1)).alias("n")).withColumn("words", F.split("norm", " "))
    # a size that cannot be null: no filter for the join is then pushed into the expressions above
    rows = rows.withColumn("ours", _pairs("words")).withColumn("size", F.coalesce(F.size("ours"), F.lit(0)))
    fits = rows.join(F.broadcast(known.where("kind = 'notice'")), "size").select(doc_id, "norm", "n", "license", _dice().alias("dice")).where(F.col("dice") >= threshold)
    # at most one entry for each template: the best licences of a sentence
    best = fits.groupBy(doc_id, "norm", "n").agg(F.collect_set(F.struct("dice", "license")).alias("fits"))
    return best.withColumn("top", F.array_max(F.col("fits")["dice"])).select(doc_id, "n", "top", F.explode("fits").alias("f")).where("f.dice = top").select(doc_id, "n", F.col("top").alias("dice"), "f.license")


def _window_hits(df: DataFrame, known: DataFrame, doc_id: str, threshold: float) -> DataFrame:
    """The same of the windows of documents that whole notices fit."""
    holds = reduce(or_, [F.col("__low").contains(w.replace("license", "licen")) for w in anchors("whole")])
    rows = df.where(holds).select(F.col(doc_id), F.xxhash64("__text").alias("__key"), _grams(F.col("__text")).alias("__words"))
    known_words = F.array(*map(F.lit, dict.fromkeys(w for _, words, _ in vocabularies(threshold) for w in words)))
    asked = F.array(*(F.struct(F.lit(spdx).alias("license"), F.array(*map(F.lit, words)).alias("words"), F.lit(n).alias("n")) for spdx, words, n in vocabularies(threshold)))
    rows = rows.withColumn("__own", F.array_intersect("__words", known_words))
    rows = rows.withColumn("__asked", F.filter(asked, lambda a: F.size(F.array_intersect("__own", a["words"])) >= a["n"])["license"]).where(F.size("__asked") > 0)
    chosen = F.array(*map(F.lit, anchors("whole")))
    at = F.filter(F.sequence(F.lit(0), F.size("__words") - 1), lambda i: F.array_contains(chosen, F.get("__words", i)))
    listed = F.array(*(F.struct(F.lit(w).alias("word"), F.lit(spdx).alias("license"), F.lit(k).alias("place"), F.lit(n).alias("length")) for w, spdx, k, n in marks()))
    starts = F.transform(at, lambda i: F.transform(F.filter(listed, lambda m: (m["word"] == F.get("__words", i)) & F.array_contains("__asked", m["license"])), lambda m: F.struct(m["license"].alias("license"), (i - m["place"]).alias("start"), m["length"].alias("length"))))
    rows = rows.withColumn("__starts", F.when(F.size("__words") > 1, F.array_distinct(F.flatten(starts))))
    # the words of a window are cut out before rows multiply
    cut = lambda w: F.slice("__words", F.greatest(w["start"], F.lit(0)) + 1, w["length"] + F.least(w["start"], F.lit(0)))
    spans = F.transform("__starts", lambda w: F.struct(w["license"].alias("license"), w["start"].alias("start"), w["length"].alias("length"), cut(w).alias("words")))
    found = rows.select(doc_id, "__key", F.explode(spans).alias("w")).select(doc_id, "__key", "w.*")
    found = found.withColumn("ours", _pairs("words")).withColumn("size", F.coalesce(F.size("ours"), F.lit(0)))
    fits = found.join(F.broadcast(known.where("kind = 'whole'")), ["license", "size"]).withColumn("dice", _dice()).where(F.col("dice") >= threshold)
    fits = fits.groupBy(doc_id, "__key", "license", "start", "length", "dice").agg(F.count(F.lit(1)).alias("n"))
    # all hits of one text: no more than its windows
    texts = fits.groupBy(doc_id, "__key").agg(F.collect_list(F.struct("license", "start", "length", "dice", "n")).alias("hits"))
    meets = lambda a, b: (a["start"] < b["start"] + b["length"]) & (b["start"] < a["start"] + a["length"])
    beats = lambda a, b: (a["dice"] > b["dice"]) | ((a["dice"] == b["dice"]) & (a["license"] == b["license"]) & (a["start"] < b["start"]))
    best = F.filter("hits", lambda h: ~F.exists("hits", lambda g: meets(g, h) & beats(g, h)))
    return texts.select(doc_id, F.explode(best).alias("h")).select(doc_id, "h.n", "h.dice", "h.license")


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, n_matches (sentences and windows that it fits best) and best_dice of
    each document and licence found in it."""
    spark = df.sparkSession
    listed = [(s, spdx, kind, sorted(grams), len(grams)) for spdx, kind, grams in templates() for s in bounds(len(grams), threshold)]
    known = spark.createDataFrame(listed, "size int, license string, kind string, theirs array<string>, their_size int")
    # a column of its own, so that it is lowered once
    df = df.select(F.col(doc_id), F.col(text).alias("__text")).withColumn("__low", F.lower("__text"))
    hits = _sentence_hits(df, known, doc_id, threshold).unionByName(_window_hits(df, known, doc_id, threshold))
    return hits.groupBy(doc_id, "license").agg(F.sum("n").alias("n_matches"), F.round(F.max("dice"), 9).alias("best_dice"))


def sql(table: str = "documents", threshold: float = THRESHOLD) -> str:
    """The same scan in SQL: every sentence and window against its templates, without size bounds; texts without
    enough words of a notice have no windows for it."""

    def words(x: str) -> str:
        return f"list_filter(string_split(replace(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), 'licence', 'license'), ' '), lambda w: w <> '')"

    def grams(ws: str) -> str:
        return f"(SELECT list_distinct(list_transform(range(1, len(gs)), lambda i: gs[i] || ' ' || gs[i + 1])) FROM (SELECT {ws} AS gs))"

    dice = "2.0 * len(list_intersect(ours, theirs)) / (len(ours) + len(theirs))"
    values = ",\n".join("('{}', '{}', [{}])".format(spdx, kind, ", ".join(f"'{g}'" for g in sorted(g))) for spdx, kind, g in templates())
    words_ = ", ".join(f"('{w}', '{spdx}', {n})" for spdx, ws, n in vocabularies(threshold) for w in ws)
    placed = ", ".join(f"('{w}', '{spdx}', {k}, {n})" for w, spdx, k, n in marks())
    return f"""
WITH k(license, kind, theirs) AS (VALUES {values}),
m(word, license, place, length) AS (VALUES {placed}),
v(word, license, least_words) AS (VALUES {words_}),
t AS (SELECT doc_id, text, row_number() OVER () AS row_no, {words('text')} AS ws FROM {table} WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]*[ \\t\\r]*\\n\\s*|[.!?]+\\s+')) AS unit FROM t),
g AS (SELECT doc_id, row_number() OVER () AS unit_no, {grams(words('unit'))} AS ours FROM s),
d AS (SELECT doc_id, unit_no, license, max({dice}) AS dice FROM g, k WHERE kind = 'notice' AND len(ours) > 0 GROUP BY ALL),
b AS (SELECT *, rank() OVER (PARTITION BY doc_id, unit_no ORDER BY dice DESC) AS place FROM d WHERE dice >= {threshold}),
p AS (SELECT row_no, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM t),
e AS (SELECT row_no, license FROM (SELECT DISTINCT row_no, word FROM p) JOIN v USING (word) GROUP BY row_no, license HAVING count(*) >= max(least_words)),
w AS (SELECT DISTINCT row_no, license, pos - place AS start, length FROM p JOIN m USING (word) SEMI JOIN e USING (row_no, license)),
h AS (SELECT doc_id, row_no, license, start, length, {grams("ws[greatest(start, 0) + 1 : start + length]")} AS ours FROM w JOIN t USING (row_no)),
f AS (SELECT doc_id, row_no, license, start, length, {dice} AS dice FROM h JOIN k USING (license) WHERE kind = 'whole' AND len(ours) > 0),
c AS (SELECT * FROM f WHERE dice >= {threshold}),
o AS (SELECT doc_id, license, dice FROM c AS x WHERE NOT EXISTS (SELECT 1 FROM c AS y WHERE y.row_no = x.row_no AND y.start < x.start + x.length AND x.start < y.start + y.length
 AND (y.dice > x.dice OR (y.dice = x.dice AND y.license = x.license AND y.start < x.start))))
SELECT doc_id, license, CAST(count(*) AS BIGINT) AS n_matches, round(max(dice), 9) AS best_dice
FROM (SELECT doc_id, license, dice FROM b WHERE place = 1 UNION ALL SELECT doc_id, license, dice FROM o) GROUP BY doc_id, license"""
