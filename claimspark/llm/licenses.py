"""Licences by Dice coefficient over word bigrams, in SQL functions only.

A text is lower-cased (A-Z); what is not a-z or 0-9 separates words. Its units
are its sentences and lines, its paragraphs (between blank lines, also those of
comments), its sentences that run over line ends, and the whole text. Each unit
is compared with notices and with whole licences by
Dice = 2 * shared / (bigrams of both), on sets of bigrams. A Dice of t or more
needs n * t / (2 - t) to n * (2 - t) / t bigrams beside a template of n:
templates outside these bounds are pruned before any bigrams are compared. As
many of the template's own bigrams are shared at least, so that of any
n - n * t / (2 - t) + 1 of them one is there: words that cover as many bigrams of
each template tell which texts can't hold any, before they are cut up. All of it
happens within the row: nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ends of sentences and lines.
END = r"[.!?]+[\x20\x09-\x0D]+|[\x0A-\x0D]+"
#: Ends of sentences that run over lines.
STOP = r"[.!?]+[ \n]+"

#: Public licence notices, (licence, notice).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.")
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. ")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. ")
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
    "License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
    "<https://www.gnu.org/licenses/>.")
#: Public licences as a whole, and full file headers, (licence, text).
WHOLE = (
    ("Apache-2.0", " ".join((NOTICES[1][1], "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", NOTICES[2][1],
                             "See the License for the specific language governing permissions and limitations under the License."))),
    ("BSD-2-Clause", _BSD_TWO + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _BSD_WARRANTY),
    ("GPL-2.0", _GNU.format(2)),
    ("GPL-3.0", _GNU.format(3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY),
    ("MIT", next(text for name, text in NOTICES if name == "MIT" and text.startswith("Permission"))
            + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
)
TEMPLATES = NOTICES + WHOLE


def template_bigrams(notice: str) -> list[str]:
    words = re.findall("[a-z0-9]+", notice.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a unit whose Dice with a template of ``n`` can reach ``threshold``."""
    return ceil(n * threshold / (2 - threshold) - 1e-9), floor(n * (2 - threshold) / threshold + 1e-9)


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda k: F.concat_ws(" ", F.get(words, k), F.get(words, k + 1)))
    return F.array_distinct(pairs)


def anchors(notices, threshold: float) -> list[str]:
    """Words of which every text with a unit that reaches ``threshold`` has at least one.

    Each template has enough bigrams with one of them that a unit without any
    shares too few. Chosen greedily, by how many bigrams that still count a
    word covers.
    """
    grams = [set(template_bigrams(text)) for _, text in notices]
    grams = [g for g in grams if g]
    # a unit lacks at most this many bigrams of the template; one more must be covered
    need = [len(g) - max(bounds(len(g), threshold)[0], 1) + 1 for g in grams]
    chosen: list[str] = []
    while any(n > 0 for n in need):
        gain: dict[str, int] = {}
        for g, n in zip(grams, need):
            for w in {w for b in g for w in b.split()} if n > 0 else ():
                gain[w] = gain.get(w, 0) + min(n, sum(w in b.split() for b in g))
        # short words tell little, numbers still less; of words alike the one in fewer templates
        word = max(sorted(gain), key=lambda w: (gain[w] * max(len(w) - 4, 0.0 if w.isdigit() else 0.01), -sum(w in b.split() for g in grams for b in g)))
        chosen.append(word)
        for k, g in enumerate(grams):
            gone = {b for b in g if word in b.split()}
            need[k] -= len(gone)
            grams[k] = g - gone
    return sorted(chosen)


def scan(docs: DataFrame, notices=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, license, dice, licenses, n_notices``.

    ``license``: of the unit and template with the highest Dice of at least
    ``threshold`` (ties: the first by name), else null, with ``dice`` 0.
    ``licenses``: all that reach it, sorted, comma-joined. ``n_notices``: units
    that reach it (the whole text counts where it has several units, a
    paragraph where there are several and it is more than a sentence or line, a
    sentence over lines where its paragraph has several). Null text is empty;
    repeated rows each give a row, no rows give none. Only ``doc_id`` and
    ``text`` are read.
    """
    templates = [(name, template_bigrams(text)) for name, text in notices]
    known = sorted({b for _, grams in templates for b in grams})
    limits = [bounds(len(grams), threshold) for _, grams in templates]
    least, most = min(low for low, _ in limits), max(high for _, high in limits)

    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, UPPER.lower())
    rows = docs.select(F.col("doc_id").cast("long"), lower.alias("text"))
    words = anchors(notices, threshold)
    short = "|".join(w for w in words if len(w) < 5)
    held = reduce(or_, (F.contains("text", F.lit(w)) for w in words if len(w) >= 5), F.lit(False))
    if short:
        held = held | F.rlike("text", F.lit(f"(?<![a-z0-9])(?:{short})(?![a-z0-9])"))
    rows = rows.select("doc_id", F.when(held, F.col("text")).otherwise(F.lit("")).alias("text"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", F.lit(END), F.lit("\n")), F.lit("[^a-z0-9\n]+"), F.lit(" ")))
    # line ends as they are, and the marks that end sentences
    lines = F.translate(F.regexp_replace("text", F.lit("\r\n"), F.lit("\n")), "\r\x0b\x0c", "\n\n\n")
    lines = F.regexp_replace(F.regexp_replace(lines, F.lit("[^a-z0-9.!?\n]+"), F.lit(" ")), F.lit(" ?\n ?"), F.lit("\n"))
    paragraphs = F.filter(F.transform(F.split(lines, "\n{2,}"), lambda p: F.trim(p, F.lit(" \n"))), lambda p: p != "")
    rows = rows.select("doc_id", clean.alias("clean"), paragraphs.alias("paragraphs"))
    parts = F.filter(F.split("clean", " ?\n ?"), lambda u: u != "")
    whole = F.trim(F.regexp_replace("clean", F.lit("[ \n]+"), F.lit(" ")))
    more = F.filter("paragraphs", lambda p: F.rlike(p, F.lit(f"{STOP}|\n")))
    over = F.filter(F.flatten(F.transform("paragraphs", lambda p: F.when(F.rlike(p, F.lit(STOP)), F.split(p, STOP)).otherwise(
        F.array().cast("array<string>")))), lambda u: F.contains(u, F.lit("\n")))
    runs = F.concat(F.when(F.size("paragraphs") > 1, more).otherwise(F.array().cast("array<string>")), over)
    runs = F.filter(F.transform(runs, lambda u: F.trim(F.regexp_replace(u, F.lit("[.!? \n]+"), F.lit(" ")))), lambda u: u != "")
    rows = rows.select("doc_id", parts.alias("units"), whole.alias("whole"), runs.alias("runs"))
    units = F.concat(F.when(F.size("units") > 1, F.concat("units", F.array("whole"))).otherwise(F.col("units")), "runs")

    # as many pairs of words as the smallest template asks for, at least one; repeats make the set smaller still
    words = F.filter(F.transform(units, lambda u: F.split(u, " ")), lambda w: F.size(w) > max(least, 1))
    rows = rows.select("doc_id", words.alias("words"))
    grams = F.filter(F.transform("words", _bigrams), lambda g: (F.size(g) <= most) & F.arrays_overlap(g, F.lit(known)))
    rows = rows.select("doc_id", grams.alias("grams"))

    def dice(g: Column) -> Column:
        scores = []
        for (name, own), (low, high) in zip(templates, limits):
            value = 2 * F.size(F.array_intersect(g, F.lit(own))) / (F.size(g) + len(own))
            scores.append(F.when(F.size(g).between(low, high), F.struct(F.round(value, 6).alias("dice"), F.lit(name).alias("license"))))
        return F.filter(F.array(*scores), lambda s: s["dice"] >= threshold)

    hits = F.filter(F.transform("grams", dice), lambda h: F.size(h) > 0)
    rows = rows.select("doc_id", F.when(F.size("grams") > 0, hits).otherwise(F.array().cast("array<array<struct<dice:double,license:string>>>")).alias("hits"))
    flat = F.flatten("hits")
    best = F.array_min(F.transform(flat, lambda s: F.struct((-s["dice"]).alias("dice"), s["license"].alias("license"))))
    return rows.select(
        "doc_id", best["license"].alias("license"), F.coalesce(-best["dice"], F.lit(0.0)).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(flat, lambda s: s["license"]))), ",").alias("licenses"),
        F.size("hits").cast("long").alias("n_notices"))
