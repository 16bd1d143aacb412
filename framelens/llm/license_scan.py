"""Licence scans: texts against licence templates by the Dice coefficient of their word bigrams.

Each line of a document, each paragraph of several lines (licences are wrapped, and comment marks stand before their
lines), and the document as a whole, is normalised (ASCII letters in lower case, everything
but letters and digits a space) and turned into its set of word bigrams. Dice is twice the shared bigrams over
the sum of both sizes, so a template can reach the threshold t only if its size lies between t / (2 - t) and
(2 - t) / t times the size of the text's set: these bounds leave few templates for each line. They also mean that a
match has most of the template's bigrams, so it has one of a few trigger words; texts and lines without any are passed over
by byte searches. All is done within the row by array functions; nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import text_of

#: Licence notices as (licence, text): fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

#: What parts paragraphs: lines without a letter or digit.
BREAK = r"\n[^A-Za-z0-9]*\n"


def _plain(text: str) -> list[str]:
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def template_grams(templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """Index, licence and sorted distinct bigrams of each template."""
    out = []
    for i, (name, text) in enumerate(templates):
        words = _plain(text)
        out.append((i, name, sorted({f"{a} {b}" for a, b in zip(words, words[1:])})))
    return out


def trigger_words(templates: Sequence[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every text that reaches the threshold with any template has at least one.

    Such a text has t / (2 - t) of a template's bigrams, so it suffices that the bigrams without a trigger are fewer.
    Long words that many templates need are taken first.
    """
    grams = [[g.split() for g in grams] for _, _, grams in template_grams(templates)]
    need = [len(g) - math.ceil(len(g) * threshold / (2 - threshold) - 1e-9) + 1 for g in grams]
    chosen: list[str] = []

    def missing(words: list[str]) -> list[int]:
        return [max(0, n - sum(any(w in words for w in g) for g in own)) for own, n in zip(grams, need)]

    while any(left := missing(chosen)):
        words = sorted({w for own, n in zip(grams, left) if n for g in own for w in g} - {*chosen})
        gain = {w: sum(a - b for a, b in zip(left, missing([*chosen, w]))) for w in words}
        chosen.append(max(words, key=lambda w: (gain[w] > 0, len(w) >= 5, gain[w], len(w), -sum(w in g for own in grams for g in own))))
    return chosen


def _has_trigger(text: Column, triggers: Sequence[str]) -> Column:
    lower = F.lower(text)
    out = F.lit(False)
    for w in triggers:
        out = out | lower.contains(w)
    return out


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[^a-z0-9]+"), lambda w: w != "")


def _found(line: Column, templates: Column, threshold: float) -> Column:
    """dice, licence and template of the best template for a text, null below the threshold."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def judge(words: Column) -> Column:
        pairs = F.array_distinct(F.transform(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), lambda w, i: F.concat_ws(" ", w, F.element_at(words, i + 2))))

        def best(grams: Column) -> Column:
            fits = F.filter(templates, lambda t: (t["n"] >= F.size(grams) * low - 1e-9) & (t["n"] <= F.size(grams) * high + 1e-9))
            scored = F.transform(fits, lambda t: F.struct((2.0 * F.size(F.array_intersect(t["grams"], grams)) / (t["n"] + F.size(grams))).alias("dice"), (-t["i"]).alias("rank"), t["name"].alias("licence")))
            return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))

        return F.element_at(F.transform(F.array(pairs), best), 1)

    # Some template must be within the bounds of the word pairs, repeated ones included: most lines end here.
    def gate(words: Column) -> Column:
        near = F.exists(templates, lambda t: t["n"] <= (F.size(words) - 1) * high + 1e-9)
        return F.when((F.size(words) > 1) & near, judge(words))

    return F.element_at(F.transform(F.array(_words(line)), gate), 1)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """A row for each document: doc_id, licence, dice, n_matches, n_paragraphs, licences, whole.

    Paragraphs are parted by lines without a letter or digit of ASCII; those with two lines that have one are judged.
    ``licences`` has the distinct licences of all lines and paragraphs with a template at ``threshold`` or more, sorted
    and joined by commas (empty: none), ``n_matches`` the number of such lines, ``n_paragraphs`` that of such
    paragraphs, ``licence`` and ``dice`` the best match of a line, a paragraph or the whole text (ties: the first
    template), and ``whole`` tells if the whole text matches one. A text with fewer than two words, an empty and a null text match nothing; repeated rows are
    judged alike; an empty table gives no rows. Other columns are ignored.
    """
    known = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams")) for i, name, grams in template_grams(templates)])
    text = text_of()
    triggers = trigger_words(templates, threshold)
    kind = "struct<dice:double,rank:int,licence:string>"
    none = F.array().cast(f"array<{kind}>")
    any_at_all = _has_trigger(text, triggers)

    def matches(units: Column) -> Column:
        return F.when(any_at_all, F.filter(F.transform(units, lambda x: _found(x, known, threshold)), lambda m: m.isNotNull())).otherwise(none)

    def wrapped(x: Column) -> Column:
        return F.size(F.filter(F.split(x, "\n"), lambda line: line.rlike("[A-Za-z0-9]"))) > 1

    lines = F.filter(F.split(text, "\n"), lambda x: _has_trigger(x, triggers))
    paragraphs = F.filter(F.split(text, BREAK), lambda x: _has_trigger(x, triggers) & wrapped(x))
    whole = F.when(any_at_all & (F.instr(text, "\n") > 0), _found(text, known, threshold))
    found = docs.select("doc_id", matches(lines).alias("lines"), matches(paragraphs).alias("paragraphs"), whole.alias("all"))
    best = F.array_max(F.concat("lines", "paragraphs", F.when(F.col("all").isNotNull(), F.array("all")).otherwise(none)))
    return found.select(
        "doc_id", best["licence"].alias("licence"), F.round(best["dice"], 6).alias("dice"), F.size("lines").cast("long").alias("n_matches"), F.size("paragraphs").cast("long").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.concat("lines", "paragraphs"), lambda m: m["licence"]))), ",").alias("licences"), F.col("all").isNotNull().alias("whole"),
    )
