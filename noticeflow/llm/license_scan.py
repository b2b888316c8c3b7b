"""Licence scan: Dice coefficient over word bigrams against licence templates (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public licence notices, (licence id, notice).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    # whole texts, as they stand at the head or in the licence file of a work
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
        "in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    # the beginnings of licence texts too long to be compared whole
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION "
        "1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 "
        "of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    ),
    (
        "GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., "
        "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies "
        "of this license document, but changing it is not allowed.",
    ),
    (
        "GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. "
        "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    (
        "AGPL-3.0",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. "
        "Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, "
        "specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    (
        "LGPL-2.1",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. "
        "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies "
        "of this license document, but changing it is not allowed. [This is the first released version of the Lesser GPL. It also counts "
        "as the successor of the GNU Library Public License, version 2, hence the version number 2.1.]",
    ),
    (
        "LGPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. "
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the "
        "GNU General Public License, supplemented by the additional permissions listed below.",
    ),
    (
        "MPL-2.0",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to "
        "the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others (if any) used "
        "by a Contributor and that particular Contributor's Contribution.",
    ),
]
#: How texts fall into units: at line ends, at lines without letters and digits, and behind sentence ends.
PARAGRAPH, SENTENCE = r"\n[^A-Za-z0-9\n]*\n", r"[.!?]\s+"


def template_words(text: str) -> list[str]:
    import re

    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def read_templates(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(file name without its ending, text) of every file of a folder of licence texts, for `license_scan`."""
    rows = spark.read.text(f"{folder.rstrip('/')}/*", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1).alias("name"), "value").collect()
    return sorted((r["name"], r["value"]) for r in rows)


#: Words too common to tell a notice by.
COMMON = {"the", "a", "of", "to", "and", "or", "in", "is", "by", "under", "this", "that", "for", "as", "are", "be", "with", "any", "not", "on", "it", "you", "may", "can", "at", "so", "if", "do"}


def telling_words(known: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold holds at least one.

    Such a unit shares at least t/(2-t) of a template's bigrams, so it shares
    one of any larger-than-the-rest selection; the selection is made of the
    bigrams that few, long, uncommon words cover.
    """
    words: set[str] = set()
    for _, grams in known:
        need = len(grams) - int(len(grams) * threshold / (2 - threshold) - 1e-9)
        pairs = [set(g.split(" ")) for g in grams]
        for word in sorted({w for p in pairs for w in p}, key=lambda w: (w in COMMON or w.isdigit(), -len(w), w)):
            if sum(bool(p & words) for p in pairs) >= need:
                break
            words.add(word)
    return sorted(words)


def anchors(templates, threshold: float) -> dict[str, list[tuple[int, int]]]:
    """Bigrams by which windows of words are laid: {bigram: [(its place in the template, the template's words)]}.

    Of each template the least common ones, so many that every passage that
    reaches the threshold holds at least one.
    """
    found: dict[str, list[tuple[int, int]]] = {}
    for _, text in templates:
        words = template_words(text)
        grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
        distinct = sorted(set(grams), key=lambda g: (sum(w in COMMON or w.isdigit() for w in g.split(" ")), -len(g), g))
        for g in distinct[: len(distinct) - int(len(distinct) * threshold / (2 - threshold) - 1e-9)]:
            place = (grams.index(g), len(words))
            if place not in found.setdefault(g, []):
                found[g].append(place)
    return found


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.slice(pairs, F.lit(1), F.size(words) - 1)


def clean(unit: Column) -> Column:
    lowered = F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once a row: a generator, unlike a projection, is never merged into what reads it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


#: More words than a template has.
SHIFT = 1 << 20


def word_windows(rows: DataFrame, places: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """(doc_id, words): of rows with doc_id and text, the words around each anchor where its template would stand.

    The number of windows grows with the anchors in a text and their size with
    the templates, so the work is linear in the text.
    """
    rows = computed(rows.select("doc_id", F.split(clean(F.col("text")), " ").alias("whole")), "w", F.col("whole")).drop("whole")
    rows = computed(rows, "grams", F.when(F.size("w") > 1, bigrams(F.col("w"))))
    # a window as one number, so that equal ones are found by hashing: its first word (from -SHIFT on) and its length
    order = sorted(places)
    laid = ", ".join("array(" + ", ".join(f"{(SHIFT - at) * SHIFT + n}L" for at, n in places[g]) + ")" for g in order)
    listed = ", ".join(f"'{g}'" for g in order)
    hits = f"filter(transform(grams, (g, i) -> struct(g AS g, i AS i)), h -> h.g IN ({listed}))"
    starts = F.expr(f"flatten(transform({hits}, h -> transform(element_at(array({laid}), cast(array_position(array({listed}), h.g) as int)), p -> h.i * {SHIFT}L + p)))")
    rows = computed(rows, "starts", F.array_distinct(starts)).where(F.size("starts") > 0)
    window = f"slice(w, cast(greatest(p div {SHIFT} - {SHIFT}, 0) + 1 as int), cast(p % {SHIFT} + least(p div {SHIFT} - {SHIFT}, 0) as int))"
    return rows.select("doc_id", F.explode(F.expr(f"transform(starts, p -> {window})")).alias("words"))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license_id, dice, units): licences found in each document.

    Units are the lines of a text, its sentences, its paragraphs (parted by lines
    without letters and digits, as in comments), and windows of words that are as
    long as a template, laid so that one of its telling bigrams stands where the
    template has it: they find notices inside longer sentences, and texts of any
    number of paragraphs.  A unit is lower-cased (A-Z) and every run outside
    [a-z0-9] becomes one space; dice = 2|A & B| / (|A| + |B|) over distinct word
    bigrams.  A unit of n bigrams meets only templates of t/(2-t)*n to (2-t)/t*n
    bigrams: outside these bounds the coefficient cannot reach t.  Of a
    document's units the best dice per licence is given, with the number of
    different units that reach the threshold.  Null, empty and wordless texts,
    empty tables and an empty list of templates give no rows; rows that repeat a
    doc_id are scanned as one document; the work grows in proportion to a text,
    whatever its lines and paragraphs.  `templates` is a list in the caller's
    memory (see read_templates).
    """
    known = [(name, template_bigrams(text)) for name, text in templates]
    known = [(name, grams) for name, grams in known if grams]
    if not known:
        return docs.where("false").select(F.col(id_col).alias("doc_id"), F.lit("").alias("license_id"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("units"))
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    least, most = min(len(g) for _, g in known) * low, max(len(g) for _, g in known) * high
    # documents, then units, without a telling word go before anything is cut or normalised
    telling = f"(?i)(?<![a-z0-9])(?:{'|'.join(telling_words(known, threshold))})(?![a-z0-9])"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(telling))
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", PARAGRAPH), F.split("text", SENTENCE)))
    plain = texts.select("doc_id", F.explode(units).alias("unit")).where(F.col("unit").rlike(telling)).select("doc_id", F.split(clean(F.col("unit")), " ").alias("words"))
    rows = plain.unionByName(word_windows(texts, anchors(templates, threshold)))
    # distinct bigrams are at most words - 1: short units go before any bigram is built
    rows = computed(rows.where(F.size("words") - 1 >= F.lit(least)), "grams", F.array_distinct(bigrams(F.col("words"))))
    rows = rows.where((F.size("grams") >= F.lit(least)) & (F.size("grams") <= F.lit(most)))
    n = F.size("grams")
    scored = [
        F.when(
            (n >= F.lit(len(grams) * low)) & (n <= F.lit(len(grams) * high)),
            F.struct(
                F.lit(name).alias("license_id"),
                (F.lit(2.0) * F.size(F.array_intersect("grams", F.split(F.lit("|".join(grams)), r"\|"))) / (n + F.lit(len(grams)))).alias("dice"),
            ),
        )
        for name, grams in known
    ]
    hits = rows.select("doc_id", F.array_join("words", " ").alias("unit"), F.explode(F.filter(F.array(*scored), lambda s: s["dice"] >= threshold)).alias("hit"))
    return hits.groupBy("doc_id", F.col("hit.license_id").alias("license_id")).agg(F.max("hit.dice").alias("dice"), F.count_distinct("unit").alias("units"))
