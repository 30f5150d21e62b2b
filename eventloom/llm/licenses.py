"""Licence scans by diagonal voting.

The rolling word k-gram hashes of every text are joined to the positions of the same
k-grams in a fixed table of licence texts. A hit at word p of the text and word q
of a template votes for the diagonal p - q. Votes are summed by diagonal, and diagonals
that differ by at most `GAP` from the next in order of diagonals are merged: an inserted or
dropped word moves the rest of a match to a neighbouring diagonal, while a stray
hit elsewhere in the template lies on a far one and parts nothing. All places of a diagonal
are within one length of the template. A merged span is verified: it must cover at
least `MIN_COVERAGE` of the template's k-grams, each counted once, within twice the template's
length. Templates so short that one changed word would be too much must be covered whole.

A text is read and cut into words once. Of its k-grams only those whose hash is in the
template table leave the row, each with its place and its k words, which the join compares,
so hash collisions never count. The template table has a fixed size and is broadcast.

Besides, every place of a short base phrase is reported with its label.

Defined results: a null or empty text has no words, no labels and score 0; texts that
are equal after lower-casing share one result; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.shared import ascii_lower, join_small, checkpoint, text_or_empty

#: A word is a run of digits, lower-case letters and characters beyond ASCII; this splits between words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Statements of public licences that stand alone in texts, and their labels.
STATEMENTS = [
    ("mit", "Released under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License version 2"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights"),
    ("bsd", "Use of this source code is governed by a BSD-style license"),
]

_WARRANTY_MIT = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_CONDITIONS_BSD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
_WARRANTY_BSD = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

#: Texts of public licences, or the notices that they ask for, and their labels.
TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""" + _WARRANTY_MIT),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"""),
    ("bsd-2-clause", _CONDITIONS_BSD + _WARRANTY_BSD),
    ("bsd-3-clause", _CONDITIONS_BSD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""" + _WARRANTY_BSD),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE
        OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
        marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
        source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
        and by any means."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software"""),
]

TEMPLATES = [*STATEMENTS, *TEXTS]

K = 3
GAP = 3
MIN_COVERAGE = 0.8


def template_words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN_WORDS, text.lower()) if w]


def _gram(words: Column, at: Column, k: int) -> Column:
    """Hash of the k words from a position on."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def template_positions(spark: SparkSession, templates=tuple(TEMPLATES), k: int = K) -> DataFrame:
    """One row per k-gram of each template: its hash, place, words and the template's number of k-grams."""
    rows = [
        (n, label, at, words[at : at + k], len(words) - k + 1)
        for n, (label, text) in enumerate(templates)
        for words in [template_words(text)]
        for at in range(len(words) - k + 1)
    ]
    table = spark.createDataFrame(rows, "template int, label string, at int, gram_words array<string>, n_grams int")
    return table.withColumn("gram", _gram(F.col("gram_words"), F.lit(0), k))


def template_hits(words: Column, table: DataFrame, k: int = K) -> Column:
    """Places of `words` whose k-gram's hash is in the table, each with the hash and the words."""
    known = [row.gram for row in table.select("gram").distinct().collect()]
    last = F.size(words) - k
    places = F.filter(F.sequence(F.lit(0), last), lambda i: _gram(words, i, k).isin(known))
    found = F.transform(places, lambda i: F.struct(i.alias("place"), _gram(words, i, k).alias("gram"), F.slice(words, i + 1, F.lit(k)).alias("gram_words")))
    return F.when(last >= 0, found)


def license_spans(hits: DataFrame, table: DataFrame, k: int = K, gap: int = GAP, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Verified spans of rows (text_key, hits): text_key, label, first_word, end_word, coverage.

    Rows with the same text_key must have the same hits.
    """
    votes = (
        hits.select("text_key", F.explode("hits").alias("hit"))
        .select("text_key", "hit.*")
        .join(F.broadcast(table), ["gram", "gram_words"])
        .select("text_key", "template", "label", "n_grams", "place", "at", (F.col("place") - F.col("at")).alias("diagonal"))
    )
    diagonals = votes.groupBy("text_key", "template", "label", "n_grams", "diagonal").agg(
        F.min("place").alias("start"), F.max("place").alias("end"), F.collect_set("at").alias("places")
    )
    in_order = Window.partitionBy("text_key", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > gap, F.lit(True))
    return (
        diagonals.withColumn("new", new.cast("int"))
        .withColumn("run", F.sum("new").over(in_order))
        .groupBy("text_key", "template", "label", "n_grams", "run")
        .agg(F.min("start").alias("first_word"), (F.max("end") + k).alias("end_word"), F.flatten(F.collect_list("places")).alias("places"))
        .withColumn("coverage", F.size(F.array_distinct("places")) / F.col("n_grams"))
        .where(F.col("coverage") >= F.when(F.col("n_grams") * (1 - min_coverage) < k, 1.0).otherwise(min_coverage))
        .where(F.col("end_word") - F.col("first_word") <= 2 * (F.col("n_grams") + k))
        .select("text_key", "label", "first_word", "end_word", "coverage")
    )


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    parts = phrase.split()
    start = lambda i: F.forall(
        F.array(*[F.get(words, i + j) == F.lit(p) for j, p in enumerate(parts)]), lambda x: F.coalesce(x, F.lit(False))
    )
    # Only places of the first word are looked at.
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (F.get(words, i) == parts[0]) & start(i))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, base phrase places and labels, labels of both kinds, and a score.

    The score is the greatest coverage of a template, a base phrase counting as covered whole.
    """
    table = checkpoint(template_positions(docs.sparkSession))
    lowered = ascii_lower(text_or_empty(text_col))
    words = docs.select(
        F.col(id_col).alias("doc_id"),
        F.md5(lowered).alias("text_key"),
        F.filter(F.split(lowered, BETWEEN_WORDS), lambda w: w != "").alias("words"),
    )
    none = F.array().cast("array<int>")
    found = {
        label: F.when(F.array_contains("words", phrase.split()[0]), _places(F.col("words"), phrase)).otherwise(none)
        for phrase, label in BASE_PHRASES.items()
    }
    scanned = words.select(
        "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), template_hits(F.col("words"), table).alias("hits"),
        *[c.alias(f"at_{n}") for n, c in enumerate(found.values())],
    ).select(
        "doc_id", "text_key", "n_words", "hits",
        F.concat(*[F.col(f"at_{n}") for n in range(len(found))]).alias("places"),
        F.filter(
            F.array(*[F.when(F.size(f"at_{n}") > 0, F.lit(label)) for n, label in enumerate(found)]), lambda x: x.isNotNull()
        ).alias("base"),
    )
    base = checkpoint(scanned)
    by_text = checkpoint(
        license_spans(base.where(F.size("hits") > 0).select("text_key", "hits"), table)
        .groupBy("text_key")
        .agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    )
    joined = join_small(base, by_text, "text_key", "left")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    has_base = F.size("places") > 0
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.when(has_base, 1.0).otherwise(0.0), F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )
