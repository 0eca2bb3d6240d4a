"""License scans: an exact set-similarity join between license templates and the text blocks of documents.

Blocks are lines of any length and, for notices wrapped over lines, all runs of neighbouring words of the text that are
at most ``SLACK`` words more than twice as long as the template; a template and a block are sets of words. A block is a hit when it holds at least
``threshold`` of the template's words (containment of the template). Words are ordered by the number of texts of the whole
corpus that hold them, rarest first. By the prefix filter a hit must hold one of the template's first n - need + 1
words in that order, by the length filter at least ``need`` of its words, and by the positional filter the block's words
from the first shared one on must suffice; what is left is verified by intersection.

One pass in the JVM cuts texts into words and keeps, for every document, the number of words and which template words it
holds. The word counts come from it; and as only templates that all words of a text together reach can be reached by a
part of it, the filters are first applied to whole texts there. Only the texts that pass go on to Python, with the
labels they may have, where the same filters meet lines and runs. The counts cover all documents, for the words that
templates hold (a fixed few hundred), so nothing unbounded is sent.

Base labels come from whole texts: places where the words of a phrase stand one after another.

Nulls and odd input: a null text has no words, no places and no labels (empty strings, null positions);
rows with equal or null doc_id are separate; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.common import ascii_lowered, keep

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
#: Words that a run may have beyond twice its template's.
SLACK = 8
#: Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices that stand in files, and license texts, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "mit-notice": "released under the mit license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl-2": "this program is free software under the gnu general public license version 2",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-sa-4.0": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "bsd-3": "redistribution and use in source and binary forms with or without modification are permitted",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "rights-reserved": "all rights reserved",
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "isc-text": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
        ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-2.0-notice": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl-notice": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License
        for more details. You should have received a copy of the GNU General Public License along with this program.""",
    "boost-text": """
        Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to
        whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and
        this entire statement, including the above license grant, this restriction and the following disclaimer, must be
        included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
        copies or derivative works are solely in the form of machine-executable object code generated by a source language
        processor.""",
    "zlib-text": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would
        be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. This notice may not be removed or altered from any source
        distribution.""",
    "unlicense-text": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author
        or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
        this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend
        this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law.""",
}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def template_sets(templates: dict[str, str]) -> dict[str, frozenset[str]]:
    return {label: frozenset(words_of(t)) for label, t in templates.items()}


def needed(size: int, threshold: float) -> int:
    """Fewest shared words that reach the threshold (exact for ties)."""
    return next(n for n in range(size + 1) if n >= threshold * size - 1e-9)


class TemplateIndex:
    """Templates in the global order of words, with an inverted list of their prefixes."""

    def __init__(self, templates: dict[str, str], counts: dict[str, int], threshold: float):
        self.order = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
        self.prefixes: dict[str, list[str]] = {}
        self.sets, self.need, self.width = template_sets(templates), {}, {t: 2 * len(words_of(x)) + SLACK for t, x in templates.items()}
        for label, words in self.sets.items():
            line = sorted(words, key=self.order.__getitem__)
            need = self.need[label] = needed(len(line), threshold)
            for w in line[: len(line) - need + 1]:
                self.prefixes.setdefault(w, []).append(label)

    def prefix(self, label: str) -> list[str]:
        return [w for w, labels in self.prefixes.items() if label in labels]

    def candidates(self, block: set[str], positional: bool = True) -> list[str]:
        """Labels that the prefix, length and positional filters leave."""
        ranked = sorted(self.order.keys() & block, key=self.order.__getitem__)
        left: dict[str, bool] = {}
        for i, w in enumerate(ranked):
            for label in self.prefixes.get(w, ()):
                # The first shared word decides: what follows it in the block must suffice.
                left.setdefault(label, len(ranked) - (i if positional else 0) >= self.need[label])
        return [label for label, may in left.items() if may]

    def match(self, block: set[str]) -> dict[str, float]:
        """label -> containment, for the templates that the block reaches."""
        shared = {label: len(self.sets[label] & block) for label in self.candidates(block)}
        return {label: n / len(self.sets[label]) for label, n in shared.items() if n >= self.need[label]}

    def reached(self, held: Column) -> Column:
        """Labels that a text may have, as a column over the template words it holds."""
        may = []
        for label, words in self.sets.items():
            literal = lambda xs: F.array(*map(F.lit, sorted(xs)))
            enough = F.size(F.array_intersect(held, literal(words))) >= self.need[label]
            may.append(F.when((F.size(held) >= self.need[label]) & F.arrays_overlap(held, literal(self.prefix(label))) & enough, F.lit(label)))
        return F.array_compact(F.array(*may)) if may else F.array().cast("array<string>")


def run_hits(words: list[str], template: frozenset[str], need: int, width: int) -> list[tuple[int, int, int]]:
    """(shared words, first, last) of runs of at most ``width`` words that hold ``need`` of the template's: for each
    last word that the run does not hold before, the shortest run with as many shared words."""
    at = [i for i, w in enumerate(words) if w in template]
    held: dict[str, int] = {}
    found, left = [], 0
    for last in at:
        w = words[last]
        held[w] = held.get(w, 0) + 1
        while last - at[left] >= width or held[words[at[left]]] > 1:
            out = words[at[left]]
            held[out] -= 1
            if not held[out]:
                del held[out]
            left += 1
        if held[w] == 1 and len(held) >= need:
            found.append((len(held), at[left], last))
    return found


def scan_text(text: str, index: TemplateIndex, reached: list[str]) -> tuple[dict[str, float], list[int]]:
    """label -> best containment, and the numbers of the lines that hit, for the templates that the whole text reaches."""
    labels: dict[str, float] = {}
    lines = [words_of(line) for line in text.split("\n")]
    own: dict[str, set[int]] = {label: set() for label in reached}
    for i, line in enumerate(lines):
        for label, share in index.match(set(line)).items():
            own[label].add(i)
            labels[label] = max(share, labels.get(label, 0.0))
    hits = set().union(*own.values())
    words, line_of = [w for line in lines for w in line], [i for i, line in enumerate(lines) for _ in line]
    for label in reached:
        for shared, first, last in run_hits(words, index.sets[label], index.need[label], index.width[label]):
            labels[label] = max(shared / len(index.sets[label]), labels.get(label, 0.0))
            touched = range(line_of[first], line_of[last] + 1)
            if own[label].isdisjoint(touched):
                hits.update(touched)
    return labels, sorted(hits)


def phrase_places(words: list[str], phrases: dict[tuple[str, ...], str]) -> list[tuple[int, str]]:
    places = []
    last = {p[-1] for p in phrases}
    for at in [i for i, w in enumerate(words) if w in last]:
        for phrase, label in phrases.items():
            first = at - len(phrase) + 1
            if first >= 0 and tuple(words[first : at + 1]) == phrase:
                places.append((first, label))
    return places


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<int>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """Per document: words, places and labels of phrases, labels of templates, best containment, and the line numbers that hit."""
    sets = template_sets(templates)
    parts = {tuple(words_of(p)): label for p, label in phrases.items()}
    vocabulary = frozenset().union(*sets.values(), *parts)
    literal = lambda xs: F.array(*map(F.lit, sorted(xs))).cast("array<string>")
    words = F.regexp_extract_all(ascii_lowered(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), words.alias("words"))
    cut = cut.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", literal(vocabulary)).alias("held"), "text")
    # The length filter needs no order of words: texts that no template and no phrase can be in stay behind.
    counted = lambda xs: F.size(F.array_intersect("held", literal(xs)))
    may = [counted(s) >= needed(len(s), threshold) for s in sets.values()] + [counted(p) == len(set(p)) for p in parts]
    least = min([needed(len(s), threshold) for s in sets.values()] + [len(set(p)) for p in parts], default=0)
    some = F.lit(False)
    for test in may:
        some = some | test
    cut = keep(cut.withColumn("text", F.when((F.size("held") >= least) & some, F.col("text"))))
    counts = cut.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    index = TemplateIndex(templates, dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in counts}, threshold)

    def run(batches):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc, n, text, reached in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    places = phrase_places(words_of(text), parts)
                    labels, hits = scan_text(text, index, reached) if reached else ({}, [])
                    base = sorted({label for _, label in places})
                    starts = [p for p, _ in places]
                    score = max([*labels.values(), *([1.0] if base else [])], default=0.0)
                    rows.append((doc, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *labels})), score, hits))
                kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    near = cut.filter("text is not null").select("doc_id", "n_words", "text", index.reached(F.col("held")).alias("reached")).mapInArrow(run, SCHEMA)
    none = {"n_base": "0L", "first_word": "cast(null as long)", "last_word": "cast(null as long)", "base_labels": "''", "labels": "''", "score": "0D", "blocks": "cast(array() as array<int>)"}
    return cut.filter("text is null").select("doc_id", "n_words", *[F.expr(e).alias(c) for c, e in none.items()]).unionByName(near)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).drop("blocks")
