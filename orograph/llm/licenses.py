"""License scans: stock phrases, and an exact set-similarity join with license templates.

A text block is as many consecutive words of a document as the template has,
from any word on, over line breaks and comment marks; a shorter document is one
block. It matches the template when it holds at least ``threshold`` of the
template's distinct words. The join is exact. Words are ordered by how many
documents hold them, rarest first; a match must hold a word of the template's
prefix (all but the last ``needed - 1`` words in that order), and the first one
it holds must leave ``needed`` words from there on. Documents with fewer of the
template's words than needed fall to the length filter. What is left is counted
by sliding over the places of the template's words.

Only the counts of the templates' own words reach the driver. Defined results:
null text counts as empty (no words, no labels, score 0); repeated rows each
give a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import each_text, utf8

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Our templates, by label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License.""",
    "bsd-3-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
        OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "gpl-notice-text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
        received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
}

#: Lower-cases A-Z and turns every other ASCII byte that is no letter or digit into a space; others stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(start, label) wherever a phrase's words stand consecutively."""
    joined, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        at, passed, start = joined.find(phrase), 0, 0
        while at >= 0:
            start += joined.count(b" ", passed, at)
            found.append((start, label))
            passed, at = at, joined.find(phrase, at + 1)
    return found


class Join:
    """The templates, indexed by the words of their prefixes."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        self.templates = []
        for label, text in sorted(templates.items()):
            words = words_of(text.encode())
            tokens = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
            needed = max(1, ceil(threshold * len(tokens) - 1e-9))
            for i, w in enumerate(tokens[: len(tokens) - needed + 1]):
                self.prefix.setdefault(w, []).append((len(self.templates), i))
            self.templates.append((label, frozenset(tokens), needed, len(words)))

    def matches(self, words: list[bytes], have: frozenset[bytes] | set[bytes]) -> dict[str, float]:
        """The best share of each template's words in a block, where it meets the threshold; ``have`` are the words, each once."""
        first, found = {}, {}
        for w in have & self.prefix.keys():
            for t, i in self.prefix[w]:
                first[t] = min(i, first.get(t, i))
        for t, i in first.items():
            label, tokens, needed, width = self.templates[t]
            if len(tokens) - i < needed or len(tokens & have) < needed:
                continue
            if (n := most_in(words, tokens, width)) >= needed:
                found[label] = n / len(tokens)
        return found


def most_in(words: list[bytes], tokens: frozenset[bytes], width: int) -> int:
    """The most distinct tokens in ``width`` consecutive words."""
    hits = [(i, w) for i, w in enumerate(words) if w in tokens]
    held: dict[bytes, int] = {}
    best = left = 0
    for i, w in hits:
        held[w] = held.get(w, 0) + 1
        while hits[left][0] <= i - width:
            gone = hits[left][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            left += 1
        best = max(best, len(held))
    return best


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        for b in batches:
            for text in each_text(b):
                for w in vocabulary.intersection(words_of(text)):
                    counts[w] += 1
        held = [(w, n) for w, n in counts.items() if n]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in held], pa.binary()), pa.array([n for _, n in held], pa.int64())], ["word", "n"])

    return run


def _scanner(join: Join, phrases: dict[str, str]):
    spaced = {b" " + k.encode() + b" ": v for k, v in phrases.items()}
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def row(text: bytes) -> tuple:
        words = words_of(text)
        found = places(words, spaced)
        base = {label for _, label in found}
        scores = {} if join.prefix.keys().isdisjoint(words) else join.matches(words, set(words))
        at = [i for i, _ in found]
        score = 1.0 if base else max(scores.values(), default=0.0)
        return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | scores.keys())), score

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(t) for t in each_text(b)]
            made = zip(*rows, strict=True) if rows else [[] for _ in columns[1:]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(made, types[1:], strict=True))], columns)

    return run


def scan_licenses(docs: DataFrame, *, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document.

    ``labels`` adds the labels of the templates matched; ``score`` is 1 where a
    phrase stands, else the best containment that meets the threshold, else 0.
    """
    templates = TEMPLATES if templates is None else templates
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    vocabulary = frozenset(w for t in templates.values() for w in words_of(t.encode()))
    counts = texts.mapInArrow(_frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {bytes(r.word): r.n for r in counts.collect()}  # at most the templates' own words
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return texts.mapInArrow(_scanner(Join(templates, frequency, threshold), PHRASES if phrases is None else phrases), schema)


def oracle(threshold: float = 0.8, templates: dict[str, str] | None = None) -> str:
    """The same scan as DuckDB SQL, by comparing every block of the documents that hold enough of a template's words."""

    def tokens(text: str) -> Sequence[str]:
        return sorted({w.decode() for w in words_of(text.encode())})

    chosen = sorted((TEMPLATES if templates is None else templates).items())
    values = ", ".join(f"('{k}', {tokens(v)!r}, {len(words_of(v.encode()))})" for k, v in chosen)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = r"regexp_extract_all(" + low + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = ", ".join(f"({k.split()!r}, '{v}')" for k, v in PHRASES.items())
    return f"""
        WITH d AS (SELECT doc_id, {split.format("coalesce(text, '')")} AS w FROM documents),
        p(p, label) AS (VALUES {phrases}),
        b AS (SELECT doc_id, i - 1 AS start_word, label FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, p)
              WHERE w[i : i + len(p) - 1] = p),
        base AS (SELECT doc_id, count(*) AS n, min(start_word) AS f, max(start_word) AS l, list(DISTINCT label) AS ls FROM b GROUP BY doc_id),
        t(label, w, width) AS (VALUES {values}),
        near AS (SELECT doc_id, d.w, t.w AS tw, label, width FROM d, t WHERE len(list_intersect(list_distinct(d.w), t.w)) >= ceil({threshold} * len(t.w) - 1e-9)),
        blocks AS (SELECT doc_id, label, tw, w[i : i + width - 1] AS w FROM (SELECT *, unnest(range(1, greatest(1, len(w) - width + 1) + 1)) AS i FROM near)),
        s AS (SELECT doc_id, label, n / m AS c FROM (SELECT doc_id, label, len(list_intersect(list_distinct(w), tw)) AS n, len(tw) AS m FROM blocks) WHERE n >= ceil({threshold} * m - 1e-9)),
        m AS (SELECT doc_id, list(DISTINCT label) AS ls, max(c) AS c FROM s GROUP BY doc_id)
        SELECT doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_base, f AS first_word, l AS last_word,
               coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(m.ls, [])))), ','), '') AS labels,
               CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
        FROM d LEFT JOIN base USING (doc_id) LEFT JOIN m USING (doc_id)"""
