"""Operator 4: licence scans by Dice coefficient over word bigrams.

A text is compared with licence templates unit by unit: each line, each sentence of a line, the text as a whole
(a licence file spread over lines), and runs of consecutive pieces, where a piece is what lies between two line or
sentence ends (licences and notices that are wrapped or in paragraphs inside a longer text). Unit and template are normalised (letters and digits, lower case) to their sets of
word bigrams ``A`` and ``B``; they match if ``2 |A & B| / (|A| + |B|) >= threshold``.
Since ``|A & B| <= min(|A|, |B|)``, only templates with ``t/(2-t) |A| <= |B| <= (2-t)/t |A|`` are candidates; among
those, an index of template bigrams yields the ones that share any.

A run has at most ``(2-t)/t`` times the words of the template. Since ``|A & B| >= t/(2-t) |B|``, runs start only where
that many bigrams of the template lie within so many words. Of overlapping runs that match, the one with the most
bigrams in common counts (BSD-3-Clause, not the BSD-2-Clause inside it); a licence that the text matches as a whole keeps
that coefficient. Lines and sentences that overlap a matching run over several lines are no units of their own.

The templates are a fixed, small table (a few KB) inside the code. Whole texts are scanned in one narrow pass
without a shuffle.

A unit counts for the licence that it resembles most. Licences that differ by a version or a word only are told apart
by these: a template matches no unit that lacks its version numbers, or whose ``VARIANTS`` are others than its own.

Defined results: null and empty texts and texts of one word match nothing; a licence that several units match counts
once with its best coefficient; ties go to the licence listed first; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sitegraph.llm.common import slices
from sitegraph.plans.tables import table

THRESHOLD = 0.8
#: The usual notices and texts of public licences, as (licence, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    *((f"CC-{code}-{version}", text) for version, place in (("4.0", "International"), ("3.0", "Unported"), ("2.0", "Generic"))
      for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                         ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
      for text in (f"Licensed under CC {code} {version}.", f"This work is licensed under a Creative Commons {name if version == '4.0' else name.replace('Derivatives', 'Derivs')} {version} {place} License.")),
    ("proprietary", "All rights reserved."),
)
#: Words that one licence of a family has and others lack.
VARIANTS = frozenset(b"affero lesser sharealike noncommercial noderivatives noderivs sa nc nd endorse".split())
BEFORE_VERSION = VARIANTS | {b"version", b"v", b"by", b"attribution"}
WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 10 if b == 10 else 46 if b in b".!?" else 32 for b in range(256))
SENTENCE = re.compile(rb"(?<=[.!?])\s+(?=[A-Z])")


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(WORD).replace(b".", b" ").split()


def versions(grams: set[tuple[bytes, bytes]]) -> set[tuple[bytes, bytes]]:
    """The bigrams that name a version."""
    return {(a, b) for a, b in grams if b.isdigit() and (a.isdigit() or a in BEFORE_VERSION)}


def variants(grams: set[tuple[bytes, bytes]]) -> set[bytes]:
    return {w for g in grams for w in g if w in VARIANTS}


class Templates:
    """Templates by bigram, with the bounds of size."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names = list(dict.fromkeys(name for name, _ in templates))
        self.sets = [(self.names.index(name), bigrams(normal_words(text.encode()))) for name, text in templates]
        self.index: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (_, s) in enumerate(self.sets):
            for g in s:
                self.index.setdefault(g, []).append(i)
        self.versions, self.variants = [versions(s) for _, s in self.sets], [variants(s) for _, s in self.sets]
        sizes = [len(s) for _, s in self.sets]
        self.least, self.most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
        self.vocabulary = {w for g in self.index for w in g}
        #: per template: the least number of its bigrams in a match, and the most words of a run
        self.need = [max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9)) for n in sizes]
        self.reach = [int(len(normal_words(text.encode())) * (2 - threshold) / threshold) for _, text in templates]

    def match(self, words: list[bytes], best: dict[int, float]) -> int:
        """Raise ``best`` (licence number: coefficient) by the best licence of one unit, which is returned (or -1)."""
        if len(words) < 2 or len(words) <= self.least:
            return -1
        unit = bigrams(words)
        if not self.least <= len(unit) <= self.most:
            return -1
        top, licence, _ = self.likest(unit)
        if top > best.get(licence, 0.0):
            best[licence] = top
        return licence

    def likest(self, unit: set[tuple[bytes, bytes]]) -> tuple[float, int, int]:
        """The best coefficient that reaches the threshold, its licence and the bigrams in common (else 0, -1, 0)."""
        n, top, licence, common = len(unit), 0.0, -1, 0
        for i in sorted({i for g in unit & self.index.keys() for i in self.index[g]}):
            name, own = self.sets[i]
            if n * self.threshold <= (2 - self.threshold) * len(own) and len(own) * self.threshold <= (2 - self.threshold) * n:
                both = len(unit & own)
                dice = 2 * both / (n + len(own))
                if dice >= self.threshold and dice > top and self.versions[i] <= unit and self.variants[i] == variants(unit):
                    top, licence, common = dice, name, both
        return top, licence, common

    def runs(self, text: bytes, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """First word, end, licence and coefficient of the runs of pieces that match, without overlaps."""
        index, places = self.index, {}
        for k, g in enumerate(zip(words, words[1:])):
            if g in index:
                for i in index[g]:
                    places.setdefault(i, []).append(k)
        dense = {}
        for i, at in places.items():
            need, reach = self.need[i], self.reach[i]
            if starts := [k for k, last in zip(at, at[need - 1:]) if last - k < reach]:
                dense[i] = starts
        if not dense:
            return []
        first = [0]  # the first word of every piece with words, and the end
        for line in text.split(b"\n"):
            for piece in SENTENCE.split(line):
                if n := len(normal_words(piece)):
                    first.append(first[-1] + n)
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        for i, starts in dense.items():
            own, at, need, reach = self.sets[i][1], places[i], self.need[i], self.reach[i]
            for p in sorted({bisect_right(first, k) - 1 for k in starts}):
                a = first[p]
                stop = bisect_right(first, a + reach) - 1  # the last piece boundary in reach
                if bisect_left(at, first[stop] - 1) - bisect_left(at, a) < need:
                    continue
                unit, both, done = set(), 0, a
                for q in range(p + 1, stop + 1):
                    for g in zip(words[done:first[q] - 1], words[done + 1:first[q]]):
                        if g not in unit:
                            unit.add(g)
                            both += g in own
                    done = first[q] - 1
                    if (p, q) not in found and 2 * both >= self.threshold * (len(unit) + len(own)):
                        found[p, q] = self.likest(unit)
        out, taken = [], bytearray(len(first))
        for (p, q), (dice, licence, _) in sorted(found.items(), key=lambda x: (-x[1][2], -x[1][0], x[0][1] - x[0][0], x[0])):
            if licence >= 0 and not any(taken[p:q]):
                taken[p:q] = b"\1" * (q - p)
                out.append((first[p], first[q], licence, dice))
        return sorted(out)

    def scan(self, text: bytes) -> dict[int, float]:
        """The matching licences of a text with their best coefficients."""
        best: dict[int, float] = {}
        lines, words = text.split(b"\n"), normal_words(text)
        runs = self.runs(text, words)
        whole = self.match(words, best) if len(lines) > 1 else -1
        for _, _, licence, dice in runs:
            if licence != whole and dice > best.get(licence, 0.0):
                best[licence] = dice
        at, starts = 0, [a for a, _, _, _ in runs]
        for line in lines:
            words = normal_words(line)
            first = start = at
            at += len(words)
            if self.vocabulary.isdisjoint(words):
                continue
            near = runs[max(0, bisect_right(starts, first) - 1):bisect_left(starts, at)]
            wrapped = [(a, b) for a, b, _, _ in near if first < b and (a < first or at < b)]
            if not wrapped:
                self.match(words, best)
            sentences = SENTENCE.split(line)
            if len(sentences) > 1:
                for sentence in sentences:
                    words = normal_words(sentence)
                    if not any(a < start + len(words) and start < b for a, b in wrapped):
                        self.match(words, best)
                    start += len(words)
        return best


SCHEMA = "doc_id long, n_licenses int, licenses string, best_license string, best_dice double"


def scan_documents(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the licences that match (by name), the best one and its coefficient (else null, 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch, texts in slices(batches):
            rows = []
            for text in texts:
                best = known.scan(text)
                top = min(best, key=lambda i: (-best[i], i), default=None)
                rows.append((len(best), ",".join(sorted(known.names[i] for i in best)), None if top is None else known.names[top], best.get(top, 0.0)))
            types = [pa.int32(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]],
                                             names=["doc_id", "n_licenses", "licenses", "best_license", "best_dice"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
