"""License scans: an exact set-similarity join of text blocks with license templates, and base phrases.

A block is any stretch of consecutive words of the whole text, line breaks or not, up to the template's number of words
divided by the threshold. A template is found where a block holds at least ``threshold`` of its distinct words. Template
words are ordered by their frequency over all documents, rarest first. A block that meets a template holds a word of its
prefix in that order (prefix filter); the text must hold enough of the template's words (length filter), and enough of
them must be left besides those rarer than the shared word which the text lacks (positional filter). Blocks about the
prefix words that remain slide one word at a time over running counts. Blocks of one template that meet become one
find, from the first word to the last that is counted, with the largest containment.

Defined results for odd input: null text is the empty text, with no words; repeated rows and ids are scanned row by
row; labels are distinct and sorted, so ties can't show; other columns pass through untouched, but for those named as a
result; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.llm.rows import map_texts

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Public license notices and texts with their labels, a fixed and small set.
TEMPLATES = {
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2",
    "You may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache-2",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "All rights reserved.": "all-rights-reserved",
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
    this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
    "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
    HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
    ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""": "mit",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
    the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
    WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
    governing permissions and limitations under the License.""": "apache-2",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
    PURPOSE ARE DISCLAIMED.""": "bsd",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies.""": "isc",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
    version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
    details.""": "gpl",
}
#: Word bytes stay, with A-Z in lower case; all others become blanks.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    return text.translate(FOLD).split()


def places(text: list[bytes], phrase: list[bytes]) -> list[int]:
    """Every word number at which the phrase's words stand one after the other."""
    joined, wanted = b" " + b" ".join(text) + b" ", b" " + b" ".join(phrase) + b" "
    out, at = [], joined.find(wanted)
    while at >= 0:
        out.append(joined.count(b" ", 0, at))
        at = joined.find(wanted, at + 1)
    return out


def template_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each template word stands. Each task sends one row for a word; the vocabulary is fixed."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words(text or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


class Template:
    """One template: its words as ranks in the global order, rarest first."""

    __slots__ = ("label", "least", "order", "prefix", "ranks", "width")

    def __init__(self, label: str, ranks: set[int], n_words: int, threshold: float):
        self.label, self.order = label, sorted(ranks)
        self.ranks, self.least, self.width = frozenset(ranks), math.ceil(threshold * len(ranks) - 1e-9), math.ceil(n_words / threshold - 1e-9)
        self.prefix = self.order[: len(ranks) - self.least + 1]

    def anchors(self, known: frozenset[int]) -> set[int]:
        """Prefix words, held by the text, that can be the rarest one a block shares with the template."""
        out, lacking = set(), 0
        for rank in self.prefix:
            if rank not in known:
                lacking += 1
            elif len(self.order) - lacking >= self.least:
                out.add(rank)
        return out

    def finds(self, places: list[int], ranks: list[int], known: frozenset[int]) -> list[tuple[int, int, float]]:
        """(first word, end, containment) of each find. ``places`` and ``ranks``: the template's words in the text, in order."""
        if len(known & self.ranks) < self.least:
            return []
        anchors = self.anchors(known)
        near = [p for p, r in zip(places, ranks, strict=True) if r in anchors]
        found: list[list] = []
        counts: Counter = Counter()
        left, k = 0, 0
        for right, (place, rank) in enumerate(zip(places, ranks, strict=True)):
            counts[rank] += 1
            while places[left] <= place - self.width:
                counts[ranks[left]] -= 1
                if not counts[ranks[left]]:
                    del counts[ranks[left]]
                left += 1
            while k + 1 < len(near) and near[k + 1] <= place:
                k += 1
            if len(counts) >= self.least and near and places[left] <= near[k] <= place:
                share = len(counts) / len(self.order)
                if found and places[left] < found[-1][1]:
                    found[-1][1], found[-1][2] = places[right] + 1, max(found[-1][2], share)
                else:
                    found.append([places[left], places[right] + 1, share])
        return [tuple(f) for f in found]


class TemplateIndex:
    """Templates in global word order, and which of them each prefix word belongs to."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float):
        listed = [(label, words(text.encode())) for text, label in templates.items()]
        self.rank = {w: i for i, w in enumerate(sorted({w for _, ws in listed for w in ws}, key=lambda w: (frequency.get(w, 0), w)))}
        self.vocabulary = frozenset(self.rank)
        self.templates = [Template(label, {self.rank[w] for w in ws}, len(ws), threshold) for label, ws in listed]
        self.by_word: dict[int, list[int]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            for rank in t.prefix:
                self.by_word[rank].append(k)

    def finds(self, text: list[bytes], held: frozenset[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, containment) of every find; ``held``: the template words that stand in the text."""
        known = frozenset(self.rank[w] for w in held)
        asked = sorted({k for rank in known for k in self.by_word.get(rank, ()) if len(known & self.templates[k].ranks) >= self.templates[k].least})
        if not asked:
            return []
        places = [(i, self.rank[w]) for i, w in enumerate(text) if w in held]
        out = []
        for k in asked:
            t = self.templates[k]
            own = [x for x in places if x[1] in t.ranks]
            out += [(t.label, *f) for f in t.finds([i for i, _ in own], [r for _, r in own], known)]
        return out


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: dict[str, str] = TEMPLATES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, ``phrase_places`` (place and label of every base phrase), ``blocks`` (label, first word, end and containment of every find)."""
    vocabulary = {w for text in templates for w in words(text.encode())}
    frequency = template_frequencies(docs, vocabulary)

    def make():
        index = TemplateIndex(templates, frequency, threshold)
        phrases = [(words(p.encode()), label) for p, label in PHRASES.items()]

        def work(text: bytes | None):
            all_words = words(text or b"")
            held = index.vocabulary.intersection(all_words)
            found = [{"place": at, "label": label} for phrase, label in phrases if held.issuperset(phrase) or not index.vocabulary.issuperset(phrase) for at in places(all_words, phrase)]
            blocks = [dict(zip(("label", "start", "end", "containment"), f, strict=True)) for f in index.finds(all_words, held)]
            return len(all_words), found, blocks

        return work

    return map_texts(docs, make, "n_words long, phrase_places array<struct<place:long,label:string>>, blocks array<struct<label:string,start:long,end:long,containment:double>>", keep)
