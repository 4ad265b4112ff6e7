"""Licence scans by a generalised suffix automaton over the words of licence templates.

The automaton accepts every run of words of any template. A text streams through it and gets, at each word, the
longest run ending there that some template contains (matching statistics). Long maximal runs of one template
that follow each other in text and template are chained into spans; a span that covers enough of its template
gives the template's label.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.tables import short_batches

#: Phrases that give a label wherever they stand.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed values: (label, notice), well-known licence notices.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
)

#: Fixed values: (label, text), whole notices as their licences give them; words only count.
NOTICES = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
        BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
        anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.""",
    ),
)

_BETWEEN = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TO_WORDS = bytes.maketrans(_BETWEEN + bytes(range(65, 91)), b" " * len(_BETWEEN) + bytes(range(97, 123)))


@dataclass(frozen=True)
class LicenseParameters:
    least_run: int = 3  # words of a run that may be part of a span (whole phrases always are)
    gap: int = 6  # words of the text, or of the template, that a chain may skip between two runs
    short: int = 12  # templates of fewer words must be covered by ``short_share``, others by ``long_share``
    short_share: float = 0.85
    long_share: float = 0.5


class SuffixAutomaton:
    """States of all runs of the templates' words; built once, then read only."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (template, words up to the end)
        self.lengths = [len(t) for t in templates]
        for t, words in enumerate(templates):
            last = 0
            for at, word in enumerate(words, 1):
                last = self._extend(last, word)
                self.ends[last].add((t, at))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another template has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def step(self, state: int, run: int, word: int) -> tuple[int, int]:
        """(state, words of the longest run that ends here) after one more word."""
        step = self.next[state].get(word)
        while step is None and state:
            state = self.link[state]
            run = self.length[state]
            step = self.next[state].get(word)
        return (0, 0) if step is None else (step, run + 1)


class LicenseScanner:
    """Scans texts; the words of the templates are all that it keeps."""

    def __init__(self, p: LicenseParameters, templates=TEMPLATES + NOTICES, phrases=PHRASES):
        self.p = p
        texts = [(label, t.encode().translate(_TO_WORDS).split()) for label, t in templates] + [(label, t.encode().split()) for t, label in phrases.items()]
        self.phrase_from = len(templates)
        self.labels = [label for label, _ in texts]
        self.codes: dict[bytes, int] = {}
        coded = [[self.codes.setdefault(w, len(self.codes)) for w in words] for _, words in texts]
        self.automaton = SuffixAutomaton(coded)
        # phrases that end wherever a state does
        self.phrases_at: list[list[tuple[int, int]]] = [sorted((t, n) for t, n in ends if t >= self.phrase_from and n == self.automaton.lengths[t] <= length) for ends, length in zip(self.automaton.ends, self.automaton.length)]
        self._complete()

    def _complete(self) -> None:
        """Phrases that are proper suffixes of a state's runs, from the states that it links to."""
        a = self.automaton
        for state in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            if a.link[state] > 0:
                self.phrases_at[state] = sorted({*self.phrases_at[state], *self.phrases_at[a.link[state]]})

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
        """(words, phrases as (label, first word, end), spans as (label, first word, end, share of the template))."""
        words = text.encode().translate(_TO_WORDS).split()
        codes = np.fromiter(map(self.codes.get, words, [-1] * len(words)), np.int32, len(words))
        known = codes >= 0
        edges = np.flatnonzero(np.diff(np.r_[False, known, False]))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= 2
        phrases: list[tuple[str, int, int]] = []
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for low, high in zip(starts[long].tolist(), ends[long].tolist()):
            self._stream(codes[low:high].tolist(), low, phrases, runs)
        return len(words), phrases, self._chain(runs)

    def _stream(self, codes, low, phrases, runs) -> None:
        a, state, run = self.automaton, 0, 0
        for at, word in enumerate(codes, low):
            before = state, run
            state, run = a.step(state, run, word)
            if run <= before[1]:
                self._keep(*before, at, runs)
            for t, n in self.phrases_at[state]:
                if n <= run:
                    phrases.append((self.labels[t], at + 1 - n, at + 1))
        self._keep(state, run, low + len(codes), runs)

    def _keep(self, state: int, run: int, end: int, runs) -> None:
        """Record a maximal run for every template that has it."""
        if run < self.p.least_run:
            return
        for t, at in self.automaton.ends[state]:
            if t < self.phrase_from and at >= run:
                runs[t].append((end - run, at - run, run))

    def _chain(self, runs) -> list[tuple[str, int, int, float]]:
        spans = []
        for t, own in runs.items():
            own.sort()
            size = self.automaton.lengths[t]
            best: list[list[int]] = []  # (words covered, first word, end, end in the template)
            for start, at, n in own:
                entry = [n, start, start + n, at + n]
                for covered, first, end, place in best:
                    over = max(0, end - start, place - at)  # words that both runs have
                    if over < n and -self.p.gap <= end - start and -self.p.gap <= place - at and place < at + n and covered + n - over > entry[0]:
                        entry = [covered + n - over, first, start + n, at + n]
                best = [b for b in best if b[2] + self.p.gap >= start] + [entry]
                spans.append((self.labels[t], entry[1], entry[2], entry[0] / size, size))
        least = lambda size: self.p.short_share if size < self.p.short else self.p.long_share
        return [(label, first, end, min(1.0, share)) for label, first, end, share, size in spans if share >= least(size)]


def scan(docs: DataFrame, p: LicenseParameters = LicenseParameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row of ``docs``.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. Base counts are the places of
    ``PHRASES``; labels has theirs and those of covered templates; score is the largest share of a template
    that is covered (1 for a phrase, 0 for nothing). Null texts are empty. Repeated rows are scanned alike;
    null ids come back null; an empty table gives an empty result; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, end_word: long, share: double>>"
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())]))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(p)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    n, phrases, spans = scanner.scan(text or "")
                    places = [first for _, first, _ in phrases]
                    base = {label for label, _, _ in phrases}
                    every = base | {s[0] for s in spans}
                    best = max([1.0] * bool(base) + [s[3] for s in spans], default=0.0)
                    rows.append((doc, n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(every)), best, [dict(zip(("label", "first_word", "end_word", "share"), s)) for s in spans]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
