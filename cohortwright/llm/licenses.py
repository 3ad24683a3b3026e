"""License scan by a generalised suffix automaton of licence texts.

The automaton holds every substring of the templates' words. A document streams through it and gives, at each word,
the longest template substring that ends there (matching statistics). Matches of at least LEAST words that can't be
lengthened are placed in the templates they come from and chained: words and template positions both advance, with
gaps of at most GAP words. A template whose best chain covers COVERED of its words adds its label. Short phrases are
templates too; each place where one stands is a recognised state of the automaton and adds the phrase's label.

The automaton depends on the templates only (some thousand states). Words that no template has, and pairs of
neighbours that no template has, end every match, so only stretches of known pairs are streamed. The scan is a
narrow pass over the rows: nothing is shuffled, and long texts stream in one row. Words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z. Null and empty texts have no words and score 0; repeated rows
are scanned one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import texts
from .words import PLAIN, Words, chunks, cut

LEAST, GAP, COVERED = 5, 40, 0.5

# Phrases and labels of the base.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public licence texts, or the notices that their authors ask to be put into files.
TEMPLATES = {
    "mit": """
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
    "apache": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "gpl": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License
        along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "bsd": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "mpl": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


@dataclass
class Automaton:
    """Generalised suffix automaton over template words (as numbers), with the end positions of every state."""

    following: list[dict[int, int]]
    link: list[int]
    length: list[int]
    places: list[list[tuple[int, int]]]
    phrases: list[list[int]]
    vocabulary: np.ndarray
    pairs: np.ndarray
    sizes: list[int]
    labels: list[str]
    n_phrases: int

    @staticmethod
    def build(phrases: Mapping[str, str], templates: Mapping[str, str]) -> Automaton:
        sources = [*phrases, *templates.values()]
        words = cut(pa.array(sources), PLAIN, lower=True)
        vocabulary, numbers = np.unique(words.hashes(), return_inverse=True)
        streams = [numbers[a:b].tolist() for a, b in zip(words.offsets[:-1], words.offsets[1:])]
        following, link, length, ends = [{}], [-1], [0], [[]]

        def state(n: int, after: dict[int, int], suffix: int) -> int:
            following.append(dict(after))
            link.append(suffix)
            length.append(n)
            ends.append([])
            return len(length) - 1

        def shorter(p: int, c: int) -> int:
            """The state of the c-extension of p's longest string, split off if its state holds longer ones too."""
            q = following[p][c]
            if length[q] == length[p] + 1:
                return q
            copy = state(length[p] + 1, following[q], link[q])
            link[q] = copy
            while p >= 0 and following[p].get(c) == q:
                following[p][c] = copy
                p = link[p]
            return copy

        for t, stream in enumerate(streams):
            last = 0
            for i, c in enumerate(stream):
                if c in following[last]:
                    last = shorter(last, c)
                else:
                    new, p = state(length[last] + 1, {}, 0), last
                    while p >= 0 and c not in following[p]:
                        following[p][c] = new
                        p = link[p]
                    link[new] = 0 if p < 0 else shorter(p, c)
                    last = new
                ends[last].append((t, i))
        # A state also ends wherever the states of its extensions to the left do.
        for s in sorted(range(1, len(length)), key=lambda x: -length[x]):
            if link[s] > 0:
                ends[link[s]] = sorted({*ends[link[s]], *ends[s]})
        own: dict[int, int] = {}
        for t in range(len(phrases)):
            s = 0
            for c in streams[t]:
                s = following[s][c]
            own[s] = t
        known: list[list[int]] = [[] for _ in length]
        for s in sorted(range(1, len(length)), key=lambda x: length[x]):
            known[s] = known[link[s]] + ([own[s]] if s in own else [])
        pairs = np.unique([a * len(vocabulary) + b for stream in streams for a, b in zip(stream, stream[1:])])
        return Automaton(following, link, length, ends, known, vocabulary, pairs, [len(s) for s in streams], [*phrases.values(), *templates], len(phrases))

    def coded(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if no template has it."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def stretches(self, codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """[first, last) of the maximal stretches whose neighbouring words all stand side by side in some template."""
        if len(codes) < 2:
            return []
        pair = codes[:-1].astype(np.int64) * len(self.vocabulary) + codes[1:]
        linked = (codes[:-1] >= 0) & (codes[1:] >= 0)
        linked[offsets[(offsets > 0) & (offsets < len(codes))] - 1] = False
        hits = np.flatnonzero(linked)
        at = np.minimum(np.searchsorted(self.pairs, pair[hits]), len(self.pairs) - 1)
        linked[hits] = self.pairs[at] == pair[hits]
        edge = np.diff(np.concatenate(([0], linked.astype(np.int8), [0])))
        return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist()))

    def stream(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: (state, length) of the longest template substring that ends at each word."""
        s = n = 0
        for c in codes:
            while s and c not in self.following[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.following[s]:
                s, n = self.following[s][c], n + 1
            yield s, n


def chained(matches: list[tuple[int, int, int]], size: int) -> int:
    """Most template words that a chain of (document start, template start, length) covers."""
    matches = sorted(matches)
    best: list[int] = []
    for i, (d, t, n) in enumerate(matches):
        most = n
        for j in range(i - 1, -1, -1):
            d0, t0, n0 = matches[j]
            gap, skipped = d - (d0 + n0), t - (t0 + n0)
            over = max(0, -gap, -skipped)
            if t > t0 and gap <= GAP and skipped <= GAP and over < n:
                most = max(most, best[j] + n - over)
            if d - d0 > GAP + size:
                break
        best.append(most)
    return min(size, max(best, default=0))


def _scan(words: Words, machine: Automaton) -> list[dict]:
    n = len(words.offsets) - 1
    codes = machine.coded(words.hashes())
    rows = [{"places": [], "labels": set(), "matches": defaultdict(list)} for _ in range(n)]
    for a, b in machine.stretches(codes, words.offsets):
        doc = int(np.searchsorted(words.offsets, a, side="right")) - 1
        row, first = rows[doc], a - int(words.offsets[doc])
        stats = list(machine.stream(codes[a:b].tolist()))
        for i, (s, length) in enumerate(stats):
            for p in machine.phrases[s]:
                if length >= machine.sizes[p]:
                    row["places"].append(first + i - machine.sizes[p] + 1)
                    row["labels"].add(machine.labels[p])
            # The match can't be lengthened: the next word's match doesn't contain it.
            if length >= LEAST and (i + 1 == len(stats) or stats[i + 1][1] <= length):
                for t, end in machine.places[s]:
                    if t >= machine.n_phrases:
                        row["matches"][t].append((first + i - length + 1, end - length + 1, length))
    return rows


def _batches(batches: Iterator[pa.RecordBatch], machine: Automaton) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = cut(part.column("text"), PLAIN, lower=True)
            out = []
            for row in _scan(words, machine):
                cover = {t: chained(m, machine.sizes[t]) / machine.sizes[t] for t, m in row["matches"].items()}
                found = {machine.labels[t] for t, c in cover.items() if c >= COVERED}
                spans = sorted({(d, d + n, machine.labels[t]) for t, m in row["matches"].items() if machine.labels[t] in found for d, _, n in m})
                # A whole phrase is a template covered in full.
                score = max([float(bool(row["places"])), *cover.values()])
                out.append((len(row["places"]), row["places"], ",".join(sorted(row["labels"])), ",".join(sorted(row["labels"] | found)), score, spans))
            count, places, base, labels, score, spans = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(count, pa.int64()), pa.array([min(p, default=None) for p in places], pa.int64()),
                    pa.array([max(p, default=None) for p in places], pa.int64()), pa.array(base), pa.array(labels), pa.array(score, pa.float64()),
                    pa.array([[{"first": a, "last": b, "label": x} for a, b, x in s] for s in spans], _SPANS),
                ],
                names=["doc_id", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))
_SCANNED_SQL = (
    "doc_id bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<first:bigint,last:bigint,label:string>>"
)


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Per document row: doc_id, n_base, first_word, last_word, base_labels, labels, score, spans (words of found templates)."""
    machine = Automaton.build(phrases, templates)
    return texts(docs).mapInArrow(lambda it: _batches(it, machine), _SCANNED_SQL)
