"""License scans: winnowed template fingerprints, then banded alignment.

Texts and templates are sequences of lower-case alphanumeric words.  Of a template's hashes of
``gram`` words, winnowing keeps the smallest of every ``window`` neighbours; they form an inverted index from
hash to (template, place).  A document's hashes that are in the index vote for (template, diagonal); a vote
that no earlier alignment of the template explains is a candidate, which a sequence alignment through the vote's place, within
``band`` words of its diagonal, scores.  A match reports the template, the part of its words that are aligned to equal ones, and
the span of the text they cover, in code points.  In templates of fewer than ``EXACT`` words none may be put in or left out, and lines and notices
of licences that differ in a name or a number must hold theirs (``TELLING``).  Of templates that match nearly the same span, such as two versions of one
licence, the best covered is reported.

The templates are a parameter; the index is as large as they are and travels with the tasks.

Edge cases: null and empty texts have no match; very long texts are scanned whole; templates shorter than ``gram`` words are
matched as whole sequences; overlapping matches of one template are reported once, by the best coverage, the first of equals;
repeated notices are reported each, however near; repeated rows are reported each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import small_batches, text_batches

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
)
_BSD_BINARY = (
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(what: str, licence: str, version: str) -> str:
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {licence} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        f"PARTICULAR PURPOSE. See the GNU {licence} for more details."
    )


#: Public wordings of licences and licence notices, by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": _gnu("program", "General Public License", "2"),
    "GPL-3.0-notice": _gnu("program", "General Public License", "3"),
    "LGPL-2.1-notice": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0-notice": _gnu("library", "Lesser General Public License", "3"),
    "AGPL-3.0-notice": _gnu("program", "Affero General Public License", "3"),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-notice": _MIT,
    "MIT-text": _MIT
    + (
        ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-part": _BSD,
    "BSD-2-Clause-text": _BSD + _BSD_BINARY + _BSD_WARRANTY,
    "BSD-3-Clause-text": _BSD + _BSD_BINARY + _BSD_NAMES + _BSD_WARRANTY,
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "Unlicense-part": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means."
    ),
    "Zlib-part": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "reserved": "All rights reserved.",
}
GRAM, WINDOW, BAND, COVERAGE = 3, 4, 8, 0.8
#: In templates of fewer words, words may be changed, but none put in or left out.
EXACT = 15
#: Words in a row that a match must hold, as they tell a licence from its neighbours.
TELLING = {
    "Apache-2.0": ("apache license version 2 0",),
    "GPL-3.0": ("gnu general public license version 3",),
    "MIT": ("mit license",),
    "CC-BY-NC-4.0": ("cc by nc 4 0",),
    "CC-BY-SA-4.0": ("cc by sa 4 0",),
    "CC-BY-4.0": ("cc by 4 0",),
    "CC0-1.0": ("cc0 1 0",),
    "Apache-2.0-notice": ("apache license", "version 2 0"),
    "GPL-2.0-notice": ("gnu general public license", "version 2 of the license"),
    "GPL-3.0-notice": ("gnu general public license", "version 3 of the license"),
    "LGPL-2.1-notice": ("gnu lesser general public license", "version 2 1 of the license"),
    "LGPL-3.0-notice": ("gnu lesser general public license", "version 3 of the license"),
    "AGPL-3.0-notice": ("gnu affero general public license", "version 3 of the license"),
    "MPL-2.0-notice": ("mozilla public license", "2 0"),
    "Unlicense-part": ("public domain",),
}
TOKEN = re.compile(r"[^\W_]+")


#: Spans that overlap each other by this part are nearly the same.
SAME = 0.9


def words_of(text: str) -> list[str]:
    # word by word: lower-casing a text can change the number of its words
    return [w.lower() for w in TOKEN.findall(text)]


def align_from(a: np.ndarray, b: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Pairs of places of equal words on a best alignment of all of a with a beginning of b.

    Needleman-Wunsch from the first words of both, a match worth 2, a mismatch or gap -1, over the diagonals up to ``band``.
    """
    n, m, w = len(a), len(b), 2 * band + 1
    low = -(10**6)
    steps = np.arange(w)
    score = np.full((n + 1, w), low)
    score[0, band:] = -np.arange(band + 1)  # words of b before the first of a
    score[0, band + m + 1 :] = low
    equal = np.zeros((n + 1, w), bool)
    padded = np.concatenate([np.full(band + 1, -2), b, np.full(n + band + 1, -2)])  # -2: no word
    for i in range(1, n + 1):
        column = i - band + steps  # words of b used so far
        equal[i] = padded[band + i - band + steps] == a[i - 1]
        fits = (column >= 0) & (column <= m)
        step = np.where((column >= 1) & fits, score[i - 1] + np.where(equal[i], 2, -1), low)
        skip = np.append(score[i - 1, 1:], low) - 1
        best = np.where(fits, np.maximum(step, skip), low)
        # words of b left out: from the best cell to the left, one off for each
        score[i] = np.where(fits, np.maximum.accumulate(best + steps) - steps, low)
    i = int(np.flatnonzero(score.max(axis=1) > low // 2)[-1])  # where b ends early, the rest of a is aligned to nothing
    d, pairs = int(score[i].argmax()), []
    while i > 0:
        if i - band + d >= 1 and score[i, d] == score[i - 1, d] + (2 if equal[i, d] else -1):
            if equal[i, d]:
                pairs.append((i - 1, i - 1 - band + d))
            i -= 1
        elif d + 1 < w and score[i, d] == score[i - 1, d + 1] - 1:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return pairs[::-1]


def align_through(a: np.ndarray, b: np.ndarray, at: int, place: int, gram: int, band: int) -> list[tuple[int, int]]:
    """Pairs of places of equal words on a best alignment of a with a part of b, in which a's ``gram`` words from ``place`` lie at ``at``."""
    right = align_from(a[place + gram :], b[at + gram : at + len(a) - place + band], band)
    left = align_from(a[:place][::-1], b[max(0, at - place - band) : at][::-1], band)
    pairs = [(place - 1 - i, at - 1 - j) for i, j in reversed(left)]
    pairs += [(place + k, at + k) for k in range(gram)]
    return pairs + [(place + gram + i, at + gram + j) for i, j in right]


class Scanner:
    def __init__(self, templates: dict[str, str], gram: int, window: int, band: int, coverage: float) -> None:
        self.gram, self.band, self.coverage = gram, band, coverage
        self.names, self.vocabulary = list(templates), {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t)], np.int64) for t in templates.values()]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, seq in enumerate(self.words):
            k = min(gram, len(seq))
            if not k:
                continue
            hashes = [self.hash(seq[i : i + k]) for i in range(len(seq) - k + 1)]
            span = min(window, len(hashes))
            for at in {min(range(i, i + span), key=lambda x: (hashes[x], x)) for i in range(len(hashes) - span + 1)}:
                self.index.setdefault(hashes[at], []).append((t, at))
        self.lengths = sorted({min(gram, len(s)) for s in self.words if len(s)})
        self.telling = [[np.array([self.vocabulary.get(w, -2) for w in p.split()], np.int64) for p in TELLING.get(name, ())] for name in self.names]

    def tells(self, t: int, part: np.ndarray) -> bool:
        """Whether a part of a text, as word numbers, holds all phrases that tell template ``t``."""
        for phrase in self.telling[t]:
            k = len(phrase)
            if len(part) < k or not (np.lib.stride_tricks.sliding_window_view(part, k) == phrase).all(axis=1).any():
                return False
        return True

    @staticmethod
    def hash(ids) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(" ".join(map(str, ids)), 3)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) of a text's matches, by start."""
        if not text:
            return []
        where = [m.span() for m in TOKEN.finditer(text)]
        ids = np.array([self.vocabulary.get(text[a:b].lower(), -1) for a, b in where], np.int64)
        votes: dict[int, list[tuple[int, int, int]]] = {}
        for k in self.lengths:
            if len(ids) < k:
                continue
            inside = ids >= 0
            full = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(inside, k).all(axis=1))
            for at in full.tolist():
                for t, place in self.index.get(self.hash(ids[at : at + k]), ()):
                    votes.setdefault(t, []).append((at, place, k))
        if not votes:
            return []
        found = []
        for t, seen in votes.items():
            seq, explained = self.words[t], set()
            own = np.bincount(seq, minlength=len(self.vocabulary) + 1)
            for at, place, k in seen:
                if (place, at) in explained:
                    continue
                # no alignment covers more of the template than has a like word in reach
                reach = ids[max(0, at - place - self.band) : at - place + len(seq) + self.band]
                if np.minimum(own, np.bincount(reach + 1, minlength=len(own) + 1)[1:]).sum() < self.coverage * len(seq):
                    continue
                pairs = align_through(seq, ids, at, place, k, self.band)
                explained.update(pairs)
                share = len(pairs) / len(seq)
                spread = pairs[-1][1] - pairs[0][1] + 1
                if share >= self.coverage and (len(seq) >= EXACT or spread == pairs[-1][0] - pairs[0][0] + 1) and self.tells(t, ids[pairs[0][1] : pairs[-1][1] + 1]):
                    fit = len(pairs) / max(len(seq), pairs[-1][1] - pairs[0][1] + 1)
                    found.append((self.names[t], share, where[pairs[0][1]][0], where[pairs[-1][1]][1], fit))
        return self.select(found)

    @staticmethod
    def select(found: list[tuple[str, float, int, int, float]]) -> list[tuple[str, float, int, int]]:
        """Of overlapping matches of one template the best covered, of nearly the same spans of several the best fit.

        A match's fit is its aligned words' part of the template or of its span, whichever is longer.
        """
        ends: dict[str, list[tuple[int, int]]] = {}  # spans kept, by start, none overlapping
        best = []
        for m in sorted(set(found), key=lambda x: (-x[1], -x[4], x[2], x[0], x[3])):
            kept, span = ends.setdefault(m[0], []), m[2:4]
            k = bisect_left(kept, span)
            if (k and kept[k - 1][1] > span[0]) or (k < len(kept) and kept[k][0] < span[1]):
                continue
            kept.insert(k, span)
            best.append(m)
        best.sort(key=lambda x: (x[2], x[3], x[0]))
        dropped = set()
        for k, m in enumerate(best):
            for x in best[k + 1 :]:
                if x[2] > m[2] + (1 - SAME) * (m[3] - m[2]):
                    break  # no later one covers enough of this span
                if min(m[3], x[3]) - x[2] >= SAME * max(m[3] - m[2], x[3] - x[2]) and x[4] != m[4]:
                    dropped.add(min(m, x, key=lambda y: y[4]))
        return [x[:4] for x in best if x not in dropped]


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, *, gram: int = GRAM, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE
) -> DataFrame:
    """(doc_id, license, coverage, start, end), one row per match."""
    small_batches(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, gram, window, band, coverage)
        for batch in text_batches(batches):
            rows = [(i, *m) for i, t in enumerate(batch.column("text").to_pylist()) for m in scanner.scan(t)]
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                names=["doc_id", "license", "coverage", "start", "end"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, license string, coverage double, start long, `end` long"
    )
