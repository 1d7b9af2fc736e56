"""License notices found by MinHash bands over overlapping windows (operator 4).

Templates are sorted into classes by their number of shingles: class c holds those of over c / 2 and up
to c shingles. For each class texts are cut into windows of 2c shingles, c apart, so that every
occurrence of a template lies within a window and makes up at least ``least_similarity`` of it. A band
is one MinHash value; a class has as many bands as it takes to miss such a window with a probability
below MISS. Texts of retrieved windows are verified by the exact share of
the template's shingles in each occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import kernels

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
MISS = 1e-7
#: Shingles of windows whose MinHash values are worked out at once.
MOST_AT_ONCE = 1 << 18

# Public notices and license texts, by license (SPDX names).
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_FREE_SOFTWARE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-ND-4.0": "Attribution-NoDerivatives", "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike"}
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version",
        _FREE_SOFTWARE.format("General Public License", 3),
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
        "of the License, or (at your option) any later version",
        _FREE_SOFTWARE.format("General Public License", 2),
    ],
    "LGPL-3.0": [_FREE_SOFTWARE.format("Lesser General Public License", 3), "This work is licensed under the GNU Lesser General Public License, version 3"],
    "LGPL-2.1": [_FREE_SOFTWARE.format("Lesser General Public License", "2.1"), "This work is licensed under the GNU Lesser General Public License, version 2.1"],
    "AGPL-3.0": [_FREE_SOFTWARE.format("Affero General Public License", 3), "This work is licensed under the GNU Affero General Public License, version 3"],
    "BSD-2-Clause": [_BSD_TERMS + " " + _BSD_WARRANTY],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        _BSD_TERMS + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission. " + _BSD_WARRANTY,
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0",
    ],
    "CDDL-1.0": [
        'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this '
        "file except in compliance with the License.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY,
    ],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        "Distributed under the Boost Software License, Version 1.0",
    ],
    "Artistic-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0"],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    **{
        name: [f"Licensed under {name.rpartition('-')[0].replace('CC-', 'CC ')} 4.0", f"This work is licensed under a Creative Commons {words} 4.0 International License"]
        for name, words in _CC.items()
    },
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _permuted(shingles: np.ndarray, seed: int) -> np.ndarray:
    one, two = np.random.SeedSequence(seed).generate_state(2, np.uint64)
    x = (shingles ^ one) * (two | np.uint64(1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x


def _shingles(words: kernels.Words, k: int) -> np.ndarray:
    return kernels.windows(words.hashes(), k)


def bands(least_similarity: float) -> int:
    """Bands of one value that miss a window of the similarity with a probability of at most MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - least_similarity))


class Templates:
    """The templates' shingles, classes and MinHash values."""

    def __init__(self, templates: dict[str, list[str]], k: int):
        self.k = k
        self.names, self.sets = [], []
        for name, texts in templates.items():
            for text in texts:
                s = np.unique(_shingles(kernels.Words([text], lower=True, gap=_GAP), k))
                if not len(s):
                    raise ValueError(f"a template of {name} has fewer than {k} words")
                self.names.append(name)
                self.sets.append(s)
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            self.classes.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        self.bands = {c: bands(min(len(self.sets[i]) for i in members) * CONTAINMENT / (2 * c)) for c, members in self.classes.items()}
        self.all = np.unique(np.concatenate(self.sets))
        # The bands' tables: of each class and band the MinHash values of its templates, sorted, and whose they are.
        self.tables = {}
        for c, members in self.classes.items():
            for j in range(self.bands[c]):
                values = np.array([_permuted(self.sets[i], j).min() for i in members])
                order = np.argsort(values, kind="stable")
                self.tables[c, j] = (values[order], np.array(members)[order])

    def candidates(self, shingles: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, from, to): windows of shingles that share a band with a template, by look-up of the
        windows' MinHash values in the bands' tables. Windows without any shingle of a template can't
        share a value with one, and get none."""
        found: set[tuple[int, int, int]] = set()
        at = np.flatnonzero(_among(shingles, self.all))
        for c in self.classes:
            blocks = np.unique(at // c)
            starts = np.unique(np.concatenate((blocks, blocks[blocks > 0] - 1))) * c
            for part in range(0, len(starts), max(1, MOST_AT_ONCE // (2 * c))):
                first = starts[part : part + max(1, MOST_AT_ONCE // (2 * c))]
                # A window that ends with the texts has its last shingle repeated, which changes no minimum.
                windows = shingles[np.minimum(first[:, None] + np.arange(2 * c), len(shingles) - 1)]
                for j in range(self.bands[c]):
                    values, members = self.tables[c, j]
                    least = _permuted(windows, j).min(1)
                    low, high = np.searchsorted(values, least), np.searchsorted(values, least, "right")
                    for w in np.flatnonzero(high > low).tolist():
                        for i in members[low[w] : high[w]].tolist():
                            found.add((i, int(first[w]), min(len(shingles), int(first[w]) + 2 * c)))
        return found


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _meeting(words: kernels.Words, candidates: set[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """(text, template): the texts that candidate windows touch."""
    out = set()
    for i, a, b in candidates:
        first, last = np.searchsorted(words.first, (a, b - 1), "right") - 1
        out.update((t, i) for t in range(int(first), int(last) + 1))
    return out


def _scan(templates: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, _, texts in kernels.parts(batch, 1):
                words = kernels.Words(texts, lower=True, gap=_GAP)
                shingles = _shingles(words, templates.k)
                rows: dict[tuple[int, int, int], tuple] = {}
                for t, i in _meeting(words, templates.candidates(shingles)) if len(shingles) else ():
                    own = templates.sets[i]
                    base = int(words.first[t])
                    hits = np.flatnonzero(_among(shingles[base : max(base, int(words.first[t + 1]) - templates.k + 1)], own))
                    # Occurrences: runs of hits with no gap longer than the template.
                    for part in np.split(hits, np.flatnonzero(np.diff(hits) > len(own)) + 1):
                        share = len(np.unique(shingles[base + part])) / len(own)
                        if share >= CONTAINMENT:
                            rows[t, i, int(part[0])] = (int(part[0]), int(part[-1]) + templates.k, share)
                order = sorted(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([start + t for t, _, _ in order], pa.int64())),
                        pa.array([templates.names[i] for _, i, _ in order], pa.string()),
                        pa.array([i for _, i, _ in order], pa.int32()),
                        pa.array([rows[x][0] for x in order], pa.int64()),
                        pa.array([rows[x][1] for x in order], pa.int64()),
                        pa.array([rows[x][2] for x in order], pa.float64()),
                    ],
                    ["doc_id", "license", "template", "first_word", "end_word", "containment"],
                )

    return run


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, license, template, first_word, end_word, containment): a row for each notice found.

    Words are runs of letters and digits, A-Z lower-cased; first_word and end_word border the notice in
    them. containment: the share of the template's shingles that is there, at least CONTAINMENT. A notice
    that ties or overlaps with another, or is part of one, has its own row. Null, empty and short texts
    have no row; a text of any length is scanned whole; repeated rows have theirs each. Ids of any type;
    other columns are not read. The templates are a table of bounded size that tasks carry along; a window
    of the wanted similarity is missed with a probability of at most MISS.
    """
    known = Templates(templates or TEMPLATES, SHINGLE_WORDS)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(known), f"doc_id {kind}, license string, template int, first_word long, end_word long, containment double")
