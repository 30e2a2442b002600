"""Licence scans: Dice coefficient of word bigrams against licence templates.

Texts are normalised: A-Z folded, ASCII punctuation dropped, so comment marks and
line ends of any kind don't count. Units of a document are its lines, its
paragraphs (between lines without a word), its whole text, and for each template
all windows of as many words as it has. Only units whose number of bigrams can
reach the threshold against some template are looked at, and of those only the
ones that share enough bigrams with any template are compared. A document is
scanned where it lies: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import PLAIN, Words, pieces, runs, words

THRESHOLD = 0.8

# Public licence notices and texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        'distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
        'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
        "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software "
        "is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are "
        "solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR "
        "ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of "
        "this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for "
        "the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE "
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)


def bigrams(text: str) -> set[int]:
    """Hashes of a normalised text's word bigrams; of one word, the word's."""
    w = words(pa.array([text]), PLAIN)
    return set(runs(w.hash, 2 if len(w.hash) > 1 else 1).tolist())


KINDS = ("line", "paragraph", "text", "window")
STARTS = 2048  # windows compared at once


def _units(w: Words, raw: np.ndarray) -> dict[str, np.ndarray]:
    """The number of each word's unit, by kind; raw is the text before normalising."""
    text = w.text_of
    line = np.searchsorted(np.flatnonzero(raw == 0x0A), w.start)
    new = np.diff(text, prepend=-1) > 0
    return {"line": np.cumsum(new | (np.diff(line, prepend=-1) > 0)), "paragraph": np.cumsum(new | (np.diff(line, prepend=-2) > 1)), "text": text}


def _windows(w: Words, h: np.ndarray, hits: np.ndarray, template: np.ndarray, length: int, threshold: float) -> list[tuple[float, int]]:
    """(dice, first word) of the windows of ``length`` words that reach the
    threshold against a template, of overlapping ones the best. hits[k] is how many
    of the first k bigrams may be in some template."""
    size, text = len(template), w.text_of
    n = len(text) - length + 1
    if n <= 0:
        return []
    need = threshold * size / (2 - threshold)
    start = np.flatnonzero((hits[length - 1 :][:n] - hits[:n] >= need) & (text[:n] == text[length - 1 :]))
    if not len(start):
        return []
    # only the bigrams under these windows are looked at further
    near = np.unique((start[:, None] + np.arange(0, length - 1, max(length // 2, 1))).ravel() // length)
    place = np.unique(np.clip((near[:, None] * length + np.arange(-length, 2 * length)).ravel(), 0, len(h) - 1))
    mine = np.zeros(len(h), bool)
    mine[place] = np.isin(h[place], template)
    total = np.concatenate([[0], np.cumsum(mine)])
    start = start[total[start + length - 1] - total[start] >= need]
    order = place[np.lexsort((place, h[place]))]
    before = np.full(len(h), -1)  # where each bigram stood last
    same = h[order[1:]] == h[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    found = []
    for k in range(0, len(start), STARTS):
        at = start[k : k + STARTS, None] + np.arange(length - 1)
        new = before[at] < start[k : k + STARTS, None]
        dice = 2 * (new & mine[at]).sum(1) / (new.sum(1) + size)
        found += [(float(x), int(p)) for x, p in zip(dice, start[k : k + STARTS], strict=True) if x >= threshold]
    found.sort(key=lambda f: f[1])
    best, end = [], -1
    for dice, p in found:
        if p >= end:
            best.append((dice, p))
        elif dice > best[-1][0]:
            best[-1] = (dice, p)
        end = p + length
    return best


def _places(found: list[tuple]) -> list[tuple]:
    """Of (dice, begin, end, kind, name, template's size) those that lie under no
    better one: higher Dice, then the larger template, then the earlier and shorter."""
    kept: list[tuple] = []
    for x in sorted(found, key=lambda f: (-f[0], -f[5], f[1], f[2] - f[1], f[3], f[4])):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
            kept.append(x)
    return kept


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, id_col: str = "doc_id") -> DataFrame:
    """One row for each document and licence that some unit reaches: doc_id,
    license, unit (line, paragraph, text or window: the kind of the best unit), dice
    of the best, n_units.

    Of units that overlap only the best counts, whatever their licences, so a text
    is not also taken for a licence that it contains most of; n_units counts what is
    left. A null or empty text has none; a very long one is scanned whole. Ids may
    be null or repeat, rows are judged one by one, and repeated rows give repeated
    results. Other columns are ignored.
    """
    known = [(name, np.array(sorted(bigrams(text)), np.uint64), len(words(pa.array([text]), PLAIN).start)) for name, text in templates]
    known = [x for x in known if len(x[1])]
    sets = [set(b.tolist()) for _, b, _ in known]
    sizes = np.array([len(b) for b in sets])
    lowest, highest = sizes * threshold / (2 - threshold), sizes * (2 - threshold) / threshold
    every = np.array(sorted(set().union(*sets)), np.uint64)
    sieve = np.zeros(1 << 20, bool)
    sieve[(every >> np.uint64(44)).astype(np.int64)] = True

    def judge(own: set[int]) -> list[tuple[float, int]]:
        n = len(own)
        fits = np.flatnonzero((lowest <= n) & (n <= highest))
        dice = [(2 * len(own & sets[k]) / (n + sizes[k]), int(k)) for k in fits]
        return [x for x in dice if x[0] >= threshold]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield from look(piece)

    def look(piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w = words(piece.column(1), PLAIN)
        if not len(w.start):
            return
        raw = words(piece.column(1), np.arange(256, dtype=np.uint8)).data
        h = np.concatenate([runs(w.hash, 2), np.zeros(1, np.uint64)])
        text = w.text_of
        in_text = np.append(text[1:] == text[:-1], False)
        maybe = in_text & sieve[(h >> np.uint64(44)).astype(np.int64)]
        hits_before = np.concatenate([[0], np.cumsum(maybe)])
        found: dict[int, list[tuple]] = {}
        for kind, unit in _units(w, raw).items():
            begin = np.flatnonzero(np.diff(unit, prepend=unit[0] - 1) != 0)
            count = np.diff(np.append(begin, len(unit)))
            hits = hits_before[begin + count - 1] - hits_before[begin]
            # repeated bigrams only lower a unit's set size, so the lower size bound uses the words there are
            able = (count - 1 >= lowest.min()) & (2 * hits >= threshold * lowest.min()) | (count == 1) & (lowest.min() <= 1)
            for k in np.flatnonzero(able):
                a, b = int(begin[k]), int(begin[k] + count[k])
                own = set(h[a : b - 1].tolist()) if b - a > 1 else set(runs(w.hash[a:b], 1).tolist())
                if len(own) <= highest.max():
                    found.setdefault(int(text[a]), []).extend((x, a, b, KINDS.index(kind), known[t][0], int(sizes[t])) for x, t in judge(own))
        for t, (name, template, length) in enumerate(known):
            for x, p in _windows(w, h, hits_before, template, length, threshold) if length > 1 else ():
                found.setdefault(int(text[p]), []).append((x, p, p + length, KINDS.index("window"), name, int(sizes[t])))
        best: dict[tuple[int, str], list] = {}
        for row, units in found.items():
            for x, _, _, kind, name, _ in _places(units):  # best first
                best.setdefault((row, name), [KINDS[kind], x, 0])[2] += 1
        keys = sorted(best)
        ids = piece.column(0).take(pa.array([k[0] for k in keys], pa.int64()))
        yield pa.record_batch(
            [ids, pa.array([k[1] for k in keys], pa.string()), *(pa.array([best[k][j] for k in keys], t) for j, t in enumerate((pa.string(), pa.float64(), pa.int64())))],
            names=[id_col, "license", "unit", "dice", "n_units"],
        )

    source = docs.select(id_col, "text")
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(scan, f"{id_col} {kind}, license string, unit string, dice double, n_units long")


def op2(documents: DataFrame) -> DataFrame:
    return scan_licenses(documents)
