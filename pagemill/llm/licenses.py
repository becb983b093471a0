"""License scans by patience alignment of texts with templates."""

from __future__ import annotations

import bisect
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches
from .words import slices, word_hashes

COVERAGE = 0.9  # share of a template's words that must be aligned

# The notices looked for, as their licenses word them, and short forms.
TEMPLATES = {
    "AGPL-3.0": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for
        more details.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    ],
    "BSD-3-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""",
    ],
    "BSL-1.0": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
        is furnished to do so, all subject to the following:""",
    ],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Licensed under CC0 1.0 Universal.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-2.0": [
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ],
    "LGPL-2.1": [
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for
        more details.""",
    ],
    "LGPL-3.0": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for
        more details.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    ],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions:""",
    ],
}
TAG = "SPDX-License-Identifier: "  # with its name, a form of each license; GNU ones say which versions
for _name in TEMPLATES:
    TEMPLATES[_name] += [TAG + _name, *([f"{TAG}{_name}-only", f"{TAG}{_name}-or-later"] if "GPL" in _name else [])]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second also rises, by patience sorting."""
    tops, piles, back = [], [], []
    for n, (_, y) in enumerate(pairs):
        p = bisect.bisect_left(tops, y)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(y)
            piles.append(n)
        else:
            tops[p], piles[p] = y, n
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words in a and b, rising in both. Equal heads and tails pair up first; then
    the longest rising run of words that occur once in each anchors the rest, and the gaps between
    anchors are aligned alike. A gap without such words pairs up no more."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once: dict = {}
        for x in range(i, j):
            once[a[x]] = -1 if a[x] in once else x
        twin: dict = {}
        for y in range(k, m):
            twin[b[y]] = -1 if b[y] in twin else y
        anchors = _rising(sorted((x, twin[w]) for w, x in once.items() if x >= 0 and twin.get(w, -1) >= 0))
        out += anchors
        if anchors:
            edges = [(i - 1, k - 1), *anchors, (j, m)]
            todo += [(p + 1, x, q + 1, y) for (p, q), (x, y) in zip(edges, edges[1:])]
    return sorted(out)


def _held(place: np.ndarray, word: np.ndarray, most: np.ndarray, text_start: np.ndarray, size: int) -> np.ndarray:
    """For each of some rising places, how many words of ``place`` the stretch of ``size`` words from there holds, each word up to its
    ``most`` and inside one text. A word counts for the stretches that begin behind the word ``most`` times before it."""
    order = np.argsort(word, kind="stable")
    rank = np.arange(len(order)) - np.searchsorted(word[order], word[order])  # among those of the same word
    earlier = np.full(len(order), -1)
    some = rank >= most[order]
    earlier[some] = place[order][np.flatnonzero(some) - most[order][some]]
    before = np.empty(len(order), np.int64)
    before[order] = earlier
    low = np.maximum(np.maximum(before + 1, place - size + 1), text_start)
    steps = np.zeros(len(place) + 1, np.int64)
    np.add.at(steps, np.searchsorted(place, low), 1)
    steps[1:] -= 1
    return np.cumsum(steps)[:-1]


class _Scanner:
    def __init__(self, templates: dict[str, list[str]], coverage: float):
        self.coverage, self.texts = coverage, []
        for name, forms in sorted(templates.items()):
            for form in forms:
                raw = np.frombuffer(form.encode(), np.uint8)
                words, _ = word_hashes(raw, np.array([0, len(raw)]), "alnum")
                if len(words):
                    self.texts.append((name, words.tolist()))
        self.known = np.unique(np.array([w for _, t in self.texts for w in t], np.uint64))
        # how often each template has each word
        self.holds = np.zeros((len(self.texts), len(self.known) + 1), np.int32)
        for k, (_, t) in enumerate(self.texts):
            np.add.at(self.holds[k], np.searchsorted(self.known, np.array(t, np.uint64)), 1)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known >> np.uint64(44)] = True

    def scan(self, hashes: np.ndarray, starts: np.ndarray):
        """(text, template, words aligned, first word, end) of each notice."""
        which = np.full(len(hashes), len(self.known))
        some = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.known, hashes[some]), len(self.known) - 1)
        same = self.known[at] == hashes[some]
        which[some[same]] = at[same]
        some = some[same]  # words of any template, by rising place
        text = np.searchsorted(starts, some, "right")
        text_start, text_end = (starts[text - 1], starts[text]) if len(some) else (some, some)
        for k, (_, template) in enumerate(self.texts):
            # no notice without a stretch of twice the template's words that holds enough of its words
            need = int(np.ceil(self.coverage * len(template) - 1e-9))
            most = self.holds[k][which[some]]
            mine = most > 0
            place, end = some[mine], text_end[mine]
            if len(place) < need:
                continue
            held = _held(place, which[place], most[mine], text_start[mine], 2 * len(template))
            region = None
            for p in np.flatnonzero(held >= need).tolist():
                span = (int(place[p]), int(end[p]))
                if region and span[0] < region[1]:
                    continue  # inside the notice just found
                # the shorter stretch is for a notice that a like one follows
                for size in (2 * len(template), len(template) + len(template) // 4):
                    pairs = patience(hashes[span[0] : min(span[0] + size, span[1])].tolist(), template)
                    if pairs and pairs[0][0] == 0 and len(pairs) >= need:
                        region = (span[0], span[0] + pairs[-1][0] + 1)
                        yield int(np.searchsorted(starts, span[0], "right")) - 1, k, len(pairs), *region
                        break


@lru_cache(2)
def _scanner(templates: tuple, coverage: float) -> _Scanner:
    return _Scanner({name: list(forms) for name, forms in templates}, coverage)


FOUND = "array<struct<license: string, coverage: double, words: long, start: long, stop: long>>"


def scan_licenses(docs: DataFrame, coverage: float = COVERAGE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Adds licenses, the notices found in each whole text, to all columns of docs. ``templates`` has the forms of
    notice of each license; the given ones are notices and short forms, not whole license texts.

    Words are runs of letters, digits and non-ASCII characters, A-Z folded. Where a stretch of twice a
    template's length holds enough of its words, each counted no more often than the template has it, the stretch is aligned with it by patience; a notice is
    found where at least ``coverage`` of the template's words are aligned. Of notices that overlap, the one of more
    bytes stays, then of more aligned words, then of the lesser name. start and stop are bytes of the UTF-8 text. Null, empty
    and wordless texts: none. Repeated notices and rows repeat. Empty table: no rows. A column of
    docs named licenses is replaced."""

    forms = tuple(sorted((name, tuple(x)) for name, x in templates.items()))

    def run(batches):
        scanner = _scanner(forms, coverage)
        for batch in batches:
            out = []
            for i, j, data, at in slices(batch.column("text")):
                hashes, starts, first, stop = word_hashes(data, at, "alnum", spots=True)
                own: list[list] = [[] for _ in range(j - i)]
                for d, k, n, a, b in scanner.scan(hashes, starts):
                    own[d].append({"license": scanner.texts[k][0], "coverage": n / len(scanner.texts[k][1]), "words": n, "start": int(first[a] - at[d]), "stop": int(stop[b - 1] - at[d])})
                for found in own:
                    kept: list = []
                    for x in sorted(found, key=lambda x: (x["start"] - x["stop"], -x["words"], -x["coverage"], x["license"], x["start"])):
                        if all(x["stop"] <= y["start"] or y["stop"] <= x["start"] for y in kept):
                            kept.append(x)
                    out.append(sorted(kept, key=lambda x: x["start"]))
            cols = {"licenses": pa.array(out, batch.schema.field("licenses").type)}
            yield pa.RecordBatch.from_arrays([cols.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return map_batches(docs, run, {"licenses": F.array().cast(FOUND)})
