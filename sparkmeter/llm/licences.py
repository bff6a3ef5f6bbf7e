"""Licence texts and notices in documents, by the Dice coefficient over word bigrams.

A document is read as a whole, line by line and by passages, each unit against all templates whose size allows the
wanted coefficient: with Dice d, a unit of n bigrams can only match templates of n d / (2 - d) to n (2 - d) / d bigrams.
A passage is any run of words between two breaks; lines and sentences end at breaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_cache import PieceCache
from .words import chunks

DICE = 0.8
#: Templates are held by every task; their number and text are bounded.
MOST_TEMPLATES, MOST_BYTES = 5_000, 32 << 20

_GNU = [("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
        ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3")]
# Wordings of public licences and of the notices that name them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("All-Rights-Reserved", "All rights reserved."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/."""),
    ("EPL-1.0", """All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse
Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"""),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
http://www.boost.org/LICENSE_1_0.txt)"""),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    *((name, f"This work is licensed under the {of}, version {number}.") for name, of, number in _GNU),
    *((name, f"Licensed under the {of}, version {number} or later.") for name, of, number in _GNU),
    *((name, f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the {of} as published by
the Free Software Foundation, either version {number} of the License, or (at your option) any later version.""") for name, of, number in _GNU for thing in ("program", "library")),
    *((name, f"""This {thing} is free software; you can redistribute it and/or modify it under the terms of the {of} version {number} as
published by the Free Software Foundation.""") for name, of, number in _GNU for thing in ("program", "library")),
]
# Full texts, one file each named by its licence; the README says which licences are covered.
TEMPLATES += sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt"))

_COPYRIGHT = re.compile(r"^\W*(?:copyright|\(c\)|©)[^\n]*\d{4}[^\n]*$", re.I | re.M)
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_BREAK = re.compile(r"[\n.;:!?]")


def normalised(text: str | None) -> list[str]:
    """Lower-case words; copyright lines with a year, punctuation and comment marks go, and "licence" is "license"."""
    return _WORD.findall(_COPYRIGHT.sub(" ", text or "").lower().replace("licence", "license"))


def passages(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of `normalised`, the line of each, and the word numbers at which a passage may begin or end."""
    some, line, breaks, end = [], [], [0], 0
    number = 0
    for row in _COPYRIGHT.sub(lambda m: "\n" * m.group().count("\n") + " ", text).lower().replace("licence", "license").split("\n"):
        if some and breaks[-1] != len(some):
            breaks.append(len(some))
        end = 0
        for m in _WORD.finditer(row):
            if breaks[-1] != len(some) and _BREAK.search(row, end, m.start()):
                breaks.append(len(some))
            end = m.end()
            some.append(m.group())
            line.append(number)
        number += 1
    return some, line, breaks if breaks[-1] == len(some) else [*breaks, len(some)]


def bigrams(some: list[str]) -> set[tuple[str, str]]:
    """Pairs of words in a row; a single word is paired with nothing."""
    return set(zip(some, some[1:])) if len(some) > 1 else {(w, "") for w in some}


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    """Templates by size and by bigram. `best` is exact: every template within the size bounds that shares a bigram is compared."""

    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.least = least
        self.names = [n for n, _ in templates]
        self.sets = [bigrams(normalised(t)) for _, t in templates]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, s in enumerate(self.sets):
            for g in s:
                self.holders.setdefault(g, []).append(i)
        self.known = frozenset(self.holders)
        self.longest = max(map(len, self.sets), default=0) * (2 - least) / least

    def best(self, unit: str) -> tuple[int, float] | None:
        """(template, coefficient) of the best match; of equal ones the first template."""
        mine = bigrams(normalised(unit))
        return self._best(mine, self._shared(mine))

    def _shared(self, mine: set) -> dict[int, int]:
        """Number of bigrams shared with each template that shares any."""
        have: dict[int, int] = {}
        for g in self.known & mine:
            for i in self.holders[g]:
                have[i] = have.get(i, 0) + 1
        return have

    def _best(self, mine: set, have: dict[int, int]) -> tuple[int, float] | None:
        if not mine or len(mine) > self.longest:
            return None
        low, high = len(mine) * self.least / (2 - self.least) - 1e-9, len(mine) * (2 - self.least) / self.least + 1e-9
        found = max(((2 * n / (len(mine) + len(self.sets[i])), -i) for i, n in have.items() if low <= len(self.sets[i]) <= high), default=None)
        return (-found[1], found[0]) if found and found[0] >= self.least - 1e-12 else None

    def whole_and_passages(self, text: str, lines: dict[int, tuple[int, float]]) -> tuple[tuple[int, float] | None, list[tuple[int, int, int, float]]]:
        """The match of the whole text, and (first line, last line, template, coefficient) of passages beside `lines` (matches by line).

        Templates are searched where the text holds as many of their bigrams as any match needs. Of passages over the
        same words the best is told, and none that a line or the whole text tells as well: see `_told_already`.
        """
        mine = bigrams(normalised(text))
        have = self._shared(mine)
        whole = self._best(mine, have)
        wanted = sorted(i for i, n in have.items() if n >= len(self.sets[i]) * self.least / (2 - self.least) - 1e-9)
        if not wanted:
            return whole, []
        some, line, breaks = passages(text)
        pairs = list(zip(some, some[1:])) if len(some) > 1 else [(w, "") for w in some]
        ids: dict[tuple[str, str], int] = {}
        seq = [ids.setdefault(g, len(ids)) for g in pairs]
        told = [(0, len(some), *whole, False)] if whole else []
        at = np.searchsorted(line, np.arange(line[-1] + 2))
        told += [(int(at[k]), int(at[k + 1]), *hit, True) for k, hit in lines.items()]
        found = sorted((-v, i, s, e) for i in wanted for v, s, e in self._windows(i, ids, seq, np.array(breaks)))
        out = []
        for v, i, s, e in found:
            grams = self.sets[i].intersection(pairs[s : max(e - 1, s + 1)])
            if not any(self._told_already(s, e, i, -v, grams, *x) for x in told):
                told.append((s, e, i, -v, True))
                out.append((line[s], line[e - 1], i, -v))
        return whole, out

    def _told_already(self, s: int, e: int, i: int, v: float, grams: set, s2: int, e2: int, i2: int, v2: float, inside: bool) -> bool:
        """Is the passage s to e inside a told line or passage, or does what is told share words with it and name the same
        licence on half as many words or more, or match as well with a template that holds most of the bigrams it matches by?"""
        both = min(e, e2) - max(s, s2)
        if both <= 0:
            return False
        if (inside and both == e - s) or (self.names[i] == self.names[i2] and 2 * (e2 - s2) >= e - s):
            return True
        return v2 >= v - 1e-12 and (i == i2 or 2 * len(grams & self.sets[i2]) > len(grams))

    def _windows(self, i: int, ids: dict, seq: list[int], breaks: np.ndarray) -> list[tuple[float, int, int]]:
        """(coefficient, begin, end) of the best passage from each break on that reaches `least`, for template i.

        Breaks are taken from the last to the first; `near` holds the distinct bigrams from there on by first occurrence,
        as many as a match may have, so a prefix of it is the set of a passage wherever a break parts it from the next.
        """
        n, size = len(seq), len(self.sets[i])
        if n == 1 and breaks[-1] == 1:  # one word, paired with nothing
            v = dice({next(iter(ids))}, self.sets[i])
            return [(v, 0, 1)] if v >= self.least - 1e-12 else []
        wanted = np.zeros(len(ids), bool)
        wanted[[ids[g] for g in self.sets[i] if g in ids]] = True
        hit = np.append(0, np.cumsum(wanted[seq]))
        following = breaks[np.minimum(np.searchsorted(breaks, np.arange(n) + 2), len(breaks) - 1)]
        limit = int(size * (2 - self.least) / self.least + 1e-9) + 1
        first, inside, near, out, p = [0] * len(ids), bytearray(len(ids)), [], [], n
        place = np.arange(1, limit + 1)
        for k in range(len(breaks) - 2, -1, -1):
            s = int(breaks[k])
            for p in range(p - 1, s - 1, -1):
                g = seq[p]
                if inside[g]:
                    near.remove(g)
                else:
                    inside[g] = 1
                    if len(near) >= limit:
                        inside[near.pop()] = 0
                near.insert(0, g)
                first[g] = p
            p = min(p, s)
            if hit[min(int(breaks[k + 1]), n)] == hit[min(s, n)] or not near:
                continue
            at = np.array([first[g] for g in near])
            value = 2 * np.cumsum(wanted[near]) / (place[: len(near)] + size)
            end = following[at]
            # the break must come before the next new bigram is complete; a full list has no next one that is known
            value[:-1][end[:-1] >= at[1:] + 2] = 0
            if len(near) == limit:
                value[-1] = 0
            best = int(value.argmax())
            if value[best] >= self.least - 1e-12:
                out.append((float(value[best]), s, int(end[best])))
        return out


def _finder(templates: list[tuple[str, str]], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)

        def judged(units: list[str]) -> list[np.ndarray]:
            """Template number + 1 and the coefficient's bits of each distinct unit; 0 where nothing matches."""
            out = []
            for u in units:
                hit = scanner.best(u)
                out.append(np.array([hit[0] + 1, np.float32(hit[1]).view(np.int32)] if hit else [0, 0], np.int32))
            return out

        lines = PieceCache(judged, limit=500_000)
        for rows, data, at in chunks(batches):
            edge = np.zeros(len(data) + 1, bool)
            edge[at[at < len(data)]] = True
            edge[1:][data == 0x0A] = True
            edge[len(data)] = False
            start = np.flatnonzero(edge)
            end = np.append(start[1:], len(data)) if len(start) else start
            found = lines.ids_of(data, start, end)[0].reshape(-1, 2) if len(start) else np.zeros((0, 2), np.int32)
            owner = np.searchsorted(at, start, "right") - 1
            hit = np.flatnonzero(found[:, 0])
            hits: dict[int, dict[int, tuple[int, float]]] = {}
            for i in hit:
                hits.setdefault(int(owner[i]), {})[int(i - np.searchsorted(owner, owner[i]))] = (int(found[i, 0]) - 1, float(found[i, 1:2].view(np.float32)[0]))
            out = [(d, k, k, *x) for d, of in hits.items() for k, x in of.items()]
            raw, many = data.tobytes(), np.bincount(owner, minlength=rows.num_rows)
            for d in np.flatnonzero(many):
                whole, runs = scanner.whole_and_passages(raw[at[d] : at[d + 1]].decode(), hits.get(int(d), {}))
                if whole and many[d] > 1:
                    out.append((int(d), -1, -1, *whole))
                out += [(int(d), *x) for x in runs]
            out.sort()
            doc, line, last, template, value = zip(*out) if out else [()] * 5
            ids = rows.column(0).take(pa.array(doc, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(line, pa.int64()), pa.array(last, pa.int64()), pa.array([scanner.names[t] for t in template], pa.string()), pa.array([round(v, 6) for v in value], pa.float64())], ["doc_id", "line", "last_line", "licence", "dice"])

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = DICE) -> DataFrame:
    """(doc_id, line, last_line, licence, dice) for each line, the whole text (line -1) and each passage that a template matches.

    `licence` is that of the best template; of equally good ones the first. Lines count from 0. A passage runs over
    whole lines or sentences from `line` to `last_line` and is told where lines and the whole text do not tell it.
    Null and empty texts match nothing; a text of one line is told once, as its line. doc_id may be null or repeated.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES or sum(len(t) for _, t in templates) > MOST_BYTES:
        raise ValueError("too many templates for every task to hold")
    return docs.select("doc_id", F.col("text")).mapInArrow(_finder(templates, least), "doc_id long, line long, last_line long, licence string, dice double")
