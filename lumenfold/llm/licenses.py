"""License scans by conditional compression.

A text is looked at as its words; lines play no part in finding.  Each template names
words of its own of which any copy within the allowed differences must hold one.  The
engine sorts out texts without such a word, and a word's place in the template says
where a copy would begin.  The window there is compressed by itself and with the
template as zstandard raw dictionary; what that saves, against the template's own
size, ranks the candidates.  The wording decides: the fewest words that are missing
or stand between, and no difference in a version number or in a word that tells the
template from a lookalike.  Of candidates over the same words the best one stays.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_GPL2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_LGPL3 = """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""
_LGPL2 = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_CC0 = """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: Fixed values: (license, wording).  Full notices and the short statements in use.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", _GPL),
    ("Unlicense", _UNLICENSE),
    ("GPL-2.0", _GPL2),
    ("LGPL-3.0", _LGPL3),
    ("LGPL-2.1", _LGPL2),
    ("AGPL-3.0", _AGPL),
    ("MPL-2.0", _MPL),
    ("CC0-1.0", _CC0),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

#: A template of fewer words has to stand in the text without any difference.
SHORT_WORDS = 30
_word = re.compile(r"[^\W_]+")
_VERSION = ("version", "v")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def versions(words: list[str]) -> list[str]:
    """The numbers that follow the word version."""
    out = []
    for i, w in enumerate(words):
        if w in _VERSION:
            j = i + 1
            while j < len(words) and words[j].isdigit():
                out.append(words[j])
                j += 1
            out.append("")
    return out


def _last_row(template: np.ndarray, window: np.ndarray, free: bool) -> np.ndarray:
    """For each end in the window: the fewest missing words and words between of the
    template against what ends there and begins anywhere (``free``) or at the front."""
    at = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64) if free else at.copy()
    for i, w in enumerate(template):
        down = row + 1
        down[1:] = np.where(window == w, np.minimum(down[1:], row[:-1]), down[1:])
        row = np.minimum.accumulate(down - at) + at
    return row


def wording(template: list[str], window: list[str]) -> tuple[int, int, int, int]:
    """(missing, between, start, end) of the stretch of the window that differs least."""
    ids: dict[str, int] = {}
    t, w = (np.array([ids.setdefault(x, len(ids)) for x in words], np.int64) for words in (template, window))
    row = _last_row(t, w, True)
    end = int(row.argmin())
    back = _last_row(t[::-1], w[:end][::-1], False)
    length = int(back.argmin())
    differ = int(back[length])
    missing = (differ + len(template) - length) // 2
    return missing, differ - missing, end - length, end


@dataclass
class Template:
    name: str
    words: list[str]
    bag: Counter
    size: int
    compressor: object
    #: Words of which each copy holds at least one, with their places in the template.
    marks: dict[str, list[int]]
    must: set[str] = field(default_factory=set)  # words that a lookalike lacks
    never: set[str] = field(default_factory=set)  # words that a lookalike has instead


def marks_of(words: list[str], most: float) -> dict[str, list[int]]:
    """The template's longest words, so many that the allowed differences can't take all of them."""
    bag, out, held = Counter(words), {}, 0
    for w in sorted(bag, key=lambda w: (-len(w), w)):
        out[w] = [i for i, x in enumerate(words) if x == w]
        held += bag[w]
        if held > most * len(words):
            break
    return out


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], min_reduction: float, max_difference: float):
        import zstandard as z

        self.plain = z.ZstdCompressor(level=3, write_content_size=False)
        self.least, self.most = min_reduction, max_difference
        self.templates: list[Template] = []
        for name, text in templates:
            if words := words_of(text):
                raw = " ".join(words).encode("utf-8", "replace")
                data = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                self.templates.append(Template(name, words, Counter(words), len(self.plain.compress(raw)), z.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_dict_id=False), marks_of(words, self.differences(len(words)) / len(words))))
        full = [t for t in self.templates if len(t.words) >= SHORT_WORDS]
        for t in full:
            for u in full:
                if t.name != u.name and (t.bag - u.bag).total() + (u.bag - t.bag).total() <= self.differences(len(t.words)):
                    t.must |= set(t.bag - u.bag)
                    t.never |= set(u.bag - t.bag)
        self.marks = {w for t in self.templates for w in t.marks}

    def differences(self, n: int) -> int:
        return int(self.most * n) if n >= SHORT_WORDS else 0

    def gain(self, words: list[str], t: Template) -> float:
        """What the template as dictionary saves, as a part of the template's own size."""
        raw = " ".join(words).encode("utf-8", "replace")
        return (len(self.plain.compress(raw)) - len(t.compressor.compress(raw))) / t.size

    def confirmed(self, t: Template, window: list[str]) -> tuple[float, int, int, int, int] | None:
        """(reduction, missing, between, start, end) if the window holds the template's wording."""
        n, slack = len(t.words), self.differences(len(t.words))
        if (t.bag & Counter(window)).total() < n - slack or (gain := self.gain(window, t)) < self.least:
            return None
        missing, between, a, b = wording(t.words, window)
        if missing + between > slack:
            return None
        part = Counter(window[a:b])
        if t.must & set(t.bag - part) or t.never & set(part - t.bag) or versions(t.words) != versions(window[a:b]):
            return None
        return gain, missing, between, a, b

    def candidates(self, words: list[str]) -> Iterator[tuple[Template, int, int]]:
        """(template, window's start, end): where the place of a marked word says a copy may stand."""
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.marks:
                places.setdefault(w, []).append(i)
        for t in self.templates:
            n, slack = len(t.words), self.differences(len(t.words))
            step = slack + 1
            # A copy's marked words say its start but for the differences before them.
            for at in sorted({(p - k) // step for w, ks in t.marks.items() for p in places.get(w, ()) for k in ks}):
                a, b = max(0, at * step - slack), min(len(words), at * step + step + n + 2 * slack)
                if b - a >= n - slack:
                    yield t, a, b

    def matches(self, words: list[str]) -> list[tuple[int, int, str, float, int, int]]:
        """(start, end, license, reduction, missing, between), by place; none overlap."""
        found = set()
        for t, a, b in self.candidates(words):
            if got := self.confirmed(t, words[a:b]):
                gain, missing, between, s, e = got
                found.add((missing - len(t.words), missing + between, -gain, t.name, a + s, a + e, missing, between))
        out: list[tuple[int, int, str, float, int, int]] = []
        for _, _, gain, name, a, b, missing, between in sorted(found):
            at = bisect_right(out, (a,))
            if (at == len(out) or b <= out[at][0]) and (at == 0 or out[at - 1][1] <= a):
                out.insert(at, (a, b, name, -gain, missing, between))
        return out

    def text(self, text: str) -> list[dict]:
        spans = [m.span() for m in _word.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        ends = [m.start() for m in re.finditer("\n", text)]
        return [
            {"license": name, "first_line": bisect_right(ends, spans[a][0]), "last_line": bisect_right(ends, spans[b - 1][0]), "reduction": gain, "missing": missing, "between": between}
            for a, b, name, gain, missing, between in self.matches(words)
        ]


_MATCH = pa.list_(pa.struct([("license", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("reduction", pa.float64()), ("missing", pa.int32()), ("between", pa.int32())]))


def scan(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, min_reduction: float = 0.1, max_difference: float = 0.1) -> DataFrame:
    """``keep`` with ``matches``: each copy of a template's wording in order, with its
    lines (from 0), the size reduction as a part of the template's size, and the words
    missing and between.

    Every template of ``SHORT_WORDS`` words or more is looked for with at most
    ``max_difference`` of its words differing and at least ``min_reduction`` saved; a
    shorter statement has to stand as it is.  Copies may be wrapped or indented in any
    way and stand in lines of any length.  Where copies overlap, the one with most of
    its words there stays, then the one with fewest differences, then the larger
    reduction.  A null or empty text has no matches.  Repeated rows stay; an empty
    table or no templates give no rows or no matches.  Columns not named play no part.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    marks = sorted(Scanner(templates, min_reduction, max_difference).marks)
    # The engine sorts out texts without any marked word; they don't go to Python.
    whole = F.col(text)
    may = F.arrays_overlap(F.split(F.lower(whole), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, marks)).cast("array<string>"))
    df = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names)], F.when(may, whole).alias("_text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_reduction, max_difference)
        for b in batches:
            found = [scanner.text(v.as_py()) if v.is_valid else [] for v in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found, _MATCH)], names=[*names, "matches"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields[: len(names)])
    match = "matches array<struct<license: string, first_line: int, last_line: int, reduction: double, missing: int, between: int>>"
    return df.mapInArrow(look, kinds + match).select(*[F.col(a).alias(c) for c, a in zip(keep, names)], "matches")
