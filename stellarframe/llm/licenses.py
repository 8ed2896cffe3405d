"""Licence scan: windows of a text's words against licence templates by the Dice coefficient over word bigrams.

Words are lower-cased runs of letters and digits, wherever lines end; a window's set holds its word bigrams. With sizes a
and b the coefficient 2 * shared / (a + b) can reach t only if t / (2 - t) <= a / b <= (2 - t) / t, and a window that
reaches it shares t / (2 - t) of the template's set, which most texts don't hold. A window begins and ends with a bigram of
its template, since others lower the score; it has at most (2 - t) / t times the template's words. Of windows that overlap
the one with most shared bigrams, times the score, goes first, so that a text is found before its part in another licence.
A window that has all words of its first or last line includes that line's edge. Short templates of a family, which differ in a
version or a condition alone, need their own marks in the window and no other's.

Defined cases: a null or empty text has no match; a very long text is scanned whole; one word has no bigram and no match; equals go to the template that
comes first; repeated rows get equal results; extra columns pass through, and one named like a result is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.8
#: Licence notices and texts as their publishers give them, fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
]
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_UNLICENSE_REST = "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: Texts whose publishers give them as a grant and what follows it; as one they are templates too.
_REST = {("MIT", "Permission"): _MIT_WARRANTY, ("BSD-3-Clause", "Redistribution"): _BSD_WARRANTY, ("BSD-2-Clause", "Redistribution"): _BSD_WARRANTY, ("ISC", "Permission"): _ISC_WARRANTY, ("Unlicense", "This"): _UNLICENSE_REST}
TEMPLATES += [(n, f"{x} {_REST[n, x.split(' ')[0]]}") for n, x in TEMPLATES if (n, x.split(" ")[0]) in _REST]
#: The GNU licences' names with their versions, the Creative Commons licences' conditions; fixed values of their publishers.
GNU = {"GPL": ("General", ("1", "2", "3")), "LGPL": ("Lesser General", ("2.1", "3")), "AGPL": ("Affero General", ("3",))}
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_ID = lambda family, v: f"{family}-{v}" + ".0" * ("." not in v)
_NOTICE = "{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
_ONLY = "{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} Public License version {2} as published by the Free Software Foundation."
_ROWS = [(_ID(f, v), name, v, "This library" if f == "LGPL" else "This program") for f, (name, versions) in GNU.items() for v in versions] + [("LGPL-2.0", "Library General", "2", "This library")]
TEMPLATES += [(n, form.format(what, name, v)) for n, name, v, what in _ROWS for form in (_NOTICE, _ONLY)]
TEMPLATES += [(n, f"This work is licensed under the GNU {name} Public License, version {v}.") for n, name, v, _ in _ROWS]
TEMPLATES += [("GPL-1.0", _NOTICE.format("This program", "General", "1").replace(" of the License, or", ", or"))]
TEMPLATES += [(f"CC-{c}-{v}.0", f"This work is licensed under a Creative Commons {name} {v}.0 {scope} License.") for c, name in CC.items() for v, scope in (("4", "International"), ("3", "Unported"))]
TEMPLATES += [(f"CC-{c}-{v}.0", f"Licensed under CC {c} {v}.0.") for c in CC for v in "34"]
#: The titles of full texts, some of their first sentences, and other notices.
TEMPLATES += [
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("GFDL-1.1", "GNU Free Documentation License Version 1.1, March 2000"), ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"), ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    *[(f"GFDL-1.{v}", f"Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.{v} or any later version published by the Free Software Foundation") for v in "123"],
    ("CC0-1.0", "CC0 1.0 Universal"), ("CC0-1.0", "A Work made available under CC0 may be protected by copyright and related or neighboring rights"), ("EPL-1.0", "Eclipse Public License - v 1.0"), ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("Artistic-1.0", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications."),
]
#: Tags of source files, made of the names above and of how the GNU licences go on.
_NAMES = list(dict.fromkeys(n for n, _ in TEMPLATES if n != "Proprietary"))
TEMPLATES += [(n, f"SPDX-License-Identifier: {n}{more}") for n in _NAMES for more in (("", "-only", "-or-later") if "GPL" in n else ("",))]
#: Only beside no other licence does this one say anything: copyright lines of all kinds of licences end with it.
WEAK = "Proprietary"
#: Words and pairs that tell the licences of a family apart: a window has all of its template's and none of another's. Numbers do
#: so too, as versions; a year must be there too. Texts of more than MARKED words speak for themselves.
MARKED = 80
QUALIFIERS = {"apache", "bsd", "eclipse", "isc", "mit", "mozilla", "noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd"}
QUALIFYING = {("lesser", "general"), ("library", "general"), ("affero", "general"), ("free", "documentation")}
_VERSION = re.compile("v?([1-9][0-9]?)|((?:19|20)[0-9]{2})")
_WORD = re.compile(r"[^\W_]+")
_ADDED = {"licenses": T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))}


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def marks(words: list[str]) -> tuple[set, set]:
    """The versions, and the words and pairs, that tell a licence from others of its family."""
    versions = {m[1] or m[2] for w in words if (m := _VERSION.fullmatch(w))}
    return versions, (QUALIFIERS & set(words)) | (QUALIFYING & bigrams(words))


class Templates:
    """Templates with their sets, and for each bigram those that hold it."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.names = [n for n, _ in templates]
        words = [_WORD.findall(t.lower()) for _, t in templates]
        self.words = [len(w) for w in words]
        self.sets = [bigrams(w) for w in words]
        self.of: dict[tuple[str, str], list[int]] = {}
        for i, s in enumerate(self.sets):
            for b in s:
                self.of.setdefault(b, []).append(i)
        self.ratio = (2 - threshold) / threshold + 1e-9
        #: Bigrams that a window must share with each template, whatever its size.
        self.need = [math.ceil(len(x) / self.ratio - 1e-6) for x in self.sets]
        self.marks = [marks(w) if len(w) <= MARKED else None for w in words]
        families: dict[str, set] = {}
        for name, own in zip(self.names, self.marks, strict=True):
            families.setdefault(name.split("-")[0], set()).update(v for v in (own[0] if own else ()) if len(v) < 3)
        self.versions = [families[n.split("-")[0]] for n in self.names]
        self.least = min(map(len, self.sets)) / self.ratio
        self.most = max(map(len, self.sets)) * self.ratio

    def fits(self, i: int, words: list[str]) -> bool:
        """Whether a window's words have the marks of template i, and none of another of its family."""
        if not self.marks[i]:
            return True
        versions, others = marks(words)
        return self.marks[i][0] <= versions and not (versions & self.versions[i]) - self.marks[i][0] and others == self.marks[i][1]

    def best(self, block: set) -> tuple[float, int] | None:
        """The best template of a block that reaches the threshold; the size bounds prune the rest."""
        size = len(block)
        if not self.least <= size <= self.most:
            return None
        shared: dict[int, int] = {}
        for b in block:
            for i in self.of.get(b, ()):
                shared[i] = shared.get(i, 0) + 1
        fits = [(2 * n / (size + len(self.sets[i])), -i) for i, n in shared.items() if size <= self.ratio * len(self.sets[i]) and len(self.sets[i]) <= self.ratio * size]
        top = max(fits, default=(0.0, 0))
        return (top[0], -top[1]) if top[0] >= self.threshold else None


def _windows(words: list, pairs: list, t: Templates, i: int) -> list[tuple[int, float, int, int]]:
    """(shared, score, first pair, last pair) of the best window from each place that begins one for template i."""
    own, size = t.sets[i], len(t.sets[i])
    places = [k for k, b in enumerate(pairs) if b in own]
    most, longest = size * t.ratio, int(t.words[i] * t.ratio) + 1
    out = []
    for k, begin in enumerate(places):
        last = k + t.need[i] - 1
        if last >= len(places):
            break
        if places[last] - begin >= longest:
            continue
        seen, shared, best = set(), 0, None
        for at in range(begin, min(begin + longest, len(pairs))):
            b = pairs[at]
            if b in seen:
                continue
            seen.add(b)
            if len(seen) > most or best and best[1] >= 2 * size / (len(seen) + size):
                break
            if b in own:
                shared += 1
                score = 2 * shared / (len(seen) + size)
                if score >= t.threshold and (not best or score > best[1]) and t.fits(i, words[begin : at + 2]):
                    best = (shared, score, begin, at)
        if best:
            out.append(best)
    return out


def scan(text: str | None, t: Templates) -> list[tuple[str, float, int, int]]:
    """(license, score, start, end) of the text's matches, those that explain most of the text before others, in order."""
    if not text:
        return []
    low = text.replace("\u0130", "i").lower()  # the one letter that grows when lower-cased
    words = _WORD.findall(low)
    pairs = list(zip(words, words[1:], strict=False))
    shared: dict[int, int] = {}
    for b in t.of.keys() & set(pairs):
        for i in t.of[b]:
            shared[i] = shared.get(i, 0) + 1
    found = [(-n * score, i, a, b, score) for i, m in shared.items() if m >= t.need[i] for n, score, a, b in _windows(words, pairs, t, i)]
    if any(t.names[i] != WEAK for _, i, *_ in found):
        found = [x for x in found if t.names[x[1]] != WEAK]
    if not found:
        return []
    ends, out = [], []
    for _, i, a, b, score in sorted(found):
        k = bisect(ends, (a, b))  # in word pairs; b + 1 is the last word
        if (k == 0 or ends[k - 1][1] + 1 < a) and (k == len(ends) or b + 1 < ends[k][0]):
            ends.insert(k, (a, b))
            out.append((a, b, i, score))
    spans = [m.span() for m in _WORD.finditer(low)]

    def edges(a: int, b: int) -> tuple[int, int]:
        """Where the window begins and ends: with its line, if it has all words that the line has on that side."""
        start, end = spans[a][0], spans[b + 1][1]
        line, stop = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        return (line if a == 0 or spans[a - 1][1] <= line else start, stop if b + 2 == len(spans) or spans[b + 2][0] >= stop else end)

    return [(t.names[i], score, *edges(a, b)) for a, b, i, score in sorted(out)]


def find_licenses(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """`docs` with `licenses`: an array of (license, score, start, end) in code points.

    `keep` names the columns of `docs` that are wanted, all unless given; others, such as the text, are not sent back.
    """
    known = templates or TEMPLATES
    kept = [c for c in (docs.columns if keep is None else keep) if c not in _ADDED]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(k, v) for k, v in _ADDED.items()]])
    made = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(known, threshold)
        for b in batches:
            rows = [[dict(zip(("license", "score", "start", "end"), m, strict=True)) for m in scan(x.as_py(), t)] for x in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(rows, made)], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text_col])]).mapInArrow(run, schema)
