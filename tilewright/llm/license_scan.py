"""Licence scans: passages of a text against licence templates by Dice coefficient over word bigrams.

Texts and templates are compared as lower-case words (letters and digits). A
passage with n bigrams can reach a Dice coefficient of t with a template of m
bigrams only if m*t/(2-t) <= n <= m*(2-t)/t and if it has m*t/(2-t) of the
template's bigrams; templates that a text can't reach by these bounds are
pruned. For the others, each stretch of the text within the size bound that
starts and ends with one of the template's bigrams is a candidate, and the best
ones that don't overlap are reported.

Defined results: null and empty texts have no finding. Where passages of several
templates overlap, the larger Dice, then the longer passage, then the first
template by name wins. Rows with a null doc_id take part; repeated rows are
reported each. Long texts are compared whole. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""



def _gnu(what: str, name: str, version: str, free: str, which: str = "") -> str:
    """The standard header of a GNU licence."""
    return f"{what} is free software{free} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {which or what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."


_COPY = " You should have received a copy of the GNU {} along with this {}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_LGPL, _AGPL = "Lesser General Public License", "Affero General Public License"

#: Fixed values: (name, kind, text) of licence texts, standard headers and one-line notices.
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "text", _BSD_START + " " + _BSD_END),
    ("BSD-3-Clause", "text", _BSD_START + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("Zlib", "text", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "header", _gnu("This program", "General Public License", "2", ";")),
    ("GPL-2.0", "header", _gnu("This program", "General Public License", "2", ";") + _COPY.format("General Public License", "program")),
    ("LGPL-2.1", "header", _gnu("This library", _LGPL, "2.1", ";")),
    ("LGPL-2.1", "header", _gnu("This library", _LGPL, "2.1", ";") + _COPY.format(_LGPL, "library")),
    ("LGPL-3.0", "header", _gnu("This program", _LGPL, "3", ":")),
    ("LGPL-3.0", "header", _gnu("This library", _LGPL, "3", ";")),
    ("AGPL-3.0", "header", _gnu("This program", _AGPL, "3", ":")),
    ("EPL-1.0", "header", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/ SPDX-License-Identifier: EPL-2.0"),
    ("BSL-1.0", "text", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSL-1.0", "header", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Artistic-2.0", "notice", "Licensed under the Artistic License 2.0"),
    ("EPL-2.0", "notice", "Licensed under the Eclipse Public License 2.0"),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "notice", "Released under the MIT License"),
    ("MIT", "notice", "Licensed under the MIT License"),
    ("MIT", "notice", "This project is licensed under the terms of the MIT license"),
    ("BSD", "notice", "Released under the BSD License"),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License"),
    ("ISC", "notice", "Released under the ISC License"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "notice", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "notice", "Licensed under the Mozilla Public License, Version 2.0"),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "notice", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "notice", "Released under CC0 1.0 Universal Public Domain Dedication"),
    ("Unlicense", "notice", "Released into the public domain"),
]
_WORD = re.compile(r"[^\W_]+")
#: A notice of few bigrams that names no licence needs one of these words as near as that.
LICENCE_WORDS = frozenset({"license", "licence", "licensed", "licenced", "licensing", "unlicense", "copyright", "copyrighted", "spdx"})
FEW, NEAR = 4, 8
#: Characters of a table of templates.
MOST_TEMPLATES = 20_000_000


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Templates:
    """Bigrams of the templates and the bounds they set for a least Dice coefficient."""

    def __init__(self, templates: list[tuple[str, str, str]], least: float) -> None:
        self.names = [(n, k) for n, k, _ in templates]
        self.least = least
        self.bags, self.of = [], {}
        for i, (_, _, text) in enumerate(templates):
            w = words(text)
            self.bags.append(Counter(zip(w, w[1:], strict=False)))
            for b in self.bags[-1]:
                self.of.setdefault(b, []).append(i)
        self.sizes = [b.total() for b in self.bags]
        self.bare = [k == "notice" and b.total() <= FEW and not LICENCE_WORDS & {w for pair in b for w in pair} and not {"cc", "cc0"} & {w for pair in b for w in pair} for (_, k), b in zip(self.names, self.bags, strict=True)]
        self.shared = [int(np.ceil(m * least / (2 - least) - 1e-9)) for m in self.sizes]
        self.most = [int(np.floor(m * (2 - least) / least + 1e-9)) for m in self.sizes]

    def find(self, text: str) -> list[tuple[int, float, int, int]]:
        """(template, dice, first word, words) of the passages, best first, without overlaps."""
        w = words(text)
        hits: dict[int, list[tuple[int, tuple[str, str]]]] = {}
        get = self.of.get
        for at, pair in enumerate(zip(w, w[1:], strict=False)):
            if (found := get(pair)) is not None:
                for i in found:
                    hits.setdefault(i, []).append((at, pair))
        candidates: list[tuple[float, int, int, int]] = []
        for i, places in hits.items():
            if len(places) >= self.shared[i]:
                candidates += self._stretches(i, places)
        taken: list[tuple[int, float, int, int]] = []
        spans: list[tuple[int, int]] = []  # first word and word behind the last, in order
        for dice, n, i, at in sorted(candidates, key=lambda c: (-c[0], -c[1], self.names[c[2]], c[3])):
            if self.bare[i] and not LICENCE_WORDS.intersection(w[max(0, at - NEAR) : at + n + 1 + NEAR]):
                continue
            k = bisect.bisect(spans, (at, at))
            if (k == 0 or spans[k - 1][1] <= at) and (k == len(spans) or at + n + 1 <= spans[k][0]):
                spans.insert(k, (at, at + n + 1))
                taken.append((i, dice, at, n + 1))
        return taken

    def _stretches(self, i: int, places: list[tuple[int, tuple[str, str]]]) -> list[tuple[float, int, int, int]]:
        """(dice, bigrams, template, first word): the best stretch from each of the template's bigrams in the text.

        A bigram counts as shared while its place among the equal ones of the
        stretch is below the template's number of them; as the start moves on by
        one, one number of ``passed`` changes.
        """
        p = np.array([at for at, _ in places])
        number = {b: k for k, b in enumerate(self.bags[i])}
        kind, have = np.array([number[b] for _, b in places]), np.array(list(self.bags[i].values()))
        order = np.argsort(kind, kind="stable")
        first = np.r_[0, np.flatnonzero(np.diff(kind[order])) + 1]
        nth = np.empty(len(p), np.int64)  # how many equal ones come before each
        nth[order] = np.arange(len(p)) - np.repeat(first, np.diff(np.r_[first, len(p)]))
        upto = np.searchsorted(p, p + self.most[i])  # hits within the size bound of each start
        enough, passed, out = upto - np.arange(len(p)) >= self.shared[i], np.zeros(len(have), np.int64), []
        for s in range(len(p)):
            if enough[s]:
                here = slice(s, int(upto[s]))
                common = np.cumsum(nth[here] - passed[kind[here]] < have[kind[here]])
                n = p[here] - p[s] + 1
                dice = 2 * common / (n + self.sizes[i])
                e = len(dice) - 1 - int(dice[::-1].argmax())
                if dice[e] >= self.least - 1e-12:
                    out.append((float(dice[e]), int(n[e]), i, int(p[s])))
            passed[kind[s]] += 1
        return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, templates: list[tuple[str, str, str]] | DataFrame | None = None) -> DataFrame:
    """doc_id, license, kind, dice, start, end (code points): a row for each passage found.

    ``templates`` are (name, kind, text), or a table of these columns, of
    ``MOST_TEMPLATES`` characters at most. A notice that names no licence ("released into
    the public domain") counts only with a licence word beside it.
    """
    kind = docs.select(F.col(id_col).alias("doc_id")).schema
    for name, t in (("license", "string"), ("kind", "string"), ("dice", "double"), ("start", "long"), ("end", "long")):
        kind = kind.add(name, t)
    chosen = TEMPLATES if templates is None else _from_table(templates) if isinstance(templates, DataFrame) else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(chosen, least)
        for b in batches:
            rows = []
            for r, text in enumerate(b.column(1).to_pylist()):
                if found := known.find(text):
                    spans = _spans(text)
                    rows += [(r, *known.names[i], dice, spans[at][0], spans[at + n - 1][1]) for i, dice, at, n in found]
            if rows:
                at, *cols = zip(*rows, strict=True)
                types = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.record_batch([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=kind.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").mapInArrow(run, kind)


def _from_table(table: DataFrame) -> list[tuple[str, str, str]]:
    size = table.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > MOST_TEMPLATES:
        raise ValueError(f"the templates have {size} characters; {MOST_TEMPLATES} are the most")
    return sorted((r.name, r.kind, r.text) for r in table.select("name", "kind", "text").filter("name IS NOT NULL AND kind IS NOT NULL AND text IS NOT NULL").collect())


def _spans(text: str) -> list[tuple[int, int]]:
    """The words' spans in the text itself; lower-casing may lengthen a text, so places are mapped back."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in _WORD.finditer(low)]
    back = [i for i, c in enumerate(text) for _ in c.lower()]
    back += [len(text)] * (len(low) - len(back) + 1)
    return [(back[m.start()], back[m.end() - 1] + 1) for m in _WORD.finditer(low)]
