"""License texts in documents: exact phrases, and an exact set-similarity join with templates.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. The join finds every
block (consecutive words of a document, across its lines, up to WIDER times as many as a template has) whose word set contains at
least CONTAINMENT of the template's word set: whole license texts, and the short notices that stand for them. Notices of different
licenses differ in one word of five to nine, so all words of a template of fewer than ten must be there.

Template words are ordered by their frequency in the whole table, rarest first. Of t words of a template, n = ceil(CONTAINMENT t) must be
found, so the rarest common word is one of its first t - n + 1 (prefix filter): only where one of these stands in a document can a block be,
and every block has such a place. There, with the template's words as far as a block can reach to either side: they must be n at least (length
filter), and as that word is the rarest common one, so must be those of them that do not come before it in the order, which is what is left of the block
and of the template from its place on (positional filter). Around the places that are left, every block is measured.
The filters lose nothing, so the join is exact.

Defined results: a null text counts as empty (no words, no labels, score 0); repeated rows are scanned
each; a null doc_id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, coded, column, pieces, texts

#: Fixed values of the contract: phrases and labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Texts of licenses, and short notices as their authors ask for them to be given; label and text (fixed values).
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
CONTAINMENT, WIDER = 0.9, 1.25

_SPACE = bytes(10 if i == 10 else 32 if i <= 0x2F or 0x3A <= i <= 0x40 or 0x5B <= i <= 0x60 or 0x7B <= i <= 0x7F else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPACE).split()


def _frequency(known: set[bytes]):
    def run(batches):
        total: dict[bytes, int] = {}
        for batch in pieces(batches):
            joined = " ".join(texts(batch).to_pylist()).encode().translate(_SPACE)
            at, names = coded(pa.array(joined.split(), pa.large_binary()))
            n = np.bincount(at, minlength=len(names))
            for w, c in zip(names.to_pylist(), n.tolist(), strict=True):
                if w in known:
                    total[w] = total.get(w, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return run


def frequencies(documents: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """How often each template word stands in the table; as many rows as templates have distinct words reach the driver."""
    known = {w for _, t in templates for w in words(t)}
    rows = documents.select(F.col("text").cast("string")).mapInArrow(_frequency(known), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {w: 0 for w in known} | {bytes(r["word"]): r["n"] for r in rows.collect()}


class Template(NamedTuple):
    label: str
    words: dict[bytes, int]  # each with its place in the order of frequencies
    need: int
    width: int  # words of a block, at most


class Join:
    """The templates, ordered and indexed by their prefixes."""

    def __init__(self, frequency: dict[bytes, int], templates=TEMPLATES, containment: float = CONTAINMENT):
        order = {w: i for i, (w, _) in enumerate(sorted(frequency.items(), key=lambda x: (x[1], x[0])))}
        self.templates: list[Template] = []
        self.prefixes: dict[bytes, list[int]] = {}
        for k, (label, text) in enumerate(templates):
            every = words(text)
            own = sorted(set(every), key=order.__getitem__)
            need = max(1, math.ceil(containment * len(own) - 1e-9))
            self.templates.append(Template(label, {w: order[w] for w in own}, need, math.ceil(WIDER * len(every))))
            for w in own[: len(own) - need + 1]:
                self.prefixes.setdefault(w, []).append(k)

    def text(self, found: list[bytes], seen: dict[str, int] | None = None) -> dict[str, float]:
        """The largest containment of each label's templates in any block of a document's words. seen: counts the places of prefix words, those that each filter rejects, and those around which blocks are measured."""
        best: dict[str, float] = {}
        anchors: dict[int, list[int]] = {}
        if self.prefixes.keys().isdisjoint(found):
            return best
        for at, w in enumerate(found):
            for k in self.prefixes.get(w, ()):
                anchors.setdefault(k, []).append(at)
        for k, places_ in anchors.items():
            t = self.templates[k]
            own = [(at, t.words[w]) for at, w in enumerate(found) if w in t.words]
            most = max((self._most(own, a, b, t.width) for a, b in self._around(own, places_, found, t, seen)), default=0)
            if most >= t.need:
                best[t.label] = max(most / len(t.words), best.get(t.label, 0.0))
        return best

    @staticmethod
    def _around(own: list[tuple[int, int]], anchors: list[int], found: list[bytes], t: Template, seen: dict[str, int] | None) -> list[tuple[int, int]]:
        """Stretches of the document, apart from each other, in which all blocks lie whose rarest common word is an anchor that the filters leave."""
        out: list[tuple[int, int]] = []
        count = dict.fromkeys(("places", "length", "position", "measured"), 0)
        for at in anchors:
            low, high = at - t.width + 1, at + t.width
            near = {o for _, o in own[bisect_left(own, (low,)) : bisect_left(own, (high,))]}
            rarest = t.words[found[at]]
            count["places"] += 1
            if len(near) < t.need:
                count["length"] += 1
            elif sum(o >= rarest for o in near) < t.need:
                count["position"] += 1
            else:
                count["measured"] += 1
                if out and low < out[-1][1]:
                    out[-1] = (out[-1][0], high)
                else:
                    out.append((low, high))
        if seen is not None:
            for c, n in count.items():
                seen[c] = seen.get(c, 0) + n
        return out

    @staticmethod
    def _most(own: list[tuple[int, int]], low: int, high: int, width: int) -> int:
        """The most distinct words of a template in any block of a stretch; own: places and words."""
        inside = own[bisect_left(own, (low,)) : bisect_left(own, (high,))]
        count: dict[int, int] = {}
        first = most = 0
        for at, w in inside:
            count[w] = count.get(w, 0) + 1
            while at - inside[first][0] >= width:
                out = inside[first][1]
                count[out] -= 1
                if not count[out]:
                    del count[out]
                first += 1
            most = max(most, len(count))
        return most


def places(found: list[bytes], joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively; joined: the words with a space around each."""
    out, at, key = [], -1, b" " + phrase + b" "
    n, last = 0, 0
    while (at := joined.find(key, at + 1)) >= 0:
        n, last = n + joined.count(b" ", last, at), at
        out.append(n)
    return out


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(join: Join):
    needles = tuple(p.encode() for p in PHRASES)

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(column(batch, "doc_id").to_pylist(), texts(batch).to_pylist(), strict=True):
                flat = text.encode("utf-8", "surrogatepass").translate(_SPACE)
                found = flat.split()
                at, base = [], set()
                joined = b" " + b" ".join(found) + b" "
                for p in needles:
                    if p in joined and (got := places(found, joined, p)):
                        at += got
                        base.add(PHRASES[p.decode()])
                best = join.text(found)
                rows.append((doc, len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | best.keys())), 1.0 if base else max(best.values(), default=0.0)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCAN.split(", ")])

    return run


def scan(documents: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a phrase, else the largest containment)."""
    join = Join(frequencies(bounded(documents), templates), templates, containment)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(join), SCAN)
