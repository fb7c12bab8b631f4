"""License scans by template markup: templates with optional and replaceable regions, compiled to automata over words.

Markup, after the public license-matching guidelines: ``<<beginOptional>>...<<endOptional>>`` may be missing, ``<<var:N>>`` stands for up to N
words, ``<<number:N>>`` for up to N words of digits.  A text has the license if the template's mandatory wording stands in it exactly, word for word; words are lower-cased (A-Z) runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, so punctuation and line breaks never matter.  Short phrases that name a license are the base labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

#: Phrases that name a license, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_NAMES = (
    "<<beginOptional>>3.<<endOptional>> Neither the name of <<var:12>> nor the names of <<var:6>> contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY <<var:12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:12>> BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
#: The elements of Creative Commons licenses after attribution, in the spellings in use.
_CC = {"nc": ("NonCommercial", "Non Commercial"), "nd": ("NoDerivatives", "NoDerivs", "No Derivatives"), "sa": ("ShareAlike", "Share Alike")}


def _cc_templates() -> list[tuple[str, str]]:
    return [
        (
            "-".join(("cc-by", *elements)),
            "This work is licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons "
            f"{' '.join(('Attribution', *spelt))} <<number:2>> <<beginOptional>>International<<endOptional>> "
            "<<beginOptional>>Unported<<endOptional>> <<beginOptional>>Generic<<endOptional>> License",
        )
        for elements in ((), ("nc",), ("nd",), ("sa",), ("nc", "sa"), ("nc", "nd"))
        for spelt in product(*map(_CC.get, elements))
    ]


#: Fixed texts: the public wording of licenses and of their notices, in template markup.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software <<beginOptional>>and associated "
        'documentation files<<endOptional>> (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the "
        "Software. " + _WARRANTY
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the <<beginOptional>>\"<<endOptional>>License); you may not use <<var:4>> except in "
        "compliance with the License. You may obtain a copy of the License at <<beginOptional>>http<<endOptional>> "
        "<<beginOptional>>https<<endOptional>> www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    ("bsd-2", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("bsd-3", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    (
        "isc",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND <<var:8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        "FITNESS. IN NO EVENT SHALL <<var:8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    (
        "gpl",
        "This program is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation<<beginOptional>>, <<beginOptional>>either<<endOptional>> version "
        "<<number:2>> of the License<<endOptional>><<beginOptional>>, or (at your option) any later version<<endOptional>>. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU "
        "General Public License along with this program. If not"
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version <<number:2>> of the License, or (at your option) any later version. This "
        "library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have "
        "received a copy of the GNU Lesser General Public License along with this library; if not"
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version <<number:2>> of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have "
        "received a copy of the GNU Affero General Public License along with this program. If not"
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> mozilla.org/MPL/2.0"
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest "
        "in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs "
        "and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law. " + _WARRANTY
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will <<var:8>> be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
        "in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "<<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."
    ),
    (
        "bsl-1",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and '
        "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
        'processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL <<var:12>> BE LIABLE FOR "
        "ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    (
        "0bsd",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is "
        'hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND <<var:8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    ("cc0", "To the extent possible under law, <<var:12>> waived all copyright and related or neighboring rights to <<var:12>> This work is published from"),
    *_cc_templates(),
    ("mit", "released under the <<beginOptional>>terms of the<<endOptional>> MIT license"),
]

_SEPARATOR = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.ones(256, bool)
_IS_WORD[np.r_[0:0x30, 0x3A:0x61, 0x7B:0x80]] = False


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Automaton:
    """A nondeterministic automaton over words: state i has read the template up to item i."""

    def __init__(self, template: str):
        self.items: list[tuple[str, object]] = []
        opened: list[int] = []
        for tag, size, plain in re.findall(r"<<(beginOptional|endOptional|var|number)(?::(\d+))?>>|((?:(?!<<).)+)", template, re.S):
            if tag == "beginOptional":
                opened.append(len(self.items))
                self.items.append(("skip", None))
            elif tag == "endOptional":
                self.items[opened.pop()] = ("skip", len(self.items))
            elif tag in ("var", "number"):
                self.items += [("any", tag == "number")] * int(size)
            else:
                self.items += [("word", w) for w in words(plain)]
        first = next(i for i, item in enumerate(self.items) if item[0] == "word")
        if first:
            raise ValueError("a template begins with mandatory wording")
        lead = []
        for kind, word in self.items:
            if kind != "word" or len(lead) == 4:
                break
            lead.append(word)
        #: The words every match begins with, as an expression over lower-cased bytes.
        self.lead = re.compile(rb"(?<!" + _NOT(_SEPARATOR) + rb")" + (_SEPARATOR + rb"+").join(map(re.escape, lead)) + rb"(?!" + _NOT(_SEPARATOR) + rb")")

    def _closure(self, states: set[int]) -> set[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s in out:
                continue
            out.add(s)
            if s < len(self.items):
                kind, target = self.items[s]
                if kind == "skip":
                    todo += [s + 1, target]
                elif kind == "any":
                    todo.append(s + 1)
        return out

    @staticmethod
    def _reads(kind: str, item: object, word: bytes) -> bool:
        return (word.isdigit() or not item) if kind == "any" else kind == "word" and item == word

    def accepts(self, following: Iterator[bytes]) -> bool:
        """Whether the words from here begin with a text of this template."""
        states = self._closure({0})
        while len(self.items) not in states:
            word = next(following, None)
            if word is None:
                return False
            step = {s + 1 for s in states if s < len(self.items) and self._reads(*self.items[s], word)}
            if not step:
                return False
            states = self._closure(step)
        return True


def _NOT(separator: bytes) -> bytes:
    return b"[^" + separator[1:]


@lru_cache(1)
def _compiled() -> tuple[list[tuple[str, re.Pattern]], list[tuple[str, Automaton]]]:
    edge = _NOT(_SEPARATOR)
    phrases = [
        (label, re.compile(rb"(?<!" + edge + rb")" + (_SEPARATOR + rb"+").join(map(re.escape, words(phrase))) + rb"(?!" + edge + rb")")) for phrase, label in PHRASES.items()
    ]
    return phrases, [(label, Automaton(t)) for label, t in TEMPLATES]


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text; null is empty.

    The score is 1 for a license's own wording, 0.5 for a phrase that names one, else 0.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    inside = _IS_WORD[np.frombuffer(raw, np.uint8)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    total = int(begins.sum())
    phrases, automata = _compiled()
    places: list[int] = []
    base, more = set(), set()
    if any(hint in raw for hint in (b"license", b"cc", b"ermission", b"distribut", b"copyright")):
        for label, expression in phrases:
            at = [m.start() for m in expression.finditer(raw)]
            if at:
                base.add(label)
                places += at
        for label, automaton in automata:
            if any(automaton.accepts(m[0] for m in _WORD.finditer(raw, lead.start())) for lead in automaton.lead.finditer(raw)):
                more.add(label)
    numbers = [int(begins[:p].sum()) for p in (min(places), max(places))] if places else [None, None]
    score = 1.0 if more else 0.5 if base else 0.0
    return total, len(places), *numbers, ",".join(sorted(base)), ",".join(sorted(base | more)), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]


def license_scan(docs: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` for every row of ``docs`` (doc_id, text, any other columns); see :func:`scan_text`.

    Null ids are kept, repeated rows stay repeated, no row gives no row.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in texts(batch):
                columns = zip(*map(scan_text, part))
                arrays = [batch.column(0).slice(at, len(part)), *(pa.array(c, t) for c, t in zip(columns, _TYPES[1:]))]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, SCHEMA)
