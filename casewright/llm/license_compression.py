"""License scans by conditional compression.

Around every word that license texts use, a block the size of a template is compressed
twice with Zstandard: alone, and with the template as a raw dictionary. The templates are
ranked by the bytes saved times their share of what the template saves of its own words,
so that neither a part of a long wording nor one with words too many comes first, and
confirmed in that order: the fewest words to
insert, delete or replace turn the template into some run of the block's words, and these
differences decide and are reported. Of confirmed runs that overlap, the first by the same
rank, of the run alone, takes the place. So of wordings that contain each other, or share
words, the one that explains most of the text is reported.

No saving is too small to be confirmed, because of a template of a few dozen bytes
Zstandard's own overhead eats most; only templates whose words are not there are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from casewright.llm.common import table

#: Words that at least one word of every template contains, in lower case.
CUES = ("licens", "copyright", "permission", "redistribution", "warrant", "public domain")
_CUE = re.compile("|".join(CUES))
_WORD = re.compile(r"[^\W_]+")
LEVEL = 3
#: One difference is allowed per so many words of a template.
WORDS_PER_DIFFERENCE = 15

# Wording of licenses and of the notices that name them.
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
GNU_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have "
    "received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>.")
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. " + BSD_DISCLAIMER),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission. " + BSD_DISCLAIMER),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. " + GNU_WARRANTY.format(name="General Public License")),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. " + GNU_WARRANTY.format(name="Affero General Public License")),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC0-1.0": ("Licensed under CC0 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
# Identifiers of the usual licenses.
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-2-Clause-Patent "
    "BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 "
    "CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-1.0-or-later GPL-2.0 GPL-2.0+ "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1+ LGPL-2.1-only "
    "LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception "
    "MS-PL NCSA OFL-1.1 OpenSSL PostgreSQL Python-2.0 Unlicense UPL-1.0 W3C WTFPL Zlib").split()
TAG = "SPDX-License-Identifier: "
# An identifier ends where nothing follows that could belong to it.
_ENDS, _ENDS_PLUS = re.compile(r"(?![\w+]|[-.]\w)"), re.compile(r"\+(?!\w)")
_ANYWHERE = re.compile("")


def wordings() -> Iterator[tuple[str, str, re.Pattern]]:
    """License, wording, and what must hold behind it in the text."""
    for name, texts in TEMPLATES.items():
        for text in texts:
            yield name, text, _ANYWHERE
    for name in IDENTIFIERS:
        yield name, TAG + name, _ENDS_PLUS if name.endswith("+") else _ENDS


def words_at(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words (runs of letters and digits, in lower case) and their places."""
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


@dataclass
class Template:
    license: str
    words: list[str]
    alone: zstandard.ZstdCompressor
    given: zstandard.ZstdCompressor
    behind: re.Pattern
    whole: int = 1  # bytes saved of the template's own words

    @property
    def letters(self) -> int:
        return sum(map(len, self.words)) + len(self.words)

    @property
    def allowed(self) -> int:
        return len(self.words) // WORDS_PER_DIFFERENCE

    def rank(self, saved: int) -> float:
        return saved * abs(saved) / self.whole

    def possible(self, present: set[str]) -> bool:
        """False if so many words are absent that no run can be near enough: each of them is a difference."""
        return sum(w not in present for w in self.words) <= self.allowed


@lru_cache(maxsize=1)
def templates() -> list[Template]:
    """Prepared once per worker process; words of text and template are put alike before they are compressed."""
    alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    out = []
    for name, text, behind in wordings():
        words, _ = words_at(text)
        raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        given = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False)
        out.append(Template(name, words, alone, given, behind))
        out[-1].whole = max(1, saving(out[-1], words))
    return out


def saving(template: Template, words: list[str]) -> int:
    """Bytes by which the template as a dictionary makes a compressed block smaller."""
    block = " ".join(words).encode("utf-8", "surrogatepass")
    return len(template.alone.compress(block)) - len(template.given.compress(block))


def differences(wanted: list[str], words: list[str]) -> tuple[int, int, int]:
    """(differences, first, last): the run of ``words`` that is nearest to ``wanted``, the longest if several are."""
    code: dict[str, int] = {}
    have = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    n = len(have)
    place = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), place.copy()  # a run may begin anywhere
    for word in wanted:
        same = have == code.get(word, -1)
        # Costs carry their start: of equal costs the earlier start wins, which makes runs long.
        key = cost * (n + 2) + start
        step = np.empty(n + 1, np.int64)
        step[0] = key[0] + n + 2
        step[1:] = np.minimum(key[:-1] + np.where(same, 0, n + 2), key[1:] + n + 2)
        # Words of the block that the template lacks: the least of all steps to the left, one more for each word between.
        step = np.minimum.accumulate(step - place * (n + 2)) + place * (n + 2)
        cost, start = step // (n + 2), step % (n + 2)
    end = n - int(np.argmin(cost[::-1]))
    return int(cost[end]), int(start[end]), end


@dataclass(frozen=True)
class Finding:
    license: str
    start: int
    end: int
    differences: int
    words: int
    saved: int = 0  # bytes, of the run alone
    rank: float = 0.0


def scan(text: str | None) -> list[Finding]:
    """Licenses in a whole text, in order. Of findings that overlap, the one whose template
    ranks first stays, then the one of fewer differences, then the first."""
    low = (text or "").lower()
    if not any(cue in low for cue in CUES):
        return []
    words, places = words_at(text)
    starts = np.array([a for a, _ in places])
    found: dict[tuple[str, int, int], Finding] = {}
    seen: dict[tuple[tuple[str, ...], int], list[tuple[Template, int, int, int, int]]] = {}
    cued = [k for k, w in enumerate(words) if _CUE.search(w) or w == "public" and words[k + 1:k + 2] == ["domain"]]
    reach = max(len(t.words) + t.allowed for t in templates())
    for k in cued:
        around = tuple(words[max(0, k - reach):k + reach + 1])
        at = min(k, reach)  # in a short text all cues have the same words around them
        if (around, at) not in seen:
            seen[around, at] = _winners(around, at)
        for template, first, last, count, saved in seen[around, at]:
            a, b = max(0, k - reach) + first, max(0, k - reach) + last
            span = (int(starts[a]), places[b - 1][1])
            if template.behind.match(text, span[1]):
                found.setdefault((template.license, *span), Finding(
                    template.license, *span, count, len(template.words), saved, template.rank(saved)))
    kept: list[Finding] = []
    for f in sorted(found.values(), key=lambda f: (-f.rank, f.differences, f.start, f.end, f.license)):
        if all(f.end <= other.start or f.start >= other.end for other in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f.start)


def _winners(around: tuple[str, ...], at: int) -> list[tuple[Template, int, int, int, int]]:
    """Confirmed templates near the word ``at``: template, first and last word (exclusive),
    differences, and the bytes saved of the run alone. Templates are confirmed in the order of
    what they save of their blocks."""
    ranked, present = [], set(around)
    for number, template in enumerate(templates()):
        if not template.possible(present):
            continue
        wide = len(template.words) + template.allowed
        lower = max(0, at - wide)
        block = list(around[lower:at + wide + 1])
        if template.possible(set(block)):
            ranked.append((-template.rank(saving(template, block)), number, lower, block))
    ranked.sort(key=lambda r: r[:2])
    out: list[tuple[Template, int, int, int, int]] = []
    for _, number, lower, block in ranked:
        template = templates()[number]
        out += [(template, lower + first, lower + last, count, saving(template, block[first:last]))
                for first, last, count in _runs(template, block)]
    return out


def _runs(template: Template, block: list[str]) -> Iterator[tuple[int, int, int]]:
    """(first, last, differences) of all runs near enough to the template; a block may hold a neighbour's notice too."""
    parts = [(0, len(block))]
    while parts:
        a, b = parts.pop()
        if not template.possible(set(block[a:b])):
            continue
        count, first, last = differences(template.words, block[a:b])
        if count <= template.allowed and last > first:
            yield a + first, a + last, count
            parts += [(a, a + first), (a + last, b)]


FOUND = "licenses string, n_found long, exact long, saved long, spans string"


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (distinct, sorted, comma-joined), n_found, exact (findings without a
    difference), saved (bytes by which their templates make the found runs smaller) and spans (license:start:end:differences; code points, end exclusive).

    One row per row of ``docs``; null texts are empty; other columns are not read.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [scan(text.as_py()) for text in part["text"]]
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], pa.array([",".join(sorted({f.license for f in r})) for r in rows], pa.string()),
                pa.array([len(r) for r in rows], pa.int64()), pa.array([sum(not f.differences for f in r) for r in rows], pa.int64()),
                pa.array([sum(f.saved for f in r) for r in rows], pa.int64()),
                pa.array([",".join(f"{f.license}:{f.start}:{f.end}:{f.differences}" for f in r) for r in rows], pa.string())],
                names=["doc_id", "licenses", "n_found", "exact", "saved", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(batches, f"doc_id long, {FOUND}")


def op1_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    return license_scan(table(spark, sf_dir, "documents"))
