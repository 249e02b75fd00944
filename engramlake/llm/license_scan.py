"""Operator 2: license scans by patience alignment.

Text and template are runs of letters and digits in lower case.  Words that
occur once in both are anchors; the longest increasing subsequence of their
places in the text keeps the anchors that agree in order; the gaps between
them are aligned in the same way, and where a gap has no anchor its equal
beginnings and ends are matched.  Coverage is the share of template words
matched within the densest stretch of the text that a template's length (half
again, and ten words) can span, aligned anew on its own, since words that are
unique there need not be unique in the whole text.

A template is aligned only if enough of its words occur in the text for the
coverage asked for, which no alignment could reach otherwise; so the filter
loses nothing.  After a finding the search goes on before and behind it, within
a block of the text: long texts are read left to right in blocks, each from
where the last finding ended, so their cost grows with their length alone.

Scanning is a narrow step over whole texts; templates are a constant of some
kilobytes.  Defined results: null, empty or wordless texts have no findings;
equal coverage goes to the earlier, then the first template by name; repeated
rows repeat their findings; other columns are untouched, but one named
``licenses`` is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm.shared import arrow_map, table

COVERAGE = 0.8
#: Words of a block, in lengths of the longest stretch.
BLOCKS = 4
_WORD = re.compile(r"[^\W_]+")

#: Fixed texts of public licenses and of their usual notices.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
        ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.""",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "ISC-permission": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    "MIT-permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "MIT-notice": "Released under the MIT License",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "all-rights-reserved": "All rights reserved",
}


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, p in enumerate(places):
        at = bisect_left(tails, p)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(p)
            ends.append(k)
        else:
            tails[at], ends[at] = p, k
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment of word lists: matched (place in a, place in b), both increasing."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i == j or k == m:
            continue
        once: dict[str, int] = {}
        for x in range(i, j):
            once[a[x]] = -1 if a[x] in once else x
        there: dict[str, int] = {}
        for y in range(k, m):
            if b[y] in once:
                there[b[y]] = -1 if b[y] in there else y
        pairs = sorted((x, there[w]) for w, x in once.items() if x >= 0 and there.get(w, -1) >= 0)
        chosen = [pairs[c] for c in increasing([y for _, y in pairs])]
        if not chosen:
            continue
        found += chosen
        for (x, y), (u, v) in zip([(i - 1, k - 1), *chosen], [*chosen, (j, m)]):
            if u - x > 1 and v - y > 1:
                todo.append((x + 1, u, y + 1, v))
    return sorted(found)


def densest(places: list[int], width: int) -> tuple[int, int]:
    """The range [first, last] of ``places`` (increasing) within ``width`` that holds most; the earliest."""
    best, most = (0, 0), 0
    for k, p in enumerate(places):
        n = bisect_right(places, p + width - 1) - k
        if n > most:
            best, most = (p, places[k + n - 1]), n
    return best


def best_match(template: list[str], words: list[str]) -> tuple[float, int, int] | None:
    """(coverage, first word, end) of the best stretch, or None without a match.

    Candidate stretches begin wherever a template word that is rarest in the
    text can lie; each is aligned on its own, besides the alignment of the whole.
    """
    if not words:
        return None
    width = len(template) * 3 // 2 + 10
    own = set(template)
    seen: dict[str, list[int]] = {}
    for y, w in enumerate(words):
        if w in own:
            seen.setdefault(w, []).append(y)
    if not seen:
        return None
    starts = set()
    matched = align(template, words)
    if matched:
        starts.add(densest([y for _, y in matched], width)[0] - len(template) // 2)
    # any cover of COVERAGE misses few words: of the rarest ones, more than it can miss, one is in it
    spare = len(template) - int(-(-COVERAGE * len(template) // 1))
    rarest = sorted((len(seen.get(w, ())), w) for w in own)
    taken = 0
    for n, w in rarest:
        starts.update(max(0, y - width // 2) for y in seen.get(w, ()))
        taken += template.count(w)
        if taken > spare:
            break
    best = None
    last = None
    for s in sorted(max(0, s) for s in starts):
        if last is not None and s - last < len(template) // 8 + 1:
            continue
        last = s
        here = align(template, words[s : s + 2 * width])
        if not here:
            continue
        lo, hi = densest([y for _, y in here], width)
        n = sum(lo <= y <= hi for _, y in here)
        if best is None or n > best[0]:
            best = (n, s + lo, s + hi + 1)
    if best is None or best[0] < COVERAGE * len(template):
        # copies close together hide each other's words from the alignment: one copy at a time
        for s in sorted({max(0, y - k) for k, w in enumerate(template[: spare + 1]) for y in seen.get(w, ())}):
            part = words[s : s + len(template)]
            if len(own.intersection(part)) < len(own) - spare:
                continue
            here = align(template, part)
            if here and (best is None or len(here) > best[0]):
                best = (len(here), s + here[0][1], s + here[-1][1] + 1)
    return best and (best[0] / len(template), best[1], best[2])


_PLAIN = {name: [w.lower() for w in _WORD.findall(t)] for name, t in sorted(TEMPLATES.items())}


def _findings(words: list[str], templates: dict[str, list[str]], least: float) -> list[tuple[int, int, str, float]]:
    """(first word, end, license, coverage) of stretches apart from each other, in order."""
    out = []
    todo = [(0, len(words))]
    while todo:
        lo, hi = todo.pop()
        part = words[lo:hi]
        known = set(part)
        tried = []
        for name, t in templates.items():
            if sum(w in known for w in t) >= least * len(t) and (m := best_match(t, part)) and m[0] >= least:
                tried.append((-len(t) * m[0], m[1], name, m))
        if tried:
            _, _, name, (share, a, b) = min(tried)
            out.append((lo + a, lo + b, name, round(share, 6)))
            todo += [(lo, lo + a), (lo + b, hi)]
    return sorted(out)


def findings(text: str, templates: dict[str, list[str]] = _PLAIN, least: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) by start: stretches apart from each other, in code points."""
    marks = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in marks]
    reach = max((len(t) * 3 // 2 + 10 for t in templates.values()), default=0)
    out: list[tuple[int, int, str, float]] = []
    lo = 0
    while lo < len(words):
        hi = min(len(words), lo + BLOCKS * reach)
        here = [(lo + a, lo + b, name, share) for a, b, name, share in _findings(words[lo:hi], templates, least)]
        # what comes near the end may go on behind it: the next block has it whole
        sure = [f for f in here if f[1] <= hi - reach or hi == len(words)]
        out += sure
        if hi == len(words):
            break
        lo = max([hi - 2 * reach, *(b for _, b, _, _ in sure)])
    return [(name, share, marks[a][0], marks[b - 1][1]) for a, b, name, share in out]


def scan(df: DataFrame, text: str = "text", least: float = COVERAGE) -> DataFrame:
    """``df`` without the text and with ``licenses``: array of struct<license, coverage, start, end>."""
    names = [c for c in df.columns if c not in (text, "licenses")]
    kind = T.ArrayType(T.StructType.fromDDL("license string, coverage double, start int, end int"))
    out = T.StructType([df.schema[c] for c in names] + [T.StructField("licenses", kind)])
    arrow = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("license", "coverage", "start", "end"), f)) for f in findings((t or b"").decode("utf-8", "replace"), least=least)] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(1 + i) for i in range(len(names))], pa.array(found, arrow)], names=out.names)

    kept = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    return arrow_map(df.select(F.col(f"`{text}`").cast("binary").alias("t"), *kept), run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)).alias("best_coverage"),
    )
