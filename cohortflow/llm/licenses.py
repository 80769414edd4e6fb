"""License scans by conditional compression.

The words of a text are taken over line ends, so a wrapped notice and one inside a
long line are found alike. Places that share RUN words in a row (or a whole short
notice) with a template are gathered to regions of at most REGION words. A region is
compressed alone and with each template as zstandard raw-content dictionary;
templates are ranked by the share of bytes saved. In that order, a template confirms
by its wording: the region is aligned with each notice of the template, and the
densest span of equal runs counts if at most DIFFERENT of its words differ and no
identifying word (licence name, version, NC / ND / SA and clause marks, "not")
differs within the span or in the rest of its first and last sentence. A span that
another licence's template explains as well (a clause they share) is not confirmed.
What lies before and after a confirmed span is scanned again.

A row is a notice: ``block`` is its first line, ``text`` its lines (the span alone in
lines longer than LONG; what such a line holds beside its notices is a candidate like
any line). ``n_different`` counts words that one side has and the other
lacks; ``exact`` means that the words of the row are a run of the template's words.
Other candidate lines (a shared run that saves GAIN of the bytes, or a word that
licence notices use, CUES) give a row of null license with the best-ranked template,
neighbouring lines in one.

Null and empty texts and lines that are no candidates give no rows. Ties in size go
to the template that comes first. Repeated rows are scanned each. Extra columns are
not read.
"""

from __future__ import annotations

import difflib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import slices

#: Share of words that may differ, and words in a row that must be the same.
DIFFERENT, RUN = 0.25, 4
LEVEL = 9
#: Words between two shared runs of one region, words of a region (the longest notice has 230), characters of a line given whole with its notice.
GAP, REGION, LONG = 40, 800, 4000
#: Share of bytes that a line of a shared run, without a cue and unconfirmed, saves at least to give a row.
GAIN = 0.2

_BSD = ("All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ENDORSE = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
            "this software without specific prior written permission. ")
_GNU = ("{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
        "Foundation, either version {version} of the License, or (at your option) any later version. {what} is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU {name} for more details. You should have received a copy of the GNU {name} along with {that}. If not, see "
        "<https://www.gnu.org/licenses/>.")
_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}. "
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
          "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
          "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
          "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")


def _notices(*lines: str) -> str:
    return "\n".join(lines)


def _named(name: str) -> tuple[str, ...]:
    return (f"Licensed under the {name}.", f"Released under the {name}.", f"This project is licensed under the terms of the {name}.",
            f"This work is licensed under the {name}.")


def _gnu(name: str, short: str, version: str, what: str = "This program", that: str = "this program") -> str:
    return _notices(f"This work is licensed under the GNU {name}, version {version}.", f"GNU {name} v{version}.", f"Licensed under the {short} v{version}.",
                    _GNU.format(what=what, that=that, name=name, version=version))


def _cc(name: str, short: str) -> str:
    url = short.lower()
    return _notices(f"This work is licensed under a Creative Commons {name} 4.0 International License. To view a copy of this license, visit "
                    f"http://creativecommons.org/licenses/{url}/4.0/.", f"Licensed under CC {short} 4.0.",
                    f"Text is available under the Creative Commons {name} 4.0 License.")


#: Wording of common licence notices, one notice a line.
TEMPLATES = {
    "MIT": _notices(*_named("MIT License"),
                    "The MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
                    "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
                    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall "
                    "be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
                    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
                    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
                    "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
                    "IN THE SOFTWARE."),
    "Apache-2.0": _notices("Licensed under the Apache License, Version 2.0.",
                           "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                           "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable "
                           "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                           "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                           "permissions and limitations under the License."),
    "GPL-3.0": _gnu("General Public License", "GPL", "3"),
    "GPL-2.0": _gnu("General Public License", "GPL", "2"),
    "BSD-2-Clause": _notices(*_named("BSD 2-Clause License"), _BSD.format("")),
    "BSD-3-Clause": _notices(*_named("BSD 3-Clause License"), _BSD.format(_ENDORSE)),
    "ISC": _notices(*_named("ISC License"),
                    _PERMIT.format(", provided that the above copyright notice and this permission notice appear in all copies") + _AS_IS),
    "0BSD": _notices(*_named("0BSD License"), _PERMIT.format("") + _AS_IS),
    "CC-BY-4.0": _cc("Attribution", "BY"),
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike", "BY-SA"),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial", "BY-NC"),
    "CC-BY-ND-4.0": _cc("Attribution-NoDerivatives", "BY-ND"),
    "CC-BY-NC-SA-4.0": _cc("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "CC-BY-NC-ND-4.0": _cc("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    "CC0-1.0": _notices("CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                        "this work.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "MPL-2.0": _notices("Licensed under the Mozilla Public License, version 2.0.",
                        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "LGPL-3.0": _gnu("Lesser General Public License", "LGPL", "3", "This library", "this library"),
    "LGPL-2.1": _gnu("Lesser General Public License", "LGPL", "2.1", "This library", "this library"),
    "AGPL-3.0": _gnu("Affero General Public License", "AGPL", "3"),
    "proprietary": _notices("All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any "
                            "means without the prior written permission of the publisher."),
}
CUES = r"(?i)licen[sc]e|copyright|rights reserved|\bgnu\b|creative commons|warrant(?:y|ies)|redistribut|\bpermission|free of charge|\bcc[ -]by\b|©"
_CUES = re.compile(CUES)
_TOKEN = re.compile(r"v(?=\d)|(?:[al]?gpl|mpl)(?=v?\d)|\d+(?:\.\d+)*(?![^\W_])|[^\W_]+", re.I)
_PLAIN = re.compile(r"[^\W\d_]+")
_STOP = re.compile(r"[.;:!?](?=\W|$)")
_NAMES = frozenset("mit apache gnu lesser affero gpl lgpl agpl bsd 0bsd isc mozilla mpl cc cc0 creative commons attribution noncommercial noderivatives "
                   "sharealike clause eclipse epl eupl artistic boost endorse advertising appear not".split())
_CC = frozenset("cc by nc nd sa".split())
_VERSIONED = _NAMES - {"not"} | _CC | {"version", "v", "license", "licenses"}
_JOINED = {("non", "commercial"): "noncommercial", ("share", "alike"): "sharealike", ("no", "derivatives"): "noderivatives", ("no", "derivs"): "noderivatives"}


class Words:
    """Words of some lines, with line, sentence, place in the line, and whether each identifies a licence."""

    def __init__(self, lines: list[str]) -> None:
        self.word, self.line, self.sentence, self.first, self.end = [], [], [], [], []
        sentence = 0
        for k, line in enumerate(lines):
            sentence += not line.strip()
            last = 0
            for m in _TOKEN.finditer(line):
                w = m.group().lower()
                if w[0].isdecimal():
                    while w.endswith(".0"):
                        w = w[:-2]
                stop = _STOP.search(line, last, m.start()) is not None if last else False
                # A full stop within "v. 2.0" ends no sentence.
                sentence += stop and not (self.word and self.word[-1] == "v")
                last = m.end()
                joined = _JOINED.get((self.word[-1], w)) if self.word and self.line[-1] == k else None
                if joined:
                    self.word[-1], self.end[-1] = joined, m.end()
                    continue
                self.word.append("license" if w == "licence" else w)
                self.line.append(k)
                self.sentence.append(sentence)
                self.first.append(m.start())
                self.end.append(m.end())
            sentence += _STOP.search(line, last) is not None if last else 0
        w = self.word
        self.marks = [self._marks(w[k - 1] if k else "", x, w[k + 1] if k + 1 < len(w) else "") for k, x in enumerate(w)]

    @staticmethod
    def _marks(before: str, word: str, after: str) -> bool:
        if word in _NAMES:
            return True
        if word in _CC:
            return before in _CC or before == "licenses"
        return word[0].isdecimal() and (before in _VERSIONED or after == "clause")


def words(text: str) -> list[str]:
    return Words(text.split("\n")).word


class Scanner:
    def __init__(self, templates: dict[str, str]) -> None:
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.templates = [
            (name, zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)),
             [Words([v]) for v in t.split("\n")])
            for name, t in templates.items()]
        #: Runs that make a place a candidate.
        self.runs = {tuple(v.word[k : k + RUN]) for _, _, vs in self.templates for v in vs for k in range(max(1, len(v.word) - RUN + 1))}
        self.short = sorted({len(r) for r in self.runs} - {RUN})
        # Words one of which each run holds: a text without them has no run.
        seen: dict[str, int] = {}
        for r in self.runs:
            for w in {p for x in r for p in _PLAIN.findall(x)}:
                seen[w] = seen.get(w, 0) + 1
        self.anchors = {max((p for x in r for p in _PLAIN.findall(x)), key=lambda w: (len(w), -seen[w], w)) for r in self.runs}
        # Joined words are looked up by their last part.
        self.anchors |= {b for (_, b), w in _JOINED.items() if w in self.anchors} | ({"licence"} if "license" in self.anchors else set())
        self.ranked = lru_cache(4096)(self.ranked)

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(share of bytes saved, template) of each template, best first."""
        data = block.lower().encode()
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / alone, k) for k, (_, c, _) in enumerate(self.templates)), key=lambda x: (-x[0], x[1]))

    def hits(self, w: list[str]) -> list[int]:
        """Places of words in a shared run."""
        found: set[int] = set()
        for n in [*self.short, RUN]:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in self.runs:
                    found.update(range(k, k + n))
        return sorted(found)

    def spans(self, t: Words, lo: int, hi: int, k: int):
        """(confirmed, same words, differing words, first, end, one run) of the best spans of t[lo:hi] in the notices of template k."""
        mine = t.word[lo:hi]
        for v in self.templates[k][2]:
            theirs = v.word
            runs = [m for m in difflib.SequenceMatcher(None, mine, theirs, autojunk=False).get_matching_blocks() if m.size]
            sure = [x for x, m in enumerate(runs) if m.size >= min(RUN, len(theirs))]
            for s, i in enumerate(sure):
                same, different, clean = 0, 0, True
                for x in range(i, sure[-1] + 1):
                    m = runs[x]
                    if x > i:
                        p = runs[x - 1]
                        a, b = p.a + p.size, p.b + p.size
                        different += max(m.a - a, m.b - b)
                        clean &= not (any(t.marks[lo + a : lo + m.a]) or any(v.marks[b : m.b]))
                    same += m.size
                    if x in sure and different <= DIFFERENT * (same + different):
                        first, end = runs[i], m
                        yield (clean and self._edges(t, lo + first.a, lo + end.a + end.size, v, first.b, end.b + end.size),
                               same, different, lo + first.a, lo + end.a + end.size, i == x)

    @staticmethod
    def _edges(t: Words, a: int, b: int, v: Words, c: int, d: int) -> bool:
        """No identifying word in the rest of the span's first and last sentence, on either side."""
        def rest(x: Words, at: int, step: int, most: int) -> bool:
            inner, k = at - 1 if step > 0 else at + 1, at
            while 0 <= k < len(x.word) and x.sentence[k] == x.sentence[inner] and (k - at) * step < most:
                if x.marks[k]:
                    return True
                k += step
            return False
        return not (rest(t, b, 1, RUN) or rest(t, a - 1, -1, RUN) or rest(v, d, 1, len(v.word)) or rest(v, c - 1, -1, len(v.word)))

    def notice(self, t: Words, lo: int, hi: int, text: str):
        """(name, saved, same, different, first, end, one run) of the region's best-ranked confirmed notice, or None."""
        grams = {tuple(t.word[k : k + n]) for n in [*self.short, RUN] for k in range(lo, hi - n + 1)} & self.runs
        found = []
        for saved, k in self.ranked(text):
            if not any(tuple(v.word[x : x + RUN]) in grams for v in self.templates[k][2] for x in range(max(1, len(v.word) - RUN + 1))):
                continue
            good = [s for s in self.spans(t, lo, hi, k) if s[0]]
            if good:
                found.append((self.templates[k][0], saved, *max(good, key=lambda s: (s[1] - s[2], -s[3]))[1:]))
        for x in found:
            # The other licences' spans that cover this one and explain it as well.
            rivals = [y for y in found if y is not x and y[4] <= x[4] and y[5] >= x[5] and y[2] - y[3] >= x[2] - x[3]]
            if not rivals:
                return x
        return None

    def scan(self, text: str) -> list[tuple]:
        """block, text, license, best, saved, n_words, n_different, exact of each notice and other candidate of a text."""
        lines = text.split("\n")
        t = Words(lines)
        where = self.hits(t.word)
        regions: list[list[int]] = []
        for p in where:
            if regions and p - regions[-1][1] <= GAP:
                regions[-1][1] = p + 1
            else:
                regions.append([p, p + 1])
        out, taken, open_words = [], {}, set()
        todo = [tuple(r) for r in reversed(regions)]
        hit = set(where)
        while todo:
            lo, hi = todo.pop()
            inside = [p for p in range(lo, hi) if p in hit]
            if not inside:
                continue
            lo, end = inside[0], inside[-1] + 1
            hi = min(end, lo + REGION)
            found = self.notice(t, lo, hi, self._text(lines, t, lo, hi))
            if found:
                name, saved, same, different, a, b, one = found
                shown = self._rows(lines, t, a, b)
                exact = one and not different and len(words(shown)) == b - a
                best = self.templates[self.ranked(shown)[0][1]][0]
                out.append((t.line[a], shown, name, best, round(saved, 4), same + different, different, exact))
                for x in range(t.line[a], t.line[b - 1] + 1):
                    ends = (t.first[a] if x == t.line[a] else 0, t.end[b - 1] if x == t.line[b - 1] else len(lines[x]))
                    taken.setdefault(x, []).append(ends)
                todo += [(b, end), (lo, a)]
            else:
                cut = hi if hi == end else lo + REGION // 2
                open_words.update(p for p in inside if p < cut)
                todo.append((cut, end))
        # Candidates that no template confirms: neighbouring lines in one row.
        free = sorted(({k for k, line in enumerate(lines) if _CUES.search(line)} | {t.line[p] for p in open_words}) - set(taken))
        groups: list[list[int]] = []
        for k in free:
            if groups and k == groups[-1][1] + 1:
                groups[-1][1] = k
            else:
                groups.append([k, k])
        rest = [(a, "\n".join(lines[a : b + 1])) for a, b in groups]
        # What a long line holds beside its notices.
        for k, ends in taken.items():
            if len(lines[k]) > LONG:
                ends = sorted(ends)
                places = [t.first[p] for p in open_words if t.line[p] == k]
                for lo, hi in zip([0, *[e for _, e in ends]], [*[b for b, _ in ends], len(lines[k])]):
                    part = lines[k][lo:hi].strip()
                    if part and (_CUES.search(part) or any(lo <= p < hi for p in places)):
                        rest.append((k, part))
        for a, shown in rest:
            (saved, k), *_ = self.ranked(shown) if len(shown) <= LONG else self.ranked.__wrapped__(shown)
            if saved < GAIN and not _CUES.search(shown):
                continue
            same, different = self._nearest(Words(shown.split("\n")), k)
            out.append((a, shown, None, self.templates[k][0], round(saved, 4), same + different, different, False))
        return sorted(out, key=lambda r: r[0])

    @staticmethod
    def _text(lines: list[str], t: Words, a: int, b: int) -> str:
        """The text of words a to b."""
        x, y = t.line[a], t.line[b - 1]
        if x == y:
            return lines[x][t.first[a] : t.end[b - 1]]
        return "\n".join([lines[x][t.first[a] :], *lines[x + 1 : y], lines[y][: t.end[b - 1]]])

    def _rows(self, lines: list[str], t: Words, a: int, b: int) -> str:
        x, y = t.line[a], t.line[b - 1]
        if max(len(lines[x]), len(lines[y])) > LONG:
            return self._text(lines, t, a, b)
        return "\n".join(lines[x : y + 1])

    def _nearest(self, t: Words, k: int) -> tuple[int, int]:
        """(same, differing) words of the best span of all of t in a notice of template k. Windows of REGION
        words overlap by half, more than a span of the longest notice can take."""
        runs = {tuple(v.word[x : x + RUN]) for v in self.templates[k][2] for x in range(max(1, len(v.word) - RUN + 1))}
        sizes = {len(r) for r in runs}
        places = [p for p in range(len(t.word)) if any(tuple(t.word[p : p + n]) in runs for n in sizes)]
        best = (0, 0)
        for lo in sorted({max(0, p // (REGION // 2) - x) * (REGION // 2) for p in places for x in (0, 1)}):
            if lo and lo + REGION // 2 >= len(t.word):
                continue  # the window before holds it
            for s in self.spans(t, lo, min(len(t.word), lo + REGION), k):
                best = max(best, (s[1], s[2]), key=lambda s: s[0] - s[1])
        return best


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(templates: dict[str, str]) -> Scanner:
    key = tuple(templates.items())
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(templates)
    return _SCANNERS[key]


def license_blocks(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, block (first line), text of the block, license, best, saved, n_words, n_different, exact."""
    templates = templates or TEMPLATES
    schema = "doc_id long, block int, text string, license string, best string, saved double, n_words int, n_different int, exact boolean"
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        scanner = _scanner(templates)
        for batch in batches:
            for part in slices(batch):
                out = []
                for doc, text, cue in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if cue or not scanner.anchors.isdisjoint(_PLAIN.findall(text.lower())):
                        out += [(doc, *r) for r in scanner.scan(text)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, kinds)], names)

    return docs.where("length(text) > 0").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("text").rlike(CUES).alias("cue")).mapInArrow(run, schema)
