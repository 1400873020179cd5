"""Operator 10. License scans by a generalised suffix automaton of licence tokens.

Template texts are token sequences. One automaton over all of them recognises every
token string that occurs in any template. A file streams through it; after each word
it knows the longest suffix of what was read that occurs in a template (matching
statistics). Maximal long matches of one template are chained in order, and a chain
that covers enough of its template is a span with that template's label. Base
phrases are templates too: a place is where the match length reaches the phrase's
and the state lies on the phrase.

Words that occur in no template reset the automaton, so only runs of template words
are stepped through; those are found by vectorised word hashes.

Defined cases: null text is empty: no words, no labels, score 0; rows are
independent, so repeated rows and null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.llm import textkit as tk
from pageloom.runtime import ship

WORD_BYTES = tk.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

# Phrases and labels of the base.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Public licences, whole, and notices of others, by label.
WHOLE = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no "
        "event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action "
        "of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the "
        "above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express "
        "or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use "
        "data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way "
        "out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is "
        "granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of "
        "this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation "
        "would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be "
        "removed or altered from any source distribution",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
        "licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions "
        "of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of "
        "the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this "
        "program if not see http www gnu org licenses",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as "
        "a compiled binary for any purpose commercial or non commercial and by any means",
    ),
)
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc-by-nd", "licensed under cc by nd 4.0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "may not be copied reproduced or distributed without the prior written permission of"),
)
TEMPLATES = NOTICES + WHOLE


def words_of(text: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


class SuffixAutomaton:
    """Of several token sequences. ``ends[state]``: (sequence, end position) pairs of the state's strings, first occurrences in each sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for k, tokens in enumerate(sequences):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((k, i))
        # what ends at a state ends at its suffix links too
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        self.ends[0] = set()

    def _new(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, q)
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        state, p = self._new(self.length[last] + 1), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][token]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return state

    def stream(self, tokens) -> list[tuple[int, int]]:
        """Matching statistics: (state, length of the longest match that ends here) after each token."""
        state, size, out = 0, 0, []
        step, link, length = self.next, self.link, self.length
        for t in tokens:
            while state and t not in step[state]:
                state = link[state]
                size = length[state]
            if t in step[state]:
                state = step[state][t]
                size += 1
            out.append((state, size))
        return out


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES, least_match: int = 3, coverage: float = 0.8, gap: int = 3):
        self.base, self.templates = base, templates
        self.least, self.coverage, self.gap = least_match, coverage, gap
        texts = [words_of(p) for p, _ in base] + [words_of(t) for _, t in templates]
        self.vocabulary = sorted({w for t in texts for w in t})
        ids = {w: k for k, w in enumerate(self.vocabulary)}
        self.sequences = [[ids[w] for w in t] for t in texts]
        self.labels = [label for _, label in base] + [label for label, _ in templates]
        # templates by their last word: one that is part of a longer one is found whole, too
        self.by_last: dict[int, list[int]] = {}
        for k in range(len(base), len(self.sequences)):
            self.by_last.setdefault(self.sequences[k][-1], []).append(k)
        self.shortest = min([least_match, *map(len, self.sequences[: len(base)])])
        self.automaton = SuffixAutomaton(self.sequences)
        raw = [w.encode() for w in self.vocabulary]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        hashes = tk.span_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds[:-1], bounds[1:])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Vocabulary ids of words, -1 for others; equal hashes are compared byte by byte."""
        hashes = tk.span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == hashes, self.order[at], -1)
        for i in np.flatnonzero(out >= 0).tolist():
            if data[starts[i] : ends[i]].tobytes() != self.vocabulary[out[i]].encode():
                out[i] = -1
        return out

    def matches(self, tokens: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Of a run of vocabulary words: base places (phrase, start), and maximal matches (template, its end position, start, end in the run)."""
        places, found = [], []
        stats = self.automaton.stream(tokens)
        for i, (state, size) in enumerate(stats):
            if size < self.shortest:
                continue
            ends = self.automaton.ends[state]
            for b in range(len(self.base)):
                n = len(self.sequences[b])
                # the longest match may be longer than the phrase: its suffix of n words lies on a suffix link
                if size >= n and tokens[i - n + 1 : i + 1] == self.sequences[b]:
                    places.append((b, i - n + 1))
            for k in self.by_last.get(tokens[i], ()):
                n = len(self.sequences[k])
                if size >= n and tokens[i - n + 1 : i + 1] == self.sequences[k]:
                    found.append((k, n - 1, i - n + 1, i + 1))
            if size >= self.least and (i + 1 == len(stats) or stats[i + 1][1] <= size):
                found += [(k, end, i - size + 1, i + 1) for k, end in ends if k >= len(self.base)]
        return places, found

    def chain(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Matches (template, end position there, start, end in the text) to spans (template, start, end, coverage), in order and near each other."""
        spans = []
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for k, end, a, b in found:
            by_template.setdefault(k, []).append((a, b, end))
        for k, parts in sorted(by_template.items()):
            size = len(self.sequences[k])
            best: list[tuple[int, int, int, int, int]] = []  # covered, start of the chain, own start, end, end in the template
            for a, b, end in sorted(parts):
                covered, start = b - a, a
                for c, s, own, e, t in reversed(best):
                    if a - own > self.gap + size:
                        break
                    if 0 <= a - e <= self.gap and t <= end - (b - a) and c + b - a > covered:
                        covered, start = c + b - a, s
                best.append((covered, start, a, b, end))
            taken: list[tuple[int, int]] = []
            for covered, start, _, end, _ in sorted((x for x in best if x[0] >= self.coverage * size), key=lambda x: (-x[0], x[1])):
                if all(end <= s or start >= e for s, e in taken):
                    taken.append((start, end))
                    spans.append((k, start, end, min(1.0, covered / size)))
        return sorted(spans, key=lambda x: (x[1], x[2], x[0]))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, base places, and covered template spans.

    base: array of (label, word); spans: array of (label, start, end, coverage), words from 0, end exclusive.
    """
    ship(docs.sparkSession)
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    @tk.releasing
    def rows(batches):
        scanner = Scanner()
        for batch, data, offs in tk.slices(batches, text_col):
            data = tk.lower_ascii(data)
            starts, ends = tk.runs(WORD_BYTES[data], offs)
            bounds = tk.row_bounds(starts, offs)
            ids = scanner.ids(data, starts, ends)
            known = np.flatnonzero(ids >= 0)
            row = np.searchsorted(bounds, known, side="right") - 1
            first = np.flatnonzero(np.concatenate([[True], (np.diff(known) != 1) | (np.diff(row) != 0)])) if len(known) else np.empty(0, np.int64)
            stop = np.append(first[1:], len(known))
            base: list[list] = [[] for _ in range(batch.num_rows)]
            found: list[list] = [[] for _ in range(batch.num_rows)]
            long = stop - first >= scanner.shortest
            for a, b in zip(first[long].tolist(), stop[long].tolist()):
                r = int(row[a])
                at = int(known[a] - bounds[r])
                places, matches = scanner.matches(ids[known[a:b]].tolist())
                base[r] += [{"label": scanner.labels[k], "word": at + i} for k, i in places]
                found[r] += [(k, e, at + x, at + y) for k, e, x, y in matches]
            spans = [[{"label": scanner.labels[k], "start": s, "end": e, "coverage": c} for k, s, e, c in scanner.chain(f)] if f else [] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(base, pa.list_(place)), pa.array(spans, pa.list_(span))],
                ["doc_id", "n_words", "base", "spans"],
            )

    return docs.select(id_col, text_col).mapInArrow(rows, "doc_id long, n_words long, base array<struct<label:string,word:long>>, spans array<struct<label:string,start:long,end:long,coverage:double>>")
