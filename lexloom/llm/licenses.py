"""Licence scan: a generalised suffix automaton over the tokens of licence templates.

Each text streams through the automaton once. The matching statistics (the longest template
substring that ends at each word) mark the base phrases, which are templates themselves, and
yield long matches; matches of one template are chained in order into covered spans, and a
template whose covered share reaches MIN_COVER adds its label.

Null texts count as empty: no words, null positions, empty labels, score 0. Words that no
template has reset the automaton. Repeated rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from lexloom.llm.base import per_text

#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Well-known sentences of public licence texts, as words.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
}
#: Whole public licence texts without their copyright lines, as words.
WHOLE = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
}
MIN_MATCH = 4  # words of a match that may be chained
MIN_COVER = 0.5  # covered share of a template that earns its label
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Automaton:
    """Suffix automaton of several token sequences; each state keeps where its strings first end."""

    def __init__(self, sequences: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].append((k, i))
        order = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for s in order:  # ends of longer strings are ends of their suffixes
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})
        self.vocabulary = frozenset(t for sequence in sequences for t in sequence)

    def _state(self, length: int, nxt: dict[str, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: str) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: str) -> int:
        if token in self.next[last]:  # an earlier sequence has it
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def locate(self, sequence: list[str]) -> int:
        s = 0
        for token in sequence:
            s = self.next[s][token]
        return s


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, *templates: dict[str, str]):
        named = [(label, text) for t in templates or (TEMPLATES, WHOLE) for label, text in t.items()]
        self.labels = [*base.values(), *(label for label, _ in named)]
        self.words = [p.split() for p in [*base, *(text for _, text in named)]]
        self.n_base = len(base)
        self.sam = a = Automaton(self.words)
        at = {a.locate(w): (k, len(w)) for k, w in enumerate(self.words[: self.n_base])}
        self.phrases: list[list[tuple[int, int]]] = []  # base phrases that are suffixes of a state's strings
        for s in range(len(a.length)):
            found, up = [], s
            while up > 0:
                if up in at:
                    found.append(at[up])
                up = a.link[up]
            self.phrases.append(found)

    def runs(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Stretches of two words or more that templates have."""
        known, start = self.sam.vocabulary, -1
        if known.isdisjoint(words):
            return
        for i, w in enumerate(words):
            if w in known:
                if start < 0:
                    start = i
            elif start >= 0:
                if i - start > 1:
                    yield start, i
                start = -1
        if 0 <= start < len(words) - 1:
            yield start, len(words)

    def scan(self, text: str | None) -> tuple:
        words = _WORD.findall((text or "").translate(_LOWER))
        a, base, matches = self.sam, [], []
        for start, stop in self.runs(words):
            state = length = 0
            for i in range(start, stop):
                w = words[i]
                if w in a.next[state]:
                    state, length = a.next[state][w], length + 1
                else:
                    if length >= MIN_MATCH:
                        matches.append((i - length, length, state))
                    while state and w not in a.next[state]:
                        state = a.link[state]
                        length = a.length[state]
                    if w in a.next[state]:
                        state, length = a.next[state][w], length + 1
                    else:
                        state = length = 0
                base += [(i + 1 - n, k) for k, n in self.phrases[state] if n <= length]
            if length >= MIN_MATCH:
                matches.append((stop - length, length, state))
        spans = self.chain(matches)
        mine = {self.labels[k] for _, k in base}
        more = {label for label, share, _, _ in spans if share >= MIN_COVER}
        starts = [s for s, _ in base]
        score = 1.0 if base else max([0.0, *(share for _, share, _, _ in spans)])
        return (
            len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(mine)), ",".join(sorted(mine | more)), score, spans,
        )

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, float, int, int]]:
        """(label, covered share, first word, end word) of each template's best chain of matches.

        A chain's matches follow one another, without overlap, in the text and in the template,
        and no stretch of the text longer than the template lies between two matches of it. The
        best chain covers most words; of several the one that starts first, then ends first.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, n, state in matches:
            for k, end in self.sam.ends[state]:
                if k >= self.n_base and end + 1 >= n:
                    by.setdefault(k, []).append((start, end + 1 - n, n))
        out = []
        for k, found in sorted(by.items()):
            size, best, reach = len(self.words[k]), (0, 0, 0), None
            tree: list[tuple[int, int]] = []
            waiting: list[tuple] = []
            for start, at, n in sorted(found):
                if reach is None or start - reach > size:  # a new stretch
                    tree, waiting, reach = [(0, 0)] * (size + 1), [], start
                reach = max(reach, start + n)
                while waiting and waiting[0][0] <= start:  # chains that end before this match
                    _, place, value = heapq.heappop(waiting)
                    while place <= size:
                        tree[place] = max(tree[place], value)
                        place += place & -place
                covered, first, place = 0, -start, at  # the best chain that ends at or before `at` in the template
                while place:
                    if tree[place][0] and tree[place] > (covered, first):
                        covered, first = tree[place]
                    place -= place & -place
                value = (covered + n, first)
                heapq.heappush(waiting, (start + n, at + n, value))
                best = max(best, (*value, -(start + n)))
            out.append((self.labels[k], best[0] / size, -best[1], -best[2]))
        return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,share:double,first:long,end:long>>"


def scan_licenses(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each text."""

    def make():
        scanner = Scanner()

        def scan(texts):
            columns = list(zip(*map(scanner.scan, texts)))
            columns[-1] = [[dict(zip(("label", "share", "first", "end"), s)) for s in x] for x in columns[-1]]
            return columns

        return scan

    return per_text(docs, key, SCHEMA, make)
