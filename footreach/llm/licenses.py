"""License scans with a generalised suffix automaton of licence tokens.

The templates' and names' word sequences make one suffix automaton (a state per class of substrings with the same end places). A
text is streamed through it word by word: after each word the state and the length of the longest suffix that some
template contains are known (matching statistics), in constant time per word on average. Names and base phrases stand
where their state is an ancestor of the current one and is not longer than the match, so their places come out of the same pass; they are
taken exactly, and a name inside a longer one (`cc by nc` in `cc by nc sa`) does not count. The base phrases' places always do.

Where matches of `MIN_MATCH` words lie, all common runs of text and template of that length are taken from the states and
their suffix links. Per template the heaviest chain of runs is found, in the order of both, with gaps of at most `MAX_GAP`
words in either. A template's words weigh ln(1 + templates / templates with the word), so words that all licences share
count little. A chain that covers `MIN_COVER` of the weight and the whole of the template's key (the words that tell its
licence from others') is a span; of spans of different licences on the same words the heavier one stays.

Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased.

Defined cases: null and empty texts have no words, labels "" and score 0; positions are null where there is no base
place; repeated rows stay; other columns are ignored. No shuffle; the automaton is built from the templates in each
worker and holds at most two states a template word.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from footreach.llm.batches import ALNUM, lower_bytes, small_batches

MIN_MATCH, MAX_GAP, MIN_COVER = 3, 4, 0.6
#: Base phrases and their labels (fixed values).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
_VARIANTS = {"cc-by-sa": ("sa", "sharealike"), "cc-by-nc": ("nc", "noncommercial"), "cc-by-nd": ("nd", "noderivatives"),
             "cc-by-nc-sa": ("nc sa", "noncommercial sharealike"), "cc-by-nc-nd": ("nc nd", "noncommercial noderivatives")}
#: Names that say a licence wherever they stand: (label, words).
NAMES = (
    ("lgpl", "gnu lesser general public license"), ("lgpl", "gnu library general public license"), ("agpl", "gnu affero general public license"), ("gpl", "gnu gpl"),
    ("mpl", "mozilla public license"), ("epl", "eclipse public license"), ("bsd", "bsd license"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("isc", "isc license"),
    ("boost", "boost software license"), ("zlib", "zlib license"), ("unlicense", "the unlicense"), ("cc-by", "creative commons attribution"), ("cc0", "cc0 1 0"),
    *[(label, f"{start} {words}") for label, (short, long) in _VARIANTS.items() for start, words in (("cc by", short), ("attribution", long), ("creative commons attribution", long))],
)
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
_GNU = ("this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1} as published by the free software foundation either version {2} of the license "
        "or at your option any later version")
_GNU_REST = ("this {0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
             "see the gnu {1} for more details you should have received a copy of the gnu {1} along with this {0}")
#: (label, key, text): licences and their notices, part by part as words; a span must hold the key.
TEMPLATES = (
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "gnu general public license", _GNU.format("program", "general public license", "3")),
    ("gpl", "gnu general public license", _GNU_REST.format("program", "general public license")),
    ("lgpl", "lesser general public license", _GNU.format("library", "lesser general public license", "2 1")),
    ("lgpl", "lesser general public license", _GNU_REST.format("library", "lesser general public license")),
    ("agpl", "affero general public license", _GNU.format("program", "affero general public license", "3")),
    ("agpl", "affero general public license", _GNU_REST.format("program", "affero general public license")),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "see the license for the specific language governing permissions", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
     "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "to deal in the software without restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
     "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
     "furnished to do so subject to the following conditions"),
    ("mit", "to deal in the software without restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _AS_IS
     + "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
     "connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions in binary form must reproduce", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must "
     "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "to endorse or promote products", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
     "permission notice appear in all copies"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "altered source versions must be plainly marked", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
     "following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such"),
    ("boost", "machine executable object code generated by a source language processor", "the copyright notices in the software and this entire statement including the above license grant this restriction and the following "
     "disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable "
     "object code generated by a source language processor"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
     "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("unlicense", "unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "may be reproduced", "all rights reserved no part of this publication may be reproduced"),
)


class SuffixAutomaton:
    """Generalised suffix automaton over words, with the end places of every state.

    templates: (label, key words, words); phrases and names: (label, words), sequences of the automaton taken only as a whole.
    """

    def __init__(self, templates: list[tuple[str, list[bytes], list[bytes]]], phrases: list[tuple[str, list[bytes]]], names: list[tuple[str, list[bytes]]] = ()) -> None:
        self.n_templates = len(templates)
        self.labels = [label for label, *_ in templates]
        texts = [words for *_, words in templates]
        having: dict[bytes, int] = {}
        for words in texts:
            for w in set(words):
                having[w] = having.get(w, 0) + 1
        #: Weight of the first n words of each template.
        self.weight = [[0.0] for _ in texts]
        for k, words in enumerate(texts):
            for w in words:
                self.weight[k].append(self.weight[k][-1] + math.log(1 + len(texts) / having[w]))
        self.keys = [[set(range(p, p + len(key))) for p in range(len(words) - len(key) + 1) if words[p:p + len(key)] == key] for _, key, words in templates]
        sequences = texts + [words for _, words in (*phrases, *names)]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.word: dict[bytes, int] = {}
        self.texts: list[list[int]] = []
        for k, words in enumerate(sequences):
            last = 0
            self.texts.append([self.word.setdefault(w, len(self.word)) for w in words])
            for p, w in enumerate(self.texts[-1]):
                last = self._extend(last, w)
                self.ends[last].add((k, p))
        deepest = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in deepest:
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]
        self.phrases, self.names = self._ending(deepest, phrases), self._ending(deepest, names)

    def _ending(self, deepest: list[int], said: list[tuple[str, list[bytes]]]) -> list[list[tuple[int, str]]]:
        """Per state the (size, label) of the sequences that its longest string ends with."""
        own: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for label, words in said:
            s = 0
            for w in words:
                s = self.next[s][self.word[w]]
            own[s].append((len(words), label))
        out: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for s in reversed(deepest):
            out[s] = own[s] + (out[self.link[s]] if self.link[s] > 0 else [])
        return out

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of the strings that p's strings make with the word; a state of its own if they are not the longest there."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._new(self.length[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        s, p = self._new(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = s
            p = self.link[p]
        self.link[s] = 0 if p < 0 else self._split(p, word)
        return s

    def _step(self, state: int, size: int, word: int) -> tuple[int, int]:
        """State and size of the longest suffix that is in the automaton after one more word."""
        to = self.next[state].get(word)
        while to is None and state:
            state = self.link[state]
            size, to = self.length[state], self.next[state].get(word)
        return (0, 0) if to is None else (to, size + 1)

    def stream(self, words: list[bytes], names: list[tuple[int, int, str]] | None = None) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """(base places as (start, label), right-maximal matches as (end, length, state)) of a text; `names` takes (start, size, label) in."""
        base: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []
        nexts, phrases, named = self.next, self.phrases, self.names
        state = size = 0
        before = -2
        get = self.word.get
        for i, w in [(i, x) for i, x in enumerate(map(get, words)) if x is not None]:
            if i != before + 1:
                if size >= MIN_MATCH:
                    matches.append((before, size, state))
                state = size = 0
            to = nexts[state].get(w)
            if to is None:
                if size >= MIN_MATCH:
                    matches.append((i - 1, size, state))
                state, size = self._step(state, size, w)
            else:
                state, size = to, size + 1
            before = i
            if phrases[state]:
                base += [(i - n + 1, label) for n, label in phrases[state] if n <= size]
            if names is not None and named[state]:
                names += [(i - n + 1, n, label) for n, label in named[state] if n <= size]
        if size >= MIN_MATCH:
            matches.append((before, size, state))
        return base, matches

    def runs(self, matches: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """Per template all maximal common runs of at least MIN_MATCH words: (last word in the text, last in the template, size)."""
        known: dict[int, int] = {}
        for end, size, state in matches:
            k, p = next(iter(self.ends[state]))
            for j in range(size):
                known[end - j] = self.texts[k][p - j]
        out: dict[int, list[tuple[int, int, int]]] = {}
        open_runs: dict[tuple[int, int], int] = {}  # (template, place) of the word before -> size
        state = size = 0
        before = -2
        for i in [*sorted(known), None]:
            now: dict[tuple[int, int], int] = {}
            if i is not None:
                if i != before + 1:
                    state = size = 0
                state, size = self._step(state, size, known[i])
                s, n = state, size
                while n >= MIN_MATCH:
                    for place in self.ends[s]:
                        if place[0] < self.n_templates:
                            now.setdefault(place, n)
                    s = self.link[s]
                    n = self.length[s]
            for (k, p), n in open_runs.items():
                if i != before + 1 or (k, p + 1) not in now:
                    out.setdefault(k, []).append((before, p, n))
            open_runs, before = now, i if i is not None else before
        return out

    def best_chain(self, k: int, runs: list[tuple[int, int, int]]) -> tuple[float, list[tuple[int, int, int]]]:
        """(weight, runs cut to what each adds) of the heaviest chain in template k; the earliest one on ties. runs by last word."""
        runs = sorted(runs)
        ends = [r[0] for r in runs]
        weight = self.weight[k]
        value, via, added = [], [], []
        for j, (end, p, size) in enumerate(runs):
            best, prev, own = weight[p + 1] - weight[p + 1 - size], -1, size
            for i in range(bisect_left(ends, end - size - MAX_GAP), j):
                e, q, _ = runs[i]
                if e < end and q < p:
                    n = min(size, end - e, p - q)
                    if end - n - e <= MAX_GAP and p - n - q <= MAX_GAP and value[i] + weight[p + 1] - weight[p + 1 - n] > best:
                        best, prev, own = value[i] + weight[p + 1] - weight[p + 1 - n], i, n
            value.append(best)
            via.append(prev)
            added.append(own)
        at = max(range(len(runs)), key=lambda j: (value[j], -j))
        top, chain = value[at], []
        while at >= 0:
            chain.append((runs[at][0], runs[at][1], added[at]))
            at = via[at]
        return top, chain[::-1]

    def spans(self, matches: list[tuple[int, int, int]]) -> tuple[list[tuple[str, int, int, float]], float]:
        """(label, first word, last word, coverage) of chains that cover enough, and the best coverage of any chain."""
        found, best = [], 0.0
        for k, runs in sorted(self.runs(matches).items()):
            while runs:  # the best chain, then the best of what it leaves
                value, chain = self.best_chain(k, runs)
                first, last = chain[0][0] - chain[0][2] + 1, chain[-1][0]
                share = min(1.0, value / self.weight[k][-1])
                best = max(best, share)
                if share < MIN_COVER:
                    break
                covered = {p for _, q, n in chain for p in range(q - n + 1, q + 1)}
                if any(key <= covered for key in self.keys[k]):
                    found.append((value, self.labels[k], first, last, share))
                runs = [r for r in runs if r[0] < first or r[0] - r[2] + 1 > last]
        out: list[tuple[str, int, int, float]] = []
        for _, label, first, last, share in sorted(found, key=lambda s: (-s[0], s[2], s[1])):
            if not any(first <= b and a <= last for _, a, b, _ in out):
                out.append((label, first, last, share))
        return sorted(out, key=lambda s: (s[1], s[2], s[0])), best


def longest_names(names: list[tuple[int, int, str]]) -> list[tuple[str, int, int, float]]:
    """Names as spans, without those inside a longer one."""
    kept = {(a, n, label) for a, n, label in names if not any(b <= a and a + n <= b + m and m > n for b, m, _ in names)}
    return [(label, a, a + n - 1, 1.0) for a, n, label in sorted(kept)]


def automaton(templates=TEMPLATES, phrases=PHRASES, names=NAMES) -> SuffixAutomaton:
    split = lambda text: ALNUM.findall(lower_bytes(text))
    return SuffixAutomaton([(label, split(key), split(text)) for label, key, text in templates], [(label, split(text)) for text, label in phrases],
                           [(label, split(text)) for label, text in names])


SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
          "spans array<struct<label:string,first:int,last:int,coverage:double>>")


def license_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, names=NAMES) -> DataFrame:
    """One row per row: base places, labels, best coverage and the covered spans."""
    columns = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
    kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("coverage", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(templates, phrases, names)
        for ids, texts in small_batches(batches):
            rows = []
            for t in texts:
                words = ALNUM.findall(lower_bytes(t))
                said: list[tuple[int, int, str]] = []
                base, matches = machine.stream(words, said)
                spans, best = machine.spans(matches) if matches else ([], 0.0)
                if said:
                    spans, best = sorted(set(spans) | set(longest_names(said)), key=lambda s: (s[1], s[2], s[0])), 1.0
                own = {label for _, label in base}
                starts = [s for s, _ in base]
                rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
                             ",".join(sorted(own | {s[0] for s in spans})), 1.0 if base else best,
                             [{"label": a, "first": f, "last": e, "coverage": c} for a, f, e, c in spans]))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=columns)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(scan, SCHEMA)


def op5(spark, sf_dir: str) -> DataFrame:
    return license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
