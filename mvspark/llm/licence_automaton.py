"""Licences found by a generalised suffix automaton of their words.

The automaton holds every run of words of every template. A text's words go through it one by one; its state and length are the matching statistic: the longest
run that ends at this word and stands in some template. A match of LONG words or more ends for each place in a template that the next word does not continue.
Matches of one template are chained in order, with gaps of at most GAP words on both sides; a chain that covers SHARE of the template is a licence span.
The phrases looked for word by word are in the automaton as well: its states know which of them end there.

Templates are a parameter; the automaton grows with them alone and is broadcast. Texts are scanned whole, and apart from each other.

A null or empty text, and one without words, has no places, no labels and the score 0; its first and last word are null. Repeated rows are scanned each. Of overlapping spans
of a template that of the greatest share stays, the first of equals. An empty table gives no rows. Columns of added names are replaced, others are kept.
"""

import bisect
from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_text_columns
from .decontamination import words_of

#: Words of a match that counts, words between chained matches, share of a template's words that a span covers.
LONG, GAP, SHARE = 4, 8, 0.8
#: Phrases whose every place counts, with their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public licence texts and notices by label (fixed values).
TEMPLATES = (
    ("mit-notice", "Released under the MIT License"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0-notice", "licensed under the GNU General Public License, version 3"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "lgpl-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "agpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


class Automaton:
    """States of the generalised suffix automaton: transitions, suffix link, length, and where in the templates a state's runs end."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], phrases: Mapping[str, str], long: int = LONG):
        self.labels, self.sizes = [label for label, _ in templates], [len(words) for _, words in templates]
        self.phrases = [(words_of(text), label) for text, label in phrases.items()]
        every = [*[words for _, words in templates], *[words for words, _ in self.phrases]]
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for words in every for w in words), 1)}
        self.runs = [[self.ids[w] for w in words] for words in every]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for k, run in enumerate(self.runs):
            at = 0
            for i, word in enumerate(run):
                at = self._extended(at, word, ends)
                ends[at].add((k, i))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for state in reversed(order):
            ends[self.link[state]] |= ends[state]
        n = len(templates)
        #: Places (template, last word) of the states that hold runs long enough.
        self.ends = [sorted(e for e in found if e[0] < n) if size >= long else [] for found, size in zip(ends, self.length, strict=True)]
        #: Phrases that each state's runs end with.
        self.found: list[list[int]] = [[] for _ in self.link]
        for p, run in enumerate(self.runs[n:]):
            at = 0
            for word in run:
                at = self.next[at][word]
            self.found[at].append(p)
        for state in order:
            self.found[state] = self.found[state] + self.found[self.link[state]]

    def _extended(self, last: int, word: int, ends: list) -> int:
        """The state of the run of ``last`` and one word more; runs of templates before may have it."""
        if word in self.next[last]:
            to = self.next[last][word]
            return to if self.length[to] == self.length[last] + 1 else self._cloned(last, word, to, ends)
        new = self._added(self.length[last] + 1, {}, -1, ends)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._cloned(at, word, to, ends)
        return new

    def _added(self, length: int, moves: dict, link: int, ends: list) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        ends.append(set())
        return len(self.link) - 1

    def _cloned(self, at: int, word: int, to: int, ends: list) -> int:
        clone = self._added(self.length[at] + 1, dict(self.next[to]), self.link[to], ends)
        self.link[to] = clone
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def scan(self, ids: list[int], first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Phrases (start, phrase) and long matches (template, place there, place in the text, words) of a run of known words whose first is the ``first`` of its text."""
        phrases, matches = [], []
        state = size = 0
        for i, word in enumerate([*ids, 0]):
            moves = self.next[state]
            ends = self.ends[state]
            if ends:
                # The places that this word does not continue end here.
                matches += [(k, e - size + 1, first + i - size, size) for k, e in ends if e + 1 == self.sizes[k] or self.runs[k][e + 1] != word]
            while state and word not in moves:
                state = self.link[state]
                size, moves = self.length[state], self.next[state]
            if word in moves:
                state, size = moves[word], size + 1
                for p in self.found[state]:
                    n = len(self.phrases[p][0])
                    if n <= size:
                        phrases.append((first + i - n + 1, p))
        return phrases, [m for m in matches if m[3] >= LONG]


def chains(matches: list[tuple[int, int, int, int]], sizes: list[int], gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """(template, first word, last word, words covered) of chains of matches (template, place there, place in the text, words). A match joins, of the chains that it can, the one
    that covers most; chains that a gap has closed are done."""
    done, alive = [], {}
    for k, there, here, size in sorted(matches, key=lambda m: (m[2] + m[3], m[2], m[0], m[1])):
        best = (size, 0, None)
        still = []
        for chain in alive.get(k, []):
            first, here_end, there_end, covered, _ = chain
            if here - here_end > gap:
                done.append((k, first, here_end - 1, covered))
                continue
            still.append(chain)
            gained = size - max(0, here_end - here, there_end - there)
            if gained > 0 and there - there_end <= gap and (covered + gained, -first) > (best[0], best[1]):
                best = (covered + gained, -first, chain)
        still.append((best[2][0] if best[2] else here, here + size, there + size, best[0], None))
        alive[k] = still
    done += [(k, first, end - 1, covered) for k, some in alive.items() for first, end, _, covered, _ in some]
    return done


def spans(found: list[tuple[int, int, int, int]], sizes: list[int], share: float = SHARE) -> list[tuple[int, int, int, int]]:
    """Of chains those that cover enough of their template; of overlapping ones of a template the fullest, then the first, then the shortest."""
    out: list[tuple[int, int, int, int]] = []
    taken: dict[int, list[tuple[int, int]]] = {}
    for k, first, last, covered in sorted((c for c in found if c[3] >= share * sizes[c[0]]), key=lambda c: (c[0], -c[3], c[1], c[2])):
        own = taken.setdefault(k, [])  # apart from each other, in order
        at = bisect.bisect(own, (first, last))
        if (not at or own[at - 1][1] < first) and (at == len(own) or last < own[at][0]):
            own.insert(at, (first, last))
            out.append((k, first, last, covered))
    return sorted(out, key=lambda c: (c[1], c[2], c[0]))


class Scanner:
    def __init__(self, automaton: Automaton):
        self.a = automaton

    def __call__(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]], float]:
        """(words, phrases, spans, greatest covered share) of a whole text."""
        a = self.a
        words = words_of(text)
        ids = np.array([a.ids.get(w, 0) for w in words], np.int32)
        known = np.flatnonzero(ids)
        if len(known) < 2:
            return len(words), [], [], 0.0
        cuts = np.flatnonzero(np.diff(known) > 1) + 1
        starts, stops = known[np.r_[0, cuts]], known[np.r_[cuts - 1, len(known) - 1]] + 1
        phrases, matches = [], []
        for first, stop in zip(starts.tolist(), stops.tolist(), strict=True):
            if stop - first > 1:
                p, m = a.scan(ids[first:stop].tolist(), first)
                phrases += p
                matches += m
        found = chains(matches, a.sizes)
        top = max([c[3] / a.sizes[c[0]] for c in found] + [1.0] * bool(phrases), default=0.0)
        return len(words), phrases, spans(found, a.sizes), top


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
ADDED = {
    "n_words": ("bigint", pa.int64()),
    "n_base": ("bigint", pa.int64()),
    "first_word": ("bigint", pa.int64()),
    "last_word": ("bigint", pa.int64()),
    "base_labels": ("array<string>", pa.list_(pa.string())),
    "labels": ("array<string>", pa.list_(pa.string())),
    "licences": ("array<struct<label:string,first:bigint,last:bigint,share:double>>", _SPANS),
    "score": ("double", pa.float64()),
}


def licences(docs: DataFrame, text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """``docs`` with n_words; n_base, first_word and last_word of the phrases' places; base_labels; labels (those and the spans'); licences, the spans with their label, first and
    last word and covered share; and score, the greatest share of a template that the text covers (1 where a phrase stands)."""
    automaton = Automaton([(label, words_of(text)) for label, text in templates], phrases)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def make() -> Callable[[list[str | None]], dict]:
        scanner = Scanner(shared.value)
        a = scanner.a

        def f(texts: list[str | None]) -> dict:
            out: dict[str, list] = {name: [] for name in ADDED}
            for n, places, found, top in map(scanner, texts):
                base = sorted({a.phrases[p][1] for _, p in places})
                starts = [at for at, _ in places]
                row = (n, len(places), min(starts, default=None), max(starts, default=None), base, sorted({*base, *(a.labels[k] for k, *_ in found)}))
                for name, value in zip(ADDED, (*row, [{"label": a.labels[k], "first": i, "last": j, "share": c / a.sizes[k]} for k, i, j, c in found], top), strict=True):
                    out[name].append(value)
            return out

        return f

    return with_text_columns(docs, text_col, ADDED, make)


def op12_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


QUERIES = {"op12_licence_automaton": op12_licence_automaton}
ORACLE_SQL: dict[str, str] = {}
