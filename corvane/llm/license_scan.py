"""Licence scans: matching statistics of documents against a suffix automaton of licence texts.

Words are maximal runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. All templates
and phrases go into one generalised suffix automaton over words (a few thousand states; its size is
that of the templates and not of the data). A document is streamed through it piece by piece: at every word the automaton
gives the longest stretch ending there that any template holds. A stretch that can't be
extended and has ``MIN_MATCH`` words or more is a match, with its places in each template.
Matches of one template are chained while they go on in the template and lie within
``MAX_GAP`` words of each other in the document; a chain is a span of that template, and a span that covers
``MIN_COVERAGE`` of the template's words gives its label. So a licence with changed names or words is
found as well as a whole one.

Phrases are exact: one ends at a word if its state is on the path of suffix links and the match
is as long as the phrase.

A row gives a row, whatever its id; null and empty texts have no words. A document of any length is read in
pieces of a megabyte, over whose borders the automaton's state is carried. Other columns are not used.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import strings

MIN_MATCH = 3
MAX_GAP = 12
MIN_COVERAGE = 0.8

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and operative passages of licences, as published, by label.
TEMPLATES = {
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
}

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PIECE = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """A generalised suffix automaton of word lists, with where each state's stretches end in each of them."""

    def __init__(self, templates: list[list[bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.coded = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in t] for t in templates]
        for codes in self.coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.ends: list[dict[int, list[int]]] = [{} for _ in self.link]
        for t, codes in enumerate(self.coded):
            at = 0
            for end, c in enumerate(codes, 1):
                at = self.next[at][c]
                state = at
                while state > 0:
                    self.ends[state].setdefault(t, []).append(end)
                    state = self.link[state]

    def _clone(self, p: int, q: int, c: int) -> int:
        """A state for the shorter stretches of q, reached from p by c."""
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:  # another template has this prefix
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, c)
        new = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def state_of(self, words: list[bytes]) -> int:
        at = 0
        for w in words:
            at = self.next[at][self.vocabulary[w]]
        return at

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """Matching statistics: the longest stretch that ends with word c, after one of ``matched`` words at ``state``."""
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        found = self.next[state].get(c)
        return (0, 0) if found is None else (found, matched + 1)


class Chain:
    """Matches that follow each other in a document and in a template."""

    __slots__ = ("first", "end", "reached", "covered")

    def __init__(self, first: int, end: int, reached: int, covered: int):
        self.first, self.end, self.reached, self.covered = first, end, reached, covered


class Scanner:
    """Reads documents one after the other; picklable, made once on the driver from templates and phrases."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        flat = [(label, words_of(t.encode())) for label, texts in templates.items() for t in texts]
        flat += [(label, words_of(p.encode())) for p, label in phrases.items()]
        self.labels, self.sizes = [x[0] for x in flat], [len(x[1]) for x in flat]
        self.automaton = SuffixAutomaton([x[1] for x in flat])
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.automaton.link]  # of each state: the phrases that end with it
        own = {self.automaton.state_of(words_of(p.encode())): (len(words_of(p.encode())), label) for p, label in phrases.items()}
        for state in range(len(self.phrases)):
            at = state
            while at > 0:
                if at in own:
                    self.phrases[state].append(own[at])
                at = self.automaton.link[at]

    def scan(self, text: bytes) -> dict:
        """Words, places of phrases as (first word, label), and spans as (first word, words, template, coverage)."""
        get, a = self.automaton.vocabulary.get, self.automaton
        places: list[tuple[int, str]] = []
        self._open, self._spans = {}, []
        base = state = matched = at = 0
        whole = text.translate(_WORD_BYTES) if len(text) <= _PIECE else None
        while at < len(text):
            if whole is not None:
                piece, at = whole, len(text)
            else:
                piece = text[at : at + _PIECE].translate(_WORD_BYTES)
                if at + _PIECE < len(text):
                    rest = text[at + len(piece) : at + len(piece) + _PIECE].translate(_WORD_BYTES)
                    while rest and b" " not in rest:  # a word of over a megabyte
                        piece += rest
                        rest = text[at + len(piece) : at + len(piece) + _PIECE].translate(_WORD_BYTES)
                    piece += rest[: rest.find(b" ")] if rest else b""
                at += len(piece)
            words = piece.split()
            codes = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
            known = np.flatnonzero(np.diff(np.r_[False, codes > 0, False].astype(np.int8)))
            if state and (not len(known) or known[0] > 0) and len(words):
                self._match(base - 1, state, matched)
                state = matched = 0
            for lo, hi in known.reshape(-1, 2).tolist():
                if hi - lo < 2 and 0 < lo and hi < len(words):
                    continue  # one word between unknown ones is no phrase and no match
                for i, c in enumerate(codes[lo:hi].tolist(), base + lo):
                    before, length = state, matched
                    state, matched = a.step(state, matched, c)
                    if matched != length + 1 and length:
                        self._match(i - 1, before, length)
                    for n, label in self.phrases[state]:
                        if matched >= n:
                            places.append((i - n + 1, label))
                if hi < len(words):
                    self._match(base + hi - 1, state, matched)
                    state = matched = 0
            base += len(words)
        self._match(base - 1, state, matched)
        for t in list(self._open):
            self._close(t)
        return {"n_words": base, "places": places, "spans": sorted(self._spans)}

    def _match(self, last: int, state: int, n: int) -> None:
        """A stretch of n words up to the word ``last``: appended to the chain of each template that holds it."""
        if n < 2:
            return
        first = last - n + 1
        for t, ends in self.automaton.ends[state].items():
            if n < min(MIN_MATCH, self.sizes[t]):
                continue
            chain = self._open.get(t)
            if chain is not None and first - chain.end <= MAX_GAP:
                at = bisect_left(ends, max(chain.reached + 1, n))
                if at < len(ends):
                    end = ends[at]
                    chain.covered += min(n, end - chain.reached)
                    chain.end, chain.reached = last + 1, end
                    continue
                if n <= chain.covered:
                    continue  # an inner repetition that goes back in the template
            if chain is not None:
                self._close(t)
            self._open[t] = Chain(first, last + 1, ends[0], n)

    def _close(self, t: int) -> None:
        chain = self._open.pop(t)
        self._spans.append((chain.first, chain.end - chain.first, t, min(1.0, chain.covered / self.sizes[t])))


def _scan(scanner: Scanner, min_coverage: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("coverage", pa.float64())]))
        places_type = pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            words, places, spans, score = [], [], [], []
            for text in strings(batch.column("text")):
                found = scanner.scan(text)
                words.append(found["n_words"])
                places.append([{"first_word": i, "label": x} for i, x in found["places"]])
                spans.append([{"label": scanner.labels[t], "first_word": i, "n_words": n, "coverage": c} for i, n, t, c in found["spans"] if c >= min_coverage])
                score.append(max((c for *_, c in found["spans"]), default=0.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(places, places_type), pa.array(spans, spans_type), pa.array(score, pa.float64())], ["doc_id", "n_words", "places", "spans", "score"])

    return scan


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, n_words, places, spans, score): places of phrases, covered spans of templates, and the highest coverage of any template."""
    scanner = Scanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_scan(scanner, min_coverage), "doc_id long, n_words long, places array<struct<first_word:long,label:string>>, spans array<struct<label:string,first_word:long,n_words:long,coverage:double>>, score double")


def license_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row a document."""
    starts, base, own = F.col("places.first_word"), F.col("places.label"), F.col("spans.label")
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return license_scan(docs).select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), "score")
