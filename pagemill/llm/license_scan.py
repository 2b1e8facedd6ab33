"""Licence scans: matching statistics against a generalised suffix automaton, chained into template spans.

The automaton is built of the words of all templates and phrases. A text streams through it: at each word it
gives the longest run of words, ending there, that stands in some template. Words outside the
templates, and neighbours that no template holds, end every match, so only what lies between them is
walked, many stretches at a time. Long matches are chained along each template, and a chain that covers enough of its
template is a span. Memory follows a slice of a few MB, and a few bytes a word of the longest text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bytesio import LOWER, mix, slices, tidy

# Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public notices and permission texts, as their owners word them.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
     (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
     sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
     The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
     THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
     FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
     LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
     copyright notice and this permission notice appear in all copies."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
     Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
     Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
     and/or other materials provided with the distribution."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
     Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
     Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
     and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
     or promote products derived from this software without specific prior written permission."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
     of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
     distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
     permissions and limitations under the License."""),
    ("gpl-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
     Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
     Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("lgpl-3.0", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the
     Free Software Foundation; either version 3 of the License, or (at your option) any later version."""),
    ("agpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the
     Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
     obtain one at https://mozilla.org/MPL/2.0/."""),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
     the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
     redistribute it freely, subject to the following restrictions"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
     software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]

#: Bytes of words: digits, letters, all of code points from 0x80.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A template's word has this many bytes at most, so that two machine words hold it.
LONGEST = 16
#: Words of a match that is chained; words that a chain may pass over; the share of its template that a span covers.
LEAST_MATCH, GAP, COVERED = 4, 30, 0.75
#: Words that one walk takes on; a longer stretch is walked in parts that overlap by the longest template.
STRETCH = 4096


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return stretches(WORD[data])


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of words of up to 16 bytes as two machine words, exactly."""
    padded = np.concatenate([LOWER[data], np.zeros(LONGEST, np.uint8)])
    eight = np.ndarray((len(data) + 9,), np.dtype("<u8"), padded, strides=(1,))
    size = (end - start).astype(np.uint64)
    keep = lambda n: np.where(n >= 8, ~np.uint64(0), (np.uint64(1) << (np.minimum(n, np.uint64(7)) * np.uint64(8))) - np.uint64(1))
    return eight[start] & keep(size), np.where(size > 8, eight[start + 8] & keep(np.maximum(size, np.uint64(8)) - np.uint64(8)), np.uint64(0))


class Automaton:
    """A generalised suffix automaton of word sequences, its tables as arrays."""

    def __init__(self, texts: list[str], phrases: int = 0):
        raw = [t.encode() for t in texts]
        cut = [words_of(np.frombuffer(r, np.uint8)) for r in raw]
        said = [[r[a:b].lower() for a, b in zip(*c)] for r, c in zip(raw, cut)]
        vocabulary = sorted({w for s in said for w in s})
        if any(len(w) > LONGEST for w in vocabulary):
            raise ValueError(f"a template's word has {LONGEST} bytes at most")
        number = {w: i for i, w in enumerate(vocabulary)}
        self.texts = [[number[w] for w in s] for s in said]
        if any(len(t) < 2 for t in self.texts):
            raise ValueError("a template or phrase has two words at least")
        flat = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary])
        lo, hi = _keys(flat, ends - [len(w) for w in vocabulary], ends)
        by = np.argsort(mix(lo) ^ hi)
        self.hashes, self.lo, self.hi, self.number = (mix(lo) ^ hi)[by], lo[by], hi[by], by.astype(np.int16)
        if len(np.unique(self.hashes)) < len(vocabulary):
            raise ValueError("two words of the templates share a hash")

        step, link, size = [{}], [-1], [0]

        def extend(last: int, c: int) -> int:
            def split(p: int, q: int) -> int:
                """The state of the prefix of q's words that p reaches, made where it is not q itself."""
                if size[p] + 1 == size[q]:
                    return q
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                copy = len(step) - 1
                link[q] = copy
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                return copy

            if c in step[last]:
                return split(last, step[last][c])
            step.append({})
            link.append(0)
            size.append(size[last] + 1)
            new, p = len(step) - 1, last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = split(p, step[p][c])
            return new

        for t in self.texts:
            at = 0
            for c in t:
                at = extend(at, c)
        self.go = np.full((len(step), len(vocabulary)), -1, np.int16 if len(step) < 1 << 15 else np.int32)
        for s, to in enumerate(step):
            for c, q in to.items():
                self.go[s, c] = q
        self.link, self.size = np.array(link), np.array(size)
        self.pairs = np.zeros((len(vocabulary) + 1, len(vocabulary) + 1), bool)  # the last row and column: a word of no template
        #: Where a state's words end in the templates; which phrase a state's longest words are; which end within them.
        self.places: list[list[tuple[int, int]]] = [[] for _ in step]
        self.own, self.under = np.zeros((phrases, len(step)), bool), np.zeros((phrases, len(step)), bool)
        for k, t in enumerate(self.texts):
            self.pairs[t[:-1], t[1:]] = True
            s = 0
            for i, c in enumerate(t):
                s = int(self.go[s, c])
                self.places[s].append((k, i + 1))
            if k < phrases:
                self.own[k, s] = True
        for s in np.argsort(self.size, kind="stable")[1:]:
            self.under[:, s] = self.own[:, self.link[s]] | self.under[:, self.link[s]]
        for s in sorted(range(1, len(step)), key=lambda s: -size[s]):
            if link[s] > 0:
                self.places[link[s]] = sorted({*self.places[link[s]], *self.places[s]})
        self.longest = max(map(len, self.texts))

    def tokens(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for one of no template."""
        out = np.full(len(start), -1, np.int16)
        short = np.flatnonzero(end - start <= LONGEST)
        lo, hi = _keys(data, start[short], end[short])
        h = mix(lo) ^ hi
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = (self.lo[at] == lo) & (self.hi[at] == hi)
        out[short[same]] = self.number[at[same]]
        return out

    def statistics(self, tok: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, state) of every word at which a match of two words or more ends, in order."""
        if len(tok) < 2:
            return (np.zeros(0, np.int64),) * 3
        meet = self.pairs[tok[:-1], tok[1:]] & (owner[:-1] == owner[1:])
        first, last = stretches(meet)  # words first to last, whose neighbours are pairs of some template
        parts = -(-(last - first + 1) // STRETCH)
        whose = np.repeat(np.arange(len(first)), parts)
        k = np.arange(len(whose)) - np.repeat(np.cumsum(parts) - parts, parts)
        a, b = first[whose] + k * STRETCH, np.minimum(first[whose] + (k + 1) * STRETCH, last[whose] + 1)
        begin = np.maximum(first[whose], a - self.longest)
        by = np.argsort(begin - b, kind="stable")
        begin, a, b = begin[by], a[by], b[by]
        state, length = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        found = []
        for i in range(int((b - begin)[0]) if len(by) else 0):
            n = int(np.searchsorted(begin - b, -i, "left"))  # stretches of more than i words
            c, s, l = tok[begin[:n] + i].astype(np.int64), state[:n], length[:n]
            to = self.go[s, c]
            stuck = np.flatnonzero((to < 0) & (s > 0))
            while len(stuck):
                s[stuck] = self.link[s[stuck]]
                l[stuck] = self.size[s[stuck]]
                to[stuck] = self.go[s[stuck], c[stuck]]
                stuck = stuck[(to[stuck] < 0) & (s[stuck] > 0)]
            l[:] = np.where(to < 0, 0, l + 1)
            s[:] = np.maximum(to, 0)
            tell = np.flatnonzero((l > 1) & (begin[:n] + i >= a[:n]))
            found.append((begin[tell] + i, l[tell].copy(), s[tell].copy()))
        place, length, state = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(place, kind="stable")
        return place[order], length[order], state[order]


@lru_cache(maxsize=2)
def automaton(templates: tuple[tuple[str, str], ...], phrases: tuple[str, ...]) -> Automaton:
    return Automaton([*phrases, *[text for _, text in templates]], len(phrases))


def chains(matches: list[tuple[int, int, list[int]]], size: int, gap: int = GAP) -> list[tuple[int, int, int]]:
    """Matches (first word, words, ends in the template), in order -> (first word, words, covered words) of chains.

    A match goes on from the fullest open chain that lies before it, in the text and in the template, by at most ``gap`` words;
    what two matches share counts once. Else it begins a chain.
    """
    opened: list[list[int]] = []  # first, end, end in the template, covered
    done = []
    for first, n, ends in matches:
        done += [c for c in opened if first - c[1] > gap]
        opened = [c for c in opened if first - c[1] <= gap]
        best = None
        for c in opened:
            new = min(n, first + n - c[1])
            to = [e for e in ends if 0 <= e - new - c[2] <= gap] if new > 0 else []
            if to and (best is None or c[3] + new > best[0]):
                best = (c[3] + new, c, new, min(to))
        if best:
            _, c, new, e = best
            c[1], c[2], c[3] = first + n, e, c[3] + new
        else:
            opened += [[first, first + n, e, n] for e in ends[:1]]
    return [(c[0], c[1] - c[0], min(c[3], size)) for c in done + opened]


def spans_of(found: dict[int, list[tuple[int, int, list[int]]]], templates: list[tuple[str, int]], covered: float) -> tuple[list[tuple[str, int, int, float]], float]:
    """Spans (label, first word, words, coverage) of a text, and the greatest coverage of any chain.

    ``found``: matches by template. A span that lies mostly in one that covers more words is left out.
    """
    made = [(c, templates[k][1], first, size, templates[k][0]) for k, m in found.items() for first, size, c in chains(m, templates[k][1])]
    best = max((c / n for c, n, *_ in made), default=0.0)
    full = [x for x in made if x[0] >= covered * x[1]]
    reach = max((x[3] for x in full), default=0)
    kept: list[tuple[int, int, int]] = []  # first word, words, covered words; by first word
    out = set()
    for c, n, first, size, label in sorted(full, key=lambda x: (-x[0], x[1], x[4], x[2])):
        at = bisect_left(kept, (first - reach,))
        hidden = False
        while at < len(kept) and kept[at][0] < first + size and not hidden:
            start, other, more = kept[at]
            hidden = more > c and 2 * (min(first + size, start + other) - max(first, start)) > size
            at += 1
        if not hidden:
            insort(kept, (first, size, c))
            out.add((label, first, size, c / n))
    return sorted(out, key=lambda s: (s[1], s[0])), best


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,length:long,coverage:double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("coverage", pa.float64())]))


def _pieces(raw: np.ndarray, most: int = 4 << 20) -> Iterator[np.ndarray]:
    """The text in pieces of about ``most`` bytes that end between words."""
    at = 0
    while len(raw) - at > most:
        end = at + most
        while end < len(raw):
            blank = np.flatnonzero(~WORD[raw[end : end + (1 << 16)]])
            if len(blank):
                end += int(blank[0])
                break
            end = min(end + (1 << 16), len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, covered: float = COVERED) -> DataFrame:
    """Per row of documents: word counts, places of the phrases, labels, and the spans that templates cover.

    ``n_base`` counts the places of all phrases; first_word and last_word are the first words of the first and last of them (null
    without one). ``labels`` are those of phrases and spans. ``score`` is the greatest share of a template that one
    chain covers, and at least 0.5 where a phrase stands. A null text is empty: no words, no labels, score 0. Each row is judged
    by itself, also with a null or repeated doc_id; other columns are not read. Words are counted from 0.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spoken, fixed = tuple(phrases), tuple(templates)
    base = [phrases[p] for p in spoken]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(fixed, spoken)
        info = [(label, len(a.texts[len(base) + k])) for k, (label, _) in enumerate(fixed)]
        span_of = [len(t) for t in a.texts]
        for rows, raw, off in slices(batches):
            n = rows.num_rows
            if n == 1:
                tok, count = [], 0
                for piece in _pieces(raw):
                    start, end = words_of(piece)
                    tok.append(a.tokens(piece, start, end))
                tok = np.concatenate(tok)
                owner, starts = np.zeros(len(tok), np.int32), np.array([0, len(tok)])
            else:
                spaced, at = _apart(raw, off)
                start, end = words_of(spaced)
                tok = a.tokens(spaced, start, end)
                owner = (np.searchsorted(at, start, "right") - 1).astype(np.int32)
                starts = np.concatenate([np.searchsorted(owner, np.arange(n)), [len(tok)]])
            place, length, state = a.statistics(tok, owner)
            firsts: list[list[int]] = [[] for _ in range(n)]
            names: list[set[str]] = [set() for _ in range(n)]
            # phrases: the state's own words where all of them were read, or those of a suffix
            for k in range(len(base)):
                at_end = np.flatnonzero(a.under[k][state] | (a.own[k][state] & (length == a.size[state])))
                for i in place[at_end].tolist():
                    o = int(owner[i])
                    firsts[o].append(i - span_of[k] + 1 - int(starts[o]))
                    names[o].add(base[k])
            # long matches: as far as they go
            goes_on = np.zeros(len(place), bool)
            if len(place) > 1:
                goes_on[:-1] = (place[1:] == place[:-1] + 1) & (length[1:] == length[:-1] + 1) & (owner[place[1:]] == owner[place[:-1]])
            found: list[dict[int, list]] = [{} for _ in range(n)]
            for i in np.flatnonzero((length >= LEAST_MATCH) & ~goes_on).tolist():
                o, by = int(owner[place[i]]), {}
                for k, e in a.places[int(state[i])]:
                    if k >= len(base):
                        by.setdefault(k - len(base), []).append(e)
                for k, ends in by.items():
                    found[o].setdefault(k, []).append((int(place[i] - length[i] + 1 - starts[o]), int(length[i]), ends))
            judged = [spans_of(f, info, covered) if f else ([], 0.0) for f in found]
            texts = lambda s: ",".join(sorted(s))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array(np.diff(starts).astype(np.int64)), pa.array([len(f) for f in firsts], pa.int64()),
                    pa.array([min(f, default=None) for f in firsts], pa.int64()), pa.array([max(f, default=None) for f in firsts], pa.int64()),
                    pa.array([texts(s) for s in names]), pa.array([texts(s | {x[0] for x in j[0]}) for s, j in zip(names, judged)]),
                    pa.array([max(j[1], 0.5 if s else 0.0) for s, j in zip(names, judged)], pa.float64()),
                    pa.array([[dict(zip(("label", "start", "length", "coverage"), x)) for x in j[0]] for j in judged], _SPAN),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return d.mapInArrow(tidy(run), SCHEMA)


def _apart(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank after each, and where each begins."""
    n = len(off) - 1
    out = np.full(len(raw) + n, 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(off))] = raw
    return out, off[:-1] + np.arange(n)
