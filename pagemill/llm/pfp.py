"""Corpus order of a block of texts by prefix-free parsing, deep enough to compare windows.

Rolling-hash triggers cut the texts into phrases that overlap by one trigger. The
dictionary holds each distinct phrase once, and its suffix array (prefix doubling that
leaves out what is settled) orders all phrase suffixes; the suffix array of the parse,
with its longest common prefixes, orders what follows a phrase. No phrase suffix that
ends in a trigger is a prefix of another, so both together give the order of all
window starts: by phrase suffix first, by the parse after it second. Neighbours in
that order with a common prefix of a whole window are the same string. Repetitive
text costs little: a phrase is sorted once, however often it stands there.
"""

from __future__ import annotations

import numpy as np

from pagemill.llm.bytesio import U64, prefix_hash, range_hash
from pagemill.llm.spark import runs

#: Bytes of a trigger; one position in MODULUS is a trigger.
TRIGGER, MODULUS = 12, 32
_LEADING = np.array([2**64 - 2 ** (8 * (8 - k)) for k in range(8)], U64)  # masks of the first k bytes


def triggers(data: np.ndarray, off: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the phrases of all texts that are not empty, in corpus order."""
    at = np.arange(max(0, len(data) - TRIGGER + 1))
    at = at[range_hash(h, at, at + TRIGGER) & U64(MODULUS - 1) == 0]
    at = at[at + TRIGGER <= off[np.searchsorted(off, at, "right")]] if len(at) else at
    start = np.union1d(off[:-1][np.diff(off) > 0], at)
    stop = off[np.searchsorted(off, start, "right")]
    end = stop.copy()
    inner = np.flatnonzero(start[1:] < stop[:-1])
    end[inner] = start[inner + 1] + TRIGGER
    return start, end


def suffix_array(text: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each text[i : i + min(left[i], depth)] in lexicographic order; equal strings share one.

    ``left``: bytes up to the end of the phrase of i, which no comparison crosses.
    """
    n, have = len(text), 7
    assert depth >= have
    # seven bytes at once, by doubling; those past the end are blanked, the last byte is their number
    key = np.zeros(n + have, U64)
    key[:n] = text
    key[:-1] = key[:-1] << U64(8) | key[1:]
    key[:-2] = key[:-2] << U64(16) | key[2:]
    key = key[:n] << U64(32) | (key[3 : n + 3] & U64(0xFFFFFF)) << U64(8)
    some = np.minimum(left, have)
    key &= _LEADING[some]
    key |= some.astype(U64)
    del some
    order = np.argsort(key)
    key = key[order]
    at = runs(key)
    del key
    size = np.diff(np.append(at, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, size)
    live = order[np.repeat(size > 1, size)]
    del order
    live = live[left[live] >= have]
    while have < depth and len(live):
        step = min(have, depth - have)
        head = rank[live]
        on = left[live] > step
        follow = np.zeros(len(live), np.int64)
        follow[on] = rank[live[on] + step] + 1
        pair = head << 32 | follow
        o = np.argsort(pair)
        live, pair, head = live[o], pair[o], head[o]
        at = runs(pair)
        size = np.diff(np.append(at, len(pair)))
        group = runs(head)
        first = np.repeat(group, np.diff(np.append(group, len(head))))
        rank[live] = np.repeat(head[at] + at - first[at], size)
        have += step
        live = live[np.repeat(size > 1, size)]
        live = live[left[live] >= have]
    return rank


def parse_order(phrase: np.ndarray, start: np.ndarray, end: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, place) of the suffixes of the parse, compared for ``depth`` bytes at least.

    phrase: rank of each phrase in the dictionary; stop: end of its text.
    """
    n = len(phrase)
    rank, many = phrase.astype(np.int64), 1
    last = np.searchsorted(start, stop)  # phrases of other texts begin here
    while True:
        _, rank = np.unique(rank, return_inverse=True)
        reach = np.minimum(np.arange(n) + many, last) - 1
        if ((end[reach] - start >= depth) | (end[reach] == stop)).all():
            break
        follow = np.arange(n) + many
        rank = rank << 32 | np.where(follow < last, rank[np.minimum(follow, n - 1)] + 1, 0)
        many *= 2
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that data[a:] and data[b:] share, ``depth`` at most, within their texts."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(depth):
        live = live[(a[live] + k < stop_a[live]) & (b[live] + k < stop_b[live])]
        live = live[data[a[live] + k] == data[b[live] + k]]
        if not len(live):
            break
        out[live] = k + 1
    return out


class RangeMinimum:
    """Minimum of values[i:j] for many (i, j) at once, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            v, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(v[:-half], v[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.floor(np.log2(np.maximum(j - i, 1))).astype(np.int64)
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            at, v = level == k, self.levels[k]
            out[at] = np.minimum(v[i[at]], v[j[at] - (1 << k)])
        return out


def classes(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts in corpus order, class): equal classes are equal strings of ``width`` bytes.

    Only starts whose string may stand twice are returned; windows lie within one text.
    """
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none
    h = prefix_hash(data)
    start, end = triggers(data, off, h)
    stop = off[np.searchsorted(off, start, "right")]
    _, one, word = np.unique(range_hash(h, start, end), return_index=True, return_inverse=True)
    del h
    size = (end - start)[one]
    begin = np.cumsum(size) - size
    text = data[np.repeat(start[one] - begin, size) + np.arange(int(size.sum()))]
    left = np.repeat(begin + size, size) - np.arange(len(text))
    rank = suffix_array(text, left, width)
    del text
    # every window start belongs to the phrase it stands in
    room = np.clip(np.minimum(np.append(start[1:], len(data)), stop - width + 1) - start, 0, None)
    inside = np.repeat(np.arange(len(start)), room)
    at = np.arange(len(inside)) + np.repeat(start - (np.cumsum(room) - room), room)
    suffix = rank[at + (begin[word] - start)[inside]]
    twice = np.bincount(suffix, minlength=len(left))[suffix] > 1
    at, inside, suffix = at[twice], inside[twice], suffix[twice]
    if not len(at):
        return none, none
    order, place = parse_order(rank[begin[word]], start, end, stop, width)
    a, b = order[:-1], order[1:]
    least = RangeMinimum(common_prefix(data, start[a], start[b], stop[a], stop[b], width))
    short = end[inside] - at < width
    follow = np.where(short, place[np.minimum(inside + 1, len(place) - 1)], 0)
    o = np.argsort(suffix << 32 | follow, kind="stable")
    at, inside, suffix, follow, short = at[o], inside[o], suffix[o], follow[o], short[o]
    new = np.ones(len(at), bool)
    new[1:] = suffix[1:] != suffix[:-1]
    ask = np.flatnonzero(~new & short)
    ask = ask[follow[ask] != follow[ask - 1]]
    need = width - (end[inside[ask]] - TRIGGER - at[ask])
    new[ask] = least.of(follow[ask - 1], follow[ask]) < need
    return at, np.cumsum(new) - 1


def repeated(data: np.ndarray, off: np.ndarray, priority: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each byte: does its window also start earlier, in a text of less priority or before it in the same?

    priority: dense rank of each text; first: where data's part of it starts in the text.
    """
    at, kind = classes(data, off, width)
    out = np.zeros(len(data), bool)
    if len(at):
        own = np.searchsorted(off, at, "right") - 1
        place = priority[own] << 32 | (first[own] + at - off[own])
        begin = runs(kind)
        least = np.minimum.reduceat(place, begin)
        out[at] = place > np.repeat(least, np.diff(np.append(begin, len(kind))))
    return out
