"""Byte-level BPE ids of many texts at once.

The pre-tokeniser's pattern is evaluated on code-point classes of a whole slice
with numpy; only distinct pieces are merged (and remembered by the worker), and
ids are gathered back. The ids are those of the ``tokenizers`` file; texts that
hold the string of a special token go to that library itself.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from pagemill.llm.bytesio import prefix_hash, range_hash

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Bytes of remembered pieces a worker holds at most, and what an entry takes besides its own bytes.
REMEMBERED, ENTRY = 24 << 20, 220


@lru_cache(1)
def _classes() -> np.ndarray:
    space = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    kind = {"L": LETTER, "N": NUMBER}
    return np.array([SPACE if c in space else kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)


def pieces(code: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokeniser's pieces in code points; off: text boundaries, which always cut."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    cls = _classes()[code]
    edge = np.zeros(n + 1, bool)
    edge[off[:-1]] = True
    edge[n] = True
    new = edge[:n].copy()
    new[1:] |= cls[1:] != cls[:-1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], n)
    kind = cls[at]
    last = edge[end]
    # the last character of a run of spaces before a word goes with the word (a blank) or stands alone
    inner = (kind == SPACE) & ~last
    tail = end[inner] - 1
    blank = code[tail] == 0x20
    start = np.zeros(n + 1, bool)
    start[at] = True
    start[tail] = True
    start[tail[blank] + 1] = False
    # contractions: an apostrophe on its own, not after a blank, then letters
    one = np.flatnonzero((kind == OTHER) & (end - at == 1) & (code[at] == 0x27) & start[at] & ~last)
    if len(one):
        one = one[kind[np.minimum(one + 1, len(kind) - 1)] == LETTER]
        for k in one:
            p, stop = int(at[k]), int(end[k + 1])
            a = chr(code[p + 1])
            b = chr(code[p + 2]) if p + 2 < stop else ""
            size = 1 if a in "stmd" else 2 if a + b in ("re", "ve", "ll") else 0
            if size:
                start[p + 1] = False
                if p + 1 + size < stop:
                    start[p + 1 + size] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """ids of texts by the vocabulary of a ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        back = {}
        k = 0
        for b in range(256):  # the byte alphabet: printable bytes stand for themselves, others for U+0100 onwards
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                back[chr(b)] = b
            else:
                back[chr(256 + k)] = b
                k += 1
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        """Drop the remembered pieces (a worker outlives its task)."""
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _ids(self, piece: bytes) -> bytes:
        got = self.known.get(piece)
        if got is None:
            got = np.array(self.merge._encode_single_piece(piece), np.int32).tobytes()
            cost = len(piece) + len(got) + ENTRY
            if self.held + cost > REMEMBERED:
                self.forget()
            if cost <= REMEMBERED:
                self.known[piece] = got
                self.held += cost
        return got

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of UTF-8 texts."""
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        places = np.append(lead, len(data))
        at = places[pieces(code, np.searchsorted(lead, off))]
        end = np.append(at[1:], len(data))
        h = prefix_hash(data)
        _, first, inverse = np.unique(range_hash(h, at, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        ids = [self._ids(raw[a:b]) for a, b in zip(at[first].tolist(), end[first].tolist())]
        size = np.array([len(x) for x in ids], np.int64) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        begin = np.cumsum(size) - size
        n = size[inverse]
        total = np.cumsum(n)
        out = flat[np.repeat(begin[inverse] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)] if len(n) else flat
        own = np.searchsorted(off, at, "right") - 1
        per = np.bincount(own, weights=n, minlength=len(off) - 1).astype(np.int64) if len(n) else np.zeros(len(off) - 1, np.int64)
        bounds = np.append(0, np.cumsum(per))
        for s in self.special:
            if s.encode() in raw:
                hit = [i for i in range(len(off) - 1) if s.encode() in raw[off[i] : off[i + 1]]]
                texts = [out[bounds[i] : bounds[i + 1]] for i in range(len(off) - 1)]
                for i in hit:
                    texts[i] = np.array(self.library.encode(raw[off[i] : off[i + 1]].decode(), add_special_tokens=False).ids, np.int32)
                return np.concatenate(texts), np.append(0, np.cumsum([len(x) for x in texts]))
        return out, bounds


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
