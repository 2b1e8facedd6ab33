"""SentencePiece encoding and decoding by a batched Viterbi search.

The hashes of all substrings of a length probe the sorted keys of the pieces at once. Words
of equal length then advance together: at each end position a vectorised maximum over
the lengths of the last piece stores score and backpointer. A long word is first cut where
no piece reaches over, which no path can avoid; its stretches are words like others.
Scores are the model's own, and the best path is that of its unigram search (greatest
total, ties to the longer last piece); characters without a piece fall back to byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece as spm
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bytesio import U64, mix, prefix_hash, range_hash, slices, tidy
from pagemill.llm.spark import batch

SPACE = "▁"
#: How far below the least piece score an unknown character is (fixed by the format's search).
UNKNOWN_PENALTY = 10.0
#: Bytes of remembered words a worker holds at most, and what an entry takes besides its own bytes.
REMEMBERED, ENTRY = 24 << 20, 260
#: Words above this many characters are cut into stretches first; stretches above LINEAR are searched position by position.
LONG, LINEAR = 64, 2048
FILTER_BITS = 20
_MUL = U64(0x9E3779B97F4A7C15 | 1)


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    h = np.zeros(len(codes), U64)
    for k in range(codes.shape[1]):
        h = mix(h * _MUL + codes[:, k].astype(U64) + U64(1))
    return h


class Pieces:
    """The pieces of a model file: sorted keys, scores, byte pieces."""

    def __init__(self, path: str):
        sp = spm.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.unknown = float(min((self.score[i] for i in plain), default=0.0)) - UNKNOWN_PENALTY
        self.longest = max((len(self.text[i]) for i in plain), default=1)
        keys = np.zeros(len(plain), U64)
        size = np.array([len(self.text[i]) for i in plain])
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            keys[at] = _hash(np.array([[ord(c) for c in self.text[plain[i]]] for i in at]))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain)[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[keys >> U64(64 - FILTER_BITS)] = True
        #: Words can be cut before a space mark that follows another character if no piece runs over that place.
        self.cuts = not any(a != SPACE and b == SPACE for i in plain for a, b in zip(self.text[i], self.text[i][1:]))
        self.forget()

    def forget(self) -> None:
        """Drop the remembered words (a worker outlives its task)."""
        self.known: dict[str, bytes] = {}
        self.held = 0

    def hits(self, codes: np.ndarray, size: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Substrings of ``size`` characters down the first axis: (hashes, by those one shorter; flat places of pieces; the pieces).

        A table of the hashes' leading bits lets few but pieces through to the search of the sorted keys.
        """
        h = mix(h[: len(codes) - size + 1] * _MUL + codes[size - 1 :] + U64(1))
        flat = h.reshape(-1)
        at = np.flatnonzero(self.maybe[flat >> U64(64 - FILTER_BITS)])
        k = np.minimum(np.searchsorted(self.keys, flat[at]), len(self.keys) - 1)
        right = self.keys[k] == flat[at]
        return h, at[right], self.ids[k[right]]

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """ids of words; equal-length words are searched together."""
        stretches: list[str] = []
        first = []
        for w in words:
            first.append(len(stretches))
            stretches += self._stretches(w) if len(w) > LONG else [w]
        found: list = [None] * len(stretches)
        size = np.array([len(w) for w in stretches])
        for length in np.unique(size):
            at = np.flatnonzero(size == length)
            step = max(1, 200_000 // max(1, int(length)))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                codes = np.frombuffer("".join(stretches[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                for i, ids in zip(part, self._search(codes) if length <= LINEAR else [self._walk(c) for c in codes]):
                    found[i] = ids
        return [found[a] if b == a + 1 else np.concatenate(found[a:b]) for a, b in zip(first, [*first[1:], len(stretches)])]

    def _stretches(self, word: str) -> list[str]:
        """The word, cut at each place that no piece of two characters or more reaches over."""
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        edge = np.zeros(len(codes) + 1, np.int64)
        codes, h = codes.astype(U64), np.zeros(len(codes), U64)
        for size in range(1, min(self.longest, len(codes)) + 1):
            h, start, _ = self.hits(codes, size, h)
            if size > 1:
                np.add.at(edge, start + 1, 1)
                np.add.at(edge, start + size, -1)
        cuts = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
        bounds = [*np.union1d(cuts, [0]).tolist(), len(word)]
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _walk(self, codes: np.ndarray) -> np.ndarray:
        """The search of one long stretch: the few pieces at each place, found at once, are gone through in order."""
        n = len(codes)
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
        wide, h = codes.astype(U64), np.zeros(n, U64)
        for size in range(1, min(self.longest, n) + 1):
            h, at, ids = self.hits(wide, size, h)
            for a, i, score in zip(at.tolist(), ids.tolist(), self.score[ids].tolist()):
                ends[a].append((a + size, score, i))
            if size == 1:
                for a in np.setdiff1d(np.arange(n), at).tolist():
                    ends[a].append((a + 1, self.unknown, -1))
        best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for a in range(n):
            here = best[a]
            for b, score, i in ends[a]:
                if here + score > best[b]:
                    best[b], back[b] = here + score, (a, i)
        path, at = [], n
        while at > 0:
            a, i = back[at]
            path.append([i] if i >= 0 else self._bytes(chr(int(codes[a]))))
            at = a
        return np.array([i for x in reversed(path) for i in x], np.int32)

    def _search(self, codes: np.ndarray) -> list[np.ndarray]:
        n, length = codes.shape
        if not length:
            return [np.zeros(0, np.int32) for _ in range(n)]
        most = min(self.longest, length)
        # of the piece of k characters at a in word i: its number, pieces[k - 1][a, i], or -1; and its score
        wide = np.ascontiguousarray(codes.T).astype(U64)
        pieces, scores, h = [], [], np.zeros((length, n), U64)
        for size in range(1, most + 1):
            h, at, ids = self.hits(wide, size, h)
            pieces.append(np.full(h.shape, -1, np.int32))
            pieces[-1].reshape(-1)[at] = ids
            scores.append(np.full(h.shape, self.unknown if size == 1 else -np.inf))
            scores[-1].reshape(-1)[at] = self.score[ids]
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        take = np.zeros((length + 1, n), np.int32)
        for end in range(1, length + 1):
            sizes = range(min(most, end), 0, -1)  # longest first, so ties keep the longer piece
            total = np.stack([best[end - k] + scores[k - 1][end - k] for k in sizes])
            k = total.argmax(0)
            best[end] = total[k, np.arange(n)]
            take[end] = sizes[0] - k
        rows, at = np.arange(n), np.full(n, length)
        steps = []
        while (at > 0).any():
            live = at > 0
            size = np.where(live, take[at, rows], 1)
            prev = np.where(live, at - size, 0)
            ids = np.full(n, -1, np.int64)
            for k in np.unique(size[live]):
                m = live & (size == k)
                ids[m] = pieces[k - 1][prev[m], rows[m]]
            steps.append((live, ids, prev))
            at = prev
        # from the front; words with unknown characters, which become bytes, one by one
        live, ids, prev = (np.array(x[::-1]).reshape(len(steps), n) for x in zip(*steps))
        flat, size = ids.T[live.T].astype(np.int32), live.sum(0)
        out = [flat[b - k : b] for b, k in zip(np.cumsum(size).tolist(), size.tolist())]
        for i in np.flatnonzero((live & (ids < 0)).any(0)).tolist():
            place = prev[live[:, i], i].tolist()
            out[i] = np.array([x for p, a in zip(out[i].tolist(), place) for x in ([p] if p >= 0 else self._bytes(chr(int(codes[i, a]))))], np.int32)
        return out

    def _bytes(self, c: str) -> list[int]:
        raw = c.encode("utf-8", "replace")
        return [self.byte[b] for b in raw] if len(self.byte) == 256 else [self.unk]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text: spaces as marks, one mark put before a text that is not empty."""
        marked = [(SPACE + t).replace(" ", SPACE) if t else "" for t in texts]
        if not self.cuts:
            return self.viterbi(marked)
        raw = [t.encode() for t in marked]
        data = np.frombuffer(b"".join(raw), np.uint8)
        off = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
        if not len(data):
            return [np.zeros(0, np.int32) for _ in texts]
        # a word: a run of marks and what follows up to the next mark (the mark is E2 96 81)
        mark = np.zeros(len(data), bool)
        mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        after = np.zeros(len(data), bool)
        after[3:] = mark[:-3]
        start = mark & ~after
        start[off[:-1][np.diff(off) > 0]] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(data))
        h = prefix_hash(data)
        _, first, inverse = np.unique(range_hash(h, at, end), return_index=True, return_inverse=True)
        blob = data.tobytes()
        words = [blob[a:b].decode() for a, b in zip(at[first].tolist(), end[first].tolist())]
        new = [w for w in words if w not in self.known]
        fresh = {w: x.tobytes() for w, x in zip(new, self.viterbi(new))}
        ids = [fresh[w] if w in fresh else self.known[w] for w in words]
        cost = sum(4 * len(w) + len(x) + ENTRY for w, x in fresh.items())
        if self.held + cost > REMEMBERED:
            self.forget()
        if cost <= REMEMBERED:
            self.known |= fresh
            self.held += cost
        size = np.array([len(x) for x in ids]) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        begin = np.cumsum(size) - size
        n = size[inverse]
        total = np.cumsum(n)
        out = flat[np.repeat(begin[inverse] - (total - n), n) + np.arange(int(total[-1]))]
        per = np.bincount(np.searchsorted(off, at, "right") - 1, weights=n, minlength=len(texts)).astype(np.int64)
        return np.split(out, np.cumsum(per)[:-1])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces joined, marks as spaces, the first one dropped."""
        back = {i: bytes([b]) for b, i in self.byte.items()}
        raw = b"".join(back.get(int(i)) or self.text[int(i)].encode() for i in ids)
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """One model for each worker process."""
    return Pieces(path)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids of every whole text, and whether decoding gives the text back.

    A null or empty text has no ids. A text that holds the space mark itself decodes to
    a space there, so its round trip is false. Repeated rows give a row each;
    a row without doc_id keeps its null. Other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        table = [model.text[i].replace(SPACE, " ").encode() for i in range(len(model.text))]
        for b, i in model.byte.items():
            table[i] = bytes([b])
        for rows, _, _ in slices(batches, most=1 << 20):
            texts = [t or "" for t in rows.column(1).to_pylist()]
            ids = model.encode(texts)
            back = [b"".join(map(table.__getitem__, x.tolist())) for x in ids]
            same = [b[1:] == t.encode() if t else not b for b, t in zip(back, texts)]
            off = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
            yield batch({"doc_id": rows.column(0), "n_tokens": np.diff(off).astype(np.int64), "ids": pa.ListArray.from_arrays(off, np.concatenate(ids).astype(np.int32)), "round_trip": same}, _OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, lambda: pieces(path).forget()), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else model.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
