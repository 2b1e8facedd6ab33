"""Rolling-hash triggers: the phrase parse shared by the suffix-array operator and its tests."""

from __future__ import annotations

import numpy as np

from pagemill.llm.bytesio import U64, prefix_hash, range_hash

GRAM = 32


def phrases(data: np.ndarray, off: np.ndarray, width: int = 100, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of the window starts of each text: (first start, last start, owner, trigger hash).

    Every window of ``width`` bytes holds ``width - gram + 1`` grams; its trigger is
    the one with the least (hash, position). Starts that share a trigger form a
    phrase. The trigger depends on the window's own bytes alone, so equal windows
    have equal triggers wherever they stand.
    """
    n = len(data)
    span = width - gram + 1
    if n < width:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U64)
    h = prefix_hash(data)
    at = np.arange(n - gram + 1)
    full = range_hash(h, at, at + gram)
    bits = max(1, int(n).bit_length())
    key = (full >> U64(bits) << U64(bits)) | at.astype(U64)
    best, have = key, 1
    while have * 2 <= span:
        best = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    if have < span:
        best = np.minimum(best[: len(best) - (span - have)], best[span - have :])
    where = (best & U64((1 << bits) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(where)]
    ok = np.arange(len(where)) + width <= off[1:][owner]
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new & ok)
    last_of = np.ones(len(where), bool)
    last_of[:-1] = new[1:] | ~ok[1:]
    last = np.flatnonzero(last_of & ok)
    return first, last, owner[first], full[where[first]]
