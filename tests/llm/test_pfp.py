import random

import numpy as np
import pytest

from pagemill.llm import pfp


def flat(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


def brute(texts, width):
    seen, out = {}, []
    for i, t in enumerate(texts):
        for s in range(len(t) - width + 1):
            seen.setdefault(t[s : s + width], (i, s))
        out.append([s + width <= len(t) and seen[t[s : s + width]] != (i, s) for s in range(len(t))])
    return [x for row in out for x in row]


@pytest.mark.parametrize("modulus", [1, 2, 4, 32])
def test_repeats(modulus, monkeypatch):
    monkeypatch.setattr(pfp, "MODULUS", modulus)
    r = random.Random(modulus)
    for _ in range(80):
        alphabet = r.choice([b"a", b"ab", b"\0a", b"abcdefghij ", bytes(range(256))])
        width = r.choice([16, 20, 30, 100])
        some = lambda k: bytes(r.choice(alphabet) for _ in range(k))  # noqa: E731, B023
        base = some(r.randint(1, 600))
        texts = []
        for _ in range(r.randint(1, 8)):
            t = b""
            for _ in range(r.randint(0, 4)):
                a = r.randrange(len(base))
                t += base[a : a + r.randint(1, 300)] if r.random() < 0.6 else some(r.randint(0, 80))
            texts.append(t)
        data, off = flat(texts)
        got = pfp.repeated(data, off, np.arange(len(texts)), np.zeros(len(texts), np.int64), width)
        assert got.tolist() == brute(texts, width)


def test_order():
    texts = [b"the cat sat on the mat and the cat sat on the hat " * 3, b"on the mat and the cat sat on the moon", b"", b"x"]
    data, off = flat(texts)
    at, kind = pfp.classes(data, off, 16)
    windows = [bytes(data[i : i + 16]) for i in at]
    assert windows == sorted(windows) and len(set(windows)) == len(set(kind.tolist()))
    rank = pfp.suffix_array(data, np.repeat(off[1:], np.diff(off)) - np.arange(len(data)), 40)
    all_of = [(t[s : s + 40], int(rank[off[i] + s])) for i, t in enumerate(texts) for s in range(len(t))]
    assert sorted(all_of) == sorted(all_of, key=lambda x: x[1]) and len({a for a, _ in all_of}) == len({b for _, b in all_of})
