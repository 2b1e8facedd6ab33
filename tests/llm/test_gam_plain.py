"""The quality model against plain Python: every feature counted by hand, and boosting without histograms."""

import math
from collections import Counter

import numpy as np
from pagemill.llm.gam import FEATURES, features, fit

BLANKS = set(b" \t\n\x0b\x0c\r")
SYMBOLS, STOPS = set(b"#*$%&|<>~^=+_\\/@{}[]"), set(b".,;:!?'\"()-")


def plain_features(raw):
    words, now = [], []
    for c in raw + b" ":
        if c in BLANKS:
            if now:
                words.append(bytes(now))
            now = []
        else:
            now.append(c)
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(raw), len(words)
    share = lambda ok: sum(map(ok, raw)) / n
    lines = raw.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    repeated = lambda xs: (len(xs) - len(set(xs))) / max(len(xs), 1)
    windows = [tuple(words[i : i + 5]) for i in range(w - 4)]
    return [
        math.log(1 + w), sum(map(len, words)) / w, share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in SYMBOLS), share(lambda c: c in STOPS), share(lambda c: c >= 128), share(lambda c: c in BLANKS),
        math.log(1 + n / (raw.count(b"\n") + 1)), repeated(lines), 1 - repeated(words), max(Counter(words).values()) / w,
        -sum(k / n * math.log(k / n) for k in Counter(raw).values()), sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
        sum(len(x) > 12 for x in words) / w, repeated(windows),
    ]


def test_all_features_of_many_texts(spark):
    texts = [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [b"", b" \n", b"a", b"one\n\n\ntwo.\n", b"x " * 40, b"\xc3\xa9 \xe6\x97\xa5?\n!", b"no end", b"a b c d e a b c d e"]
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    got = features(np.frombuffer(b"".join(texts), np.uint8), off)
    for t, x in zip(texts, got):
        want = plain_features(t)
        for name, a, b in zip(FEATURES, x, want):
            assert abs(a - b) < 1e-9, (name, t[:80], a, b)


def plain_tree(values, g, h, leaves, ridge):
    """Best splits of rows by one integer value, greedily: the step of each row."""
    part = lambda rows: (sum(g[r] for r in rows) ** 2) / (sum(h[r] for r in rows) + ridge)
    top = max(values)
    cuts = []
    for _ in range(leaves - 1):
        best = (1e-9, None)
        bounds = [0, *sorted(cuts), top + 1]
        for a, b in zip(bounds, bounds[1:]):
            for c in range(a + 1, b):
                left, right = [r for r, v in enumerate(values) if a <= v < c], [r for r, v in enumerate(values) if c <= v < b]
                gain = part(left) + part(right) - part(left + right)
                if gain > best[0] + 1e-13:
                    best = (gain, c)
        if best[1] is None:
            break
        cuts.append(best[1])
    bounds = [0, *sorted(cuts), top + 1]
    step = {}
    for a, b in zip(bounds, bounds[1:]):
        rows = [r for r, v in enumerate(values) if a <= v < b]
        v = sum(g[r] for r in rows) / (sum(h[r] for r in rows) + ridge)
        step.update(dict.fromkeys(rows, v))
    return [step[r] for r in range(len(values))]


def test_boosting_of_fifty_rows_equals_a_plain_one():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(50, 3)), 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = fit(x, y, rounds=12, pairs=0, bins=8)
    bins = [[sum(v >= e for e in edges) for v in x[:, f]] for f, edges in enumerate(model.edges)]
    for f in range(3):
        assert np.allclose(model.edges[f], np.unique([np.quantile(x[:, f], q / 8) for q in range(1, 8)]))
    prior = (y.sum() + 1) / 52
    m = [math.log(prior / (1 - prior))] * 50
    for _ in range(12):
        for f in range(3):
            p = [1 / (1 + math.exp(-v)) for v in m]
            step = plain_tree(bins[f], [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p], 3, 5.0)
            m = [a + 0.1 * b for a, b in zip(m, step)]
    assert np.max(np.abs(model.margin(x) - m)) < 1e-9
