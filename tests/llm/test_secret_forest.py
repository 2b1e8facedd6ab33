"""The forest and the features of secret scans against plain computations."""

import math
import random
import re
from collections import Counter

import numpy as np
from pagemill.llm import secrets as S


def plain_class(c):
    return 0 if c.isascii() and c.isdigit() else 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else 3


def plain_describe(text, start, end, known, place):
    s = text[start:end]
    n, low, cls = len(s), s.lower(), [plain_class(c) for c in s]
    symbol = [ord(c) - 31 if 32 <= ord(c) < 127 else 0 for c in s]
    count = Counter(s)
    left = text[max(0, start - 40) : start]
    near = re.findall("[A-Za-z0-9_]+", left)[-3:]
    words = sorted((w for w in S.WORDS if len(w) > 2), key=len, reverse=True)
    at = fixed = 0
    while at < n:
        hit = next((w for w in words if low.startswith(w, at)), None)
        fixed += len(hit) if hit else 0
        at += len(hit) if hit else 1
    common = sum(len(w) for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", s) if len(w) > 2 and w.lower() in known.words)
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    pairs = list(zip(s, s[1:]))
    return {
        "length": n, "entropy": -sum(k / n * math.log2(k / n) for k in count.values()), "surprise": mean([known.surprise[a][b] for a, b in zip(symbol, symbol[1:])]), "transitions": mean([a != b for a, b in zip(cls, cls[1:])]),
        "digits": cls.count(0) / n, "upper": cls.count(1) / n, "lower": cls.count(2) / n, "hex": sum(c in "0123456789abcdef" for c in low) / n, "repeat": mean([a == b for a, b in pairs]),
        "dictionary": max(fixed, common) / n, "path": s.count("/") > 1 or left[-1:] in ("/", "\\") or text[end : end + 1] == "/", "dots": s.count(".") / n,
        "announced": any(S._ANNOUNCES.search(w) for w in near), "otherwise": any(w.lower() == x or w.lower().endswith("_" + x) for w in near for x in S.OTHERWISE),
        "assigned": re.search("[=:]\\s*[\"']?$", left) is not None, "quoted": left[-1:] in ("'", '"') and left != "",
        "uuid_shape": [len(p) for p in low.split("-")] == [8, 4, 4, 4, 12] and all(c in "0123456789abcdef-" for c in low), "all_digits": set(cls) == {0}, "marks": cls.count(3) / n,
        "brackets": bool(set(s) & set("()[]{}<>")), "userinfo": text[end : end + 1] == "@" and left.endswith(":"), "place": any(w in ("test", "tests", "spec", "example", "examples", "sample", "samples", "fixture", "fixtures", "mock", "mocks", "doc", "docs", "vendor") for w in re.findall("[a-z]+", place.lower())),
    }


def test_all_features_of_made_findings():
    known = S.neutral()
    for text, start, size, _, place in S.made_findings(400, seed=21):
        got = dict(zip(S.FEATURES, S.describe(text, start, start + size, known, place)))
        want = plain_describe(text, start, start + size, known, place)
        for name in S.FEATURES:
            assert abs(got[name] - float(want[name])) < 1e-9, (name, text, got[name], want[name])


def test_probabilities_by_walking_each_tree():
    x, y = S.labelled_findings(600, seed=4)
    forest = S.Forest(x, y, trees=12)
    for row, p in zip(x, forest.probability(x)):
        total = 0.0
        for feature, cuts, left, value in forest.trees:
            at = 0
            while left[at] != at:
                at = left[at] + int(row[feature[at]] > cuts[at])
            total += value[at]
        assert abs(total / 12 - p) < 1e-12


def test_a_tree_splits_where_a_plain_search_does():
    """One tree on all features of some rows: the first split has the greatest gain of all features and cuts."""
    r = random.Random(2)
    x = np.array([[r.random(), r.randrange(4), r.random()] for _ in range(80)])
    y = np.array([float(a[0] + 0.2 * a[1] > 0.8) for a in x])

    class All:
        def choice(self, n, k, replace):
            return np.arange(n)

    feature, cuts, left, value = S.Forest._grow(x, y, All(), 3, 1, 3)
    best = (-1, None, None)
    for f in range(3):
        for c in sorted(set(x[:, f]))[:-1]:
            a, b = y[x[:, f] <= c], y[x[:, f] > c]
            if min(len(a), len(b)) >= 3:
                gain = len(a) * a.mean() ** 2 + len(b) * b.mean() ** 2
                if gain > best[0] + 1e-12:
                    best = (gain, f, c)
    assert feature[0] == best[1] and ((x[:, feature[0]] <= cuts[0]) == (x[:, best[1]] <= best[2])).all()
    assert abs(value[left[0]] - y[x[:, best[1]] <= best[2]].mean()) < 1e-12


def test_places_are_learned_from_and_used():
    x, y = S.labelled_findings(6_000, seed=11)
    k = S.FEATURES.index("place")
    assert 0.3 < x[y == 0, k].mean() and 0.03 < x[y == 1, k].mean() < 0.15
    forest = S.Forest(x, y)
    assert sum(int(((f == k) & (left != np.arange(len(left)))).sum()) for f, _, left, _ in forest.trees) >= 10
    x, y = S.labelled_findings(3_000, seed=77)
    for where in (0, 1):
        at = x[:, k] == where
        said = forest.probability(x[at]) >= 0.5
        assert (said & (y[at] == 1)).sum() >= 0.97 * (y[at] == 1).sum() and (said & (y[at] == 0)).sum() <= 0.03 * (y[at] == 0).sum()


def test_equal_probabilities_at_the_threshold_are_secrets(spark):
    class Half:
        def spans(self, texts, places):
            return [[(0, 4, 0.5)] for _ in texts]

    docs = spark.createDataFrame([(1, "abcd efgh"), (1, "abcd efgh")], "doc_id long, text string")
    assert [r.is_secret for r in S.scan(docs, Half()).collect()] == [True, True]
    assert [r.text for r in S.redact(docs, Half()).collect()] == ["[SECRET] efgh"] * 2
