import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pagemill.llm import secrets as S

ROWS = [(1, "The cat, the cat!\nTHE end\u00e9x"), (2, None), (3, ""), (4, "a the"), (4, "a the"), (None, "cat 22b a1 7")]


def test_learned_counts(spark):
    """Transitions and words against a count by hand, over texts that end in a letter."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    known = S.learn(df, rarest=8)
    pairs = Counter()
    for _, t in ROWS:
        raw = (t or "").encode()
        pairs.update(int(S._SYMBOL[a]) * S.SYMBOLS + int(S._SYMBOL[b]) for a, b in zip(raw, raw[1:]) if not {a, b} & set(b"0123456789"))
    words = Counter(w.lower() for _, t in ROWS for w in re.findall("[A-Za-z]{3,}", t or ""))
    assert np.allclose(known.surprise, S.background_of(pairs, []).surprise)
    assert known.words == {w for w, n in words.items() if 8 * n >= sum(words.values())}


def test_long_strings_by_a_plain_scan():
    """Without names and addresses, candidates are the maximal runs of 16 characters or more that hold a letter or digit."""
    r = random.Random(4)
    for _ in range(300):
        t = "".join(r.choice(r.choice(["abcXYZ019", "+/_.-", "=", " ,"])) if r.random() < 0.3 else r.choice("abcdefXYZ0189") for _ in range(r.randint(0, 80)))
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_.\-]+", t):
            end = m.end()
            pad = len(t[end:]) - len(t[end:].lstrip("="))
            if pad and not re.match(r"[A-Za-z0-9+/_.\-=]", t[end + pad : end + pad + 1]):
                end += pad
            if m.end() - m.start() >= 14 and end - m.start() >= 16 and re.search("[A-Za-z0-9]", m[0]):
                want.append((m.start(), end))
        assert S.candidates(t) == want, t


def test_given_findings(spark):
    """Findings of the caller decide: here, hexadecimal is harmless and words are the secrets."""
    r = random.Random(6)
    rows = []
    for k in range(200):
        value = hashlib.sha1(str(k).encode()).hexdigest() if k % 2 else "".join(r.choice("abcdefghij") for _ in range(24))
        rows.append((f"x {value} y", 2, len(value), k % 2 == 0, "src/app.py"))
    rows += [(None, 0, 1, True, ""), ("short", 3, 40, True, ""), ("text", 0, 2, None, None)]
    findings = spark.createDataFrame(rows, "text string, start int, length int, is_secret boolean, place string")
    docs = spark.createDataFrame([(1, "see " + hashlib.sha1(b"z").hexdigest()), (2, "see " + "abcdefgh" * 3), (2, "see " + "abcdefgh" * 3)], "doc_id long, text string")
    got = sorted((x.doc_id, x.is_secret) for x in S.scan(docs, S.train(docs, findings)).collect())
    assert got == [(1, False), (2, True), (2, True)]
    with pytest.raises(ValueError):
        S.train(docs, findings.where("is_secret"))


def test_pinned_table(spark, sf):
    """Each value of token = "..." of the documents is found, and nothing else is called a secret."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    found = {(r.doc_id, r.start, r.length) for r in S.scan(docs).where("is_secret").collect()}
    want = {(d, m.start(1), 40) for d, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t, re.I)}
    assert len(want & found) >= 0.99 * len(want) and len(found - want) <= 0.01 * len(found)
