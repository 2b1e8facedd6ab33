import random
import re

import numpy as np
from pagemill.llm import ngram_join
from pagemill.llm.components import components
from pagemill.llm.ngram_join import Lists, divide_skip, heap_merge, similar, tallied, tally, untally


def shingles(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = {}
    for d, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(d)
    seen = set()
    for ds in held.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    k = len(sets[a] & sets[b])
                    if 100 * k >= 75 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def check(spark, rows, **kw):
    got = similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **kw).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert len(got) == len(rows)


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(r.choice([3, 7, 20, 60, 120]))]
        for _ in range(r.choice([1, 2, 9])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.2:
                w = w[: int(len(w) * 0.8)]
            rows.append((n * 7 % 1009, " ".join(w).replace("a", r.choice("aA"))))
            n += 1
    for k in range(14):  # a shared passage with 10 to 40 % of its own words: overlaps around the limit
        rows.append((2000 + k, " ".join(passage + [word() for _ in range(6 + k)])))
    return rows + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one two"), (5004, "ONE\ttwo")]


def test_brute_force(spark):
    check(spark, made(3))


def test_block_pairs(spark):
    check(spark, made(4), block=3)


def test_the_search_finds_all_links_by_itself(spark, monkeypatch):
    """Without links to pivots, all that classes leave open goes through the T-occurrence search."""
    none = lambda sets: sets.limit(0).select(sets.rep.alias("a"), sets.rep.alias("b"))
    monkeypatch.setattr(ngram_join, "_pivot_links", none)
    check(spark, made(8))
    check(spark, made(9), block=8)


def test_edges(spark):
    assert similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = similar(spark.createDataFrame([(1, "a b c d e f", 2), (1, "a b c d e f", 3), (None, "x", 4)], "doc_id long, text string, component_id int")).collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(1, 1)] * 2


def test_pinned_table(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_divide_skip():
    r = random.Random(5)
    docs = [sorted(r.sample(range(60), r.randint(1, 30))) for _ in range(80)]
    index = Lists([np.array(d) for d in docs])
    for q in docs:
        for least in (1, 3, 8, 20):
            want = sorted((d, k) for d in range(50) if (k := len(set(q) & set(docs[d]))) >= least)
            assert divide_skip(index, np.array(q), least, 50) == want


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.id: x.comp for x in components(df, 0).collect()}
    assert all({x.id: x.comp for x in components(df, k).collect()} == got for k in (20, 1000))
    parent = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {k: v for k, v in parent.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert np.all([v <= k for k, v in got.items()])


def test_heap_merge():
    r = random.Random(7)
    for n in (0, 1, 2, 17, 300):
        lists = [np.array(sorted(r.sample(range(400), r.randint(1, 12)))) for _ in range(n)]
        assert heap_merge(lists).tolist() == sorted(x for l in lists for x in l.tolist())


def test_tally():
    r = random.Random(8)
    for n, size in ((1, 0), (5, 3), (1000, 2), (70_000, 5), (300, 5000), (2, 70_000)):
        doc = np.array(sorted(r.randrange(n) for _ in range(size)), np.int64)
        packed = tally(doc, n).tobytes()
        assert untally(packed).tolist() == doc.tolist() and tallied(packed) == n and len(packed) <= 5 + 4 * min(n, max(size, 1))


def test_long_texts(spark):
    """Texts of more than a block, each a slice of its own, and short ones between them."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(5000)]
    long = [r.choice(words) for _ in range(260_000)]
    other = list(long)
    for k in range(0, len(other), 60):
        other[k] = "x"
    far = list(long)
    for k in range(0, len(far), 10):
        far[k] = "y"
    check(spark, [(9, " ".join(long)), (4, " ".join(other)), (2, " ".join(far)), (7, "one two three four five six"), (5, "one two three four five six")])
