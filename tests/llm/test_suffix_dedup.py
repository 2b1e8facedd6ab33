import hashlib
import random

from pagemill.llm.suffix_dedup import dedup


def brute(rows, width=100):
    seen, out = {}, {}
    for d, t in sorted(((d, (t or "").encode()) for d, t in rows if d is not None)):
        for s in range(len(t) - width + 1):
            seen.setdefault(t[s : s + width], (d, s))
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if d is not None and seen[b[s : s + width]] < (d, s):
                gone[s : s + width] = [True] * width
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(rest).hexdigest())
    return out


def check(spark, rows, **kw):
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **kw).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def texts(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(40) for _ in range(3)]
    base = prose(150)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = prose(60)
        elif kind == 1:
            t = prose(20) + " " + r.choice(shared) + " " + prose(20)
        elif kind == 2:
            w = base.split(" ")
            w[r.randrange(len(w))] = "X"
            t = " ".join(w)
        elif kind == 3:
            t = base
        elif kind == 4:
            t = "ab" * 150 + prose(3)
        else:
            t = shared[0][:99]
        rows.append((i * 3 - 5, t))
    return rows


def test_brute_force(spark):
    rows = texts(1, 48) + [(1000, None), (1001, ""), (1002, "a" * 700), (1003, "a" * 99)]
    check(spark, rows)


def test_spread_triggers(spark):
    check(spark, texts(2, 60), hot=2)


def test_texts_in_parts(spark):
    """Texts of more than two blocks are ordered part by part, with the same result; so is one of 24 MB."""
    rows = texts(3, 40) + [(500, "ab" * 900 + texts(4, 2)[1][1] * 3), (501, None)]
    check(spark, rows, block=150)
    check(spark, rows, block=150, hot=2)
    r = random.Random(1)
    unit = "".join(r.choice("abcdefgh ") for _ in range(3_000_000))
    (got,) = dedup(spark.createDataFrame([(1, unit * 8)], "doc_id long, text string")).collect()
    assert (got.n_removed, got.n_spans, got.kept_sha256) == (21_000_000, 1, hashlib.sha256(unit.encode()).hexdigest())


def test_edges(spark):
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = (7, "some text, twice " * 20)
    twice = dedup(spark.createDataFrame([row, row, (None, "x")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and len({r.n_removed for r in twice if r.doc_id == 7}) == 1
    more = spark.createDataFrame([(1, "é" * 120, 5, "k"), (2, "é" * 120, 6, None), (3, None, 7, None)], "doc_id long, text string, n_bytes int, lang string")
    out = {r.doc_id: r for r in dedup(more, text_out=True).collect()}
    assert out[3].text is None and out[2].text == "" and out[1].lang == "k"


def test_pinned_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)
