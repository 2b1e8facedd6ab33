import random

import public_tokenizers as P
from pagemill.llm.sentencepiece import decode_documents, encode_documents, pieces

PATH = P.path("piece_bpe_32k.model")


def brute(m, text):
    """A plain Viterbi over the whole marked text, in double precision."""
    t = ("▁" + text).replace(" ", "▁") if text else ""
    index = {m.text[i]: i for i in m.ids.tolist()}
    best = [(0.0, 0, None)] + [(float("-inf"), 0, None)] * len(t)
    for i in range(len(t)):
        for j in range(i + 1, min(len(t), i + m.longest) + 1):
            p = index.get(t[i:j])
            s = m.score[p] if p is not None else m.unknown if j == i + 1 else None
            if s is not None and best[i][0] + s > best[j][0]:
                best[j] = (best[i][0] + s, i, p)
    out, j = [], len(t)
    while j:
        _, i, p = best[j]
        out[:0] = [p] if p is not None else [m.byte[x] for x in t[i:j].encode()]
        j = i
    return out


def made(bits, seed=4):
    r = random.Random(seed)
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(300)] + [""]


BITS = ["the", " the", "ing", "Straße", "été", " ", "日本", "ñ", "x1", "!!", "tion", "zq"]


def test_brute_force():
    m = pieces(PATH)
    texts = made(BITS + ["語", "  ", "\n", "🙂", "\t", "א", "\x00"], 5) + [" ", "a", "🙂🙂"]
    for t, x in zip(texts, m.encode(texts)):
        assert x.tolist() == brute(m, t), repr(t)
        assert m.decode(x) == t


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = {r.doc_id: r.text for r in docs.collect()}
    got = encode_documents(docs, PATH)
    rows = got.collect()
    assert len(rows) == len(by)
    for r in rows:
        assert r.round_trip and r.n_tokens == len(r.ids)
    m = pieces(PATH)
    assert all(list(r.ids) == brute(m, by[r.doc_id]) for r in rows[::8])
    assert {r.doc_id: r.text for r in decode_documents(got, PATH).collect()} == by


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, "x", 0), (3, "a▁b", 1), (4, "ab " * 50_000, 1)]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH).collect()
    assert len(got) == 6 and [r.n_tokens for r in got if r.doc_id in (1, 2)] == [0, 0, 0]
    assert [r.round_trip for r in got if r.doc_id == 3] == [False] and [r.round_trip for r in got if r.doc_id == 4] == [True]
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
