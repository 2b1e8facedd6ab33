import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pagemill.llm.bpe import encoder
from pagemill.llm.packing import hilbert, pack
from tokenizers import Tokenizer

PATH = P.path("byte_bpe_50k.json")


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


def test_same_ids_as_library():
    r = random.Random(1)
    bits = ["'s", "'re", "'ve", "'ll", "don't", "we'd've", " '", "''s", "-'s", "  ", " ", "\n", "\t ", "\n\n ", "é", "ß", "日本", "٣4", "½", "a", "Zb", "12", "!!", "<|endoftext|>", " ", "　x", "​", "\r\n", "🙂", "'", "'S", "é"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(600)]
    tok = Tokenizer.from_file(PATH)
    ids, off = encoder(PATH).encode(*arrays(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_hilbert_neighbours():
    pts = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = hilbert(pts, 3)
    assert sorted(key) == list(range(512))
    walk = pts[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("sizes", [(2048, 4 << 20), (16, 1 << 10)])
def test_pieces(spark, sf, sizes, tmp_path):
    length, each = sizes
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "x"), (10**6 + 1, "", "y"), (10**6 + 2, "a b", "z")], "doc_id long, text string, length string")
    docs.unionByName(extra, allowMissingColumns=True).write.parquet(str(tmp_path / "d"))
    both = spark.read.parquet(str(tmp_path / "d"))
    got = pack(both, PATH, length, bytes_each=each).collect()
    tok = Tokenizer.from_file(PATH)
    want = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in both.collect()}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == want.keys()
    for d, ps in by.items():
        ids, at = want[d], 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : at], "<u4").tobytes())
        assert at == len(ids)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= length
    short = sum(sum(n for _, n in s) < length for s in seqs.values())
    assert short <= (1 if each > 1 << 20 else 8)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
