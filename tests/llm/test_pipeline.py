import corpus_pipeline as P
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import test_ngram_join as near
from tests.llm import test_suffix_dedup as cuts


def test_each_stage(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12 34 ... 56", "en", "src0", 12), (9002, None, None, None, None), (9003, 'the and of the token = "0123456789abcdef0123456789abcdef01234567" of the and', "en", "src1", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(extra).withColumn("component_id", P.F.lit(1)).write.parquet(str(tmp_path / "in"))
    now = spark.read.parquet(str(tmp_path / "in"))
    seen = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, now, sf)
        if name != "packing":
            assert out.columns == P.COLUMNS, name
        out.write.parquet(str(tmp_path / str(k)))
        before, now = now, spark.read.parquet(str(tmp_path / str(k)))
        a = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        if name == "language":
            b = {r.doc_id: r.text for r in now.collect()}
            assert 9001 not in b and 9002 not in b and len(b) >= 0.99 * len(a) - 2 and all(a[d] == t for d, t in b.items())
        elif name == "near_copies":
            b = {r.doc_id: r.text for r in now.collect()}
            want = near.brute(list(a.items()))
            assert set(b) == {d for d, (_, c) in want.items() if c == d} and len(b) < len(a)
        elif name == "repeated_passages":
            rows = now.collect()
            want = cuts.brute(list(a.items()))
            for r in rows:
                assert r.n_chars == len(r.text)
                if not want[r.doc_id][1]:
                    assert r.text == a[r.doc_id]
                else:
                    assert len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1]
            assert len(rows) == len(a) and any(w[1] for w in want.values())
        elif name == "secrets":
            b = {r.doc_id: r.text for r in now.collect()}
            assert b.keys() == a.keys() and "0123456789abcdef" not in b[9003] and "[SECRET]" in b[9003]
            assert np.mean([a[d] == b[d] for d in a]) > 0.9
        else:
            tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            total = {}
            for r in now.collect():
                total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            assert total == {d: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in a.items()}
        seen.append(name)
    assert seen == ["language", "near_copies", "repeated_passages", "secrets", "packing"]


def test_run(spark, sf):
    got = P.run(spark, sf)
    assert got.count() > 0 and got.columns[:3] == ["doc_id", "start", "length"]


def test_empty_stages(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").count() == 0
