import hashlib
import random

import numpy as np
from pagemill.llm import language as L
from pagemill.llm import secrets as S
from pyspark.sql import functions as F


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify_documents(docs).alias("g").join(docs.select("doc_id", F.col("lang").alias("want")), "doc_id").collect()
    assert len(got) == docs.count()
    assert np.mean([r.lang == r.want for r in got if r.kept]) > 0.98
    assert np.mean([r.kept for r in got]) > 0.99
    # text alone, on documents the model has not seen
    seen = docs.where("doc_id < 400")
    new = docs.where("doc_id >= 400").withColumn("lang2", F.col("lang"))
    alone = L.identify(new, *L.fit_text_model(seen), F.lit(None), F.lit(None), F.lit(None)).join(new.select("doc_id", "lang2"), "doc_id").collect()
    assert np.mean([r.lang == r.lang2 for r in alone]) > 0.97


def test_pages(spark, sf):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    ev = {r.page_id: r for r in L.page_evidence(pages).collect()}
    assert all(r.declared and r.host and "<" not in r.text for r in ev.values())
    got = L.identify_pages(pages, *L.fit_text_model(docs)).collect()
    assert len(got) == pages.count() and np.mean([r.lang == ev[r.page_id].declared for r in got]) > 0.7


def test_evidence_decides_what_text_leaves_open(spark):
    table = np.log(np.full((2, 1 << L.HASH_BITS), 1 / (1 << L.HASH_BITS))).astype(np.float32)
    tilt = np.zeros((2, 1 << L.HASH_BITS), np.float32)
    code, _ = L.grams(np.frombuffer(b"aaaa aaaa", np.uint8), np.array([0, 9]))
    other, _ = L.grams(np.frombuffer(b"bbbb bbbb", np.uint8), np.array([0, 9]))
    tilt[0, np.unique(code)] = 1
    tilt[1, np.unique(other)] = 1
    rows = [(i, "aaaa aaaa aaaa aaaa", "h1", "en") for i in range(50)] + [(100 + i, "bbbb bbbb bbbb bbbb", "h2", "fr") for i in range(50)]
    rows += [(200, "zq zq", "h1", None), (201, "zq zq", "h2", None), (202, "zq zq", None, "fr-CA"), (203, None, "h1", "en"), (204, "12 34", "h1", "en"), (None, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, declared string")
    got = {r.doc_id: r for r in L.identify(df, ["en", "fr"], table + tilt, F.col("host"), F.col("declared"), F.lit(None)).collect()}
    assert len(got) == len(rows)
    assert (got[200].lang, got[201].lang, got[202].lang) == ("en", "fr", "fr")
    assert not got[203].kept and got[204].lang == "und"


def test_language_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert L.identify_documents(empty).count() == 0
    one = spark.createDataFrame([(1, "abc def", None, None)] * 2, "doc_id long, text string, lang string, source string")
    assert [r.lang for r in L.identify_documents(one).collect()] == ["und", "und"]


def test_forest_on_held_out_findings():
    x, y = S.labelled_findings(1500, seed=99)
    p = S.default_forest().probability(x)
    assert ((p >= 0.5) == y).mean() > 0.95


def secret_text(r):
    words = [r.choice("the of and in that erent".split()) for _ in range(30)]
    key = hashlib.sha1(str(r.random()).encode()).hexdigest()
    kind = r.randrange(3)
    if kind == 0:
        return " ".join(words[:15]) + f' token = "{key}" ' + " ".join(words[15:]), key
    if kind == 1:
        return " ".join(words[:15]) + f' TOKEN = "{key.upper()}"!! ' + " ".join(words[15:]), key.upper()
    return " ".join(words) + r.choice([" 9807915762804490 ", f" commit {key} ", " 10.20.30.40 a@b.example.com ", " /static/images/page001.html "]), None


def test_planted_secrets(spark):
    r = random.Random(3)
    made = [secret_text(r) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "é", i) for i, (t, _) in enumerate(made)], "doc_id long, text string, lang string, start int")
    found = {}
    for x in S.scan(df).where("is_secret").collect():
        found.setdefault(x.doc_id, []).append(made[x.doc_id][0][x.start : x.start + x.length])
    want = {i: [k] for i, (_, k) in enumerate(made) if k}
    right = sum(found.get(i) == k for i, k in want.items())
    assert right >= 0.98 * len(want) and len(set(found) - set(want)) <= 2
    out = {x.doc_id: x.text for x in S.redact(df).collect()}
    assert len(out) == 300 and all(k not in out[i] for i, (_, k) in enumerate(made) if k and found.get(i))
    assert all(out[i] == t for i, (t, k) in enumerate(made) if i not in found)


def test_scan_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, 'password = "hunter2!x9"'), (3, "a" * 200_000 + "1")], "doc_id long, text string")
    assert {x.doc_id for x in S.scan(df).collect()} <= {None, 3}
    assert S.scan(df.limit(0)).count() == 0 and S.redact(df).count() == 4
    assert [x.text for x in S.redact(df.where("doc_id = 1")).collect()] == [None]
