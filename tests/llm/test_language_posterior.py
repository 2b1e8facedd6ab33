import math
import random
from collections import defaultdict

import numpy as np
from pagemill.llm import language as L
from pyspark.sql import functions as F

LANGS = ["de", "en", "fr"]


def plain(rows, table, strength=20.0):
    """Bayes' rule by hand: text, then what is declared, then a host's prior smoothed by its suffix and the corpus."""
    ll = {}
    for i, text, *_ in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        code, _ = L.grams(raw, np.array([0, len(raw)]))
        ll[i] = [float(np.mean(t[code].astype(float))) * min(len(code), L.EFFECTIVE) for t in table] if len(code) else None
    norm = lambda x: [math.exp(v - max(x)) / sum(math.exp(u - max(x)) for u in x) for v in x]
    host, suffix, said = (defaultdict(lambda: [0.0] * len(LANGS)) for _ in range(3))
    total = [1.0] * len(LANGS)
    for i, _, h, d, s in rows:
        if ll[i]:
            for k, p in enumerate(norm(ll[i])):
                host[s or "", h or ""][k] += p
                suffix[s or ""][k] += p
                said[d or ""][k] += p
                total[k] += p
    whole = [x / sum(total) for x in total]
    smooth = lambda c, up: [(x + strength * u) / (sum(c) + strength) for x, u in zip(c, up)]
    out = {}
    for i, _, h, d, s in rows:
        if ll[i]:
            prior = smooth(host[s or "", h or ""], smooth(suffix[s or ""], whole))
            claim = [math.log((c + 0.5) / (t + 0.5 * len(said))) for c, t in zip(said[d or ""], total)] if d else [0.0] * len(LANGS)
            out[i] = norm([a + b + math.log(c) for a, b, c in zip(ll[i], claim, prior)])
    return out


def test_posterior(spark):
    r = random.Random(1)
    table = np.log(np.random.default_rng(2).dirichlet(np.full(1 << L.HASH_BITS, 0.5), len(LANGS)) + 1e-9).astype(np.float32)
    some = lambda: "".join(r.choice("abcdeé ") for _ in range(r.choice([0, 2, 4, 8, 60, 400])))
    rows = [(i, some(), r.choice(["h1", "h2", "h3", None]), r.choice(["de", "en", "fr", "it", None]), r.choice(["de", "com", None])) for i in range(150)]
    rows += [(200 + i, *rows[3][1:]) for i in range(3)]  # repeated texts
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, declared string, suffix string")
    got = {x.doc_id: x for x in L.identify(df, LANGS, table, F.col("host"), F.col("declared"), F.col("suffix")).collect()}
    want = plain(rows, table)
    assert len(got) == len(rows) and 20 < len(want) < len(rows)
    for i, x in got.items():
        if i in want:
            assert abs(x.probability - max(want[i])) < 1e-6
            assert x.lang == (LANGS[int(np.argmax(want[i]))] if x.probability >= 0.6 else L.UNKNOWN)
        else:
            assert not x.kept and x.lang == L.UNKNOWN


def test_ties_and_long_texts(spark):
    """Equal evidence for two languages is no clear evidence; a text of many slices is judged whole."""
    table = np.full((2, 1 << L.HASH_BITS), -math.log(1 << L.HASH_BITS), np.float32)
    long = "zz " * 10 + "abcd " * 600_000
    code, _ = L.grams(np.frombuffer(b"abcd abcd ", np.uint8), np.array([0, 10]))
    tilt = table.copy()
    tilt[1, np.unique(code)] += 1
    df = spark.createDataFrame([(1, "no odds", "h"), (2, long, "h")], "doc_id long, text string, host string")
    tie = {x.doc_id: x for x in L.identify(df, ["de", "en"], table, F.col("host"), F.lit(None), F.lit(None)).collect()}
    assert all(x.lang == L.UNKNOWN and abs(x.probability - 0.5) < 1e-9 for x in tie.values())
    got = {x.doc_id: x.lang for x in L.identify(df, ["de", "en"], tilt, F.lit(None), F.lit(None), F.lit(None)).collect()}
    assert got[2] == "en"


def test_the_label_is_no_evidence(spark):
    """A document's own label does not sway its answer."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit_text_model(docs)
    a = {x.doc_id: (x.lang, round(x.probability, 9)) for x in L.identify_documents(docs, model=model).collect()}
    b = {x.doc_id: (x.lang, round(x.probability, 9)) for x in L.identify_documents(docs.withColumn("lang", F.lit("xx")), model=model).collect()}
    assert a == b
