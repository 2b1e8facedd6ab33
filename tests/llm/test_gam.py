import zlib

import numpy as np
from pagemill.llm.gam import FEATURES, features, fit, score
from pyspark.sql import functions as F


def test_learns_an_interaction():
    g = np.random.default_rng(1)
    x = g.uniform(0, 1, (4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = fit(x[:3000], y[:3000])
    assert {m.pairs[0][:2]} == {(0, 1)}
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    # a score is the sum of its table entries
    row = x[3500]
    total = m.base + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(m.edges, m.tables, row))
    total += sum(t[np.searchsorted(m.coarse[i], row[i], "right"), np.searchsorted(m.coarse[j], row[j], "right")] for i, j, t in m.pairs)
    assert abs(m.margin(row[None])[0] - total) < 1e-12


def test_features_by_hand():
    t = b"ab ab cd\nab ab cd\n"
    x = dict(zip(FEATURES, features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]))
    assert abs(x["log_words"] - np.log(7)) < 1e-12 and x["word_length"] == 2
    assert abs(x["distinct_words"] - 2 / 6) < 1e-12 and abs(x["top_word"] - 4 / 6) < 1e-12
    assert x["dup_lines"] == 0.5


def test_slices_do_not_matter(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()
    raw = [(r.text or "").encode() for r in rows]
    off = np.append(0, np.cumsum([len(t) for t in raw]))
    whole = features(np.frombuffer(b"".join(raw), np.uint8), off)
    for i, t in enumerate(raw):
        assert np.allclose(whole[i], features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality", "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    y, s = got.quality.to_numpy(), got.score.to_numpy()
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    print("held out", len(y), "AUC", auc, "accuracy", (got.predicted == y).mean())
    assert auc > 0.95 and (got.predicted == y).mean() > 0.93
    assert (s[got.predicted == 1] >= 0.3).all()


def test_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (2, "", 0.2), (None, "x y", None)], "doc_id long, text string, score double")
    got = score(docs, labels).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    assert score(docs.limit(0), labels).count() == 0
    some = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in score(docs.select("doc_id", F.col("text")), some).collect())
