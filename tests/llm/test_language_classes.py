import math

import numpy as np
from pagemill.llm import language as L
from pyspark.sql import functions as F

GREEK = "και το της ειναι που στην απο για με "


def test_a_rare_language_is_learned_at_any_size(spark):
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("the and of that with this ").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("h"), F.col("id") % 50).alias("source"))
    rare = spark.createDataFrame([(50_000, GREEK * 20, "el", "gr"), (None, "или что это как они " * 20, "ru", "ru")], "doc_id long, text string, lang string, source string")
    docs = many.unionByName(rare)
    langs, table = L.fit_text_model(docs)
    assert langs == ["el", "en", "ru"] and table.shape[0] == 3
    got = L.identify_documents(docs).where("doc_id = 50000 or doc_id is null").collect()
    assert {(r.doc_id, r.lang, r.kept) for r in got} == {(50_000, "el", True), (None, "ru", True)}


def test_more_than_64_languages(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 2} " * 20, f"l{i:03d}", "h") for i in range(70) for _ in range(2)]
    langs, _ = L.fit_text_model(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert langs == sorted({r[2] for r in rows})


def test_copies_of_one_row_leave_their_language(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("abc def ghi").alias("text"), (F.col("id") % 7).cast("string").alias("lang"))
    assert L.fit_text_model(docs, each=5)[0] == [str(i) for i in range(7)]


def test_the_sample_of_a_language_is_bounded(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("abc "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 100, "b").otherwise("a").alias("lang"))
    _, table = L.fit_text_model(docs, each=200)
    code = int(table[0].argmax())
    rows = [float(p) for p in table[:, code]]  # 'abc' once in each row: (n + 0.5) / (total + 0.5 * codes)
    per = (1 << L.HASH_BITS) * 0.5
    grams = len(L.grams(*_one(b"abc 1"))[0])
    n = [(math.exp(p) * per - 0.5) / (1 - math.exp(p) * grams) for p in rows]
    assert 140 < n[0] < 260 and round(n[1]) == 100


def _one(raw):
    return np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
