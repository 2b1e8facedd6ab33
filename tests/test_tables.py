import random
import re

import pytest
from pyspark.errors import AnalysisException

from pagemill.operators import relations as R
from pagemill.operators.assembly import document_chunks
from pagemill.sources.bucketed import load_bucketed, save_bucketed
from pagemill.sources.table_functions import register_table_functions


def test_page_relations_in_buckets_join_without_an_exchange(spark, tmp_path):
    text = spark.createDataFrame([(f"d{i % 7}", i // 7, f"text {i}") for i in range(70)], "doc_id string, page long, text string")
    images = spark.createDataFrame([(f"d{i % 7}", i % 10, i, f"u{i}") for i in range(90)], "doc_id string, page long, image_index long, data_url string")
    links = spark.createDataFrame([(f"d{i % 7}", i % 9, f"http://{i}") for i in range(60)], "doc_id string, page long, uri string")
    want = sorted(map(tuple, R.page_payload(text, images, links).collect()))
    t = load_bucketed(spark, save_bucketed({"text": text, "images": images, "links": links}, "in_buckets", 8, folder=str(tmp_path)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = R.page_payload(t["text"], t["images"], t["links"])
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and len(re.findall("Bucketed: true", plan)) == 3
        assert sorted(map(tuple, df.collect())) == want
        plain = R.page_payload(text, images, links)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_chunks_are_bounded_and_make_up_the_document(spark):
    rng = random.Random(3)
    rows = [("a", i, "".join(rng.choice("xyé日\n") for _ in range(rng.randrange(0, 400)))) for i in range(60)]
    rows += [("long", 1, "ab" * 5_000), ("long", 2, None), ("empty", 1, None), ("empty", 2, ""), (None, 1, "no id"), ("twice", 1, "same"), ("twice", 1, "same")]
    out = document_chunks(spark.createDataFrame(rows, "doc_id string, page long, text string"), limit=256).collect()
    whole = {}
    for r in sorted(out, key=lambda r: r.chunk):
        assert len(r.text.encode()) <= 5 * 256 and r.first_page <= r.last_page
        whole[r.doc_id] = whole.get(r.doc_id, "") + r.text
    want = {}
    for d, _, t in rows:
        want[d] = want.get(d, "") + (t or "")
    assert whole == want and sum(r.doc_id == "long" for r in out) == 40
    assert document_chunks(spark.createDataFrame([], "doc_id string, page long, text string")).collect() == []


def test_a_table_function_takes_a_table(spark):
    register_table_functions(spark)
    rows = [("d", 1, 3, i, line, {"k": i}) for i, line in enumerate(["a", "/", "3", " / ", "3 ", "/", "/", "3", "3", None, "/"])] + [("d", 2, 3, 0, "/", None), ("e", 1, None, 0, "/", None), ("e", 1, None, 1, "None", None)]
    spark.createDataFrame(rows, "doc_id string, page int, page_count int, pos int, line string, more map<string,int>").createOrReplaceTempView("some_lines")
    df = spark.sql("SELECT * FROM strip_artifacts(TABLE(some_lines) PARTITION BY (doc_id, page) ORDER BY pos)")
    assert df.schema == spark.table("some_lines").schema
    got = sorted((r.doc_id, r.page, r.pos, r.line) for r in df.collect())
    assert got == sorted([("d", 1, 0, "a"), ("d", 1, 5, "/"), ("d", 1, 8, "3"), ("d", 1, 9, None), ("d", 1, 10, "/"), ("d", 2, 0, "/"), ("e", 1, 0, "/"), ("e", 1, 1, "None")])
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM strip_artifacts(TABLE(SELECT 1 AS line, 2 AS page_count))").collect()
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM strip_artifacts(5)").collect()
