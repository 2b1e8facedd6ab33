import time

import pytest

from pagemill.operators.structure import structured_text
from pagemill.streaming.documents import gathered, stream_structured_text

SCHEMA = "doc_id string, page long, page_count long, text string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(name, old)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_three_batches_equal_one(rocks, tmp_path):
    spark = rocks
    rows = [(d, p, n, f"Head {p}\nline {d}{p * p}\nFoot") for d, n in (("a", 5), ("b", 4), ("c", 1)) for p in range(1, n + 1)]
    late = [("open", 1, 3, "one"), ("a", 2, 5, "Head 2\nline a4\nFoot"), (None, 1, 1, "x")]
    for k in range(3):
        part = [r for i, r in enumerate(rows) if i % 3 == k] + ([late[k]] if k < len(late) else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_structured_text(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 3
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "page", "header", "body", "footer").collect())
    want = sorted(tuple(r) for r in structured_text(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "page", "header", "body", "footer").collect())
    assert got == want
    numbers = {r.doc_id: r.batch for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(numbers) == {"a", "b", "c"}


def test_a_document_that_waits_too_long_is_put_out(rocks, tmp_path):
    spark = rocks
    spark.createDataFrame([("late", 2, 3, "two"), ("late", 1, 3, None)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = gathered(stream, wait_ms=1).writeStream.format("memory").queryName("waited").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    for _ in range(60):
        time.sleep(1)
        if spark.table("waited").count():
            break
    q.stop()
    assert sorted(tuple(r) for r in spark.table("waited").collect()) == [("late", 1, "", False), ("late", 2, "two", False)]
