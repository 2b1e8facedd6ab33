"""Tasks, batches and rounds that go by the size of the input."""

from pyspark.sql import functions as F

from pagemill.sources import writer
from pagemill.sources.syntax import Lexer, Ref, Word


def _docs(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.array(F.lit("a line")).alias("lines"))


def test_small_rows_are_written_by_many_tasks(spark):
    """files take much longer than the bytes of their rows suggest, so tasks are not put together by these."""
    files = writer.write(_docs(spark, 500), lambda rows: (rows, None))
    assert files.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert files.count() == 500


def test_zeros_keep_their_sign():
    assert writer._value([0.0, -0.0, 1.5, 0.0]) == b"[0 -0 1.5 0]"


def test_tokens():
    values = lambda data: [Lexer(data).value()]
    assert values(b"% 1 0 R (\n<</A 1 0 R/B[1 -2.5 3]/C/D/E 7/F[1 0 R 2]/G (x)>>") == [{b"A": Ref(1, 0), b"B": [1, -2.5, 3], b"C": b"D", b"E": 7, b"F": [Ref(1, 0), 2], b"G": b"x"}]
    assert values(b"% only (a) comment") == [Word(b"")]


def test_batches_to_python_are_bounded_in_bytes(spark):
    """a batch was bounded in rows only, so that long texts made it as long as they are."""
    import pyarrow as pa
    from pagemill.sources import scans

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    scans.scan(spark.createDataFrame([("a", b"")], "doc_id string, content binary"), lambda doc: [], scans.TEXT)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    found = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("t")).mapInArrow(sizes, "n long").collect()
    assert len(found) > 1 and max(r.n for r in found) < 5 << 20
    assert scans.weight({"a": "x" * 100, "b": [1.0] * 4, "c": None}) > 900


def test_long_lists_are_ranked_by_rulers(spark, tmp_path):
    """the list is ranked without taking all of it along in every round."""
    from pagemill.operators.trees import enumerate_nodes

    rows = [("a", i, None if i == 0 else i // 2 if i % 3 else i - 1, i % 5) for i in range(1500)] + [("c", 1, 2, 0), ("c", 2, 1, 0), ("u", 1, 9, 0), (None, 1, None, 0)]
    rows += [("s", i, i - 1 if i else None, 0) for i in range(700)] + [("x", i, (i + 1) % 300, 0) for i in range(300)]
    spark.createDataFrame(rows, "doc_id string, id long, parent long, place long").write.parquet(str(tmp_path / "n"))
    n = spark.read.parquet(str(tmp_path / "n"))
    one = {(r.doc_id, r.id): r.page for r in enumerate_nodes(n, False).collect()}
    many = {(r.doc_id, r.id): r.page for r in enumerate_nodes(n, False, few=300).collect()}
    assert one == many and len(one) == 2200 and [one["s", i] for i in range(700)] == list(range(1, 701))


def test_circles_end_the_rounds(spark, monkeypatch):
    """a circle among very many objects was followed for log2 of their number of rounds."""
    from pagemill.operators import references

    tables = []
    monkeypatch.setattr(references, "cut", lambda df, cut=references.cut: tables.append(1) or cut(df))
    rows = [(i, i + 1 if i < 4 else None) for i in range(5)] + [(10, 11), (11, 10)] + [(i, None) for i in range(100, 5000)]
    objects = spark.createDataFrame(rows, "k long, r long").select(F.lit("d").alias("doc_id"), F.col("k").cast("string").alias("id"), F.parse_json(F.to_json(F.struct(F.col("r").cast("string").alias("ref")))).alias("value"))
    ends = {r.id: (r.target, r.hops) for r in references.settled(objects).where("id < 20").collect()}
    assert ends == {str(i): ("4", 4 - i) for i in range(5)} and len(tables) <= 5
