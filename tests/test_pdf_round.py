"""The way of rows through files and back: what it costs for each document, and that nothing is lost on it."""

import pyarrow as pa
from pyspark.sql import functions as F

from pagemill.plans import pdf_queries
from pagemill.sources import scans, syntax, writer
from pagemill.sources.syntax import Lexer, load

_ROWS = [{"page": k, "crop": None if k % 3 else [0.0, -0.0, 10.5, k % 2 * 7.0], "media": [0.0, 0.0, 595.0, 842.0][: 3 + k % 2]} for k in range(1, 8)]


def test_rows_are_dealt_once_before_the_files(spark):
    """rows of a document were dealt to its task, then dealt and gathered again by an aggregate for the writer."""
    plan = pdf_queries.pdf_boxes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("MapInArrow") :]
    assert plan.count("Exchange") == 2 and below.count("Exchange") == 1 and "Aggregate" not in below


def test_dictionaries_of_the_same_text_are_read_once(monkeypatch):
    """every object of every file was read token by token."""
    calls = []
    monkeypatch.setattr(Lexer, "value", lambda self, *a, value=Lexer.value: calls.append(1) or value(self, *a))
    file = writer.document(_ROWS)
    want = [{"page": r["page"], "crop": r["crop"], "media": r["media"] if len(r["media"]) == 4 else None} for r in _ROWS]
    syntax.small.cache_clear()
    assert all(list(scans.rect_rows(load(file))) == want for _ in range(100))
    assert len(calls) < 100


def test_an_end_within_a_string_ends_nothing():
    pdf = b"%PDF-1.7\n1 0 obj\n<</Type /Catalog /Pages 2 0 R>>\nendobj\n2 0 obj\n<</Kids [] /A (<<>>endobj) /B 3>>\nendobj\n3 0 obj\n<</A 1>> <</B 2>>\nendobj\ntrailer\n<</Root 1 0 R>>\n"
    doc = load(pdf)
    assert doc.get(syntax.Ref(2, 0)) == {b"Kids": [], b"A": b"<<>>endobj", b"B": 3} and doc.get(syntax.Ref(3, 0)) == {b"A": 1}


def test_flat_values():
    """rows were taken from Arrow a value at a time."""
    kind = pa.struct([("a", pa.int64()), ("b", pa.list_(pa.float64())), ("c", pa.list_(pa.struct([("d", pa.string())])))])
    held = [[{"a": 1, "b": [1.0, None, -0.0], "c": [{"d": "x"}, None]}, None], None, [], [{"a": None, "b": None, "c": []}], [{"a": 3, "b": [], "c": [{"d": None}]}]]
    for a in (pa.array(held, pa.list_(kind)), pa.array(held[3][:1] + [None] + held[0], kind), pa.array([True, None]), pa.array([1, 2], pa.int32()), pa.array([], pa.list_(kind))):
        for start in range(len(a) + 1):
            for n in range(len(a) - start + 1):
                assert repr(writer.values(a.slice(start, n))) == repr(a.slice(start, n).to_pylist())


def test_documents_are_gathered_over_batches(spark):
    """Batches end within documents, pages come in any order, and a document without an id is one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        rows = [(d, p, [0.0, 0.0, 1.0 + p, 2.0]) for d in ("a", "b", None, "c") for p in (5, 2, 1, 4, 3)]
        pages = spark.createDataFrame(rows, "doc_id string, page long, media array<double>")
        files = {d: load(bytes(c)) for d, c in writer.write(pages, lambda rows: (rows, None)).collect()}
        near = writer.write(pages.repartition(1), lambda rows: (rows, None), dealt=True).select("doc_id", F.crc32("content").alias("c")).collect()
    finally:
        spark.conf.set(name, before)
    assert {d: [r["media"][2] for r in scans.rect_rows(f)] for d, f in files.items()} == dict.fromkeys(("a", "b", None, "c"), [2.0, 3.0, 4.0, 5.0, 6.0]) and len(near) == 4
