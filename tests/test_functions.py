import pytest
from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators import boxes as B
from pagemill.operators import relations as R
from pagemill.operators.structure import structured_text
from pagemill.sources.extract import box
from pyspark.sql import functions as F

# (text, page count, result): a pair '/', count goes; anything else stays as it is, byte for byte
ARTIFACTS = [
    ("one\n/\n12\ntwo", "12", "one\ntwo"), ("a\n  / \n 12\t\nb", "12", "a\nb"), ("a\n/\n13\nb", "12", "a\n/\n13\nb"), ("/\n3\nx\n/\n3\ny", "3", "x\ny"),
    ("/\n3\nx", "3", "x"), ("x\n/\n3", "3", "x"), ("", "3", ""), ("/", "3", "/"), ("/\n3\n/\n3", "3", ""), ("x\n/ 3\ny", "3", "x\n/ 3\ny"),
    ("x\n/\n33\ny", "3", "x\n/\n33\ny"), ("3\n/\nx", "3", "3\n/\nx"), ("x\r\n/\r\n3\r\ny\r\n", "3", "x\ny"), ("x\r\ny\r\n", "3", "x\r\ny\r\n"), ("a\n /　\n3\n", "3", "a"), ("/\n/\n3", "3", "/"),
]
DATES = [
    ("D:20240131101502+05'30'", "2024-01-31T10:15:02+05:30"), ("20240131101502Z", "2024-01-31T10:15:02Z"), ("D:2024", "2024-01-01T00:00:00"), ("D:202", "D:202"), ("", ""), ("D:20241", "2024-01-01T00:00:00"),
    ("D:202412", "2024-12-01T00:00:00"), ("D:20240131101502-08", "2024-01-31T10:15:02-08:00"), ("D:20240131101502-0", "2024-01-31T10:15:02"), ("D:20240131101502Z00'00'", "2024-01-31T10:15:02Z"), ("abcdefgh", "abcd-ef-ghT00:00:00"), ("D:20240131+02'00'", "2024-01-31T+0:2':00"),
]


def test_footer_artifacts(spark):
    df = spark.createDataFrame([(i, t, int(n)) for i, (t, n, _) in enumerate(ARTIFACTS)], "i int, t string, n long")
    got = {r.i: r.x for r in df.select("i", T.strip_footer_artifacts(F.col("t"), F.col("n")).alias("x")).collect()}
    assert [got[i] for i in range(len(ARTIFACTS))] == [w for _, _, w in ARTIFACTS]


def test_dates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DATES)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", T.pdf_date_to_iso(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(DATES))] == [w for _, w in DATES]


def test_lines(spark):
    texts = ["", "\n", "a", "a\n", "a\r\nb\r", "\n\n", "a\rb\n"]
    want = [[], [""], ["a"], ["a"], ["a", "b\r"], ["", ""], ["a\rb"]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.lines(F.col("t")).alias("l"), T.normalise_line(F.lit("  Page 12/340 \t")).alias("n"), T.visible_chars(F.lit("a  b\n")).alias("v"))
    rows = {r.i: r for r in df.collect()}
    assert [rows[i].l for i in range(len(texts))] == want and rows[0].n == "Page <NUM>/<NUM>" and rows[0].v == 2


@pytest.mark.parametrize("value, want", [([0, 0, 612, 792], [0.0, 0.0, 612.0, 792.0]), ([0.5, 1.5, 2.5, 3.5], [0.5, 1.5, 2.5, 3.5]), ([0, 1.5, 2, 3], [0.0, 1.5, 2.0, 3.0]), ([0, 0, 612], None), ([0, b"x", 1, 2], None), (7, None), ([1, 2, 3, 4, b"x"], [1.0, 2.0, 3.0, 4.0])])
def test_box_values(value, want):
    assert box(value) == want


def test_signed_zero_and_ties(spark):
    rows = [("d", 1, [0.0, 0.0, 1.0, 1.0]), ("d", 2, [-0.0, 0.0, 1.0, 1.0]), ("d", 3, None), ("e", 1, [5.0, 5.0, 1.0, 2.0])]
    got = B.page_boxes(B.page_geometry(spark.createDataFrame(rows, "doc_id string, page long, crop array<double>").withColumn("media", F.lit(None).cast("array<double>")))).collect()
    d = sorted((r for r in got if r.doc_id == "d"), key=lambda r: r.box_index)
    assert [r.box_type for r in d] == ["CropBox", "CropBox", "Unknown"] and [r.pages for r in d] == [[1], [2], None] and all(r.page_count == 3 for r in d)
    e = next(r for r in got if r.doc_id == "e")
    assert (e.left, e.bottom, e.right, e.top, e.width, e.height, e.pages) == (1.0, 2.0, 5.0, 5.0, 4.0, 3.0, None)


def test_detector_rules(spark):
    def run(pages):
        df = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(pages)], "doc_id string, page long, text string")
        return [tuple(r)[2:] for r in sorted(structured_text(df).collect(), key=lambda r: r.page)]

    # split by position on every page, even one that differs; 3 of 5 is enough
    five = ["H 1\nx\nF", "H 2\ny\nF", "H 3\nz\nF", "other\nw\nF", "\n\nv\nG"]
    assert run(five) == [("H 1", "x", "F"), ("H 2", "y", "F"), ("H 3", "z", "F"), ("other", "w", "F"), ("", "\nv", "G")]
    # a blank line at a position ends the prefix; the body loses its last newline
    assert run(["a\n\nb\nx1\n", "a\n\nb\ny2\n", "a\n\nb\nz z\n"]) == [("a", "\nb\nx1", ""), ("a", "\nb\ny2", ""), ("a", "\nb\nz z", "")]
    # what the header has taken is not counted again from below
    assert run(["a"] * 3) == [("a", "", "")] * 3
    assert run(["a\n", "b"]) == [("", "a\n", ""), ("", "b", "")]
    assert run(["", "", ""]) == [("", "", "")] * 3


def test_sizes(spark):
    df = spark.createDataFrame([(595.276, None), (612.0, 10), (612.0, 1000)], "p double, d int").select(G.normalise_dpi(F.col("d")).alias("d"), G.pixels(F.col("p"), G.normalise_dpi(F.col("d"))).alias("w"), G.single(F.col("p")).alias("s"))
    assert [tuple(r)[:2] for r in df.collect()] == [(300, 2480), (72, 612), (600, 5100)] and df.first().s == 595.2760009765625


def test_ancestors(spark):
    rows = [("a", "b", None), ("b", "c", "bad"), ("c", None, "good"), ("x", "y", None), ("y", "x", None), ("z", "gone", None)]
    df = spark.createDataFrame(rows, "id string, parent string, v string")
    assert {r.id: r.found for r in R.nearest_ancestor(df, "v", depth=8).collect()} == {"a": "bad", "b": "bad", "c": "good", "x": None, "y": None, "z": None}
    assert {r.id: r.found for r in R.nearest_ancestor(df, "v", F.col("v") == "good", depth=8).collect()}["a"] == "good"
