from pagemill.operators import relations as R
from pagemill.sources.syntax import load
from pyspark.sql import functions as F

from tests.pdf_writer import pdf


def test_a_value_far_up_is_found(spark):
    rows = [(f"n{i}", f"n{i + 1}" if i < 99 else None, "top" if i == 99 else "bad" if i == 80 else None) for i in range(100)]
    rows += [(f"c{i}", f"c{(i + 1) % 70}", None) for i in range(70)] + [("into", "c0", None), ("free", None, None), ("lost", "gone", None)]
    df = spark.createDataFrame(rows, "id string, parent string, v string")
    got = {r.id: r.found for r in R.nearest_ancestor(df, "v").collect()}
    assert len(got) == len(rows) and all(got[f"n{i}"] == ("bad" if i <= 80 else "top") for i in range(100))
    assert all(got[k] is None for k in ("c0", "c69", "into", "free", "lost"))
    assert R.nearest_ancestor(df, "v", F.col("v") == "top").where("id = 'n0'").first().found == "top"


def deep(levels, cycle=False):
    objects = {1: {"Type": "/Catalog", "Pages": "10 0 R"}}
    for i in range(levels):
        up = {"Parent": f"{9 + i} 0 R"} if i else {"Parent": f"{9 + levels} 0 R"} if cycle else {"MediaBox": [0, 0, 200, 300]}
        objects[10 + i] = {"Type": "/Pages", "Count": 1, "Kids": [f"{11 + i} 0 R"]} | up
    objects[10 + levels] = {"Type": "/Page", "Parent": f"{9 + levels} 0 R"}
    return load(pdf(objects))


def test_a_box_far_up_is_inherited():
    doc = deep(100)
    (page,) = doc.pages()
    assert doc.inherited(page, b"MediaBox") == [0, 0, 200, 300]
    doc = deep(100, cycle=True)
    (page,) = doc.pages()
    assert doc.inherited(page, b"MediaBox") is None
