import numpy as np
import pytest
from pagemill import api
from pagemill.functions.text import quoted_path
from pagemill.sources import extract, scans
from pagemill.sources.datasource import grouped
from pagemill.sources.syntax import load
from pagemill.sources.writer import document
from pyspark.sql import functions as F

GRAY = ("im", "Image", 2, 2, "DeviceGray", 8, b"\x07" * 4)


def docs_of(spark, **files):
    return spark.createDataFrame(list(files.items()), "doc_id string, content binary")


def test_one_parse_serves_all_relations(spark):
    d = docs_of(spark, a=document([{"lines": ["one"], "media": [0, 0, 10, 20], "links": [("Link", "http://x", None, [1, 2])], "objects": [GRAY]}, {"lines": ["two"]}], {"Creator": b"me"}), b=document([{"lines": []}]))
    parsed = api.parse(d)
    for f in (api.page_text, api.structured_text, api.page_images, api.page_annotations, api.page_boxes, api.metadata, api.document):
        assert sorted(map(str, f(parsed).collect())) == sorted(map(str, f(d).collect())), f
    plan = api.document(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # what is left reads the parsed table
    assert [r.doc_id for r in api.in_order(api.page_text(parsed)).collect()] == ["a", "a", "b"]


def test_only_pages_that_need_it_reach_the_engines(spark):
    pages = [{"lines": ["enough"], "objects": [GRAY]}, {"objects": [GRAY]}, {"objects": [("f", "Form", None, None, None, None, b"")]}, {}]
    calls = spark.sparkContext.accumulator(0)
    drawn = spark.sparkContext.accumulator(0)

    def engine(x, lang):
        calls.add(1)
        return "" if x.shape[2] == 1 and x[0, 0, 0] == 9 else f"read {x[0, 0, 0]}"

    def renderer(data, page, dpi):
        drawn.add(1)
        return np.full((1, 1, 1), 100 + page, np.uint8)

    out = {r.page: (r.text, r.source) for r in api.page_text_ocr(docs_of(spark, a=document(pages)), api.OcrOptions(engine=engine, renderer=renderer, max_threads=1)).collect()}
    assert out == {1: ("enough\n", "Native"), 2: ("read 7", "Ocr"), 3: ("read 103", "Rendered"), 4: ("", "Ocr")}
    assert drawn.value == 1 and calls.value == 2


def test_a_page_that_cannot_be_drawn_loses_itself_only(spark):
    def renderer(data, page, dpi):
        if page == 2:
            raise OSError("no")
        return np.zeros((1, 1, 3), np.uint8)

    d = docs_of(spark, a=document([{}, {}, {}]))
    assert sorted(r.page for r in api.render_pages(d, renderer).collect()) == [1, 3]
    out = api.page_text_ocr(d, api.OcrOptions(engine=lambda x, lang: "t", renderer=renderer, render="Always")).collect()
    assert {r.page: r.text for r in out} == {1: "t", 2: "", 3: "t"}


def test_images_of_other_formats_count_as_images():
    jpeg = ("j", "Image", 2, 2, "DeviceRGB", 8, b"\xff\xd8\xff\xe0 and so on")
    raw = document([{"objects": [jpeg]}, {"objects": [(*jpeg[:6], b"nothing")]}]).replace(b"/ColorSpace", b"/ColorSpace")
    doc = load(raw)
    refs = doc.pages()
    for n in range(2):
        for _, _, s in extract.painted_streams(doc, refs[n]):
            s.dict[b"Filter"] = [s.dict[b"Filter"], type(s.dict[b"Filter"])(b"DCTDecode")]
    assert [extract.has_image(doc, r) for r in refs] == [True, False]


def test_code_ranges_of_any_size():
    m = extract._cmap(b"2 beginbfrange <000000> <02FFFF> <0041> <030000> <030001> [<0061> <0062>] endbfrange 1 beginbfchar <05> <007A> endbfchar")
    assert m.get((0).to_bytes(3, "big")) == "A" and m.get((0x10005).to_bytes(3, "big")) == "F" and m.get((0x30001).to_bytes(3, "big")) == "b"
    assert m.get(b"\x05") == "z" and m.get(b"\x06") is None and m.get((0x30002).to_bytes(3, "big"), "") == ""


def test_content_streams():
    """Text sees streams apart; names and operators are read from the bytes joined as they are, and a Do paints its first operand."""
    raw = document([{"objects": [GRAY, ("other", "Image", 1, 1, "DeviceGray", 8, b"\1")], "paint": ["im"]}])
    doc = load(raw)
    page = doc.pages()[0]
    assert extract.raw_content(doc, page) == extract.content(doc, page)
    names = {bytes(a[0]) for op, a in extract.operations(b"/a /b Do") if op == b"Do"}
    assert names == {b"a"} and extract.painted_names(doc, page, extract.xobjects_of(doc, page)) == {b"im"}


def test_files_share_partitions():
    files = [(f"f{i}", 10) for i in range(7)] + [("big", 100)]
    assert [len(g) for g in grouped(files, bytes_each=35, files_each=3)] == [3, 3, 1, 1]
    assert [len(g) for g in grouped(files, bytes_each=1000, files_each=3)] == [3, 3, 2]
    assert grouped([]) == []


def test_settings(monkeypatch):
    assert quoted_path('List of languages in "/usr/share/data/" (2):') == "/usr/share/data/"
    assert quoted_path("nothing", 'x "a" "b"') == "a" and quoted_path("nothing", 'one " only') is None
    assert api.threads_of(0) == 1 and api.threads_of(10**6) >= 1 and api.threads_of(None) <= 4
    monkeypatch.setattr(api, "_bound", {})
    monkeypatch.setenv("RENDER_LIBRARY_PATH", "/env")
    asked = []
    assert api.first_binding("/given", lambda p: asked.append(p) or ((lambda: p) if p == "/env" else None))() == "/env"
    assert asked == ["/given", "/env"] and api.first_binding("/other", lambda p: None)() == "/env"
    monkeypatch.setattr(api, "_bound", {})
    with pytest.raises(RuntimeError):
        api.first_binding(None, lambda p: None)


def test_batches_are_closed_by_text_too():
    assert scans.weight({"page": 1, "text": "x" * 1000, "data": None}) > 1000


def test_body_text(spark):
    rows = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 3, " \n"), ("b", 1, "")], "doc_id string, page long, body string")
    assert [tuple(r) for r in api.body_text(rows).orderBy(F.col("doc_id")).collect()] == [("a", "one\n\ntwo")]
