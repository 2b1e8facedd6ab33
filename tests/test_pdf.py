import struct
import zlib

import numpy as np
import pytest
from pagemill import api
from pagemill.sources import datasource, scans
from pagemill.sources.extract import cmyk_to_rgb, page_images, page_text, png
from pagemill.sources.syntax import PdfError, ascii85, load, lzw, png_predictor, run_length, tiff_predictor

from tests.pdf_writer import lines, simple


def frame(spark, *files):
    return spark.createDataFrame([(f"d{i}", bytearray(f)) for i, f in enumerate(files)], "doc_id string, content binary")


def read_png(data):
    w, h, _, kind = struct.unpack(">IIBB", data[16:26])
    n = {0: 1, 2: 3, 6: 4}[kind]
    size = struct.unpack(">I", data[33:37])[0]
    rows = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(h, 1 + w * n)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and not rows[:, 0].any()
    return rows[:, 1:].reshape(h, w, n)


def encode_rows(x, kind, pixel):
    """PNG filters, written forward."""
    out, prev = [], np.zeros(x.shape[1], int)
    for row in x.astype(int):
        left = np.concatenate([np.zeros(pixel, int), row[:-pixel]])
        corner = np.concatenate([np.zeros(pixel, int), prev[:-pixel]])
        if kind == 4:
            p = left + prev - corner
            a, b, c = abs(p - left), abs(p - prev), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, prev, corner))
        else:
            guess = [0, left, prev, (left + prev) // 2][kind]
        out.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        prev = row
    return b"".join(out)


@pytest.mark.parametrize("kind", range(5))
def test_png_predictors(kind):
    x = np.random.default_rng(kind).integers(0, 256, (7, 12)).astype(np.uint8)
    assert png_predictor(encode_rows(x, kind, 3), 3, 12) == x.tobytes()
    assert png_predictor(b"\x05" + bytes(12), 3, 12) is None and png_predictor(bytes(12), 3, 12) is None


def test_other_filters():
    x = np.random.default_rng(1).integers(0, 256, (5, 9)).astype(np.uint8)
    d = x.copy()
    d[:, 3:] -= x[:, :-3]
    assert tiff_predictor(d.tobytes(), 3, 9) == x.tobytes()
    import base64

    raw = bytes(range(256)) + bytes(9)
    assert ascii85(base64.a85encode(raw) + b"~>") == raw
    assert run_length(b"\x02abc\xfed\x80zz") == b"abcddd"
    assert lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


@pytest.mark.parametrize("kw", [{}, {"xref_stream": True}, {"tail": False}])
def test_text_by_any_cross_reference(spark, kw):
    f = simple([lines(b"Hello (PDF) world", b"Caf\xe9 \\ x"), lines(b"second")], **kw)
    got = {(r.page): r.text for r in api.page_text(frame(spark, f)).collect()}
    assert got == {1: "Hello (PDF) world\nCafé \\ x\n", 2: "second\n"}


def test_structure_and_artifacts(spark):
    pages = [lines(b"Report 2024", b"body %d" % i, b"Page %d of 5" % i, b"/", b"5") for i in range(1, 6)]
    got = sorted(api.structured_text(frame(spark, simple(pages))).collect(), key=lambda r: r.page)
    assert [(r.header, r.body, r.footer) for r in got] == [("Report 2024", f"body {i}", f"Page {i} of 5") for i in range(1, 6)] or got[0].header.startswith("Report 2024")
    short = api.structured_text(frame(spark, simple(pages[:2]))).collect()
    assert all(r.header == "" and r.footer == "" for r in short)


def test_fonts():
    cmap = b"1 beginbfchar <01> <00660069> endbfchar 1 beginbfrange <02> <03> <0041> endbfrange"
    f = simple([b"BT /F2 9 Tf <010203> Tj /F3 9 Tf (ab) Tj /F4 9 Tf <00410042> Tj [(x) -300 (y)] TJ ET"], extra={
        4: {"Type": "/Font", "Subtype": "/Type1", "ToUnicode": "5 0 R"}, 5: ({}, cmap), 6: {"Type": "/Font", "Subtype": "/Type1", "Encoding": {"Differences": [97, "/eacute", "/uni20AC"]}}, 7: {"Type": "/Font", "Subtype": "/Type0"},
    }, page_keys={0: {"Resources": {"Font": {"F2": "4 0 R", "F3": "6 0 R", "F4": "7 0 R"}}}})
    doc = load(f)
    assert page_text(doc, doc.pages()[0]).startswith("fiABé€AB")


def image(data, w, h, space="/DeviceRGB", bits=8, **keys):
    return ({"Type": "/XObject", "Subtype": "/Image", "Width": w, "Height": h, "ColorSpace": space, "BitsPerComponent": bits, "Filter": "/FlateDecode"} | keys, zlib.compress(data))


def with_images(contents, objects, names):
    return simple([contents], extra=objects, page_keys={0: {"Resources": {"XObject": names}}})


def test_images(spark):
    g = np.random.default_rng(2)
    rgb, gray, cmyk, alpha = g.integers(0, 256, (4, 5, 3), np.uint8), g.integers(0, 256, (4, 5, 1), np.uint8), g.integers(0, 256, (4, 5, 4), np.uint8), g.integers(0, 256, (4, 5, 1), np.uint8)
    deep = g.integers(0, 65536, (4, 5), np.uint16)
    parms = {"Predictor": 15, "Colors": 3, "BitsPerComponent": 8, "Columns": 5}
    objects = {
        20: image(rgb.tobytes(), 5, 4), 21: image(gray.tobytes(), 5, 4, "/DeviceGray"), 22: image(cmyk.tobytes(), 5, 4, "/DeviceCMYK"), 23: image(rgb.tobytes() + b"xx", 5, 4, SMask="24 0 R"), 24: image(alpha.tobytes(), 5, 4, "/DeviceGray"),
        25: image(deep.astype(">u2").tobytes(), 5, 4, "/DeviceGray", 16), 26: image(encode_rows(rgb.reshape(4, 15), 4, 3), 5, 4, DecodeParms=parms), 27: image(b"short", 5, 4), 28: image(b"", 0, 4),
        29: ({"Subtype": "/Form"}, b"/InForm Do"), 30: image(gray.tobytes(), 5, 4, ["/ICCBased", "31 0 R"]), 31: ({"N": 1}, b""), 32: image(b"\xff\xd8", 5, 4, Filter="/DCTDecode"),
    }
    names = {"A": "20 0 R", "B": "21 0 R", "C": "22 0 R", "D": "23 0 R", "E": "25 0 R", "F": "26 0 R", "Short": "27 0 R", "Zero": "28 0 R", "Fm": "29 0 R", "InForm": "30 0 R", "Unpainted": "20 0 R", "Jpeg": "32 0 R"}
    f = with_images(b"/A Do /B Do /C Do /D Do /E Do /F Do /Short Do /Zero Do /Fm Do /Jpeg Do", objects, names)
    rows = sorted(api.page_images(frame(spark, f)).collect(), key=lambda r: r.image_index)
    assert [r.xobject_name for r in rows] == ["A", "B", "C", "D", "E", "F", "InForm"] and [r.image_index for r in rows] == list(range(7))
    pix = {r.xobject_name: read_png(r.data) for r in rows}
    assert (pix["A"] == rgb).all() and (pix["B"] == gray).all() and (pix["F"] == rgb).all() and (pix["E"][..., 0] == deep >> 8).all()
    assert (pix["D"] == np.concatenate([rgb, alpha], 2)).all() and (pix["C"] == cmyk_to_rgb(cmyk).reshape(4, 5, 3)).all()
    by = {r.xobject_name: r for r in rows}
    assert by["InForm"].color_space == "ICCBased1" and by["A"].filter == "FlateDecode" and by["A"].object_id == "20 0 obj"
    # nothing painted: everything counts; a decoder makes JPEG rows
    g2 = with_images(b"", objects, names)
    doc = load(g2)
    kept = [r["xobject_name"] for r in page_images(doc, doc.pages()[0], {"DCTDecode": lambda b: np.zeros((4, 5, 3), np.uint8)})]
    assert "Unpainted" in kept and "Jpeg" in kept


def test_annotations_metadata_boxes(spark):
    pages = [b"", b"", b"", b""]
    extra = {
        40: {"Creator": b"\xfe\xff\x00A\x00\xe9\x00", "Producer": b"p\xff", "CreationDate": b"D:20240131101502+05'30'", "ModDate": b"20"}, 41: {"Subtype": "/Link", "Rect": [1, 2.5, 3, 4, "/x"], "A": "42 0 R"}, 42: {"S": "/URI", "URI": b"http://a/"},
    }
    keys = {0: {"Annots": ["41 0 R", {"Subtype": "/Link", "Dest": "/here", "Contents": b"note"}], "CropBox": [100, 200, 0, 0]}, 1: {"CropBox": [1, 2, 3]}, 2: {"CropBox": [0, 0, 100, 200]}, 3: {"Annots": [{"A": {"URI": b"u"}}]}}
    docs = frame(spark, simple(pages, extra=extra, page_keys=keys, info="40 0 R", version="1.4"))
    notes = {(r.page, r.annotation_index): r for r in api.page_annotations(docs).collect()}
    assert notes[1, 0].uri == "http://a/" and notes[1, 0].rect == [1.0, 2.5, 3.0, 4.0] and notes[1, 1].dest == "here" and notes[1, 1].content == "note" and notes[4, 0].subtype == ""
    m = api.metadata(docs).first()
    assert (m.page_count, m.version, m.is_linearized, m.creator, m.producer, m.creation_date, m.modification_date) == (4, "1.4", False, "Aé", "p�", "2024-01-31T10:15:02+05:30", "20")
    a, b = m.page_boxes
    # two groups of two pages: the later one is dominant
    assert (a.box_type, a.right, a.top, a.pages) == ("CropBox", 100.0, 200.0, [1, 3]) and (b.box_type, b.right, b.pages) == ("MediaBox", float(np.float32(595.276)), None)
    d = api.document(docs).first()
    assert d.total_annotations == 3 and d.annotation_pages == [1, 4] and d.total_images == 0 and d.image_pages == [] and len(d.text) == len(d.structured_text) == 4


def test_bad_files(spark):
    docs = frame(spark, b"no pdf", simple([lines(b"ok")]), b"%PDF-1.7\n garbage")
    assert [r.text for r in api.page_text(docs, "skip").collect()] == ["ok\n"]
    said = {r.doc_id: r.error for r in scans.load_errors(docs).collect()}
    assert set(said) == {"d0", "d2"} and all(e.startswith("Failed to load PDF: ") for e in said.values())
    with pytest.raises(Exception, match="Failed to load PDF"):
        api.page_text(docs).collect()
    with pytest.raises(PdfError):
        load(None)


def test_cascade(spark):
    g = np.zeros((4, 5, 1), np.uint8)
    scanned = with_images(b"/A Do", {20: image(g.tobytes(), 5, 4, "/DeviceGray")}, {"A": "20 0 R"})
    vector = simple([b"0 0 m 1 1 l S " * 5])
    docs = frame(spark, simple([lines(b"native")]), scanned, vector, simple([b""]))
    engine = lambda x, lang: "" if x.shape[2] == 1 and x.max() > 0 else f" {lang} {x.shape[1]} "
    draw = lambda data, page, dpi: np.zeros((3, dpi, 3), np.uint8)
    run = lambda **kw: {r.doc_id: (r.text, r.source) for r in api.page_text_ocr(docs, api.OcrOptions(**kw)).collect()}
    assert run() == {"d0": ("native\n", "Native"), "d1": ("", "Ocr"), "d2": ("", "Ocr"), "d3": ("", "Ocr")}
    auto = run(engine=engine, renderer=draw)
    assert auto == {"d0": ("native\n", "Native"), "d1": ("eng 5", "Ocr"), "d2": ("eng 300", "Rendered"), "d3": ("", "Ocr")}
    assert run(engine=engine, renderer=draw, max_threads=1) == auto
    every = run(engine=engine, renderer=draw, render="Always", render_dpi=10)
    assert every == {"d0": ("eng 72", "Rendered"), "d1": ("eng 5", "Ocr"), "d2": ("eng 72", "Rendered"), "d3": ("eng 72", "Rendered")}
    assert run(engine=engine, renderer=draw, render="Never")["d2"] == ("", "Ocr")
    assert {r.source for r in api.structured_text_ocr(docs, api.OcrOptions(engine=engine)).collect()} == {"Native", "Ocr"}
    assert api.document_ocr(docs).count() == 4
    shown = api.render_pages(docs, draw, "Auto", 1000).collect()
    assert {(r.doc_id, r.width, r.dpi) for r in shown} == {("d2", 600, 600), ("d3", 600, 600)}
    assert api.render_pages(docs, draw).count() == 4 and api.render_pages(docs, mode="Never").count() == 0
    with pytest.raises(RuntimeError):
        api.render_pages(docs)
    assert tuple(api.capabilities(spark).first()) == (False, False)


def test_sql_source_and_stream(spark, tmp_path):
    from pagemill.streaming.extract import stream_page_text

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(simple([lines(b"file %d" % i)] * (i + 1)))
    docs = scans.read_pdfs(spark, str(tmp_path / "in"))
    scans.register(spark)
    docs.createOrReplaceTempView("files")
    want = sorted(f"file {i}\n" for i in range(3) for _ in range(i + 1))
    assert sorted(r.text for r in spark.sql("SELECT t.text FROM files, LATERAL pdf_pages(content) t").collect()) == want
    spark.dataSource.register(datasource.PdfDataSource)
    assert sorted(r.text for r in spark.read.format("pdf").load(str(tmp_path / "in")).collect()) == want
    assert spark.read.format("pdf").option("relation", "meta").load(str(tmp_path / "in")).count() == 3
    stream_page_text(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_png_round_trip():
    x = np.random.default_rng(3).integers(0, 256, (3, 4, 4), np.uint8)
    assert (read_png(png(x)) == x).all()
