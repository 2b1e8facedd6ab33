import base64
import glob
import hashlib

import pyarrow.fs as pafs
import zstandard
from pagemill.llm.warc import archive_round_trip, read_archives, seek_table, write_archives


def want(rows, least=0):
    out, first = {}, {}
    for p, _, h in rows:
        first[h or ""] = min(p, first.get(h or "", p))
    for p, _, h in rows:
        b = (h or "").encode()
        again = first[h or ""] < p and len(b) >= least
        out[p] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)
    return out


def test_round_trip(spark, sf, tmp_path):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows += [(5000 + i, u, h) for i, (u, h) in enumerate([(None, None), ("http://a/\r\nX: y", ""), ("é", "é\r\n\r\nx"), ("b", rows[0][2]), ("b", "WARC/1.1\r\n\r\n" * 9)])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = archive_round_trip(df).collect()
    assert {r.page_id: tuple(r)[1:5] for r in got} == want(rows) and len(got) == len(rows)
    by = {p: h for p, _, h in rows}
    assert all(r.payload.decode() == (by[r.page_id] or "") for r in got if r.record_type == "response")


def test_frames_stand_alone(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i % 40} " * (i % 9)) for i in range(200)]
    folder = f"file://{tmp_path}/w"
    index = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, least_bytes=30, frame_bytes=2000, bundle_bytes=1500)
    assert {r.page_id: tuple(r)[1:5] for r in read_archives(index, folder).collect()} == want(rows, 30)
    ix = {(r.bundle, r.frame_start) for r in index.collect()}
    seen = set()
    files = glob.glob(f"{tmp_path}/w/*.warc.zst")
    assert len(files) > 8
    for f in files:
        src = pafs.LocalFileSystem().open_input_file(f)
        whole = b""
        for at, packed, plain in seek_table(src):
            seen.add((f.rsplit("/", 1)[1], at))
            src.seek(at)
            data = zstandard.ZstdDecompressor().decompress(src.read(packed))
            assert len(data) == plain and data.startswith(b"WARC/1.1\r\n")
            whole += data
        with open(f, "rb") as h:  # an ordinary reader skips the seek table
            assert zstandard.ZstdDecompressor().stream_reader(h, read_across_frames=True).read() == whole
    assert seen == ix


def test_edges(spark):
    assert archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rows = [(3, "u", "x", 1), (3, "u", "x", 1), (None, "u", "x", 1), (4, "v", "x", 2)]
    got = archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, offset int")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(3, "response", None), (3, "response", None), (4, "revisit", 3)]
