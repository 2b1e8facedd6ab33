"""A small deterministic PDF writer: pages of rows as documents, for round trips and samples.

Text is written in UTF-16 codes of a composite font with an identity ToUnicode map, so
every character of a row comes back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from math import copysign

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.scan import ranges
from pagemill.plans.session import bounded_batches

#: A map of each two-byte code to the character of that number.
_MAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"


def _number(v: float) -> bytes:
    return _formatted(v) if v else b"-0" if copysign(1, v) < 0 else b"0"  # a cache takes both zeros for one


@lru_cache(4096)
def _formatted(v: float) -> bytes:
    return f"{v:.6f}".rstrip("0").rstrip(".").encode()


def _array(v: list) -> bytes:
    return b"[" + b" ".join([(_formatted(x) if x else _number(x)) if type(x) is float else _value(x) for x in v]) + b"]"


_NOTHING = zlib.compress(b"")


def _value(v) -> bytes:
    if isinstance(v, str):  # names with their slash, references
        return v.encode()
    if isinstance(v, float):
        return _number(v)
    if isinstance(v, dict):
        return b"<<" + b" ".join(b"/" + k.encode() + b" " + _value(x) for k, x in v.items()) + b">>"
    if isinstance(v, list):
        return _array(v)
    if isinstance(v, tuple):  # a stream: (dictionary, data)
        body = zlib.compress(v[1]) if v[1] else _NOTHING
        return _value(v[0] | {"Filter": "/FlateDecode", "Length": len(body)}) + b"\nstream\n" + body + b"\nendstream"
    if isinstance(v, bytes):
        return b"<" + v.hex().encode() + b">"
    return str(v).encode()


#: Objects that every file has, and a page's content without operators, as they are written.
_CATALOG = _value({"Type": "/Catalog", "Pages": "2 0 R"})
_FONT = _value({"Type": "/Font", "Subtype": "/Type0", "BaseFont": "/Sans", "Encoding": "/Identity-H", "ToUnicode": "4 0 R"})
_WRITTEN_MAP, _NO_CONTENT = _value(({}, _MAP)), _value(({}, b""))


def utf16(text: str) -> bytes:
    """A string of the information dictionary, with its mark."""
    return b"\xfe\xff" + text.encode("utf-16-be", "replace")


def page_content(page: dict) -> bytes:
    """Operators of a page: its lines, each at a place of its own, then the names it paints."""
    rows = b" ".join(_value(x.encode("utf-16-be", "replace")) + b" Tj 0 -14 Td" for x in page.get("lines") or [])
    text = b"BT /F1 12 Tf 72 700 Td " + rows + b" ET" if page.get("lines") else b""
    return text + b"".join(b" q /" + n.encode() + b" Do Q" for n in page.get("paint") or [])


def document(pages: list[dict], info: dict | None = None) -> bytes:
    """A file of the pages. Keys of a page: lines, crop, media, links [(subtype, uri, dest, rect)], paint, and
    objects [(name, subtype, width, height, space, bits, data)] as its XObjects. None leaves an entry out."""
    bodies = [_CATALOG, b"", _FONT, _WRITTEN_MAP]  # objects 1, 2, ... as they are written
    kids = []
    for page in pages:
        me = len(bodies) + 1
        node = b"<</Type /Page /Parent 2 0 R /Contents %d 0 R" % (me + 1)
        for k, v in ((b" /CropBox ", "crop"), (b" /MediaBox ", "media")):
            if page.get(v) is not None:
                node += k + _array(page[v])
        more: dict = {}
        content = page_content(page) if page.get("lines") or page.get("paint") else b""
        bodies += [b"", _value(({}, content)) if content else _NO_CONTENT]
        if page.get("links"):
            more["Annots"] = []
            for subtype, uri, dest, rect in page["links"]:
                bodies.append(_value({"Type": "/Annot", "Subtype": f"/{subtype}", "Rect": list(rect)} | ({"A": {"S": "/URI", "URI": uri.encode()}} if uri is not None else {}) | ({"Dest": dest.encode()} if dest is not None else {})))
                more["Annots"].append(f"{len(bodies)} 0 R")
        if page.get("objects"):
            held = {}
            for name, subtype, width, height, space, bits, data in page["objects"]:
                size = {k: v for k, v in (("Width", width), ("Height", height)) if v is not None}
                bodies.append(_value(({"Type": "/XObject", "Subtype": f"/{subtype}"} | size | ({"ColorSpace": f"/{space}", "BitsPerComponent": bits} if subtype == "Image" else {}), data)))
                held[name] = f"{len(bodies)} 0 R"
            more["Resources"] = {"Font": {"F1": "3 0 R"}, "XObject": held}
        bodies[me - 1] = node + (b" " + _value(more)[2:] if more else b">>")
        kids.append(b"%d 0 R" % me)
    bodies[1] = b"<</Type /Pages /Kids [%b] /Count %d /Resources <</Font <</F1 3 0 R>>>>>>" % (b" ".join(kids), len(kids))
    n = len(bodies) + 1
    root = b"<</Size %d /Root 1 0 R>>" % (n + 1)
    if info:
        bodies.append(_value({k: v for k, v in info.items() if v is not None}))
        root = b"<</Size %d /Root 1 0 R /Info %d 0 R>>" % (n + 1, n)
    out = [b"%PDF-1.7\n", *[b"%d 0 obj\n%b\nendobj\n" % x for x in enumerate(bodies, 1)]]
    at = list(accumulate(map(len, out)))
    table = b"%010d 00000 n \n" * len(bodies) % tuple(at[:-1]) + b"0000000000 00000 f \n" * (not info)
    return b"".join(out) + b"xref\n0 %d\n0000000000 65535 f \n%btrailer\n%b\nstartxref\n%d\n%%%%EOF\n" % (n + 1, table, root, at[-1])


#: Bytes of the tables read that a task writes files of; files of an output batch, and their bytes; rows taken at a time.
EACH, FILES, BATCH, ROWS = 8 << 20, 64, 4 << 20, 1024


def values(a: pa.Array) -> list:
    """What to_pylist gives; lists and structs are cut from their flat values, a call a level instead of one a value."""
    if pa.types.is_list(a.type):
        flat, at, out = values(a.flatten()), 0, []
        for n in pc.fill_null(pc.list_value_length(a), -1).to_numpy().tolist():
            out.append(None if n < 0 else flat[at : at + n])
            at += max(n, 0)
        return out
    if pa.types.is_struct(a.type):
        names = [f.name for f in a.type]
        rows = [dict(zip(names, x)) for x in zip(*map(values, a.flatten()))] if names else [{}] * len(a)
        return [r if ok else None for r, ok in zip(rows, a.is_valid().to_pylist())] if a.null_count else rows
    if (pa.types.is_integer(a.type) or pa.types.is_floating(a.type)) and not a.null_count:
        return a.to_numpy().tolist()
    return a.to_pylist()


def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str | None, list[dict]]]:
    """(doc_id, rows) of rows that come document by document, doc_id first: one is held until the next begins."""
    rows: list[dict] = []
    last = None
    for b in batches:
        names = b.schema.names[1:]
        for at in range(0, b.num_rows, ROWS):
            ids, *columns = map(values, b.slice(at, ROWS).columns)
            for doc_id, row in zip(ids, zip(*columns)):
                if doc_id != last and rows:
                    yield last, rows
                    rows = []
                last = doc_id
                rows.append(dict(zip(names, row)))
    if rows:
        yield last, rows


def write(pages: DataFrame, build, dealt: bool = False) -> DataFrame:
    """(doc_id, content) of rows (doc_id, page, ...): the rows of a document are gathered and given, by page, to ``build``.

    ``build`` takes the list of rows and returns (pages, info) of document(). The number of tasks goes by what is read: they
    work much longer than the bytes of their rows suggest, so they are not to be put together by these. ``dealt``: each
    document's rows are in one task of such size already, and stay there. Rows go to Python flat, in order, and are gathered as they come.
    """
    cols = [c for c in pages.columns if c not in ("doc_id", "page")]
    rows = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "page", *cols)
    rows = (rows if dealt else rows.repartition(ranges(pages, EACH), "doc_id")).sortWithinPartitions("doc_id", "page", *cols)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        files: list[bytes] = []
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(files, pa.binary())], names=["doc_id", "content"])
        for doc_id, held in gathered(batches):
            ids.append(doc_id)
            files.append(document(*build(held)))
            size += len(files[-1])
            if len(files) == FILES or size >= BATCH:
                yield batch()
                ids, files, size = [], [], 0
        if files:
            yield batch()

    bounded_batches(pages.sparkSession)
    return rows.mapInArrow(run, "doc_id string, content binary")
