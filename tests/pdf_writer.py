"""A small deterministic PDF writer for tests."""

import zlib


def stream(d, data):
    return (d, data)


def text_of(v):
    if isinstance(v, tuple):
        d, data = v
        return text_of(d | {"Length": len(data)}) + b"\nstream\n" + data + b"\nendstream"
    if isinstance(v, dict):
        return b"<<" + b" ".join(b"/" + k.encode() + b" " + text_of(x) for k, x in v.items()) + b">>"
    if isinstance(v, (list,)):
        return b"[" + b" ".join(map(text_of, v)) + b"]"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, (int, float)):
        return str(v).encode()
    if isinstance(v, bytes):
        return b"<" + v.hex().encode() + b">"
    return v.encode()  # names with their slash, references, anything raw


def pdf(objects, info=None, xref_stream=False, version="1.7", tail=True):
    """objects: {number: value}; 1 is the catalog."""
    out, at = b"%PDF-" + version.encode() + b"\n", {}
    for n, v in objects.items():
        at[n] = len(out)
        out += f"{n} 0 obj\n".encode() + text_of(v) + b"\nendobj\n"
    size = max(objects) + 2
    trailer = {"Size": size, "Root": "1 0 R"} | ({"Info": info} if info else {})
    start = len(out)
    if xref_stream:
        at[size - 1] = start
        rows = b"".join((b"\x01" + at[n].to_bytes(4, "big") + b"\0") if n in at else b"\0\0\0\0\0\0" for n in range(size))
        rows = b"".join(b"\x02" + r for r in _up(rows, 6))
        out += f"{size - 1} 0 obj\n".encode() + text_of(({"Type": "/XRef", "W": [1, 4, 1], "Filter": "/FlateDecode", "DecodeParms": {"Predictor": 12, "Columns": 6}} | trailer, zlib.compress(rows))) + b"\nendobj\n"
    else:
        out += f"xref\n0 {size}\n".encode() + b"0000000000 65535 f \n" + b"".join((f"{at[n]:010d} 00000 n \n" if n in at else "0000000000 00000 f \n").encode() for n in range(1, size))
        out += b"trailer\n" + text_of(trailer) + b"\n"
    return out + (f"startxref\n{start}\n%%EOF\n".encode() if tail else b"")


def _up(rows, width):
    prev = bytes(width)
    for i in range(0, len(rows), width):
        cur = rows[i : i + width]
        yield bytes((a - b) & 255 for a, b in zip(cur, prev))
        prev = cur


def simple(pages, extra=None, page_keys=None, **kw):
    """pages: content streams; object 2 is the page tree, 3 a font."""
    objects = {1: {"Type": "/Catalog", "Pages": "2 0 R"}, 3: {"Type": "/Font", "Subtype": "/Type1", "BaseFont": "/Helvetica", "Encoding": "/WinAnsiEncoding"}}
    kids, n = [], 10
    for i, c in enumerate(pages):
        objects[n + 1] = ({"Filter": "/FlateDecode"}, zlib.compress(c))
        objects[n] = {"Type": "/Page", "Parent": "2 0 R", "Contents": f"{n + 1} 0 R"} | ((page_keys or {}).get(i, {}))
        kids.append(f"{n} 0 R")
        n += 2
    objects[2] = {"Type": "/Pages", "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 595.276, 842], "Resources": {"Font": {"F1": "3 0 R"}}}
    return pdf(objects | (extra or {}), **kw)


def lines(*rows):
    return b"BT /F1 12 Tf 72 700 Td " + b" ".join(b"(" + r.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj 0 -14 Td" for r in rows) + b" ET"
