"""PDF files as Python objects: lexer, cross references, object streams, filters."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np


class PdfError(ValueError):
    """The bytes are not a PDF that can be read."""


class Name(bytes):
    """A name object, without its slash."""


class Ref(NamedTuple):
    number: int
    generation: int


@dataclass
class Stream:
    dict: dict
    raw: bytes


class Word(NamedTuple):
    """An operator or keyword."""

    text: bytes


WHITE = b"\x00\t\n\x0c\r "
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_HEX = re.compile(rb"#([0-9A-Fa-f]{2})")
_REGULAR, _END = rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]", rb"(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])"
_INDIRECT = rb"(\d++)[\x00\t\n\x0c\r ]++(\d++)[\x00\t\n\x0c\r ]++"
#: White space and the token after it, told apart by the last group that took part; the empty one stands for what is left.
_PARTS = [rb"/(" + _REGULAR + rb"*+)", rb"([+-]?\d++)" + _END, rb"([+-]?(?:\d++\.\d*+|\.\d++))" + _END, rb"(<<)", rb"(>>)", rb"(\[)", rb"(\])", rb"<([^>]*+)>", rb"(" + _REGULAR + rb"++)", rb"()"]
_NAME, _INT, _REAL, _OPEN, _CLOSE, _LIST, _LISTED, _STRING, _WORD, _REST = range(1, 11)
_SPACE = rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+"
_TOKEN = re.compile(_SPACE + rb"(?:" + rb"|".join(_PARTS) + rb")")
_REFERENCE = re.compile(_SPACE + _INDIRECT + rb"R" + _END)
_OBJECT = re.compile(_SPACE + _INDIRECT + rb"obj" + _END)
_ENTRIES = re.compile(rb"(?:\d{10} \d{5} [nf](?: \r| \n|\r\n))*+")
#: A table in one piece, up to its trailer.
_TABLE = re.compile(_SPACE + rb"xref[\x00\t\n\x0c\r ]++(\d++)[\x00\t\n\x0c\r ]++(\d++)[\x00\t\n\x0c\r ]++(" + _ENTRIES.pattern + rb")" + _SPACE + rb"trailer" + _END)
#: What most entries are: a name with a reference, a name or a whole number; and lists of plain numbers.
_ENTRY = re.compile(_SPACE + rb"/(" + _REGULAR + rb"*+)" + _SPACE + rb"(?:" + _INDIRECT + rb"R" + _END + rb"|/(" + _REGULAR + rb"*+)|(\d++)" + _END + rb"(?=" + _SPACE + rb"[/>]))")
_NUMBERS = re.compile(rb"((?:[\t\n\x0c\r ]*+[+-]?\d++(?:\.\d*+)?+(?=[\t\n\x0c\r \]]))*+)[\t\n\x0c\r ]*+\]")
_HEADER, _START = re.compile(rb"%PDF-(\d+\.\d+)"), re.compile(rb"startxref\s+(\d+)")
_ENDSTREAM = re.compile(rb"\s*endstream")
_CONSTANTS = {b"true": True, b"false": False, b"null": None}


def _unescaped(name: bytes) -> bytes:
    return _HEX.sub(lambda x: bytes([int(x[1], 16)]), name) if b"#" in name else name


def _from_hex(digits: bytes) -> bytes:
    try:
        return bytes.fromhex(digits.decode("ascii"))
    except ValueError:
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class Lexer:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def value(self, refs: bool = True, depth: int = 0):
        """The next object; Word for a keyword, None at the end of the data or for null."""
        if depth > 200:
            raise PdfError("objects nested too deeply")
        d = self.data
        m = _TOKEN.match(d, self.at)
        kind = m.lastindex
        self.at = m.end()
        if kind == _INT:
            word = m[kind]
            if refs and word[0] >= 0x30:  # no sign
                ref = _REFERENCE.match(d, m.start(kind))
                if ref:
                    self.at = ref.end()
                    return Ref(int(ref[1]), int(ref[2]))
            return int(word)
        if kind == _NAME:
            return Name(_unescaped(m[kind]))
        if kind == _OPEN:
            out: dict = {}
            while True:
                if refs and (m := _ENTRY.match(d, self.at)):
                    self.at = m.end()
                    kind = m.lastindex
                    out[_unescaped(m[1])] = Ref(int(m[2]), int(m[3])) if kind == 3 else Name(_unescaped(m[4])) if kind == 4 else int(m[5])
                    continue
                m = _TOKEN.match(d, self.at)
                if m.lastindex == _CLOSE:
                    self.at = m.end()
                    return out
                if m.lastindex != _NAME:
                    if self.value(refs, depth + 1) == Word(b""):
                        raise PdfError("a dictionary does not end")
                    continue
                self.at = m.end()
                item = self.value(refs, depth + 1)
                if isinstance(item, Word):
                    if item.text == b">>":
                        return out
                    item = None
                out[_unescaped(m[_NAME])] = item
        if kind == _STRING:
            return _from_hex(m[kind])
        if kind == _REAL:
            return float(np.float32(m[kind]))
        if kind == _LIST:
            m = _NUMBERS.match(d, self.at)
            if m:
                self.at = m.end()
                return [float(np.float32(x)) if b"." in x else int(x) for x in m[1].split()]
            held = []
            while True:
                m = _TOKEN.match(d, self.at)
                if m.lastindex == _LISTED:
                    self.at = m.end()
                    return held
                item = self.value(refs, depth + 1)
                if isinstance(item, Word):
                    if item.text in (b"", b"endobj", b">>"):
                        return held
                    continue
                held.append(item)
        if kind == _WORD:
            word = m[kind]
            return _CONSTANTS[word] if word in _CONSTANTS else Word(word)
        if kind != _REST:
            return Word(m[kind])
        i = self.at
        c = d[i : i + 1]
        if not c:
            return Word(b"")
        if c == b"(":
            return self._literal()
        if c == b"<":  # without an end
            self.at = len(d) + 1
            return _from_hex(d[i + 1 :])
        self.at = i + 1
        return Word(c)

    def _literal(self) -> bytes:
        d, i, depth, out = self.data, self.at + 1, 1, bytearray()
        while i < len(d):
            c = d[i : i + 1]
            if c == b"\\":
                n = d[i + 1 : i + 2]
                octal = re.compile(rb"[0-7]{1,3}").match(d, i + 1)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    i = octal.end()
                    continue
                if n == b"\r" and d[i + 2 : i + 3] == b"\n":
                    i += 3
                    continue
                out += b"" if n in (b"\n", b"\r") else _ESCAPES.get(n, n)
                i += 2
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
            i += 1
        self.at = i + 1
        return bytes(out)


#: Bytes of an object's text up to which it is looked up, and how many such texts are kept: a few MB at most.
SHORT, KEPT = 512, 2048


@lru_cache(KEPT)
def small(text: bytes) -> dict | None:
    """A dictionary that is all of ``text``, else None: files of one producer hold the same ones. Shared, so not to be changed."""
    lx = Lexer(text)
    try:
        value = lx.value()
    except (PdfError, ValueError, RecursionError, IndexError):
        return None
    return value if isinstance(value, dict) and lx.at == len(text) else None


def _short(data: bytes, at: int, end: bytes) -> dict | None:
    """The dictionary that is all there is from ``at`` to ``end``, if it is short."""
    to = data.find(end, at, at + SHORT)
    text = data[at:to].strip(WHITE) if to > 0 else b""
    return small(text) if text.startswith(b"<<") and text.endswith(b">>") else None


def inflate(data: bytes) -> bytes | None:
    """zlib data, or raw deflate; what could be read of damaged data."""
    for bits in (15, -15):
        d = zlib.decompressobj(bits)
        out = b""
        try:
            out = d.decompress(data)
            return out + d.flush()
        except zlib.error:
            if bits == 15 and not out:
                continue
            return out or None
    return None


def png_predictor(data: bytes, pixel: int, row: int) -> bytes | None:
    """Rows of a filter byte and ``row`` bytes, unfiltered; None if lengths or filters are wrong."""
    if row <= 0 or len(data) % (row + 1):
        return None
    rows = np.frombuffer(data, np.uint8).reshape(-1, row + 1)
    if len(rows) and rows[:, 0].max() > 4:
        return None
    out = np.zeros((len(rows), row), np.uint8)
    up = np.zeros(row, np.uint8)
    for k, line in enumerate(rows):
        kind, cur = int(line[0]), line[1:].copy()
        if kind == 2:
            cur += up
        elif kind == 1:
            for b in range(min(pixel, row)):
                cur[b::pixel] = np.cumsum(cur[b::pixel], dtype=np.uint8)
        elif kind == 3 or kind == 4:
            a, u = cur.tolist(), up.tolist()
            for i in range(row):
                left, above = a[i - pixel] if i >= pixel else 0, u[i]
                if kind == 3:
                    guess = (left + above) >> 1
                else:
                    corner = u[i - pixel] if i >= pixel else 0
                    near = left + above - corner
                    guess = min((abs(near - left), 0, left), (abs(near - above), 1, above), (abs(near - corner), 2, corner))[2]
                a[i] = (a[i] + guess) & 255
            cur = np.array(a, np.uint8)
        out[k] = up = cur
    return out.tobytes()


def tiff_predictor(data: bytes, pixel: int, row: int) -> bytes:
    """Horizontal differences of whole rows undone, byte by byte."""
    whole = len(data) // row * row if row > 0 else 0
    rows = np.frombuffer(data[:whole], np.uint8).reshape(-1, row).copy() if whole else np.zeros((0, 1), np.uint8)
    for b in range(min(pixel, rows.shape[1])):
        rows[:, b::pixel] = np.cumsum(rows[:, b::pixel], axis=1, dtype=np.uint8)
    return rows.tobytes() + data[whole:]


def lzw(data: bytes, early: int = 1) -> bytes:
    table: list[bytes] = []
    out, width, hold, bits, prev = [], 9, 0, 0, None
    for byte in data:
        hold, bits = hold << 8 | byte, bits + 8
        if bits < width:
            continue
        code = hold >> (bits - width) & ((1 << width) - 1)
        bits -= width
        hold &= (1 << bits) - 1
        if code == 256:
            table, width, prev = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        if not table:
            table = [bytes([i]) for i in range(256)] + [b"", b""]
        if prev is None:
            entry = table[code] if code < len(table) else b""
        elif code < len(table):
            entry = table[code]
            table.append(prev + entry[:1])
        else:
            entry = prev + prev[:1]
            table.append(entry)
        out.append(entry)
        prev = entry
        width = min(12, max(9, (len(table) + early).bit_length()))
    return b"".join(out)


def ascii85(data: bytes) -> bytes:
    data = re.sub(rb"[\x00\t\n\x0c\r ]", b"", data.split(b"~>")[0].removeprefix(b"<~"))
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                v = 0
                for g in group:
                    v = v * 85 + g
                out += (v & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group) - 1
        v = 0
        for g in group + [84] * (5 - len(group)):
            v = v * 85 + g
        out += (v & 0xFFFFFFFF).to_bytes(4, "big")[:n]
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


_SHORT = {b"Fl": b"FlateDecode", b"AHx": b"ASCIIHexDecode", b"A85": b"ASCII85Decode", b"LZW": b"LZWDecode", b"RL": b"RunLengthDecode", b"DCT": b"DCTDecode"}


@dataclass
class Document:
    """A loaded file: trailer, objects by reference, pages in order."""

    data: bytes
    trailer: dict = field(default_factory=dict)
    places: dict[int, tuple] = field(default_factory=dict)
    version: str = ""
    _objects: dict = field(default_factory=dict)
    _bundles: dict = field(default_factory=dict)

    def get(self, value, depth: int = 0):
        """An object with references followed; what cannot be found is None."""
        if not isinstance(value, Ref):
            return value
        for _ in range(depth, 32):
            value = self.object(value)
            if not isinstance(value, Ref):
                return value
        return None

    def object(self, ref: Ref):
        number, objects = ref.number, self._objects
        if number not in objects:
            objects[number] = None  # a cycle reads as missing
            try:
                objects[number] = self._read(number)
            except (PdfError, ValueError, RecursionError, IndexError):
                pass
        return objects[number]

    def _read(self, number: int):
        place = self.places.get(number)
        if place is None:
            return None
        if place[0] == "at":
            return self.indirect(place[1])[1]
        bundle = self._bundle(place[1])
        return bundle.get(number)

    def _bundle(self, number: int) -> dict:
        if number not in self._bundles:
            s = self.get(Ref(number, 0))
            out: dict = {}
            self._bundles[number] = out
            if isinstance(s, Stream):
                body = self.decoded(s)
                head = Lexer(body)
                first = int(self.get(s.dict.get(b"First")) or 0)
                pairs = [(head.value(False), head.value(False)) for _ in range(int(self.get(s.dict.get(b"N")) or 0))]
                for n, at in pairs:
                    if isinstance(n, int) and isinstance(at, int):
                        out[n] = Lexer(body, first + at).value()
        return self._bundles[number]

    def indirect(self, at: int):
        """(number, object) of 'n g obj ...' at an offset."""
        head = _OBJECT.match(self.data, at)
        if head and (value := _short(self.data, head.end(), b"endobj")) is not None:
            return int(head[1]), value
        lx = Lexer(self.data, at)
        if head:
            number, lx.at = int(head[1]), head.end()
        else:  # a comment between, or other odd forms
            number, _, word = lx.value(False), lx.value(False), lx.value(False)
            if not isinstance(number, int) or word != Word(b"obj"):
                raise PdfError(f"no object at {at}")
        value = lx.value()
        lx.skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", lx.at):
            start = lx.at + 6
            start += 2 if self.data.startswith(b"\r\n", start) else 1
            size = self.get(value.get(b"Length"))
            if not isinstance(size, int) or size < 0 or not _ENDSTREAM.match(self.data[start + size : start + size + 20]):
                end = self.data.find(b"endstream", start)
                end = len(self.data) if end < 0 else end
                if self.data[end - 2 : end] == b"\r\n":
                    end -= 2
                elif self.data[end - 1 : end] in (b"\n", b"\r"):
                    end -= 1
                size = max(0, end - start)
            value = Stream(value, self.data[start : start + size])
        return number, value

    def filters(self, s: Stream) -> list[bytes]:
        f = self.get(s.dict.get(b"Filter"))
        f = [f] if isinstance(f, Name) else [self.get(x) for x in f] if isinstance(f, list) else []
        return [_SHORT.get(bytes(x), bytes(x)) for x in f if isinstance(x, Name)]

    def parameters(self, s: Stream) -> list[dict]:
        p = self.get(s.dict.get(b"DecodeParms"))
        p = p if isinstance(p, list) else [p]
        return [d if isinstance(d := self.get(x), dict) else {} for x in p]

    def integer(self, d: dict, key: bytes) -> int | None:
        v = self.get(d.get(key))
        return v if isinstance(v, int) and not isinstance(v, bool) else None

    def decoded(self, s: Stream, predict: bool = True) -> bytes:
        """Stream bytes after all filters that are not image formats; damaged data as far as it goes."""
        data, params = s.raw, self.parameters(s)
        for k, name in enumerate(self.filters(s)):
            parms = params[k] if k < len(params) else {}
            if name == b"FlateDecode":
                data = inflate(data) or b""
            elif name == b"LZWDecode":
                early = self.integer(parms, b"EarlyChange")
                data = lzw(data, 1 if early is None else early)
            elif name == b"ASCIIHexDecode":
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif name == b"ASCII85Decode":
                data = ascii85(data)
            elif name == b"RunLengthDecode":
                data = run_length(data)
            else:
                break
            kind = self.integer(parms, b"Predictor") or 1
            if predict and kind > 1 and name in (b"FlateDecode", b"LZWDecode"):
                colors, bits, columns = (self.integer(parms, x) or d for x, d in ((b"Colors", 1), (b"BitsPerComponent", 8), (b"Columns", 1)))
                pixel, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
                data = tiff_predictor(data, pixel, row) if kind == 2 else png_predictor(data, pixel, row) or data
        return data

    def pages(self) -> list[Ref]:
        """Page references in order; a cycle or a missing kid is passed over."""
        root = self.get(self.trailer.get(b"Root"))
        todo, out, seen = [root.get(b"Pages")] if isinstance(root, dict) else [], [], set()
        while todo:
            ref = todo.pop()
            if not isinstance(ref, Ref) or ref in seen:
                continue
            seen.add(ref)
            node = self.get(ref)
            if isinstance(node, dict):
                kids = self.get(node.get(b"Kids"))
                if isinstance(kids, list) and self.get(node.get(b"Type")) != Name(b"Page"):
                    todo += reversed(kids)
                else:
                    out.append(ref)
        return out

    def inherited(self, page: Ref, key: bytes, valid=None):
        """The nearest value of a key up the parent chain, which ends where it comes back to a node.

        Without ``valid`` the first node that has the key decides, even if its value can't
        be resolved; with it, invalid values are passed over.
        """
        node, seen = self.get(page), None
        while isinstance(node, dict):
            if key in node:
                value = self.get(node[key])
                value = value if valid is None else valid(value)
                if valid is None or value is not None:
                    return value
            up = node.get(b"Parent")
            if isinstance(up, Ref):
                seen = seen or {page}
                if up in seen:
                    return None
                seen.add(up)
            node = self.get(up)
        return None


def _table(doc: Document, first: int, entries: bytes) -> None:
    words = entries.split()
    places = {k: ("at", int(offset)) if kind == b"n" else None for k, offset, kind in zip(range(first, first + len(words) // 3), words[::3], words[2::3])}
    if not doc.places:
        doc.places = places
        return
    for k, place in places.items():
        doc.places.setdefault(k, place)


def _sections(doc: Document, at: int) -> None:
    """Follow the chain of cross-reference sections, newest first."""
    seen = set()
    while at not in seen and 0 <= at < len(doc.data):
        seen.add(at)
        lx = Lexer(doc.data, at)
        table = _TABLE.match(doc.data, at)
        whole = table and len(table[3]) == 20 * int(table[2]) > 0
        if whole or lx.value(False) == Word(b"xref"):
            if whole:
                _table(doc, int(table[1]), table[3])
                lx.at, first = table.end(), Word(b"trailer")
            while not whole and isinstance(first := lx.value(False), int):
                count = lx.value(False)
                count = count if isinstance(count, int) else 0
                lx.skip()
                if count > 0 and _ENTRIES.match(doc.data, lx.at, lx.at + 20 * count).end() == lx.at + 20 * count:
                    _table(doc, first, doc.data[lx.at : lx.at + 20 * count])
                    lx.at += 20 * count
                    continue
                for k in range(count):
                    offset, _, kind = lx.value(False), lx.value(False), lx.value(False)
                    if kind == Word(b"n"):
                        doc.places.setdefault(first + k, ("at", offset))
                    else:
                        doc.places.setdefault(first + k, None)
            trailer = (_short(doc.data, lx.at, b"startxref") or lx.value()) if first == Word(b"trailer") else None
            if not isinstance(trailer, dict):
                raise PdfError("no trailer")
            hybrid = trailer.get(b"XRefStm")
            if isinstance(hybrid, int):
                _entries(doc, doc.indirect(hybrid)[1])
        else:
            stream = doc.indirect(at)[1]
            if not isinstance(stream, Stream):
                raise PdfError("no cross-reference stream")
            _entries(doc, stream)
            trailer = stream.dict
        doc.trailer = trailer | doc.trailer
        at = trailer.get(b"Prev", -1)
        at = at if isinstance(at, int) else -1


def _entries(doc: Document, s: Stream) -> None:
    widths = doc.get(s.dict.get(b"W"))
    index = doc.get(s.dict.get(b"Index")) or [0, doc.get(s.dict.get(b"Size")) or 0]
    data, at = doc.decoded(s), 0
    step = sum(widths)
    for first, count in zip(index[::2], index[1::2]):
        for k in range(count):
            row = data[at : at + step]
            at += step
            if len(row) < step:
                return
            cols, p = [], 0
            for w in widths:
                cols.append(int.from_bytes(row[p : p + w], "big") if w else None)
                p += w
            kind = 1 if cols[0] is None else cols[0]
            doc.places.setdefault(first + k, ("at", cols[1]) if kind == 1 else ("in", cols[1]) if kind == 2 else None)


def _rebuild(doc: Document) -> None:
    """Find objects by their headers where the cross references are of no use."""
    doc.places, doc.trailer, doc._objects = {}, {}, {}
    for m in re.finditer(rb"(?<![0-9])(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj\b", doc.data):
        doc.places[int(m[1])] = ("at", m.start())
    for m in re.finditer(rb"trailer", doc.data):
        t = Lexer(doc.data, m.end()).value()
        if isinstance(t, dict):
            doc.trailer |= t
    for number in list(doc.places):
        v = doc.object(Ref(number, 0))
        if isinstance(v, Stream) and v.dict.get(b"Type") == Name(b"ObjStm"):
            for inner in doc._bundle(number):
                doc.places.setdefault(inner, ("in", number))
        if isinstance(v, Stream) and v.dict.get(b"Type") == Name(b"XRef"):
            doc.trailer = v.dict | doc.trailer
        if isinstance(v, dict) and v.get(b"Type") == Name(b"Catalog"):
            doc.trailer.setdefault(b"Root", Ref(number, 0))


def load(data: bytes | None) -> Document:
    """Parse a file, or raise PdfError('Failed to load PDF: ...')."""
    try:
        head = _HEADER.search((data or b"")[:1024])
        if not head:
            raise PdfError("no header")
        doc = Document(bytes(data[head.start() :]), version=head[1].decode())
        last = doc.data.rfind(b"startxref", -2048)
        m = _START.match(doc.data, last) if last >= 0 else None
        start = [m[1]] if m else _START.findall(doc.data[-2048:])
        try:
            if not start:
                raise PdfError("no startxref")
            _sections(doc, int(start[-1]))
            if not isinstance(doc.get(doc.trailer.get(b"Root")), dict):
                raise PdfError("no catalog")
        except (PdfError, TypeError, ValueError, IndexError, AttributeError):
            _rebuild(doc)
        if b"Encrypt" in doc.trailer:
            raise PdfError("the file is encrypted")
        if not isinstance(doc.get(doc.trailer.get(b"Root")), dict):
            raise PdfError("no catalog")
        return doc
    except PdfError as e:
        raise PdfError(f"Failed to load PDF: {e}") from None
    except (RecursionError, TypeError, ValueError, KeyError, IndexError, AttributeError) as e:
        raise PdfError(f"Failed to load PDF: {type(e).__name__}: {e}") from None
