"""Relations of one loaded document: text, images, annotations, metadata, boxes."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

from pagemill.functions.geometry import CHANNELS, PATH_OPERATORS
from pagemill.sources.syntax import Document, Lexer, Name, PdfError, Ref, Stream, Word, png_predictor, tiff_predictor

#: Glyph names of the standard encodings that are not a single letter or "uniXXXX" (fixed values).
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}",
    "bullet": "•", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "ellipsis": "…", "fi": "fi", "fl": "fl", "germandbls": "ß", "Euro": "€", "degree": "°", "section": "§",
}
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "cedilla": "̧", "ring": "̊", "caron": "̌"}


def operations(data: bytes) -> Iterator[tuple[bytes, list]]:
    """(operator, operands) of a content stream; inline images are passed over."""
    lx, operands = Lexer(data), []
    while True:
        v = lx.value(False)
        if not isinstance(v, Word):
            operands.append(v)
            continue
        if not v.text:
            return
        if v.text == b"ID":
            m = re.compile(rb"[\x00\t\n\x0c\r ]EI(?![^\x00\t\n\x0c\r ])").search(data, lx.at)
            lx.at = m.end() if m else len(data)
        yield v.text, operands
        operands = []


def content(doc: Document, page: Ref) -> bytes:
    """All content streams of a page, as text is read from them: apart by a line end; an array may stand behind a reference."""
    node = doc.get(page)
    c = node.get(b"Contents") if isinstance(node, dict) else None
    if isinstance(c, Ref) and isinstance(doc.get(c), list):
        c = doc.get(c)
    return b"\n".join(_streams(doc, c))


def raw_content(doc: Document, page: Ref) -> bytes:
    """The content that painted names and path operators are read from: the streams of a reference or of an array's references, without anything between them."""
    node = doc.get(page)
    return b"".join(_streams(doc, node.get(b"Contents") if isinstance(node, dict) else None))


def _streams(doc: Document, c) -> Iterator[bytes]:
    for r in c if isinstance(c, list) else [c]:
        s = doc.get(r) if isinstance(r, Ref) else None
        if isinstance(s, Stream):
            yield doc.decoded(s)


def resources(doc: Document, page: Ref) -> dict:
    r = doc.inherited(page, b"Resources")
    return r if isinstance(r, dict) else {}


# text


class CMap:
    """Code -> text of a ToUnicode map: single codes, and ranges as they stand, of any size."""

    def __init__(self) -> None:
        self.one: dict[bytes, str] = {}
        self.ranges: list[tuple[int, int, int, object]] = []  # (bytes of a code, first, last, text or list of texts)
        self.identity = False  # two-byte codes stand for themselves

    def __bool__(self) -> bool:
        return bool(self.one or self.ranges)

    def get(self, code: bytes, default: str | None = None) -> str | None:
        found = self.one.get(code)
        if found is None and self.ranges:
            x = int.from_bytes(code, "big")
            for size, lo, hi, to in reversed(self.ranges):  # later ranges go before earlier ones
                if size == len(code) and lo <= x <= hi:
                    found = self._of(to, x - lo)
                    break
            if found is not None:
                self.one[code] = found
        return default if found is None else found

    @staticmethod
    def _of(to, k: int) -> str | None:
        if isinstance(to, list):
            return to[k].decode("utf-16-be", "replace") if k < len(to) and isinstance(to[k], bytes) else None
        return (to[:-2] + ((int.from_bytes(to[-2:], "big") + k) & 0xFFFF).to_bytes(2, "big")).decode("utf-16-be", "surrogatepass")


def _cmap(data: bytes) -> CMap:
    lx, held, out = Lexer(data), [], CMap()
    text = lambda b: b.decode("utf-16-be", "replace")
    while True:
        v = lx.value(False)
        if not isinstance(v, Word):
            held.append(v)
            continue
        if not v.text:
            out.identity = not out.one and out.ranges == [(2, 0, 0xFFFF, b"\0\0")]
            return out
        if v.text == b"endbfchar":
            for code, to in zip(held[::2], held[1::2]):
                if isinstance(code, bytes) and isinstance(to, bytes):
                    out.one[bytes(code)] = text(to)
        elif v.text == b"endbfrange":
            for lo, hi, to in zip(held[::3], held[1::3], held[2::3]):
                if not (isinstance(lo, bytes) and isinstance(hi, bytes)):
                    continue
                if isinstance(to, list) or (isinstance(to, bytes) and len(to) >= 2):
                    out.ranges.append((len(lo), int.from_bytes(lo, "big"), int.from_bytes(hi, "big"), to))
        held = []


def glyph(name: str) -> str:
    import unicodedata

    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    m = re.fullmatch(r"u(?:ni)?([0-9A-F]{4,6})", name)
    if m:
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else ""
    if name[1:] in _ACCENTS:
        return unicodedata.normalize("NFC", name[0] + _ACCENTS[name[1:]])
    return ""


class Font:
    def __init__(self, doc: Document, font: dict):
        self.map = CMap()
        to = doc.get(font.get(b"ToUnicode"))
        if isinstance(to, Stream):
            self.map = _cmap(doc.decoded(to))
        self.wide = doc.get(font.get(b"Subtype")) == Name(b"Type0")
        self.codec, self.names = "cp1252", {}
        enc = doc.get(font.get(b"Encoding"))
        base = enc if isinstance(enc, Name) else doc.get(enc.get(b"BaseEncoding")) if isinstance(enc, dict) else None
        if base == Name(b"MacRomanEncoding"):
            self.codec = "mac_roman"
        if isinstance(enc, dict):
            at = 0
            for x in doc.get(enc.get(b"Differences")) or []:
                if isinstance(x, int):
                    at = x
                elif isinstance(x, Name):
                    self.names[at] = glyph(x.decode("latin-1"))
                    at += 1

    def text(self, raw: bytes) -> str:
        if self.wide:
            if self.map.identity:
                return raw[: len(raw) // 2 * 2].decode("utf-16-be", "replace")
            pairs = [raw[i : i + 2] for i in range(0, len(raw), 2)]
            if self.map:
                return "".join(self.map.get(p, "") for p in pairs).encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")  # halves of a pair meet
            return raw.decode("utf-16-be", "replace")
        out = []
        for b in raw:
            one = bytes([b])
            mapped = self.map.get(one)
            out.append(mapped if mapped is not None else self.names[b] if b in self.names else one.decode(self.codec, "replace"))
        return "".join(out)


_PLAIN = Font.__new__(Font)
_PLAIN.map, _PLAIN.wide, _PLAIN.codec, _PLAIN.names = CMap(), False, "cp1252", {}


def page_text(doc: Document, page: Ref) -> str:
    """Text of a page in content order: a new line at the end of a text object and wherever a line starts; '' if it fails."""
    try:
        fonts_of = doc.get(resources(doc, page).get(b"Font"))
        fonts: dict = {}
        font, out = _PLAIN, []

        def fresh():
            if out and not out[-1].endswith("\n"):
                out.append("\n")

        for op, args in operations(content(doc, page)):
            if op == b"Tf" and args and isinstance(args[0], Name):
                key = bytes(args[0])
                if key not in fonts:
                    f = doc.get(fonts_of.get(key)) if isinstance(fonts_of, dict) else None
                    fonts[key] = Font(doc, f) if isinstance(f, dict) else _PLAIN
                font = fonts[key]
            elif op in (b"T*", b"ET"):
                fresh()
            elif op in (b"Td", b"TD"):
                if len(args) > 1 and isinstance(args[1], (int, float)) and args[1]:
                    fresh()
            elif op in (b"Tj", b"'", b'"', b"TJ"):
                if op in (b"'", b'"'):
                    fresh()
                last = args[-1] if args else b""
                for x in last if isinstance(last, list) else [last]:
                    if isinstance(x, bytes) and not isinstance(x, Name):
                        out.append(font.text(x))
                    elif isinstance(x, (int, float)) and x < -200 and out and not out[-1].endswith((" ", "\n")):
                        out.append(" ")
        return "".join(out)
    except (PdfError, ValueError, TypeError, AttributeError, RecursionError):
        return ""


# images


def painted_names(doc: Document, page: Ref, xobjects: dict) -> set[bytes]:
    """Names painted by the page, and by the forms it paints (one level, looked up in the page's own resources)."""
    do = lambda data: {bytes(a[0]) for op, a in operations(data) if op == b"Do" and a and isinstance(a[0], Name)}
    names = do(raw_content(doc, page))
    for n in list(names):
        s = doc.get(xobjects.get(n))
        if isinstance(s, Stream) and doc.get(s.dict.get(b"Subtype")) == Name(b"Form"):
            names |= do(doc.decoded(s))
    return names


def xobjects_of(doc: Document, page: Ref) -> dict:
    x = doc.get(resources(doc, page).get(b"XObject"))
    return x if isinstance(x, dict) else {}


def painted_streams(doc: Document, page: Ref) -> Iterator[tuple[bytes, Ref, Stream]]:
    x = xobjects_of(doc, page)
    names = painted_names(doc, page, x) if x else set()
    for name, ref in x.items():
        if (not names or name in names) and isinstance(ref, Ref) and isinstance(s := doc.get(ref), Stream):
            yield name, ref, s


def has_form(doc: Document, page: Ref) -> bool:
    return any(s.dict.get(b"Subtype") == Name(b"Form") for _, _, s in painted_streams(doc, page))


def has_vector(doc: Document, page: Ref) -> bool:
    try:
        return sum(op.decode("latin-1") in PATH_OPERATORS for op, _ in operations(raw_content(doc, page))) > 10
    except PdfError:
        return False


def color_space(doc: Document, d: dict) -> str:
    v = doc.get(d.get(b"ColorSpace"))
    if isinstance(v, Name):
        return v.decode("utf-8", "replace")
    if isinstance(v, list) and v and isinstance(v[0], Name):
        if v[0] == b"ICCBased":
            s = doc.get(v[1]) if len(v) > 1 else None
            n = doc.integer(s.dict, b"N") if isinstance(s, Stream) else None
            return f"ICCBased{3 if n is None else n}"
        return v[0].decode("utf-8", "replace")
    return "DeviceRGB"


def sample_bytes(doc: Document, s: Stream, width: int, height: int, channels: int, bits: int) -> bytes:
    """Decompressed samples; predictors are undone only where the sizes fit the image."""
    data = doc.decoded(s, predict=False)
    parms = next((p for p in doc.parameters(s) if p), {})
    kind = doc.integer(parms, b"Predictor") or 1
    colors, depth, columns = (doc.integer(parms, k) or d for k, d in ((b"Colors", channels), (b"BitsPerComponent", bits), (b"Columns", width)))
    pixel, row = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if kind == 2 and len(data) == row * height:
        return tiff_predictor(data, pixel, row)
    if kind >= 10 and len(data) == (row + 1) * height:
        return png_predictor(data, pixel, row) or data
    return data


def cmyk_to_rgb(x: np.ndarray) -> np.ndarray:
    """Rows of four bytes to three, in 32-bit arithmetic, truncated."""
    p = x.reshape(-1, 4).astype(np.float32) / np.float32(255)
    return (np.float32(255) * (np.float32(1) - p[:, :3]) * (np.float32(1) - p[:, 3:])).astype(np.uint8)


def pixels(data: bytes, width: int, height: int, bits: int, space: str) -> np.ndarray | None:
    """(height, width, 1 or 3) samples of 8 bits; None if there are too few."""
    n = CHANNELS.get(space, 3)
    wide = bits > 8
    need = width * height * n * (2 if wide else 1)
    if len(data) < need:
        return None
    x = np.frombuffer(data, np.uint8, need)
    x = x[::2] if wide else x
    return cmyk_to_rgb(x).reshape(height, width, 3) if n == 4 else x.reshape(height, width, n)


def with_alpha(x: np.ndarray, mask: bytes | None) -> np.ndarray:
    """RGBA by a mask of one byte a pixel; the image itself where the mask is too short."""
    h, w = x.shape[:2]
    if mask is None:
        return x
    rgb = np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x
    if len(mask) < w * h:
        return rgb
    return np.concatenate([rgb, np.frombuffer(mask, np.uint8, w * h).reshape(h, w, 1)], axis=2)


def png(x: np.ndarray) -> bytes:
    """An 8-bit gray, RGB or RGBA image as a PNG file."""
    h, w, n = x.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), x.reshape(h, w * n)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def soft_mask(doc: Document, d: dict) -> bytes | None:
    ref = d.get(b"SMask")
    s = doc.get(ref) if isinstance(ref, Ref) else None
    if not isinstance(s, Stream) or doc.get(s.dict.get(b"Subtype")) != Name(b"Image"):
        return None
    w, h, b = (doc.integer(s.dict, k) for k in (b"Width", b"Height", b"BitsPerComponent"))
    return sample_bytes(doc, s, w or 0, h or 0, 1, b or 8)


def page_images(doc: Document, page: Ref, decoders: dict | None = None, raw: bool = False) -> Iterator[dict]:
    """Painted images that can be decoded, numbered from 0. ``decoders``: filter name -> bytes to pixel array."""
    index = 0
    for name, ref, s in painted_streams(doc, page):
        if doc.get(s.dict.get(b"Subtype")) != Name(b"Image"):
            continue
        w, h, bits = (doc.integer(s.dict, k) for k in (b"Width", b"Height", b"BitsPerComponent"))
        bits = 8 if bits is None else bits
        if not w or not h or w < 0 or h < 0:
            continue
        filters = doc.filters(s)
        last = filters[-1].decode("latin-1") if filters else "None"
        space = color_space(doc, s.dict)
        if last in ("DCTDecode", "JPXDecode"):
            decode = (decoders or {}).get(last)
            x = decode(doc.decoded(s)) if decode else None
        else:
            x = pixels(sample_bytes(doc, s, w, h, CHANNELS.get(space, 3), bits), w, h, bits, space)
        if x is None:
            continue
        if not raw:
            x = with_alpha(x, soft_mask(doc, s.dict))
        yield {"image_index": index, "width": w, "height": h, "data": x if raw else png(x), "color_space": space, "bits_per_component": bits, "filter": last, "xobject_name": name.decode("utf-8", "replace"), "object_id": f"{ref.number} {ref.generation} obj"}
        index += 1


def has_image(doc: Document, page: Ref, decoders: dict | None = None) -> bool:
    """Does the page paint an image that can be decoded? One in a format that only ``decoders`` read counts by its signature, if none is given."""
    for _, _, s in painted_streams(doc, page):
        filters = doc.filters(s)
        last = filters[-1] if filters else b""
        if doc.get(s.dict.get(b"Subtype")) == Name(b"Image") and last in (b"DCTDecode", b"JPXDecode") and last.decode() not in (decoders or {}):
            w, h = (doc.integer(s.dict, k) for k in (b"Width", b"Height"))
            if (w or 0) > 0 and (h or 0) > 0 and doc.decoded(s).startswith((b"\xff\xd8\xff", b"\xff\x4f\xff\x51", b"\x00\x00\x00\x0cjP")):
                return True
    return any(True for _ in page_images(doc, page, decoders, raw=True))


# annotations, metadata, boxes


def page_annotations(doc: Document, page: Ref, decode_utf16: bool = False) -> Iterator[dict]:
    node = doc.get(page)
    items = doc.get(node.get(b"Annots")) if isinstance(node, dict) else None
    text = (lambda b: info_text(b)) if decode_utf16 else (lambda b: b.decode("utf-8", "replace"))
    index = 0
    for item in items if isinstance(items, list) else []:
        a = doc.get(item)
        if not isinstance(a, dict):
            continue
        subtype, rect, act, dest, note = (doc.get(a.get(k)) for k in (b"Subtype", b"Rect", b"A", b"Dest", b"Contents"))
        uri = act.get(b"URI") if isinstance(act, dict) else None
        string = lambda v: isinstance(v, bytes) and not isinstance(v, Name)
        yield {
            "annotation_index": index, "subtype": subtype.decode("utf-8", "replace") if isinstance(subtype, Name) else "",
            "rect": [float(v) for v in rect if isinstance(v, (int, float)) and not isinstance(v, bool)] if isinstance(rect, list) else [],
            "uri": text(uri) if string(uri) else None, "dest": dest.decode("utf-8", "replace") if isinstance(dest, bytes) else None, "content": text(note) if string(note) else None,
        }
        index += 1


def info_text(raw: bytes) -> str:
    """A string of the information dictionary: UTF-16 after its mark (an odd byte dropped), else lossy UTF-8."""
    if raw[:2] == b"\xfe\xff":
        return raw[2 : len(raw) // 2 * 2].decode("utf-16-be", "replace")
    return raw.decode("utf-8", "replace")


def metadata(doc: Document) -> dict:
    """One row; dates as they stand (the date function works on columns)."""
    ref = doc.trailer.get(b"Info")
    info = doc.get(ref) if isinstance(ref, Ref) else None
    get = lambda k: info_text(v) if isinstance(info, dict) and isinstance(v := info.get(k), bytes) and not isinstance(v, Name) else None
    return {"page_count": len(doc.pages()), "version": doc.version, "is_linearized": b"Linearized" in doc.trailer, "creator": get(b"Creator"), "producer": get(b"Producer"), "raw_creation": get(b"CreationDate"), "raw_modification": get(b"ModDate")}


_NUMBER = {int, float}


def box(value) -> list[float] | None:
    """The first four numbers of an array that starts with four."""
    four = value[:4] if isinstance(value, list) else []
    return list(map(float, four)) if len(four) == 4 and _NUMBER.issuperset(map(type, four)) else None


def page_rects(doc: Document, page: Ref) -> dict:
    return {"crop": doc.inherited(page, b"CropBox", box), "media": doc.inherited(page, b"MediaBox", box)}
