"""Column functions on page text and PDF strings; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?U)^\s+|\s+$"


def lines(text: Column) -> Column:
    """Lines of a text: cut at \\n, one \\r before it dropped, no empty line after the last \\n; '' has none."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trim(text: Column) -> Column:
    """Unicode white space cut from both ends."""
    return F.regexp_replace(text, _EDGE, "")


def normalise_line(line: Column) -> Column:
    """A line as header and footer lines are compared: trimmed, each run of ASCII digits as <NUM>."""
    return F.regexp_replace(trim(line), "[0-9]+", "<NUM>")


def visible_chars(text: Column) -> Column:
    """How many characters are not white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S")).cast("long")


def strip_footer_artifacts(text: Column, page_count: Column) -> Column:
    """The text without line pairs '/' and the page count; unchanged, byte for byte, where there is none."""

    def cut(l: Column) -> Column:
        bare = F.transform(l, trim)

        def in_pairs(b: Column) -> Column:
            total = page_count.cast("string")
            pair = lambda i: F.coalesce((F.get(b, i) == "/") & (F.get(b, i + 1) == total), F.lit(False))
            kept = F.filter(l, lambda _, i: ~(pair(i) | ((i > 0) & pair(i - 1))))
            return F.transform(F.array(kept), lambda k: F.when(F.size(k) == F.size(l), text).otherwise(F.array_join(k, "\n")))[0]

        return F.transform(F.array(bare), in_pairs)[0]

    return F.transform(F.array(lines(text)), cut)[0]


def pdf_date_to_iso(raw: Column) -> Column:
    """ISO 8601 form of a PDF date; no digit is validated, and what is too short stays as it is."""
    s = F.when(F.startswith(raw, F.lit("D:")), F.substring(raw, 3, 1 << 30)).otherwise(raw)
    size = F.length(s)
    two = lambda at, default: F.when(size >= at + 1, F.substring(s, at, 2)).otherwise(default)
    zone = F.substring(s, 15, 1 << 30)
    bare = F.replace(zone, F.lit("'"), F.lit(""))
    minutes = F.when(F.length(bare) >= 5, F.substring(bare, 4, 2)).otherwise("00")
    shown = F.when(F.length(zone) == 0, "").when(F.startswith(zone, F.lit("Z")), "Z").when(F.length(bare) >= 3, F.concat(F.substring(bare, 1, 3), F.lit(":"), minutes)).otherwise("")
    iso = F.concat(F.substring(s, 1, 4), F.lit("-"), two(5, "01"), F.lit("-"), two(7, "01"), F.lit("T"), two(9, "00"), F.lit(":"), two(11, "00"), F.lit(":"), two(13, "00"), shown)
    return F.when(size < 4, raw).otherwise(iso)


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.replace(F.base64(png), F.lit("\r\n"), F.lit("")))


def quoted_path(listing: str, other: str = "") -> str | None:
    """The text between the first two quotes of an engine's language listing (of ``other`` where it has none)."""
    parts = (listing if '"' in listing else other).split('"', 2)
    return parts[1] if len(parts) > 2 else None
