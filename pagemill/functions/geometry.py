"""Column functions on boxes, sizes and pixel counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the public contract.
DPI_DEFAULT, DPI_LEAST, DPI_MOST = 300, 72, 600
#: Channels by colour space; any other counts as 3.
CHANNELS = {"DeviceRGB": 3, "ICCBased3": 3, "CalRGB": 3, "DeviceGray": 1, "ICCBased1": 1, "CalGray": 1, "DeviceCMYK": 4, "ICCBased4": 4}
#: Path construction and painting operators that count as vector content.
PATH_OPERATORS = ("m", "l", "c", "v", "y", "h", "re", "S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n", "W", "W*")


def single(value: Column) -> Column:
    """A number as it is after a pass through 32 bits."""
    return value.cast("float").cast("double")


def normalise_dpi(dpi: Column) -> Column:
    return F.least(F.greatest(F.coalesce(dpi, F.lit(DPI_DEFAULT)), F.lit(DPI_LEAST)), F.lit(DPI_MOST)).cast("long")


def pixels(points: Column, dpi: Column) -> Column:
    """Rendered size of a length: points * dpi / 72 in 32 bits, truncated."""
    return ((points.cast("float") * dpi.cast("float")) / F.lit(72).cast("float")).cast("float").cast("long")


def channels(space: Column) -> Column:
    out = F.lit(3)
    for name, n in CHANNELS.items():
        if n != 3:
            out = F.when(space == name, n).otherwise(out)
    return out.cast("long")


def expected_bytes(width: Column, height: Column, space: Column, bits: Column) -> Column:
    """Bytes that raw pixels need: a sample of more than 8 bits takes two."""
    return (width.cast("long") * height.cast("long") * channels(space) * F.when(bits > 8, 2).otherwise(1)).cast("long")


def valid_box(box: Column) -> Column:
    """The first four numbers of an array of at least four, else null."""
    four = F.slice(box, 1, 4)
    return F.when((F.size(box) >= 4) & F.forall(four, lambda x: x.isNotNull()), four)


def normalise_box(box: Column) -> Column:
    """(left, bottom, right, top, width, height) of two opposite corners."""
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    left, right, bottom, top = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    return F.struct(left.alias("left"), bottom.alias("bottom"), right.alias("right"), top.alias("top"), (right - left).alias("width"), (top - bottom).alias("height"))


def has_vector_content(op: Column, least: int = 10) -> Column:
    """An aggregate over a page's operators, one a row: more than ``least`` of them are path operators."""
    return F.count_if(op.isin(*PATH_OPERATORS)) > least
