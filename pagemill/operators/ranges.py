"""Sets of pages as ranges and as bitmaps: a document of any number of pages without a list of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.scan import numbered, running
from pagemill.plans.session import cut


def page_ranges(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, page) -> (key, first, last): the maximal runs of consecutive pages; repeated and null pages count once and not at all."""
    pages = cut(rows.where("page is not null").select(*key, F.col("page").cast("long").alias("page")).distinct())
    n = numbered(pages, key, ["page"], "__pos").withColumn("_run", F.col("page") - F.col("__pos"))
    return n.groupBy(*key, "_run").agg(F.min("page").alias("first"), F.max("page").alias("last")).drop("_run")


def _swept(ranges: DataFrame, key: list[str], span: DataFrame | None = None) -> DataFrame:
    """(key, first, last) -> (key, first, last, depth): stretches between neighbouring ends, and how many ranges cover each.

    ``span`` (key, first, last) adds ends that cover nothing. Ends are summed along each key by the two-pass scan.
    """
    ends = lambda df, by: df.select(*key, F.col("first").alias("__at"), F.lit(by).cast("long").alias("_d")).unionByName(df.select(*key, (F.col("last") + 1).alias("__at"), F.lit(-by).cast("long").alias("_d")))
    all_ends = ends(ranges, 1) if span is None else ends(ranges, 1).unionByName(ends(span, 0))
    points = cut(all_ends.groupBy(*key, "__at").agg(F.sum("_d").alias("_d")))
    one = F.lit(1).cast("long")
    swept = cut(running(points, key, ["__at"], {"depth": F.col("_d"), "__nth": one}))
    after = swept.select(*[F.col(c).alias(f"_{c}") for c in key], (F.col("__nth") - 1).alias("__before"), (F.col("__at") - 1).alias("last"))
    j = swept.join(after, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key] + [F.col("__nth") == F.col("__before")])
    return j.select(*key, F.col("__at").alias("first"), "last", "depth")


def _joined(stretches: DataFrame, key: list[str]) -> DataFrame:
    """Stretches that touch, as one: a stretch that no other ends just before begins a new one."""
    s = cut(stretches.select(*key, "first", "last"))
    before = s.select(*[F.col(c).alias(f"_{c}") for c in key], (F.col("last") + 1).alias("_at"))
    fresh = s.join(before, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key] + [F.col("first") == F.col("_at")], "left")
    fresh = cut(fresh.select(*key, "first", "last", F.when(F.col("_at").isNull(), 1).otherwise(0).cast("long").alias("__new")))
    return running(fresh, key, ["first"], {"__run": F.col("__new")}).groupBy(*key, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__run")


def union_ranges(ranges: DataFrame, key: list[str], depth: int = 1) -> DataFrame:
    """Pages that at least ``depth`` ranges of a key cover, as disjoint ranges that do not touch."""
    return _joined(_swept(ranges, key).where(F.col("depth") >= depth), key)


def except_ranges(whole: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """Pages of ``whole`` (one range a key) that none of ``ranges`` covers, as disjoint ranges."""
    inside = _swept(ranges, key, whole).where("depth = 0")
    w = whole.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("first").alias("_first"), F.col("last").alias("_last"))
    j = inside.join(w, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return j.where("first >= _first and last <= _last").select(*key, "first", "last")


def pages_of(ranges: DataFrame, step: int = 4096) -> DataFrame:
    """(..., first, last) -> (..., page): a long range is dealt out in steps, so that no row makes a list of all its pages."""
    rest = [c for c in ranges.columns if c not in ("first", "last")]
    parts = ranges.select(*rest, "last", F.explode(F.sequence("first", "last", F.lit(step).cast("long"))).alias("_from"))
    return parts.select(*rest, F.explode(F.sequence("_from", F.least("last", F.col("_from") + step - 1))).alias("page"))


def page_bitmaps(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, page) -> (key, bucket, bits): 32,768 pages a row, merged by bit; repeated pages count once."""
    p = rows.where("page is not null")
    return p.groupBy(*key, F.bitmap_bucket_number("page").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("page")).alias("bits"))


def merged_bitmaps(bitmaps: DataFrame, key: list[str]) -> DataFrame:
    """Bitmaps of a finer key -> those of ``key``: pages that any of them holds."""
    return bitmaps.groupBy(*key, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def pages_counted(bitmaps: DataFrame, key: list[str], name: str = "n_pages") -> DataFrame:
    return bitmaps.groupBy(*key).agg(F.sum(F.bitmap_count("bits")).cast("long").alias(name))
