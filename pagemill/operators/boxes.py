"""Page boxes: source priority, grouping with a dominant group, and expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.geometry import normalise_box, valid_box
from pagemill.operators.joins import lookup
from pagemill.operators.ranges import except_ranges, page_ranges, pages_of
from pagemill.operators.scan import ranges
from pagemill.plans.session import cut

#: Bytes of the tables read whose documents a task groups.
EACH = 16 << 20

GEOMETRY = ("left", "bottom", "right", "top", "width", "height")


def page_geometry(rects: DataFrame) -> DataFrame:
    """(doc_id, page, crop, media) -> one normalised box per page, CropBox before MediaBox, else Unknown at 0."""
    r = rects.withColumns({"c": valid_box(F.col("crop")), "m": valid_box(F.col("media"))})
    box = F.coalesce("c", "m", F.array(*[F.lit(0.0)] * 4))
    kind = F.when(F.col("c").isNotNull(), "CropBox").when(F.col("m").isNotNull(), "MediaBox").otherwise("Unknown")
    return r.select("doc_id", "page", normalise_box(box).alias("b"), kind.alias("box_type")).select("doc_id", "page", "b.*", "box_type")


def page_boxes(geometry: DataFrame) -> DataFrame:
    """One row per distinct box of a document, in order of first appearance; the dominant one has null pages.

    Boxes are the same if their four corners have the same bits and they come
    from the same source. Dominant is the group of most pages; of equal ones,
    that which appears last. Documents are dealt once, into tasks by the size of what is read: boxes and windows need no further exchange.
    """
    bits = [F.col(c).cast("string").alias(f"_{c}") for c in GEOMETRY[:4]]
    geometry = geometry.repartition(ranges(geometry, EACH), "doc_id")
    groups = geometry.withColumns({f"_{c}": b for c, b in zip(GEOMETRY[:4], bits)}).groupBy("doc_id", *[f"_{c}" for c in GEOMETRY[:4]], "box_type").agg(
        *[F.first(c).alias(c) for c in GEOMETRY], F.count("*").alias("n"), F.min("page").alias("first_page"), F.sort_array(F.collect_list("page")).alias("pages")
    )
    doc = Window.partitionBy("doc_id")
    ranked = groups.withColumn("dominant", F.row_number().over(doc.orderBy(F.desc("n"), F.desc("first_page"))) == 1).withColumn("box_index", F.row_number().over(doc.orderBy("first_page")).cast("long"))
    return ranked.select("doc_id", "box_index", F.sum("n").over(doc).cast("long").alias("page_count"), *GEOMETRY, "box_type", F.when(~F.col("dominant"), F.col("pages")).alias("pages"))


def expand_boxes(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, geometry, box_type): null pages stand for all pages that no other box of the document lists."""
    listed = F.flatten(F.collect_list(F.coalesce("pages", F.array().cast("array<long>"))).over(Window.partitionBy("doc_id")))
    pages = F.coalesce("pages", F.array_except(F.sequence(F.lit(1).cast("long"), F.col("page_count")), F.col("listed")))
    return boxes.withColumn("listed", listed).select("doc_id", F.explode(pages).alias("page"), *GEOMETRY, "box_type")


def box_ranges(geometry: DataFrame, listed_only: bool = False) -> DataFrame:
    """page_boxes with page ranges for lists: doc_id, box_index, geometry, box_type, dominant, first, last; a row a range.

    The dominant box's pages are no list: they are what the other boxes leave of 1 to the page count (``listed_only``
    leaves them out, as null pages do). So no row grows with the number of pages.
    """
    corners = [F.col(c).cast("string").alias(f"_{c}") for c in GEOMETRY[:4]]
    g = cut(geometry.select("*", *corners))
    key = ["doc_id", *[f"_{c}" for c in GEOMETRY[:4]], "box_type"]
    groups = g.groupBy(*key).agg(*[F.first(c).alias(c) for c in GEOMETRY], F.count("*").alias("n"), F.min("page").alias("first_page"))
    doc = Window.partitionBy("doc_id")  # a row a box
    ranked = groups.withColumn("dominant", F.row_number().over(doc.orderBy(F.desc("n"), F.desc("first_page"))) == 1).withColumn("box_index", F.row_number().over(doc.orderBy("first_page")).cast("long"))
    boxes = cut(ranked.withColumn("page_count", F.sum("n").over(doc).cast("long")))
    # only pages of other boxes than the dominant one are put in order, by their box's number
    others = lookup(g.select(*key, "page"), boxes.select(*key, "box_index", "dominant"), key, null_safe=True, how="inner").where("not dominant")
    listed = cut(page_ranges(others.select("doc_id", "box_index", "page"), ["doc_id", "box_index"]))
    parts = listed
    if not listed_only:
        whole = boxes.where("dominant").select("doc_id", F.lit(1).cast("long").alias("first"), F.col("page_count").alias("last"))
        rest = except_ranges(whole, listed.select("doc_id", "first", "last"), ["doc_id"])
        top = boxes.where("dominant").select(F.col("doc_id").alias("_d"), "box_index")
        parts = listed.unionByName(rest.join(top, F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "box_index", "first", "last"))
    b = boxes.select(F.col("doc_id").alias("_d"), F.col("box_index").alias("_i"), *GEOMETRY, "box_type", "dominant")
    return parts.join(b, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("box_index") == F.col("_i"))).select("doc_id", "box_index", *GEOMETRY, "box_type", "dominant", "first", "last")


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """The geometry of each page of box_ranges."""
    return pages_of(ranges.select("doc_id", *GEOMETRY, "box_type", "first", "last")).select("doc_id", "page", *GEOMETRY, "box_type")
