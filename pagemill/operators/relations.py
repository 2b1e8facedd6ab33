"""Joins, lookups and assembly of page relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def painted(xobjects: DataFrame, names: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """XObjects that their page paints; all of them where the page paints nothing."""
    on = list(keys)
    named = names.groupBy(*on).agg(F.array_distinct(F.collect_list("name")).alias("_names"))
    j = xobjects.join(named, on, "left")
    return j.where(F.col("_names").isNull() | (F.size("_names") == 0) | F.array_contains("_names", F.col("name"))).drop("_names")


def usable_images(xobjects: DataFrame) -> DataFrame:
    """Image streams of positive size (a missing side counts as 0)."""
    return xobjects.where((F.col("subtype") == "Image") & (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0))


def distinct_pages(rows: DataFrame, name: str = "pages") -> DataFrame:
    """doc_id -> ascending distinct pages that have a row."""
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("page")).alias(name))


def annotations_by_subtype(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("subtype").agg(F.count("*").alias("n"))


def links(annotations: DataFrame) -> DataFrame:
    """Annotations with an address."""
    return annotations.where(F.col("uri").isNotNull())


def needs_render(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages without a visible character and without a decodable image."""
    from pagemill.functions.text import visible_chars

    bare = pages.where(visible_chars(F.col("text")) == 0)
    return bare.join(images.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def page_payload(text: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per page: its text, the names of its images and the addresses on it, empty lists where it has none."""
    key = ["doc_id", "page"]
    i = images.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("image_index", "data_url"))), lambda x: x["data_url"]).alias("images"))
    a = links(annotations).groupBy(*key).agg(F.sort_array(F.collect_list("uri")).alias("links"))
    none = F.array().cast("array<string>")
    return text.join(i, key, "left").join(a, key, "left").select(*key, "text", F.coalesce("images", none).alias("images"), F.coalesce("links", none).alias("links"))


def join_texts(parts: DataFrame) -> DataFrame:
    """Non-empty texts of a page's images in order, one to a line: doc_id, page, text."""
    full = parts.where(F.col("text") != "")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("image_index", "text"))), lambda x: x["text"])
    return full.groupBy("doc_id", "page").agg(F.array_join(ordered, "\n").alias("text"))


def nearest_ancestor(nodes: DataFrame, value: str, valid: Column | None = None, depth: int | None = None) -> DataFrame:
    """(id, parent, value) -> id, found: the value of the nearest ancestor or self that has one.

    Without ``valid`` the first node that has the value ends the walk; with it, values that
    fail the test are passed over. Each round joins a node with what its pointer has seen and
    doubles the levels it covers; it ends when none is open. A walk longer than there are
    nodes is a parent cycle and finds nothing. ``depth`` bounds the rounds, if given.
    """
    from pagemill.plans.session import cut

    ok = F.col(value).isNotNull() if valid is None else F.col(value).isNotNull() & F.coalesce(valid, F.lit(False))
    state = cut(nodes.select("id", F.col("parent").alias("up"), F.when(ok, F.col(value)).alias("found")))
    rounds = state.count().bit_length()
    for _ in range(rounds if depth is None else min(depth, rounds)):
        if not state.where("found is null and up is not null").take(1):
            break
        table = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("found").alias("_v"))
        j = state.join(table, (F.col("up") == F.col("_id")) & F.col("found").isNull(), "left")
        state = cut(j.select("id", F.when(F.col("found").isNull(), F.col("_up")).alias("up"), F.coalesce("found", "_v").alias("found")))
    return state.select("id", "found")
