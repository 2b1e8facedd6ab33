"""Page relations derived from the given tables, for the queries that SQL can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import data_url
from pagemill.operators.scan import numbered, ranges


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents of a source as its pages: a running head, a numbered foot, every seventh page bare.

    Pages are numbered without the texts, which join their numbers by the table's key.
    """
    d = read(spark, sf_dir, "documents")
    n = numbered(d.select("doc_id", F.col("source").alias("_source")), ["_source"], ["doc_id"], "page", "page_count").select("doc_id", (F.col("page") + 1).alias("page"), "page_count")
    text = F.coalesce("text", F.lit(""))
    of = F.concat(F.lit("Collected papers of "), F.col("source"), F.lit("\n"), text, F.lit("\nPage "), F.col("page").cast("string"), F.lit(" of "), F.col("page_count").cast("string"))
    return d.join(n, "doc_id").select(F.col("source").alias("doc_id"), "page", "page_count", F.when(F.col("page") % 7 == 0, text).otherwise(of).alias("text"))


def conv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def artifact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_pages with '/' and page-count lines put in."""
    p = doc_pages(spark, sf_dir)
    n = F.col("page_count").cast("string")
    return p.select(
        "doc_id", "page", "page_count",
        F.when(F.col("page") % 3 == 0, F.concat("text", F.lit("\n / \n"), n, F.lit("\n")))
        .when(F.col("page") % 3 == 1, F.concat(F.lit("/\n"), n, F.lit("\n"), F.col("text"), F.lit("\n/\n0")))
        .otherwise(F.col("text")).alias("text"),
    )


def rects(spark: SparkSession, sf_dir: str, each: int = 16 << 20) -> DataFrame:
    """lineitem as page rectangles: an order is a document, its rows are pages. A document is whole in one task, of ``each`` bytes of the table."""
    rows = read(spark, sf_dir, "lineitem")
    rows.repartition(ranges(rows, each), "l_orderkey").createOrReplaceTempView("_lineitem")
    return spark.sql("""
        SELECT CAST(l_orderkey AS STRING) AS doc_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS page,
               CASE WHEN l_returnflag <> 'A' THEN array(0D, floor(l_discount * 20) * 36D, 600D - 12 * floor(l_quantity / 25), 792D) END AS crop,
               CASE WHEN l_linestatus = 'O' THEN array(612D, 792D, 0D, 0D) WHEN l_returnflag = 'A' AND l_quantity > 40 THEN array(0D, 0D, 612D) ELSE array(0D, 0D, 595D, 842D) END AS media
        FROM _lineitem""")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of pages.html as destinations, and each page's own address; ten web pages are one document."""
    p = read(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).cast("string").alias("doc_id"), (F.col("page_id") % 10 + 1).cast("long").alias("page"), "url", F.coalesce("html", F.lit("")).alias("html"))
    hrefs = p.select("doc_id", "page", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("dest"))
    none = F.lit(None).cast("string")
    return hrefs.select("doc_id", "page", F.when(F.col("dest").contains("ó"), "GoTo").otherwise("Link").alias("subtype"), none.alias("uri"), "dest").unionByName(p.select("doc_id", "page", F.lit("Link").alias("subtype"), F.col("url").alias("uri"), none.alias("dest")))


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select(F.floor(F.col("page_id") / 10).cast("string").alias("doc_id"), (F.col("page_id") % 10 + 1).cast("long").alias("page"), F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1).alias("text"))


def web_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image row for each list item of a page, its text as the payload."""
    p = read(spark, sf_dir, "pages")
    tagged = p.select(F.floor(F.col("page_id") / 10).cast("string").alias("doc_id"), (F.col("page_id") % 10 + 1).cast("long").alias("page"), F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<li><a href="([^"]*)"'), 1)).alias("i", "x"))
    return tagged.select("doc_id", "page", F.col("i").cast("long").alias("image_index"), data_url(F.col("x").cast("binary")).alias("data_url"))


def xobjects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """parts of a supplier group as XObjects of pages, and the names that pages paint."""
    part = read(spark, sf_dir, "part")
    x = part.select(
        (F.col("p_partkey") % 97).cast("string").alias("doc_id"), (F.col("p_size") % 7 + 1).cast("long").alias("page"), F.concat(F.lit("Im"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_partkey") % 5 == 0, "Form").otherwise("Image").alias("subtype"), (F.col("p_size") % 4).cast("long").alias("width"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_size").cast("long")).alias("height"),
    )
    names = x.where((F.col("page") % 2 == 0) & (F.expr("CAST(substr(name, 3) AS BIGINT)") % 3 == 0)).select("doc_id", "page", "name")
    return x, names


def cascade_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with whole native texts, and pages without: benchmark items as what an engine reads, and as what is drawn.

    Labelled documents were drawn as well; quality says whether a page has forms, toxic whether it has vector content.
    """
    d, l, b = (read(spark, sf_dir, n) for n in ("documents", "labels", "benchmark"))
    l = l.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    none, flag = F.lit(None).cast("string"), lambda c: F.coalesce(c, F.lit(0)) == 1
    drawn = F.when(F.col("quality").isNotNull(), F.concat(F.lit("drawn "), F.col("doc_id").cast("string")))
    native = d.select("doc_id", "text", "source").join(l, "doc_id", "left").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.col("text").alias("native"), none.alias("ocr_text"), drawn.alias("rendered_text"), flag(F.col("quality")).alias("has_form"), flag(F.col("toxic")).alias("has_vector"))
    odd = F.length("text") % 2 == 1
    read_pages = b.select(F.lit("read").alias("doc_id"), F.col("item_id").alias("page"), F.lit(" \n\t").alias("native"), F.col("text").alias("ocr_text"), none.alias("rendered_text"), F.lit(False).alias("has_form"), odd.alias("has_vector"))
    drawn_pages = b.select(F.lit("drawn").alias("doc_id"), F.col("item_id").alias("page"), none.alias("native"), F.lit("").alias("ocr_text"), F.col("text").alias("rendered_text"), odd.alias("has_form"), F.lit(False).alias("has_vector"))
    return native.unionByName(read_pages).unionByName(drawn_pages)


def objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References, and the relation of objects that they lead into: orders refer to the order before or to their customer, customers to
    nations, some in a circle or nowhere. What refers: each order's object, and each event by a number in its properties."""
    key = F.col("o_orderkey")
    name = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    ref = lambda c: F.to_json(F.struct(c.alias("ref")))
    o = read(spark, sf_dir, "orders").select(name("o", key).alias("id"), ref(F.when(key % 64 != 0, name("o", key - 1)).otherwise(name("c", F.col("o_custkey")))).alias("json"))
    k = F.col("c_custkey")
    to = F.when(k % 50 == 1, name("c", k + 1)).when(k % 50 == 2, name("c", k - 1)).when(k % 50 == 3, F.lit("n99")).otherwise(name("n", F.col("c_nationkey")))
    c = read(spark, sf_dir, "customer").select(name("c", k).alias("id"), ref(to).alias("json"))
    n = read(spark, sf_dir, "nation").select(name("n", F.col("n_nationkey")).alias("id"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("json"))
    book = lambda df: df.withColumn("doc_id", F.lit("book"))
    table = book(o.unionByName(c).unionByName(n)).select("doc_id", "id", F.parse_json("json").alias("value"))
    said = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    refs = read(spark, sf_dir, "events").select(name("e", F.col("event_id")).alias("source"), name("c", said).alias("id")).unionByName(o.select(F.col("id").alias("source"), "id"))
    return book(refs), table


def order_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a priority as a tree: a spine with a leaf at each node for the lowest, for others a node below that of half its number or the one before."""
    o = numbered(read(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_custkey"), ["o_orderpriority"], ["o_orderkey"], "k")
    k = F.col("k")
    up = F.when(k == 0, None).when((k % 4 == 1) | ((F.col("o_orderpriority") == "5-LOW") & (k % 2 == 1)), k - 1).when(F.col("o_orderpriority") == "5-LOW", k - 2).otherwise(F.floor(k / 2))
    return o.select(F.col("o_orderpriority").alias("doc_id"), k.alias("id"), up.cast("long").alias("parent"), (F.col("o_custkey") % 7).cast("long").alias("place"))


def coded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as two very long rows of bytes, each coded as the difference from the one before."""
    return read(spark, sf_dir, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("long") * 7 - 100).alias("delta"))


def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a few documents of very many pages: a flag is a document, and the pages of forty orders change their box twice."""
    by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    n = numbered(read(spark, sf_dir, "lineitem").select("l_returnflag", *by), ["l_returnflag"], by, "page")
    at = F.col("l_orderkey") % 40
    box = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    crop = F.when(at < 5, box(0, 0, 842, 595)).when(at < 9, box(0, 792, 612, 0))
    return n.select(F.col("l_returnflag").alias("doc_id"), (F.col("page") + 1).alias("page"), crop.alias("crop"), F.when(at == 9, None).otherwise(box(0, 0, 595, 842)).alias("media"))


def ordered_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotations of web pages, and one note for each event; most notes are on few pages."""
    e = read(spark, sf_dir, "events")
    notes = e.select(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("doc_id"), F.lit(1).cast("long").alias("page"), F.col("event_type").alias("subtype"), F.col("event_id").alias("annotation_index"))
    a = annotations(spark, sf_dir)
    return notes.unionByName(a.select("doc_id", "page", "subtype", F.length(F.coalesce("dest", "uri")).cast("long").alias("annotation_index")))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations as pages, with '/' and page-count lines put in."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    n = c.groupBy("conv_id").agg(F.count("*").alias("page_count"))
    total = F.col("page_count").cast("string")
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n / \n"), total)).when(F.col("turn") % 3 == 1, F.concat(F.lit("/\n"), total, F.lit("\n/\n"), F.col("text"), F.lit("\n/"))).otherwise(F.col("text"))
    p = c.join(n, "conv_id").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).alias("page"), "page_count", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return p.withColumn("pos", F.col("pos").cast("long"))
