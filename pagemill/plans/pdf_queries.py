"""Registered queries that write table rows as PDF files, parse these, and are checked by SQL on the rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import api
from pagemill.plans import fixtures as X
from pagemill.plans import queries as Q
from pagemill.sources import scans, writer

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# documents of five lines to a page, with a running head and a numbered foot

PAPERS = """d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l FROM documents),
n AS (SELECT doc_id, l, greatest(1, (len(l) + 4) // 5) AS n FROM d),
papers AS (SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(n AS BIGINT) AS page_count,
  array_to_string(list_concat(['Collected papers'], list_concat(l[5 * page - 4:5 * page], ['Page ' || page || ' of ' || n])), chr(10)) || chr(10) AS text
  FROM (SELECT *, unnest(range(1, n + 1)) AS page FROM n))"""


def papers(spark, sf_dir) -> DataFrame:
    """(doc_id, content): each document as a PDF."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x != "")
    d = X.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), lines.alias("l"))
    d = d.withColumn("n", F.greatest(F.lit(1), F.ceil(F.size("l") / 5)).cast("int")).select("doc_id", "l", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    foot = F.format_string("Page %d of %d", "page", "n")
    return writer.write(d.select("doc_id", "page", F.concat(F.array(F.lit("Collected papers")), F.slice("l", F.col("page") * 5 - 4, F.lit(5)), F.array(foot)).alias("lines")), lambda rows: (rows, None))


@query(f"WITH {PAPERS} SELECT doc_id, page, text FROM papers")
def pdf_text(spark, sf_dir):
    return api.page_text(papers(spark, sf_dir))


@query(f"WITH {PAPERS}, {Q._structure_sql('papers')}")
def pdf_structured_text(spark, sf_dir):
    return api.structured_text(papers(spark, sf_dir))


@query(f"""WITH {PAPERS}, st AS (WITH x AS (SELECT 1), {Q._structure_sql('papers')})
SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY page) AS text FROM st WHERE {Q._TRIM('body')} <> '' GROUP BY doc_id""")
def pdf_body_text(spark, sf_dir):
    return api.body_text(api.structured_text(papers(spark, sf_dir)))


@query(f"WITH {PAPERS} SELECT doc_id, page, text FROM papers")
def pdf_table_function(spark, sf_dir):
    scans.register(spark)
    papers(spark, sf_dir).createOrReplaceTempView("_papers")
    return spark.sql("SELECT doc_id, p.page, p.text FROM _papers, LATERAL pdf_pages(content) p")


# web pages with their links

def web(spark, sf_dir) -> DataFrame:
    links = X.annotations(spark, sf_dir).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("subtype", "uri", "dest"))).alias("links"))
    rows = X.web_pages(spark, sf_dir).join(links, ["doc_id", "page"], "left")

    def build(rows):
        pages = [{} for _ in range(rows[-1]["page"])]
        for r in rows:
            pages[r["page"] - 1] = {"lines": [r["text"]], "links": [(x["subtype"], x["uri"], x["dest"], [0, r["page"], 10.5, 20.25]) for x in r["links"] or []]}
        return pages, None

    return writer.write(rows, build)


@query(f"WITH {Q._ANNOTS} SELECT doc_id, page, subtype, [0::DOUBLE, CAST(page AS DOUBLE), 10.5, 20.25] AS rect, uri, dest, NULL::VARCHAR AS content FROM a")
def pdf_annotations(spark, sf_dir):
    return api.page_annotations(web(spark, sf_dir)).drop("annotation_index")


@query(f"""WITH {Q._ANNOTS}
SELECT t.doc_id, max(t.page) AS page_count, 0::BIGINT AS total_images, any_value(n) AS total_annotations, []::BIGINT[] AS image_pages, any_value(p) AS annotation_pages, max(t.page) AS n_texts
FROM t JOIN (SELECT doc_id, count(*) AS n, list_sort(list(DISTINCT page)) AS p FROM a GROUP BY doc_id) x ON t.doc_id = x.doc_id GROUP BY t.doc_id""")
def pdf_document(spark, sf_dir):
    d = api.document(web(spark, sf_dir))
    return d.select("doc_id", "page_count", "total_images", "total_annotations", "image_pages", "annotation_pages", F.size("text").cast("long").alias("n_texts"))


# parts as images and forms of pages

HELD = f"""{Q._XOBJ}, g AS (SELECT *, width * coalesce(height, 0) AS size FROM pt),
im AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY name) - 1 AS image_index, name, width, height, p_partkey, size
       FROM g WHERE subtype = 'Image' AND size > 0 AND p_partkey % 13 <> 0)"""


def held_images(spark, sf_dir) -> DataFrame:
    """A gray image of one value for each part; every thirteenth lacks its last byte, and every fifth is a form."""
    x, names = X.xobjects(spark, sf_dir)
    painted = names.withColumn("painted", F.lit(True))
    rows = x.join(painted, ["doc_id", "page", "name"], "left").withColumn("key", F.expr("CAST(substr(name, 3) AS BIGINT)"))

    def build(rows):
        pages: list[dict] = [{"objects": [], "paint": []} for _ in range(7)]
        for r in sorted(rows, key=lambda r: r["name"]):
            size = r["width"] * (r["height"] or 0)
            data = bytes([r["key"] % 251]) * (size - (r["key"] % 13 == 0 and size > 0))
            pages[r["page"] - 1]["objects"].append((r["name"], r["subtype"], r["width"], r["height"], "DeviceGray", 8, data if r["subtype"] == "Image" else b""))
            if r["painted"]:
                pages[r["page"] - 1]["paint"].append(r["name"])
        return pages, None

    return writer.write(rows, build)


def _pixel_sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the samples of gray PNG files without row filters."""
    for b in batches:
        out = []
        for data, width in zip(b.column("data").to_pylist(), b.column("width").to_pylist()):
            at = data.index(b"IDAT")
            raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
            out.append(sum(raw) - sum(raw[:: width + 1]))
        yield b.drop_columns(["data"]).append_column("pixel_sum", pa.array(out, pa.int64()))


@query(f"""WITH {HELD} SELECT doc_id, page, image_index, name AS xobject_name, width, height, 'DeviceGray' AS color_space, 8::BIGINT AS bits_per_component, 'FlateDecode' AS filter,
CAST(size * (p_partkey % 251) AS BIGINT) AS pixel_sum FROM im""")
def pdf_images(spark, sf_dir):
    i = api.page_images(held_images(spark, sf_dir)).drop("object_id")
    return i.mapInArrow(_pixel_sum, "doc_id string, page long, image_index long, width long, height long, color_space string, bits_per_component long, filter string, xobject_name string, pixel_sum long")


@query(f"""WITH {HELD}, docs AS (SELECT DISTINCT doc_id FROM x), p AS (SELECT doc_id, unnest(range(1, 8)) AS page FROM docs)
SELECT p.doc_id, CAST(p.page AS BIGINT) AS page, coalesce(bool_or(subtype = 'Form'), false) AS has_form, false AS has_vector FROM p LEFT JOIN pt ON p.doc_id = pt.doc_id AND p.page = pt.page GROUP BY p.doc_id, p.page""")
def pdf_shapes(spark, sf_dir):
    return scans.scan(held_images(spark, sf_dir), scans.shape_rows, scans.SHAPES)


@query(f"""WITH {HELD}, docs AS (SELECT DISTINCT doc_id FROM x), p AS (SELECT doc_id, unnest(range(1, 8)) AS page FROM docs),
o AS (SELECT doc_id, page, string_agg('value ' || (p_partkey % 251), chr(10) ORDER BY image_index) AS t FROM im GROUP BY doc_id, page),
f AS (SELECT doc_id, page, bool_or(subtype = 'Form') AS form FROM pt GROUP BY doc_id, page)
SELECT p.doc_id, CAST(p.page AS BIGINT) AS page, CASE WHEN t IS NOT NULL THEN t WHEN form THEN 'drawn ' || p.page ELSE '' END AS text,
       CASE WHEN t IS NULL AND form THEN 'Rendered' ELSE 'Ocr' END AS source
FROM p LEFT JOIN o ON p.doc_id = o.doc_id AND p.page = o.page LEFT JOIN f ON p.doc_id = f.doc_id AND p.page = f.page""")
def pdf_ocr(spark, sf_dir):
    """An engine that reads a gray image's value, and a renderer that draws a page's number."""
    import numpy as np

    engine = lambda x, lang: f"drawn {x[0, 0, 1]} " if x.shape[2] == 3 else f" value {x[0, 0, 0]}\t"
    renderer = lambda data, page, dpi: np.full((1, 1, 3), page, np.uint8)
    return api.page_text_ocr(held_images(spark, sf_dir), api.OcrOptions(engine=engine, renderer=renderer))


@query(f"""WITH {HELD}, docs AS (SELECT DISTINCT doc_id FROM x), p AS (SELECT doc_id, unnest(range(1, 8)) AS page FROM docs)
SELECT p.doc_id, CAST(p.page AS BIGINT) AS page, 2::BIGINT AS width, 3::BIGINT AS height, 600::BIGINT AS dpi FROM p LEFT JOIN im ON p.doc_id = im.doc_id AND p.page = im.page WHERE im.page IS NULL AND p.page <> 5""")
def pdf_render_auto(spark, sf_dir):
    """Pages without text and image are drawn; a renderer that fails on page 5 loses that page only."""
    import numpy as np

    def renderer(data, page, dpi):
        if page == 5:
            raise ValueError("cannot draw")
        return np.zeros((3, 2, 1), np.uint8)

    return api.render_pages(held_images(spark, sf_dir), renderer, "Auto", 1000).drop("data")


# boxes and metadata

@query(Q.ORACLE["page_boxes"])
def pdf_boxes(spark, sf_dir):
    return api.page_boxes(writer.write(X.rects(spark, sf_dir, writer.EACH), lambda rows: (rows, None), dealt=True))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, 1::BIGINT AS page_count, '1.7' AS version, false AS is_linearized, c_name AS creator, c_mktsegment AS producer,
'2000-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || 'T10:15:02+01:30' AS creation_date, CASE WHEN c_nationkey % 2 = 0 THEN '2000-01-01T00:00:00' END AS modification_date, 1::BIGINT AS n_boxes FROM customer""")
def pdf_metadata(spark, sf_dir):
    c = X.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(1).alias("page"), "c_name", "c_mktsegment", (F.col("c_custkey") % 28 + 1).alias("day"), (F.col("c_nationkey") % 2 == 0).alias("changed"))

    def build(rows):
        r = rows[0]
        return [{"media": [0, 0, 595, 842]}], {"Creator": writer.utf16(r["c_name"]), "Producer": r["c_mktsegment"].encode(), "CreationDate": f"D:200001{r['day']:02d}101502+01'30'".encode(), "ModDate": b"D:2000" if r["changed"] else None}

    m = api.metadata(writer.write(c, build))
    return m.withColumn("n_boxes", F.size("page_boxes").cast("long")).drop("page_boxes")


@query("SELECT 1::BIGINT AS n, false AS ocr, true AS render")
def capabilities(spark, sf_dir):
    return api.capabilities(spark, renderer=len).select(F.lit(1).cast("long").alias("n"), "ocr", "render")


@query(f"WITH {PAPERS} SELECT doc_id, page, text FROM papers")
def pdf_sorted_sink(spark, sf_dir):
    """The rows as they go to a sorted sink."""
    return api.in_order(api.page_text(papers(spark, sf_dir)))
