"""PDF scans: (doc_id, content) -> one frame per relation, parsed by Arrow batches.

A relation has a scan of its own, so a query that needs text never decodes images;
``everything`` gives the rows of several relations from one parse, told apart by ``kind``.
Binary content goes no further than the scan. ``errors`` is 'fail' (the
task fails with the load error) or 'skip' (no rows; load_errors names such documents).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.plans.session import bounded_batches
from pagemill.sources import extract as X
from pagemill.sources.syntax import Document, PdfError, load, small

TEXT = "doc_id string, page long, page_count long, text string"
IMAGES = "doc_id string, page long, image_index long, width long, height long, data binary, color_space string, bits_per_component long, filter string, xobject_name string, object_id string"
ANNOTATIONS = "doc_id string, page long, annotation_index long, subtype string, rect array<double>, uri string, dest string, content string"
META = "doc_id string, page_count long, version string, is_linearized boolean, creator string, producer string, raw_creation string, raw_modification string"
RECTS = "doc_id string, page long, crop array<double>, media array<double>"
SHAPES = "doc_id string, page long, has_form boolean, has_vector boolean"
RENDERED = "doc_id string, page long, width long, height long, dpi long, data binary"
ERRORS = "doc_id string, error string"


def read_pdfs(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files as (doc_id, content); doc_id is the path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "content")


def text_rows(doc: Document) -> Iterator[dict]:
    pages = doc.pages()
    for k, page in enumerate(pages):
        yield {"page": k + 1, "page_count": len(pages), "text": X.page_text(doc, page)}


def image_rows(doc: Document, decoders: dict | None = None) -> Iterator[dict]:
    for k, page in enumerate(doc.pages()):
        for row in X.page_images(doc, page, decoders):
            yield {"page": k + 1} | row


def annotation_rows(doc: Document) -> Iterator[dict]:
    for k, page in enumerate(doc.pages()):
        for row in X.page_annotations(doc, page):
            yield {"page": k + 1} | row


def meta_rows(doc: Document) -> Iterator[dict]:
    yield X.metadata(doc)


def rect_rows(doc: Document) -> Iterator[dict]:
    for k, page in enumerate(doc.pages()):
        yield {"page": k + 1} | X.page_rects(doc, page)


def shape_rows(doc: Document) -> Iterator[dict]:
    for k, page in enumerate(doc.pages()):
        yield {"page": k + 1, "has_form": X.has_form(doc, page), "has_vector": X.has_vector(doc, page)}


#: Relation -> (rows, schema).
RELATIONS: dict[str, tuple[Callable[[Document], Iterable[dict]], str]] = {"text": (text_rows, TEXT), "images": (image_rows, IMAGES), "annotations": (annotation_rows, ANNOTATIONS), "meta": (meta_rows, META), "boxes": (rect_rows, RECTS), "shapes": (shape_rows, SHAPES)}


def everything(kinds: Iterable[str], decoders: dict | None = None) -> tuple[Callable[[Document], Iterator[dict]], str]:
    """Rows of several relations of one parsed document, and their common schema."""
    wanted = {k: RELATIONS[k] for k in kinds}
    columns = dict.fromkeys(c for _, ddl in wanted.values() for c in ddl.split(", ")[1:])

    def rows(doc: Document) -> Iterator[dict]:
        for kind, (of, _) in wanted.items():
            for row in image_rows(doc, decoders) if kind == "images" else of(doc):
                yield {"kind": kind} | row

    return rows, ", ".join(["doc_id string", "kind string", *columns])


def names_of(ddl: str) -> list[str]:
    return [c.split(" ")[0] for c in ddl.split(", ")]


def schema_of(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


_EACH = {str: 4, bytes: 1, list: 32}


def weight(row: dict) -> int:
    """Some bytes that a row holds, as Python objects."""
    held = 512
    for v in row.values():
        held += len(v) * each if (each := _EACH.get(type(v))) else 0
    return held


def scan(docs: DataFrame, rows: Callable[..., Iterable[dict]], ddl: str, errors: str = "fail", bytes_each: int = 4 << 20) -> DataFrame:
    """Rows of each document; an output batch is closed at ``bytes_each`` of rows as Python objects.

    Documents come in batches of bounded bytes (``bounded_batches``), and one at a time is parsed.

    With a column ``pages`` (an array of page numbers), ``rows`` gets these as its second argument.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(schema_of(ddl))
    some = "pages" in docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0
        for b in batches:
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                try:
                    doc = load(b.column(1)[i].as_py())
                except PdfError:
                    if errors == "fail":
                        raise
                    continue
                for row in rows(doc, b.column(2)[i].as_py()) if some else rows(doc):
                    out.append({"doc_id": doc_id} | row)
                    held += weight(row)
                    if held >= bytes_each:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                doc = None  # goes before the next is parsed
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
        small.cache_clear()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("string"), "content", *["pages"] * some).mapInArrow(run, ddl)


def load_errors(docs: DataFrame) -> DataFrame:
    """doc_id, error of the documents that cannot be loaded."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, said = [], []
            for i in range(b.num_rows):
                try:
                    load(b.column(1)[i].as_py())
                except PdfError as e:
                    ids.append(b.column(0)[i].as_py())
                    said.append(str(e))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(said, pa.string())], names=["doc_id", "error"])

    return docs.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, ERRORS)


def register(spark: SparkSession) -> None:
    """SQL table functions pdf_pages, pdf_images, pdf_annotations, pdf_info, pdf_boxes and pdf_shapes of a binary column."""
    from pyspark.sql.functions import udtf

    def of(rows, ddl):
        names = names_of(ddl)[1:]
        returns = ddl.split(", ", 1)[1]

        class Table:
            def eval(self, content):
                for row in rows(load(bytes(content))):
                    yield tuple(row[n] for n in names)

        return udtf(Table, returnType=returns)

    for name, kind in (("pdf_pages", "text"), ("pdf_images", "images"), ("pdf_annotations", "annotations"), ("pdf_info", "meta"), ("pdf_boxes", "boxes"), ("pdf_shapes", "shapes")):
        spark.udtf.register(name, of(*RELATIONS[kind]))
