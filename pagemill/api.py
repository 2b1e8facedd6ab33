"""The public surface: documents in, relations out.

``docs`` is a frame of (doc_id, content), or what ``parse`` made of one: then no function
parses again. Functions are lazy, but for those that read a relation more than once
(structured text, metadata, documents, OCR): they write what they parsed to the shared folder, once. Options follow the names of the OCR and
render settings: lang, min_text_length, max_threads, render, render_dpi; an OCR
engine or renderer is a function given by the caller, since none is bundled.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import pdf_date_to_iso, strip_footer_artifacts, trim
from pagemill.operators import boxes as B
from pagemill.operators import cascade as C
from pagemill.operators import relations as R
from pagemill.operators.structure import structured_text as _structure
from pagemill.plans.session import cut
from pagemill.sources import extract as X
from pagemill.sources import scans as S
from pagemill.sources.syntax import Document


@dataclass(frozen=True)
class OcrOptions:
    """engine: (pixel array, lang) -> text; renderer: (document bytes, page number, dpi) -> pixel array or None.

    ``max_threads``: images of a document that one task recognises at a time (default 4, one to the
    executor's cores). Tasks are those of the frame; nothing is gathered for the engine.
    """

    lang: str = "eng"
    min_text_length: int = 1
    max_threads: int | None = None
    render: str = "Auto"
    render_dpi: int | None = None
    engine: Callable | None = None
    renderer: Callable | None = None


def dpi_of(dpi: int | None) -> int:
    return min(max(300 if dpi is None else dpi, 72), 600)


def threads_of(most: int | None) -> int:
    return min(max(4 if most is None else most, 1), os.cpu_count() or 1)


def parse(docs: DataFrame, kinds: Iterable[str] = ("text", "images", "annotations", "meta", "boxes"), errors: str = "fail", decoders: dict | None = None) -> DataFrame:
    """One parse of each document for several relations, written to the shared folder; the other functions take it for ``docs``."""
    return cut(S.scan(docs, *S.everything(kinds, decoders), errors))


def _rows(docs: DataFrame, kind: str, errors: str, decoders: dict | None = None) -> DataFrame:
    """A relation of documents, or of what was parsed of them."""
    rows, ddl = S.RELATIONS[kind]
    if "kind" in docs.columns:
        return docs.where(F.col("kind") == kind).select(*S.names_of(ddl))
    return S.scan(docs, (lambda d: S.image_rows(d, decoders)) if kind == "images" else rows, ddl, errors)


def _parsed(docs: DataFrame, kinds: Iterable[str], errors: str, decoders: dict | None = None) -> DataFrame:
    return docs if "kind" in docs.columns else parse(docs, kinds, errors, decoders)


def in_order(rows: DataFrame) -> DataFrame:
    """The rows sorted for a sink: by document, page and number within the page. They are written once first: a sort
    reads its input twice, to sample its ranges and to deal the rows, and would parse it twice."""
    return cut(rows).orderBy(*[c for c in ("doc_id", "page", "image_index", "annotation_index", "box_index") if c in rows.columns])


def page_text(docs: DataFrame, errors: str = "fail") -> DataFrame:
    return _rows(docs, "text", errors).select("doc_id", "page", strip_footer_artifacts(F.col("text"), F.col("page_count")).alias("text"))


def structured_text(docs: DataFrame, errors: str = "fail") -> DataFrame:
    return _structure(page_text(_parsed(docs, ["text"], errors)))


def body_text(structured: DataFrame) -> DataFrame:
    """doc_id, text: the bodies of a document's pages that are not blank, in order, with an empty line between them."""
    full = structured.where(trim(F.col("body")) != "")
    return full.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "\n\n").alias("text"))


def page_images(docs: DataFrame, errors: str = "fail", decoders: dict | None = None) -> DataFrame:
    return _rows(docs, "images", errors, decoders)


def page_annotations(docs: DataFrame, errors: str = "fail") -> DataFrame:
    return _rows(docs, "annotations", errors)


def page_boxes(docs: DataFrame, errors: str = "fail") -> DataFrame:
    return B.page_boxes(B.page_geometry(_rows(docs, "boxes", errors)))


_BOX = ["page_count", "left", "bottom", "right", "top", "width", "height", "box_type", "pages"]


def metadata(docs: DataFrame, errors: str = "fail") -> DataFrame:
    docs = _parsed(docs, ["meta", "boxes"], errors)
    m = _rows(docs, "meta", errors).withColumns({"creation_date": pdf_date_to_iso(F.col("raw_creation")), "modification_date": pdf_date_to_iso(F.col("raw_modification"))}).drop("raw_creation", "raw_modification")
    b = page_boxes(docs, errors).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("box_index", F.struct(*_BOX).alias("b")))), lambda x: x["b"]).alias("page_boxes"))
    j = m.join(b, "doc_id", "left")
    return j.withColumn("page_boxes", F.coalesce("page_boxes", F.array().cast(b.schema["page_boxes"].dataType)))


def _nest(rows: DataFrame, name: str, key: str) -> DataFrame:
    cols = [c for c in rows.columns if c != "doc_id"]
    pages = f"{name}_pages"
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*([c for c in ("page", key) if c in cols] + [c for c in cols if c not in ("page", key)])))).alias(name), F.sort_array(F.collect_set("page")).alias(pages))


def _assemble(docs: DataFrame, text: DataFrame, structured: DataFrame, errors: str) -> DataFrame:
    images, notes = page_images(docs, errors), page_annotations(docs, errors)
    out = metadata(docs, errors)
    for rows, name, key in ((text, "text", "page"), (structured, "structured_text", "page"), (images, "images", "image_index"), (notes, "annotations", "annotation_index")):
        nested = _nest(rows, name, key)
        out = out.join(nested, "doc_id", "left").withColumns({c: F.coalesce(c, F.array().cast(nested.schema[c].dataType)) for c in (name, f"{name}_pages")})
    return out.drop("text_pages", "structured_text_pages").withColumnsRenamed({"images_pages": "image_pages", "annotations_pages": "annotation_pages"}).withColumns({"total_images": F.size("images").cast("long"), "total_annotations": F.size("annotations").cast("long")})


def document(docs: DataFrame, errors: str = "fail") -> DataFrame:
    """One nested row per document: metadata, totals, page lists, text, structured text, images, annotations."""
    docs = parse(docs, errors=errors) if "kind" not in docs.columns else docs
    text = page_text(docs, errors)
    return _assemble(docs, text, _structure(text), errors)


def _read(engine: Callable, x, lang: str) -> str:
    try:
        return engine(x, lang) or ""
    except Exception:  # noqa: BLE001  an engine that fails has read nothing
        return ""


def _engine_rows(options: OcrOptions):
    def rows(doc: Document, pages: list[int]):
        refs = doc.pages()
        with ThreadPoolExecutor(threads_of(options.max_threads)) as pool:
            for page in sorted(pages):
                images = list(X.page_images(doc, refs[page - 1], raw=True))
                for r, text in zip(images, pool.map(lambda r: _read(options.engine, r["data"], options.lang), images)):
                    yield {"page": page, "image_index": r["image_index"], "text": text}

    return rows


def _drawn(renderer: Callable, doc: Document, page: int, dpi: int):
    """A page's pixels, or None where it cannot be drawn."""
    try:
        return renderer(doc.data, page, dpi)
    except Exception:  # noqa: BLE001  a page that fails is passed over, the others are not
        return None


def _drawn_rows(options: OcrOptions):
    def rows(doc: Document, pages: list[int]):
        for page in sorted(pages):
            x = _drawn(options.renderer, doc, page, dpi_of(options.render_dpi))
            yield {"page": page, "rendered_text": "" if x is None else _read(options.engine, x, options.lang)}

    return rows


def _shape_rows(doc: Document, pages: list[int]):
    refs = doc.pages()
    for page in sorted(pages):
        yield {"page": page, "has_form": X.has_form(doc, refs[page - 1]), "has_vector": X.has_vector(doc, refs[page - 1])}


def _of_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents that have one of the pages, with their page numbers; the other columns of ``docs`` are left behind."""
    held = pages.groupBy("doc_id").agg(F.collect_list("page").alias("pages"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").join(held, "doc_id")


def page_text_ocr(docs: DataFrame, options: OcrOptions = OcrOptions(), errors: str = "fail") -> DataFrame:
    """doc_id, page, text, source by the cascade.

    Only pages whose native text does not suffice reach the engine, and only those that it reads
    nothing in and that may be drawn reach the renderer (all pages do in mode Always).
    """
    from pagemill.functions.text import visible_chars

    native = page_text(parse(docs, ["text"], errors)).withColumnRenamed("text", "native")
    out = native
    none = {"ocr_text": F.lit(None).cast("string"), "rendered_text": F.lit(None).cast("string"), "has_form": F.lit(False), "has_vector": F.lit(False)}
    if options.engine is not None:
        key = ["doc_id", "page"]
        bare = native.where(visible_chars(F.col("native")) < options.min_text_length).select(*key)
        t = S.scan(_of_pages(docs, bare), _engine_rows(options), "doc_id string, page long, image_index long, text string", errors)
        read = cut(R.join_texts(t.withColumn("text", trim(F.col("text")))).withColumnRenamed("text", "ocr_text"))
        out = out.join(read, key, "left")
        del none["ocr_text"]
        if options.renderer is not None and options.render != "Never":
            open_pages = bare.join(read, key, "left_anti")
            shapes = cut(S.scan(_of_pages(docs, open_pages), _shape_rows, S.SHAPES, errors))
            wanted = native.select(*key) if options.render == "Always" else shapes.where("has_form or has_vector").select(*key)
            drawn = S.scan(_of_pages(docs, wanted), _drawn_rows(options), "doc_id string, page long, rendered_text string", errors)
            out = out.join(drawn.withColumn("rendered_text", trim(F.col("rendered_text"))), key, "left").join(shapes, key, "left")
            none = {}
    return C.cascade(out.withColumns(none) if none else out, options.render, options.min_text_length)


def structured_text_ocr(docs: DataFrame, options: OcrOptions = OcrOptions(), errors: str = "fail") -> DataFrame:
    return C.structured_with_source(page_text_ocr(docs, options, errors))


def document_ocr(docs: DataFrame, options: OcrOptions = OcrOptions(), errors: str = "fail") -> DataFrame:
    text = cut(page_text_ocr(docs, options, errors))
    return _assemble(parse(docs, ["images", "annotations", "meta", "boxes"], errors), text, C.structured_with_source(text), errors)


def render_pages(docs: DataFrame, renderer: Callable | None = None, mode: str = "Always", dpi: int | None = None, errors: str = "fail", decoders: dict | None = None) -> DataFrame:
    """Pages as PNG: all of them, none (Never), or (Auto) those without visible text and decodable image.

    Without a renderer this fails, unless the mode is Never; a page that cannot be drawn gives no row.
    """
    spark = docs.sparkSession
    if mode == "Never":
        return spark.createDataFrame([], S.RENDERED)
    if renderer is None:
        raise RuntimeError("no renderer is available")
    size = dpi_of(dpi)

    def rows(doc: Document):
        for k, page in enumerate(doc.pages()):
            if mode == "Auto" and (X.page_text(doc, page).strip() or X.has_image(doc, page, decoders)):
                continue
            x = _drawn(renderer, doc, k + 1, size)
            if x is not None:
                yield {"page": k + 1, "width": x.shape[1], "height": x.shape[0], "dpi": size, "data": X.png(x)}

    return S.scan(docs, rows, S.RENDERED, errors)


def capabilities(spark: SparkSession, engine: Callable | None = None, renderer: Callable | None = None) -> DataFrame:
    """One row: can this session recognise, can it render."""
    return spark.range(1).select(F.lit(engine is not None).alias("ocr"), F.lit(renderer is not None).alias("render"))


def first_binding(path: str | None, bind: Callable[[str | None], Callable | None], variable: str = "RENDER_LIBRARY_PATH") -> Callable:
    """The renderer that ``bind`` makes: of the given path, else of the path in an environment variable, else (None) of the system.

    The first that is found serves from then on, also where another path is asked for later.
    """
    if "renderer" not in _bound:
        named = os.environ.get(variable)
        tries = [x for x in (path, named) if x is not None] + [None]
        found = next((r for x in tries if (r := bind(x)) is not None), None)
        if found is None:
            raise RuntimeError(f"no renderer is available: install one or set {variable}")
        _bound["renderer"] = found
    return _bound["renderer"]


_bound: dict[str, Callable] = {}
