"""Where a page's text comes from: native, OCR of its images, or OCR of its rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import visible_chars
from pagemill.operators.structure import structured_text

NATIVE, OCR, RENDERED = "Native", "Ocr", "Rendered"


def cascade(pages: DataFrame, mode: str = "Auto", least: int = 1) -> DataFrame:
    """(doc_id, page, native, ocr_text, rendered_text, has_form, has_vector) -> doc_id, page, text, source.

    First match wins: rendered text of an Always page whose native text suffices; native text that
    suffices; OCR text; rendered text where mode is Always or the page has forms or vector
    content (never in mode Never); else '' tagged Ocr. Null candidates count as empty.
    """
    enough = visible_chars(F.coalesce("native", F.lit(""))) >= least
    ocr, drawn = F.coalesce("ocr_text", F.lit("")), F.coalesce("rendered_text", F.lit(""))
    always, may = F.lit(mode == "Always"), F.lit(mode != "Never") & (F.lit(mode == "Always") | F.col("has_form") | F.col("has_vector"))
    tier = F.when(enough & always & (drawn != ""), RENDERED).when(enough, NATIVE).when(ocr != "", OCR).when(F.coalesce(may, F.lit(False)) & (drawn != ""), RENDERED)
    text = F.when(tier == RENDERED, drawn).when(tier == NATIVE, F.col("native")).when(tier == OCR, ocr).otherwise("")
    return pages.select("doc_id", "page", text.alias("text"), F.coalesce(tier, F.lit(OCR)).alias("source"))


def structured_with_source(pages: DataFrame) -> DataFrame:
    """Header, body and footer of cascaded pages, with the source of each page."""
    return structured_text(pages, ("source",))
