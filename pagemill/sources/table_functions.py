"""Table functions over tables, for SQL: TABLE(...) PARTITION BY ... ORDER BY ..."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class StripArtifacts:
    """Lines of a page in order -> those that are no footer artifact: '/' followed by the page count goes, with the count.

    The table has columns ``line`` and ``page_count``, and any others, which pass through; its schema is the
    result's. One line is held back at a time, so a page of any length takes the memory of two lines. A null line is kept.
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable:
            raise ValueError("strip_artifacts takes a TABLE argument")
        kinds = {f.name: f.dataType for f in lines.dataType.fields}
        if not isinstance(kinds.get("line"), StringType) or "page_count" not in kinds:
            raise ValueError("strip_artifacts needs the columns line (string) and page_count")
        return AnalyzeResult(schema=lines.dataType)

    def __init__(self) -> None:
        self.held: Row | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        held, self.held = self.held, row
        if held is None:
            return
        if row["page_count"] is not None and held["line"] is not None and held["line"].strip() == "/" and row["line"] is not None and row["line"].strip() == str(row["page_count"]):
            self.held = None
            return
        yield tuple(held)

    def terminate(self) -> Iterator[tuple]:
        if self.held is not None:
            yield tuple(self.held)


def register_table_functions(spark: SparkSession) -> None:
    """strip_artifacts(TABLE(lines) PARTITION BY (doc_id, page) ORDER BY pos)."""
    spark.udtf.register("strip_artifacts", udtf(StripArtifacts))
