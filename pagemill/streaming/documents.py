"""Documents whose pages arrive in any order: put out as soon as the last page has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pagemill.operators.structure import structured_text

PAGE = "doc_id string, page long, text string, complete boolean"
_LONG = StructType([StructField("n", LongType())])


class Gather(StatefulProcessor):
    """Holds a document's pages in a map by page until there are page_count of them, or until nothing has come for ``wait_ms``.

    A page that comes again replaces the one before. What has waited too long is put out as it is, not complete; pages
    that come later begin anew. Each page is a state entry of its own, so a document is never one value.
    """

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", _LONG, StructType([StructField("text", StringType())]))
        self.count = handle.getValueState("count", _LONG)
        self.timer = handle.getValueState("timer", _LONG)

    def _out(self, key: str, complete: bool) -> Iterator[pd.DataFrame]:
        rows = sorted((k[0], v[0]) for k, v in self.pages.iterator())
        for i in range(0, len(rows), 1000):
            part = rows[i : i + 1000]
            yield pd.DataFrame({"doc_id": key, "page": [p for p, _ in part], "text": [t for _, t in part], "complete": complete})
        self.pages.clear()
        self.count.clear()
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = (self.count.get()[0] if self.count.exists() else 0), None
        for df in rows:
            for page, text, of in zip(df["page"].tolist(), df["text"].tolist(), df["page_count"].tolist()):
                n += not self.pages.containsKey((page,))
                self.pages.updateValue((page,), (text,))
                total = of
        self.count.update((n,))
        if total is not None and n >= total:
            yield from self._out(key[0], True)
        elif self.wait_ms:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield from self._out(key[0], False)

    def close(self) -> None:
        pass


def gathered(pages: DataFrame, wait_ms: int = 0) -> DataFrame:
    """A stream (doc_id, page, page_count, text) -> the pages of documents that are whole: doc_id, page, text, complete.

    ``wait_ms``: put out a document that lacks pages after so long without a new one; 0 waits for ever. The session needs
    the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    given = pages.where("doc_id is not null and page is not null").selectExpr("cast(doc_id as string) doc_id", "cast(page as long) page", "cast(page_count as long) page_count", "coalesce(text, '') text")
    return given.groupBy("doc_id").transformWithStateInPandas(Gather(wait_ms), PAGE, "Append", "ProcessingTime" if wait_ms else "None")


def stream_structured_text(pages: DataFrame, out: str, checkpoint: str, wait_ms: int = 0, **trigger):
    """Append header, body and footer of each document to a Parquet folder, once it is whole; a batch's documents go by its number, so a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        structured_text(batch.select("doc_id", "page", "text")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return gathered(pages, wait_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
