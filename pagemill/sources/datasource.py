"""``spark.read.format("pdf")``: pages of PDF files as a data source; small files share a partition."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagemill.sources import scans

RELATIONS = scans.RELATIONS
#: Bytes and files of a partition.
BYTES_EACH, FILES_EACH = 64 << 20, 512


class PdfFiles(InputPartition):
    def __init__(self, uris: list[str]):
        self.uris = uris


def grouped(files: list[tuple[str, int]], bytes_each: int = BYTES_EACH, files_each: int = FILES_EACH) -> list[list[str]]:
    """Files (uri, size) in groups of like size, in order."""
    out: list[list[str]] = []
    held = 0
    for uri, size in files:
        if not out or held + size > bytes_each or len(out[-1]) == files_each:
            out.append([])
            held = 0
        out[-1].append(uri)
        held += size
    return out


class PdfReader(DataSourceReader):
    def __init__(self, options: dict, relation: str):
        self.path, self.relation = options["path"], relation
        self.skip = options.get("errors", "fail") == "skip"

    def partitions(self) -> list[PdfFiles]:
        fs, base = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True)) if fs.get_file_info(base).type == pafs.FileType.Directory else [fs.get_file_info(base)]
        head = self.path[: self.path.index("://") + 3] if "://" in self.path else "file://"
        return [PdfFiles(uris) for uris in grouped([(head + f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.lower().endswith(".pdf")])]

    def read(self, partition: PdfFiles) -> Iterator[tuple]:
        from pagemill.sources.syntax import PdfError, load

        rows, ddl = RELATIONS[self.relation]
        names = scans.names_of(ddl)[1:]
        for uri in partition.uris:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                data = f.read()
            try:
                doc = load(data)
            except PdfError:
                if not self.skip:
                    raise
                continue
            for row in rows(doc):
                yield (uri, *(row[n] for n in names))


class PdfDataSource(DataSource):
    """Options: path, relation (text, images, annotations, meta, boxes or shapes), errors (fail or skip)."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return RELATIONS[self.options.get("relation", "text")][1]

    def reader(self, schema) -> PdfReader:
        return PdfReader(dict(self.options), self.options.get("relation", "text"))
