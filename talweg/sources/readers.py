"""Landed files by ``spark.read.format("landed")``: sheets, archive members and PDF pages, a partition for each file or member.

    readers.register(spark)
    spark.read.format("landed").option("kind", "pdf").load("hdfs:///landed/budgets")

Kinds: "sheets" (path, sheet, row, col, value), "zip" (path, member, content; option
``member`` is an expression for its name), "pdf" (path, page, lines). Files are opened
through Arrow's file systems, so a path may be on any store that those know; where only
Spark reads the store, ``files.read_sheets``, ``tables.read_zip`` and ``files.read_pdf`` give the
same rows through Spark's own binary reader.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from talweg.sources import files, pdf

KINDS = {"sheets": files.CELLS, "zip": "path string, member string, content binary", "pdf": "path string, page int, lines array<string>"}
ENDINGS = {"sheets": (".xlsx", ".ods"), "zip": (".zip",), "pdf": (".pdf",)}


class Part(InputPartition):
    """A file, or a member of one."""

    def __init__(self, path: str, member: str | None = None):
        super().__init__(path)
        self.path, self.member = path, member


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def _kind(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        return kind

    def schema(self) -> str:
        return KINDS[self._kind()]

    def reader(self, schema) -> DataSourceReader:
        return LandedReader(self._kind(), self.options.get("path", ""), self.options.get("member", "."))


class LandedReader(DataSourceReader):
    def __init__(self, kind: str, path: str, member: str):
        self.kind, self.path, self.member = kind, path, member

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path)
        found = [store.get_file_info(at)] if store.get_file_info(at).type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(ENDINGS[self.kind]))
        if self.kind != "zip":
            return [Part(p) for p in paths]
        parts = []
        for p in paths:
            with zipfile.ZipFile(store.open_input_file(p)) as z:
                names = z.namelist()
            if bad := [n for n in names if n.startswith("/") or ".." in n.split("/")]:
                raise ValueError(f"{p}: {bad[0]} leaves the archive")
            parts += [Part(p, n) for n in names if re.search(self.member, n) and not n.endswith("/")]
        return parts

    def read(self, part: Part) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(part.path) as f:
            if part.member is not None:
                with zipfile.ZipFile(f) as z:
                    yield part.path, part.member, z.read(part.member)
                return
            content = f.read()
        if self.kind == "pdf":
            for page, lines in enumerate(pdf.page_lines(content)):
                yield part.path, page, lines
            return
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for cell in files.sheet_cells(z):
                yield part.path, *cell


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Landed)
