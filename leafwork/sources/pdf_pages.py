"""A Spark data source of rendered PDF pages, one partition for each range of pages.

    spark.dataSource.register(PdfPages)
    spark.read.format("pdf_pages").option("paths", "a.pdf,b.pdf").option("dpi", 150).load()

Rendering needs a library that is not part of this package; reading fails with a
plain message where it is missing.  The source's paths must be on storage that
executors mount; files elsewhere come as bytes through uploads.read_files()."""

from __future__ import annotations

import importlib.util

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, page int, width int, height int, dpi int, image binary"
PAGES_PER_PARTITION = 16


class PageRange(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def available() -> bool:
    return importlib.util.find_spec("fitz") is not None


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options)


class PdfReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.dpi = int(options.get("dpi", 150))

    def partitions(self):
        if not available():
            raise RuntimeError("pdf_pages: no PDF renderer is installed")
        import fitz

        out = []
        for p in self.paths:
            with fitz.open(p) as doc:
                out += [PageRange(p, a, min(a + PAGES_PER_PARTITION, doc.page_count)) for a in range(0, doc.page_count, PAGES_PER_PARTITION)]
        return out

    def read(self, partition):
        import fitz

        with fitz.open(partition.path) as doc:
            for n in range(partition.first, partition.last):
                pix = doc[n].get_pixmap(dpi=self.dpi)
                yield partition.path, n + 1, pix.width, pix.height, self.dpi, pix.tobytes("png")


def page_ranges(pages: int, each: int = PAGES_PER_PARTITION) -> list[tuple[int, int]]:
    return [(a, min(a + each, pages)) for a in range(0, pages, each)]
