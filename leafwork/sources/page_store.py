"""A versioned store of pages and their results.

Five tables (pages, words, blocks, tables, cells) are bucketed by (doc_id, page) and
partitioned by segment.  A commit writes the rows of the pages it replaces to a new
segment of every table, and then puts one entry into the log, which names the
segment.  Readers list the log first and read its segments only; of a page they see
the rows of its highest version.  So the results of a page change at once in all
tables, and a writer that dies leaves segments that nobody reads.

Entries are numbered.  Putting one in place fails if it exists, so of two writers that
began at the same version one commits and the other is told; see ``replace``.  The
number of entries that a reader lists is bounded by compact(), which writes what is
current as one segment."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.operators import documents, page_plan
from leafwork.schemas import STORED
from leafwork.sources.commit_log import CommitLog

PAGE = ["doc_id", "page"]


class Conflict(RuntimeError):
    """Another writer committed the version that this one meant to make."""


class PageStore:
    """Pages below ``root``, a folder of any file system that Spark reaches.

    buckets: how many parts each segment's tables have, fixed by the first writer.  On a
    file system without a rename that refuses to replace, writers must take turns."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/_log")
        self.log.put("settings.json", {"buckets": buckets})
        self.buckets = self.log.get("settings.json")["buckets"]
        self.database = "pages_" + hashlib.md5(self.root.encode()).hexdigest()[:16]
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
        for name, ddl in STORED.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.database}.{name} ({ddl}, segment string) USING parquet PARTITIONED BY (segment) CLUSTERED BY (doc_id, page) SORTED BY (doc_id, page) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'")

    # ------------------------------------------------------------------- reading
    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return self.log.last()

    def segments(self, version: int | None = None) -> list[str]:
        """The segments of a version: those of the entries since the last compaction before it."""
        out: list[str] = []
        for n in range(self.version() if version is None else version, 0, -1):
            entry = self.log.entry(n)
            out.append(entry["segment"])
            if entry["kind"] == "compact":
                break
        return out[::-1]

    def _rows(self, name: str, segments: list[str]) -> DataFrame:
        table = f"{self.database}.{name}"
        for s in segments:  # those of other sessions; known ones cost nothing
            if s not in self._known.setdefault(name, set()):
                self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (segment = '{s}') LOCATION '{self.root}/{name}/segment={s}'")
                self._known[name].add(s)
        return self.spark.table(table).where(F.col("segment").isin(segments) if segments else F.lit(False)).drop("segment")

    @property
    def _known(self) -> dict[str, set[str]]:
        return self.__dict__.setdefault("_seen", {})

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, by default the last one."""
        segments = self.segments(version)
        last = self._rows("pages", segments).groupBy(*PAGE).agg(F.max("version").alias("_v"), F.max_by("is_deleted", "version").alias("_gone")).where("not _gone").drop("_gone")
        # the page alone is the key, so that bucketed sides meet as they lie; of its versions none is higher than the last
        return self._rows(name, segments).join(last, PAGE).where(F.col("version") >= F.col("_v")).drop("_v")

    def trees(self, version: int | None = None) -> DataFrame:
        """The nested tree of each page; no stored table is shuffled."""
        v = self.version() if version is None else version
        return page_plan.page_trees(self.read("pages", v), self.read("blocks", v), self.read("cells", v))

    def pending(self, pages: DataFrame, config: str) -> DataFrame:
        """Those of pages (doc_id, page) that have no results under this configuration."""
        done = self.read("pages").where(F.col("config_hash") == config).select(*PAGE)
        return pages.join(done, PAGE, "left_anti")

    # ------------------------------------------------------------------- writing
    def replace(self, pages: DataFrame, expected: int | None = None, attempts: int = 5, **results: DataFrame) -> int:
        """Replaces all results of pages (doc_id, page, page_width, page_height, config_hash)
        by words, blocks, tables and cells, each with doc_id and page; returns the version.
        What is not given is empty.  A page's means of confidence follow from what is given.

        expected: the version that the results were derived from; if another writer has
        committed since, Conflict is raised and nothing changes.  Without it, the commit
        is tried again as the next version, so the last writer of a page wins."""
        unknown = set(results) - set(STORED)
        if unknown:
            raise ValueError(f"unknown results: {sorted(unknown)}")
        empty = {n: self.spark.createDataFrame([], STORED[n]) for n in STORED if n != "pages" and n not in results}
        rows = {"pages": documents.page_averages(pages, *[results.get(n, empty.get(n)) for n in ("words", "blocks", "tables")], PAGE), **results, **empty}
        return self._commit(rows, "replace", expected, attempts)

    def remove(self, pages: DataFrame) -> int:
        """Pages go with all their results."""
        gone = pages.select(*PAGE).distinct().withColumn("is_deleted", F.lit(True))
        return self._commit({"pages": gone}, "replace", None, 5)

    def edit_cells(self, patches: DataFrame) -> int:
        """Cells by (doc_id, page, table_no, row, column) get what patches give: text,
        align_h, align_v, rowspan, colspan, each or null, of several the last by ordinal."""
        key = [*PAGE, "table_no", "row", "column"]
        return self._edit("cells", patches, key, lambda df, p: documents.edit_cells(df, p))

    def edit_blocks(self, patches: DataFrame) -> int:
        """Blocks by (doc_id, page, z_order) get a text or alignment, of several the last by ordinal."""
        return self._edit("blocks", patches, [*PAGE, "z_order"], documents.edit_elements)

    def _edit(self, name: str, patches: DataFrame, key: list[str], change) -> int:
        """The pages of patches are replaced with one table's rows changed, unless another writer was faster."""
        v = self.version()
        touched = patches.select(*PAGE).distinct()
        rows = {n: self.read(n, v).join(touched, PAGE, "left_semi") for n in STORED}
        ident = F.concat_ws(":", *key)
        rows[name] = change(rows[name].withColumn("cell_id", ident), patches.withColumn("cell_id", ident)).drop("cell_id")
        return self._commit(rows, "replace", v, 1)

    def compact(self) -> int:
        """Writes what is current as one segment, with the versions of its pages; segments
        before it are read by no later version and are deleted by vacuum()."""
        v = self.version()
        return self._commit({n: self.read(n, v) for n in STORED}, "compact", v, 1)

    def vacuum(self) -> int:
        """Deletes segments that the last version does not read; for when no writer and no older reader is at work."""
        live, gone = set(self.segments()), 0
        for name in STORED:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            for s in self.log.fs.listStatus(folder) if self.log.fs.exists(folder) else []:
                segment = s.getPath().getName().removeprefix("segment=")
                if s.isDirectory() and segment not in live and not segment.startswith("_"):
                    self.spark.sql(f"ALTER TABLE {self.database}.{name} DROP IF EXISTS PARTITION (segment = '{segment}')")
                    self.log.fs.delete(s.getPath(), True)
                    self._known.get(name, set()).discard(segment)
                    gone += 1
        return gone

    def _commit(self, rows: dict[str, DataFrame], kind: str, expected: int | None, attempts: int) -> int:
        for _ in range(attempts):
            n = self.version() + 1
            if expected is not None and n != expected + 1:
                raise Conflict(f"version {expected} is no longer the last one")
            segment = f"{n:010d}-{uuid.uuid4().hex[:12]}"
            for name, df in rows.items():
                self._write(name, df, segment, None if kind == "compact" else n)
            if self.log.commit(n, {"segment": segment, "kind": kind}):
                return n
        raise Conflict(f"another writer made version {n}")

    def _write(self, name: str, df: DataFrame, segment: str, version: int | None) -> None:
        """One file a bucket, in order of the page, in a segment of its own."""
        like = self.spark.createDataFrame([], STORED[name]).schema
        values = [F.lit(version).cast("long").alias(f.name) if f.name == "version" and version else (F.col(f.name) if f.name in df.columns else F.lit(False) if f.name in ("is_deleted", "is_edited") else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.fields]
        out = df.select(*values, F.lit(segment).alias("segment")).repartition(self.buckets, *PAGE)
        out.write.format("parquet").mode("append").partitionBy("segment").bucketBy(self.buckets, *PAGE).sortBy(*PAGE).saveAsTable(f"{self.database}.{name}")
        self._known.setdefault(name, set()).add(segment)
