"""The engine as a whole: one object over a folder of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.functions.text import confidence_tier, needs_review
from leafwork.operators import bands, batches, edits, layout, page_plan, registers, service
from leafwork.session import cut
from leafwork.sources import office
from leafwork.sources.page_store import PageStore
from leafwork.sources.stores import Store

# Where files of a document are kept.
FOLDERS = ["original", "pages", "processed", "output"]


class Engine:
    """Reads and derives the tables of a corpus below ``root``, one Parquet folder each.

    Documents with a text are turned to words, lines, blocks and pages; each
    step is stored under its own name when process() ran it, and skipped for the
    documents that have it, so a run that broke off is taken up again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._store: PageStore | None = None

    def _exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str) -> DataFrame:
        if n := self._version(name):
            return self.spark.read.parquet(f"{self.root}/{name}@versions/{n:010d}")
        if not self._exists(name) and name in schemas.TABLES:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        return self.spark.read.parquet(f"{self.root}/{name}")

    def documents(self, status: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
        """A page of the documents, each row with the total of all pages."""
        d = self.table("documents").where(~F.col("is_deleted"))
        d = d.where(F.col("status") == status) if status else d
        total = d.agg(F.count("*").alias("total"))  # one row
        return service.page_of_results(d.join(F.broadcast(total)), [F.desc("created_at"), F.asc("id")], page, size)

    def regenerate(self, kind: str) -> DataFrame:
        """The exports of processed documents, from their stored blocks alone."""
        if kind not in ("DOCX", "PDF"):
            raise ValueError(f"unknown export {kind}")
        b = self.blocks()
        words = layout.fallback_words(b).withColumn("li", F.col("z_order"))
        sizes = b.select("doc_id", "page", "page_width", "page_height").distinct()
        return office.write_exports(b, words, sizes).where(F.col("export_type") == kind)

    def stats(self) -> DataFrame:
        busy = ["UPLOADED", "QUEUED", "PROCESSING"]
        return service.status_counts(self.table("documents").where(~F.col("is_deleted")), "status", {"processing": busy, "completed": ["COMPLETED"], "failed": ["FAILED"]})

    def find_by_hash(self, document_hash: str) -> DataFrame:
        return self.table("documents").where((F.col("document_hash") == document_hash) & ~F.col("is_deleted"))

    def process(self, texts: DataFrame) -> int:
        """Derives and stores the words and blocks of documents (doc_id, text) that were
        not processed yet, in one append each; returns how many were new.  Documents
        without a word are remembered as well, so they are not taken up again."""
        todo = texts
        if self._exists("processed"):
            todo = texts.join(self.spark.read.parquet(f"{self.root}/processed").select("doc_id"), "doc_id", "left_anti")
        n = todo.count()
        if n:
            words = layout.word_boxes(todo)
            layout.classify_blocks(layout.text_blocks(words), layout.page_sizes(words)).join(self._done(), "doc_id", "left_anti").write.mode("append").parquet(f"{self.root}/blocks")
            todo.select("doc_id").distinct().write.mode("append").parquet(f"{self.root}/processed")
            self.spark.catalog.refreshByPath(f"{self.root}/processed")
        return n

    def _done(self) -> DataFrame:
        """Documents whose blocks a run that broke off had stored."""
        if not self._exists("blocks"):
            return self.spark.createDataFrame([], "doc_id long")
        return self.spark.read.parquet(f"{self.root}/blocks").select("doc_id").distinct()

    def words(self, texts: DataFrame) -> DataFrame:
        """The words of documents with their boxes."""
        return layout.word_boxes(texts)

    def layout(self, doc_id: int | None = None, page: int | None = None) -> DataFrame:
        """Typed blocks, of one document or one page of it, in reading order."""
        b = self.blocks()
        for column, value in (("doc_id", doc_id), ("page", page)):
            b = b if value is None else b.where(F.col(column) == value)
        return b.orderBy("doc_id", "page", "z_order")

    def tables(self, texts: DataFrame) -> DataFrame:
        """Cells of the tables that aligned words make."""
        w = layout.word_boxes(texts)
        return bands.borderless_tables(w, layout.page_sizes(w))

    def export(self, texts: DataFrame, kind: str | None = None) -> DataFrame:
        """Files of documents, one row each (doc_id, export_type, content, size, error);
        of one kind (DOCX or PDF) if given."""
        if kind not in (None, "DOCX", "PDF"):
            raise ValueError(f"unknown export {kind}")
        w = layout.word_boxes(texts)
        sizes = layout.page_sizes(w)
        out = office.write_exports(layout.classify_blocks(layout.text_blocks(w), sizes), w, sizes)
        return out if kind is None else out.where(F.col("export_type") == kind)

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/blocks")

    def pages(self) -> DataFrame:
        return layout.page_ir(self.blocks())

    def quality(self, similarity: DataFrame | None = None) -> DataFrame:
        """Each document's mean confidence, its similarity (doc_id, similarity) to what is
        made of it where that is given, its tier and whether it needs a review."""
        q = self.blocks().groupBy("doc_id").agg(F.avg("confidence").alias("confidence"))
        like = similarity.groupBy("doc_id").agg(F.avg("similarity").alias("similarity")) if similarity is not None else None
        q = q.withColumn("similarity", F.lit(None).cast("double")) if like is None else q.join(like, "doc_id", "left")
        return q.select("doc_id", "confidence", "similarity", confidence_tier(F.col("confidence")).alias("tier"), needs_review(F.col("confidence"), F.col("similarity")).alias("needs_review"))

    @property
    def store(self) -> PageStore:
        """The versioned store of pages and their results."""
        if self._store is None:
            self._store = PageStore(self.spark, f"{self.root}/page_store")
        return self._store

    def process_pages(self, texts: DataFrame, config: str) -> int:
        """Derives words, tables, blocks and cells of the pages of documents (doc_id, text)
        that have none under this configuration, and replaces their results in one commit;
        returns how many pages that were.  A run that broke off is taken up by pages."""
        words = layout.word_boxes(texts, by_page=True)
        todo = self.store.pending(words.select("doc_id", "page").distinct(), config)
        todo = cut(todo, "pending-pages")
        n = todo.count()
        if n:
            words = cut(words.join(todo, ["doc_id", "page"], "left_semi"), "pending-words")
            sizes = layout.page_sizes(words)
            cells = cut(bands.borderless_tables(words, sizes), "pending-cells")
            hull = [f(c).alias(c) for c, f in (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max))]
            tables = cells.groupBy("doc_id", "page", "table_no").agg(*hull, F.max("table_confidence").alias("confidence")).withColumn("method", F.lit("words"))
            found = page_plan.elements(words, sizes, [tables])
            self.store.replace(sizes.withColumn("config_hash", F.lit(config)), words=words, blocks=found, tables=tables, cells=cells.drop("table_confidence"))
        return n

    def trees(self, version: int | None = None) -> DataFrame:
        """The nested tree of each page, as of a version of the store."""
        return self.store.trees(version)

    def edit_cells(self, patches: DataFrame) -> int:
        return self.store.edit_cells(patches)

    def edit_blocks(self, patches: DataFrame) -> int:
        return self.store.edit_blocks(patches)

    def edit_table(self, cells: DataFrame, operation: str, argument) -> DataFrame:
        return edits.edit(cells, operation, argument)

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows by key into a table.  The new version is a folder of its own; a table's
        last version is the highest that has a mark, and marks are made by a rename, so
        a reader sees one version or the next and never none.  The version before the
        last stays for readers that have begun; older ones are deleted."""
        out = service.keyed_upsert(self.table(name), rows, keys) if self._version(name) or self._exists(name) or name in schemas.TABLES else rows
        n = self._version(name) + 1
        base = f"{self.root}/{name}@versions"
        path = lambda p: self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        new = f"{base}/.{uuid.uuid4().hex}"
        out.write.parquet(new)
        if not fs.rename(path(new), path(f"{base}/{n:010d}")) or fs.exists(path(f"{base}/{n:010d}/{new.rsplit('/', 1)[1]}")):
            raise RuntimeError(f"another writer made version {n} of {name}")
        if n > 2:
            fs.delete(path(f"{base}/{n - 2:010d}"), True)

    def _version(self, name: str) -> int:
        """The last version that upsert() made of a table; 0 without any."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}@versions")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(f) for f in found if f.isdigit()), default=0)

    def delete(self, ids: list[str]) -> None:
        """Documents are marked as deleted, and their files go."""
        d = self.table("documents")
        self.upsert("documents", d.where(F.col("id").isin(ids)).withColumn("is_deleted", F.lit(True)), ["id"])
        store = Store(self.spark, self.root)
        for i in ids:
            for folder in FOLDERS:
                store.delete_prefix(f"{folder}/{i}")

    def register(self) -> DataFrame:
        return service.renumber(self.table("accession_records"), "accession_number")

    def records(self, page: int = 1, size: int = 50, year: int | None = None, month: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(page of the records, their total as one row)."""
        return registers.list_records(self.table("accession_records"), page, size, year, month)

    def batches(self) -> DataFrame:
        items = self.table("ocr_batch_items")
        rolled = service.batch_rollup(items, "batch_id", "state", {"completed", "duplicate"}, {"failed", "cancelled"}, "priority_score", "updated_at").drop("label")
        heads = self.table("ocr_batches").select(F.col("id").alias("batch_id"), "started_at")
        return batches.labels(heads, items).join(rolled, "batch_id", "left")
