"""The bibliographic register: records by document, their numbers and its rows.

A record has document_id, accession_number, record_date and what was read from the
book.  Numbers of one run are dealt out in a stated order; the numbers that exist
are looked up by joins, never collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import accession_number, notes_text
from leafwork.operators.changes import changed_keys
from leafwork.operators.service import latest_per_key, next_numbers, renumber

#: What a document's reading gives, besides its number.
READ = ["book_name", "creator", "author", "publisher", "language", "year_of_publication", "total_pages", "needs_review"]
# The columns of the register's sheet, in order, and those of records that they show; the note on a number that is taken.
HEADERS = ["S.No", "Book Name", "Accession Number", "Author Name", "Publisher Name", "Pages", "Language"]
NAMES = {"book_name": "Book Name", "accession_number": "Accession Number", "author": "Author Name", "publisher": "Publisher Name", "total_pages": "Pages", "language": "Language"}
TAKEN = ("accession_number: extracted '", "' is already assigned to another document; generated a new one instead")


def upsert_records(records: DataFrame, read: DataFrame, today: Column, prefix: str = "D", begin: int = 1) -> DataFrame:
    """The records with those of read (document_id, accession_number or null, notes
    array, and READ) added or updated by document.

    A number once given stays.  A new record gets the number that was read unless
    another record has it, or a document that comes before it in this run; it then
    gets the next free number, and a note.  Documents come in order of document_id."""
    values = [c for c in READ if c in read.columns]
    own = records.select("document_id", F.lit(True).alias("_has"))
    met = read.join(own, "document_id", "left")
    updates = met.where("_has").select("document_id", *[F.col(c).alias(f"_n_{c}") for c in values], notes_text(F.col("notes")).alias("_n_notes"), F.lit(True).alias("_up"))
    old = records.join(updates, "document_id", "left")
    for c in values:
        old = old.withColumn(c, F.when(F.col("_up"), F.col(f"_n_{c}")).otherwise(F.col(c)))
    old = old.withColumn("extraction_notes", F.when(F.col("_up"), F.col("_n_notes")).otherwise(F.col("extraction_notes"))).select(*records.columns)

    new = met.where("_has is null").drop("_has").withColumn("accession_number", F.nullif("accession_number", F.lit("")))
    taken = records.select("accession_number", F.lit(True).alias("_taken")).distinct()
    new = new.join(taken, "accession_number", "left")
    first = F.row_number().over(Window.partitionBy("accession_number").orderBy("document_id")) == 1
    free = F.col("accession_number").isNotNull() & F.col("_taken").isNull() & first
    new = new.withColumn("_free", free)
    note = F.concat(F.lit(TAKEN[0]), "accession_number", F.lit(TAKEN[1]))
    clash = ~F.col("_free") & F.col("accession_number").isNotNull()
    new = new.withColumn("notes", F.when(clash, F.array_append("notes", note)).otherwise(F.col("notes")))
    keep = new.where("_free")
    used = records.select("accession_number").union(keep.select("accession_number"))
    dealt = next_numbers(new.where("not _free"), used, "accession_number", prefix, begin, [F.asc("document_id")])
    fresh = keep.select(*dealt.columns).union(dealt).withColumn("extraction_notes", notes_text(F.col("notes"))).withColumn("record_date", today)
    missing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema.fields if f.name not in fresh.columns}
    return old.unionByName(fresh.select(*[missing.get(c, F.col(c)) for c in records.columns]))


def backfill_numbers(records: DataFrame, documents: DataFrame, prefix: str = "D") -> DataFrame:
    """The records with outcome: updated, with the number of the file's name;
    skipped_taken if another record has it or gets it in this run; unchanged; or
    no_document.  Records come in order of document_id."""
    found = documents.select("document_id", accession_number(F.col("original_filename"), prefix).alias("_found"), F.lit(True).alias("_there"))
    met = records.join(found, "document_id", "left").withColumn("_want", F.when(F.col("_found") != F.col("accession_number"), F.col("_found")))
    held = records.select(F.col("accession_number").alias("_want"), F.lit(True).alias("_held")).distinct()
    met = met.join(held, "_want", "left")
    free = F.col("_want").isNotNull() & F.col("_held").isNull()
    wins = F.row_number().over(Window.partitionBy("_want").orderBy("document_id")) == 1
    met = met.withColumn("_wins", free & wins)
    outcome = F.when(F.col("_there").isNull(), "no_document").when(F.col("_want").isNull(), "unchanged").when(F.col("_wins"), "updated").otherwise("skipped_taken")
    number = F.when(F.col("_wins"), F.col("_want")).otherwise(F.col("accession_number"))
    return met.withColumn("outcome", outcome).withColumn("accession_number", number).select(*records.columns, "outcome")


def listed(records: DataFrame, documents: DataFrame, jobs: DataFrame, exports: DataFrame) -> DataFrame:
    """document_id and what the register shows of records whose document exists, whose
    last job is COMPLETED and that have a searchable PDF."""
    last = latest_per_key(jobs.select("document_id", "status", "created_at", "job_id"), ["document_id"], [F.desc("created_at"), F.desc("job_id")]).where("status = 'COMPLETED'")
    there = documents.where(~F.col("is_deleted")).select("document_id")
    searchable = exports.where("export_type = 'SEARCHABLE_PDF'").select("document_id")
    out = records
    for side in (there, last, searchable):
        out = out.join(side.select("document_id"), "document_id", "left_semi")
    return out.select("document_id", *NAMES)


def register_rows(records: DataFrame, documents: DataFrame, jobs: DataFrame, exports: DataFrame, numeric: bool = False) -> DataFrame:
    """The whole register anew: the listed records, numbered in order of their number."""
    return sheet(listed(records, documents, jobs, exports), numeric)


def sheet(rows: DataFrame, numeric: bool = False) -> DataFrame:
    """Listed records as the register's sheet has them."""
    return renumber(rows.select(*NAMES), "accession_number", numeric).withColumnsRenamed(NAMES | {"serial": "S.No"}).select(*[f"`{h}`" for h in HEADERS])


def refresh_listed(old: DataFrame, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(the listed records after, the document_ids that were looked at again) from those
    before and two versions of each table (records, documents, jobs, exports).

    Only documents with a row that was added, changed or gone in any table are listed
    anew; the listed rows of all others are taken over.  The result is that of listed()."""
    keys = {"records": ["document_id"], "documents": ["document_id"], "jobs": ["document_id", "job_id"], "exports": ["document_id", "export_type"]}
    touched = None
    for name, key in keys.items():
        ids = changed_keys(before[name], after[name], key).select("document_id")
        touched = ids if touched is None else touched.union(ids)
    touched = touched.distinct()
    again = listed(*[after[n].join(touched, "document_id", "left_semi") for n in ("records", "documents", "jobs", "exports")])
    return old.join(touched, "document_id", "left_anti").unionByName(again), touched


def refresh(records: DataFrame, read: DataFrame, documents: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(records, summary): what was read anew from stored words of records that exist,
    then numbers from the files' names; summary has one row of counts."""
    again = read.join(records.select("document_id"), "document_id", "left_semi")
    out = backfill_numbers(upsert_records(records, again, today), documents)
    counts = out.agg(F.count_if(F.col("outcome") == "updated").alias("accession_numbers_updated"), F.count_if(F.col("outcome") == "skipped_taken").alias("skipped_taken"))
    return out.drop("outcome"), counts.crossJoin(again.agg(F.count("*").alias("documents_refreshed")))  # one row each


def header_matches(rows: DataFrame) -> bool:
    """Whether a stored register has the columns of this one, in order."""
    return rows.columns == HEADERS


def list_records(records: DataFrame, page: int = 1, size: int = 50, year: int | None = None, month: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(page of records, total as one row), by record_date and number, of a year and a month if given."""
    if year is not None:
        records = records.where(F.year("record_date") == year)
    if month is not None:
        records = records.where(F.month("record_date") == month)
    return records.orderBy("record_date", "accession_number").offset((page - 1) * size).limit(size), records.agg(F.count("*").alias("total"))
