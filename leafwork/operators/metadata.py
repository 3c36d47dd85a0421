"""A book's name, author, publisher, year, language and number, from its cover, the
typed blocks of its first pages and the name of its file.

One aggregate per document over candidates that are filtered first; nothing is
collected but the winners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import accession_number, creator_like, first_year, notes_text

TITLE_PAGES = 3
#: A paragraph that stands in for a title is cut to so many characters.
PARAGRAPH_CUT = 200


def _candidates(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("page") < TITLE_PAGES).withColumn("t", F.trim("text")).where("t <> ''")


def _first(value: Column, when: Column) -> Column:
    """The value of the first block in reading order for which ``when`` holds."""
    return F.min_by(value, F.when(when, F.struct("page", "z_order")))


def _book_name(over: Callable[[Column], Column]) -> Column:
    """(name, at) of a document's candidates, whose aggregates ``over`` takes."""
    rank = F.struct(-F.col("page"), F.length("t"), -F.col("z_order"))
    found = []
    for kind in ("TITLE", "HEADING", "PARAGRAPH"):
        text = F.substring("t", 1, PARAGRAPH_CUT) if kind == "PARAGRAPH" else F.col("t")
        found.append(F.max_by(F.struct(text.alias("name"), F.struct("page", "z_order").alias("at")), F.when(F.col("block_type") == kind, rank)))
    return F.coalesce(*map(over, found))


def book_names(blocks: DataFrame) -> DataFrame:
    """(doc_id, book_name, name_block): the longest title of the first page that has
    one, else heading, else paragraph, cut."""
    best = _book_name(lambda c: c)
    return _candidates(blocks).groupBy("doc_id").agg(best.alias("b")).select("doc_id", F.col("b.name").alias("book_name"), F.col("b.at").alias("name_block"))


# What is noted where something was not found.
NOTES = {
    "book_name": "book_name: no TITLE/HEADING/paragraph text found on the first pages; used the filename",
    "creator": "author/publisher: could not confidently identify an author or issuing-body line",
    "year": "year_of_publication: no plausible year found on the first pages",
    "language": "language: not enough OCR text to classify",
    "accession_number": "accession_number: not found in the filename or on the cover; auto-generated sequentially",
}


def book_metadata(blocks: DataFrame, files: DataFrame, covers: DataFrame | None = None, languages: DataFrame | None = None, prefix: str = "D") -> DataFrame:
    """One row for each file (doc_id, filename): book_name, author, publisher, creator,
    year, language, accession_number, needs_review and notes.

    What the cover says (title, author, publisher, year, lines_text) comes first.  A
    name is else that of the blocks, else the file's; a publisher else, without an
    author, the first other heading or line that looks like a creator; a year the
    first in the blocks; a number that of the file's name, else that of the cover's
    lines.  A missing name, author and publisher, year or language needs a review; a
    missing number does not, as one is generated.  languages: (doc_id, majority)."""
    # beside each candidate, so that blocks are made and dealt by document once
    best = _book_name(lambda c: c.over(Window.partitionBy("doc_id")))
    c = _candidates(blocks).withColumn("_best", best).withColumns({"book_name": F.col("_best.name"), "name_block": F.col("_best.at")})
    heading = F.col("block_type").isin("TITLE", "HEADING", "SUBHEADING") & F.coalesce(F.struct("page", "z_order") != F.col("name_block"), F.lit(True))
    line = (F.col("block_type") == "PARAGRAPH") & creator_like(F.col("t"))
    year = first_year(F.col("t"))
    found = c.groupBy("doc_id").agg(F.first("book_name").alias("_name"), F.coalesce(_first(F.col("t"), heading), _first(F.col("t"), line)).alias("_line"), _first(year, year.isNotNull()).alias("_year"))
    out = files.select("doc_id", "filename").join(found, "doc_id", "left")
    none = F.lit(None).cast("string")
    if covers is None:
        out = out.withColumns({x: none for x in ("title", "author", "_publisher", "_cover_year", "lines_text")})
    else:
        out = out.join(covers.select("doc_id", "title", "author", F.col("publisher").alias("_publisher"), F.col("year").alias("_cover_year"), "lines_text"), "doc_id", "left")
    out = out.join(languages.select("doc_id", F.col("majority").alias("language")), "doc_id", "left") if languages is not None else out.withColumn("language", none)
    name = F.coalesce("title", "_name")
    publisher = F.when(F.col("author").isNull() & F.col("_publisher").isNull(), F.col("_line")).otherwise(F.col("_publisher"))
    number = F.coalesce(accession_number(F.col("filename"), prefix), accession_number(F.col("lines_text"), prefix))
    out = out.select("doc_id", "filename", name.alias("_found"), "author", publisher.alias("publisher"), F.coalesce("_cover_year", "_year").alias("year"), "language", number.alias("accession_number"))
    missing = {"book_name": F.col("_found").isNull(), "creator": F.col("author").isNull() & F.col("publisher").isNull(), "year": F.col("year").isNull(), "language": F.col("language").isNull(), "accession_number": F.col("accession_number").isNull()}
    notes = F.array_compact(F.array(*[F.when(v, NOTES[k]) for k, v in missing.items()]))
    review = missing["book_name"] | missing["creator"] | missing["year"] | missing["language"]
    out = out.withColumn("needs_review", review).withColumn("notes", notes_text(notes))
    return out.select("doc_id", F.coalesce("_found", "filename").alias("book_name"), "author", "publisher", F.coalesce("author", "publisher").alias("creator"), "year", "language", "accession_number", "needs_review", "notes")
