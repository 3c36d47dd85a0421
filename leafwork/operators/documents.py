"""Documents and the results of their pages: creation, replacement and edits.

Children of a page are replaced as a whole, by anti joins on the page, so a page
that is processed again has one set of results.  A page's tree is derived from its
blocks, tables and cells, so an edit of those needs no patch of the tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import content_hash, sanitize_filename


def create(uploads: DataFrame, documents: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, jobs, duplicates) of uploads (document_id, filename, content,
    page_count, reject_reason or null, force).

    New documents are queued with one job each.  Content that a document holds, or
    an earlier upload of this run, is not made again unless forced: duplicates has
    the upload's document_id and existing_id.  Rejected uploads make nothing."""
    u = uploads.where("reject_reason is null").withColumn("document_hash", content_hash(F.col("content")))
    held = documents.where(~F.col("is_deleted")).groupBy("document_hash").agg(F.min("document_id").alias("_held"))
    u = u.join(held, "document_hash", "left")
    first = F.min("document_id").over(Window.partitionBy("document_hash"))
    same = F.coalesce("_held", F.when(first != F.col("document_id"), first))
    u = u.withColumn("_same", F.when(~F.coalesce("force", F.lit(False)), same))
    new = u.where("_same is null")
    name = sanitize_filename(F.col("filename"))
    made = new.select("document_id", name.alias("original_filename"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("file_extension"), F.length("content").cast("long").alias("file_size_bytes"), "page_count", F.lit("QUEUED").alias("status"), F.concat(F.lit("original/"), F.col("document_id").cast("string"), F.lit("/"), name).alias("storage_original_path"), "document_hash", F.lit(False).alias("is_deleted"), now.alias("created_at"))
    jobs = new.select(F.concat(F.lit("job-"), F.col("document_id").cast("string")).alias("job_id"), "document_id", F.lit("QUEUED").alias("status"), F.lit("UPLOAD").alias("stage"), F.lit(0).alias("progress_percent"), now.alias("created_at"))
    return made, jobs, u.where("_same is not null").select("document_id", F.col("_same").alias("existing_id"))


def replace_children(table: DataFrame, rows: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The table without what it has of the pages (keys), and with rows."""
    return table.join(pages.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_cells_of(cells: DataFrame, tables: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The cells but those whose table is on one of the pages."""
    gone = tables.join(pages.select(*keys).distinct(), keys, "left_semi").select("table_id")
    return cells.join(gone, "table_id", "left_anti")


def page_averages(pages: DataFrame, words: DataFrame, blocks: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """The pages with the mean confidence of their words, blocks and tables, null without any."""
    out = pages
    for df, name in ((words, "ocr_confidence_avg"), (blocks, "layout_confidence_avg"), (tables, "table_confidence_avg")):
        out = out.drop(name).join(df.groupBy(*keys).agg(F.avg("confidence").alias(name)), keys, "left")
    return out


def document_quality(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Means over a document's pages: of the words' confidence and of the similarity, where there is one."""
    return pages.groupBy(key).agg(F.avg("ocr_confidence_avg").alias("confidence"), F.avg("visual_similarity_score").alias("similarity"), F.count("*").alias("pages"))


def low_confidence(words: DataFrame, below: float = 0.8) -> DataFrame:
    """Words to be looked at."""
    return words.where(F.col("confidence") < below)


def read_words(words: DataFrame) -> DataFrame:
    """Recognised words as later steps take them: a corrected text counts before the recognised one."""
    return words.withColumn("text", F.coalesce(F.nullif("corrected_text", F.lit("")), "text"))


def _patch(df: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with p_<column> of its patch, of several patches the last by ordinal."""
    last = patches.groupBy(key).agg(F.max_by(F.struct(*columns), "ordinal").alias("_p"))
    return df.join(last, key, "left")


def merge_maps(old: Column, new: Column) -> Column:
    """The entries of both maps; where both have a key, the new one's."""
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def edit_blocks(blocks: DataFrame, patches: DataFrame) -> DataFrame:
    """The blocks with patches (block_id, text or null, style or null, ordinal)."""
    met = _patch(blocks, patches, "block_id", ["text", "style"])
    text = F.col("_p.text")
    out = met.withColumns({"text": F.coalesce(text, "text"), "edited_text": F.coalesce(text, "edited_text"), "is_edited": F.col("is_edited") | text.isNotNull(), "style": merge_maps(F.col("style"), F.col("_p.style"))})
    return out.drop("_p")


def edit_cells(cells: DataFrame, patches: DataFrame) -> DataFrame:
    """The cells with patches (cell_id, ordinal, and text, align_h, align_v, rowspan, colspan, each or null)."""
    fields = ["text", "align_h", "align_v", "rowspan", "colspan"]
    met = _patch(cells, patches, "cell_id", fields)
    text = F.col("_p.text")
    values = {f: F.coalesce(F.col(f"_p.{f}"), F.col(f)) for f in fields} | {"edited_text": F.coalesce(text, "edited_text"), "is_edited": F.col("is_edited") | text.isNotNull()}
    return met.withColumns(values).drop("_p")


def edit_elements(blocks: DataFrame, patches: DataFrame, key: str = "cell_id") -> DataFrame:
    """Elements of pages with patches (key, ordinal, text, alignment, each or null)."""
    met = _patch(blocks, patches, key, ["text", "alignment"])
    text = F.col("_p.text")
    return met.withColumns({"edited_text": F.coalesce(text, "edited_text"), "is_edited": F.col("is_edited") | text.isNotNull(), "alignment": F.coalesce("_p.alignment", "alignment")}).drop("_p")


def table_trees(cells: DataFrame) -> DataFrame:
    """(table_id, rows): each table's cells by row, both in order."""
    cell = F.struct(*[c for c in ("column", "row", "rowspan", "colspan", "text", "align_h", "align_v", "confidence", "is_header", "is_edited") if c in cells.columns])
    by_row = cells.groupBy("table_id", "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return by_row.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: F.struct(r["cells"].alias("cells"))).alias("rows"))


def link_tables(blocks: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """(block_id, table_id): a table belongs to the block it names, else to the first
    table block of its page with an equal box."""
    b = blocks.where("type = 'table'")
    t = tables.select(*keys, "table_id", "layout_block_id", *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    direct = t.join(b.select("block_id"), F.col("layout_block_id") == F.col("block_id")).select("block_id", "table_id")
    rest = t.join(direct.select("table_id"), "table_id", "left_anti")
    same = reduce(lambda a, c: a & (F.col(c) == F.col(f"_{c}")), ("x1", "y1", "x2", "y2"), F.lit(True))
    boxed = rest.join(b.select(*keys, "block_id", "z_order", "x1", "y1", "x2", "y2"), keys).where(same)
    return direct.union(boxed.groupBy("table_id").agg(F.min_by("block_id", "z_order").alias("block_id")).select("block_id", "table_id"))


def resumable(pages: DataFrame, config: Column) -> DataFrame:
    """Pages that are done under this configuration and need no work: with a tree and an image."""
    return pages.where(F.col("document_json").isNotNull() & F.col("processed_image_path").isNotNull() & (F.col("config_hash") == config))


def config_hash(provider: Column, dpi: Column, profile: Column) -> Column:
    """What a page's results depend on besides its image."""
    return F.sha2(F.concat_ws("|", provider, dpi.cast("string"), profile), 256)


def geometry_unchanged(pages: DataFrame) -> Column:
    """Whether a page was neither turned, straightened nor resized."""
    same = (F.col("original_width") == F.col("width")) & (F.col("original_height") == F.col("height"))
    return (F.coalesce("rotation", F.lit(0.0)) == 0) & (F.coalesce("skew", F.lit(0.0)) == 0) & same


def quality_pass(pages: DataFrame, rendered: DataFrame, keys: list[str]) -> DataFrame:
    """The pages with how similar their image (PNG) and the one rendered again are; null
    where one is missing or the sizes differ."""
    from leafwork.sources.images import page_similarity

    met = pages.drop("visual_similarity_score").join(rendered.select(*keys, F.col("image").alias("_again")), keys, "left")
    return met.withColumn("visual_similarity_score", page_similarity(F.col("image"), F.col("_again"))["ssim"]).drop("_again")
