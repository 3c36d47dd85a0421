"""One page as a whole: words, tables by priority, text blocks, rules and pictures
put together to elements in reading order, and the nested tree of a page.

Everything is keyed by (doc_id, page).  Inputs that are dealt by it, as word_boxes()
with ``by_page`` or a PageStore give them, are not dealt again: tables and cells are
gathered by page before they meet the page's other elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions import geometry as G
from leafwork.operators import layout, spatial

PAGE = ["doc_id", "page"]
BOX = ["x1", "y1", "x2", "y2"]
# How much of a rule a table covers that owns it, how much of a block or picture a picture covers
# that holds it, the most of a picture that words may cover, and the confidence of a rule.
OWN_RULE, HELD, MOST_TEXT, RULE_CONFIDENCE = 0.3, 0.6, 0.35, 0.7
#: The columns of elements besides the page.
ELEMENT = {"block_type": "string", "x1": "double", "y1": "double", "x2": "double", "y2": "double", "confidence": "double", "text": "string", "font": "double", "alignment": "string", "table_no": "int", "image_ref": "string"}


def _element(df: DataFrame, kind: Column, rank: int, order: str, **values: Column) -> DataFrame:
    """Rows as elements; what they lack is null.  rank and order part elements of equal place."""
    columns = [values.get(c, F.lit(None)).cast(t).alias(c) for c, t in (ELEMENT | {"block_type": "string"}).items() if c not in BOX and c != "block_type"]
    return df.select(*PAGE, kind.alias("block_type"), *[F.col(c).cast("double").alias(c) for c in BOX], *columns, F.lit(rank).alias("_rank"), F.col(order).cast("long").alias("_order"))


def kept_regions(regions: DataFrame, words: DataFrame, sizes: DataFrame, region: str) -> DataFrame:
    """Pictures among regions: those that words cover little, without those inside a larger
    one that stays, typed, and without stamps on pages with too many."""
    met = regions.join(spatial.region_words(words, regions, PAGE, region), [*PAGE, region], "left")
    met = met.where(F.coalesce("coverage", F.lit(0.0)) <= MOST_TEXT).join(sizes.select(*PAGE, "page_width", "page_height"), PAGE)
    typed = spatial.drop_excess_stamps(spatial.classify_graphics(met), PAGE)
    return largest_first(typed, region)


def largest_first(regions: DataFrame, region: str, share: float = HELD) -> DataFrame:
    """Regions, largest first, without those that a kept one covers by ``share``: a fold
    over the page's regions, which are few."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    row = F.struct((-area).alias("_a"), *[F.col(region).alias("_id")], F.struct(*regions.columns).alias("row"))
    covers = lambda a, b: G.overlap_of(_box(a["row"]), _box(b["row"])) >= share
    pages = regions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    none = F.slice("_rows", 1, 0)
    kept = F.aggregate("_rows", none, lambda acc, x: F.when(F.exists(acc, lambda k: covers(x, k)), acc).otherwise(F.array_append(acc, x)))
    return pages.select(F.explode(kept).alias("_k")).select("_k.row.*")


def _box(row: Column) -> G.Box:
    return G.Box(*[row[c] for c in BOX])


def elements(words: DataFrame, sizes: DataFrame, tables: list[DataFrame] = (), rules: DataFrame | None = None, regions: DataFrame | None = None, region: str = "r") -> DataFrame:
    """The elements of each page in reading order: (doc_id, page, z_order, block_type, box,
    confidence, text, font, alignment, table_no, image_ref).

    tables: detections (doc_id, page, table_no, box, confidence) by priority; those of a
    later one that overlap an earlier one's are dropped, and table_no must be unique on a
    page.  Words inside tables make no text blocks.  rules (block_type HLINE or VLINE, box):
    those of a table's own grid are dropped.  regions (box and ``region``): see
    kept_regions; text blocks inside a picture are dropped, as its pixels show them.
    Elements come by their top, then left edge; ties by kind, then number."""
    claimed = spatial.claimed(list(tables), PAGE) if tables else None
    boxes = claimed.select(*PAGE, *BOX) if claimed is not None else None
    free = words if boxes is None else spatial.words_outside(words, boxes, PAGE)
    blocks = layout.classify_blocks(layout.text_blocks(free), sizes)
    parts = []
    if regions is not None:
        kept = kept_regions(regions if boxes is None else spatial.not_covered(regions, boxes, PAGE, OWN_RULE), words, sizes, region)
        blocks = spatial.page_join(blocks, kept.select(*PAGE, *BOX), PAGE, lambda a, b: G.overlap_of(a, b) >= HELD, "left_anti")
        ref = F.concat_ws("-", F.lit("picture"), *[F.col(c).cast("string") for c in (*PAGE, region)])
        parts.append(_element(kept, F.col("block_type"), 3, region, confidence=F.lit(0.6), image_ref=ref))
    parts.append(_element(blocks, F.col("block_type"), 0, "block", confidence=F.col("type_confidence"), text=F.col("text"), font=F.col("font"), alignment=F.col("alignment")))
    if claimed is not None:
        parts.append(_element(claimed, F.lit("TABLE"), 1, "table_no", confidence=F.col("confidence"), table_no=F.col("table_no")))
    if rules is not None:
        own = rules if boxes is None else spatial.not_covered(rules, boxes, PAGE, OWN_RULE)
        parts.append(_element(own.withColumn("_y", F.round("y1")), F.col("block_type"), 2, "_y", confidence=F.lit(RULE_CONFIDENCE)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy(*PAGE).orderBy("y1", "x1", "_rank", "_order")
    return every.withColumn("z_order", (F.row_number().over(order) - 1).cast("int")).select(*PAGE, "z_order", *ELEMENT)


def table_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, page, tables): a page's tables by number, each with its rows of cells in order."""
    optional = {"rowspan": F.lit(1), "colspan": F.lit(1), "align_h": F.when(F.col("row") == 0, "CENTER").otherwise("LEFT"), "align_v": F.lit("MIDDLE"), "is_header": F.col("row") == 0, "is_edited": F.lit(False)}
    value = lambda c: F.coalesce(c, optional[c]) if c in cells.columns else optional[c]
    cell = F.struct("column", "row", *[value(c).alias(c) for c in ("rowspan", "colspan")], "text", F.struct(*[F.col(c).cast("double").alias(c) for c in BOX]).alias("bbox"), *[value(c).alias(c) for c in ("align_h", "align_v")], "confidence", *[value(c).alias(c) for c in ("is_header", "is_edited")])
    rows = cells.groupBy(*PAGE, "table_no", "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    tables = rows.groupBy(*PAGE, "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: F.struct(r["cells"].alias("cells"))).alias("rows"), F.count("*").cast("int").alias("n_rows"), (F.array_max(F.flatten(F.collect_list(F.transform("cells", lambda c: c["column"])))) + 1).alias("n_columns"))
    return tables.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("table_no", "n_rows", "n_columns", "rows"))).alias("tables"))


def page_trees(pages: DataFrame, blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """The tree of each page: (doc_id, page, page_width, page_height, blocks); each block
    with its pixel and normalised box, its text run or its table's rows, and its style.

    A page without elements has an empty list.  An edited text counts before the one that
    was read.  All joins are by page only, so tables bucketed by it meet without a shuffle."""
    listed = cells.withColumn("text", F.coalesce("edited_text", "text")) if "edited_text" in cells.columns else cells
    text = F.coalesce("edited_text", "text") if "edited_text" in blocks.columns else F.col("text")
    block = F.struct("z_order", F.col("block_type").alias("type"), *BOX, "confidence", text.alias("text"), "font", "alignment", "table_no", "image_ref")
    lists = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(block)).alias("_blocks"))
    met = pages.select(*PAGE, "page_width", "page_height").join(lists, PAGE, "left").join(table_rows(listed), PAGE, "left")

    def built(b: Column) -> Column:
        own = _box(b)
        table = F.get(F.filter("tables", lambda t: t["table_no"] == b["table_no"]), F.lit(0))
        run = F.struct(b["text"].alias("text"), b["font"].alias("font_size"), b["confidence"].alias("confidence"))
        none = F.slice(F.array(run), 1, 0)
        return F.struct(b["z_order"].alias("z_order"), b["type"].alias("type"), own.struct().alias("bbox"), G.to_norm(own, F.col("page_width"), F.col("page_height")).struct().alias("bbox_norm"), b["confidence"].alias("confidence"), F.when(b["text"].isNotNull() & (b["text"] != ""), F.array(run)).otherwise(none).alias("content"), F.when(b["type"] == "TABLE", table).alias("table"), b["image_ref"].alias("image_ref"), b["alignment"].alias("alignment"))

    none = F.slice(F.transform("_blocks", built), 1, 0)
    return met.select(*PAGE, "page_width", "page_height", F.coalesce(F.transform("_blocks", built), none, F.array()).alias("blocks"))
