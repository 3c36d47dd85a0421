"""Tables with ruling lines: from the pixels of a page and its words to cells.

The image and the words of a page meet in one task; what comes back are rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.operators import spatial
from leafwork.operators.folds import supplement_bounds, text_column_bounds, text_row_bounds
from leafwork.session import ship
from leafwork.sources.images import box_mean, components, decode_png, grid_mask, otsu, projection_boundaries, runs_mask, to_gray

# Ink that makes a separator, cells of a grid at most, share of cells that must hold text.
LINE_SHARE, LINE_BAND, MOST_CELLS, LEAST_FILLED = 0.11, 3, 2000, 0.35
#: Shares of a page's area between which a blot is a picture.
LEAST_AREA, MOST_AREA = 0.002, 0.35


def line_present(mask: np.ndarray, at: int, start: int, stop: int, upright: bool) -> bool:
    """Whether ink of a separator at a position covers enough of its span."""
    m = mask if upright else mask.T
    part = m[max(0, start) : max(0, stop), max(0, at - LINE_BAND) : at + LINE_BAND]
    return bool(part.size) and float(part.mean()) >= LINE_SHARE


def _joined(n_rows: int, n_columns: int, right: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The smallest cell of each cell's component, where right and below say which neighbours have no wall."""
    label = np.arange(n_rows * n_columns).reshape(n_rows, n_columns)
    while True:
        new = label.copy()
        for a, b, open_ in ((np.s_[:, :-1], np.s_[:, 1:], right), (np.s_[:-1, :], np.s_[1:, :], below)):
            least = np.minimum(new[a], new[b])
            new[a] = np.where(open_, least, new[a])
            new[b] = np.where(open_, np.minimum(least, new[b]), new[b])
        if (new == label).all():
            return label
        label = new


def table_structure(gray: np.ndarray, box: tuple[float, float, float, float], words: pd.DataFrame) -> pd.DataFrame | None:
    """The cells of a ruled region, or None where it is no table: lines give the
    boundaries, words those that no line rules; cells are joined where the line
    between them is missing; a grid that is mostly empty is none."""
    x1, y1, x2, y2 = (int(v) for v in box)
    crop = gray[y1:y2, x1:x2]
    if not crop.size:
        return None
    h, w = crop.shape
    ink = crop <= otsu(crop)
    across, down = runs_mask(ink, max(15, w // 15), 1), runs_mask(ink, max(15, h // 15), 0)
    cx, cy = (words.x1 + words.x2) / 2, (words.y1 + words.y2) / 2
    inside = words[cx.between(x1, x2) & cy.between(y1, y2)]
    inside = inside.assign(wi=range(len(inside)))
    rows, loose_rows = supplement_bounds(projection_boundaries(across, 1), text_row_bounds(inside, y1, h))
    columns, loose_columns = supplement_bounds(projection_boundaries(down, 0), text_column_bounds(inside, x1, w))
    n, m = len(rows) - 1, len(columns) - 1
    if n < 1 or m < 1 or n * m > MOST_CELLS:
        return None
    right = np.array([[columns[c + 1] not in loose_columns and not line_present(down, columns[c + 1], rows[r], rows[r + 1], True) for c in range(m - 1)] for r in range(n)], bool).reshape(n, m - 1)
    below = np.array([[rows[r + 1] not in loose_rows and not line_present(across, rows[r + 1], columns[c], columns[c + 1], False) for c in range(m)] for r in range(n - 1)], bool).reshape(n - 1, m)
    label, out = _joined(n, m, right, below), []
    for v in np.unique(label):
        r, c = np.nonzero(label == v)
        cell = (x1 + columns[c.min()], y1 + rows[r.min()], x1 + columns[c.max() + 1], y1 + rows[r.max() + 1])
        own = inside[((inside.x1 + inside.x2) / 2).between(cell[0], cell[2]) & ((inside.y1 + inside.y2) / 2).between(cell[1], cell[3])]
        own = own.assign(_y=(own.y1 / 8).round()).sort_values(["_y", "x1"], kind="stable")
        out.append((int(r.min()), int(c.min()), int(np.ptp(r)) + 1, int(np.ptp(c)) + 1, " ".join(own.text).strip(), float(own.confidence.mean()) if len(own) else 0.0, *map(float, cell), bool(r.min() == 0)))
    cells = pd.DataFrame(out, columns=["row", "column", "rowspan", "colspan", "text", "confidence", "x1", "y1", "x2", "y2", "is_header"])
    if (cells.text != "").mean() < LEAST_FILLED:
        return None
    sure = cells.confidence[cells.confidence > 0]
    return cells.assign(table_confidence=float(sure.mean()) if len(sure) else 0.5)


def page_tables(gray: np.ndarray, words: pd.DataFrame) -> list[pd.DataFrame]:
    """The cells of each ruled table of a page."""
    h, w = gray.shape
    regions = [c for c in components(grid_mask(gray)) if c[2] - c[0] >= 0.15 * w and c[3] - c[1] >= 0.03 * h and c[4] >= 200]
    found = (table_structure(gray, c[:4], words) for c in regions)
    return [t for t in found if t is not None]


CELL_FIELDS = "doc_id long, page int, table_no int, row int, column int, rowspan int, colspan int, text string, confidence double, x1 double, y1 double, x2 double, y2 double, is_header boolean, table_confidence double"


def ruled_tables(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Cells of the ruled tables of pages (doc_id, page, image as PNG) with words (boxes and confidence)."""
    names = [f.split()[0] for f in CELL_FIELDS.split(", ")]

    def page(key, image: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in image.image:
            if data is not None:
                out += [t.assign(doc_id=key[0], page=key[1], table_no=i) for i, t in enumerate(page_tables(to_gray(decode_png(data)), own))]
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    ship(pages.sparkSession)
    w = words.select("doc_id", "page", "text", "x1", "y1", "x2", "y2", "confidence")
    return pages.select("doc_id", "page", "image").groupBy("doc_id", "page").cogroup(w.groupBy("doc_id", "page")).applyInPandas(page, CELL_FIELDS)


def structure_model(pages: DataFrame, predict) -> DataFrame:
    """Cells that a table model finds, as a plug-in: predict(grey image) gives HTML
    tables with their boxes as (x1, y1, x2, y2, html); a cell's confidence is 0.8."""
    from leafwork.sources.html_tables import grid

    names = ["doc_id", "page", "table_no", "row", "column", "rowspan", "colspan", "text", "confidence"]

    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, page, data in zip(pdf.doc_id, pdf.page, pdf.image, strict=True):
                for i, (*_, html) in enumerate(predict(to_gray(decode_png(data)))):
                    out += [(doc_id, page, i, r, c, h, w, t, 0.8) for _, r, c, h, w, t in grid(html)]
            yield pd.DataFrame(out, columns=names)

    ship(pages.sparkSession)
    return pages.select("doc_id", "page", "image").mapInPandas(run, "doc_id long, page int, table_no int, row int, column int, rowspan int, colspan int, text string, confidence double")


# ------------------------------------------------------------------ pictures
def _around(mask: np.ndarray, every: bool) -> np.ndarray:
    """Each pixel with its four neighbours: whether all, or any, are set."""
    p = np.pad(mask, 1, constant_values=every)
    parts = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
    return np.logical_and.reduce(parts) if every else np.logical_or.reduce(parts)


def blots(gray: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Boxes of solid ink: strokes are opened away, the rest grows together."""
    ink = gray <= otsu(gray)
    solid = _around(_around(ink, True), False)
    grown = box_mean(np.pad(solid, 8).astype(float), 17)[8:-8, 8:-8] > 1e-9
    area = gray.size
    return [c for c in components(grown) if LEAST_AREA <= c[4] / area <= MOST_AREA]


def _blots(png: pd.Series) -> pd.Series:
    names = ("x1", "y1", "x2", "y2", "pixels")
    return pd.Series([[] if d is None else [dict(zip(names, c, strict=True)) for c in blots(to_gray(decode_png(d)))] for d in png])


def graphic_regions(pages: DataFrame, words: DataFrame, excluded: DataFrame) -> DataFrame:
    """Typed pictures of pages (doc_id, page, image, page_width, page_height): blots of
    which excluded boxes cover half at most and words 35 %; pages with too many
    stamps keep none of them."""
    ship(pages.sparkSession)
    keys = ["doc_id", "page"]
    find = F.pandas_udf(_blots, "array<struct<x1:int,y1:int,x2:int,y2:int,pixels:int>>")
    r = pages.select(*keys, "page_width", "page_height", F.posexplode(find("image")).alias("region", "b")).select(*keys, "page_width", "page_height", "region", *[F.col(f"b.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    r = spatial.not_covered(r, excluded.select(*keys, "x1", "y1", "x2", "y2"), keys, 0.5)
    met = spatial.region_words(words.select(*keys, "x1", "y1", "x2", "y2", "confidence"), r.select(*keys, "region", "x1", "y1", "x2", "y2"), keys, "region")
    r = r.join(met, [*keys, "region"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).where("coverage <= 0.35")
    return spatial.drop_excess_stamps(spatial.classify_graphics(r), keys)


def _crop(png: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    from leafwork.sources.images import encode_png

    out = []
    for d, *box in zip(png, x1, y1, x2, y2, strict=True):
        image = None if d is None else decode_png(d)
        if image is not None:
            h, w = image.shape[:2]
            a, b, c, e = (int(min(max(0, v), most)) for v, most in zip(box, (w, h, w, h), strict=True))
            image = image[b:e, a:c]
        out.append(None if image is None or not image.size else encode_png(image))
    return pd.Series(out)


def crop_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Graphic blocks (doc_id, page, z_order, box) with crop, the PNG of their box within
    the page; the original scan's if geometry_unchanged says that it fits, else the
    processed image's."""
    ship(blocks.sparkSession)
    crop = F.pandas_udf(_crop, "binary")
    image = F.when(F.col("geometry_unchanged"), F.coalesce("original", "image")).otherwise(F.col("image"))
    met = blocks.where(F.col("block_type").isin("IMAGE", "CHART", "SIGNATURE", "STAMP", "HANDWRITTEN")).join(pages.select("doc_id", "page", image.alias("_image")), ["doc_id", "page"])
    return met.withColumn("crop", crop("_image", "x1", "y1", "x2", "y2")).drop("_image")
