"""Spatial joins of boxes that share a page.

The equi-key (document, page) comes first, so Catalyst hashes or sorts by it and
applies the box predicate to what meets.  For dense pages, grid_join() adds cells of
grids to the key, so no task compares all boxes of a page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions import geometry as G
#: The side of the smallest cells; how much larger a page's further cells are than the last ones, and how many sizes it has.
CELL, STEP, SIZES = 16, 8, 3
BOX = ["x1", "y1", "x2", "y2"]


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], rule: Callable[[G.Box, G.Box], Column], how: str = "inner") -> DataFrame:
    """Joins boxes of the same keys that satisfy rule(left box, right box), which must
    imply that the boxes touch.  The right side's box columns get the prefix r_.

    A left box lies in one cell, that of its least corner, and is not copied.  A right box
    is listed in all cells where the corner of a box that touches it can be.  The cells of
    a page are as large as its right boxes are on the average, so those are listed nine
    times on the average at most.  Left boxes larger than these cells lie in a grid of
    larger ones, or, beyond the last one, in a cell for the whole page; right boxes are
    listed in all of them.  So each pair meets once, and left_semi and left_anti need no
    numbers and no second pass.

    Right boxes are hashed and left ones stream by, in the order in which they come.  Left
    ones outside of all that a page's right boxes span are not dealt, unless they are asked for."""
    if how not in {"inner", "left_semi", "left_anti"}:
        raise ValueError(f"how = {how}")
    p, q = G.box(), G.box("r_")
    b = (right if how == "inner" else right.select(*keys, *BOX)).withColumnsRenamed({c: f"r_{c}" for c in BOX})
    w, h = F.abs(q.x2 - q.x1), F.abs(q.y2 - q.y1)
    usual = F.greatest(F.sqrt(F.avg(w * h)), F.avg(w + h) / 2, F.lit(float(CELL)))
    hull = [F.min(F.least(q.x1, q.x2)).alias("_hx1"), F.min(F.least(q.y1, q.y2)).alias("_hy1"), F.max(F.greatest(q.x1, q.x2)).alias("_hx2"), F.max(F.greatest(q.y1, q.y2)).alias("_hy2")]
    base = b.groupBy(*keys).agg((CELL * F.pow(F.lit(2.0), F.ceil(F.log2(usual / CELL)))).cast("long").alias("_s"), *hull).hint("shuffle_hash")
    sizes = [F.col("_s") * STEP**i for i in range(SIZES)]
    size = F.greatest(F.abs(p.x2 - p.x1), F.abs(p.y2 - p.y1))
    own = F.lit(0).cast("long")  # the whole page
    for s in reversed(sizes):
        own = F.when(size <= s, s).otherwise(own)
    a = left.join(base, keys, "left" if how == "left_anti" else "inner")
    if how != "left_anti":
        a = a.where((F.least(p.x1, p.x2) <= F.col("_hx2")) & (F.greatest(p.x1, p.x2) >= F.col("_hx1")) & (F.least(p.y1, p.y2) <= F.col("_hy2")) & (F.greatest(p.y1, p.y2) >= F.col("_hy1")))
    a = a.drop("_hx1", "_hy1", "_hx2", "_hy2").withColumn("_s", F.coalesce(F.when(F.col("_s").isNotNull(), own), F.lit(-1).cast("long")))
    place = lambda v: F.when(F.col("_s") == 0, 0).otherwise(F.floor(v / F.col("_s"))).cast("long")
    # never null, or Spark asks of each left box, before its cell is known, whether the whole expression is
    a = a.withColumns({"_tx": F.coalesce(place(F.least(p.x1, p.x2)), F.lit(0).cast("long")), "_ty": F.coalesce(place(F.least(p.y1, p.y2)), F.lit(0).cast("long"))})
    span = lambda lo, hi: F.sequence(place(F.least(lo, hi)) - F.when(F.col("_s") == 0, 0).otherwise(1), place(F.greatest(lo, hi)))
    b = b.join(base.drop("_hx1", "_hy1", "_hx2", "_hy2").hint("shuffle_hash"), keys).withColumn("_s", F.explode(F.array(*sizes, F.lit(0).cast("long")))).withColumn("_tx", F.explode(span(q.x1, q.x2))).withColumn("_ty", F.explode(span(q.y1, q.y2)))
    on = [*keys, "_s", "_tx", "_ty"]
    b = b.withColumnsRenamed({c: f"_r{c}" for c in on})
    same = rule(p, q)
    for c in on:
        same = same & (F.col(c) == F.col(f"_r{c}"))
    return a.join(b.hint("shuffle_hash"), same, how).drop("_s", "_tx", "_ty", *[f"_r{c}" for c in on])


def page_join(left: DataFrame, right: DataFrame, keys: list[str], rule: Callable[[G.Box, G.Box], Column], how: str = "inner") -> DataFrame:
    """The same by the page alone; for pages with tens or hundreds of boxes.  Right boxes
    are hashed, so left ones that are dealt by page already are neither dealt nor sorted."""
    r = right.withColumnsRenamed({c: f"r_{c}" for c in ("x1", "y1", "x2", "y2")})
    extra = {c: f"r_{c}" for c in r.columns if c in left.columns and c not in keys}
    r = r.withColumnsRenamed(extra | {k: f"_k_{k}" for k in keys})
    on = rule(G.box(), G.box("r_"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return left.join(r.hint("shuffle_hash"), on, how).drop(*[f"_k_{k}" for k in keys])


def _join(dense: bool) -> Callable[..., DataFrame]:
    """How boxes of a page meet: all of them, or by cells of a grid where pages are dense."""
    return grid_join if dense else page_join


def words_outside(words: DataFrame, regions: DataFrame, keys: list[str], dense: bool = False) -> DataFrame:
    """Words whose centre lies in no region."""
    return _join(dense)(words, regions, keys, G.center_in, "left_anti")


def words_in_cells(words: DataFrame, cells: DataFrame, keys: list[str], cell: list[str], dense: bool = False) -> DataFrame:
    """For each cell: the words centred in it, in reading order, and their mean confidence."""
    met = _join(dense)(words, cells, keys, G.center_in)
    order = F.array_sort(F.collect_list(F.struct(F.bround(F.col("y1") / 8).alias("y"), F.col("x1"), F.col("text"))))
    return met.groupBy(*keys, *cell).agg(F.array_join(F.transform(order, lambda w: w["text"]), " ").alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_words"))


def not_covered(rows: DataFrame, regions: DataFrame, keys: list[str], share: float, dense: bool = False) -> DataFrame:
    """Rows of which no region covers more than ``share``."""
    return _join(dense)(rows, regions, keys, lambda a, b: G.overlap_of(a, b) > share, "left_anti")


def overlapping(rows: DataFrame, regions: DataFrame, keys: list[str], share: float = 0.3, dense: bool = False) -> DataFrame:
    """Rows of which some region covers at least ``share``."""
    return _join(dense)(rows, regions, keys, lambda a, b: G.overlap_of(a, b) >= share, "left_semi")


def claimed(tiers: list[DataFrame], keys: list[str], share: float = 0.3, dense: bool = False) -> DataFrame:
    """Detections by priority: those of a later tier that overlap an earlier one's are dropped."""
    kept = None
    for tier in tiers:
        fresh = tier if kept is None else not_covered(tier, kept.select(*keys, "x1", "y1", "x2", "y2"), keys, share, dense)
        kept = fresh if kept is None else kept.unionByName(fresh)
    return kept


def region_words(words: DataFrame, regions: DataFrame, keys: list[str], region: str) -> DataFrame:
    """For each region: how much of it words cover (at most 1) and their mean confidence."""
    area = F.greatest(F.lit(1.0), G.box("r_").area)
    met = page_join(words, regions, keys, G.center_in).withColumn("_a", area)
    return met.groupBy(*keys, region).agg(F.least(F.lit(1.0), F.sum(G.box().area) / F.max("_a")).alias("coverage"), F.avg("confidence").alias("word_confidence"))


def classify_graphics(regions: DataFrame) -> DataFrame:
    """Adds block_type of graphic regions with word_confidence, page_width and page_height."""
    b = G.box()
    aspect, low = b.width / F.greatest(F.lit(1.0), b.height), F.coalesce(F.col("word_confidence") < 0.45, F.lit(False))
    at = F.col("y1") / F.greatest(F.lit(1), F.col("page_height"))
    kind = F.when(low, "HANDWRITTEN").when((at > 0.65) & (aspect >= 2.2) & (b.height < 0.08 * F.col("page_height")), "SIGNATURE").when(aspect.between(0.6, 1.6) & (b.width < 0.18 * F.col("page_width")), "STAMP").otherwise("IMAGE")
    return regions.withColumn("block_type", kind)


def drop_excess_stamps(regions: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """Without any stamp on pages that have more than ``most``."""
    n = F.count(F.when(F.col("block_type") == "STAMP", 1)).over(Window.partitionBy(*keys))
    return regions.withColumn("_n", n).where((F.col("block_type") != "STAMP") | (F.col("_n") <= most)).drop("_n")


def gap_clusters(rows: DataFrame, keys: list[str], position: str, gap: Column | float) -> DataFrame:
    """Chains positions whose gaps are at most ``gap``: one row for each cluster with
    its number, its size and its centre, rounded half to even."""
    w = Window.partitionBy(*keys).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(w) <= gap, 0).otherwise(1)
    df = rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return df.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.bround(F.avg(position)).cast("long").alias("center"))


def boundaries(rows: DataFrame, keys: list[str], edges: list[str]) -> DataFrame:
    """The distinct positions of all edges, and each one's gap to the next."""
    at = rows.select(*keys, F.explode(F.array(*edges)).alias("edge")).distinct()
    return at.withColumn("gap", F.lead("edge").over(Window.partitionBy(*keys).orderBy("edge")) - F.col("edge"))
