"""Rows, columns and tables that the places of words show, as folds inside the row.

Words of a page meet in runs of one height and place first, so the fold that makes rows
of them has a step for each run and not for each word.  All groups are by (doc_id,
page): words that are dealt by it are not dealt again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.arrays import let, parted

PAGE = ["doc_id", "page"]
# How far from a row's mean a word may lie, by its height, for rows of words and for bounds of rows.
ROW_REACH, BOUND_REACH = 0.6, 0.7
# Fixed values of tables without rules: least rows and columns, tolerance by page width, share of rows a column must hit.
LEAST_ROWS, LEAST_COLUMNS, BAND_TOLERANCE, ROW_SHARE = 4, 3, 0.02, 0.85
# Fixed values of columns' bounds: least gap, tolerance by length, least rows, share of rows.
BOUND_GAP, BOUND_TOLERANCE, BOUND_ROWS, BOUND_SHARE = 8.0, 0.03, 3, 0.75
# Fixed values of cells: how far left of its column a word may begin, and the confidence of a table by its cells', or without any.
CELL_SLACK, DISCOUNT, UNSURE = 5, 0.85, 0.4
NUMBER = r"^[+-]?[0-9,./%-]*[0-9][0-9,./%-]*$"


def row_numbers(runs: Column, reach: float) -> Column:
    """The row of each of an array of runs (mid, height, n), in order: a run joins while it
    is within reach * its height of the mean of the words so far."""

    def step(acc: Column, r: Column) -> Column:
        size = F.when(r["height"] > 0, r["height"]).otherwise(1.0)
        fresh = (acc["n"] > 0) & (F.abs(r["mid"] - acc["total"] / acc["n"]) > reach * size)
        # words of one run share a fate: the first one decides, and the mean only comes nearer
        row = acc["row"] + F.when(fresh, 1).otherwise(0)
        return F.struct((F.when(fresh, 0.0).otherwise(acc["total"]) + r["mid"] * r["n"]).alias("total"), (F.when(fresh, F.lit(0).cast("long")).otherwise(acc["n"]) + r["n"]).alias("n"), row.alias("row"), F.array_append(acc["out"], row).alias("out"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("row"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(runs, start, step, lambda acc: acc["out"])


def page_runs(words: DataFrame, *more: str) -> DataFrame:
    """(doc_id, page, runs): the words of each page in runs (mid, height, n, words) of one
    height and place; words are structs (x1, wi, x2, y1, y2, text and ``more``).  Where
    words come of texts, layout.page_runs() gives the same without a row for each word."""
    mid, height = (F.col("y1") + F.col("y2")) / 2, (F.col("y2") - F.col("y1")).cast("double")
    word = F.struct("x1", "wi", "x2", "y1", "y2", "text", *more)
    runs = words.groupBy(*PAGE, mid.alias("mid"), height.alias("height")).agg(F.count("*").alias("n"), F.collect_list(word).alias("words"))
    return runs.groupBy(*PAGE).agg(F.collect_list(F.struct("mid", "height", "n", "words")).alias("runs"))


def _parted_rows(runs: Column | str, reach: float) -> Column:
    """An array of rows of words from the top, each an array of its runs (row, words)."""
    put = let(F.sort_array(runs), lambda runs: F.zip_with(runs, row_numbers(runs, reach), lambda r, row: F.struct(row.alias("row"), r["words"].alias("words"))))
    return parted(put, lambda a, b: a["row"] != b["row"])


def rows_in(pages: DataFrame, reach: float = ROW_REACH) -> DataFrame:
    """(doc_id, page, row, words) of each row of words, from the top, of a page's runs; words
    go from left to right.  Of words with one middle, the lower come first.  All of it
    happens within the page's row."""
    rows = F.transform(_parted_rows("runs", reach), lambda r: F.sort_array(F.flatten(F.transform(r, lambda x: x["words"]))))
    return pages.select(*PAGE, F.posexplode(rows).alias("row", "words"))


def rows_of(words: DataFrame, reach: float = ROW_REACH, *more: str) -> DataFrame:
    """The same of words, with ``more`` of their columns."""
    return rows_in(page_runs(words, *more), reach)


def row_clusters(words: DataFrame) -> DataFrame:
    """(doc_id, page, row, n_words, y1, y2, text) of rows of words by height."""
    return row_texts(rows_of(words))


def row_texts(rows: DataFrame) -> DataFrame:
    """The same of rows."""
    each = lambda c: F.transform("words", lambda w: w[c])
    return rows.select(*PAGE, "row", F.size("words").cast("long").alias("n_words"), F.array_min(each("y1")).alias("y1"), F.array_max(each("y2")).alias("y2"), F.array_join(each("text"), " ").alias("text"))


def _bounds(edges: Column, length: Column, offset: float) -> Column:
    return F.transform(edges, lambda e: F.bround(F.greatest(F.lit(0.0), F.least(length.cast("double"), e - offset))).cast("int"))


def _row_edges(rows: Column, length: Column, offset: float) -> Column:
    """The outer edges of rows of runs and the middles of the gaps between them; none of one row."""
    edge = lambda r, c: F.transform(r, lambda x: F.get(x["words"], F.lit(0))[c].cast("double"))  # noqa: E731  words of a run share their edges
    told = F.transform(rows, lambda r: F.struct(F.array_min(edge(r, "y1")).alias("top"), F.array_max(edge(r, "y2")).alias("bottom")))

    def edges(r: Column) -> Column:
        at = lambda i: F.get(r, i)
        inner = F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.when(at(i)["top"] > at(i - 1)["bottom"], (at(i - 1)["bottom"] + at(i)["top"]) / 2).otherwise(at(i - 1)["bottom"]))
        return F.when(F.size(r) >= 2, _bounds(F.concat(F.array(at(F.lit(0))["top"]), inner, F.array(at(F.size(r) - 1)["bottom"])), length, offset))

    return F.coalesce(let(told, edges), F.array().cast("array<int>"))


def _column_edges(rows: Column, length: Column, offset: float) -> Column:
    """The first column's place, the middles between neighbouring columns' places and the
    right edge, of rows of runs.  A column's place is the mean of left edges that recur in
    most rows; none with less than four rows or two columns."""
    words = lambda r, of: F.flatten(F.transform(r, lambda x: F.transform(x["words"], of)))
    tolerance = F.greatest(F.lit(BOUND_GAP), BOUND_TOLERANCE * length)

    def found(r: Column, n: Column) -> Column:
        lefts = F.flatten(F.transform(r, lambda row, i: words(row, lambda w: F.struct(w["x1"].cast("double").alias("x1"), i.alias("row")))))
        right = F.array_max(F.transform(r, lambda row: F.array_max(words(row, lambda w: w["x2"].cast("double")))))
        chains = parted(F.sort_array(lefts), lambda a, b: b["x1"] - a["x1"] > tolerance)
        told = F.transform(chains, lambda c: let(F.aggregate(c, F.lit(0.0), lambda t, x: t + x["x1"]) / F.size(c), lambda m: F.struct(m.alias("m"), F.size(F.array_distinct(F.transform(F.filter(c, lambda x: F.abs(x["x1"] - m) <= tolerance), lambda x: x["row"]))).alias("hit"))))
        good = F.transform(F.filter(told, lambda c: c["hit"] >= F.greatest(F.lit(BOUND_ROWS), F.floor(BOUND_SHARE * n))), lambda c: c["m"])
        return let(good, lambda c: F.when(F.size(c) >= 2, _bounds(F.concat(F.array(F.get(c, F.lit(0))), F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: (F.get(c, i - 1) + F.get(c, i)) / 2), F.array(right)), length, offset)))

    return F.coalesce(let(rows, lambda r: F.when(F.size(r) >= LEAST_ROWS, found(r, F.size(r)))), F.array().cast("array<int>"))


def chained(words: DataFrame, keys: list[str], row: str, tolerance: Column | str) -> DataFrame:
    """(keys, band, center, n, hit) of chains of left edges whose gaps are within
    ``tolerance``: the mean of its edges, its words, and how many rows have a word within
    the tolerance of the mean.  Words of other chains cannot be that near."""
    order = Window.partitionBy(*keys).orderBy("x1", row)
    own = words.withColumn("_tol", tolerance if isinstance(tolerance, Column) else F.col(tolerance))
    new = F.when(F.col("x1") - F.lag("x1").over(order) <= F.col("_tol"), 0).otherwise(1)
    chains = own.withColumn("_new", new).withColumn("band", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    mean = F.avg("x1").over(Window.partitionBy(*keys, "band"))
    near = chains.withColumn("_mean", mean).withColumn("_near", F.when(F.abs(F.col("x1") - F.col("_mean")) <= F.col("_tol"), F.col(row)))
    return near.groupBy(*keys, "band").agg(F.first("_mean").alias("center"), F.count("*").alias("n"), F.count_distinct("_near").alias("hit"))


def column_bands(words: DataFrame, keys: list[str], line: str, tolerance: float = BAND_TOLERANCE, share: float = ROW_SHARE) -> DataFrame:
    """(keys, band, n, hit) of chains of left edges whose gaps are within ``tolerance`` of
    the page's width, that two lines or more, and a share of them, hit near their mean."""
    wide = words.withColumn("_width", F.max("x2").over(Window.partitionBy(*keys)) * tolerance)
    lines = words.groupBy(*keys).agg(F.count_distinct(line).alias("_lines"))
    met = chained(wide, keys, line, "_width").join(lines, keys)
    return met.where(F.col("hit") >= F.greatest(F.lit(2), F.floor(F.col("_lines") * share))).select(*keys, "band", "n", "hit")


def page_bounds(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, rows, columns): boundaries that the words of each page suggest."""
    sizes = pages.select(*PAGE, "page_width", "page_height")
    return bounds_in(page_runs(words).join(sizes.hint("shuffle_hash"), PAGE))


def bounds_in(pages: DataFrame, offset: float = 0.0) -> DataFrame:
    """The same of pages' runs, page_width and page_height, from ``offset``.  All of it
    happens within the page's row: words are neither listed nor sorted as rows."""
    return pages.select(*PAGE, _row_edges(_parted_rows("runs", BOUND_REACH), F.col("page_height"), offset).alias("rows"), _column_edges(_parted_rows("runs", ROW_REACH), F.col("page_width"), offset).alias("columns"))


# ------------------------------------------------------------- tables without rules
def bands_of(edges: Column, rows: Column, tolerance: Column) -> Column:
    """The places of columns from an array of (x1, row) in order of x1: means of chains
    that most of so many rows hit."""

    def step(acc: Column, e: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct((last["total"] + e["x1"]).alias("total"), (last["n"] + 1).alias("n"), e["x1"].alias("end"))
        joins = F.coalesce(e["x1"] - last["end"] <= tolerance, F.lit(False))
        new = F.struct(e["x1"].alias("total"), F.lit(1).alias("n"), e["x1"].alias("end"))
        return F.when(joins, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), grown)).otherwise(F.array_append(acc, new))

    chains = F.aggregate(edges, F.array().cast("array<struct<total:double,n:int,end:double>>"), step)
    least = F.greatest(F.lit(2), F.floor(rows * ROW_SHARE)).cast("int")
    hits = lambda c: F.size(F.array_distinct(F.transform(F.filter(edges, lambda e: F.abs(e["x1"] - c) <= tolerance), lambda e: e["row"])))
    return F.filter(F.transform(chains, lambda x: x["total"] / x["n"]), lambda c: hits(c) >= least)


def table_runs(rows: Column, tolerance: Column) -> Column:
    """(first, last) of runs of an array of rows (edges), as places in it: a run grows as
    long as three columns are common to all of it, and is a table with four rows or more."""
    none = F.array().cast("array<struct<x1:double,row:int>>")

    def step(acc: Column, r: Column) -> Column:
        joint = F.array_sort(F.concat(acc["edges"], r["edges"]))
        n = acc["at"] - acc["first"] + 1
        return let(joint, lambda j: let((n == 1) | (F.size(bands_of(j, n, tolerance)) >= LEAST_COLUMNS), lambda grows: grown(acc, r, j, grows)))

    def grown(acc: Column, r: Column, joint: Column, grows: Column) -> Column:
        closed = F.array_append(acc["out"], F.struct(acc["first"].alias("first"), acc["at"].alias("last")))
        return F.struct(F.when(grows, acc["first"]).otherwise(acc["at"]).alias("first"), (acc["at"] + 1).alias("at"), F.when(grows, joint).otherwise(r["edges"]).alias("edges"), F.when(grows, acc["out"]).otherwise(closed).alias("out"))

    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("at"), none.alias("edges"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))
    end = lambda acc: F.array_append(acc["out"], F.struct(acc["first"].alias("first"), acc["at"].alias("last")))
    return F.filter(F.aggregate(rows, start, step, end), lambda t: t["last"] - t["first"] >= LEAST_ROWS)


def borderless_tables(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Cells of tables without rules: (doc_id, page, table_no, row, column, text, box,
    confidence, table_confidence).  A table has a column of numbers."""
    numeric = words.where(F.col("text").rlike(NUMBER)).groupBy(*PAGE).agg(F.count("*").alias("_n")).where("_n >= 2")
    some = words.join(numeric.select(*PAGE), PAGE, "left_semi").join(pages.select(*PAGE, (F.col("page_width") * BAND_TOLERANCE).alias("tolerance")), PAGE)
    rows = rows_of(some, ROW_REACH, "confidence", "tolerance").where(F.size("words") >= LEAST_COLUMNS)
    edges = F.transform("words", lambda w: F.struct(w["x1"].cast("double").alias("x1"), F.col("row").alias("row")))
    page = rows.withColumn("edges", edges).groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("row", "words", "edges"))).alias("rows"), F.max(F.element_at("words", 1)["tolerance"]).alias("tolerance"))
    page = page.where(F.size("rows") >= LEAST_ROWS).withColumn("runs", table_runs(F.col("rows"), F.col("tolerance")))
    t = page.select(*PAGE, "rows", "tolerance", F.explode("runs").alias("t")).select(*PAGE, "tolerance", F.slice("rows", F.col("t.first") + 1, F.col("t.last") - F.col("t.first")).alias("rows"), F.col("t.first").alias("first"))
    t = t.withColumn("bands", bands_of(F.array_sort(F.flatten(F.transform("rows", lambda r: r["edges"]))), F.size("rows"), F.col("tolerance")))

    def texts(c: Column) -> Column:
        own = lambda r: F.filter(r["words"], lambda w: F.abs(w["x1"] - c) <= 2 * F.col("tolerance"))
        met = F.filter(F.transform("rows", own), lambda w: F.size(w) > 0)
        return F.transform(met, lambda w: F.array_join(F.transform(w, lambda x: x["text"]), ""))

    def numbers(c: Column) -> Column:
        return let(texts(c), lambda x: (F.size(x) >= F.greatest(F.lit(2), F.floor(F.size("rows") * 0.6))) & (F.size(F.filter(x, lambda s: s.rlike(NUMBER))) >= 0.6 * F.size(x)))

    t = t.where((F.size("bands") >= LEAST_COLUMNS) & F.exists("bands", numbers))
    t = t.withColumn("table_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("first")) - 1)
    right = F.array_max(F.transform(F.flatten(F.transform("rows", lambda r: r["words"])), lambda w: w["x2"])) + 1
    t = t.withColumn("edges", F.array_append("bands", right.cast("double")))
    cell = t.select(*PAGE, "table_no", "bands", "edges", F.posexplode("rows").alias("row", "r")).select("*", F.posexplode("bands").alias("column", "x"))
    begin, end = F.col("x"), F.get("edges", F.col("column") + 1)
    inside = F.filter(F.col("r.words"), lambda w: (w["x1"] >= begin - CELL_SLACK) & (w["x1"] < end - CELL_SLACK))
    cell = cell.withColumn("w", inside).withColumn("confidence", F.when(F.size("w") > 0, F.aggregate("w", F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size("w")).otherwise(0.0))
    edge = lambda c: F.transform("r.words", lambda w: w[c].cast("double"))
    out = cell.select(*PAGE, "table_no", "row", "column", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), begin.alias("x1"), F.array_min(edge("y1")).alias("y1"), end.alias("x2"), F.array_max(edge("y2")).alias("y2"), "confidence")
    sure = F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).over(Window.partitionBy(*PAGE, "table_no"))
    return out.withColumn("table_confidence", F.coalesce(sure * DISCOUNT, F.lit(UNSURE)))
