"""Edits of table structure: cells are rows with table_id, row, column, rowspan,
colspan, text and any further columns; each edit is a projection or one aggregate
of the table.  Tables have n_rows, n_cols, row_heights and column_widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The size of a new row and of a new column.
NEW_SIZE = {"row": 30.0, "column": 80.0}
_OTHER = {"row": "column", "column": "row"}
_SPAN = {"row": "rowspan", "column": "colspan"}


def _sizes(cells: DataFrame) -> DataFrame:
    """(table_id, _row, _column): how many rows and columns each table has."""
    return cells.groupBy("table_id").agg(*[F.max(F.col(a) + F.col(s)).cast("int").alias(f"_{a}") for a, s in _SPAN.items()])


def _add(cells: DataFrame, axis: str, at: int | None) -> DataFrame:
    """A row or column of blank cells before ``at``, or behind the last one; further
    columns of blank cells are null."""
    other, sizes = _OTHER[axis], _sizes(cells)
    place = F.col(f"_{axis}") if at is None else F.lit(at)
    moved = cells.join(sizes, "table_id").withColumn(axis, F.when(F.col(axis) >= place, F.col(axis) + 1).otherwise(F.col(axis)).cast("int")).drop("_row", "_column")
    blank = sizes.select("table_id", place.cast("int").alias(axis), F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1)).alias(other), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit("").alias("text"))
    return moved.unionByName(blank, allowMissingColumns=True).select(*cells.columns)


def _delete(cells: DataFrame, axis: str, at: int) -> DataFrame:
    """A table's last row or column stays."""
    last = F.col(f"_{axis}") <= 1
    kept = cells.join(_sizes(cells), "table_id").where((F.col(axis) != at) | last)
    return kept.withColumn(axis, F.when((F.col(axis) > at) & ~last, F.col(axis) - 1).otherwise(F.col(axis)).cast("int")).select(*cells.columns)


def add_row(cells: DataFrame, at: int | None = None) -> DataFrame:
    return _add(cells, "row", at)


def add_column(cells: DataFrame, at: int | None = None) -> DataFrame:
    return _add(cells, "column", at)


def delete_row(cells: DataFrame, at: int) -> DataFrame:
    return _delete(cells, "row", at)


def delete_column(cells: DataFrame, at: int) -> DataFrame:
    return _delete(cells, "column", at)


def merge_cells(cells: DataFrame, chosen: Column) -> DataFrame:
    """Cells for which ``chosen`` holds become one in each table: the first of them, with
    the hull of their spans and their texts in order of row and column.  Where fewer
    than two are chosen, nothing changes."""
    fixed = ["table_id", "row", "column", "rowspan", "colspan", "text"]
    more = [c for c in cells.columns if c not in fixed]
    marked = cells.withColumn("_on", F.coalesce(chosen, F.lit(False)))
    enough = marked.groupBy("table_id").agg(F.count_if("_on").alias("_n"))
    marked = marked.join(enough, "table_id").withColumn("_on", F.col("_on") & (F.col("_n") >= 2)).drop("_n")
    texts = F.array_sort(F.collect_list(F.struct("row", "column", "text")))
    text = F.trim(F.array_join(F.transform(F.filter(texts, lambda x: x["text"] != ""), lambda x: x["text"]), " "))
    hull = [F.min(a).cast("int").alias(a) for a in _SPAN] + [(F.max(F.col(a) + F.col(s)) - F.min(a)).cast("int").alias(s) for a, s in _SPAN.items()]
    first = F.min_by(F.struct(F.lit(0).alias("_"), *more), F.struct("row", "column")).alias("_first")
    merged = marked.where("_on").groupBy("table_id").agg(*hull, text.alias("text"), first)
    values = [(F.lit(True) if c == "is_edited" else F.col(f"_first.`{c}`")).alias(c) for c in more]
    return marked.where("not _on").drop("_on").unionByName(merged.select(*fixed, *values)).select(*cells.columns)


def split_cell(cells: DataFrame, chosen: Column) -> DataFrame:
    """Chosen cells go back to one row and column; cells they had covered are not made again."""
    one = F.coalesce(chosen, F.lit(False)) & ((F.col("rowspan") > 1) | (F.col("colspan") > 1))
    out = cells.withColumn("_one", one)
    for c, v in {"rowspan": 1, "colspan": 1, "is_edited": True}.items():
        if c in cells.columns:
            out = out.withColumn(c, F.when(F.col("_one"), F.lit(v)).otherwise(F.col(c)))
    return out.drop("_one")


OPERATIONS = {"add_row": add_row, "add_column": add_column, "delete_row": delete_row, "delete_column": delete_column, "merge": merge_cells, "split": split_cell}


def edit(cells: DataFrame, operation: str, argument) -> DataFrame:
    """Applies an operation by name; an unknown one is refused."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation}")
    return OPERATIONS[operation](cells, argument)


def edit_sizes(tables: DataFrame, operation: str, at: int | None = None) -> DataFrame:
    """The tables with the counts and sizes that add_row, add_column, delete_row or
    delete_column leave; other operations change none."""
    if operation not in {f"{verb}_{axis}" for verb in ("add", "delete") for axis in _OTHER}:
        return tables
    verb, axis = operation.split("_")
    count, sizes = {"row": ("n_rows", "row_heights"), "column": ("n_cols", "column_widths")}[axis]
    place = F.col(count) if at is None else F.lit(at)
    head, tail = F.slice(sizes, F.lit(1), F.least(place, F.size(sizes))), lambda skip: F.filter(sizes, lambda _, i: i >= place + skip)
    if verb == "add":
        return tables.withColumn(sizes, F.concat(head, F.array(F.lit(NEW_SIZE[axis])), tail(0))).withColumn(count, F.col(count) + 1)
    more = F.col(count) > 1
    return tables.withColumn(sizes, F.when(more, F.concat(head, tail(1))).otherwise(F.col(sizes))).withColumn(count, F.when(more, F.col(count) - 1).otherwise(F.col(count)))


def cells_by_row(cells: DataFrame) -> DataFrame:
    """Each row's cells in order of column."""
    order = F.array_sort(F.collect_list(F.struct("column", "rowspan", "colspan", "text")))
    return cells.groupBy("table_id", "row").agg(order.alias("cells"))


def table_shape(cells: DataFrame) -> DataFrame:
    """Rows and columns of each table, and the widest text of each column, from 8 to 48."""
    width = cells.groupBy("table_id", "column").agg(F.greatest(F.lit(8), F.least(F.lit(48), F.max(F.length("text")) + 4)).alias("w"))
    widths = width.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "w"))), lambda x: x["w"]).alias("widths"))
    return cells.groupBy("table_id").agg(F.max(F.col("row") + F.col("rowspan")).alias("n_rows"), F.max(F.col("column") + F.col("colspan")).alias("n_columns")).join(widths, "table_id")
