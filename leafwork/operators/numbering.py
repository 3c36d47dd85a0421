"""Numbers for all rows of a table in any order, without one task that sees all rows.

Rows are dealt to ranges of the order by sampled quantiles and sorted in their
ranges; a row's number is its place in its range after the rows of all ranges
before it.  Only the counts of the ranges meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.session import cut


def number_rows(df: DataFrame, order: list[Column], name: str = "number", ranges: int | None = None) -> DataFrame:
    """df with ``name``: 1, 2, 3, ... by ``order``.

    Rows with equal values of ``order`` are numbered next to each other, in any order,
    and share a range however many they are: end ``order`` with a key to tell them
    apart and to keep the ranges even.  Nulls come where ``order`` puts them.
    Repeated rows have numbers of their own.  Empty table: empty result.  A column
    ``name`` of df is replaced.

    ranges: into how many ranges rows are dealt, the session's shuffle partitions by
    default.  The places are written once to the shared folder, as a range that is
    sampled anew after the loss of an executor might begin elsewhere."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != name]
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    # (range, place) in one number: the range is the task's, 31 bits, and the place has 33 bits
    placed = cut(dealt.select(*keep, F.monotonically_increasing_id().alias("_nr_at")), "placed")
    part = F.shiftright("_nr_at", 33)
    counts = placed.groupBy(part.alias("_nr_range")).agg(F.count("*").alias("_nr_n"))
    # one row for each range
    before = counts.select("_nr_range", (F.sum("_nr_n").over(Window.orderBy("_nr_range")) - F.col("_nr_n")).alias("_nr_before"))
    place = F.col("_nr_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("_nr_range", part).join(F.broadcast(before), "_nr_range").select(*keep, (F.col("_nr_before") + place).alias(name))
