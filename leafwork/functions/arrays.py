"""Folds over arrays within a row, in a bounded number of copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrays up to this length are folded in one go.
SHORT = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parted(values: Column, apart: Callable[[Column, Column], Column]) -> Column:
    """An array cut into arrays of neighbours: one begins wherever apart(value before, value) holds; null of an empty array."""

    def cut(v: Column) -> Column:
        begin = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | apart(F.get(v, i - 1), F.get(v, i)))
        return let(begin, lambda b: F.transform(b, lambda i, k: F.slice(v, i + 1, F.coalesce(F.get(b, k + 1), F.size(v)) - i)))

    return let(values, lambda v: F.when(F.size(v) > 0, cut(v)))


def _fold(xs: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """(last, out): what merge makes of 0 and all values, and of those before each place."""
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(xs, start, lambda acc, x: F.struct(merge(acc["last"], x).alias("last"), F.array_append(acc["out"], acc["last"]).alias("out")))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs of 0 or more: what the associative ``merge``
    makes of 0 and all values before it.

    A long array is folded in runs of the square root of its length, then the runs'
    results are, so that n values cost n * sqrt(n) copied elements and not n * n."""

    def parts(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / step).cast("int") - 1), lambda i: _fold(F.slice(v, i * step + 1, step), merge))
        return let(runs, lambda r: F.flatten(F.zip_with(r, _fold(F.transform(r, lambda x: x["last"]), merge)["out"], lambda x, b: F.transform(x["out"], lambda y: merge(b, y)))))

    return let(values, lambda v: F.when(F.size(v) <= SHORT, _fold(v, merge)["out"]).otherwise(parts(v)))


def running_sums(values: Column) -> Column:
    """The sum of all values before each."""
    return running(values, lambda a, b: a + b)
