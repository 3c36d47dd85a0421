"""What differs between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of rows that were added, changed or are gone, each once.

    Both versions are read once, and only keys and a digest of each row are shuffled.  Rows
    that repeat a key differ if any of them does; a null key is a key.  Columns come by name."""
    columns = sorted(set(before.columns) | set(after.columns))

    def digests(df: DataFrame, side: int) -> DataFrame:
        value = F.struct(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in columns])
        digest = F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)
        return df.select(*keys, digest.alias("_digest"), F.lit(side).alias("_side"))

    both = digests(before, -1).unionByName(digests(after, 1)).groupBy(*keys, "_digest").agg(F.sum("_side").alias("_n"))
    return both.where("_n <> 0").select(*keys).distinct()


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """A change feed: the rows of ``after`` that were added or changed, and the rows of
    ``before`` that are gone, with _change.  Keys are unique in each version and not null."""
    touched = changed_keys(before, after, keys)
    old = before.join(touched, keys, "left_semi")
    new = after.join(touched, keys, "left_semi")
    fresh = new.join(old.select(*keys).withColumn("_was", F.lit(True)), keys, "left")
    fresh = fresh.withColumn("_change", F.when(F.col("_was"), "changed").otherwise("added")).drop("_was")
    gone = old.join(new.select(*keys), keys, "left_anti").withColumn("_change", F.lit("gone"))
    return fresh.unionByName(gone, allowMissingColumns=True)
