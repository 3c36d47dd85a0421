"""Mixing sources to target weights (operator 9): Poisson replication, native.

A source's target share of the output over its share of the input is its mean
repetition rate.  Each document draws its count from the Poisson distribution
with that mean, by inverting it at a uniform number hashed from the seed and
its id; it is repeated so often, and all repetitions are shuffled by a hash.
A mean above MOST_MEAN is dealt to several such draws, whose sum is Poisson too,
so any rate is reached with a table of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import cut, join_hot

#: A source's target weight is its number of documents to this power, unless weights are given.
TEMPERATURE = 0.7
#: The inverse is tabulated to this many standard deviations beyond the mean, and some; what lies beyond has a chance below 1e-15.
TAIL = 12
#: The largest mean that one draw inverts: exp(-mean) is far from the least double, and its table has about 800 numbers.
MOST_MEAN = 512.0
#: So many sources at most, with so many numbers in all their tables, are broadcast; that is 9 MB.
MOST_BROADCAST = 4096
MOST_NUMBERS = 260 * 4096
#: Beyond that, the join with the sources deals each of them to so many tasks.
SALTS = 64
#: Repetitions are numbered in runs of so many.
STRIDE = 1024


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_table(mean: Column) -> Column:
    """The cumulative probabilities of 0, 1, 2, ... as far as TAIL asks."""
    top = F.ceil(mean + TAIL * F.sqrt(mean) + 20).cast("int")
    zero = F.exp(-mean)
    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.array_append(acc["out"], c).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["out"])


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(source, rate): how often a document of each source is to appear on average.

    weights: target weights by source, in any unit; sources that are missing
    get 0.  Without them, a source weighs its count to the power TEMPERATURE.
    total: documents of the output, those of the input by default."""
    n = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_mx_source")).agg(F.count("*").alias("n"))
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    else:
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
        w = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_mx_source")), F.lit(0.0)) if pairs else F.lit(0.0)
    n = n.withColumn("w", w)
    sums = n.agg(F.sum("w").alias("_w"), F.sum("n").alias("_n"))  # one row
    size = F.col("_n") if total is None else F.lit(float(total))
    rate = F.when(F.col("_w") > 0, F.col("w") / F.col("_w") * size / F.col("n")).otherwise(0.0)
    return n.join(F.broadcast(sums)).select("_mx_source", rate.alias("rate"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, total: float | None = None, seed: int = 1) -> DataFrame:
    """The rows of docs, each as often as drawn, with replica (1, 2, ...) and
    shuffle_key, dealt to partitions by that key and in its order within each.

    Each row draws for itself: by its id, or, where its id is null or that of other
    rows too, by its id, a digest of all its columns and its number among equal rows.
    Texts are carried along, however long.  Ties: repetitions with equal keys may
    come in any order.  Null source: a source of its own, named "".
    A rate has no upper bound; the repetitions of one row are made in one task.
    Empty table: empty result.  Clashing columns replica and shuffle_key of
    docs are replaced."""
    keep = [c for c in docs.columns if c not in {"replica", "shuffle_key"} and not c.startswith("_mx_")]
    draws = F.greatest(F.ceil(F.col("rate") / MOST_MEAN), F.lit(1)).cast("long")
    table = rates(docs, source, weights, total).withColumn("_mx_draws", draws)
    table = cut(table.select("_mx_source", poisson_table(F.col("rate") / F.col("_mx_draws")).alias("_mx_table"), "_mx_draws", (F.col("rate") > 0).alias("_mx_any")), "rates")
    rows = _with_source(_keyed(docs.select(*keep), doc_id, source), table).withColumn("_mx_u", uniform(seed, F.col("_mx_key")))
    drawn = lambda u: F.size(F.filter("_mx_table", lambda c: c <= u)).cast("long")
    more = F.transform(F.sequence(F.lit(2).cast("long"), F.col("_mx_draws")), lambda i: uniform(seed, F.lit("draw"), F.col("_mx_key"), i))
    more = F.when(F.col("_mx_draws") > 1, F.aggregate(more, F.lit(0).cast("long"), lambda k, u: k + drawn(u))).otherwise(0)
    rows = rows.withColumn("_mx_k", F.when(F.col("_mx_any"), drawn(F.col("_mx_u")) + more).otherwise(0)).where("_mx_k > 0").drop("_mx_table")
    # in two steps, so that no array has as many numbers as a document has repetitions
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mx_k") - 1) / STRIDE))).alias("_mx_run"))
    first = F.col("_mx_run") * STRIDE + 1
    rows = rows.select("*", F.explode(F.sequence(first, F.least(F.col("_mx_k"), first + (STRIDE - 1)))).alias("replica"))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "_mx_key", F.col("replica").cast("string"))))
    return rows.select(*keep, "replica", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def _keyed(docs: DataFrame, doc_id: str, source: str) -> DataFrame:
    """docs with _mx_source and _mx_key, by which a row draws: its id, if no other row has it.

    Ids are counted without their rows.  Where some are null or repeated, equal rows of
    them meet in one row, with their count, before they are numbered; so a row that is
    repeated without end is held once, and its numbers are made in runs."""
    keep = docs.columns
    docs = docs.withColumns({"_mx_source": F.coalesce(F.col(source).cast("string"), F.lit("")), "_mx_id": F.coalesce(F.col(doc_id).cast("string"), F.lit(""))})
    ids = docs.groupBy("_mx_id", F.col(doc_id).isNull().alias("_mx_null")).agg(F.count("*").alias("_mx_n"))
    shared = cut(ids.where("_mx_null or _mx_n > 1").groupBy("_mx_id").agg(F.sum("_mx_n").alias("_mx_n")), "shared-ids")
    total = shared.agg(F.coalesce(F.sum("_mx_n"), F.lit(0))).first()[0]
    if not total:
        return docs.withColumn("_mx_key", F.col("_mx_id")).drop("_mx_id")
    strings = [F.to_json(c) if docs.schema[c].dataType.typeName() in {"struct", "array", "map"} else F.col(f"`{c}`").cast("string") for c in keep]
    digest = F.md5(F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in strings]))
    rows = join_hot(docs, shared, ["_mx_id"], "_mx_n", total, digest, "left")
    own = rows.where("_mx_n is null").select(*keep, "_mx_source", F.col("_mx_id").alias("_mx_key"))
    equal = rows.where("_mx_n is not null").groupBy("_mx_source", "_mx_id", digest.alias("_mx_digest")).agg(F.count("*").alias("_mx_c"), *[F.first(f"`{c}`").alias(f"_mx_{i}") for i, c in enumerate(keep)])
    runs = equal.withColumn("_mx_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mx_c") - 1) / STRIDE))))
    first = F.col("_mx_run") * STRIDE + 1
    # runs of one row are dealt to tasks before they become rows
    runs = runs.repartition("_mx_digest", "_mx_run").withColumn("_mx_i", F.explode(F.sequence(first, F.least(F.col("_mx_c"), first + (STRIDE - 1)))))
    return own.unionByName(runs.select(*[F.col(f"_mx_{i}").alias(c) for i, c in enumerate(keep)], "_mx_source", F.concat_ws(":", "_mx_id", "_mx_digest", F.col("_mx_i").cast("string")).alias("_mx_key")))


def _with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined with the table of their source.  A checked number of sources and
    of their tables' numbers is broadcast, so texts stay where they are; more are
    salted, so that a source with a large share of all rows is dealt to many tasks."""
    sources, numbers = table.agg(F.count("*"), F.coalesce(F.sum(F.size("_mx_table")), F.lit(0))).first()
    if sources <= MOST_BROADCAST and numbers <= MOST_NUMBERS:
        return rows.join(F.broadcast(table), "_mx_source")
    rows = rows.withColumn("_mx_salt", F.pmod(F.xxhash64("_mx_key"), F.lit(SALTS)))
    table = table.withColumn("_mx_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(table, ["_mx_source", "_mx_salt"]).drop("_mx_salt")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """The mixture of all documents by source, with their texts."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "lang", "text", "replica", "shuffle_key")


OP9_SQL = """
WITH n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT s, n, pow(n::DOUBLE, 0.7) AS w FROM n),
r AS (SELECT s, w / (SELECT sum(w) FROM w) * (SELECT sum(n) FROM n) / n AS rate FROM w),
m AS (SELECT s, greatest(ceil(rate / 512), 1)::BIGINT AS draws, rate / greatest(ceil(rate / 512), 1) AS mean FROM r),
k AS (SELECT s, mean, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 20)::BIGINT + 1)) AS k FROM m),
c AS (SELECT s, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS c FROM k),
g AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS id, doc_id IS NULL OR count(*) OVER (PARTITION BY coalesce(doc_id::VARCHAR, '')) > 1 AS shared,
 md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''), coalesce(n_chars::VARCHAR, ''))) AS digest FROM documents),
h AS (SELECT *, CASE WHEN shared THEN id || ':' || digest || ':' || row_number() OVER (PARTITION BY id, digest) ELSE id END AS key FROM g),
j AS (SELECT h.*, unnest(range(1, draws + 1)) AS draw FROM h JOIN m ON m.s = coalesce(source, '')),
u AS (SELECT doc_id, source, lang, text, key, ('0x' || substr(md5(CASE WHEN draw = 1 THEN '1:' || key ELSE '1:draw:' || key || ':' || draw END), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM j),
d AS (SELECT doc_id, source, lang, text, key, sum((SELECT count(*) FROM c WHERE c.s = coalesce(u.source, '') AND c.c <= u.u)) AS times FROM u GROUP BY ALL),
x AS (SELECT doc_id, source, lang, text, key, unnest(range(1, times::BIGINT + 1)) AS replica FROM d WHERE times > 0)
SELECT doc_id, source, lang, text, replica, md5('order1:' || key || ':' || replica::VARCHAR) AS shuffle_key FROM x
"""
