"""The queries of the services: lists, look-ups, roll-ups, schedules and registers.

Each is one declarative plan over named columns; filters stand before joins so
that they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.functions.text import dedupe_key
from leafwork.operators.numbering import number_rows


def page_of_results(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page of the ordered rows: a top-k of page * size rows, then an offset."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """All rows in order; the sort is by ranges, so no task holds them all."""
    return df.orderBy(*order)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def status_counts(df: DataFrame, status: str, groups: dict[str, list[str]]) -> DataFrame:
    """Total and one count for each group of states, in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status).isin(v)).alias(k) for k, v in groups.items()])


def register_summary(records: DataFrame, review: Column, date: str, documents: DataFrame) -> DataFrame:
    """One row: records, those to review, the latest date, and documents."""
    a = records.agg(F.count("*").alias("records"), F.count_if(review).alias("review"), F.max(date).alias("latest"))
    return a.crossJoin(documents.agg(F.count("*").alias("documents")))  # one row each


def without(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table does not have."""
    return rows.join(other.select(key), key, "left_anti")


def duplicates_by_hash(df: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """Rows whose content occurred before: each with the first row that had it.  The
    first rows are an aggregate that combines before its shuffle, so content that is
    very common (an empty text) does not meet in one task."""
    hashed = df.select(*keys, F.sha2(F.col(content), 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(*keys)).alias("_f"), F.count("*").alias("_n")).where("_n > 1")
    return hashed.join(first, "content_hash").where(F.struct(*keys) != F.col("_f")).select(*keys, "content_hash", *[F.col(f"_f.{k}").alias(f"first_{k}") for k in keys])


def batch_rollup(items: DataFrame, batch: str, state: str, done: set[str], failed: set[str], score: str, finished: str) -> DataFrame:
    """One row for each batch: items, counts by state, percent, finish time once all are done, label."""
    d, f = F.col(state).isin(sorted(done)), F.col(state).isin(sorted(failed))
    out = items.groupBy(batch).agg(
        F.count("*").alias("items"),
        F.count_if(d).alias("done"),
        F.count_if(f).alias("failed"),
        F.coalesce(F.sum(score), F.lit(0.0)).alias("work"),
        F.max(finished).alias("_last"),
        F.collect_set(state).alias("_states"),
    )
    terminal = F.size(F.array_except("_states", F.array(*[F.lit(s) for s in sorted(done | failed)]))) == 0
    label = F.when(terminal & (F.col("failed") == 0), "completed").when(terminal & (F.col("done") == 0), "failed").when(terminal, "completed_with_errors").otherwise("running")
    return out.select(batch, "items", "done", "failed", "work", F.bround(100.0 * (F.col("done") + F.col("failed")) / F.col("items")).cast("int").alias("percent"), F.when(terminal, F.col("_last")).alias("finished_at"), label.alias("label"))


def pages_since(pages: DataFrame, jobs: DataFrame, key: str, at: str, since: str) -> DataFrame:
    """For each job: its pages that changed at or after it began.  The equality
    partitions the join; the comparison is a residual predicate."""
    p = pages.select(F.col(key).alias("_k"), F.col(at).alias("_at"))
    return jobs.join(p, (F.col(key) == F.col("_k")) & (F.col("_at") >= F.col(since))).groupBy(key).agg(F.count("*").alias("pages"))


def item_views(items: DataFrame, documents: DataFrame, jobs: DataFrame, document: str, job: str) -> DataFrame:
    """Items with their documents and, where there is one, their job."""
    return items.join(documents, document).join(jobs, job, "left")


def calendar_rollup(df: DataFrame, date: str) -> DataFrame:
    """Counts by year, by month and in all, in one pass of grouping sets."""
    d = df.select(F.year(date).alias("year"), F.month(date).alias("month"))
    return d.rollup("year", "month").agg(F.count("*").alias("n"))


def numbered(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """Adds 1, 2, 3, ... in the given order, by ranges of it: see number_rows()."""
    return number_rows(df, order, name).withColumn(name, F.col(name).cast("int"))


def next_numbers(new: DataFrame, existing: DataFrame, number: str, prefix: str, start: int, order: list[Column]) -> DataFrame:
    """New rows with consecutive numbers after the largest of the prefix, see numbered()."""
    n = F.regexp_extract(number, rf"^{prefix}-([0-9]+)$", 1)
    last = existing.where(F.col(number).startswith(f"{prefix}-") & (n != "")).agg(F.coalesce(F.max(n.cast("long")), F.lit(start - 1)).alias("_last"))
    return numbered(new, "_n", order).join(F.broadcast(last)).withColumn(number, F.concat(F.lit(f"{prefix}-"), (F.col("_last") + F.col("_n")).cast("string"))).drop("_n", "_last")


def renumber(df: DataFrame, number: str, numeric: bool = False) -> DataFrame:
    """serial 1..N in the order of the number: as text, as a register has it, or numerically."""
    key = dedupe_key(F.col(number))
    head, tail = F.regexp_extract(key, "^(.*?)-?[0-9]*$", 1), F.regexp_extract(key, "([0-9]+)$", 1)
    if not numeric:
        return numbered(df, "serial", [key])
    return numbered(df, "serial", [head, F.try_to_number(tail, F.lit("9" * 18)).cast("long"), key])


def register_append(register: DataFrame, candidates: DataFrame, number: str) -> DataFrame:
    """The register with the candidates whose number it does not have; of equal candidates, the first by their columns."""
    held = register.select(dedupe_key(F.col(number)).alias("_k"))
    w = Window.partitionBy("_k").orderBy(*[F.col(c) for c in candidates.columns])
    fresh = candidates.withColumn("_k", dedupe_key(F.col(number))).join(held, "_k", "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_k", "_n")
    return register.unionByName(fresh)


def eligible(documents: DataFrame, jobs: DataFrame, records: DataFrame, exports: DataFrame, key: str, order: list[Column], status: str, wanted: str) -> DataFrame:
    """Documents whose latest job has the wanted status and that have a record and an export."""
    latest = latest_per_key(jobs, [key], order).where(F.col(status) == wanted)
    out = documents
    for other in (latest, records, exports):
        out = out.join(other.select(key), key, "left_semi")
    return out


def first_wins(df: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """Adds owner: whether a row is the first to hold its value."""
    return df.withColumn("owner", F.row_number().over(Window.partitionBy(value).orderBy(*order)) == 1)


def schedule_choice(items: DataFrame, batch: str, score: str, position: str, state: str, lanes: int) -> DataFrame:
    """The item of each batch that a free lane takes: the smallest by score and
    position, but with two lanes or more, something running and no long item in
    flight, the largest by both."""
    q, r = F.col(state) == "queued", F.col(state) == "running"
    key = F.struct(score, position)
    out = items.where(q | r).groupBy(batch).agg(
        F.min(F.when(q, key)).alias("small"),
        F.max(F.when(q, key)).alias("large"),
        F.median(score).alias("mid"),
        F.max(F.when(r, F.col(score))).alias("longest"),
        F.count_if(q).alias("queued"),
        F.count_if(r).alias("running"),
    )
    long_lane = F.lit(lanes >= 2) & (F.col("queued") > 1) & (F.col("running") > 0) & (F.col("longest") < F.col("mid"))
    return out.where("queued > 0").select(batch, F.when(long_lane, F.col("large")[position]).otherwise(F.col("small")[position]).alias("choice"))


def majority_language(words: DataFrame, key: str, language: str = "language") -> DataFrame:
    """The main language of each document by its words; two if both have over 15 %."""
    en = F.count_if(F.col(language).isin("en", "hi-en"))
    hi = F.count_if(F.col(language).isin("hi", "hi-en"))
    num, total = F.count_if(F.col(language) == "num"), F.count_if(F.col(language).isin("en", "hi", "num", "hi-en"))
    return _majority(words.groupBy(key).agg(en.alias("en"), hi.alias("hi"), num.alias("num"), total.alias("total")))


def text_languages(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same of texts whose words end at spaces and line feeds; counted within the text,
    without a row for each word.  Null text has no language."""
    latin, deva = "A-Za-z", r"\x{0900}-\x{097F}"
    having = lambda signs: F.sum(F.regexp_count(text, F.lit(rf"[{signs}][^ \n]*"))).cast("long")
    n = docs.where(F.col(text).isNotNull()).groupBy(key).agg(having(latin).alias("en"), having(deva).alias("hi"), having(latin + deva).alias("_words"), having(f"{latin}{deva}0-9").alias("total"))
    return _majority(n.withColumn("num", F.col("total") - F.col("_words")).select(key, "en", "hi", "num", "total"))


def _majority(n: DataFrame) -> DataFrame:
    e, h, m = F.col("en"), F.col("hi"), F.col("num")
    label = F.when(F.col("total") == 0, None).when((e > 0.15 * F.col("total")) & (h > 0.15 * F.col("total")), "HINDI/ENGLISH").when((e >= h) & (e >= m), "ENGLISH").when(h >= m, "HINDI").otherwise("NUMERICAL")
    return n.withColumn("majority", label)


def missing_pages(documents: DataFrame, pages: DataFrame, key: str, count: str, page: str) -> DataFrame:
    """Page numbers 1..count of each document that have no row."""
    wanted = documents.where(F.col(count) > 0).select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long"))).alias(page))
    return wanted.join(pages.select(key, F.col(page).cast("long").alias(page)), [key, page], "left_anti")


def stale_jobs(jobs: DataFrame, updated: str, now: Column, leases: DataFrame, key: str, after_s: int = 900) -> DataFrame:
    """Jobs without an update for so long whose lease is gone."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(updated).cast("timestamp"))) / 1e6
    return jobs.where(age >= after_s).withColumn("age_s", age).join(leases.select(key), key, "left_anti")


def keyed_upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows of changes in place of those with their keys.  Both sides
    are read once; null keys match each other."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_new", "_n")


def soft_delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table with is_deleted set where the keys are in gone."""
    mark = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    return table.join(mark, keys, "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")
