"""Batches of documents: the life of their items as transitions of whole tables.

An item has item_id, batch_id, document_id, processing_job_id, position, state,
priority_score, attempts, error_message and claimed_at; a batch has batch_id and
started_at.  Each function returns the table after the transition; what it does
not concern stays as it is, so each may be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.text import duration_seconds
from leafwork.operators.service import schedule_choice

# States, what a job's end means for its item, and how long a claim counts before its lease does.
TERMINAL = ["completed", "failed", "cancelled", "duplicate"]
JOB_STATES = {"COMPLETED": "completed", "FAILED": "failed", "CANCELLED": "cancelled"}
CLAIM_GRACE_S = 120
LEASE_S = 600


def _marked(items: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """items with _on, whether their key is in chosen."""
    mark = chosen.select(key).distinct().withColumn("_on", F.lit(True))
    return items.join(mark, key, "left").withColumn("_on", F.coalesce("_on", F.lit(False)))


def _set(df: DataFrame, when: Column, **values) -> DataFrame:
    """df with columns set where ``when`` holds."""
    return df.withColumns({c: F.when(when, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def add_files(batches: DataFrame, items: DataFrame, files: DataFrame, documents: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """Checks new files (batch_id, document_id, document_hash, file_size_bytes,
    priority_score, ordinal) against their batch: adds position, state and refused.

    A batch that began takes none; one takes ``most_files`` files and ``most_bytes``
    bytes of documents; a file whose content a document holds already is a duplicate
    of it, with no work to do.  Files of a batch are taken in order of ordinal."""
    from pyspark.sql import Window

    held = items.join(documents.select("document_id", F.col("file_size_bytes").alias("_b")), "document_id").groupBy("batch_id").agg(F.count("*").alias("_n"), F.coalesce(F.sum("_b"), F.lit(0)).alias("_bytes"))
    known = documents.where(~F.col("is_deleted")).groupBy("document_hash").agg(F.min("document_id").alias("_same"))
    f = files.join(batches.select("batch_id", "started_at"), "batch_id", "left").join(held, "batch_id", "left").join(known, "document_hash", "left")
    w = Window.partitionBy("batch_id").orderBy("ordinal")
    at = F.coalesce("_n", F.lit(0)) + F.row_number().over(w) - 1
    total = F.coalesce("_bytes", F.lit(0)) + F.sum("file_size_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    refused = F.when(F.col("started_at").isNotNull(), "started").when(at >= most_files, "too many files").when(total > most_bytes, "too many bytes")
    duplicate = F.col("_same").isNotNull()
    out = f.withColumn("position", at.cast("int")).withColumn("refused", refused)
    out = out.withColumn("state", F.when(refused.isNull(), F.when(duplicate, "duplicate").otherwise("pending")))
    out = out.withColumn("document_id", F.coalesce("_same", "document_id")).withColumn("priority_score", F.when(duplicate, 0.0).otherwise(F.col("priority_score")))
    return out.drop("_n", "_bytes", "_same", "started_at")


def batch_bytes(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(batch_id, bytes) of the documents of each batch."""
    met = items.select("batch_id", "document_id").join(documents.select("document_id", "file_size_bytes"), "document_id", "left")
    return met.groupBy("batch_id").agg(F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes"))


def start(batches: DataFrame, items: DataFrame, chosen: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(batches, items): pending items of chosen batches that have not begun are
    queued; of batches that have, and of those without items, nothing changes."""
    some = items.select("batch_id").distinct().join(chosen.select("batch_id"), "batch_id", "left_semi")
    fresh = batches.where("started_at is null").select("batch_id").join(some, "batch_id", "left_semi")
    queued = _set(_marked(items, fresh, "batch_id"), F.col("_on") & (F.col("state") == "pending"), state="queued").drop("_on")
    return _set(_marked(batches, fresh, "batch_id"), F.col("_on"), started_at=now).drop("_on"), queued


def revert_start(batches: DataFrame, items: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, items): chosen batches have not begun, and their queued items are pending."""
    back = _set(_marked(items, chosen, "batch_id"), F.col("_on") & (F.col("state") == "queued"), state="pending").drop("_on")
    return _set(_marked(batches, chosen, "batch_id"), F.col("_on"), started_at=F.lit(None).cast("timestamp")).drop("_on"), back


def sync(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items take over the end of their job (job_id, status, error_message); one that has ended stays."""
    j = jobs.select(F.col("job_id").alias("processing_job_id"), F.col("status").alias("_status"), F.col("error_message").alias("_error"))
    ends = F.create_map(*[F.lit(x) for kv in JOB_STATES.items() for x in kv])
    met = items.join(j, "processing_job_id", "left").withColumn("_to", F.try_element_at(ends, "_status"))
    moves = F.col("_to").isNotNull() & ~F.col("state").isin(TERMINAL)
    error = F.when(F.col("_to") == "failed", F.coalesce(F.nullif("_error", F.lit("")), F.lit("Processing failed"))).otherwise(F.col("error_message"))
    return met.withColumn("error_message", F.when(moves, error).otherwise(F.col("error_message"))).withColumn("state", F.when(moves, F.col("_to")).otherwise(F.col("state"))).drop("_status", "_error", "_to")


def cancel(items: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, requests): waiting items of chosen batches are cancelled; requests has
    the document_id of running ones, whose pages stop at the next check."""
    met = _marked(items, chosen, "batch_id")
    requests = met.where(F.col("_on") & (F.col("state") == "running")).select("document_id").distinct()
    return _set(met, F.col("_on") & F.col("state").isin("pending", "queued"), state="cancelled").drop("_on"), requests


def without_cancelled(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages that may still be worked on; asked before each micro-batch."""
    return pages.join(requests.select("document_id"), "document_id", "left_anti")


def retry(items: DataFrame, documents: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, refused): chosen (item_id, new_job_id) failed or cancelled items whose
    document is there are queued with a new job; refused has item_id and why."""
    new = chosen.select("item_id", F.col("new_job_id").alias("_job"))
    there = documents.where(~F.col("is_deleted")).select("document_id").distinct().withColumn("_there", F.lit(True))
    met = items.join(new, "item_id", "left").join(there, "document_id", "left")
    asked, may = F.col("_job").isNotNull(), F.col("state").isin("failed", "cancelled")
    ok = asked & may & F.coalesce("_there", F.lit(False))
    why = F.when(~may, "not failed or cancelled").when(F.col("_there").isNull(), "no document")
    refused = met.where(asked & why.isNotNull()).select("item_id", why.alias("reason"))
    unknown = new.join(items.select("item_id"), "item_id", "left_anti").select("item_id", F.lit("no item").alias("reason"))
    met = met.withColumn("_ok", ok)
    out = _set(met, F.col("_ok"), processing_job_id=F.col("_job"), state="queued", error_message=F.lit(None).cast("string"), claimed_at=F.lit(None).cast("timestamp"))
    return out.drop("_job", "_there", "_ok"), refused.union(unknown)


def busy_documents(items: DataFrame, live: DataFrame, now: Column, grace_s: int = CLAIM_GRACE_S) -> DataFrame:
    """Documents being worked on: those with a lease and those claimed a moment ago."""
    recent = items.where((F.col("state") == "running") & (F.col("claimed_at") >= now - F.make_dt_interval(secs=F.lit(grace_s))))
    return live.select("document_id").union(recent.select("document_id")).distinct()


def claim(items: DataFrame, live: DataFrame, now: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """(items, outcomes): each batch with queued items claims one, as schedule_choice
    has it, while the host has free lanes; batches are served in order of their id.
    outcomes has batch_id, outcome (claimed, no_capacity or empty) and item_id."""
    free = max(0, limit - busy_documents(items, live, now).count())
    at = items.withColumn("_at", F.struct("position", "item_id"))
    choice = schedule_choice(at, "batch_id", "priority_score", "_at", "state", limit).select("batch_id", F.col("choice.item_id").alias("_item"))
    served = choice.orderBy("batch_id").limit(free).withColumn("_served", F.lit(True))
    outcomes = items.select("batch_id").distinct().join(choice, "batch_id", "left").join(served.select("batch_id", "_served"), "batch_id", "left")
    outcome = F.when(F.col("_item").isNull(), "empty").when(F.col("_served").isNull(), "no_capacity").otherwise("claimed")
    outcomes = outcomes.select("batch_id", outcome.alias("outcome"), F.when(F.col("_served").isNotNull(), F.col("_item")).alias("item_id"))
    mine = served.select(F.col("_item").alias("item_id"))
    out = _set(_marked(items, mine, "item_id"), F.col("_on"), state="running", claimed_at=now, attempts=(F.coalesce("attempts", F.lit(0)) + 1).cast("int"), error_message=F.lit(None).cast("string"))
    return out.drop("_on"), outcomes


def labels(batches: DataFrame, items: DataFrame) -> DataFrame:
    """(batch_id, label): uploading, processing, completed, cancelled or completed_with_errors."""
    state = F.col("state")
    n = items.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(~state.isin(TERMINAL)).alias("open"), F.count_if(state.isin("completed", "duplicate")).alias("good"), F.count_if(state == "cancelled").alias("gone"))
    m = batches.select("batch_id", "started_at").join(n, "batch_id", "left").fillna(0, ["n", "open", "good", "gone"])
    label = F.when(F.col("started_at").isNull(), "uploading").when(F.col("open") > 0, "processing").when(F.col("good") == F.col("n"), "completed").when(F.col("gone") == F.col("n"), "cancelled").otherwise("completed_with_errors")
    return m.select("batch_id", label.alias("label"))


def item_reads(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items as they are shown: percent is 100 for completed ones and else their
    job's, the error is their own or their failed job's, and the time their job took."""
    j = jobs.select(F.col("job_id").alias("processing_job_id"), F.col("status").alias("_status"), F.col("error_message").alias("_error"), "progress_percent", "started_at", "finished_at")
    met = items.join(j, "processing_job_id", "left")
    percent = F.when(F.col("state") == "completed", 100).otherwise(F.coalesce("progress_percent", F.lit(0))).cast("int")
    error = F.coalesce(F.nullif("error_message", F.lit("")), F.when(F.col("_status") == "FAILED", F.col("_error")))
    return met.select("item_id", "batch_id", "document_id", "position", "state", percent.alias("percent"), error.alias("error_message"), F.round("priority_score", 4).alias("priority_score"), F.coalesce("attempts", F.lit(0)).alias("attempts"), duration_seconds(F.col("started_at"), F.col("finished_at")).alias("duration_s"))


def leases(held: DataFrame, requests: DataFrame, now: Column, ttl_s: int = LEASE_S) -> DataFrame:
    """The leases (document_id, token, expires_at) after requests (document_id, token,
    action, ordinal), of which each document has one a round: acquire takes a lease that
    is free or has run out, of several requests the first; renew prolongs and release
    ends one's own lease only."""
    first = requests.groupBy("document_id").agg(F.min_by(F.struct("token", "action"), "ordinal").alias("_r"))
    met = held.where(F.col("expires_at") > now).join(first, "document_id", "full")
    own, action = F.col("_r.token") == F.col("token"), F.col("_r.action")
    takes = (action == "acquire") & F.col("token").isNull()
    keeps = F.col("token").isNotNull() & ~F.coalesce((action == "release") & own, F.lit(False))
    until = F.when(takes | F.coalesce((action == "renew") & own, F.lit(False)), now + F.make_dt_interval(secs=F.lit(ttl_s))).otherwise(F.col("expires_at"))
    return met.where(takes | keeps).select("document_id", F.when(takes, F.col("_r.token")).otherwise(F.col("token")).alias("token"), until.alias("expires_at"))


def run_rounds(items: DataFrame, work: Callable[[DataFrame], DataFrame], now: Callable[[], Column], limit: int, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Claims and works in rounds until no batch has a queued item: ``work`` takes the
    claimed items (item_id, document_id, processing_job_id) and returns their jobs
    (job_id, status, error_message), a job for each.  ``store`` writes the items of a
    round and reads them back, so a round that is lost is taken up from there.  An item
    whose job did not end is failed, so every round has fewer queued items."""
    none = items.where("false").select("document_id")
    while True:
        items = store(claim(items, none, now(), limit)[0])
        claimed = items.where("state = 'running'")
        if not claimed.head(1):
            return items
        jobs = work(claimed.select("item_id", "document_id", "processing_job_id"))
        items = sync(items, jobs)
        lost = F.col("state") == "running"
        items = store(_set(items.withColumn("_lost", lost), F.col("_lost"), error_message="Processing was lost", state="failed").drop("_lost"))
