"""Jobs as keyed state with timers on the clock.

A job's state moves with its events; each event sets a timer, and a job that stays
silent until then fails without another event, unless a lease says that a worker still
has it.  State and timers are kept in the RocksDB state store and so in the stream's
checkpoint: a stream that is restarted has them, and timers that ran out meanwhile fire
in its first batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafwork.operators.service import latest_per_key
from leafwork.session import ship

#: Terminal states, and how long a silent job is believed.
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
SILENCE_MS = 900_000
STATE = "status string, stage string, percent int, started_at timestamp, finished_at timestamp, updated_at timestamp, n_events long"
FIELDS = [f.split()[0] for f in STATE.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobProcessor(StatefulProcessor):
    """The state of one job: a value, the leases that workers hold on it, and a timer.

    silence_ms: how long it may be silent.  keep_ms: how long the state of a job stays
    after its last event, terminal ones included; an event after that begins a new job."""

    def __init__(self, silence_ms: int, keep_ms: int):
        self.silence_ms, self.keep_ms = silence_ms, max(keep_ms, 2 * silence_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE, self.keep_ms)
        self.leases = handle.getListState("leases", "worker string, until_ms long", self.keep_ms)

    def _row(self, key, held: list, failed: bool) -> pd.DataFrame:
        out = pd.DataFrame([[key[0], *held, failed]], columns=["job_id", *FIELDS, "timed_out"])
        for c in ("started_at", "finished_at", "updated_at"):
            out[c] = pd.to_datetime(out[c])
        return out

    def _set_timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = list(self.job.get()) if self.job.exists() else [None, None, 0, None, None, None, 0]
        events = pd.concat(list(rows)).sort_values(["ts", "percent"], na_position="first", kind="stable")
        for e in events[events.status.isna()].itertuples():
            if e.lease_s == e.lease_s and e.lease_s is not None:
                self.leases.appendValue((e.worker, now + int(1000 * e.lease_s)))
        for e in events[events.status.notna()].itertuples():
            held[6] += 1
            if held[0] in TERMINAL:
                continue
            at = e.ts.to_pydatetime()
            held[3] = held[3] if held[3] is not None else at if e.status == "PROCESSING" else None
            held[0], held[1], held[2], held[5] = e.status, e.stage, max(held[2] or 0, int(e.percent)), at
            if e.status in TERMINAL:
                held[4] = at
        if held[0] is None:  # leases of a job that has not begun
            return
        self.job.update(tuple(held))
        if held[0] in TERMINAL:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.leases.clear()
        else:
            self._set_timer(now + self.silence_ms)
        yield self._row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        held, now = list(self.job.get()), timerValues.getCurrentProcessingTimeInMs()
        if held[0] in TERMINAL:
            return
        leased = max((until for _, until in self.leases.get()), default=0)
        if leased > now:  # a worker still has it: it is looked at again when the lease ends
            self.handle.registerTimer(leased)
            return
        held[0], held[4] = "FAILED", pd.Timestamp(now, unit="ms").to_pydatetime()
        self.job.update(tuple(held))
        self.leases.clear()
        yield self._row(key, held, True)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, silence_ms: int = SILENCE_MS, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """The state of each job after each batch that changed it: job_id, status, stage,
    percent, started_at (of the first PROCESSING event), finished_at, updated_at, n_events,
    timed_out.

    events: job_id, ts, status, stage, percent, and worker and lease_s in rows without a
    status, which say that a worker has the job for so many seconds from now.  A job moves
    forward only, ends in a terminal state and stays there; percent never falls.  Events
    without a job_id are dropped.  Events of a batch come by ts, then percent.

    The session's state store becomes RocksDB, see use_rocksdb()."""
    spark = events.sparkSession
    ship(spark)
    use_rocksdb(spark)
    missing = {c: F.lit(None).cast(t).alias(c) for c, t in (("worker", "string"), ("lease_s", "double")) if c not in events.columns}
    kind = events.schema["job_id"].dataType.simpleString()
    rows = events.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "status", "stage", F.coalesce("percent", F.lit(0)).cast("int").alias("percent"), missing.get("worker", F.col("worker")), missing.get("lease_s", F.col("lease_s").cast("double")))
    return rows.where("job_id is not null").groupBy("job_id").transformWithStateInPandas(JobProcessor(silence_ms, keep_ms), f"job_id {kind}, {STATE}, timed_out boolean", "Update", "ProcessingTime")


def copy_to_documents(documents: DataFrame, jobs: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """The documents with the status of their last job, where states (job_id, status) have
    one that differs, and updated_at; jobs: job_id, document_id, created_at."""
    last = latest_per_key(jobs.select("document_id", "job_id", "created_at"), ["document_id"], [F.desc("created_at"), F.desc("job_id")])
    new = last.join(states.select("job_id", F.col("status").alias("_status")), "job_id").select("document_id", "_status")
    out = documents.join(new, "document_id", "left").withColumn("_new", F.col("_status").isNotNull() & ~F.col("_status").eqNullSafe(F.col("status")))
    return out.withColumns({"status": F.when(F.col("_new"), F.col("_status")).otherwise(F.col("status")), "updated_at": F.when(F.col("_new"), now).otherwise(F.col("updated_at"))}).select(*documents.columns)


def use_rocksdb(spark: SparkSession) -> None:
    """Streams with lists or timers in their state need this store.  It is a setting of the
    session: a stream that was begun with another store is restarted in a session of its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
