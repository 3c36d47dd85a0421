"""Streams with keyed state: jobs that fail by the clock, and the register."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafwork.streaming import job_states as J
from leafwork.streaming.register_stream import Register, append_register

EVENT = "job_id long, ts timestamp, status string, stage string, percent int, worker string, lease_s double"
NOW = datetime(2024, 5, 1, 12, 0, 0)


def put(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def event(job, status, percent=0, minute=0, stage="OCR"):
    return (job, NOW + timedelta(minutes=minute), status, stage, percent, None, None)


def lease(job, seconds):
    return (job, NOW, None, None, None, "w1", seconds)


def start(spark, folder, checkpoint, out, silence_ms):
    events = spark.readStream.schema(EVENT).parquet(folder)
    states = J.job_states(events, silence_ms)
    write = lambda df, _: df.write.mode("append").parquet(out)
    return states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start()


def rows_of(spark, out):
    try:
        return spark.read.parquet(out).collect()
    except Exception:  # noqa: BLE001  nothing is written yet
        return []


def wait_for(spark, out, rule, seconds=90):
    until = time.time() + seconds
    while time.time() < until:
        found = [r for r in rows_of(spark, out) if rule(r)]
        if found:
            return found
        time.sleep(0.5)
    raise AssertionError(f"not within {seconds} s: {rows_of(spark, out)}")


def test_a_silent_job_fails_by_the_clock(spark, tmp_path):
    """No event follows; a job with a lease outlives one without; finished jobs stay as they are."""
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, folder, [event(1, "QUEUED"), event(1, "PROCESSING", 30, 1), event(2, "PROCESSING", 50), event(2, "COMPLETED", 100, 2), event(2, "PROCESSING", 10, 3), event(3, "PROCESSING", 5), lease(3, 25.0), lease(4, 5.0)])
    q = start(spark, folder, f"{tmp_path}/cp", out, 2000)
    try:
        failed = wait_for(spark, out, lambda r: r.timed_out and r.job_id == 1)[0]
        three = wait_for(spark, out, lambda r: r.timed_out and r.job_id == 3)[0]
    finally:
        q.stop()
    first = {r.job_id: r for r in rows_of(spark, out) if not r.timed_out}
    assert (failed.status, failed.percent, failed.started_at, failed.n_events) == ("FAILED", 30, NOW + timedelta(minutes=1), 2)
    assert (first[2].status, first[2].percent, first[2].n_events, first[2].finished_at) == ("COMPLETED", 100, 3, NOW + timedelta(minutes=2))
    assert three.finished_at > failed.finished_at + timedelta(seconds=5) and set(first) == {1, 2, 3}
    assert not [r for r in rows_of(spark, out) if r.timed_out and r.job_id == 2]


def test_timers_outlive_a_restart(spark, tmp_path):
    folder, out, cp = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    put(spark, folder, [event(7, "PROCESSING", 40)])
    q = start(spark, folder, cp, out, 4000)
    try:
        wait_for(spark, out, lambda r: r.job_id == 7)
    finally:
        q.stop()
    time.sleep(5)
    assert not [r for r in rows_of(spark, out) if r.timed_out]
    q = start(spark, folder, cp, out, 4000)
    try:
        failed = wait_for(spark, out, lambda r: r.timed_out)[0]
    finally:
        q.stop()
    assert (failed.job_id, failed.status, failed.percent, failed.n_events) == (7, "FAILED", 40, 1)


def test_states_are_copied_to_documents(spark):
    documents = spark.createDataFrame([(1, "QUEUED", None), (2, "QUEUED", None), (3, "COMPLETED", None)], "document_id long, status string, updated_at timestamp")
    jobs = spark.createDataFrame([(10, 1, 1), (11, 1, 2), (20, 2, 1), (30, 3, 1)], "job_id long, document_id long, created_at long")
    states = spark.createDataFrame([(10, "FAILED"), (11, "PROCESSING"), (30, "COMPLETED")], "job_id long, status string")
    got = {r.document_id: (r.status, r.updated_at is not None) for r in J.copy_to_documents(documents, jobs, states, F.lit(NOW)).collect()}
    assert got == {1: ("PROCESSING", True), 2: ("QUEUED", False), 3: ("COMPLETED", False)}


ROW = "number string, title string, at int"


def finished(spark, folder, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(folder)


def run(spark, register, folder, checkpoint):
    q = append_register(spark.readStream.schema(ROW).parquet(folder), register, checkpoint, ["at", "title"])
    q.awaitTermination()


def titles(register):
    return sorted((r.number, r.title) for r in register.rows().collect())


def test_the_register_takes_each_number_once(spark, tmp_path):
    register = Register(spark, f"file://{tmp_path}/register", ROW)
    assert register.append(spark.createDataFrame([("D-1", "kept", 0)], ROW), "by hand", 0, 0)
    folder, cp = f"{tmp_path}/in", f"{tmp_path}/cp"
    finished(spark, folder, [("d-1 ", "again", 1), ("D-2", "later", 9), (" d-2", "first", 3), ("D-3", "b", 1), ("D-3", "a", 1), (None, "no number", 1)])
    run(spark, register, folder, cp)
    assert titles(register) == [(" d-2", "first"), ("D-1", "kept"), ("D-3", "a")]
    finished(spark, folder, [("D-3", "again", 0), ("D-4", "new", 1)])
    run(spark, register, folder, cp)
    assert titles(register) == [(" d-2", "first"), ("D-1", "kept"), ("D-3", "a"), ("D-4", "new")]
    # nothing new: nothing is added; a batch that is given again is left out
    last = register.log.last()
    run(spark, register, folder, cp)
    entry = register.log.entry(last)
    assert register.log.last() == last and not register.append(spark.createDataFrame([("D-9", "x", 0)], ROW), entry["writer"], entry["batch"], 1)


def test_two_writers_never_add_one_number_twice(spark, tmp_path, monkeypatch):
    register = Register(spark, f"file://{tmp_path}/register", ROW)
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    finished(spark, a, [("D-1", "a1", 1)])
    finished(spark, b, [("D-1", "b1", 1), ("D-2", "b2", 1)])
    run(spark, register, a, f"{tmp_path}/cpa")
    append = Register.append
    done = []

    def late(self, rows, writer, batch, begun, attempts=20):
        # another writer commits while this batch is on its way
        if not done:
            done.append(1)
            append(Register(spark, self.root, ROW), spark.createDataFrame([("D-2", "third", 1)], ROW), "third", 0, 0)
        return append(self, rows, writer, batch, begun, attempts)

    monkeypatch.setattr(Register, "append", late)
    run(spark, register, b, f"{tmp_path}/cpb")
    assert titles(register) == [("D-1", "a1"), ("D-2", "third")]
    # the first writer's state knows nothing of the others' numbers, but its commit does
    finished(spark, a, [("D-2", "a2", 1), ("D-3", "a3", 1)])
    run(spark, register, a, f"{tmp_path}/cpa")
    assert titles(register) == [("D-1", "a1"), ("D-2", "third"), ("D-3", "a3")]


def test_events_without_a_job_and_leases_alone_are_no_jobs(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, folder, [(None, NOW, "PROCESSING", "OCR", 1, None, None), event(5, "PROCESSING", 7), event(5, "PROCESSING", 3), lease(9, 1.0)])
    q = start(spark, folder, f"{tmp_path}/cp", out, 60_000)
    try:
        got = wait_for(spark, out, lambda r: True)
    finally:
        q.stop()
    assert [(r.job_id, r.status, r.percent) for r in got] == [(5, "PROCESSING", 7)]


@pytest.fixture(autouse=True)
def own_store(spark):
    """Other tests' streams keep the default store."""
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
