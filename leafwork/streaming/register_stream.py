"""The register as a stream's sink: finished documents are appended once by number.

Numbers that were seen are keyed state, filled from the stored register when the stream
begins, so a batch costs what the batch holds and not what the register holds.  Each
batch's rows are a part of the register, named by a numbered entry of its log.  What
other writers have added since this stream began is known by their entries; a batch is
held against those before it is committed, so two writers never add one number twice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafwork.functions.text import dedupe_key
from leafwork.session import ship
from leafwork.sources.commit_log import CommitLog
from leafwork.streaming.job_states import use_rocksdb


class Register:
    """A register of rows below ``root``: parts of Parquet and a log that names them."""

    def __init__(self, spark: SparkSession, root: str, schema: str, number: str = "number"):
        self.spark, self.root, self.schema, self.number = spark, root.rstrip("/"), schema, number
        self.log = CommitLog(spark, f"{self.root}/_log")

    def rows(self, after: int = 0, without: str | None = None) -> DataFrame:
        """The register's rows; those of entries after a number, and of other writers than one, if given."""
        entries = [self.log.entry(n) for n in range(after + 1, self.log.last() + 1)]
        paths = [f"{self.root}/{e['part']}" for e in entries if e["part"] and e["writer"] != without]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def append(self, rows: DataFrame, writer: str, batch: int, start: int, attempts: int = 20) -> bool:
        """Commits a batch of a writer that began at entry ``start``, once: a batch that the
        writer has committed before is left out.  Rows whose number another writer has added
        since then are dropped.  False if there was nothing to do."""
        key = dedupe_key(F.col(self.number))
        for _ in range(attempts):
            last = self.log.last()
            entries = [self.log.entry(n) for n in range(start + 1, last + 1)]
            if any(e["writer"] == writer and e["batch"] == batch for e in entries):
                return False
            others = self.rows(start, writer).select(key.alias("_k"))
            fresh = rows.withColumn("_k", key).join(others, "_k", "left_anti").drop("_k") if any(e["writer"] != writer and e["part"] for e in entries) else rows
            part = f"part-{last + 1:010d}-{writer[:12]}-{batch}"
            fresh.write.mode("overwrite").parquet(f"{self.root}/{part}")
            if self.log.commit(last + 1, {"writer": writer, "batch": batch, "part": part}):
                return True
        raise RuntimeError("other writers were always faster")


class FirstOf(StatefulProcessor):
    """Of the rows of a number the first ever, by the columns of ``order``; none if it was seen."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        self.seen.update((True,))
        first = None
        for batch in rows:
            held = batch if first is None else pd.concat([first, batch])
            first = held.sort_values(self.order, kind="stable").head(1)
        yield first.drop(columns="_k", errors="ignore")

    def close(self) -> None:
        pass


def append_register(events: DataFrame, register: Register, checkpoint: str, order: list[str]):
    """Starts a stream that appends what is there now of finished documents (the register's
    columns) to it.  Of equal numbers, without regard to case and outer spaces, the first by
    ``order`` is added, unless the register has the number; a null number is never added.
    A batch that is run again after a failure adds nothing twice."""
    spark = events.sparkSession
    ship(spark)
    use_rocksdb(spark)
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()
    register.log.put(f"writer-{writer[:32]}.json", {"start": register.log.last()})
    start = register.log.get(f"writer-{writer[:32]}.json")["start"]
    key = dedupe_key(F.col(register.number))
    known = _until(register, start).select(key.alias("_k")).where("_k is not null").distinct().groupBy("_k")
    rows = events.select("*", key.alias("_k")).where("_k is not null")
    fresh = rows.groupBy("_k").transformWithStateInPandas(FirstOf(order), register.schema, "Append", "None", known)
    return fresh.writeStream.foreachBatch(lambda df, batch: register.append(df, writer, batch, start) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _until(register: Register, last: int) -> DataFrame:
    """The rows of the entries up to a number."""
    entries = [register.log.entry(n) for n in range(1, last + 1)]
    paths = [f"{register.root}/{e['part']}" for e in entries if e["part"]]
    return register.spark.read.schema(register.schema).parquet(*paths) if paths else register.spark.createDataFrame([], register.schema)
