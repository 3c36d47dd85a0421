"""Sharding (operator 2): size-tiered compaction, native.

A store is a folder of immutable shards (Parquet files) and of manifests.
Arrivals are appended as small shards.  Compaction groups shards by size tier
and merges each run of similar size into one file of about the target size; it reads
and writes whole files by DataFrame jobs without a shuffle.  A manifest lists
the segments of one version, and a segment some thousand shards; segments are
immutable, so a commit writes those that changed and the list of their names.  A
manifest is written beside its place and put there by a rename that fails if that
version exists, so a reader sees one version or the next, and of two writers one
must start again; on object stores whose connector copies instead of renaming,
writers must take turns.  The driver holds names and sizes of files, never rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm.common import scratch_dir

#: Bytes of a finished shard; a tier holds shards of up to FAN times the size of the one below; runs that are merged have FAN shards at least.
TARGET_BYTES, FAN = 64 << 20, 4
#: Runs that one job merges; a bound on the size of a plan.
RUNS_A_JOB = 128
#: Shards that a segment of a manifest lists at most; segments of less than a quarter of it are joined when there are as many as this share.
SEGMENT, SMALL_SEGMENTS = 4096, 16


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    tier: int


def tier_of(size: int, target: int = TARGET_BYTES, fan: int = FAN) -> int:
    """0 for finished shards, and one more for each factor ``fan`` below that."""
    return max(0, math.ceil(math.log(target / 2 / max(size, 1), fan)))


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """Append, compact and read the versions of one table."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target, fan
        self.jvm = spark.sparkContext._jvm
        self.hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.hadoop)
        self._known: dict[str, list[Shard]] = {}  # segments that were read or written; they never change

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    # ------------------------------------------------------------- manifests
    def versions(self) -> list[int]:
        where = self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _json(self, path: str) -> dict:
        stream = self.fs.open(self._path(path))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, path: str, value: dict):
        place = self._path(path)
        out = self.fs.create(place, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        return place

    def segments(self, version: int) -> list[str]:
        """The names of the segments that a version lists."""
        return self._json(f"{self.root}/manifests/{version:020d}.json")["segments"] if version else []

    def segment(self, name: str) -> list[Shard]:
        if name not in self._known:
            self._known[name] = [Shard(**s) for s in self._json(f"{self.root}/segments/{name}")["shards"]]
        return self._known[name]

    def manifest(self, version: int | None = None) -> tuple[int, str | None, list[Shard]]:
        """(version, schema, shards); version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, None, []
        found = self._json(f"{self.root}/manifests/{version:020d}.json")
        return version, found["schema"], [s for name in found["segments"] for s in self.segment(name)]

    def commit(self, base: int, schema: str, shards: list[Shard]) -> int:
        """Puts version base + 1 in place, or raises Conflict if it is there.  Segments of the
        version before whose shards all stay are taken over; only the others are written."""
        rest = {s.path: s for s in shards}
        kept = [name for name in self.segments(base) if base in self.versions() and all(rest.get(s.path) == s for s in self.segment(name))]
        small = [name for name in kept if len(self.segment(name)) < SEGMENT // 4]
        if len(small) >= SMALL_SEGMENTS:
            kept = [name for name in kept if name not in small]
        for name in kept:
            for s in self.segment(name):
                del rest[s.path]
        new, left = [], list(rest.values())
        for at in range(0, len(left), SEGMENT):
            name = f"{uuid.uuid4().hex}.json"
            self._write(f"{self.root}/segments/{name}", {"shards": [asdict(s) for s in left[at : at + SEGMENT]]})
            self._known[name] = left[at : at + SEGMENT]
            new.append(name)
        folder = f"{self.root}/manifests"
        final = self._path(f"{folder}/{base + 1:020d}.json")
        temporary = self._write(f"{folder}/.{uuid.uuid4().hex}.tmp", {"schema": schema, "segments": [*kept, *new]})
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.hadoop)
        try:
            # without OVERWRITE this fails if the version exists
            context.rename(temporary, final, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(temporary, False)
            for name in new:
                self.fs.delete(self._path(f"{self.root}/segments/{name}"), False)
            if base + 1 in self.versions():
                raise Conflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    # ---------------------------------------------------------------- writes
    def _files(self, folder: str) -> list[Shard]:
        out, todo = [], self.fs.listFiles(self._path(folder), True)
        while todo.hasNext():
            s = todo.next()
            if s.getPath().getName().endswith(".parquet"):
                out.append(Shard(s.getPath().toString(), s.getLen(), tier_of(s.getLen(), self.target, self.fan)))
        return sorted(out, key=lambda s: s.path)

    def append(self, df: DataFrame, arrival: str | None = None, then: Callable[[], object] = lambda: None) -> int:
        """Writes the rows as new small shards and commits them.  With the name
        of a column ``arrival``, each of its values is an arrival with shards and
        a version of its own: one job writes them all, and they are committed one
        after the other in order of their folders' names.  ``then`` runs after
        each commit.  Returns the last version.

        Rows are kept as they are, nulls, repeated ones and long texts included; rows whose
        arrival is null are one arrival.  An empty df is a version with nothing new."""
        folder, part = f"{self.root}/shards/{uuid.uuid4().hex}", f"arrival_{uuid.uuid4().hex}"
        writer = df.withColumn(part, F.col(arrival)).write.partitionBy(part) if arrival else df.write
        writer.parquet(folder)
        arrivals: dict[str, list[Shard]] = {}
        for s in self._files(folder):
            arrivals.setdefault(s.path.rsplit("/", 1)[0], []).append(s)
        version = 0
        for _, new in sorted(arrivals.items()) or [("", [])]:
            version = self._retry(lambda shards, new=new: [*shards, *new], df.schema.json())
            then()
        return version

    def _retry(self, change, schema: str | None) -> int:
        while True:
            version, held, shards = self.manifest()
            if held and schema and held != schema:
                raise ValueError("the rows have another schema than the store")
            try:
                return self.commit(version, held or schema, change(shards))
            except Conflict:
                continue

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of shards of one tier, in order of size, to be merged: each as long
        as the target size allows, the last of a tier FAN shards at least."""
        runs = []
        for tier in sorted({s.tier for s in shards if s.tier}, reverse=True):
            alike, run, size = sorted((s for s in shards if s.tier == tier), key=lambda s: (s.size, s.path)), [], 0
            for s in alike:
                if len(run) > 1 and size + s.size > self.target:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.size
            if len(run) >= self.fan:
                runs.append(run)
        return runs

    def compact(self) -> int:
        """Merges until no tier has a run to merge; returns the version.

        A job merges up to RUNS_A_JOB runs: a task for each reads the run's files
        and writes one.  Each job commits a version, so a driver that is lost
        costs one job.  Shards that another version lists stay as they are until
        vacuum()."""
        while True:
            version, schema, shards = self.manifest()
            runs = self.plan(shards)[:RUNS_A_JOB]
            if not runs:
                return version
            folder = f"{self.root}/shards/{uuid.uuid4().hex}"
            tasks = [self.read_shards(run, schema).coalesce(1) for run in runs]
            with self._apart():
                reduce(DataFrame.union, tasks).write.parquet(folder)
            # a merged run is above its tier even if its file came out small
            made = [Shard(s.path, s.size, min(s.tier, runs[self._task(s.path)][0].tier - 1)) for s in self._files(folder)]
            gone = {s.path for run in runs for s in run}
            now = self._retry(lambda held, gone=gone, new=made: self._replace(held, gone, new), None)
            assert now > version

    @contextmanager
    def _apart(self):
        """Within it, the union of single partitions is as many partitions, and not one of them all."""
        conf, name = self.spark.conf, "spark.sql.unionOutputPartitioning"
        old = conf.get(name, None)
        conf.set(name, "false")
        try:
            yield
        finally:
            conf.unset(name) if old is None else conf.set(name, old)

    @staticmethod
    def _task(path: str) -> int:
        """The number of the task that wrote a file."""
        return int(path.rsplit("/", 1)[1].split("-")[1])

    @staticmethod
    def _replace(held: list[Shard], gone: set[str], new: list[Shard]) -> list[Shard]:
        if not gone <= {s.path for s in held}:
            raise RuntimeError("another writer merged the same shards")
        return [*[s for s in held if s.path not in gone], *new]

    def vacuum(self, keep_versions: int = 1) -> None:
        """Deletes manifests but the last ones, and segments and shards that those do not list.  Not for use while a writer runs."""
        versions = self.versions()
        keep = versions[-keep_versions:]
        listed = {s.path for v in keep for s in self.manifest(v)[2]}
        for v in versions[:-keep_versions]:
            self.fs.delete(self._path(f"{self.root}/manifests/{v:020d}.json"), False)
        names = {name for v in keep for name in self.segments(v)}
        where = self._path(f"{self.root}/segments")
        for s in self.fs.listStatus(where) if self.fs.exists(where) else []:
            if s.getPath().getName() not in names:
                self.fs.delete(s.getPath(), False)
        if self.fs.exists(self._path(f"{self.root}/shards")):
            for s in self._files(f"{self.root}/shards"):
                if s.path not in listed:
                    self.fs.delete(self._path(s.path), False)

    # ----------------------------------------------------------------- reads
    def read_shards(self, shards: list[Shard], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards]) if shards else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        _, schema, shards = self.manifest(version)
        if schema is None:
            raise ValueError("the store is empty")
        return self.read_shards(shards, schema)


def shard_table(df: DataFrame, root: str, arrival: str | None = None, target: int = TARGET_BYTES, keep_versions: int = 2) -> DataFrame:
    """Appends df to the store at root, by arrivals, with a compaction after each;
    then deletes what the last ``keep_versions`` versions do not list.  Returns
    the rows of the last one.

    Nulls, repeated rows, long texts and any columns are kept as they are; an
    empty table makes a version without rows.  With ``arrival``, rows whose
    value is null are an arrival of their own."""
    store = ShardStore(df.sparkSession, root, target)
    store.append(df, arrival, store.compact)
    store.vacuum(keep_versions)
    return store.read()


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Every row of documents, from the store it was sharded to in eight arrivals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.withColumn("arrival", F.coalesce(F.pmod("doc_id", F.lit(8)), F.lit(0)).cast("int"))
    out = shard_table(rows, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex[:12]}", "arrival")
    return out.select("doc_id", "lang", "source", "n_chars", "arrival", F.sha2("text", 256).alias("text_sha256"))


OP2_SQL = "SELECT doc_id, lang, source, n_chars, coalesce(doc_id % 8, 0)::INTEGER AS arrival, sha256(text) AS text_sha256 FROM documents"
