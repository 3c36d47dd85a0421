"""Progress of documents as a data source: batches of events that streams write and read.

A folder holds, for each batch, files of events dealt by document, and an entry that
names them.  Files are written by tasks under names of their own; the entry is put in
place when all are there, so a batch is seen as a whole or not at all.  A batch that is
run again after a failure finds its entry and adds nothing.  A reader's offset is the
number of a batch, so what was read is read again alike.

    events.writeStream.format("progress").option("path", ...)
    spark.readStream.format("progress").option("path", ...).option("document", "7")

The folder has one writing stream; any number may read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from leafwork.session import ship

EVENT = "document_id string, job_id string, status string, stage string, percent int, message string, at_ms long"
NAMES = [f.split()[0] for f in EVENT.split(", ")]
#: Parts that the events of a batch are dealt to by document.
PARTS = 16


def part_of(document: str | None) -> int:
    import zlib

    return zlib.crc32((document or "").encode()) % PARTS


class _Folder:
    """The files and entries below a path, on any file system that Arrow reaches."""

    def __init__(self, path: str):
        from pyarrow import fs

        if "://" not in path:
            path = f"file://{path}"
        self.fs, self.base = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        self.base = self.base.rstrip("/")

    def entries(self) -> list[int]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.base}/_entries", allow_not_found=True))
        return sorted(int(f.base_name[:12]) for f in found if f.base_name.endswith(".json"))

    def entry(self, batch: int) -> dict:
        with self.fs.open_input_stream(self._entry(batch)) as f:
            return json.loads(f.read())

    def _entry(self, batch: int) -> str:
        return f"{self.base}/_entries/{batch:012d}.json"

    def commit(self, batch: int, files: dict[str, str]) -> bool:
        """Puts a batch's entry in place; False if it is there."""
        if batch in self.entries():
            return False
        self.fs.create_dir(f"{self.base}/_entries", recursive=True)
        new = f"{self.base}/_entries/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(new) as f:
            f.write(json.dumps(files).encode())
        self.fs.move(new, self._entry(batch))
        return True

    def write(self, rows: list[tuple]) -> str:
        name = f"events-{uuid.uuid4().hex}.jsonl"
        self.fs.create_dir(self.base, recursive=True)
        with self.fs.open_output_stream(f"{self.base}/{name}") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        return name

    def read(self, name: str) -> Iterator[tuple]:
        with self.fs.open_input_stream(f"{self.base}/{name}") as f:
            for line in f.read().decode().splitlines():
                yield tuple(json.loads(line))

    def drop(self, names: list[str]) -> None:
        from pyarrow import fs

        for n in names:
            if self.fs.get_file_info(f"{self.base}/{n}").type != fs.FileType.NotFound:
                self.fs.delete_file(f"{self.base}/{n}")


@dataclass
class _Files(InputPartition):
    names: list[str]


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[int, str]]


class ProgressSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "progress"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options, [f.name for f in schema.fields])


class _Reading:
    def __init__(self, options: dict):
        self.path, self.document = options["path"], options.get("document")

    def files(self, after: int, last: int) -> list[_Files]:
        """One partition for each part of the batches after one and up to another; of one
        document, its part alone."""
        folder = _Folder(self.path)
        parts: dict[str, list[str]] = {}
        for n in folder.entries():
            if after < n <= last:
                for part, names in folder.entry(n).items():
                    if self.document is None or int(part) == part_of(self.document):
                        parts.setdefault(part, []).extend(names)
        return [_Files(names) for _, names in sorted(parts.items(), key=lambda x: int(x[0]))] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        folder = _Folder(self.path)
        for name in partition.names:
            for row in folder.read(name):
                if self.document is None or row[0] == self.document:
                    yield row


class _Batch(_Reading, DataSourceReader):
    """All events so far, or those of the option ``document``.  Filters are left to Spark: it
    keeps what a reader took over for later queries on the same DataFrame, which need not have the filter."""

    def partitions(self) -> Sequence[_Files]:
        return self.files(-1, 1 << 62)


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"batch": -1}

    def latestOffset(self) -> dict:
        return {"batch": max(_Folder(self.path).entries(), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[_Files]:
        return self.files(start["batch"], end["batch"])

    def commit(self, end: dict) -> None:
        """What was read stays for other readers."""


class _Writer(DataSourceStreamWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        missing = {"document_id"} - set(columns)
        if missing:
            raise ValueError("events need a document_id")

    def write(self, iterator: Iterator) -> _Written:
        folder, parts = _Folder(self.path), {}
        for row in iterator:
            value = row.asDict()
            out = [None if value.get(n) is None else int(value[n]) if n in ("percent", "at_ms") else str(value[n]) for n in NAMES]
            parts.setdefault(part_of(out[0]), []).append(out)
        return _Written([(p, folder.write(rows)) for p, rows in parts.items()])

    def commit(self, messages: list, batchId: int) -> None:
        folder, files = _Folder(self.path), {}
        for m in messages:
            for part, name in m.files if m else []:
                files.setdefault(str(part), []).append(name)
        if not folder.commit(batchId, files):
            folder.drop([n for names in files.values() for n in names])  # the batch was committed before

    def abort(self, messages: list, batchId: int) -> None:
        _Folder(self.path).drop([name for m in messages if m for _, name in m.files])


def register_source(spark: SparkSession) -> None:
    """Makes the format "progress" known."""
    ship(spark)
    spark.dataSource.register(ProgressSource)
