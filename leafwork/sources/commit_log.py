"""A log of numbered entries in a folder: the commits of a versioned table.

An entry is put in place by a rename that fails if it is there, so of two writers of one
number one succeeds.  Object stores whose connector copies instead of renaming do not
give that; there, writers must take turns."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    """Entries below ``root``, of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self.fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def put(self, name: str, value: dict) -> bool:
        """Puts a named value in place at once; False if there is one already."""
        if self.fs.exists(self._path(name)):
            return False
        new = self._path(f".{uuid.uuid4().hex}")
        out = self.fs.create(new, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self._conf)
        none = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(new), context.makeQualified(self._path(name)), none)
        except Exception as e:
            self.fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def get(self, name: str) -> dict | None:
        if not self.fs.exists(self._path(name)):
            return None
        source = self.fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def last(self) -> int:
        """The number of the last entry; 0 before the first."""
        if not self.fs.exists(self._path("")):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return max((int(n[:10]) for n in names if n[:10].isdigit()), default=0)

    def commit(self, number: int, entry: dict) -> bool:
        return self.put(f"{number:010d}.json", entry)

    def entry(self, number: int) -> dict:
        found = self.get(f"{number:010d}.json")
        if found is None:
            raise KeyError(f"no entry {number} in {self.root}")
        return found
