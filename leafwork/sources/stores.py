"""Stores of files by their URI: local folders, object stores, any file system that
Spark reaches.  The scheme chooses the connector; nothing else differs."""

from __future__ import annotations

import hashlib
import hmac
import mimetypes
import uuid
from datetime import UTC, datetime
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from leafwork.session import ship
from leafwork.sources.uploads import safe_join


def resolve(root: str) -> str:
    """The URI of a store: a plain path is a local folder, s3 is read by its Hadoop
    connector, and an object store needs a bucket."""
    if "://" not in root:
        return "file://" + (root if root.startswith("/") else f"/{root}")
    scheme, _, rest = root.partition("://")
    scheme = {"s3": "s3a", "s3n": "s3a"}.get(scheme, scheme)
    if scheme in {"s3a", "gs", "abfs", "abfss"} and not rest.split("/")[0]:
        raise ValueError(f"{root} names no bucket")
    return f"{scheme}://{rest.rstrip('/')}"


def presigned(host: str, path: str, key: str, secret: str, region: str, seconds: int, now: datetime) -> str:
    """An address of an object that anyone may get for some seconds, by the public fourth
    version of the signature: its query is signed with a key derived from day, region and service."""
    at = now.strftime("%Y%m%dT%H%M%SZ")
    scope = f"{at[:8]}/{region}/s3/aws4_request"
    fields = {"X-Amz-Algorithm": "AWS4-HMAC-SHA256", "X-Amz-Credential": f"{key}/{scope}", "X-Amz-Date": at, "X-Amz-Expires": str(seconds), "X-Amz-SignedHeaders": "host"}
    query = "&".join(f"{k}={quote(v, safe='')}" for k, v in sorted(fields.items()))
    request = "\n".join(["GET", quote(path), query, f"host:{host}", "", "host", "UNSIGNED-PAYLOAD"])
    signed = "\n".join(["AWS4-HMAC-SHA256", at, scope, hashlib.sha256(request.encode()).hexdigest()])
    own = f"AWS4{secret}".encode()
    for part in scope.split("/"):
        own = hmac.new(own, part.encode(), hashlib.sha256).digest()
    return f"https://{host}{quote(path)}?{query}&X-Amz-Signature={hmac.new(own, signed.encode(), hashlib.sha256).hexdigest()}"


class Store:
    """Files below a root; paths that would leave it are refused."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, resolve(root)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def url_for(self, path: str) -> str:
        scheme, _, rest = self.root.partition("://")
        return f"{scheme}://{safe_join(rest or '/', path)}" if path else self.root

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.url_for(path))

    def write(self, path: str, data: bytes) -> str:
        """Puts a file in place of the one that is there: it is written beside it and then
        renamed, so readers see one or the other where the file system renames at once."""
        place = self._at(path)
        new = self._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(new), context.makeQualified(place), options)
        return path

    def address(self, path: str, seconds: int = 3600, key: str = "", secret: str = "", region: str = "us-east-1", endpoint: str | None = None) -> str:
        """Where a client gets a file: below /files for folders, a signed address that ends
        after some seconds for buckets."""
        scheme, _, rest = self.url_for(path).partition("://")
        if scheme != "s3a":
            return "/files/" + quote(self.url_for(path)[len(self.root) :].lstrip("/"))
        bucket, _, name = rest.partition("/")
        host, place = (f"{bucket}.s3.{region}.amazonaws.com", f"/{name}") if endpoint is None else (endpoint, f"/{bucket}/{name}")
        return presigned(host, place, key, secret, region, seconds, datetime.now(UTC))

    def read(self, path: str) -> bytes:
        rows = self.spark.read.format("binaryFile").load(self.url_for(path)).select("content").head(1)
        if not rows:
            raise FileNotFoundError(path)
        return bytes(rows[0]["content"])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._at(path), False)

    def delete_prefix(self, path: str) -> bool:
        """Deletes a folder with all that is in it; the root itself stays."""
        if self.url_for(path) == self.root:
            raise ValueError("the root of a store is not deleted")
        return self._fs.delete(self._at(path), True)

    def mime_type(self, path: str) -> str:
        return mimetypes.guess_type(path)[0] or "application/octet-stream"

    def put_all(self, files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
        """(path, size, error) after writing each row's bytes, by the executors; a file
        that cannot be written is a row with its error.  Null content is skipped."""
        ship(self.spark)
        root = self.root.replace("s3a://", "s3://", 1)

        def run(batches):
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(root)
            for pdf in batches:
                out = []
                for p, data in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                    try:
                        place = safe_join(base, p)
                        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                        with system.open_output_stream(place) as f:
                            f.write(data)
                        out.append((p, len(data), None))
                    except Exception as e:  # noqa: BLE001  kept as a row
                        out.append((p, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["path", "size", "error"]).astype({"size": "Int64"})

        return files.where(files[content].isNotNull()).select(path, content).mapInPandas(run, "path string, size long, error string")
