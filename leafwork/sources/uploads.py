"""Files as they arrive: checks by name, size and first bytes, in DataFrame expressions.

Only files that pass the cheap checks reach a decoder."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.text import content_hash, sanitize_filename

# Accepted extensions, their types and first bytes.
TYPES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "webp": "image/webp"}
MAGIC = {"pdf": ["255044462D"], "png": ["89504E470D0A1A0A"], "jpg": ["FFD8FF"], "jpeg": ["FFD8FF"], "tif": ["49492A00", "4D4D002A"], "tiff": ["49492A00", "4D4D002A"], "bmp": ["424D"], "webp": ["52494646"]}
MOST_MB = 500


def read_files(spark, path: str) -> DataFrame:
    """path, content and length of every file below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length")


def sniff(ext: Column, content: Column) -> Column:
    """Whether the first bytes are those of the extension's type."""
    head, ok = F.hex(F.substring(content, 1, 8)), F.lit(False)
    for e, heads in MAGIC.items():
        for m in heads:
            ok = ok | ((ext == e) & head.startswith(m))
    return ok


def pdf_pages(content: Column) -> Column:
    """How many pages the root of a PDF's page tree counts, of several the largest; null
    where the tree is packed away in object streams.  Counts of outlines are none of it."""
    objects = F.filter(F.split(F.decode(content, "ISO-8859-1"), "endobj"), lambda o: o.rlike(r"/Type\s*/Pages(?![A-Za-z])"))
    # an object's text begins at its last "obj", as what precedes it in the file may be anything
    roots = F.filter(F.transform(objects, lambda o: F.element_at(F.split(o, r"\bobj\b"), -1)), lambda o: ~o.rlike(r"/Parent(?![A-Za-z])"))
    return F.array_max(F.transform(roots, lambda o: F.nullif(F.regexp_extract(o, r"/Count\s+(\d{1,7})", 1), F.lit("")).cast("int")))


def validate(files: DataFrame, most_mb: int = MOST_MB) -> DataFrame:
    """Adds filename, extension, mime_type, document_hash, page_count (1 for images) and
    reject_reason (null if the file is accepted).  A PDF whose trailer is encrypted is
    refused, as is one without pages."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    size = F.coalesce(F.length("content"), F.lit(0))
    mime = F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), ext)
    pdf = (ext == "pdf") & sniff(ext, F.col("content"))
    locked = pdf & F.coalesce(F.decode("content", "ISO-8859-1").rlike(r"/Encrypt\s*(?:\d+\s+\d+\s+R|<<)"), F.lit(False))
    pages = F.when(pdf, pdf_pages(F.col("content"))).when(ext.isin(list(TYPES)) & (ext != "pdf"), 1)
    reason = F.when(~ext.isin(list(TYPES)), "extension").when(size == 0, "empty").when(size > most_mb * 1024 * 1024, "too large").when(~sniff(ext, F.col("content")), "content").when(locked, "encrypted").when(pdf & (pages == 0), "no pages")
    return files.select("*", sanitize_filename(name).alias("filename"), ext.alias("extension"), mime.alias("mime_type"), content_hash(F.col("content")).alias("document_hash"), pages.alias("page_count"), reason.alias("reject_reason"))


def safe_join(root: str, *parts: str) -> str:
    """A path below root; refuses one that would leave it."""
    base = posixpath.normpath(root)
    path = posixpath.normpath(posixpath.join(base, *parts))
    if path != base and not path.startswith(base.rstrip("/") + "/"):
        raise ValueError("the path leaves its root")
    return path
