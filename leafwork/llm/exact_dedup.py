"""Exact duplicates (operator 12): Patricia-trie owners.

1. Each task inserts the full byte strings of its texts in a compressed radix
   trie; a terminal holds the smallest (or largest) identifier and the number of
   rows of its string, so copies leave a task once.  When the trie outgrows its
   budget, whole subtrees are spilled: their terminals go on and their nodes are
   freed, so memory is bounded; a string seen again later is merged downstream.
2. Terminals are dealt to partitions by length and content hash, in order of
   length, hash and bytes.  There they are inserted in a trie again, led by their
   length and hash: in that order all subtrees but the last path are complete, so
   a trie that reaches its budget is spilled as final owners.
3. Owners are joined to the rows by length and hash, and also by the text itself
   for keys under which the tries found more than one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import MOST_SMALL, cut, join_hot
from leafwork.session import ship

#: Bytes of labels and nodes that a task's trie may hold before it spills.
TRIE_BYTES = 64 << 20
#: Bytes that a node counts beside its label.
NODE_BYTES = 400
#: Bytes of strings in an output batch, about.
BATCH_BYTES = 8 << 20


class Node:
    """A node of a compressed trie: the bytes of the edge that leads to it, its
    children by their first byte, and, at the end of a string, its owner and count."""

    __slots__ = ("label", "children", "owner", "count")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.count = label, {}, None, 0


def shared(a: bytes, b: bytes) -> int:
    """The length of the common prefix, by halving, so that bytes are compared in runs."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Patricia:
    """A compressed radix trie of byte strings with owners at its terminals."""

    def __init__(self, largest: bool = False):
        self.root, self.held, self.better = Node(b""), 0, max if largest else min

    def insert(self, text: bytes, owner, count: int = 1) -> None:
        """Adds a string; null owners give way to others."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.held += len(child.label) + NODE_BYTES
                node = child
                break
            n = len(child.label)
            if not text.startswith(child.label, at):
                n = shared(child.label, text[at : at + n])
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = child = upper
                self.held += NODE_BYTES
            node, at = child, at + n
        if not node.count or node.owner is None:
            node.owner = owner
        elif owner is not None:
            node.owner = self.better(node.owner, owner)
        node.count += count

    def terminals(self, node: Node | None = None) -> Iterator[tuple[bytes, object, int]]:
        """(string, owner, count) of the whole trie, or of a child of its root, in order of the strings."""
        stack = [(node or self.root, b"")]
        while stack:
            at, path = stack.pop()
            path += at.label
            if at.count:
                yield path, at.owner, at.count
            stack += [(at.children[c], path) for c in sorted(at.children, reverse=True)]

    def spill(self) -> Iterator[tuple[bytes, object, int]]:
        """Takes the subtrees below the root out, one after the other, until half of the budget is left."""
        for first in list(self.root.children):
            if self.held <= TRIE_BYTES // 2:
                return
            child = self.root.children.pop(first)
            for text, owner, count in self.terminals(child):
                yield text, owner, count
            stack = [child]
            while stack:
                at = stack.pop()
                self.held -= len(at.label) + NODE_BYTES
                stack += at.children.values()


def _emit(rows: Iterator[tuple], kind) -> Iterator:
    """Arrow batches of (length, hash, text, owner, count), of bounded bytes."""
    import pyarrow as pa

    names = ["length", "hash", "string", "owner", "copies"]
    held, size = [], 0

    def out():
        columns = list(zip(*held, strict=True))
        kinds = [pa.int64(), pa.binary(), pa.binary(), kind, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += len(row[2] or b"") + 100
        if size > BATCH_BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _local(largest: bool, digest):
    """From rows (text, id): the terminals of the tries of a task."""

    def run(batches):
        kind = None

        def rows():
            nonlocal kind
            trie = Patricia(largest)
            for batch in batches:
                kind = batch.column(1).type
                for text, owner in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    trie.insert(text or b"", owner)
                    if trie.held > TRIE_BYTES:
                        for t, o, c in trie.spill():
                            yield len(t), digest(t), t, o, c
            for t, o, c in trie.terminals():
                yield len(t), digest(t), t, o, c

        for batch in _emit_late(rows(), lambda: kind):
            yield batch

    return run


def _emit_late(rows: Iterator[tuple], kind) -> Iterator:
    """_emit for rows whose type of identifiers is known with the first of them."""
    first = next(rows, None)
    if first is not None:
        from itertools import chain

        yield from _emit(chain([first], rows), kind())


def _owners(largest: bool, size: int):
    """From terminals in order of length, hash (of ``size`` bytes) and string: one row for each
    string with its owner and count; the string itself only where its length and hash are another's too."""

    def run(batches):
        kind = None

        def strings():
            """(length, hash, string, owner, count) in order, each string once."""
            nonlocal kind
            trie, last = Patricia(largest), b""
            for batch in batches:
                kind = batch.column(3).type
                for length, digest, text, owner, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    path = length.to_bytes(8, "big") + digest + text
                    if trie.held > TRIE_BYTES and path != last:
                        # what comes next is beyond every string so far: all subtrees are complete
                        yield from map(parts, trie.terminals())
                        trie = Patricia(largest)
                    trie.insert(path, owner, count)
                    last = path
            yield from map(parts, trie.terminals())

        def parts(terminal):
            path, owner, count = terminal
            return int.from_bytes(path[:8], "big"), path[8 : 8 + size], path[8 + size :], owner, count

        def rows():
            before, now = None, None
            for following in strings():
                if now:
                    yield _final(before, now, following)
                before, now = now, following
            if now:
                yield _final(before, now, None)

        yield from _emit_late(rows(), lambda: kind)

    return run


def _final(before, now, following) -> tuple:
    """A string's row, with the string only if a neighbour has its length and hash."""
    twin = any(other is not None and other[:2] == now[:2] for other in (before, following))
    return (*now[:2], now[2] if twin else None, *now[3:])


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", largest: bool = False, bits: int = 256) -> DataFrame:
    """One row for each row of docs: its columns except ``text``, keep_id (the
    smallest or ``largest`` id of the rows with an equal text), group_size, kept and
    text_sha256.

    Texts are equal if their bytes are; null counts as empty, and empty texts are
    equal to each other.  Very long texts are compared as a whole; a trie with one
    that exceeds its budget spills at once.  Null ids give way to others; of a group
    with null ids only, keep_id is null and all rows are kept.  Ties: rows that share
    a text and the id that stays are kept together.  Empty table: empty result.
    Clashing columns of docs are replaced.

    bits: those of the content hash that are used.  Results do not depend on it,
    as equal hashes of unlike texts are told apart by the texts."""
    ship(docs.sparkSession)
    new = {"keep_id", "group_size", "kept", "text_sha256"}
    keep = [c for c in docs.columns if c not in new | {text} and not c.startswith("_xd_")]
    if doc_id not in keep:
        raise ValueError(f"docs has no column {doc_id}")
    kind = docs.schema[doc_id].dataType.simpleString()
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    size = max(1, bits // 8)
    fields = f"length long, hash binary, string binary, owner {kind}, copies long"
    local = docs.select(whole.alias("t"), F.col(doc_id).alias("i")).mapInArrow(_local(largest, lambda t: hashlib.sha256(t).digest()[:size]), fields)
    dealt = local.repartition("length", "hash").sortWithinPartitions("length", "hash", "string")
    owners = cut(dealt.mapInArrow(_owners(largest, size), fields), "owners")

    sha = F.sha2(whole, 256)
    key = {"_xd_length": F.octet_length(whole).cast("long"), "_xd_hash": F.substring(F.unhex(sha), 1, size)}
    known = owners.select(F.col("length").alias("_xd_length"), F.col("hash").alias("_xd_hash"), F.col("string").alias("_xd_string"), F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"))
    total, twins = known.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count("_xd_string")).first()
    plain = known.where("_xd_string is null").drop("_xd_string")
    rows = docs.select(*keep, sha.alias("text_sha256"), *[c.alias(n) for n, c in key.items()], *([whole.alias("_xd_string")] if twins else []))
    out = join_hot(rows, plain.hint("merge"), list(key), "group_size", total, "text_sha256" if not keep else F.struct(doc_id)).drop("_xd_string")
    if twins:
        # keys of several strings: only their rows carry texts
        held = known.where("_xd_string is not null")
        keys = held.select(*key).distinct()
        few = keys.count() <= MOST_SMALL
        some = rows.join(F.broadcast(keys) if few else keys, list(key), "leftsemi")
        out = out.unionByName(join_hot(some, held, [*key, "_xd_string"], "group_size", total, F.struct(doc_id)).drop("_xd_string"))
    kept = F.coalesce(F.col(doc_id) == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select(*keep, "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; of equal texts the largest id stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_duplicates(docs, largest=True)


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
