"""Byte-level BPE (operator 7): corpus-level merge replay.

A task takes its texts in runs of some megabytes, finds their distinct
pre-tokens and lays all of those out as one sequence of byte tokens.  An
inverted index from the rank of a token pair to its places applies every merge
to all its places at once, in rank order, and updates only the neighbours that
a merge touched.  Texts then look their pre-tokens up.  Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import slices
from leafwork.session import ship

NONE = np.int32(2**31 - 1)
#: Bytes of text whose pre-tokens are merged together.
RUN_BYTES = 8 << 20


def load_ranks(path: str) -> bytes:
    """The rank file as it is; read on the driver, so executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def _in_order(at: np.ndarray) -> np.ndarray:
    """The distinct places in order."""
    if len(at) < 2:
        return at
    at = np.sort(at)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


class Encoder:
    """Ranks, the pre-token pattern and the table of token pairs that merge."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        lines = (x.split() for x in ranks.splitlines() if x)
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.vocabulary = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get = self.ranks.get
        pairs = []
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = get(t[:i]), get(t[i:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, r))
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.made = np.append(pairs[:, 0], np.int64(2**63 - 1)), np.append(pairs[:, 1], int(NONE)).astype(np.int32)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each word begins (and the last one ends)."""
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(tok)
        if not n:
            return tok, np.zeros(len(words) + 1, np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends_ = ends[size > 0]
        after[ends_ - 1] = n  # n: a place beyond all words
        before[(ends - size)[size > 0]] = -1
        alive = np.ones(n + 1, bool)
        alive[n] = False
        tok = np.append(tok, 0)
        rank = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(after < n)
        rank[inner] = self.pair_ranks(tok[inner], tok[after[inner]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray) -> None:
            r = rank[places]
            places, r = places[r < NONE], r[r < NONE]
            if not len(r):
                return
            if len(r) == 1:
                order, cuts = places, [0, 1]
                firsts = r.tolist()
            else:
                by = np.argsort(r, kind="stable")
                order, r = places[by], r[by]
                cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
                firsts = r[cuts[:-1]].tolist()
            for k, first in enumerate(firsts):
                if first not in index:
                    index[first] = []
                    heapq.heappush(heap, first)
                index[first].append(order[cuts[k] : cuts[k + 1]])

        add(inner)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            at = _in_order(at)
            follow = after[at]
            if len(at) > 1 and (at[np.minimum(np.searchsorted(at, follow), len(at) - 1)] == follow).any():
                at = self._leftmost(at, follow)
                follow = after[at]
            behind = after[follow]
            tok[at] = r
            alive[follow] = False
            rank[follow] = NONE
            after[at] = behind
            inside = behind < n
            before[behind[inside]] = at[inside]
            left = before[at]
            touched = np.concatenate((at, left[left >= 0]))
            touched = _in_order(touched)
            nxt = after[touched]
            rank[touched] = np.where(nxt < n, self.pair_ranks(tok[touched], tok[nxt]), NONE)
            add(touched)
        keep = alive[:n]
        kept = np.concatenate(([0], np.cumsum(keep)))
        return tok[:n][keep], np.concatenate(([0], kept[ends]))

    @staticmethod
    def _leftmost(at: np.ndarray, follow: np.ndarray) -> np.ndarray:
        """Of overlapping places of one pair, every one that the place before it does not use up."""
        out, used = [], -1
        for p, f in zip(at.tolist(), follow.tolist(), strict=True):
            if p != used:
                out.append(p)
                used = f
        return np.array(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text begins (and the last one ends)."""
        place: defaultdict[str, int] = defaultdict(count().__next__)  # a new pre-token gets the next number
        used, per_text = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.find(text)
            per_text[i] = len(found)
            used.append(np.fromiter(map(place.__getitem__, found), np.int32, len(found)))
        words = [w.encode() for w in place]
        whole = [self.ranks.get(w) for w in words]
        todo = [w for w, r in zip(words, whole, strict=True) if r is None]
        ids, begin = self.replay(todo)
        # the ids of each word: those of the replay, or a whole token beyond them
        known = np.array([r for r in whole if r is not None], np.int32)
        is_known = np.array([r is not None for r in whole], bool)
        first, length = np.empty(len(words), np.int64), np.ones(len(words), np.int64)
        first[~is_known], length[~is_known] = begin[:-1], np.diff(begin)
        first[is_known] = len(ids) + np.arange(len(known))
        ids = np.concatenate((ids, known))
        use = np.concatenate(used) if used else np.empty(0, np.int32)
        n = length[use]
        stop = np.cumsum(n)
        flat = ids[np.repeat(first[use] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        stops = np.concatenate(([0], stop))
        return flat.astype(np.int32), np.concatenate(([0], stops[np.cumsum(per_text)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


def _fields(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema.fields)


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """The columns of docs except ``text``, and ids (array of int).

    Null and empty texts have no ids.  A text longer than RUN_BYTES is a run of its
    own.  Of equal ranks at once, places are merged from left to right.  Every row is encoded by itself, so
    repeated rows get equal ids; empty table: empty result; a column ids of
    docs is replaced."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # of the vocabulary's size

    def run(batches):
        import pyarrow as pa

        own = encoder(*held.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for a, b in slices(texts, RUN_BYTES):
                flat, offsets = own.encode(texts[a:b])
                rest = batch.slice(a, b - a)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], ids], names=[*rest.schema.names[1:], "ids"])

    keep = [c for c in docs.columns if c not in {text, "ids"}]
    return docs.select(F.col(text).cast("string").alias("_bpe_text"), *keep).mapInArrow(run, _fields(docs, keep) + "ids array<int>")


def decode(docs: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """The columns of docs and decoded (binary), the bytes of its ids; null ids: no bytes.  A column decoded of docs is replaced."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches):
        import pyarrow as pa

        own = encoder(*held.value)
        for batch in batches:
            found = [own.decode(x or []) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], names=[*batch.schema.names[1:], "decoded"])

    keep = [c for c in docs.columns if c != "decoded"]
    return docs.select(F.col(ids).alias("_bpe_ids"), *keep).mapInArrow(run, _fields(docs, keep) + "decoded binary")


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes each text, decodes its ids and digests both, in one pass of one
    worker a task: the columns of docs except ``text``, n_tokens, ids_sha256 (of
    the ids as little-endian unsigned 32-bit integers), decoded_sha256 and, if
    keep_ids, ids.  Rows are treated as by encode(); clashing columns are replaced."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        own = encoder(*held.value)
        for batch in batches:
            column = batch.column(0)
            sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
            for a, b in _runs(sizes, RUN_BYTES):
                flat, at = own.encode([x or "" for x in column.slice(a, b - a).to_pylist()])
                flat = flat.astype("<u4")
                parts = [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                found = [
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array([hashlib.sha256(p.tobytes()).hexdigest() for p in parts], pa.string()),
                    pa.array([hashlib.sha256(own.decode(p.tolist())).hexdigest() for p in parts], pa.string()),
                ]
                if keep_ids:
                    found.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32))))
                rest = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], *found], names=[*rest.schema.names[1:], *new])

    keep = [c for c in docs.columns if c not in {text, *new}]
    kinds = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>"] if keep_ids else [])]
    return docs.select(F.col(text).cast("string").alias("_bpe_text"), *keep).mapInArrow(run, _fields(docs, keep) + ", ".join(kinds))


def _runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Splits rows of the given sizes into runs of about ``most`` bytes."""
    ends, out, first = np.cumsum(sizes), [], 0
    while first < len(sizes):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most, "right")))
        out.append((first, last))
        first = last
    return out


def public_ranks() -> tuple[bytes, str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, *public_ranks()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
