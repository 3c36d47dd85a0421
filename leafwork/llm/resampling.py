"""Target-distribution importance resampling (operator 13): partition-local word tries.

A feature is a run of 1 to ``most`` consecutive words; it falls in one of
``buckets`` by the CRC of its bytes.  An edge of a trie is a word and a node a
feature: a node's CRC state continues that of its parent, so a run costs the
bytes of its last word only.

1. Each task walks its texts through a trie whose nodes count their features,
   and adds the counts to its totals by bucket; these are summed over all tasks.
   A trie that reaches its budget of nodes is counted out and begun anew.
2. The gain of a bucket is the log-ratio of its smoothed shares in the target and
   in all documents.  The gains, one number a bucket, are broadcast.
3. Each task walks its texts through a trie again, whose nodes hold the gains of
   their buckets, and sums them to a document's weight.
4. The weight plus Gumbel noise hashed from the id is the score; the documents of
   largest scores are a draw without replacement in proportion to exp(weight).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import SQL_CRC_TABLE, cut, sql_crc
from leafwork.operators.numbering import number_rows
from leafwork.session import ship

#: Nodes of a trie, of some 300 bytes each, after which it is begun anew.
MOST_NODES = 1 << 18
#: Words of a text after which the budget is looked at.
PART = 1 << 16
#: Everything but letters, digits and bytes beyond ASCII becomes a space, and A-Z become small.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Run(dict):
    """A node of a word trie: the runs that continue it by their next word, the CRC
    state of its bytes, how often it was met, and the gain of its bucket."""

    __slots__ = ("state", "count", "gain", "trie")

    def __init__(self, trie: Trie, state: int):
        self.trie, self.state, self.count = trie, state, 0
        self.gain = trie.gains[state % len(trie.gains)] if trie.gains is not None else 0

    def __missing__(self, word: bytes) -> Run:
        self.trie.nodes += 1
        first = self is self.trie.root
        node = self[word] = Run(self.trie, zlib.crc32(word if first else b" " + word, self.state))
        return node


class Trie:
    """A trie of the word runs of texts, with the gains of buckets attached if they are given."""

    def __init__(self, most: int, gains: list[int] | None = None):
        self.most, self.gains = most, gains
        self.clear()

    def clear(self) -> None:
        self.nodes = 0
        self.root = Run(self, 0)

    def count(self, words: list[bytes], first: int, last: int) -> None:
        """Counts each run that begins at one of the words first..last-1 at its node."""
        root, most = self.root, self.most
        if most == 1:
            for word in words[first:last]:
                root[word].count += 1
            return
        for i in range(first, last):
            node = root
            for word in words[i : i + most]:
                node = node[word]
                node.count += 1

    def weight(self, words: list[bytes], first: int, last: int) -> tuple[int, int]:
        """(number of runs that begin there, sum of their gains)."""
        root, most = self.root, self.most
        if most == 1:
            return last - first, sum([root[word].gain for word in words[first:last]])
        n = total = 0
        for i in range(first, last):
            node = root
            for word in words[i : i + most]:
                node = node[word]
                n += 1
                total += node.gain
        return n, total

    def add_to(self, totals: np.ndarray) -> None:
        """Adds the counts of all nodes to the totals of their buckets."""
        states, counts, stack = [], [], [self.root]
        while stack:
            node = stack.pop()
            for child in node.values():
                states.append(child.state)
                counts.append(child.count)
                if child:
                    stack.append(child)
        np.add.at(totals, np.array(states, np.int64) % len(totals), np.array(counts, np.int64))


def _totals(most: int, buckets: int):
    """From texts: (bucket, n) of the features of a task."""

    def run(batches):
        import pyarrow as pa

        totals, trie = np.zeros(buckets, np.int64), Trie(most)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                for a in range(0, len(words), PART):
                    trie.count(words, a, min(a + PART, len(words)))
                    if trie.nodes > MOST_NODES:
                        trie.add_to(totals)
                        trie.clear()
        trie.add_to(totals)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], names=["bucket", "n"])

    return run


def _weights(most: int, gains):
    """From rows (text, ...): the other columns, n_words, n_features and weight."""

    def run(batches):
        import pyarrow as pa

        trie = Trie(most, gains.value)
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                words, n, weight = words_of(text), 0, 0
                for a in range(0, len(words), PART):
                    more, gain = trie.weight(words, a, min(a + PART, len(words)))
                    n, weight = n + more, weight + gain
                    if trie.nodes > MOST_NODES:
                        trie.clear()
                out.append((len(words), n, weight))
            new = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*batch.schema.names[1:], "n_words", "n_features", "weight"])

    return run


def bucket_totals(texts: DataFrame, text: str, most: int, buckets: int) -> list[int]:
    """How many features of all texts fall in each bucket; a sum of ``buckets`` numbers."""
    found = texts.select(F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(_totals(most, buckets), "bucket int, n long")
    totals = [0] * buckets
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[row["bucket"]] = row["n"]
    return totals


def gains_of(raw: list[int], target: list[int]) -> list[int]:
    """1000 times the log-ratio of each bucket's smoothed shares in target and raw, rounded down."""
    own, wanted = sum(raw) + len(raw), sum(target) + len(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(own) / (float(s + 1) * float(wanted)))) for s, t in zip(raw, target, strict=True)]


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate hashed from the seed and an id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row for each row of docs: its columns except ``text``, n_features, weight,
    score, and rank: 1, 2, 3, ... for the ``percent`` % of the documents with
    ``least_words`` words that are drawn, by falling score, null for the rest.

    docs and target have a column ``text``.  Words are runs of letters, digits and
    characters beyond ASCII, after A-Z are lower-cased.  Null and empty texts have no
    features and weight 0.  Very long texts are walked as a whole.  Null id: the noise
    of an empty id, last among equal scores.  Ties of score go to the smaller id;
    rows that share an id and a score are drawn in any order.  Repeated rows count as
    often as they occur.  Empty tables: an empty target has only smoothed shares, an
    empty docs an empty result.  Clashing columns of docs are replaced."""
    spark = docs.sparkSession
    ship(spark)
    new = {"n_features", "weight", "score", "rank"}
    keep = [c for c in docs.columns if c not in new | {text} and not c.startswith("_rs_")]
    if doc_id not in keep:
        raise ValueError(f"docs has no column {doc_id}")
    gains = gains_of(bucket_totals(docs, text, most, buckets), bucket_totals(target, text, most, buckets))
    held = spark.sparkContext.broadcast(gains)  # one number a bucket
    renamed = {c: f"_rs_{i}" for i, c in enumerate(keep)}
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in renamed.items())
    plain = docs.select(F.col(text).cast("string").cast("binary").alias("_rs_text"), *[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
    rows = plain.mapInArrow(_weights(most, held), f"{fields}, n_words long, n_features long, weight long")
    rows = cut(rows.withColumn("score", F.col("weight") + noise(F.col(renamed[doc_id]), seed)), "weights")
    enough = F.col("n_words") >= least_words
    n = rows.where(enough).count()
    numbered = number_rows(rows.where(enough), [F.desc("score"), F.asc_nulls_last(renamed[doc_id])], "rank")
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    out = numbered.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(*[F.col(v).alias(c) for c, v in renamed.items()], "n_features", "weight", "score", "rank")


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; the target is benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = rf"""
WITH {SQL_CRC_TABLE},
d AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
l AS (SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d),
o AS (SELECT side, id, unnest(ws) AS word FROM l),
v AS (SELECT word, {sql_crc('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM o), crcs),
f AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM o JOIN v USING (word) GROUP BY 1),
n AS (SELECT count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM o),
g AS (SELECT bucket, floor(1000 * ln((f.t + 1)::DOUBLE * (n.s + 10000)::DOUBLE / ((f.s + 1)::DOUBLE * (n.t + 10000)::DOUBLE)))::BIGINT AS gain FROM f, n),
w AS (SELECT id, sum(gain)::BIGINT AS weight FROM o JOIN v USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY 1),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM (SELECT id AS doc_id, ws FROM l WHERE side = 0) LEFT JOIN w ON w.id = doc_id),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= 20) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM r
"""
