"""A training-data pipeline over documents: five stages of the operators in leafwork.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet and reads it as the next stage's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import bpe, mixing, near_dedup, pii, quality_classifier
from leafwork.llm.common import Scope, cut, drop_table, join_small, scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts have the score of the bias.  Very long texts are scored as
    a whole.  A score equal to the threshold stays.  Repeated rows share a fate.
    Empty table: empty result.  Columns beyond the documents' are dropped."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs.select(*COLUMNS), model, keep_text=True).where("predicted = 1").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the
    smallest id; of its near copies with that id, the first by its other columns.

    Each row is a node of its own, numbered once as the rows are written, so rows that
    share an id but not a text are documents of their own, and no two rows are taken for
    one.  Rows of null id stay as they are.  Of the rows of an id with equal texts
    without words, null or not, one stays.  Ties of all columns are equal rows, of which
    one stays.  Very long texts are compared as a whole.  Empty table: empty result.
    Columns beyond the documents' are dropped."""
    rows = cut(docs.select(*COLUMNS).where("doc_id is not null").withColumn("_node", F.monotonically_increasing_id()), "numbered")
    with Scope(spark) as scope:
        found = near_dedup.near_duplicates(rows.select("doc_id", "text", "_node"), doc_id="_node")
        found = scope.keep(cut(found.select("doc_id", "_node", "n_shingles", "component_id"), "components"))
    # the winners are sought without texts, which are looked at only where an id is tied with itself
    first = found.where("n_shingles > 0").groupBy("component_id").agg(F.min("doc_id").alias("doc_id"))
    ahead = found.join(first, ["component_id", "doc_id"]).groupBy("component_id").agg(F.min("_node").alias("_node"), F.count("*").alias("n"))
    ahead = cut(ahead, "ahead")
    winners = ahead.where("n = 1").select("_node")
    tied = cut(found.join(first, ["component_id", "doc_id"]).join(ahead.where("n > 1").select("component_id"), "component_id").select("component_id", "_node"), "tied")
    if tied.head(1):
        rest = join_small(rows, tied, ["_node"]).groupBy("component_id").agg(F.min_by("_node", F.struct("text", "lang", "source", "n_chars", "_node")).alias("_node"))
        winners = winners.union(rest.select("_node"))
    # winners grow with the rows, so this is a merge join at any size and never a broadcast
    kept = rows.join(winners.hint("merge"), "_node", "leftsemi")
    wordless = join_small(rows, found.where("n_shingles = 0").select("_node"), ["_node"], "leftsemi")
    wordless = wordless.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("x")).select("doc_id", "text", "x.*")
    return kept.select(*COLUMNS).unionByName(wordless).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds, and n_chars follows.

    Null text stays null, with n_chars null; empty text stays empty.  Very long texts
    are read as a whole.  Of overlapping spans the first is replaced and the rest of
    the other dropped.  Repeated rows each stay.  Empty table: empty result.  Columns
    beyond the documents' are dropped."""
    found = pii.extract_pii(docs.select(*COLUMNS, F.col("text").alias("whole")))
    text = pii.mask_spans(F.col("whole"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to reach the sources' weights, and shuffled.

    Null source: a source of its own.  Null id: drawn as an empty id.  Null, empty and
    very long texts are carried along.  Repeated rows have equal counts.  Ties of the
    shuffle's key come in any order.  Empty table: empty result.  Columns beyond the
    documents' are dropped."""
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and digests of them and of what they decode to.

    Null and empty texts have no ids.  Very long texts are encoded as a whole.
    Repeated rows have equal ids.  Empty table: empty result.  Columns beyond doc_id,
    source and text are dropped."""
    return bpe.round_trip(docs.select("doc_id", "source", "text"), *bpe.public_ranks(), keep_ids=True)


STAGES = [("quality classifier", classify), ("near-duplicates", deduplicate), ("personal data", redact), ("mixing", mix), ("byte-level BPE", tokenize)]

#: Models, sketches and vocabularies are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; the result is the last one's."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{scratch_dir(spark)}/stage{i}-{uuid.uuid4().hex[:12]}"
        with Scope(spark):  # what a stage writes on the way goes once its rows are written
            stage(spark, docs, sf_dir).write.parquet(path)
        if old:
            drop_table(spark, old)
        docs, old = spark.read.parquet(path), path
    return docs
