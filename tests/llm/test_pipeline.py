"""run() against the stages done plainly, one document at a time."""

import hashlib
import math
from collections import Counter

import brute
import corpus_pipeline
import pytest

from leafwork.llm import quality_classifier

COLUMNS = corpus_pipeline.COLUMNS
def poisson(mean, u):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u:
        k += 1
        p *= mean / k
        total += p
    return k


@pytest.fixture(scope="module")
def whole(spark, sf):
    return [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]


def test_run_equals_plain_stages(spark, sf, whole):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    scores = quality_classifier.score_texts([r["text"].encode() for r in rows], *model)
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    of = brute.near({r["doc_id"]: r["text"] for r in rows}, 5)
    rows = [r for r in rows if of[r["doc_id"]][1] == r["doc_id"]]
    n = Counter(r["source"] for r in rows)
    weight = sum(v**0.7 for v in n.values())
    tokens, want = brute.tokenizer(), []
    spans = brute.bootstrap([r["text"] for r in rows])
    for r, found in zip(rows, spans, strict=True):
        mean = n[r["source"]] ** 0.7 / weight * len(rows) / n[r["source"]]
        u = int(hashlib.md5(f"1:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        want += [(r["doc_id"], *brute.bpe(tokens, brute.masked(r["text"], found)))] * poisson(mean, u)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in whole) == sorted(want)


def test_stages_keep_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert sorted(out.columns) == sorted(COLUMNS), name
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.classify(spark, docs, sf).select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.98 * len(good)


def test_stages_on_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some words of no id at all", "en", None, 26), (3, "some words of an id that is there", "en", "b", 33), (3, "some words of an id that is there", "en", "b", 33)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.deduplicate(spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "None"]
    for f in (corpus_pipeline.classify, corpus_pipeline.redact, corpus_pipeline.mix, corpus_pipeline.tokenize):
        f(spark, docs, sf).collect()
        assert f(spark, docs.limit(0), sf).count() == 0


def test_deduplicate_drops_only_near_copies(spark, sf):
    words = [f"word{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "edit"]), "a text that is like none of the others here"
    rows = [(None, "one without an id"), (None, "two without an id"), (None, "two without an id"), (None, None), (None, text)]
    rows += [(1, text), (2, near), (3, text), (3, near), (3, other), (3, other), (4, None), (4, other + " at all"), (5, near), (5, "the last one of them all")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, docs, sf).collect()]
    want = rows[:5] + [(1, text), (3, other), (4, None), (4, other + " at all"), (5, "the last one of them all")]
    assert sorted(map(str, got)) == sorted(map(str, want))
    # near copies that share an id: the first by its columns stays
    same = spark.createDataFrame([(7, t, "en", "a", 0) for t in (near, text, near)], docs.schema)
    assert [(r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, same, sf).collect()] == [(7, min(text, near))]


def test_deduplicate_tells_all_rows_apart_whatever_hashes_say(spark, sf, monkeypatch):
    """Rows are numbered, not hashed: with Spark's row hash cut to four bits, nothing is lost."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    docs = spark.createDataFrame([(i % 90, f"a text of its own with number {i} and word{i} word{i + 1} word{i + 2}" if i % 11 else None, "en", "a", 0) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(F, "xxhash64", lambda *c: real(*c).bitwiseAND(15))
    got = corpus_pipeline.deduplicate(spark, docs, sf).collect()
    rows = {tuple(r) for r in docs.collect()}
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))


def test_stages_on_clashing_columns_and_very_long_texts(spark, sf):
    """Columns of the operators' names beside the documents' are dropped; a megabyte of text goes through every stage."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    long = docs.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.concat(*[F.repeat(F.concat("text", F.lit(f" part{i} ")), 40) for i in range(3)]).alias("text"), "lang", "source", "n_chars")
    clash = {c: F.lit("mine") for c in ("score", "kept", "component_id", "n_shingles", "_node", "n", "spans", "base", "whole", "replica", "shuffle_key", "ids", "n_tokens", "component", "predicted", "held_out")}
    plain = docs.union(long)
    for name, stage in corpus_pipeline.STAGES:
        want, got = stage(spark, plain, sf), stage(spark, plain.withColumns(clash), sf)
        assert got.columns == want.columns, name
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name


def test_classifier_keeps_scores_at_the_threshold(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    for score, n in ((0.3, 5), (0.29999, 0)):
        monkeypatch.setattr(quality_classifier, "fit", lambda *_, score=score: (__import__("numpy").zeros(quality_classifier.DIMENSIONS, "float32"), math.log(score / (1 - score)) + (1e-12 if score == 0.3 else 0)))
        assert corpus_pipeline.classify(spark, docs, sf).count() == n


def test_runs_leave_only_their_result_behind(spark, sf, whole):
    import os

    from leafwork.llm.common import scratch_dir

    folder = scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf)
    new = set(os.listdir(folder)) - before
    assert len(new) == 1 and next(iter(new)).startswith("stage4") and out.count() == len(whole)
