"""Quality classifier (operator 6): logistic regression on hashed word n-grams,
trained with follow-the-regularised-leader updates, scored as sparse dot products.

Training reads a bounded sample of labelled rows (``most_rows``, those with the
smallest hash of their id, and ``most_texts`` texts that have their ids) in one task; the model is DIMENSIONS weights, so
what reaches the driver and the executors has a fixed size.  Scoring is one
pass over all texts without a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import CLASSES, mix, slices, token_hashes, utf8
from leafwork.session import ship

DIMENSIONS = 1 << 20
#: Rows a model is fitted on, at most, and passes over them.
MOST_ROWS, EPOCHS = 6000, 4
#: Texts a model is fitted on, at most: more than rows only where texts share ids.
MOST_TEXTS = 4 * MOST_ROWS
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: The mean weight of a text's n-grams is multiplied by this.
SCALE = 100.0

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hashed feature) of each occurrence.

    Tokens are runs of letters and digits, or of other marks.  Features are
    1- and 2-grams of tokens and 1- to 3-grams of their shapes: a word's case,
    digits and rough length, a mark as it is."""
    h, doc, kind, start, end = token_hashes(texts, CLASSES)
    if not len(h):
        return doc, h.astype(np.int64)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    upper = np.concatenate(([0], np.cumsum(_UPPER[buf])))
    digit = np.concatenate(([0], np.cumsum(_DIGIT[buf])))
    n, up = end - start, upper[end] - upper[start]
    case = np.where(up == 0, 0, np.where(up == n, 3, np.where((up == 1) & (_UPPER[buf[start]] == 1), 1, 2)))
    shape = (1 + case + 4 * (digit[end] > digit[start]) + 8 * np.minimum(n // 4, 4)).astype(np.uint64)
    with np.errstate(over="ignore"):
        shape = mix(np.where(kind == 2, h, shape * np.uint64(0xD6E8FEB86659FD93)))
        docs, found = [doc, doc], [h, shape ^ np.uint64(0x51)]
        for base, top, salt in ((h, 2, 0x1001), (shape, 3, 0x2001)):
            gram = base
            for size in range(2, top + 1):
                gram = mix(gram[:-1] * np.uint64(3) + base[size - 1 :] + np.uint64(salt * size))
                docs.append(doc[size - 1 :])
                found.append(np.where(doc[size - 1 :] == doc[: len(doc) - size + 1], gram, np.uint64(0)))
                docs[-1] = np.where(doc[size - 1 :] == doc[: len(doc) - size + 1], docs[-1], -1)
    docs, found = np.concatenate(docs), np.concatenate(found)
    use = docs >= 0
    return docs[use], (found[use] % np.uint64(DIMENSIONS)).astype(np.int64)


def score_texts(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1; that of the bias alone for a text without tokens."""
    doc, x = features(texts)
    total = np.bincount(doc, weights[x], len(texts))
    count = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
    return 1 / (1 + np.exp(-np.clip(bias + SCALE * total / count, -30, 30)))


def fit_arrays(examples: list[tuple[np.ndarray, np.ndarray, float]], epochs: int) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader with per-coordinate rates over (features, values, label)."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(i):
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for e in rng.permutation(len(examples)):
            i, x, y = examples[e]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            new = n[i] + g * g
            z[i] += g - (np.sqrt(new) - np.sqrt(n[i])) / ALPHA * w
            n[i] = new
    w = weights(np.arange(DIMENSIONS + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _fit(epochs: int):
    def run(batches):
        import pyarrow as pa

        examples = []
        for batch in batches:
            texts, y = utf8(batch.column(0)), batch.column(1).to_pylist()
            for a, b in slices(texts):
                doc, x = features(texts[a:b])
                for t in range(b - a):
                    i, c = np.unique(x[doc == t], return_counts=True)
                    v = SCALE * c / max(c.sum(), 1)
                    examples.append((np.append(i, DIMENSIONS).astype(np.int32), np.append(v, 1.0).astype(np.float32), float(y[a + t])))
        w, bias = fit_arrays(examples, epochs)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary()), pa.array([bias])], names=["at", "w", "bias"])

    return run


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id; labels of these are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS, most_texts: int = MOST_TEXTS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) learned from the labels of documents that are not held out.

    Learns from ``most_rows`` labels at most, those with the smallest hashes of their
    ids, and from ``most_texts`` of the texts with these ids, in that order.

    Null labels and labels without a document are ignored; without any label
    the model is 0 and scores 0.5.  A document with several labels counts once
    for each, and so do several texts of one id.  Null and empty texts teach the
    bias alone; very long texts count as one example as any other.  Ties of the
    order are broken by id, text and label.  Further columns are ignored."""
    ship(docs.sparkSession)
    use = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    chosen = use.select(F.col(doc_id).alias("_qc_id"), F.col(label).cast("double").alias("y"), F.xxhash64(F.col(doc_id)).alias("o")).orderBy("o", "_qc_id", "y").limit(most_rows)
    # most_rows bounds what is broadcast, and what meets in the one task that trains
    rows = docs.select(F.col(text).cast("string").alias("t"), F.col(doc_id).alias("_qc_id")).join(F.broadcast(chosen), "_qc_id")
    rows = rows.select("t", "y", "o", "_qc_id").orderBy("o", "_qc_id", "t", "y").limit(most_texts)
    model = rows.mapInArrow(_fit(epochs), "at binary, w binary, bias double").collect()
    w = np.zeros(DIMENSIONS, np.float32)
    if not model:
        return w, 0.0
    w[np.frombuffer(model[0]["at"], "<i4")] = np.frombuffer(model[0]["w"], np.float32)
    return w, model[0]["bias"]


def _score(model):
    def run(batches):
        import pyarrow as pa

        weights, bias = model.value
        for batch in batches:
            texts = utf8(batch.column(0))
            out = np.concatenate([score_texts(texts[a:b], weights, bias) for a, b in slices(texts)]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64())], names=[*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep_text: bool = False, threshold: float = 0.3) -> DataFrame:
    """The columns of docs (with ``text`` if keep_text), score (0 to 1, higher:
    label 1 likelier) and predicted (1 if score >= threshold, else 0).

    Null and empty texts get the score of the bias.  Very long texts are scored as
    a whole.  A score equal to the threshold is predicted 1.  Repeated rows get
    equal scores.  Empty table: empty result.  Clashing columns of docs are replaced."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in {"score", "predicted"} and (keep_text or c != text)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col(text).cast("string").alias("_qc_text"), *keep).mapInArrow(_score(held), f"{fields}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
