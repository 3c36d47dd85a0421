"""Token counts (operator 1): trie-shared dynamic programming.

A unigram model gives each piece a log-probability; a word is worth its most
probable sequence of pieces.  A task inserts the distinct pre-tokens of a run
of texts in a trie by walking them in sorted order, which is the trie's
depth-first order: the forward score and the token count of a prefix are
computed once and shared by all words below it; each word's count is stored at
its terminal.  Texts then sum the counts of their words.  Nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import slices
from leafwork.session import ship

#: Bytes of text whose pre-tokens share a trie.
RUN_BYTES = 16 << 20
MARK = "▁"


def load_pieces(path: str) -> dict[str, float]:
    """Log-probabilities of the pieces of a public vocabulary, by Zipf's law of
    their merge ranks: -ln(2 + rank).  Control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    return {model.id_to_piece(i): -math.log(2 - model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


class Counter:
    """Counts the tokens of words under a unigram model.

    The trie of the words is the order in which counts() walks them: ``score`` and
    ``tokens`` hold the forward score and token count of each prefix on the path to the
    last word, the node of a word is cut from the path when the next one leaves it, and
    what stands at a terminal is put into the result.

    A character that no piece covers becomes its UTF-8 bytes, each a token with
    the score of ``byte_score``.  Of equally probable sequences the one with
    fewer tokens counts."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = min(pieces.values(), default=-1.0) - 10.0
        prefixes: set[str] = set()
        for p in pieces:
            prefixes.update(p[i:] for i in range(len(p)))
        self.suffixes = prefixes  # ends of pieces: a longer look-back is in vain once the end is none

    def counts(self, words: list[str]) -> list[int]:
        """The token count of each of the words, which are distinct and in order."""
        get, ends, longest = self.pieces.get, self.suffixes, self.longest
        score, tokens, last, out = [0.0], [0], "", []
        for word in words:
            shared = 0
            for a, b in zip(word, last):  # noqa: B905  the shorter one ends it
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode())
                best, fewest = score[end - 1] + size * self.byte_score, tokens[end - 1] + size
                for start in range(end - 1, max(-1, end - longest - 1), -1):
                    part = word[start:end]
                    p = get(part)
                    if p is not None:
                        s, n = score[start] + p, tokens[start] + 1
                        if s > best or s == best and n < fewest:
                            best, fewest = s, n
                    elif part not in ends:
                        break
                score.append(best)
                tokens.append(fewest)
            out.append(tokens[-1])
            last = word
        return out

    def text_counts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """(words, tokens) of each text; words are split at ASCII white space and begin with a mark."""
        place: defaultdict[bytes, int] = defaultdict(count().__next__)
        used = []
        for t in texts:
            words = t.encode().split()
            used.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
        order = sorted((MARK + w.decode(), i) for w, i in place.items())
        found = np.zeros(len(order), np.int64)
        found[[i for _, i in order]] = self.counts([w for w, _ in order])
        return [len(u) for u in used], [int(found[u].sum()) for u in used]


def count_tokens(docs: DataFrame, pieces: dict[str, float], text: str = "text") -> DataFrame:
    """The columns of docs except ``text``, n_words and n_tokens.

    Null and empty texts have none.  Very long texts share a trie with no other and
    are counted as a whole.  Of equally probable segmentations the one with the
    fewest tokens counts.  Repeated rows have equal counts.  Empty
    table: empty result.  Clashing columns of docs are replaced."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(pieces)  # of the vocabulary's size
    keep = [c for c in docs.columns if c not in {text, "n_words", "n_tokens"}]

    def run(batches):
        import pyarrow as pa

        counter = Counter(held.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for a, b in slices(texts, RUN_BYTES):
                words, tokens = counter.text_counts(texts[a:b])
                rest = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*rest.schema.names[1:], "n_words", "n_tokens"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    return docs.select(F.col(text).cast("string").alias("_tc_text"), *keep).mapInArrow(run, fields + "n_words long, n_tokens long")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Words and tokens of every whole text of documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
