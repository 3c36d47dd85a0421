"""Spelling variant grouping (operator 11): errata-trie merging.

1. Tasks count the words of their texts; counts are summed over all tasks.
2. Two words that differ by one inserted, deleted or replaced character have their
   first half or their last half in common.  So words are dealt by length and half,
   and both halves of a large group are dealt on by halves of what is left between
   them; what cannot be dealt on has one place left to differ, so the alphabet
   bounds it.
3. Within a group, the words in order are a trie: a node is a run of them with a
   common prefix.  Along each heavy path, the light subtrees of a node are merged
   into it and into its heavy child with one character skipped or replaced: small
   into large, so a word is moved a logarithmic number of times.  Where a moved
   terminal coincides with another, the two words are a pair.
4. A word's form is its most frequent near word if that is much more frequent; the
   forms of forms lead to a root, by doubling the step in each round.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import SQL_CRC_TABLE, Scope, cut, drop_table, join_hot, read_cut, sql_crc, write_cut
from leafwork.session import ship

#: Letters of words.
LETTER = "a-zÀ-ÿ"
#: Distinct words that a task counts before it passes the counts on.
MOST_COUNTED = 1 << 18
#: Words of a group, beyond which it is dealt on.
GROUP = 1 << 15
#: A form occurs this many times as often as the word, at least.
RATIO = 10


def damaged(doc_id: str, text: bytes | None, least: int, every: int) -> Counter:
    """The runs of letters of a text, with A-Z lower-cased, of ``least`` letters or more.  A run whose
    CRC with the document's id is a multiple of ``every`` loses the letter that it points to."""
    found = Counter(re.findall(f"[{LETTER}]{{{least},}}", (text or b"").lower().decode(errors="replace")))
    if not every:
        return found
    start = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def _count(least: int, every: int):
    """From rows (id, text): (word, n) of a task."""

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def out():
            words = list(held.items())
            for a in range(0, len(words), 1 << 14):
                part = words[a : a + (1 << 14)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update(damaged(doc_id, text, least, every))
                if len(held) > MOST_COUNTED:
                    yield from out()
                    held.clear()
        yield from out()

    return run


def near_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """All pairs of the words, which are distinct and in order, that differ by one
    inserted, deleted or replaced character; each once.

    A node of the trie is a range of the words with its prefix's length.  Of its
    children the heavy one holds most words.  For a word P a R of another child:
    replacing a by the heavy child's letter gives a terminal of that child, or not;
    words of light children with equal R coincide in their merged subtree; skipping a
    gives a terminal of the node; and skipping the heavy child's letter h in P h Q
    gives P Q, so Q's words, which are light, are looked for below h.  A skipped
    letter that is followed by itself is left to the node after it, where the same
    pair comes out."""
    held = set(words)
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2:
            continue
        # the paths between branches and terminals have no light subtree
        first, last = words[low], words[high - 1]
        depth = _common(first, last, depth)
        prefix = first[:depth]
        node = first == prefix
        children, at = [], low + node
        while at < high:
            end = _next(words, at, high, depth)
            children.append((at, end))
            stack.append((at, end, depth + 1))
            at = end
        heavy = max(children, key=lambda c: c[1] - c[0])
        h = words[heavy[0]][depth]
        if node and prefix + h in held:
            yield prefix, prefix + h
        merged: dict[str, list[str]] = {}
        for child in children:
            if child == heavy:
                continue
            for word in words[child[0] : child[1]]:
                a, rest = word[depth], word[depth + 1 :]
                other = prefix + h + rest
                if other in held:
                    yield word, other
                twins = merged.setdefault(rest, [])
                for twin in twins:
                    yield twin, word
                twins.append(word)
                if rest[:1] != a and prefix + rest in held:
                    yield word, prefix + rest
                longer = prefix + h + word[depth:]
                if longer in held:
                    yield word, longer


def _common(a: str, b: str, low: int) -> int:
    """The length of the common prefix of a and b, which is ``low`` at least."""
    high = min(len(a), len(b)) + 1
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _next(words: list[str], low: int, high: int, depth: int) -> int:
    """Where the run of words with the letter of words[low] at ``depth`` ends, by doubling steps and halving."""
    letter, step = words[low][depth], 1
    while low + step < high and words[low + step][depth] == letter:
        low, step = low + step, 2 * step
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if words[mid][depth] == letter:
            low = mid
        else:
            high = mid
    return high


def _pairs(batches):
    """From rows (length, group, word, n) in order: (u, nu, v, nv) of the near words of
    each group whose shorter has that length."""
    import pyarrow as pa

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    held = []
    for (length, _), group in groupby(rows(), key=lambda r: r[:2]):
        n = {word: count for *_, word, count in group}
        for u, v in near_pairs(list(n)):
            if min(len(u), len(v)) == length:
                u, v = min(u, v), max(u, v)
                held.append((u, n[u], v, n[v]))
        if len(held) > 1 << 14:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(held: list[tuple]):
    import pyarrow as pa

    columns = zip(*held, strict=True)
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["u", "nu", "v", "nv"])


def _group() -> Column:
    """What the words of a group have in common, beside its length: head and tail and the letters of both."""
    letters = F.concat(F.substring("word", F.lit(1), F.col("head")), F.right("word", F.col("tail")))
    return F.concat_ws(":", "head", "tail", letters)


def _halved(rows: DataFrame) -> DataFrame:
    """Deals the words of each group to two: by half of the letters between head and tail, and by the other half."""
    half = F.floor((F.col("length") - F.col("head") - F.col("tail")) / 2).cast("int")
    parts = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("length") - F.col("head") - half).alias("tail")))
    return rows.select("word", "n", "length", F.explode(parts).alias("_p")).select("word", "n", "length", "_p.head", "_p.tail")


def _dealt(words: DataFrame, least: int) -> DataFrame:
    """(word, n, length, head, tail): words dealt to groups by the length of a pair's
    shorter word and so many first and last letters.

    Where the words of a pair have ``left`` letters between head and tail, the longer
    perhaps one more, they either share the first half of them, rounded down, or the
    last ones that make it up to ``left``; so each pair meets in a group.  Groups beyond
    GROUP words are dealt on until one letter is left."""
    spark = words.sparkSession
    rows = words.select("word", "n", F.explode(F.array(F.char_length("word") - 1, F.char_length("word"))).alias("length")).where(F.col("length") >= least)
    rows = _halved(rows.select("*", F.lit(0).alias("head"), F.lit(0).alias("tail")))
    path = write_cut(rows, "dealt")
    while True:
        now = read_cut(spark, path, rows).withColumn("group", _group())
        open_ = now.where(F.col("length") - F.col("head") - F.col("tail") > 1)
        large = cut(open_.groupBy("length", "group").agg(F.count("*").alias("size")).where(F.col("size") > GROUP), "large-groups")
        total = large.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if not total:
            return now
        # groups of more than GROUP words are few, but they grow with the words: no broadcast
        met = join_hot(now, large, ["length", "group"], "size", total, "word", "left").select(*rows.columns, "size")
        met = cut(met, "met")
        new = write_cut(met.where("size is null").drop("size").unionByName(_halved(met.where("size is not null"))), "dealt")
        drop_table(spark, path)
        path = new


def _roots(forms: DataFrame) -> DataFrame:
    """From (word, form): (word, root), the last word that is reached by following forms.
    Each round doubles the step.  The rows that point to one root are dealt to several tasks."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        hubs = now.groupBy("root").agg(F.count("*").alias("size"))
        onward = cut(hubs.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root"), "onward")
        total = onward.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if not total:
            return now
        now = cut(join_hot(now, onward, ["root"], "size", total, "word", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, often: int = 2, ratio: int = RATIO, every: int = 0) -> DataFrame:
    """One row for each word of ``least`` letters or more that occurs ``often`` times or
    more: word, form, root, n, n_near, form_n.

    Words are runs of letters after A-Z are lower-cased.  Two are near if they differ by
    one inserted, deleted or replaced letter.  A word's form is its near word of largest
    n (ties: the smallest in code-point order) if that is ``ratio`` times its own or more,
    else null; its root is where forms lead, itself if it has none.  n_near counts its
    near words; form_n is the form's n.

    every: where the CRC of ``id:word`` is a multiple of it, an occurrence loses the
    letter that the CRC points to before it is counted; 0 damages none.

    Null and empty texts have no words; null id counts as an empty one.  Very long texts
    and words are read as a whole.  Repeated rows count as often as they occur.  Empty
    table: empty result.  Further columns of docs are ignored."""
    ship(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").cast("binary").alias("t"))
    with Scope(docs.sparkSession) as scope:  # only the last two tables stay
        words = plain.mapInArrow(_count(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)
        words = cut(words, "words")
        met = _dealt(words, least).select("length", "group", "word", "n").repartition("length", "group").sortWithinPartitions("length", "group", "word")
        # a pair may meet in two groups
        pairs = cut(met.mapInArrow(_pairs, "u string, nu long, v string, nv long").distinct(), "pairs")
        both = pairs.select(F.col("u").alias("word"), F.col("v").alias("near"), F.col("nv").alias("n")).union(pairs.select("v", "u", "nu"))
        best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
        out = words.join(best, "word", "left").withColumn("_ok", -F.col("best.n") >= ratio * F.col("n"))
        out = out.select("word", F.when(F.col("_ok"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_ok"), -F.col("best.n")).alias("form_n"))
        out = scope.keep(cut(out, "forms"))
        roots = scope.keep(_roots(out.where("form is not null")))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all words of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_groups(docs, every=31)


OP11_SQL = rf"""
WITH RECURSIVE {SQL_CRC_TABLE},
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {sql_crc("(doc_id::VARCHAR || ':' || run)")} AS h FROM r, crcs),
k AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM k WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
c AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word AS u, b.word AS v FROM c a JOIN c b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word UNION SELECT c.word, w.word FROM c JOIN w ON c.cut = w.word UNION SELECT w.word, c.word FROM c JOIN w ON c.cut = w.word),
s AS (SELECT u AS word, count(*) AS n_near, first(v ORDER BY w.n DESC, v) AS best, max(w.n) AS most FROM e JOIN w ON w.word = v GROUP BY 1),
f AS (SELECT w.word, CASE WHEN most >= 10 * n THEN best END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 10 * n THEN most END AS form_n FROM w LEFT JOIN s USING (word)),
p AS (SELECT word, word AS root FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT p.word, p.root FROM p JOIN f ON f.word = p.root WHERE f.form IS NULL) q ON q.word = f.word
"""
