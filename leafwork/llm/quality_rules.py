"""Quality rules (operator 4): host-level rules with shrunken failure rates, native.

Each document is measured inside its row and judged by four rules: length,
repeats, symbols and lines.  The failures of each rule are summed by host; a
host's rate of each rule is shrunk towards the corpus with a beta prior fitted
to the hosts by the method of moments, and the rates are joined back to the
host's documents.  A host with a rate that is too high is rejected as a whole.
A failure of the rules of symbols and lines rejects a document too, unless its
host has earned trust: a rate of that rule that is low even after shrinking, so
that a single odd document may stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import MOST_SMALL, NON_SPACE, SPACE, cut, join_hot

WINDOW = 8
#: Fixed values of the contract.
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS, REPEAT_PERCENT = 20, 30
#: The rules beyond the contract's: symbols for 100 words, and repeated lines of 100, at most.
SYMBOL_PERCENT, LINE_PERCENT = 10, 50
#: A shrunken rate of failures beyond which a host is rejected, and up to which single failures are forgiven.
MOST_RATE, TRUST = 0.5, 0.02
#: Documents that the prior of a rate is worth at least; at most, it is worth an average host.
LEAST_STRENGTH = 2.0
#: The rules, of which the first two are the contract's base.
RULES = ["length", "repeats", "symbols", "lines"]


def words_of(text: Column) -> Column:
    """The words of a text, without empty strings."""
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def with_repeated_words(df: DataFrame, words: str, name: str, window: int = WINDOW) -> DataFrame:
    """Adds ``name``: how many words lie in windows of ``window`` words that are
    found twice or more in the text, the first included.

    Windows are compared by 64-bit hash.  Repeats are found by sorting within
    the row, so the cost is n log n however much repeats; texts without a
    repeated window, which are most, skip that."""
    n = F.size(words) - (window - 1)
    df = df.withColumn("_q_hash", F.when(n > 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(F.col(words), i, window)))).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("_q_any", F.size(F.array_distinct("_q_hash")) < F.size("_q_hash"))
    # (hash, place) in order; a place repeats if a neighbour has its hash
    df = df.withColumn("_q_sorted", F.when(F.col("_q_any"), F.sort_array(F.transform("_q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda i: F.get(F.col("_q_sorted"), i)["h"]
    df = df.withColumn("_q_at", F.sort_array(F.transform(F.filter("_q_sorted", lambda x, i: (x["h"] == at(i - 1)) | (x["h"] == at(i + 1))), lambda x: x["i"])))
    # each repeated window adds its words up to the next one's start
    covered = F.aggregate("_q_at", F.struct(F.lit(-window).alias("last"), F.lit(0).alias("sum")), lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(i - acc["last"], F.lit(window))).alias("sum")), lambda acc: acc["sum"])
    return df.withColumn(name, F.coalesce(F.when(F.col("_q_any"), covered), F.lit(0)).cast("long")).drop("_q_hash", "_q_any", "_q_sorted", "_q_at")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces ``text`` by n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (long).

    Null and empty texts measure 0 throughout.  Of equal lines all but the first are
    duplicates, of equal windows all count.  Very long texts are measured as a whole.  One
    row for each row, repeated ones too.  Empty table: empty result.  Columns of docs with
    these names are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    keep = [c for c in docs.columns if c != text and c not in names and not c.startswith("_q_")]
    df = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_q_text"))
    t = F.col("_q_text")
    df = df.withColumn("_q_words", words_of(t)).withColumn("_q_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NON_SPACE)))
    df = df.withColumn("n_words", F.size("_q_words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(t, F.lit(SYMBOLS)).cast("long"))
    df = df.withColumn("n_lines", F.size("_q_lines").cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
    return with_repeated_words(df, "_q_words", "n_repeat_words").select(*keep, *names)


def failures() -> dict[str, Column]:
    """Whether a measured document fails each rule."""
    words = F.col("n_words")
    return {
        "length": words < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * words,
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * words,
        "lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
    }


def judge(docs: DataFrame, host: str, text: str = "text", most_rate: float = MOST_RATE, trust: float = TRUST, least_strength: float = LEAST_STRENGTH, most_strength: float | None = None) -> DataFrame:
    """One row for each row of docs: its columns except ``text``, the measures,
    base_failed, host_docs, rate_length, rate_repeats, rate_symbols, rate_lines
    (the host's, shrunken) and kept.

    A document fails by length with fewer than 20 words, by repeats with more than
    30 % of them in repeated windows, by symbols with more than 10 symbols for 100
    words, by lines if more than 50 % of its lines repeat earlier ones.  It is kept
    unless it fails by length or repeats, or a rate of its host exceeds
    ``most_rate``, or it fails by symbols or lines and its host's rate of that rule
    exceeds ``trust``.

    A host's rate is (failures + mean * strength) / (documents + strength), where the
    strength that the moments of all hosts give is held between ``least_strength`` and
    ``most_strength`` (an average host's documents, unless given): hosts that differ by
    more than a beta prior allows would make it negative, and hosts that hardly differ
    would make it outweigh any host.  Both bounds decide the verdicts of small hosts.

    Null text: no words, so it fails by length.  Very long texts are measured as a
    whole, in n log n.  Null host: documents without a host are one host.  Ties: a
    rate equal to a bound does not exceed it.  Repeated rows count and are returned
    as often as they occur.  Empty table: empty result.  Clashing columns of docs
    are replaced.
    """
    new = {"base_failed", "kept", "host_docs", *[f"rate_{r}" for r in RULES]}
    df = measure(docs.select(*[c for c in docs.columns if c not in new]), text)
    df = cut(df.withColumn("_q_host", F.coalesce(F.col(host).cast("string"), F.lit(""))), "quality-rules")
    fails = failures()
    hosts = df.groupBy("_q_host").agg(F.count("*").alias("host_docs"), *[F.count_if(v).alias(f"_q_{k}") for k, v in fails.items()])
    hosts = cut(shrink(hosts, "host_docs", {f"rate_{k}": f"_q_{k}" for k in RULES}, least_strength, most_strength).select("_q_host", "host_docs", *[f"rate_{k}" for k in RULES]), "hosts")
    n, total = hosts.agg(F.count("*"), F.coalesce(F.sum("host_docs"), F.lit(0))).first()
    # a checked number of hosts is broadcast; of more, those with many documents are dealt to several tasks
    out = df.join(F.broadcast(hosts), "_q_host") if n <= MOST_SMALL else join_hot(df, hosts, ["_q_host"], "host_docs", total, F.struct("n_words", "word_chars", "n_symbols"))
    out = out.withColumn("base_failed", fails["length"] | fails["repeats"])
    kept = ~F.col("base_failed")
    for rule in RULES:
        kept = kept & (F.col(f"rate_{rule}") <= most_rate)
    for rule in RULES[2:]:
        kept = kept & ~(fails[rule] & (F.col(f"rate_{rule}") > trust))
    return out.withColumn("kept", kept).drop("_q_host")


def shrink(hosts: DataFrame, n: str, failed: dict[str, str], least: float = LEAST_STRENGTH, most: float | None = None) -> DataFrame:
    """Adds, for each (rate, failures), the posterior mean rate under a beta prior
    whose mean and strength come from all groups by the method of moments.

    The mean is that of all documents.  The variance between groups is the
    variance of their rates less the part due to their sizes; if nothing is
    left of it, the prior is worth ``most`` documents, by default as many as an average
    group has; it is never worth more, nor less than ``least`` unless ``most`` is less."""
    sums = [F.avg(1 / F.col(n)).alias("_q_inv"), F.avg(n).alias("_q_size")]
    for i, f in enumerate(failed.values()):
        sums += [(F.sum(f) / F.sum(n)).alias(f"_q_mean{i}"), F.var_pop(F.col(f) / F.col(n)).alias(f"_q_var{i}")]
    total = hosts.agg(*sums)
    for i in range(len(failed)):
        m, top = F.col(f"_q_mean{i}"), F.col("_q_size") if most is None else F.lit(float(most))
        between = F.col(f"_q_var{i}") - m * (1 - m) * F.col("_q_inv")
        strength = F.when((between > 0) & (m > 0) & (m < 1), F.least(F.greatest(m * (1 - m) / between - 1, F.lit(float(least))), top)).otherwise(top)
        total = total.withColumn(f"_q_strength{i}", strength)
    # one row of sums, so that the join is with a single row
    out = hosts.join(F.broadcast(total))
    for i, (rate, f) in enumerate(failed.items()):
        out = out.withColumn(rate, (F.col(f) + F.col(f"_q_mean{i}") * F.col(f"_q_strength{i}")) / (F.col(n) + F.col(f"_q_strength{i}")))
    return out.drop(*total.columns)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; the host is its source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rates = [F.round(f"rate_{r}", 9).alias(f"rate_{r}") for r in RULES]
    return judge(docs, "source").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *rates)


def _sql_rate(r: str) -> str:
    return f"""(SELECT mean, CASE WHEN var - mean * (1 - mean) * inv > 0 AND mean > 0 AND mean < 1 THEN least(greatest(mean * (1 - mean) / (var - mean * (1 - mean) * inv) - 1, 2.0), size) ELSE size END AS strength
 FROM (SELECT sum({r}) / sum(n)::DOUBLE AS mean, var_pop({r} / n::DOUBLE) AS var, avg(1 / n::DOUBLE) AS inv, avg(n) AS size FROM o))"""


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS h, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, h, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM r)) GROUP BY 1),
m AS (SELECT w.doc_id, h, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN v ON v.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 AS a1, 100 * n_repeat_words > 30 * n_words AS a2, 100 * n_symbols > 10 * n_words AS a3, 100 * n_dup_lines > 50 * n_lines AS a4 FROM m),
o AS (SELECT h, count(*) AS n, count(*) FILTER (a1) AS f1, count(*) FILTER (a2) AS f2, count(*) FILTER (a3) AS f3, count(*) FILTER (a4) AS f4 FROM b GROUP BY 1),
x AS (SELECT h, {', '.join(f'(f{i} + k{i}.mean * k{i}.strength) / (n + k{i}.strength) AS r{i}' for i in (1, 2, 3, 4))} FROM o, {', '.join(f'{_sql_rate(f"f{i}")} k{i}' for i in (1, 2, 3, 4))})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a1 OR a2 AS base_failed, NOT (a1 OR a2) AND greatest(r1, r2, r3, r4) <= 0.5 AND NOT (a3 AND r3 > 0.02) AND NOT (a4 AND r4 > 0.02) AS kept,
 round(r1, 9) AS rate_length, round(r2, 9) AS rate_repeats, round(r3, 9) AS rate_symbols, round(r4, 9) AS rate_lines FROM b JOIN x USING (h)
"""
