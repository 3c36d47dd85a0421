"""Spelling variants, exact duplicates and resampling against plain versions, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from leafwork.llm import entry, exact_dedup, resampling, spelling

CLASH = ["score", "kept", "rank", "weight", "n_words", "n_features", "keep_id", "group_size", "length", "hash", "string", "owner", "copies", "word", "n", "t", "i", "bucket", "size", "number", "text_sha256", "_m"]


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def odd(docs):
    """Repeated rows, null ids and columns with names that operators use."""
    more = docs.union(docs.where("doc_id % 5 = 0")).union(docs.where("doc_id in (9, 12)").withColumn("doc_id", F.lit(None).cast("long")))
    return more.withColumns({**{c: F.lit("mine") for c in CLASH}, "extra col": F.lit("e")})


# -------------------------------------------------------------- spelling variants
def plain_words(docs, least=7, often=2, every=0):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= often}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n, ratio=10):
    out = {}
    for w in n:
        around = [v for v in n if near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (form, n[w], len(around), n[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (form, root(w), c, k, m) for w, (form, c, k, m) in out.items()}


def found_groups(df):
    found = rows(df)
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}
    assert len(out) == len(found)
    return out


def some_words(seed, letters, longest, many):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randrange(1, longest))) for _ in range(many)}
    for w in list(words)[: many // 2]:
        at = r.randrange(len(w))
        words |= {w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :]} | ({w[:at] + w[at + 1 :]} - {""})
    return sorted(words)


@pytest.mark.parametrize(("letters", "longest"), [("ab", 9), ("abc", 6), ("aéÿz", 12), ("a", 30)])
def test_tries_give_each_near_pair_once(letters, longest):
    words = some_words(1, letters, longest, 150)
    got = [tuple(sorted(p)) for p in spelling.near_pairs(words)]
    assert sorted(got) == sorted(p for p in itertools.combinations(words, 2) if near(*p))


@pytest.mark.parametrize("group", [2, 9, 1 << 15])
def test_spelling_groups_of_any_size(spark, monkeypatch, group):
    """A third of the words begin alike; groups beyond the bound are dealt on until nothing is left to split."""
    monkeypatch.setattr(spelling, "GROUP", group)
    r = random.Random(4)
    words = some_words(2, "abé", 10, 60) + ["prefix" + w for w in some_words(3, "xy", 9, 40)]
    docs = [(i, " ".join(r.choice(words) for _ in range(120)) + (" " + r.choice(words)) * r.choice([1, 90])) for i in range(6)]
    want = plain_groups(plain_words(docs, 3), 4)
    got = found_groups(spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"), least=3, ratio=4))
    assert got == want and any(w[0] for w in want.values())


def test_forms_lead_to_roots(spark):
    text = " ".join(["abcdefgh"] * 8000 + ["abcdefgx"] * 800 + ["abcdefyx"] * 80 + ["abcdezyx"] * 8 + ["lonelyword"] * 2)
    got = found_groups(spelling.spelling_groups(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    assert {w: v[:2] for w, v in got.items()} == {"abcdefgh": (None, "abcdefgh"), "abcdefgx": ("abcdefgh", "abcdefgh"), "abcdefyx": ("abcdefgx", "abcdefgh"), "abcdezyx": ("abcdefyx", "abcdefgh"), "lonelyword": (None, "lonelyword")}


def test_spelling_of_odd_rows(spark, odd, docs):
    plain = [(r["doc_id"], r["text"]) for r in rows(odd.select("doc_id", "text"))]
    got = found_groups(spelling.spelling_groups(odd, least=4, every=3))
    assert got == plain_groups(plain_words(plain, 4, every=3)) and got
    assert spelling.spelling_groups(docs.limit(0)).count() == 0
    assert spelling.spelling_groups(docs.select("doc_id", F.lit(None).cast("string").alias("text"))).count() == 0


def test_spelling_of_very_long_words(spark):
    """Words of a million letters that differ in one, and a text of many words."""
    long = "ab" * 500_000
    text = " ".join([long, long[:-1] + "c", "z" + long] * 2 + [f"wordnumber{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(200_000)])
    got = found_groups(spelling.spelling_groups(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    assert got[long][2:4] == (2, 2) and got["z" + long][3] == 1 and len(got) == 103
    assert got["wordnumberak"][2:4] == (2000, 18)


# --------------------------------------------------------------- exact duplicates
def plain_owners(pairs, largest):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    better = max if largest else min
    out = []
    for i, t in pairs:
        own = groups[t or ""]
        keep = better((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), keep is None or i == keep, brute.sha(t or "")))
    return out


def owners_of(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(df))


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("budget", [3000, 64 << 20])
def test_exact_duplicates_match_plain_groups(spark, docs, odd, monkeypatch, largest, budget):
    """Tries that spill after every few strings, and tries that hold all."""
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", budget)
    for df in (docs, odd):
        pairs = [(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))]
        got = exact_dedup.exact_duplicates(df, largest=largest)
        assert owners_of(got) == Counter(plain_owners(pairs, largest))
    assert "extra col" in got.columns and "length" in got.columns and {r["owner"] for r in rows(got)} == {"mine"}


@pytest.mark.parametrize("bits", [8, 16])
def test_unlike_texts_of_equal_hashes_are_told_apart(spark, bits):
    """Hashes cut to a byte: most keys hold several texts; results stay the same."""
    r = random.Random(5)
    pairs = [(i, None if i % 50 == 7 else "".join(r.choice("ab") for _ in range(r.choice([2, 6, 9])))) for i in range(1500)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(7)
    assert owners_of(exact_dedup.exact_duplicates(df, bits=bits)) == Counter(plain_owners(pairs, False))


def test_exact_duplicates_of_a_hot_text(spark):
    """A third of all rows, of a megabyte of text in all ids' order and of unlike ends, and an empty table."""
    long = "x" * 1_000_000
    pairs = [(f"id{i}", long if i % 3 == 0 else long + str(i % 7) if i % 30 == 1 else f"t{i}") for i in range(300)]
    df = spark.createDataFrame(pairs, "doc_id string, text string").repartition(6)
    assert owners_of(exact_dedup.exact_duplicates(df, largest=True)) == Counter(plain_owners(pairs, True))
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="doc_id"):
        exact_dedup.exact_duplicates(df.drop("doc_id"))


def test_radix_tries_keep_all_strings():
    r = random.Random(6)
    strings = [bytes(r.choice(b"\x00ab\xff") for _ in range(r.randrange(9))) for _ in range(500)]
    trie = exact_dedup.Patricia(True)
    for i, s in enumerate(strings):
        trie.insert(s, i)
    want = {s: (max(i for i, x in enumerate(strings) if x == s), strings.count(s)) for s in strings}
    found = list(trie.terminals())
    assert {s: (o, c) for s, o, c in found} == want and [s for s, *_ in found] == sorted(want)


# --------------------------------------------------------------------- resampling
def plain_resample(pairs, target, most, buckets, percent, least, seed):
    def runs(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.lower(text))
        return w, [" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, most + 1) if i + k <= len(w)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in pairs for f in runs(t)[1])
    t_ = Counter(bucket(f) for t in target for f in runs(t)[1])
    total, wanted = sum(s.values()), sum(t_.values())
    gain = [math.floor(1000 * math.log((t_[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    out = []
    for i, t in pairs:
        words, features = runs(t)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = percent * len(order) // 100
    rank = {}
    for k, x in enumerate(order[:drawn], 1):
        rank.setdefault(x, []).append(k)
    return Counter((i, n, w, sc, rank[x].pop() if rank.get(x := (i, nw, n, w, sc)) else None) for i, nw, n, w, sc in out)


def ranks_of(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows(df))


@pytest.mark.parametrize(("most", "buckets", "percent", "least", "nodes"), [(1, 10_000, 10, 20, 1 << 18), (3, 50, 40, 3, 5), (2, 7, 100, 0, 1 << 18)])
def test_resampling_matches_the_plain_version(spark, docs, odd, monkeypatch, most, buckets, percent, least, nodes):
    """Tries that are begun anew after a few nodes, runs of several words, and rows that repeat."""
    monkeypatch.setattr(resampling, "MOST_NODES", nodes)
    monkeypatch.setattr(resampling, "PART", 11)
    target = ["alpha1 beta2 Word3 of4 the5 Über6", None, "", "mail a.b+c@d-e.org"]
    held = spark.createDataFrame([(t,) for t in target], "text string")
    for df in (docs, odd):
        pairs = [(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))]
        got = resampling.resample(df, held, most=most, buckets=buckets, percent=percent, least_words=least, seed=7)
        assert ranks_of(got) == plain_resample(pairs, target, most, buckets, percent, least, 7)
    assert "extra col" in got.columns and {r["bucket"] for r in rows(got)} == {"mine"}


def test_resampling_of_empty_tables_and_long_texts(spark, docs):
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    pairs = [(r["doc_id"], r["text"]) for r in rows(docs)] + [(10**6, "word " * 400_000)]
    got = resampling.resample(spark.createDataFrame(pairs, "doc_id long, text string"), none)
    assert ranks_of(got) == plain_resample(pairs, [], 1, 10_000, 10, 20, 2024)


# ------------------------------------------------------------------------ queries
def test_queries_on_the_smallest_tables(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))]
    target = [r["text"] for r in rows(spark.read.parquet(f"{sf}/benchmark.parquet"))]
    assert found_groups(entry.QUERIES["op11_spelling_variants"](spark, sf)) == plain_groups(plain_words(docs, every=31))
    assert owners_of(entry.QUERIES["op12_exact_dedup"](spark, sf)) == Counter(plain_owners(docs, True))
    assert ranks_of(entry.QUERIES["op13_resampling"](spark, sf)) == plain_resample(docs, target, 1, 10_000, 10, 20, 2024)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_exact_dedup", "op13_resampling"])
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(entry.SQL[name])
    names = [c[0] for c in cursor.description]
    got = entry.QUERIES[name](spark, sf).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(cursor.fetchall())
