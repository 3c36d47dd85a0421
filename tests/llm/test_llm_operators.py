"""The operators against plain versions, and on nulls, empties, ties, repeats and clashing names."""

import itertools
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwork.llm import bpe, chat, common, embedding_dedup, mixing, near_dedup, pii, quality_classifier, quality_rules, sharding, token_counts


@pytest.fixture(scope="module")
def ranks():
    return bpe.public_ranks()


@pytest.fixture(scope="module")
def odd(docs):
    """Repeated rows, a null id and columns with names that operators use."""
    rows = docs.union(docs.where("doc_id % 5 = 0")).union(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    clash = {"score": F.lit("mine"), "kept": F.lit(1), "spans": F.lit(2), "base": F.lit(3), "ids": F.lit(4), "n_words": F.lit(5), "replica": F.lit(6), "component_id": F.lit(7), "n_shingles": F.lit(8), **{c: F.lit(9) for c in ("copies", "node", "size", "component", "n", "c", "many", "tree", "u", "v", "s", "e", "k", "token", "pattern", "string", "found", "host_docs", "rate_lines", "rate", "w", "text_", "y", "o", "t", "b", "i", "j")}, "extra col": F.lit("e")}
    return rows.withColumns(clash)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ------------------------------------------------------------------ personal data
def spans_of(row, name="spans"):
    return [(x["s"], x["k"], x["e"]) for x in row[name]]


def test_pii_matches_plain_rules(docs, texts):
    want = dict(zip(texts, brute.bootstrap(list(texts.values())), strict=True))
    for r in rows(pii.extract_pii(docs.select("doc_id", "text"))):
        assert spans_of(r, "base") == brute.pii(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert spans_of(r) == want[r["doc_id"]]
        assert all(x["m"] == texts[r["doc_id"]][x["s"] : x["e"]] for x in r["base"])


def test_pii_bootstraps_like_the_plain_version(spark):
    """Random sentences over few contexts: seeds, unseen identifiers that only a later round reaches, and rejected ones."""
    r = random.Random(12)
    lines = [f"mail of box{i}@site{i}.org is old" for i in range(60)]
    lines += [f"mail of staff-{i}x7 is old and user staff-{i}x7 signs here" for i in range(10, 22)]  # found by the seeds' context
    lines += [f"then user guest-{i}q9 signs here" for i in (55,)]  # in the context of those alone
    lines += [f'set token = "{r.randrange(16**40):040x}" here' for _ in range(9)] + ['set token = "opaque-77-XY" here', f"sum {r.randrange(16**40):040x} of a file"]
    lines += [f"version {i}.{i}{i} of it" for i in range(12)] + ["see 10 20 30 40 and 10.0.0.7 10.0.0.8 next", "10.1.2.3"] * 2 + [None, ""]
    some = ["at", "host", "on", "port"]
    for _ in range(150):
        ip = ".".join(str(r.randrange(300 if r.random() < 0.05 else 256)) for _ in range(4))
        lines.append(" ".join([r.choice(some), r.choice(some), ip if r.random() < 0.9 else f"id{r.randrange(99)}-{r.randrange(99)}", r.choice(some)]))
    want = brute.bootstrap(lines)
    got = {x["i"]: x for x in rows(pii.extract_pii(spark.createDataFrame(list(enumerate(lines)), "i int, text string").repartition(5)))}
    for i, w in enumerate(want):
        assert spans_of(got[i]) == w, lines[i]
    found = {lines[i][s:e]: brute.ALL_KINDS[k] for i, w in enumerate(want) for s, k, e in w if (s, k, e) not in brute.pii(lines[i])}
    assert found["staff-12x7"] == found["guest-55q9"] == "email" and found["opaque-77-XY"] == "secret"
    assert not any(x.startswith("1.1") or x == "30" for x in found)


def test_pii_is_linear_in_numbers(spark):
    """A text of a megabyte of numbers, and one of as many spans, take seconds."""
    import time

    numbers = " ".join(f"word {i}" for i in range(90_000))
    spans = " ".join(f"10.0.{i % 256}.{i // 256 % 256}" for i in range(60_000))
    df = spark.createDataFrame([(0, numbers), (1, spans)], "i int, text string")
    start = time.time()
    got = {x["i"]: x for x in rows(pii.extract_pii(df.withColumn("whole", F.col("text"))).select("i", F.size("spans").alias("n"), F.length(pii.mask_spans(F.col("whole"), F.col("spans"))).alias("left")))}
    assert got[0]["n"] == 0 and got[0]["left"] == len(numbers) and got[1]["n"] == 60_000 and got[1]["left"] == 60_000 * 5 - 1
    assert time.time() - start < 60


def test_pii_learns_contexts(spark):
    lines = [(i, f"please write to {w}{i}@mail.org now, day {i % 3}x") for i, w in enumerate("abcdefghij")]
    lines += [(100, "please write to agent77-q1 now"), (101, "they met in room77-q2 now"), (102, None), (103, "")]
    got = {r["doc_id"]: r for r in rows(pii.extract_pii(spark.createDataFrame(lines, "doc_id long, text string")))}
    assert [(x["s"], x["e"], pii.KINDS[x["k"]]) for x in got[100]["spans"]] == [(16, 26, "email")]
    assert not got[101]["spans"] and not got[102]["spans"] and not got[103]["spans"]


def test_pii_tokens_have_whole_contexts(spark, texts):
    def want(text):
        words = [(m.start(), m.end(), m.group()) for m in brute.WORD.finditer(text)]
        hit = [bool(set(w) & set("0123456789@")) for *_, w in words]
        name = ["<num>" if h else w.lower() for h, (*_, w) in zip(hit, words, strict=True)]
        at = lambda i: name[i] if 0 <= i < len(name) else ""
        return [(s, e, w, at(i - 2), at(i - 1), at(i + 1)) for i, (s, e, w) in enumerate(words) if hit[i]]

    far = " " * 200
    mine = [*(t for t in texts.values() if t), "please write to agent77-q1 agent78-q2 now", "on 3 agent77-q1", "1 2 3", f"Some words{far}a1{far}behind it", f"{'x' * 300} {'y' * 90} b2 {'z' * 120} c3"]
    got = rows(spark.createDataFrame(list(enumerate(mine)), "i int, text string").select("i", pii.find_tokens(F.col("text")).alias("t")))
    for r in got:
        assert [tuple(x.values()) for x in r["t"]] == want(mine[r["i"]]), mine[r["i"]][:80]


def test_pii_learns_between_identifiers(spark):
    lines = [(i, f"on 3 a{i}x@mail.org then 5 b{i}x@mail.org now") for i in range(8)] + [(100, "on 4 agent77-q1 then it"), (101, "then 6 agent78-q2 now")]
    got = {r["doc_id"]: r for r in rows(pii.extract_pii(spark.createDataFrame(lines, "doc_id long, text string")))}
    assert [(x["s"], x["e"], pii.KINDS[x["k"]]) for x in got[100]["spans"]] == [(5, 15, "email")]
    assert [(x["s"], x["e"], pii.KINDS[x["k"]]) for x in got[101]["spans"]] == [(7, 17, "email")]


def test_pii_odd_rows_and_masks(odd, docs, texts):
    got = pii.extract_pii(odd.withColumn("whole", F.col("text")))
    assert got.count() == odd.count() and "extra col" in got.columns
    for r in rows(got.select("doc_id", "whole", "spans", pii.mask_spans(F.col("whole"), F.col("spans")).alias("masked"))):
        if r["whole"] is None:
            assert r["masked"] is None
            continue
        assert r["masked"] == brute.masked(r["whole"], spans_of(r))


# ------------------------------------------------------------------ quality rules
def test_rules_match_plain_version(docs, texts):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in rows(quality_rules.measure(docs.select("doc_id", "text"))):
        assert tuple(r[n] for n in names) == brute.rules(texts[r["doc_id"]]), r["doc_id"]


def test_hosts_are_judged_together(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    data = [(i, "good" if i < 40 else "bad" if i < 80 else None, good if i < 36 or i in (41, 90) else bad) for i in range(92)]
    got = {r["id"]: r for r in rows(quality_rules.judge(spark.createDataFrame(data, "id long, host string, text string"), "host"))}
    assert got[0]["kept"] and not got[37]["kept"] and got[37]["base_failed"]
    assert not got[41]["kept"] and not got[41]["base_failed"]  # a good text of a bad host
    assert 0.1 < got[0]["rate_length"] < 0.5 < got[41]["rate_length"] < 39 / 40


@pytest.mark.parametrize("most", [quality_rules.MOST_SMALL, 0])
def test_host_trust_decides_single_failures(spark, monkeypatch, most):
    """The verdict against plain arithmetic: a symbol-heavy text stands on a host with a clean record only; hosts broadcast and salted."""
    monkeypatch.setattr(quality_rules, "MOST_SMALL", most)
    monkeypatch.setattr(common, "HOT", 100)
    clean, junk, again = " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}###" for i in range(30)), "\n".join([" ".join(f"w{i}" for i in range(4))] * 9 + [" ".join(f"v{i}" for i in range(40))] * 1)
    data = [("clean", junk if i == 0 else clean) for i in range(600)] + [("mixed", junk if i % 4 == 0 else clean) for i in range(200)] + [("lines", again if i % 3 == 0 else clean) for i in range(30)] + [(f"h{i}", clean) for i in range(40)]
    got = rows(quality_rules.judge(spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(data)], "id long, host string, text string"), "host"))
    hosts = {}
    for h, t in data:
        n_words, _, n_symbols, n_dup, n_repeat = brute.rules(t)
        lines = [x for x in t.split("\n") if brute.WORD.search(x)]
        fails = (n_words < 20, 100 * n_repeat > 30 * n_words, 100 * n_symbols > 10 * n_words, 100 * n_dup > 50 * len(lines))
        hosts.setdefault(h, []).append(fails)
    rate = {h: [] for h in hosts}
    for k in range(4):
        n, f = [len(v) for v in hosts.values()], [sum(x[k] for x in v) for v in hosts.values()]
        mean, r = sum(f) / sum(n), [a / b for a, b in zip(f, n, strict=True)]
        between = sum((x - sum(r) / len(r)) ** 2 for x in r) / len(r) - mean * (1 - mean) * sum(1 / b for b in n) / len(n)
        size = sum(n) / len(n)
        strength = min(max(mean * (1 - mean) / between - 1, 2.0), size) if between > 0 and 0 < mean < 1 else size
        for h, a, b in zip(hosts, f, n, strict=True):
            rate[h].append((a + mean * strength) / (b + strength))
    assert rate["clean"][2] < 0.02 < rate["mixed"][2]
    for x in got:
        h, t = data[x["id"]]
        r, f = rate[h], hosts[h]
        own = f[[i for i, d in enumerate(data) if d[0] == h].index(x["id"])]
        assert [x[f"rate_{k}"] for k in quality_rules.RULES] == pytest.approx(r)
        assert x["kept"] == (not own[0] and not own[1] and max(r) <= 0.5 and not (own[2] and r[2] > 0.02) and not (own[3] and r[3] > 0.02)), (h, t)
    assert len(got) == len(data) and {x["kept"] for x in got if x["id"] == 0} == {True} and not got[0]["base_failed"]


def test_bounds_of_the_prior_act(spark):
    """Two kinds of hosts that differ by more than a beta prior allows: the strength is held at its least; hosts that hardly differ: at its most."""
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    far = [(h * 10 + i, f"h{h}", bad if h % 2 else good) for h in range(20) for i in range(10)]
    close = [(h * 10 + i, f"h{h}", bad if i == h % 10 else good) for h in range(20) for i in range(10)]

    def rate(data, **bounds):
        df = spark.createDataFrame(data, "id long, host string, text string")
        return {r["host"]: r["rate_length"] for r in rows(quality_rules.judge(df, "host", **bounds))}

    # mean 1/2, variance 1/4: the strength of the moments is about 0.1
    assert rate(far)["h1"] == pytest.approx((10 + 1) / 12) and rate(far, least_strength=0.0)["h1"] > 0.98
    assert rate(far, least_strength=50.0, most_strength=100.0)["h1"] == pytest.approx((10 + 25) / 60)
    # no variance between hosts: the prior is worth ten documents, an average host, unless said otherwise
    assert rate(close)["h3"] == pytest.approx(0.1) and rate(close, most_strength=90.0)["h3"] == pytest.approx(0.1)
    odd_one = [*close, *[(900 + i, "new", bad) for i in range(2)]]
    assert rate(odd_one, most_strength=1.0)["new"] > 0.6 > rate(odd_one, most_strength=1000.0)["new"]


def test_rules_odd_rows(odd, texts):
    got = rows(quality_rules.judge(odd, "source"))
    assert len(got) == odd.count() and all(r["extra col"] == "e" for r in got)
    for r in got:
        t = texts[9 if r["doc_id"] is None else r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.rules(t)


# ---------------------------------------------------------------- near duplicates
@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_all_pairs(docs, texts, k):
    want = brute.near(texts, k)
    for r in rows(near_dedup.near_duplicates(docs.select("doc_id", "text"), shingle=k)):
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_words_that_share_a_polynomial_hash_are_not_linked(spark):
    """The Thue-Morse word and its complement have one value in any polynomial hash modulo 2**64."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    common_words = " ".join(f"w{i}" for i in range(6))
    data = {0: word, 1: other, 2: f"{common_words} {word}", 3: f"{common_words} {other}", 4: word * 2, 5: other * 2, 6: word * 4, 7: other * 4}
    got = rows(near_dedup.near_duplicates(spark.createDataFrame(list(data.items()), "doc_id long, text string"), shingle=4))
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i for i in data} and brute.near(data, 4)[3][1] == 3
    assert not set(near_dedup.shingle_sets([word.encode()], 4)[0].tolist()) & set(near_dedup.shingle_sets([other.encode()], 4)[0].tolist())


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Blocks of a few members, so that groups are split; chains of edits, so that links matter."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(common, "HOT", 16)
    r = random.Random(5)
    data = {}
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for i in range(60):
            w = list(base)
            for _ in range(r.randrange(5)):
                w[r.randrange(60)] = f"e{r.randrange(1000)}"
            data[g * 100 + i] = " ".join(w)
    got = rows(near_dedup.near_duplicates(spark.createDataFrame(list(data.items()), "doc_id long, text string"), shingle=4))
    want = brute.near(data, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_duplicates_edges_grow_with_the_members(spark, monkeypatch):
    """A tight group of many blocks leaves as many edges a member as one of few, beside loose texts in the same buckets."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    made = []

    def components(edges):
        made.append(edges.count())
        return common.connected_components(edges)

    monkeypatch.setattr(near_dedup, "connected_components", components)
    r, most = random.Random(7), []
    for size in (40, 160):
        base = [f"w{i}" for i in range(300)]
        data = {i: " ".join([*base, f"own{i}"]) for i in range(size)}
        for i in range(size, size + 6):  # share registers with the group, but are none of it
            data[i] = " ".join(base[:220] + [f"e{r.randrange(1000)}" for _ in range(80)])
        made.clear()
        got = rows(near_dedup.near_duplicates(spark.createDataFrame(list(data.items()), "doc_id long, text string"), shingle=4))
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute.near(data, 4)
        most.append(max(made))
    assert most[0] < near_dedup.BANDS * 46 and most[1] < near_dedup.BANDS * 166
    assert most[1] < 6 * most[0]


def test_rows_outside_of_the_main_tree_meet_all(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 4)
    dealt = spark.createDataFrame([(1, x, 0 if x < 30 else x, 41, 30, 0) for x in range(41)], "key long, node long, tree long, size long, most long, main long")
    met = {}
    for x in rows(near_dedup._between(dealt)):
        met.setdefault((x["i"], x["j"]), []).append(x["node"])
    pairs = {(min(a, b), max(a, b)) for group in met.values() for a in group for b in group if a != b}
    assert pairs >= {(a, b) for b in range(30, 41) for a in range(b)}
    assert all(any(x >= 30 for x in group) for group in met.values() if len(group) > 1 and len({x >= 30 for x in group}) == 2)
    assert sum(map(len, met.values())) == 30 * 3 + 11 * (3 + 8)


def test_near_duplicates_odd_rows(odd, texts):
    want = brute.near(texts, 5)
    got = rows(near_dedup.near_duplicates(odd))
    assert len(got) == odd.count()
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]][1] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) and r["extra col"] == "e"


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(2))
    both = np.concatenate((a, b))
    # a larger value is a smaller minimum
    assert (near_dedup.registers(both) == np.maximum(near_dedup.registers(a), near_dedup.registers(b))).all()
    for share in (0.4, 0.95):
        n = int(3000 * share)
        x, y = near_dedup.registers(a).astype(int), near_dedup.registers(np.concatenate((a[:n], b[n:]))).astype(int)
        j = n / (6000 - n)
        counts = [np.array([float((x > y).sum())]), np.array([float((x < y).sum())]), np.array([float((x == y).sum())])]
        size = np.array([3000.0])
        assert near_dedup.likely(*counts, size, size, j - 0.15)[0] and not near_dedup.likely(*counts, size, size, min(0.999, j + 0.15))[0]


# --------------------------------------------------------------------- classifier
def test_classifier_learns_and_is_held_out(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    data = [(i, " ".join(word() + ("###" if i % 3 == 0 and r.random() < 0.7 else "") for _ in range(60))) for i in range(300)] + [(900, None), (901, "")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i in range(300)] + [(5000, 1), (None, 1)], "doc_id long, quality int").union(spark.sql("select 1L, cast(null as int)"))
    model = quality_classifier.fit(d, labels)
    got = rows(quality_classifier.score(d, model).withColumn("held", quality_classifier.held_out(F.col("doc_id"))))
    assert all(x["held"] == brute.held_out(x["doc_id"]) and 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in got)
    wrong = [x for x in got if x["held"] and x["doc_id"] < 300 and x["predicted"] != (x["doc_id"] % 3 != 0)]
    assert len(wrong) <= 1
    # labels of held-out rows have no influence
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.fit(d, flipped)
    assert (again[0] == model[0]).all() and again[1] == model[1]


def test_classifier_without_labels(odd, spark):
    model = quality_classifier.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    got = rows(quality_classifier.score(odd, model, keep_text=True))
    assert len(got) == odd.count() and all(r["score"] == 0.5 and r["extra col"] == "e" for r in got)


# ---------------------------------------------------------------------------- BPE
def test_bpe_equals_the_library_and_decodes(docs, texts, ranks):
    own = brute.tokenizer()
    for r in rows(bpe.round_trip(docs.select("doc_id", "text"), *ranks, keep_ids=True)):
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == brute.bpe(own, texts[r["doc_id"]])
        assert r["ids"] == own.encode_ordinary(texts[r["doc_id"]] or "")
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), *ranks), *ranks)
    assert all(r["decoded"] == (texts[r["doc_id"]] or "").encode() and r["ids"] == own.encode_ordinary(texts[r["doc_id"]] or "") for r in rows(coded))


def test_bpe_merges_like_the_library(ranks):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    ours, own = bpe.Encoder(*ranks), brute.tokenizer()

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(st.text(max_size=40), st.text("ab \n'sé", max_size=60)), min_size=1, max_size=5))
    def check(some):
        some = [t.encode("utf-8", "ignore").decode() for t in some]
        flat, at = ours.encode(some)
        assert [flat[a:b].tolist() for a, b in itertools.pairwise(at)] == [own.encode_ordinary(t) for t in some]

    check()


def test_bpe_odd_rows(odd, ranks, texts):
    got = bpe.round_trip(odd, *ranks, keep_ids=True)
    assert dict(got.dtypes)["ids"] == "array<int>"
    own, got = brute.tokenizer(), rows(got)
    assert len(got) == odd.count() and all(r["extra col"] == "e" for r in got)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == brute.bpe(own, texts[9 if r["doc_id"] is None else r["doc_id"]])


# ------------------------------------------------------------------- token counts
def test_token_counts_match_every_segmentation(docs, texts):
    pieces = {p: -float(i + 1) for i, p in enumerate(["▁", "a", "l", "p", "h", "al", "▁al", "pha", "alpha", "b", "e", "t", "be", "ta", "1", "2", "12", "▁the", "o", "r", "d", "w", "word", "▁word"])}
    counter = token_counts.Counter(pieces)
    for r in rows(token_counts.count_tokens(docs.select("doc_id", "text"), pieces)):
        words = brute.WORD.findall(texts[r["doc_id"]] or "")
        assert r["n_words"] == len(words)
        if sum(map(len, words)) < 4000:
            assert r["n_tokens"] == sum(brute.tokens(pieces, counter.byte_score, "▁" + w) for w in words)


def test_token_counts_odd_rows(odd, texts):
    got = rows(token_counts.count_tokens(odd, {"▁": -1.0}))
    assert len(got) == odd.count() and all(r["extra col"] == "e" for r in got)
    for r in got:
        words = brute.WORD.findall(texts[9 if r["doc_id"] is None else r["doc_id"]] or "")
        # the mark is a piece, every other byte is a token
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(1 + len(w.encode()) for w in words))


# --------------------------------------------------------------------- embeddings
def test_near_vectors_match_all_pairs(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((40, 24))
    x = np.concatenate([base, base[:20] + 0.25 * r.standard_normal((20, 24)), base[:10] + 0.05 * r.standard_normal((10, 24)), base[:5], base[:5] * 3])
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    data += [(100, None), (101, []), (102, [0.0] * 24), (103, [None] * 24), (104, [float("nan")] * 24), (105, [1.0, 2.0]), (106, [2.0, 4.0]), (107, [float("inf")] * 24), (None, [1.0, 2.0])]
    got = rows(embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    of = brute.components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(links)), strict=True)])
    for g in got:
        i = g["vec_id"]
        if i is not None and i < len(x):
            assert (g["n_links"], g["component_id"]) == (links[i].sum(), of[i]), g
    by = {g["vec_id"]: g for g in got}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (100, 101, 102, 103, 104, 107))
    assert by[106]["component_id"] == 105 and by[105]["n_links"] == 1 and by[None]["n_links"] == 0


def test_near_vectors_in_blocks(spark, monkeypatch):
    """Blocks of a few vectors and hot keys of a few rows; hubs, copies, an id with two vectors and clashing names."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(common, "HOT", 16)
    r = np.random.default_rng(6)
    x = (r.standard_normal(16) * 3 + 0.3 * r.standard_normal((150, 16))).astype(np.float32)
    x = np.concatenate((x, x[:30], np.repeat(x[5:6], 60, 0), r.standard_normal((40, 16)).astype(np.float32)))
    data = [(i, v.tolist(), "mine", 1) for i, v in enumerate(x)]
    got = rows(embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, kept string, node int").withColumn("copies", F.lit("c")).withColumn("links", F.lit("l")).withColumn("size", F.lit(1))))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    of = brute.components(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(links)), strict=True)])
    assert len(got) == len(x)
    for g in got:
        assert (g["n_links"], g["component_id"], g["kept"], g["node"]) == (links[g["vec_id"]].sum(), of[g["vec_id"]], of[g["vec_id"]] == g["vec_id"], 1)


def test_near_vectors_that_share_an_id(spark):
    """Rows of one id have the links of each of its vectors and join their groups."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    data = [(1, a), (2, a), (5, a), (5, b), (7, b), (7, b), (9, c), (9, None)]
    got = sorted((g["vec_id"], g["n_links"], g["component_id"]) for g in rows(embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"))))
    assert [x[::2] for x in got] == [(1, 1), (2, 1), (5, 1), (5, 1), (7, 1), (7, 1), (9, 9), (9, 9)]
    assert [x[1] for x in got] == [2, 2, 2, 2, 2, 2, 0, 0]


def test_sketches_allow_pairs_at_the_threshold():
    """Pairs at 0.95 differ in no more signs than candidates may, in all but a few of a million."""
    r = np.random.default_rng(3)
    planes = embedding_dedup._planes(32, 4, 4)
    x = r.standard_normal((20_000, 32))
    y = r.standard_normal((20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    differ = ((x @ planes > 0) != (y @ planes > 0)).sum(1)
    assert differ.max() <= embedding_dedup.most_differing(0.95) < 100
    meet = (((x @ planes > 0)[:, :4]) == ((y @ planes > 0)[:, :4])).all(1).mean()
    assert abs(meet - (1 - np.arccos(0.95) / np.pi) ** 4) < 0.02


# ------------------------------------------------------------------------- mixing
def test_mixing_counts_and_order(docs):
    weights = {"s0": 3.0, "s1": 1.0}
    got = rows(mixing.mix_sources(docs, weights=weights, total=400.0))
    again = rows(mixing.mix_sources(docs.repartition(5), weights=weights, total=400.0))
    key = lambda r: (r["shuffle_key"], r["doc_id"], r["replica"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    n = {s: sum(r["source"] == s for r in got) for s in ("s0", "s1", "s2")}
    assert n["s2"] == 0 and 240 < n["s0"] < 360 and 60 < n["s1"] < 145
    per = {}
    for r in got:
        per.setdefault(r["doc_id"], []).append(r["replica"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())


def test_poisson_table_inverts(spark):
    import math

    for mean in (0.2, 1.0, 7.5, 60.0):
        table = spark.range(1).select(mixing.poisson_table(F.lit(mean)).alias("t")).first()["t"]
        want = np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(len(table))])
        assert np.allclose(table, want, atol=1e-12) and table[-1] > 1 - 1e-12


def test_mixing_with_many_sources(docs, monkeypatch):
    want = sorted(map(str, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == want


def test_mixing_reaches_high_rates(spark, monkeypatch):
    import hashlib
    import math

    def want(mean, doc_id):
        u = int(hashlib.md5(f"1:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, total = 0, math.exp(-mean)
        p = total
        while total <= u:
            k += 1
            p *= mean / k
            total += p
        return k

    def replicas(n, rare, weights):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < rare, "rare").otherwise("common").alias("source"))
        out = {}
        for r in mixing.mix_sources(docs, weights=weights).where("source = 'rare'").collect():
            out.setdefault(r["doc_id"], []).append(r["replica"])
        assert all(sorted(v) == list(range(1, len(v) + 1)) for v in out.values())
        return {i: len(v) for i, v in out.items()}

    # 2 of 1000 rows with half of the weight: a rate of 250, by one draw
    assert replicas(1000, 2, {"rare": 1.0, "common": 1.0}) == {i: want(250.0, i) for i in range(2)}
    # 2 of 8000 rows: a rate of 2000, by four draws; seven standard deviations
    got = replicas(8000, 2, {"rare": 1.0, "common": 1.0})
    assert set(got) == {0, 1} and got[0] != got[1] and all(abs(k - 2000) < 7 * 2000**0.5 for k in got.values())
    monkeypatch.setattr(mixing, "MOST_NUMBERS", 0)
    assert replicas(8000, 2, {"rare": 1.0, "common": 1.0}) == got


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows", "equal rows of null id"])
def test_mixing_reaches_the_weights_of_rows_that_share_an_id(spark, kind):
    """Ten thousand rows with nothing of their own, or with a text only: their mean count is the rate, and the counts spread as Poisson's do."""
    doc_id = F.lit(None).cast("long") if "null" in kind else F.lit(5).cast("long")
    text = F.lit("same") if "equal" in kind else F.concat(F.lit("text "), F.col("id").cast("string"))
    rows_ = spark.range(10_000).select(doc_id.alias("doc_id"), F.lit("many").alias("source"), text.alias("text"))
    docs = rows_.union(spark.range(2_000).select(F.col("id") + 10, F.lit("few"), F.lit("other")))
    got = mixing.mix_sources(docs, weights={"many": 3.0, "few": 1.0}, total=20_000.0).where("source = 'many'")
    n = got.count()
    assert abs(n - 15_000) < 5 * 15_000**0.5
    if "equal" not in kind:
        counts = [r["count"] for r in got.groupBy("text").count().collect()]
        assert abs(len(counts) / 10_000 - (1 - np.exp(-1.5))) < 0.03 and max(counts) < 12
    assert got.where("replica = 1").count() == got.select("shuffle_key").where("replica = 1").distinct().count()


def test_mixing_equals_its_sql_on_shared_ids_and_high_rates(spark):
    """Null and repeated ids, equal rows, and a source whose rate needs several draws."""
    import duckdb
    import pandas as pd

    rows_ = [(i % 40 if i % 3 else None, f"t{i % 50}", "en", "common", 3) for i in range(6000)] + [(10_000 + i, "rare text", None, f"rare{i}", 9) for i in range(2)]
    frame = pd.DataFrame(rows_, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    sql = mixing.OP9_SQL.replace("0.7)", "0.05)")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    old = mixing.TEMPERATURE
    mixing.TEMPERATURE = 0.05
    try:
        got = sorted(map(str, map(tuple, mixing.mix_sources(docs).select(*names).collect())))
    finally:
        mixing.TEMPERATURE = old
    assert got == sorted(map(str, cursor.fetchall())) and max(n for n in (sum("rare0" in g for g in got),)) > 1024


def test_mixing_odd_rows(odd, spark):
    got = mixing.mix_sources(odd)
    assert "extra col" in got.columns
    own = [c for c in odd.columns if c not in {"replica", "shuffle_key"}]
    assert {str(r) for r in got.select(*own).collect()} <= {str(r) for r in odd.select(*own).collect()}
    again = mixing.mix_sources(odd.repartition(7))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert mixing.mix_sources(odd, weights={}).count() == 0


# ----------------------------------------------------------------------- sharding
def test_store_appends_compacts_and_commits_once(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=200_000, fan=3)
    for k in range(7):
        store.append(docs.where(f"doc_id % 7 = {k}").repartition(2))
    before = store.manifest()
    assert before[0] == 7 and len(before[2]) >= 7
    last = store.compact()
    assert last > 7 and len(store.manifest()[2]) < len(before[2])
    for version in (7, last):
        assert sorted(map(str, store.read(version).collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(sharding.Conflict):
        store.commit(last - 1, before[1], [])
    assert store.versions()[-1] == last and not [f for f in (tmp_path / "store/manifests").iterdir() if f.name.endswith(".tmp")]
    store.vacuum()
    assert store.versions() == [last] and store.read().count() == docs.count()
    with pytest.raises(ValueError):
        store.append(docs.select("doc_id"))


def test_commits_write_the_segments_that_changed(spark, tmp_path, monkeypatch):
    """Segments of a few shards: an append leaves the others as they are; small ones are joined; readers of old versions find theirs."""
    monkeypatch.setattr(sharding, "SEGMENT", 4)
    monkeypatch.setattr(sharding, "SMALL_SEGMENTS", 3)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=10**9)
    data = spark.range(60).select("id")
    listed = []
    for k in range(9):
        store.append(data.where(f"id % 9 = {k}").repartition(1 if k % 2 else 5))
        listed.append(store.segments(k + 1))
        assert all(len(store.segment(n)) <= 4 for n in listed[-1])
    assert all(set(listed[i]) & set(listed[i + 1]) for i in range(2, 8))  # some segment is taken over each time
    other = sharding.ShardStore(spark, store.root)
    for version in (1, 5, 9):
        assert sorted(r.id for r in other.read(version).collect()) == sorted(i for i in range(60) if i % 9 < version)
    store.compact()
    store.vacuum()
    there = {f.name for f in (tmp_path / "store/segments").iterdir() if not f.name.startswith(".")}
    assert there == set(store.segments(store.versions()[-1])) and sharding.ShardStore(spark, store.root).read().count() == 60


def test_compaction_writes_each_run_as_a_file(spark, tmp_path):
    """Runs are planned by tier and size; each becomes one file with the rows of its own shards, near the target."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target=400_000, fan=3)
    data = spark.range(24_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    for k in range(24):
        store.append(data.where(f"id % 24 = {k}").coalesce(1))
    whole = store.manifest()[2]
    runs = store.plan(whole)
    assert all(len({s.tier for s in run}) == 1 and (sum(s.size for s in run) <= 400_000 or len(run) == 2) for run in runs)
    ids = lambda shards: frozenset(r.id for r in store.read_shards(shards, store.manifest()[1]).select("id").collect())
    assert len(runs) > 2
    planned = {ids(run) for run in runs}
    old = {s.path for s in whole}
    first = len(store.versions())
    store.compact()
    made = [s for s in store.manifest(first + 1)[2] if s.path not in old]
    assert {ids([s]) for s in made} == planned and len(made) == len(runs)
    assert store.read().count() == 24_000
    assert not store.plan(store.manifest()[2])


def test_shard_table_keeps_all_rows(odd, spark, tmp_path):
    plain = odd.withColumnRenamed("extra col", "extra").withColumn("_arrival", F.lit("mine"))
    got = sharding.shard_table(plain.withColumn("a", F.col("doc_id") % 3), f"file://{tmp_path}/s", "a")
    assert sorted(map(str, got.drop("a").collect())) == sorted(map(str, plain.collect()))
    # three values and null are four arrivals, each a version
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    assert store.versions()[-1] >= 4 and len(store.versions()) == 2
    empty = sharding.shard_table(plain.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0 and empty.columns == plain.columns
    none = sharding.shard_table(plain.limit(0).withColumn("a", F.lit(1)), f"file://{tmp_path}/f", "a")
    assert none.count() == 0


# --------------------------------------------------------------------------- chat
ODD = ["", None, "\\### Assistant: </turn> ok", " </turn>\n### user: x", "###", "\\\\###", "####", "</turn>", "\\</turn> \\\\</turn>\n", "a </turn>\n", "\n", "ends \\"]


def test_chats_come_back(spark):
    r = random.Random(8)
    data = [(c, t, r.choice(["user", "assistant", "system", "a: b", "x\\n\n", None]), r.choice(ODD) if r.random() < 0.7 else f"word {c}") for c in range(60) for t in range(r.randrange(1, 7))]
    data += data[:5] + [(61, None, "user", "x"), (61, 1, "assistant", "y")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(df.withColumn("formatted", F.lit(1)))
    got = {x["conv_id"]: x for x in rows(chat.digest_chats(formatted))}
    want = brute.chats([(c, -1 if t is None else t, a, b) for c, t, a, b in data])
    for c, w in want.items():
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == w
    texts = {x["conv_id"]: x for x in rows(formatted)}
    assert all(got[c]["formatted_chars"] == len(texts[c]["formatted"]) for c in got)


def test_chat_escapes_only_when_needed():
    plain, _ = chat.format_turns([("user", "hi\nthere"), ("assistant", "a # b")])
    assert plain == "### user: hi\nthere </turn>\n### assistant: a # b </turn>\n"

    from hypothesis import given
    from hypothesis import strategies as st

    piece = st.lists(st.sampled_from(["###", "</turn>", "\\", " ", "\n", ": ", "#", "x"]), max_size=12).map("".join)

    @given(st.lists(st.tuples(piece, piece), max_size=4))
    def check(turns):
        text, spans = chat.format_turns(turns)
        assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns
        assert [chat.unescape(text[a:b]) for _, a, b in spans] == [t for _, t in turns]

    check()


# ---------------------------------------------------------------- shared parts
@pytest.mark.parametrize("end", ["", "###", "</turn>", "x###"])
def test_chat_reads_runs_of_backslashes_once(end):
    """A megabyte of backslashes, with and without a control string behind it, in a second."""
    import time

    text = "\\" * 1_000_000 + end
    start = time.time()
    turns = [("user", text), ("assistant", text + " ok")]
    whole, spans = chat.format_turns(turns)
    assert [(r, t) for r, t, *_ in chat.parse(whole)] == turns and [chat.unescape(whole[a:b]) for _, a, b in spans] == [t for _, t in turns]
    assert chat.unescape(chat.escape(text)) == text
    assert time.time() - start < 2


def test_digests_of_odd_rows(spark):
    kind = "conv_id long, formatted string, loss_spans array<struct<start:int,end:int>>, n_turns string"
    got = rows(chat.digest_chats(spark.createDataFrame([(None, "", [], "mine"), (1, "", None, "mine"), (1, "", [], "mine")], kind)))
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"], r["formatted_chars"]) for r in got] == [(None, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0)]
    with pytest.raises(Exception, match="not of the grammar"):
        chat.digest_chats(spark.createDataFrame([(1, None, [], "")], kind)).collect()


def test_roots_of_matrices():
    r = np.random.default_rng(5)
    for n, p in ((1, 0.5), (30, 0.02), (80, 0.02), (60, 0.0), (50, 0.5)):
        a = r.random((n, n)) < p
        a |= a.T
        of = brute.components(range(n), [(int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True) if i != j])
        assert common.roots(a).tolist() == [of[i] for i in range(n)]
    chain = np.eye(300, k=1, dtype=bool)
    order = r.permutation(300)
    assert (common.roots((chain | chain.T)[np.ix_(order, order)]) == 0).all()


def test_hot_joins_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10)
    left = spark.range(500).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("w")).where("k < 30")
    for how in ("inner", "left"):
        want = sorted((r.k, r.id, r.w) if r.w else (r.k, r.id, 0) for r in left.join(right, "k", how).collect())
        got = sorted((r.k, r.id, r.w) if r.w else (r.k, r.id, 0) for r in common.join_hot(left, right, ["k"], "w", 500, "id", how).collect())
        assert got == want


def test_components(spark):
    r = random.Random(9)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    got = {x["node"]: x["component"] for x in common.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {x for p in pairs for x in p}
    want = brute.components(nodes, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_in_steps(spark, monkeypatch):
    r = random.Random(11)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1030)] + [(2000, i) for i in range(2001, 2060)] + [(-3, 5), (7, 7)]
    want = brute.components({x for p in pairs for x in p}, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    monkeypatch.setattr(common, "HOT", 16)
    steps, made = common._star, []

    def star(e, large, total):
        out = steps(e, large, total)
        made.append((out.count(), e.count()))
        return out

    monkeypatch.setattr(common, "_star", star)
    got = common.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert len(got) == len(linked) and {x["node"]: x["component"] for x in got} == {x: want[x] for x in linked}
    # no step makes more rows than it reads
    assert made and all(rows_ <= read for rows_, read in made)
    made.clear()
    stars = [(7, i) for i in range(20, 60)] + [(3, 2), (9, 8), (-1, 70)]
    assert {(x["node"], x["component"]) for x in common.connected_components(spark.createDataFrame(stars, "u long, v long")).collect()} == {(max(a, b), min(a, b)) for a, b in stars} | {(min(a, b), min(a, b)) for a, b in stars}
    assert not made  # a graph of stars needs no step


def test_scratch_tables_go_with_their_scope(spark):
    import os

    def there(df):
        return os.path.exists(df._cut_path.removeprefix("file://"))

    with common.Scope(spark):
        with common.Scope(spark) as inner:
            a, b = common.cut(spark.range(3), "a"), inner.keep(common.cut(spark.range(4), "b"))
        assert not there(a) and there(b) and b.count() == 4
    assert not there(b)


def test_very_long_texts(spark, ranks, tmp_path):
    """A megabyte of words, of one word and of marks, through every operator on texts."""
    r = random.Random(4)
    words = " ".join(f"w{r.randrange(5000)}" for _ in range(180_000))
    long = {0: words, 1: words.replace("w77 ", "w78 "), 2: "x" * 1_000_000, 3: "\n" * 300_000 + "# " * 300_000, 4: "short"}
    df = spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in long.items()], "doc_id long, text string, source string, lang string, n_chars long").repartition(5).cache()
    for x in rows(quality_rules.measure(df)):
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == brute.rules(long[x["doc_id"]])
    want = brute.near(long, 5)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows(near_dedup.near_duplicates(df))} == want
    own = brute.tokenizer()
    some = df.where("doc_id <> 2")  # the plain tokenizer is slow on a word of a megabyte
    for x in rows(bpe.round_trip(some, *ranks)):
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == brute.bpe(own, long[x["doc_id"]])
    one = rows(bpe.round_trip(df.where("doc_id = 2"), *ranks))
    assert one[0]["decoded_sha256"] == brute.sha(long[2])
    for x in rows(token_counts.count_tokens(df, {"▁": -1.0})):
        found = long[x["doc_id"]].split()
        assert (x["n_words"], x["n_tokens"]) == (len(found), sum(map(len, found)) + len(found))
    scores = {x["doc_id"]: x["score"] for x in rows(quality_classifier.score(df, (np.linspace(-1, 1, quality_classifier.DIMENSIONS, dtype=np.float32), 0.1)))}
    alone = {i: quality_classifier.score_texts([t.encode()], np.linspace(-1, 1, quality_classifier.DIMENSIONS, dtype=np.float32), 0.1)[0] for i, t in long.items()}
    assert scores == pytest.approx(alone)
    found = dict(zip([i for i in long if i != 2], brute.bootstrap([t for i, t in long.items() if i != 2]), strict=True)) | {2: []}  # the plain rules are slow on a word of a megabyte
    for x in rows(pii.extract_pii(df.select("doc_id", "text"))):
        assert spans_of(x) == found[x["doc_id"]]
    kept = rows(sharding.shard_table(df, f"file://{tmp_path}/long", target=100_000))
    assert {x["doc_id"]: x["text"] for x in kept} == long
    drawn = rows(mixing.mix_sources(df, weights={"s": 1.0}, total=15.0).select("doc_id", F.length("text").alias("n")))
    assert drawn and all(x["n"] == len(long[x["doc_id"]]) for x in drawn)
    chats = df.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text")
    assert rows(chat.digest_chats(chat.format_chats(chats)))[0]["loss_chars"] == sum(map(len, long.values()))


def test_empty_tables(spark, docs, ranks):
    none = docs.limit(0)
    assert pii.extract_pii(none).count() == 0
    assert quality_rules.judge(none, "source").count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert quality_classifier.score(none, quality_classifier.fit(none, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    assert bpe.round_trip(none, *ranks).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert token_counts.count_tokens(none, {"a": -1.0}).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.digest_chats(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_token_hashes_tell_words_apart():
    texts = [b"Ab ab cd", b"", b"ab\ncd  ", b"x\xc3\xa9y"]
    h, doc, *_ = common.token_hashes(texts)
    assert doc.tolist() == [0, 0, 0, 2, 2, 3] and h[0] == h[1] == h[3] and h[2] == h[4] and len(set(h.tolist())) == 3
