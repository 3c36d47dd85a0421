"""Personal data (operator 3): bootstrapped contextual extraction, native.

Base rules find e-mail addresses, IP addresses, card and phone numbers; a seed
rule finds strings that look like secrets.  These entities label the
identifier-like tokens they overlap.  Lexical patterns are the words around a
token: two words before it, a word on each side, or one word and the token's
shape.  Patterns and token strings form a graph that is scored in rounds: a
pattern's confidence is the share of its distinct strings that are known
entities of one kind, and strings of confident patterns become known entities
for the next round, until no pattern is added.  Tokens that no base rule found
but a confident pattern did are further spans.

All of it is DataFrame expressions.  One scan of the texts writes spans and
candidates to the checkpoint folder; the rounds run on that small table, with
aggregates that combine before their shuffle and joins that broadcast what is
counted and small, or deal a hot pattern to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.arrays import let, running, running_sums
from leafwork.llm.common import cut, drop_table, join_hot, join_small, read_cut, write_cut

# The kinds in their order and the rules of the contract.  The look-behinds, \\G and possessive
# quantifiers change no match; they keep the search linear in long runs of one class.
BASE_KINDS = ["email", "ip", "card", "phone"]
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Tokens that may be identifiers: a digit or an @ somewhere between white space.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What an identifier-like token is as a context word of others.
PLACEHOLDER = "<num>"

#: Strings that seed the kind secret: 32 hexadecimal digits or more, of which some are letters and some are not.
SECRET = r"(?<![0-9a-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}+(?![0-9a-z])"
#: All kinds, by their numbers in spans.  Secrets come from contexts only, never from their seed rule alone.
KINDS = [*BASE_KINDS, "secret"]

SPANS_TYPE = "array<struct<s:int,e:int,m:string>>"


def find_spans(text: Column, rule: str) -> Column:
    """All leftmost non-overlapping matches: array of (s, e, m), in code points, e exclusive."""
    parts = F.struct(F.transform(F.split(text, rule, -1), lambda g: F.length(g)).alias("gaps"), F.regexp_extract_all(text, F.lit(rule), F.lit(0)).alias("found"))

    def body(x: Column) -> Column:
        at = running_sums(F.zip_with(x["gaps"], x["found"], lambda g, m: (g + F.coalesce(F.length(m), F.lit(0))).cast("long")))
        starts = F.zip_with(at, x["gaps"], lambda a, g: (a + g).cast("int"))
        spans = F.zip_with(starts, x["found"], lambda s, m: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))
        return F.slice(spans, 1, F.size(x["found"]))

    return let(parts, body)


def find_tokens(text: Column) -> Column:
    """Identifier-like tokens with up to two words before and one after, wherever
    they stand in the text; words that are such tokens themselves are PLACEHOLDER.
    Array of (s, e, token, left2, left1, right1)."""

    def last(gap: Column, skip: str) -> Column:
        # backwards and anchored, so that only the words asked for are looked at
        return F.lower(F.reverse(F.regexp_extract(F.reverse(gap), rf"^[\x20\x09-\x0D]*+{skip}([^\x20\x09-\x0D]++)", 1)))

    first = lambda g: F.lower(F.regexp_extract(g, r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1))
    gaps = F.transform(F.split(text, TOKEN, -1), lambda g: F.struct(F.length(g).alias("n"), last(g, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]++").alias("g2"), last(g, "").alias("g1"), first(g).alias("f1")))
    parts = F.struct(gaps.alias("gaps"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("found"))

    def body(x: Column) -> Column:
        lengths = F.zip_with(x["gaps"], x["found"], lambda g, m: (g["n"] + F.coalesce(F.length(m), F.lit(0))).cast("long"))

        def token(m: Column, i: Column, at: Column) -> Column:
            own, before = F.get(x["gaps"], i), F.get(x["gaps"], i - 1)
            after = lambda k: F.when(i > k, PLACEHOLDER).otherwise("")
            left1 = F.when(own["g1"] != "", own["g1"]).otherwise(after(0))
            beyond = F.when(i == 0, "").when(before["g1"] != "", before["g1"]).otherwise(after(1))
            left2 = F.when(own["g2"] != "", own["g2"]).when(own["g1"] != "", after(0)).otherwise(beyond)
            behind = F.get(x["gaps"], i + 1)["f1"]
            right1 = F.when(behind != "", behind).when(i < F.size(x["found"]) - 1, PLACEHOLDER).otherwise("")
            s = (F.get(at, i) + own["n"]).cast("int")
            return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("token"), left2.alias("left2"), left1.alias("left1"), right1.alias("right1"))

        return let(running_sums(lengths), lambda at: F.transform(x["found"], lambda m, i: token(m, i, at)))

    return let(parts, body)


def kinds_of(tokens: Column, base: Column) -> Column:
    """For each of an array of tokens, in order: the kind of the base span that
    overlaps it, of several the one that reaches farthest; null without one.

    Both are sorted together, and the farthest end so far is carried along."""
    spans = F.transform(base, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("tag"), (b["e"].cast("long") * 8 + b["k"]).alias("code"), F.lit(0).alias("s")))
    own = F.transform(tokens, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("tag"), F.lit(0).cast("long").alias("code"), x["s"].alias("s")))

    def body(events: Column) -> Column:
        reach = running(F.transform(events, lambda x: x["code"]), lambda a, b: F.greatest(a, b))
        met = F.zip_with(events, reach, lambda x, r: F.struct(x["tag"].alias("tag"), x["s"].alias("s"), r.alias("r")))
        return F.transform(F.filter(met, lambda x: x["tag"] == 0), lambda x: F.when(F.shiftright(x["r"], 3) > x["s"], (x["r"] % 8).cast("int")))

    none = F.transform(tokens, lambda x: F.lit(None).cast("int"))
    return F.when(F.size(base) == 0, none).otherwise(let(F.array_sort(F.concat(spans, own)), body))


def base_spans(text: Column) -> Column:
    """The spans of the base rules: array of (s, k, e, m), by start and then kind; k is the place of the kind in KINDS."""
    none = F.array().cast(SPANS_TYPE)
    digits = lambda m: F.regexp_replace(m, r"[^0-9]", "")
    found = {
        "email": F.when(text.contains("@"), find_spans(text, RULES["email"])).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(find_spans(text, RULES["ip"]), lambda x: x["m"].rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))).otherwise(none),
        "card": F.when(text.rlike(r"[0-9][\x20-]?[0-9]"), F.filter(find_spans(text, RULES["card"]), lambda x: F.length(digits(x["m"])).between(14, 19) & F.call_function("luhn_check", digits(x["m"])))).otherwise(none),
        "phone": F.when(text.contains("+"), F.filter(find_spans(text, RULES["phone"]), lambda x: F.length(digits(x["m"])).between(10, 15))).otherwise(none),
    }

    def tagged(kind: str) -> Column:
        k = F.lit(BASE_KINDS.index(kind)).alias("k")
        return F.transform(found[kind], lambda x: F.struct(x["s"].alias("s"), k, x["e"].alias("e"), x["m"].alias("m")))

    return F.array_sort(F.concat(*map(tagged, BASE_KINDS)))


def count_kind(spans: str, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of (s, k, e, ...) that is in order."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def extract_pii(docs: DataFrame, text: str = "text", support: int = 5, confidence: float = 0.8, least_digits: int = 2, least_chars: int = 5) -> DataFrame:
    """One row for each row of docs: the columns of docs except ``text``, then
    ``base`` and ``spans`` (arrays of (s, k, e, m), by start, then kind, then end).

    A pattern is confident if ``support`` of its distinct strings or more are known
    entities of one kind and these are a share of ``confidence`` of its strings and
    one more.  Known are strings that a base span overlaps or the seed rule of
    secrets matches where the pattern stands, and all strings that a confident
    pattern found before.  A string or a token gets the kind whose patterns'
    noisy-or is highest, of equal ones the first.  To be found, a token must
    overlap no base span and have ``least_digits`` digits (or an @) and
    ``least_chars`` characters; marks around it are no part of it.

    Null or empty text: no spans.  Very long texts: work and memory follow the
    text, without a cut; n matches of a rule cost n * sqrt(n).  Repeated rows:
    each gets its own result; copies of a string count once for a pattern.
    Empty table: empty result.  Columns of docs that clash with base, spans or
    names that begin with _pii are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in {text, "base", "spans"} and not c.startswith("_pii")]
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*keep, t.alias("_pii_text")).withColumn("base", base_spans(F.col("_pii_text")))
    rows = rows.withColumn("_pii_tokens", F.when(F.col("_pii_text").rlike("[0-9@]"), find_tokens(F.col("_pii_text"))))
    rows = rows.withColumn("_pii_kinds", F.when(F.col("_pii_tokens").isNotNull(), kinds_of(F.col("_pii_tokens"), F.col("base"))))
    scanned = cut(rows.drop("_pii_text").withColumn("_pii_row", F.monotonically_increasing_id()), "pii")

    tokens = scanned.where(F.size("_pii_tokens") > 0).select("_pii_row", F.explode(F.arrays_zip("_pii_tokens", "_pii_kinds")).alias("z"))
    tokens = tokens.select("_pii_row", "z._pii_tokens.*", F.col("z._pii_kinds").alias("k"))
    lead, tail = F.length(F.regexp_extract("token", r"^[^\p{L}\p{N}+@_]*+", 0)), F.length(F.regexp_extract(F.reverse("token"), r"^[^\p{L}\p{N}_]*+", 0))
    tokens = tokens.withColumn("lead", lead).withColumn("tail", tail)
    tokens = tokens.select("_pii_row", (F.col("s") + F.col("lead")).alias("s"), (F.col("e") - F.col("tail")).alias("e"), F.lower(F.substring("token", F.col("lead") + 1, F.length("token") - F.col("lead") - F.col("tail"))).alias("token"), "left2", "left1", "right1", "k")
    shaped = ((F.regexp_count("token", F.lit("[0-9]")) >= least_digits) | F.col("token").contains("@")) & (F.length("token") >= least_chars)
    tokens = tokens.select("_pii_row", "s", "e", "token", "k", shaped.alias("ok"), F.array_compact(F.array(*_patterns())).alias("patterns"))

    label = F.coalesce("k", F.when(F.col("token").rlike(SECRET), KINDS.index("secret")))
    edges = tokens.select(F.explode("patterns").alias("pattern"), F.xxhash64("token").alias("string"), label.alias("k"), "ok").groupBy("pattern", "string").agg(F.max("k").alias("k"), F.first("ok").alias("ok"))
    edges = cut(edges, "pii-all-edges")
    # fewer strings than the support can never be enough
    sizes = cut(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support), "pii-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    edges = cut(join_hot(edges, sizes, ["pattern"], "n", total, "string"), "pii-edges")

    patterns = known = None
    before = 0
    while True:
        labelled = edges if known is None else join_small(edges, known, ["string"], "left").withColumn("k", F.coalesce("k", "found"))
        counts = labelled.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count_if(F.col("k") == i).alias(f"p{i}") for i in range(len(KINDS))])
        most = F.greatest(*[f"p{i}" for i in range(len(KINDS))])
        kind = F.array_position(F.array(*[f"p{i}" for i in range(len(KINDS))]), most).cast("int") - 1
        counts = counts.select("pattern", kind.alias("kind"), most.alias("p"), (most / (F.col("n") + 1)).alias("c")).where((F.col("p") >= support) & (F.col("c") >= confidence))
        if patterns is not None:
            drop_table(spark, patterns)
        patterns = write_cut(counts, "pii-patterns")
        confident = read_cut(spark, patterns, counts)
        # known entities never become fewer, so neither do confident patterns
        size = confident.count()
        if size == before:
            break
        before = size
        found = _kind_by_patterns(join_small(edges.where("k is null and ok").select("pattern", "string"), confident, ["pattern"]), ["string"])
        found = found if known is None else known.union(found.join(known, "string", "left_anti"))
        known = cut(found, "pii-known")
    added = tokens.where(F.col("k").isNull() & F.col("ok")).select("_pii_row", "s", "e", F.explode("patterns").alias("pattern"), F.col("token").alias("m"))
    added = _kind_by_patterns(join_small(added, confident, ["pattern"]), ["_pii_row", "s", "e", "m"])
    added = added.groupBy("_pii_row").agg(F.collect_list(F.struct("s", F.col("found").alias("k"), "e", "m")).alias("_pii_more"))
    # rows with found spans are few as a rule, and scanned may carry texts
    out = join_small(scanned, cut(added, "pii-added"), ["_pii_row"], "left").withColumn("spans", F.when(F.col("_pii_more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "_pii_more"))))
    return out.select(*keep, "base", "spans")


def _kind_by_patterns(met: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, found): the kind whose patterns' noisy-or is highest, of equal ones the first."""
    doubt = [F.round(F.sum(F.when(F.col("kind") == i, F.log(1 - F.col("c"))).otherwise(0.0)), 9).alias(f"d{i}") for i in range(len(KINDS))]
    least = F.least(*[f"d{i}" for i in range(len(KINDS))])
    return met.groupBy(*keys).agg(*doubt).select(*keys, (F.array_position(F.array(*[f"d{i}" for i in range(len(KINDS))]), least).cast("int") - 1).alias("found"))


def _patterns() -> list[Column]:
    """Lexical patterns of a token, as hashes: its two left words, the word on each
    side, and one word with the token's shape.  Each has a real word in it."""
    l2, l1, r1 = F.col("left2"), F.col("left1"), F.col("right1")
    there, real = lambda w: w != "", lambda w: ~w.isin("", PLACEHOLDER)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("token", "[0-9]", "9"), "9{5,}", "9+"), r"\p{L}+", "a")
    return [
        F.when(there(l2) & there(l1) & (real(l2) | real(l1)), F.xxhash64(F.lit("l"), l2, l1)),
        F.when(there(l1) & there(r1) & (real(l1) | real(r1)), F.xxhash64(F.lit("b"), l1, r1)),
        F.when(real(l1), F.xxhash64(F.lit("s"), l1, shape)),
        F.when(real(r1), F.xxhash64(F.lit("r"), shape, r1)),
    ]


def mask_spans(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; where spans
    overlap, the first one wins and the rest of the other is dropped.  Null text: null;
    no spans: the text as it is.  Spans are in order of start; of two with one start the
    first in the array wins.  Equal spans are replaced once.

    The text is cut in runs of spans first, then each run at its spans, so that no
    place of a long text is sought from its beginning once for each span."""
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def pieces(kept: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(kept))).cast("int")

        def run(part: Column) -> Column:
            first = F.get(part, F.lit(0))["p"]
            inner = lambda own: F.array_join(F.transform(part, lambda x: F.concat(F.substring(own, x["p"] - first + 1, x["s"] - x["p"]), F.get(kinds, x["k"]))), "")
            return let(F.substring(text, first + 1, F.element_at(part, -1)["e"] - first), inner)

        runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(kept) / step).cast("int") - 1), lambda i: let(F.slice(kept, i * step + 1, step), run))
        return F.concat(F.array_join(runs, ""), F.substring(text, F.element_at(kept, -1)["e"] + 1, F.length(text)))

    # p: the farthest end of the spans before; a span that begins before it is inside another
    ends = running(F.transform(spans, lambda x: x["e"].cast("long")), lambda a, b: F.greatest(a, b))
    kept = F.zip_with(spans, ends, lambda x, p: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), p.cast("int").alias("p")))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.filter(kept, lambda x: x["s"] >= x["p"]), pieces))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = extract_pii(docs)
    counts = [count_kind("base", kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
