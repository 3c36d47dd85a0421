"""Text functions as Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.functions.arrays import let

# Patterns and word lists that results depend on.
YEAR = r"(?<![A-Za-z0-9_])((?:1[89][0-9]{2}|20[0-3][0-9])(?![A-Za-z0-9_])(?:\s*[-–]\s*[0-9]{2,4})?)"
YEAR_TOKEN = r"^(1[89][0-9]{2}|20[0-3][0-9])([-–/][0-9]{2,4})?$"
ACCESSION = r"(?i)ACC(?:ESSION)?[._\s-]*NO\.?[._\s:-]*([A-Za-z]?[-\s]?[0-9]{2,})"
PAGE_NUMBER = r"(?iu)^[-–—]?\s*[0-9\x{0966}-\x{096F}]{1,4}\s*[-–—]?$|^(?:page|पृष्ठ|पृ\.?)\s*\.?\s*[0-9]{1,4}$"
CONNECTORS = ["to", "and", "&", "-", "–", "—", "/"]
ORG_KEYWORDS = [
    "DIRECTORATE", "MINISTRY", "DEPARTMENT", "DEPTT", "GOVERNMENT", "GOVT", "COMMISSION", "INSTITUTE", "ORGANISATION", "ORGANIZATION", "BUREAU", "COUNCIL", "BOARD", "SOCIETY",
    "UNIVERSITY", "ASSOCIATION", "OFFICE", "DIVISION", "CORPORATION", "PUBLISHED", "PUBLICATIONS", "CONTROLLER", "AUTHORITY", "COMMITTEE", "CENTRE", "FEDERATION",
]


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def detect_script(text: Column) -> Column:
    """hi-en, hi, en, num or und by the scripts that occur; null or blank text is und."""
    deva, latin = text.rlike(r"[\x{0900}-\x{097F}]"), text.rlike("[A-Za-z]")
    return F.when(text.isNull(), "und").when(deva & latin, "hi-en").when(deva, "hi").when(latin, "en").when(text.rlike(r"[0-9\x{0966}-\x{096F}]"), "num").otherwise("und")


def digit_ratio(text: Column) -> Column:
    """Digits over characters that are not white space; 0 without any."""
    solid = F.regexp_replace(text, r"\s", "")
    return F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, r"[^0-9\x{0966}-\x{096F}]", "")) / F.length(solid)).otherwise(0.0)


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def has_letters(text: Column, n: int) -> Column:
    """Whether letters(text) >= n, found without a copy of the letters."""
    return text.rlike(r"[^\p{L}]*".join([r"\p{L}"] * n))


def tidy(text: Column, limit: int = 250) -> Column:
    """Without marks at either end, and cut."""
    ends = r"[ \t,;:.\-–—]+"
    return F.trim(F.substring(F.regexp_replace(F.regexp_replace(text, f"^{ends}", ""), f"{ends}$", ""), 1, limit))


def sanitize_filename(name: Column, fallback: str = "file") -> Column:
    base = F.regexp_replace(F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1), r"[^A-Za-z0-9._-]+", "_")
    clean = F.regexp_replace(base, r"^[._]+|[._]+$", "")
    return F.when(clean == "", F.lit(fallback)).otherwise(clean)


def export_basename(name: Column) -> Column:
    stem = F.regexp_extract(name, r"([^/\\]*?)(\.[^./\\]*)?$", 1)
    return F.when(stem == "", "document").otherwise(stem)


def first_year(text: Column) -> Column:
    """The first year 1800 to 2039, with its range if there is one, as it stands; null without one."""
    return F.nullif(F.regexp_extract(text, YEAR, 1), F.lit(""))


def accession_number(name: Column, prefix: str = "D") -> Column:
    """An accession number such as D-1087 from a file name or a line."""
    raw = F.upper(F.regexp_replace(F.trim(F.regexp_extract(name, ACCESSION, 1)), r" ", ""))
    own = F.regexp_extract(raw, r"^([A-Z]+)-?([0-9]+)$", 1)
    return F.when(own != "", F.concat(own, F.lit("-"), F.regexp_extract(raw, r"([0-9]+)$", 1))).when(raw.rlike("^[0-9]+$"), F.concat(F.lit(f"{prefix}-"), raw))


def dedupe_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def numeric_looking(text: Column) -> Column:
    return text.rlike(r"^[+-]?[0-9,]*\.?[0-9]+%?$")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _letters_within(n: int) -> str:
    """A pattern of n letters of one token."""
    return r"[^\p{L}\s]*".join([r"\p{L}"] * n)


def substantial(text: Column) -> Column:
    return has_letters(text, 4) & text.rlike(_letters_within(3))


def clean_enough(text: Column) -> Column:
    """Whether, of the tokens with letters that are no connectors, three in five have three letters; counted without an array of tokens."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    joints = {n: count(rf"(?<!\S)(?i:{'|'.join(c for c in CONNECTORS if c.isalpha() and len(c) >= n)})(?!\S)") for n in (1, 3)}
    counts = F.struct((count(rf"{_letters_within(1)}\S*") - joints[1]).alias("some"), (count(rf"{_letters_within(3)}\S*") - joints[3]).alias("three"))
    return let(counts, lambda n: (n["some"] == 0) | (n["three"] >= 0.6 * n["some"]))


def creator_like(text: Column) -> Column:
    """3 to 120 characters, over 80 % capitals among the letters, no mark of a sentence at the end."""
    return F.length(text).between(3, 120) & (letters(text) > 0) & (F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) > 0.8 * letters(text)) & ~F.rtrim(text).rlike("[.,;]$")


def org_keyword(text: Column) -> Column:
    squashed = F.regexp_replace(F.upper(text), r"[^\p{L}]+", "")
    by_letter = {k[0]: [w[1:] for w in ORG_KEYWORDS if w[0] == k[0]] for k in ORG_KEYWORDS}
    return squashed.rlike("|".join(f"{k}(?:{'|'.join(ends)})" for k, ends in by_letter.items()))


def year_only(text: Column) -> Column:
    """The year or years of a line that holds nothing else, else null."""
    t = tokens(text)
    years = F.filter(t, lambda x: x.rlike(YEAR_TOKEN))
    other = F.exists(t, lambda x: ~x.rlike(YEAR_TOKEN) & ~F.lower(x).isin(CONNECTORS) & (letters(x) > 1))
    ranges = F.forall(years, lambda x: x.rlike("[-–/]"))
    two = F.concat(F.get(years, F.lit(0)), F.when(ranges, " to ").otherwise("-"), F.get(years, F.lit(1)))
    found = F.when(~other & (F.size(years) == 1), F.get(years, F.lit(0))).when(~other & (F.size(years) > 1), two)
    # a token of more letters than any connector has is something else, so most lines need no tokens
    return F.when(~text.rlike(_letters_within(max(map(len, CONNECTORS)) + 1)), found)


def author_name(text: Column) -> Column:
    name = tidy(F.substring_index(text, ",", 1))
    return F.when(letters(name) >= 3, name)


def clean_tokens(text: Column) -> Column:
    """Mends Devanagari digits that recognition put into Latin words; drops strays."""
    digit = r"[\x{0966}-\x{096F}]"
    latin_only = lambda t: t.rlike(rf"^(?:[\x00-\x7F]|{digit})+$") & t.rlike("[A-Za-z]")
    mended = F.transform(tokens(text), lambda t: F.when(t.rlike(digit) & latin_only(t), F.replace(t, F.lit("०"), F.when(t.rlike("[a-z]"), "o").otherwise("O"))).otherwise(t))
    kept = F.filter(mended, lambda t: ~(t.rlike(digit) & (latin_only(t) | (F.length(t) == 1))))
    return F.when(text.rlike(digit), F.array_join(kept, " ")).otherwise(F.trim(F.regexp_replace(text, r"\s+", " ")))


def confidence_tier(c: Column) -> Column:
    return F.when(c > 0.95, "high").when(c >= 0.8, "warning").otherwise("low")


def needs_review(confidence: Column, similarity: Column) -> Column:
    """Low values are a reason for review; missing ones are not."""
    return F.coalesce(confidence < 0.80, F.lit(False)) | F.coalesce(similarity < 0.85, F.lit(False))


def notes_text(notes: Column) -> Column:
    return F.nullif(F.array_join(notes, "; "), F.lit(""))


def json_field(text: Column, schema: str) -> Column:
    """Parses JSON; where that fails, the first {...} or [...] inside the text."""
    span = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    plain = F.from_json(text, schema)
    field = schema.split()[0]
    return F.coalesce(plain[field], F.from_json(span, schema)[field])


def json_array(text: Column, schema: str) -> Column:
    """The objects of a JSON array; where the text is not one, of the array inside it; else empty."""
    kind = f"array<struct<{', '.join(': '.join(f.split()) for f in schema.split(', '))}>>"
    whole = F.when(F.trim(text).startswith("["), F.from_json(text, kind))
    inner = F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), kind)
    return F.coalesce(F.when(F.size(whole) >= 0, whole), F.when(F.size(inner) >= 0, inner), F.array().cast(kind))


def workload(pages: Column, size_bytes: Column) -> Column:
    """Pages (or bytes over 150 KiB, at least 1) and bytes over a GiB."""
    p = F.when(pages > 0, pages.cast("double")).otherwise(F.greatest(F.lit(1.0), size_bytes / F.lit(float(150 * 1024))))
    return p + size_bytes / F.lit(float(1024**3))


def duration_seconds(started: Column, finished: Column) -> Column:
    """Never negative; null if either is."""
    us = F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.when(started.isNotNull() & finished.isNotNull(), F.greatest(F.lit(0.0), us / F.lit(1e6)))


def progress_percent(done: Column, total: Column) -> Column:
    return (10 + F.floor(55 * done / total)).cast("int")


def batch_percent(done: Column, total: Column, job_percent: Column) -> Column:
    return F.when(total > 0, F.bround(100.0 * done / total)).otherwise(job_percent).cast("int")


DEFAULT_FONTS = {"TITLE": 18.0, "HEADING": 14.0, "SUBHEADING": 12.0, "HEADER": 9.0, "FOOTER": 8.0, "FOOTNOTE": 9.0, "PAGE_NUMBER": 9.0}


def default_font(block_type: Column) -> Column:
    pairs = [F.lit(x) for kv in DEFAULT_FONTS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), block_type), F.lit(10.0))
