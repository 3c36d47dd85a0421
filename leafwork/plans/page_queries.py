"""Queries over whole pages and over stored results; they join those of queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions import text as T
from leafwork.operators import changes, covers, layout, page_plan, spatial
from leafwork.operators.numbering import number_rows
from leafwork.plans.queries import BLOCKS, INSIDE, LINES, REGIONS, SHARE, SQL, TYPED, WORDS, cells_of, cover_lines_of, covers_of, page_numbers_of, query, regions_of, words_of
from leafwork.session import cut, scratch_dir, table
from leafwork.sources import html_tables
from leafwork.sources.page_store import PageStore

PAGE = ["doc_id", "page"]


def page_parts(words: DataFrame) -> dict[str, DataFrame]:
    """What recognition would give for each page: two tiers of tables, their cells, rules and pictures."""
    r = regions_of(words)
    kept = ["doc_id", "page", "table_no", "x1", "y1", "x2", "y2"]
    first = r.where("r = 0").withColumn("table_no", F.col("r")).select(*kept)
    moved = r.where("r <= 1").select(*PAGE, (F.col("r") + 10).alias("table_no"), (F.col("x1") + 100).alias("x1"), (F.col("y1") + 60).alias("y1"), (F.col("x2") + 100).alias("x2"), (F.col("y2") + 60).alias("y2"))
    tiers = [t.withColumn("confidence", F.lit(0.8)) for t in (first, moved)]
    tables = spatial.claimed(tiers, PAGE)
    place = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.floor(i / 2).cast("int").alias("row"), (i % 2).alias("column"))))
    cells = tables.select(*kept, place.alias("p")).select(*PAGE, "table_no", "p.*", (F.col("x1") + F.col("p.column") * 250).alias("x1"), (F.col("y1") + F.col("p.row") * 50).alias("y1"))
    cells = cells.withColumns({"x2": F.col("x1") + 249, "y2": F.col("y1") + 49})
    read = spatial.words_in_cells(words, cells, PAGE, ["table_no", "row", "column"])
    cells = cells.join(read.select(*PAGE, "table_no", "row", "column", "text", "confidence"), [*PAGE, "table_no", "row", "column"], "left").fillna({"text": "", "confidence": 0.0})
    rules = words.select(*PAGE).distinct().select(*PAGE, F.lit("HLINE").alias("block_type"), F.explode(F.array(*[F.lit(y).cast("long") for y in (125, 701)])).alias("y1")).select("*", F.lit(0).cast("long").alias("x1"), F.lit(400).cast("long").alias("x2"), (F.col("y1") + 2).alias("y2"))
    return {"tiers": tiers, "tables": tables, "cells": cells, "rules": rules, "regions": r.where("r >= 2")}


_FREE = WORDS.replace("words AS (", "allwords AS (") + f""",
{REGIONS.replace("FROM words)", "FROM allwords)")},
_t0 AS (SELECT doc_id, page, r AS table_no, x1, y1, x2, y2 FROM regions WHERE r = 0),
_t1 AS (SELECT doc_id, page, r + 10 AS table_no, x1 + 100 AS x1, y1 + 60 AS y1, x2 + 100 AS x2, y2 + 60 AS y2 FROM regions WHERE r <= 1),
tb AS (SELECT * FROM _t0 UNION ALL SELECT * FROM _t1 w WHERE NOT EXISTS (SELECT 1 FROM _t0 r WHERE r.doc_id = w.doc_id AND r.page = w.page AND {SHARE} > 0.3)),
words AS (SELECT * FROM allwords w WHERE NOT EXISTS (SELECT 1 FROM tb r WHERE r.doc_id = w.doc_id AND r.page = w.page AND {INSIDE}))"""
_TYPED = _FREE + LINES[len(WORDS) :] + BLOCKS[len(LINES) :].replace("FROM words GROUP BY 1, 2)", "FROM allwords GROUP BY 1, 2)") + TYPED[len(BLOCKS) :]
#: A word's region by arithmetic, as regions are a grid.
_REGION = "CASE WHEN ((y1 + y2) / 2.0 - 30) % 140 <= 100 AND (x1 + x2) / 2.0 BETWEEN 700 * floor(((y1 + y2) / 2.0 - 30) / 140) AND 700 * floor(((y1 + y2) / 2.0 - 30) / 140) + 500 THEN floor(((y1 + y2) / 2.0 - 30) / 140)::INTEGER END"

PAGE_TREE = f"""WITH {_TYPED},
_p AS (SELECT doc_id, page, {_REGION} AS r, (x2 - x1) * (y2 - y1) AS a, confidence FROM allwords),
_c AS (SELECT doc_id, page, r, least(1.0, sum(a) / 50000.0) AS coverage, avg(confidence) AS wc FROM _p WHERE r >= 2 GROUP BY 1, 2, 3),
pictures AS (SELECT g.doc_id, g.page, g.r, g.x1, g.y1, g.x2, g.y2, CASE WHEN wc < 0.45 THEN 'HANDWRITTEN' WHEN g.y1 / 800.0 > 0.65 AND 5.0 >= 2.2 AND 100 < 64 THEN 'SIGNATURE' ELSE 'IMAGE' END AS block_type
 FROM regions g LEFT JOIN _c USING (doc_id, page, r) WHERE g.r >= 2 AND coalesce(coverage, 0) <= 0.35 AND NOT EXISTS (SELECT 1 FROM tb WHERE tb.doc_id = g.doc_id AND tb.page = g.page AND
 greatest(0, least(tb.x2, g.x2) - greatest(tb.x1, g.x1)) * greatest(0, least(tb.y2, g.y2) - greatest(tb.y1, g.y1)) > 0.3 * 50000)),
kept AS (SELECT * FROM typed w WHERE NOT EXISTS (SELECT 1 FROM pictures r WHERE r.doc_id = w.doc_id AND r.page = w.page AND {SHARE} >= 0.6)),
parts AS (SELECT doc_id, page, block_type, x1, y1, 0 AS rank, block AS o, text, NULL AS table_no FROM kept
 UNION ALL SELECT doc_id, page, 'TABLE', x1, y1, 1, table_no, NULL, table_no FROM tb
 UNION ALL SELECT DISTINCT doc_id, page, 'HLINE', 0, 701, 2, 701, NULL, NULL FROM allwords
 UNION ALL SELECT DISTINCT doc_id, page, 'HLINE', 0, 125, 2, 125, NULL, NULL FROM allwords w WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.doc_id = w.doc_id AND tb.page = w.page AND tb.table_no = 0)
 UNION ALL SELECT doc_id, page, block_type, x1, y1, 3, r, NULL, NULL FROM pictures),
cells AS (SELECT doc_id, page, table_no, i // 2 AS row, i % 2 AS col, x1 + (i % 2) * 250 AS x1, y1 + (i // 2) * 50 AS y1 FROM tb, (SELECT unnest(range(4)) AS i)),
filled AS (SELECT r.doc_id, r.page, r.table_no, r.row, r.col, coalesce(string_agg(w.text, ' ' ORDER BY round_even(w.y1 / 8.0, 0), w.x1, w.text), '') AS text
 FROM (SELECT *, x1 + 249 AS x2, y1 + 49 AS y2 FROM cells) r LEFT JOIN allwords w ON r.doc_id = w.doc_id AND r.page = w.page AND {INSIDE} GROUP BY ALL),
rows AS (SELECT doc_id, page, table_no, string_agg(text, '|' ORDER BY row, col) AS texts FROM filled GROUP BY 1, 2, 3)
SELECT p.doc_id, p.page, count(*) AS n_blocks, string_agg(block_type, ',' ORDER BY y1, x1, rank, o) AS types, md5(coalesce(string_agg(text, chr(10) ORDER BY y1, x1, rank, o) FILTER (text <> ''), '')) AS text_md5, md5(coalesce(string_agg(texts, chr(10) ORDER BY y1, x1, rank, o) FILTER (p.table_no IS NOT NULL), '')) AS tables_md5
FROM parts p LEFT JOIN rows t ON t.doc_id = p.doc_id AND t.page = p.page AND t.table_no = p.table_no GROUP BY 1, 2"""


@query(PAGE_TREE)
def page_tree(spark, d):
    """Pages with text, tables, rules and pictures, stored and read back as trees: their types in reading order, and digests of their texts and cells."""
    words = cut(words_of(spark, d), "words")
    sizes, parts = layout.page_sizes(words), page_parts(words)
    found = page_plan.elements(words, sizes, parts["tiers"], parts["rules"], parts["regions"])
    store = PageStore(spark, f"{scratch_dir(spark)}/pages-{uuid.uuid4().hex[:12]}", 8)
    store.replace(sizes, words=words, blocks=found, tables=parts["tables"], cells=parts["cells"])
    return tree_digests(store.trees())


def tree_digests(trees: DataFrame) -> DataFrame:
    texts = F.flatten(F.transform("blocks", lambda b: F.transform(b["content"], lambda r: r["text"])))
    cells = lambda b: F.array_join(F.transform(F.flatten(F.transform(b["table"]["rows"], lambda r: r["cells"])), lambda c: c["text"]), "|")
    tables = F.transform(F.filter("blocks", lambda b: b["type"] == "TABLE"), cells)
    return trees.select(*PAGE, F.size("blocks").cast("long").alias("n_blocks"), F.array_join(F.transform("blocks", lambda b: b["type"]), ",").alias("types"), F.md5(F.array_join(texts, "\n")).alias("text_md5"), F.md5(F.array_join(tables, "\n")).alias("tables_md5"))


# ------------------------------------------------- dense pages, ranges, changes, functions
@query(SQL["overlap_anti"])
def overlap_anti_dense(spark, d):
    """By a grid of levels, as dense pages need it."""
    w = words_of(spark, d)
    return spatial.not_covered(w, regions_of(page_numbers_of(spark, d)), PAGE, 0.3, dense=True).select(*PAGE, "li", "wi")


@query(SQL["overlap_semi"])
def overlap_semi_dense(spark, d):
    w = words_of(spark, d)
    return spatial.overlapping(w, regions_of(page_numbers_of(spark, d)), PAGE, dense=True).select(*PAGE, "li", "wi")


@query(SQL["claimed_regions"])
def claimed_regions_dense(spark, d):
    first = regions_of(page_numbers_of(spark, d))
    move = {"x1": 100, "x2": 100, "y1": 60, "y2": 60}
    second = first.select(*PAGE, (F.col("r") + 10).alias("r"), *[(F.col(c) + move[c]).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return spatial.claimed([first, second], PAGE, dense=True).select(*PAGE, "r")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS number FROM orders")
def numbers_by_range(spark, d):
    """Numbers of all orders by a text of five values first, of which one range could hold no more than its share."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return number_rows(o, [F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "number")


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer), b AS (SELECT k, CASE WHEN balance < 0 THEN upper(name) || ' X' ELSE name END AS name, balance FROM a WHERE k % 7 <> 0 UNION ALL SELECT k + 10000000, name, balance FROM a WHERE k % 11 = 0)
SELECT b.k, b.name, CASE WHEN a.k IS NULL THEN 'added' ELSE 'changed' END AS _change FROM b LEFT JOIN a ON a.k = b.k WHERE a.k IS NULL OR a.name <> b.name UNION ALL SELECT a.k, a.name, 'gone' FROM a WHERE k % 7 = 0""")
def change_feed(spark, d):
    """What differs between two versions of a table of customers."""
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = a.where("k % 7 <> 0").withColumn("name", F.when(F.col("balance") < 0, F.concat(F.upper("name"), F.lit(" X"))).otherwise(F.col("name")))
    b = b.union(a.where("k % 11 = 0").withColumn("k", F.col("k") + 10000000))
    return changes.changes(a, b, ["k"]).select("k", "name", "_change")


@query(SQL["html_cells"].replace("SELECT DISTINCT table_id AS page_id, 0 AS row", "SELECT DISTINCT table_id AS page_id, 0 AS table_no, 0 AS row").replace("UNION ALL SELECT table_id, r + 1", "UNION ALL SELECT table_id, 0, r + 1"))
def html_cells_lateral(spark, d):
    """The cells of html_cells by the table function, called for each page from SQL."""
    html_tables.register_functions(spark)
    c = cells_of(spark, d).withColumn("td", F.concat(F.when(F.col("column") == 0, "<td colspan=2> ").otherwise("<td>"), F.col("text"), F.lit("</td>")))
    row = c.groupBy("table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "td"))), lambda x: x["td"]), "").alias("tr"))
    body = row.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "tr"))), lambda x: F.concat(F.lit("<tr>"), x["tr"], F.lit("</tr>"))), "\n").alias("body"))
    head = F.concat(F.lit("<p>x</p><TABLE><tr><th colspan='4'>orders of "), F.col("table_id").cast("string"), F.lit("</th></tr>"))
    body.select(F.col("table_id").alias("page_id"), F.concat(head, "body", F.lit("</TABLE>")).alias("html")).createOrReplaceTempView("html_of_orders")
    return spark.sql("SELECT page_id, c.* FROM html_of_orders, LATERAL html_cells(html) AS c")


@query(f"""WITH {WORDS}, l AS (SELECT doc_id, page, li, string_agg(text, ' ' ORDER BY x1, wi) AS text, min(y1)::DOUBLE AS y1, max(y1 + font_size)::DOUBLE AS y2, coalesce(max(font_size) FILTER (regexp_matches(text, '[\\p{{L}}\\p{{N}}]')), 0)::DOUBLE AS h, avg(y1 + font_size / 2.0) AS yc
FROM words WHERE page < 3 AND trim(text) <> '' GROUP BY 1, 2, 3) SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY yc) - 1)::INTEGER AS k, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' ') AS text, y1, y2, h FROM l""")
def cover_lines(spark, d):
    """The lines of the first three pages of each document, of words whose height is their lettering."""
    return cover_lines_of(spark, d)


_LETTERS, _YEAR, _JOINTS = "length(regexp_replace({}, '[^\\p{{L}}]', '', 'g'))", "'^(1[89][0-9]{2}|20[0-3][0-9])([-–/][0-9]{2,4})?$'", "(" + ", ".join(f"'{c}'" for c in T.CONNECTORS) + ")"
_TIDY = "trim(substr(regexp_replace(regexp_replace({}, '^[ \\t,;:.\\-–—]+', ''), '[ \\t,;:.\\-–—]+$', ''), 1, 250))"
_N = {c: _LETTERS.format(c) for c in ("x", "text", "name")}
_REAL = f"NOT regexp_matches(x, {_YEAR}) AND lower(x) NOT IN {_JOINTS}"
COVERS = f"""WITH {WORDS},
_ln AS (SELECT doc_id, page, li, string_agg(text, ' ' ORDER BY x1, wi) AS raw, min(y1)::DOUBLE AS y1, max(y1 + font_size)::DOUBLE AS y2, coalesce(max(font_size) FILTER (regexp_matches(text, '[\\p{{L}}\\p{{N}}]')), 0)::DOUBLE AS h FROM words WHERE page < 3 AND trim(text) <> '' GROUP BY 1, 2, 3),
_t AS (SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY y1 + y2) - 1)::INTEGER AS k, y1, y2, h, list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> '') AS ts FROM _ln),
_x AS (SELECT *, array_to_string(ts, ' ') AS text, list_filter(ts, lambda x: regexp_matches(x, {_YEAR})) AS ys, list_filter(ts, lambda x: {_N['x']} > 0 AND {_REAL}) AS alpha FROM _t),
_s AS (SELECT *, {_N['text']} >= 4 AND len(list_filter(ts, lambda x: {_N['x']} >= 3)) > 0 AS big, regexp_matches(regexp_replace(upper(text), '[^\\p{{L}}]', '', 'g'), '{"|".join(T.ORG_KEYWORDS)}') AS org,
 len(alpha) = 0 OR len(list_filter(alpha, lambda x: {_N['x']} >= 3)) >= 0.6 * len(alpha) AS clean, {_TIDY.format("string_split(text, ',')[1]")} AS name,
 CASE WHEN len(list_filter(ts, lambda x: {_REAL} AND {_N['x']} > 1)) > 0 OR len(ys) = 0 THEN NULL WHEN len(ys) = 1 THEN ys[1] ELSE ys[1] || CASE WHEN len(list_filter(ys, lambda x: regexp_matches(x, '[-–/]'))) = len(ys) THEN ' to ' ELSE '-' END || ys[2] END AS year,
 regexp_matches(text, '(?i)^\\s*by[:.]?\\s*$') AS by, regexp_matches(text, '(?i)^\\s*(and|&)\\s*$') AS joint FROM _x),
w AS (SELECT *, y1 - lag(y2) OVER p AS above, lead(y1) OVER p - y2 AS below, lag(h) OVER p AS prev, CASE WHEN {_N['name']} >= 3 THEN name END AS author FROM _s WINDOW p AS (PARTITION BY doc_id, page ORDER BY k)),
_m AS (SELECT doc_id, page, count(*) AS n, max(h) FILTER (big AND NOT org AND y1 < 680) AS top, max(h) FILTER (big AND NOT org) / 800.0 AS share FROM w GROUP BY 1, 2),
_a AS (SELECT doc_id, page, n, share, CASE WHEN top > 0 THEN top END AS most, min(k) FILTER (big AND NOT org AND y1 < 680 AND h = top AND top > 0) AS anchor FROM w JOIN _m USING (doc_id, page) GROUP BY ALL),
_b AS (SELECT doc_id, page, n, share, most, anchor, coalesce(max(k) FILTER (k < anchor AND NOT (big AND NOT org AND h >= 0.75 * most AND below <= 2 * most)) + 1, 0) AS start, coalesce(min(k) FILTER (k > anchor AND NOT (big AND NOT org AND h >= 0.75 * most AND above <= 2 * most)), n) AS stop1 FROM w JOIN _a USING (doc_id, page) GROUP BY doc_id, page, n, share, most, anchor),
_c AS (SELECT doc_id, page, n, share, anchor, start, CASE WHEN anchor IS NULL THEN 0 ELSE least(coalesce(min(k) FILTER (k >= stop1 AND NOT (NOT org AND above <= 2.5 * most AND h >= 0.5 * most AND (big OR year IS NOT NULL) AND clean)), n), stop1 + 3) END AS stop FROM w JOIN _b USING (doc_id, page) GROUP BY doc_id, page, n, share, most, anchor, start, stop1),
_h AS (SELECT doc_id, page, n, share, anchor, start, stop, min(k) FILTER (k >= stop AND org AND big) AS house FROM w JOIN _c USING (doc_id, page) GROUP BY ALL),
_y AS (SELECT doc_id, page, n, share, anchor, start, stop, house, coalesce(min(k) FILTER (k > house AND NOT (big AND year IS NULL AND above <= 1.5 * greatest(prev, h, 1) AND (org OR h / greatest(prev, 1) BETWEEN 0.7 AND 1.4))), n) AS yard FROM w JOIN _h USING (doc_id, page) GROUP BY doc_id, page, n, share, anchor, start, stop, house),
_e AS (SELECT m.doc_id, m.page, m.k AS mark, coalesce(min(w.k) FILTER (w.above > 3 * greatest(w.prev, w.h, 1) OR (NOT w.joint AND (NOT w.big OR w.org))), m.k + 9) AS fin FROM w m LEFT JOIN w ON w.doc_id = m.doc_id AND w.page = m.page AND w.k > m.k AND w.k <= m.k + 8 WHERE m.by GROUP BY m.doc_id, m.page, m.k),
_n AS (SELECT w.doc_id, w.page, mark, author, min(k) AS k FROM _e JOIN w ON w.doc_id = _e.doc_id AND w.page = _e.page AND k > mark AND k < fin WHERE NOT joint AND author IS NOT NULL GROUP BY ALL),
_o AS (SELECT doc_id, page, mark, string_agg(author, ' / ' ORDER BY k) AS names FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, mark ORDER BY k) AS r FROM _n) WHERE r <= 6 GROUP BY ALL),
_u AS (SELECT doc_id, page, arg_min(names, mark) AS author FROM _o GROUP BY 1, 2),
_r AS (SELECT doc_id, page, share, nullif({_TIDY.format("string_agg(text, ' ' ORDER BY k) FILTER (anchor IS NOT NULL AND k >= start AND k < stop)")}, '') AS title, nullif({_TIDY.format("regexp_replace(string_agg(text, ' ' ORDER BY k) FILTER (k >= house AND k < yard), '(?i)^\\s*published\\s+by\\s+', '')")}, '') AS publisher,
 coalesce(arg_max(year, k) FILTER (y1 >= 480 AND year IS NOT NULL), arg_min(year, k) FILTER (k >= stop AND year IS NOT NULL)) AS year, string_agg(text, ' ' ORDER BY k) AS lines_text FROM w JOIN _y USING (doc_id, page) GROUP BY ALL),
_d AS (SELECT doc_id, max(share) FILTER (page = 0) AS s0, max(share) FILTER (page = 1) AS s1, max(share) FILTER (page = 2) AS s2, string_agg(lines_text, ' ' ORDER BY page) AS lines_text FROM _r GROUP BY 1),
_p AS (SELECT *, coalesce(s1, 0) > coalesce(s0, 0) * 1.0001 AS p1 FROM _d),
_q AS (SELECT *, CASE WHEN coalesce(s2, 0) > (CASE WHEN p1 THEN s1 ELSE coalesce(s0, 0) END) * 1.0001 THEN 2 WHEN p1 THEN 1 WHEN s0 > 0 THEN 0 END AS page FROM _p)
SELECT _q.doc_id, _q.page, title, author, publisher, year, md5(_q.lines_text) AS lines_md5 FROM _q LEFT JOIN _r ON _r.doc_id = _q.doc_id AND _r.page = _q.page LEFT JOIN _u ON _u.doc_id = _q.doc_id AND _u.page = _q.page"""


@query(COVERS)
def cover_reading(spark, d):
    """Covers read without likeness of misread words, so that SQL can follow; cover_metadata has that."""
    return covers_of(spark, d, fuzzy=False).select("doc_id", "page", "title", "author", "publisher", "year", F.md5("lines_text").alias("lines_md5"))
