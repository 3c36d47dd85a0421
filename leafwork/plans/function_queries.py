"""Queries of scalar functions over lines and boxes made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions import geometry as G
from leafwork.functions import text as T
from leafwork.operators import documents, layout, service
from leafwork.plans.queries import INSIDE, REGIONS, WORDS, page_join_of, query, regions_of, words_of
from leafwork.session import table

# Lines such as covers have: names, capitals, years, ranges, prices, sentences, numbers.
LINES = r"""lines AS (SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN '19' || lpad((p_partkey % 100)::VARCHAR, 2, '0') WHEN 3 THEN '1949-50 to 1966-67' WHEN 4 THEN '1995 and 1996'
 WHEN 5 THEN upper(p_name) || ', ' || p_type WHEN 6 THEN 'Rs. 25' WHEN 7 THEN upper(p_name) || '.' WHEN 8 THEN '12,345.6%' WHEN 9 THEN 'a b ' || p_name || ' c' WHEN 10 THEN 'DIRECTORATE OF ' || p_name ELSE '  ;' || p_name || ' -' END AS t FROM part),
tok AS (SELECT *, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') AS ts FROM lines)"""
_LETTERS = r"length(regexp_replace({}, '[^\p{{L}}]', '', 'g'))"
_YEAR = r"'^(1[89][0-9]{2}|20[0-3][0-9])([-–/][0-9]{2,4})?$'"
_CONNECT = "('to', 'and', '&', '-', '–', '—', '/')"


def lines_of(spark, d) -> DataFrame:
    p, n = F.col("p_partkey"), F.col("p_name")
    made = [n, F.upper(n), F.concat(F.lit("19"), F.lpad((p % 100).cast("string"), 2, "0")), F.lit("1949-50 to 1966-67"), F.lit("1995 and 1996"), F.concat(F.upper(n), F.lit(", "), "p_type"), F.lit("Rs. 25"), F.concat(F.upper(n), F.lit(".")), F.lit("12,345.6%"), F.concat(F.lit("a b "), n, F.lit(" c")), F.concat(F.lit("DIRECTORATE OF "), n), F.concat(F.lit("  ;"), n, F.lit(" -"))]
    t = made[-1]
    for i in reversed(range(11)):
        t = F.when(p % 12 == i, made[i]).otherwise(t)
    return table(spark, d, "part").select(p.alias("id"), t.alias("t"))


@query(rf"""WITH {LINES} SELECT id, {_LETTERS.format('t')} >= 4 AND len(list_filter(ts, lambda x: {_LETTERS.format('x')} >= 3)) > 0 AS substantial,
 len(list_filter(ts, lambda x: {_LETTERS.format('x')} > 0 AND NOT regexp_matches(x, {_YEAR}) AND lower(x) NOT IN {_CONNECT})) = 0 OR len(list_filter(ts, lambda x: {_LETTERS.format('x')} >= 3 AND NOT regexp_matches(x, {_YEAR}) AND lower(x) NOT IN {_CONNECT})) >= 0.6 * len(list_filter(ts, lambda x: {_LETTERS.format('x')} > 0 AND NOT regexp_matches(x, {_YEAR}) AND lower(x) NOT IN {_CONNECT})) AS clean,
 length(t) BETWEEN 3 AND 120 AND {_LETTERS.format('t')} > 0 AND length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) > 0.8 * {_LETTERS.format('t')} AND NOT regexp_matches(rtrim(t), '[.,;]$') AS creator,
 contains(regexp_replace(upper(t), '[^\p{{L}}]', '', 'g'), 'DIRECTORATE') AS organisation, regexp_matches(t, '^[+-]?[0-9,]*\.?[0-9]+%?$') AS numeric FROM tok""")
def line_predicates(spark, d):
    t = F.col("t")
    return lines_of(spark, d).select("id", T.substantial(t).alias("substantial"), T.clean_enough(t).alias("clean"), T.creator_like(t).alias("creator"), T.org_keyword(t).alias("organisation"), T.numeric_looking(t).alias("numeric"))


@query(rf"""WITH {LINES}, y AS (SELECT *, list_filter(ts, lambda x: regexp_matches(x, {_YEAR})) AS ys, len(list_filter(ts, lambda x: NOT regexp_matches(x, {_YEAR}) AND lower(x) NOT IN {_CONNECT} AND {_LETTERS.format('x')} > 1)) > 0 AS other FROM tok),
n AS (SELECT *, trim(substr(regexp_replace(regexp_replace(string_split(t, ',')[1], '^[ \t,;:.\-–—]+', ''), '[ \t,;:.\-–—]+$', ''), 1, 250)) AS name FROM y)
SELECT id, CASE WHEN other OR len(ys) = 0 THEN NULL WHEN len(ys) = 1 THEN ys[1] ELSE ys[1] || CASE WHEN len(list_filter(ys, lambda x: regexp_matches(x, '[-–/]'))) = len(ys) THEN ' to ' ELSE '-' END || ys[2] END AS year,
 CASE WHEN {_LETTERS.format('name')} >= 3 THEN name END AS author, trim(substr(regexp_replace(regexp_replace(t, '^[ \t,;:.\-–—]+', ''), '[ \t,;:.\-–—]+$', ''), 1, 250)) AS tidy, array_to_string(ts, ' ') AS cleaned FROM n""")
def line_values(spark, d):
    t = F.col("t")
    return lines_of(spark, d).select("id", T.year_only(t).alias("year"), T.author_name(t).alias("author"), T.tidy(t).alias("tidy"), T.clean_tokens(t).alias("cleaned"))


@query(f"""WITH {WORDS}, {REGIONS}, p AS (SELECT w.doc_id, w.page, w.li, w.wi, r.r, greatest(0, w.x2 - w.x1) * greatest(0, w.y2 - w.y1) AS a, greatest(0, r.x2 - r.x1) * greatest(0, r.y2 - r.y1) AS b, greatest(0, least(w.x2, r.x2) - greatest(w.x1, r.x1)) * greatest(0, least(w.y2, r.y2) - greatest(w.y1, r.y1)) AS i, least(w.x2, r.x2) - greatest(w.x1, r.x1) > 0.25 * greatest(1, least(greatest(0, w.x2 - w.x1), greatest(0, r.x2 - r.x1))) AS beside FROM words w JOIN regions r ON r.doc_id = w.doc_id AND r.page = w.page AND {INSIDE})
SELECT doc_id, page, li, wi, r, round(CASE WHEN least(a, b) > 0 AND i > 0 THEN i / least(a, b)::DOUBLE ELSE 0 END, 6) AS smaller, round(CASE WHEN a + b - i > 0 AND i > 0 THEN i / (a + b - i)::DOUBLE ELSE 0 END, 6) AS iou, beside FROM p""")
def box_measures(spark, d):
    w = words_of(spark, d)
    met = page_join_of(w, regions_of(w))
    a, b = G.box(), G.box("r_")
    return met.select("doc_id", "page", "li", "wi", "r", F.round(G.overlap_of_smaller(a, b), 6).alias("smaller"), F.round(G.iou(a, b), 6).alias("iou"), G.overlaps_horizontally(a, b).alias("beside"))


@query("""WITH b AS (SELECT p_partkey AS id, (p_partkey % 90) / 100.0::DOUBLE AS x1, (p_partkey % 70) / 100.0::DOUBLE AS y1, (p_partkey % 90 + 7) / 100.0::DOUBLE AS x2, (p_partkey % 70 + 11) / 100.0::DOUBLE AS y2 FROM part)
SELECT id, round(x1 * 1240, 6) AS px, round(y2 * 841.8898, 6) AS pt, trunc(x2 * 7772400 + 1e-6)::BIGINT AS emu, round(1240 / 150.0 * 72, 6) AS page_pt, round_even((1240 + id) / 150.0 * 914400, 0)::BIGINT AS page_emu, round(least(x1, y1, x2, y2), 6) AS left_most, round(greatest(x1, x2), 6) AS right_most FROM b""")
def box_units(spark, d):
    p = F.col("p_partkey")
    b = table(spark, d, "part").select(p.alias("id"), *[(v / F.lit(100.0)).alias(n) for n, v in (("x1", p % 90), ("y1", p % 70), ("x2", p % 90 + 7), ("y2", p % 70 + 11))])
    box = G.box()
    px, pt, emu = G.to_pixels(box, F.lit(1240), F.lit(1754)), G.norm_to_pt(box, F.lit(595.2756), F.lit(841.8898)), G.norm_to_emu(G.Box(box.x1, box.y1, box.x2 + 1e-6 / 7772400, box.y2), F.lit(7772400), F.lit(10058400))
    size = G.page_size_pt(F.lit(1240), F.lit(1754), F.lit(150))["width"]
    hull = G.polygon_box(G.polygon_of(F.array(F.array("x1", "y1"), F.array("x2", "y2"), F.array(F.least("x1", "y1"), F.lit(0.0)))))
    return b.select("id", F.round(px.x1, 6).alias("px"), F.round(pt.y2, 6).alias("pt"), emu.x2.alias("emu"), F.round(size, 6).alias("page_pt"), G.page_size_emu(1240 + F.col("id"), F.lit(1), F.lit(150))["width"].alias("page_emu"), F.round(F.least(hull.x1, F.col("y1")), 6).alias("left_most"), F.round(hull.x2, 6).alias("right_most"))


@query(f"WITH {WORDS} SELECT doc_id, page, count(*) AS n FROM words WHERE confidence < 0.8 GROUP BY 1, 2")
def low_confidence_words(spark, d):
    return documents.low_confidence(words_of(spark, d)).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 2 END::BIGINT AS n, CASE WHEN event_id % 3 = 2 THEN NULL ELSE (json_extract_string(props, '$.k'))::BIGINT END AS first FROM events")
def json_arrays(spark, d):
    """Arrays of objects as they are, inside prose, and broken."""
    two = F.concat(F.lit("["), "props", F.lit(', {"k": 7}]'))
    raw = F.when(F.col("event_id") % 3 == 0, two).when(F.col("event_id") % 3 == 1, F.concat(F.lit("see "), two, F.lit(" end"))).otherwise(F.lit("no [ array"))
    a = T.json_array(raw, "k bigint")
    return table(spark, d, "events").select("event_id", F.size(a).cast("long").alias("n"), F.get(a, F.lit(0))["k"].alias("first"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN (o_orderkey % 100)::INTEGER ELSE round_even(100.0 * (o_custkey % 4) / 4, 0)::INTEGER END AS percent FROM orders")
def batch_percents(spark, d):
    c, k = F.col("o_custkey") % 4, F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", T.batch_percent(c, F.when(c == 0, 0).otherwise(4), (k % 100).cast("int")).alias("percent"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 OR o_orderstatus <> lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS fresh, sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS line FROM (SELECT *, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS c FROM orders)")
def change_numbers(spark, d):
    """Lines are numbered anew wherever the key of a word differs from the one before."""
    return layout.number_changes(table(spark, d, "orders"), ["o_custkey"], ["o_orderstatus"], "o_orderkey").select("o_custkey", "o_orderkey", "fresh", F.col("number").alias("line"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey")
def ordered_dump(spark, d):
    return service.ordered(table(spark, d, "customer").select("c_custkey", "c_name"), [F.asc("c_name"), F.asc("c_custkey")])
