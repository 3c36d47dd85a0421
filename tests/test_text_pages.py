"""Pages of plain texts as rows: the same results as by rows of words, without sorts of all words."""

import unicodedata

from pyspark.sql import functions as F

from leafwork.functions import text as T
from leafwork.operators import bands, covers, layout, service, spatial
from leafwork.plans import page_queries  # noqa: F401  it adds to the queries
from leafwork.plans.queries import QUERIES

ODD = [(1, "one  two\n\n   \nend of  it "), (2, None), (3, ""), (4, "\n".join(f"line {i} \U0001f600 x" for i in range(95))), (5, "a " * 300 + "\nb"), (6, "\n" * 80)]


def texts(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_page_runs_are_those_of_the_words(spark):
    for lettering in (False, True):
        words = layout.word_boxes(texts(spark))
        words = words.withColumn("y2", F.col("y1") + F.col("font_size")) if lettering else words
        told = lambda df: rows(df.select("doc_id", "page", F.sort_array(F.transform("runs", lambda r: F.struct(r["mid"].alias("mid"), r["height"].alias("height"), r["n"].alias("n"), F.sort_array(r["words"]).alias("words")))).alias("runs")))
        assert told(layout.page_runs(layout.text_pages(texts(spark)), lettering)) == told(bands.page_runs(words))
    assert rows(layout.page_numbers(texts(spark))) == rows(words.select("doc_id", "page").distinct())


def test_row_clusters_of_texts_sort_no_words(spark, sf, tmp_path):
    texts(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["row_clusters"](spark, str(tmp_path))
    assert rows(got) == rows(bands.row_clusters(layout.word_boxes(texts(spark))))
    plan = plan_of(QUERIES["row_clusters"](spark, sf))
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "Aggregate" not in plan


def test_cover_lines_of_texts_sort_no_words(spark, sf, tmp_path):
    texts(spark).write.parquet(f"{tmp_path}/documents.parquet")
    words = layout.word_boxes(texts(spark)).where(F.col("page") < covers.TITLE_PAGES)
    want = rows(covers.cover_lines(words.withColumn("y2", F.col("y1") + F.col("font_size"))))
    assert rows(QUERIES["cover_lines"](spark, str(tmp_path))) == want and len(want) == 99
    plan = plan_of(QUERIES["cover_lines"](spark, sf))
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "Aggregate" not in plan


def test_covers_of_texts_are_those_of_the_words(spark, sf, tmp_path):
    # words that are null or blank, pages beyond the third, and a cover behind the first page
    texts(spark).union(spark.createDataFrame([(7, "\n".join(["GREAT BOOK"] + ["x"] * 42 + ["THE LARGER TITLE", "BY", "Ann Writer"]))], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    d, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    words = layout.word_boxes(docs).withColumn("y2", F.col("y1") + F.col("font_size"))
    want = rows(covers.cover_metadata(words, layout.page_sizes(words)))
    assert rows(QUERIES["cover_metadata"](spark, d)) == want and any("THE LARGER TITLE" in r for r in want)
    # one exchange of texts, and one more behind the Python function; none of words
    for name, most in (("cover_reading", 1), ("cover_metadata", 2)):
        plan = plan_of(QUERIES[name](spark, sf))
        assert plan.count("Exchange") == most and "SortMergeJoin" not in plan and "Window" not in plan


def test_regions_are_made_without_words(spark, sf):
    for name in ("claimed_regions", "claimed_regions_dense"):
        assert "posexplode" not in plan_of(QUERIES[name](spark, sf))


def test_catalogue_makes_its_blocks_once_and_no_words(spark, sf):
    """Lines become rows for blocks and for their pages' sizes, which share an exchange; pages and lines once for covers; nothing else."""
    assert plan_of(QUERIES["catalogue"](spark, sf)).count("Generate posexplode") == 4


def test_covers_make_no_words(spark, sf):
    plan = plan_of(QUERIES["cover_metadata"](spark, sf))
    assert plan.count("Generate posexplode") == 2 and "aggregate(" not in plan.split("ArrowEvalPython")[1]


def test_languages_of_texts_are_those_of_the_words(spark):
    more = [(8, "हिन्दी word\nहिx 12 १२ -- x1 \t"), (9, "१२ 34\n5-6 --"), (10, "é -- \n"), (11, "nur\tein Wort")]
    docs = texts(spark).union(spark.createDataFrame(more, "doc_id long, text string"))
    words = layout.word_boxes(docs).withColumn("language", T.detect_script(F.col("text")))
    assert rows(service.text_languages(docs, "doc_id")) == rows(service.majority_language(words, "doc_id"))


def test_clean_lines_by_tokens(spark):
    """Counted in the text as by tokens one at a time."""
    cases = ["", "to and TO & 1990", "NO a ry Ta ble s", "real words to 1973", "and, to. a1b2c3 x", "ab\tcde\nf  गीता-ली 12", "and and xyz qq", "band tom"]

    def want(text):
        alpha = [t for t in text.split() if any(map(str.isalpha, t)) and t.lower() not in T.CONNECTORS]
        return not alpha or sum(sum(unicodedata.category(c)[0] == "L" for c in t) >= 3 for t in alpha) >= 0.6 * len(alpha)

    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", T.clean_enough(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == {c: want(c) for c in cases}


def test_page_bounds_sort_no_words(spark, sf, tmp_path):
    docs = texts(spark).union(spark.createDataFrame([(12, "\n".join(f"{i:02} abcdefgh{' ' * 40}{i % 7} x" for i in range(50)))], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    words = layout.word_boxes(docs)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    want = rows(bands.page_bounds(words, layout.page_sizes(words)).select("doc_id", "page", joined("rows"), joined("columns")))
    assert rows(QUERIES["page_bounds"](spark, str(tmp_path))) == want
    plan = plan_of(QUERIES["page_bounds"](spark, sf))
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "Join" not in plan


def test_grid_join_deals_only_what_can_meet(spark, sf):
    """Boxes outside of all regions' span, without edges and on pages without regions: as by the page alone; cells are not asked for in the first join."""
    boxes = [(p, i, x, y, x + w, y + w) for i, (p, x, y, w) in enumerate([(0, 0, 0, 5), (0, 95, 95, 10), (0, 400, 0, 900), (0, 900, 900, 3), (0, -50, 30, 2000), (1, 1, 1, 1)])]
    a = spark.createDataFrame([*boxes, (0, 9, None, 1, 5, None)], "page int, i int, x1 long, y1 long, x2 long, y2 long")
    b = spark.createDataFrame([(0, 7, 100, 100, 200, 200), (0, 8, 450, 150, 500, 170)], "page int, r int, x1 long, y1 long, x2 long, y2 long")
    for join in (spatial.overlapping, spatial.not_covered):
        assert rows(join(a, b, ["page"], 0.01, dense=True).select("i")) == rows(join(a, b, ["page"], 0.01).select("i"))
    for name in ("overlap_semi_dense", "word_to_cell_tiled"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert "isnotnull(CASE" not in plan and "_hx1" in plan and plan.count("Generate posexplode") == 2
