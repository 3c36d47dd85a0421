"""Whole pages, and the store that replaces their results at once."""

import re

import pytest
from pyspark.sql import functions as F

from leafwork.operators import layout, page_plan
from leafwork.plans import page_queries
from leafwork.sources.commit_log import CommitLog
from leafwork.sources.page_store import Conflict, PageStore

PAGE = ["doc_id", "page"]
WORD = "doc_id long, page int, li int, wi int, text string, x1 long, y1 long, x2 long, y2 long, font_size int, confidence double"


def word_table(spark, pages):
    """Words at (text, x1, y1, x2, y2); pages by number."""
    rows = [(1, p, i, 0, t, *box, 10, 0.9) for p, words in pages.items() for i, (t, *box) in enumerate(words)]
    return spark.createDataFrame(rows, WORD)


def boxes(spark, rows, *names):
    return spark.createDataFrame(rows, "doc_id long, page int, x1 long, y1 long, x2 long, y2 long" + "".join(f", {n}" for n in names))


def test_elements_of_a_page(spark):
    words = word_table(spark, {0: [("Above", 10, 100, 90, 120), ("cell", 20, 210, 60, 230), ("Below", 10, 420, 90, 440), ("label", 520, 520, 560, 540)]})
    sizes = spark.createDataFrame([(1, 0, 1000, 1400, 10.0)], "doc_id long, page int, page_width int, page_height int, page_font double")
    first = boxes(spark, [(1, 0, 0, 200, 300, 300, 0, 0.9)], "table_no int", "confidence double")
    second = boxes(spark, [(1, 0, 10, 210, 290, 310, 1, 0.8), (1, 0, 600, 200, 900, 300, 2, 0.8)], "table_no int", "confidence double")
    rules = boxes(spark, [(1, 0, 0, 250, 300, 253, "HLINE"), (1, 0, 0, 700, 900, 703, "HLINE")], "block_type string")
    regions = boxes(spark, [(1, 0, 500, 500, 900, 900, 0), (1, 0, 510, 510, 600, 600, 1), (1, 0, 20, 210, 280, 290, 2)], "r int")
    got = page_plan.elements(words, sizes, [first, second], rules, regions).orderBy("z_order").collect()
    # the second tier's box on the first table goes, so do the grid's own rule, the picture inside a
    # larger one, the picture on a table, the word of a cell and the label inside the picture
    assert [(r.z_order, r.block_type, r.text, r.table_no) for r in got] == [(0, "PARAGRAPH", "Above", None), (1, "TABLE", None, 0), (2, "TABLE", None, 2), (3, "PARAGRAPH", "Below", None), (4, "IMAGE", None, None), (5, "HLINE", None, None)]
    assert got[4].image_ref == "picture-1-0-0" and got[4].x2 == 900
    plain = page_plan.elements(words, sizes).collect()
    assert sorted(r.text for r in plain) == ["Above", "Below", "cell", "label"]


def stored(spark, tmp_path, buckets=4):
    store = PageStore(spark, f"file://{tmp_path}/store", buckets)
    words = word_table(spark, {0: [("one", 0, 0, 50, 20), ("two", 60, 0, 90, 20)], 1: [("three", 0, 0, 50, 20)]})
    store.replace(*results(spark, words, {0: "old"})[:1], **results(spark, words, {0: "old"})[1])
    return store, words


def results(spark, words, cell, config="c1"):
    sizes = layout.page_sizes(words).withColumn("config_hash", F.lit(config))
    tables = boxes(spark, [(1, p, 0, 100, 200, 200, 0, 0.8) for p in cell], "table_no int", "confidence double")
    cells = boxes(spark, [(1, p, 0, 100, 200, 200, 0, 0, c, t, 0.8) for p, v in cell.items() for c, t in enumerate([v, "fixed"])], "table_no int", "row int", "column int", "text string", "confidence double")
    blocks = page_plan.elements(words, sizes.drop("config_hash"), [tables])
    return sizes, {"words": words, "blocks": blocks, "tables": tables, "cells": cells}


def told(store, version=None):
    """page -> (texts of its blocks, texts of its cells)"""
    out = {}
    for r in store.trees(version).collect():
        cells = [c.text for b in r.blocks if b.table for row in b.table.rows for c in row.cells]
        out[r.page] = ([x.text for b in r.blocks for x in b.content], cells)
    return out


def test_a_page_is_replaced_at_once(spark, tmp_path):
    store, words = stored(spark, tmp_path)
    assert told(store) == {0: (["one", "two"], ["old", "fixed"]), 1: (["three"], [])}
    new = word_table(spark, {0: [("new", 0, 0, 50, 20)]})
    sizes, parts = results(spark, new, {0: "fresh"})
    assert store.replace(sizes, **parts) == 2
    assert told(store) == {0: (["new"], ["fresh", "fixed"]), 1: (["three"], [])}
    assert told(store, 1) == {0: (["one", "two"], ["old", "fixed"]), 1: (["three"], [])}
    page = store.read("pages").where("page = 0").first()
    assert (page.version, page.ocr_confidence_avg, page.layout_confidence_avg, page.table_confidence_avg) == (2, 0.9, pytest.approx(0.75), 0.8)
    # another session sees the same
    again = PageStore(spark.newSession(), f"file://{tmp_path}/store", 99)
    assert again.buckets == 4 and told(again) == told(store)
    # nothing but a word's absence is left of a page without results
    store.replace(spark.createDataFrame([(1, 1, 10, 10, "c1")], "doc_id long, page int, page_width int, page_height int, config_hash string"))
    assert told(store)[1] == ([], []) and store.read("words").where("page = 1").count() == 0
    store.remove(spark.createDataFrame([(1, 1)], "doc_id long, page int"))
    assert set(told(store)) == {0}


@pytest.mark.parametrize("dies_at", ["words", "cells", "log"])
def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch, dies_at):
    store, words = stored(spark, tmp_path)
    before = told(store)
    sizes, parts = results(spark, word_table(spark, {0: [("new", 0, 0, 50, 20)]}), {0: "fresh"})
    write, put = PageStore._write, CommitLog.commit

    def dying(self, name, *rest):
        write(self, name, *rest)
        if name == dies_at:
            raise SystemError("killed")

    def dying_log(self, *rest):
        raise SystemError("killed")

    monkeypatch.setattr(PageStore, "_write", dying)
    if dies_at == "log":
        monkeypatch.setattr(CommitLog, "commit", dying_log)
    with pytest.raises(SystemError):
        store.replace(sizes, **parts)
    monkeypatch.setattr(PageStore, "_write", write)
    monkeypatch.setattr(CommitLog, "commit", put)
    assert store.version() == 1 and told(store) == before and told(PageStore(spark.newSession(), store.root)) == before
    assert store.replace(sizes, **parts) == 2 and told(store)[0] == (["new"], ["fresh", "fixed"])
    assert store.vacuum() > 0 and told(store)[0] == (["new"], ["fresh", "fixed"])


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    store, words = stored(spark, tmp_path)
    other = PageStore(spark, store.root)
    sizes, parts = results(spark, words, {0: "mine"})
    theirs = results(spark, words, {0: "theirs"})
    put = CommitLog.commit
    done = []

    def late(self, name, value):
        if self is store.log and not done:  # the other writer commits between this one's rows and its entry
            done.append(other.replace(theirs[0], **theirs[1]))
        return put(self, name, value)

    monkeypatch.setattr(CommitLog, "commit", late)
    with pytest.raises(Conflict):
        store.replace(sizes, expected=1, **parts)
    assert told(store)[0][1] == ["theirs", "fixed"] and store.version() == 2
    done.clear()
    assert store.replace(sizes, **parts) == 4  # tried again after theirs
    assert told(store)[0][1] == ["mine", "fixed"]


def test_edits_show_in_the_tree(spark, tmp_path):
    store, _ = stored(spark, tmp_path)
    cells = spark.createDataFrame([(1, 0, 0, 0, 0, 1, "first"), (1, 0, 0, 0, 0, 2, "edited")], "doc_id long, page int, table_no int, row int, column int, ordinal int, text string")
    cells = cells.withColumns({c: F.lit(None).cast(t) for c, t in (("align_h", "string"), ("align_v", "string"), ("rowspan", "int"), ("colspan", "int"))})
    store.edit_cells(cells)
    assert told(store) == {0: (["one", "two"], ["edited", "fixed"]), 1: (["three"], [])}
    cell = store.read("cells").where("column = 0").first()
    assert cell.is_edited and cell.edited_text == "edited" and not store.read("cells").where("column = 1").first().is_edited
    store.edit_blocks(spark.createDataFrame([(1, 1, 0, 1, "THREE", None)], "doc_id long, page int, z_order int, ordinal int, text string, alignment string"))
    assert told(store) == {0: (["one", "two"], ["edited", "fixed"]), 1: (["THREE"], [])}


def test_pages_are_taken_up_by_configuration(spark, tmp_path):
    store, _ = stored(spark, tmp_path)
    wanted = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, page int")
    assert {tuple(r) for r in store.pending(wanted, "c1").collect()} == {(2, 0)}
    assert store.pending(wanted, "c2").count() == 3


def test_compaction_keeps_what_is_current(spark, tmp_path):
    store, words = stored(spark, tmp_path)
    for text in ("a", "b", "c"):
        sizes, parts = results(spark, words.where("page = 0"), {0: text})
        store.replace(sizes, **parts)
    before = told(store)
    assert len(store.segments()) == 4 and store.compact() == 5
    assert len(store.segments()) == 1 and told(store) == before and store.vacuum() == 20
    assert told(store) == before and told(PageStore(spark.newSession(), store.root)) == before
    sizes, parts = results(spark, words.where("page = 0"), {0: "d"})
    store.replace(sizes, **parts)
    assert told(store)[0][1] == ["d", "fixed"] and len(store.segments()) == 2


def test_trees_are_built_without_a_shuffle(spark, tmp_path):
    store, _ = stored(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.trees()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and re.search("SortMergeJoin", plan) and "Bucketed: true" in plan


def test_page_tree_query(spark, sf):
    got = page_queries.page_tree(spark, sf)
    assert got.count() > 200 and got.where("types like '%TABLE%'").count() > 0 and got.where("types like '%IMAGE%'").count() > 0
