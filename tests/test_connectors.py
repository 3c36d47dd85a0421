"""Relational tables, progress as a data source, and table functions."""

import os

import pytest
from pyspark.sql import functions as F

from leafwork.sources import html_tables, progress_source
from leafwork.sources.relational import Database


# ----------------------------------------------------------------- relational tables
@pytest.fixture
def database(spark, tmp_path):
    db = Database(spark, f"jdbc:derby:{tmp_path}/db;create=true")
    db.execute('CREATE TABLE docs ("ID" BIGINT NOT NULL PRIMARY KEY, "NAME" VARCHAR(40) NOT NULL, "PAGES" INT, "NOTE" VARCHAR(20) DEFAULT \'none\')')
    return db


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_rows_are_merged_by_key(spark, database):
    first = spark.createDataFrame([(i, f"n{i}", i) for i in range(100)], '"ID" long, "NAME" string, "PAGES" int'.replace('"', ""))
    database.merge(first, "docs", ["ID"])
    database.execute("UPDATE docs SET \"NOTE\" = 'kept' WHERE \"ID\" = 5")
    database.merge(spark.createDataFrame([(5, "new", None), (200, "added", 2)], first.schema), "docs", ["ID"])
    got = {r.ID: (r.NAME, r.PAGES, r.NOTE) for r in database.table("docs").collect()}
    assert len(got) == 101 and got[5] == ("new", None, "kept") and got[200] == ("added", 2, "none") and got[7] == ("n7", 7, "none")
    database.merge(first.limit(0), "docs", ["ID"])
    assert database.table("docs").count() == 101


def test_a_write_that_fails_leaves_the_table_as_it_was(spark, database):
    kind = "ID long, NAME string, PAGES int"
    database.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], kind), "docs", ["ID"])
    before = rows(database.table("docs"))
    # the second row breaks a constraint after the first was merged; a key comes twice; a task dies while rows are staged
    with pytest.raises(Exception, match="(?i)null"):
        database.merge(spark.createDataFrame([(1, "changed", 9), (3, None, 3)], kind).coalesce(1), "docs", ["ID"])
    with pytest.raises(ValueError, match="twice"):
        database.merge(spark.createDataFrame([(1, "x", 9), (1, "y", 3)], kind), "docs", ["ID"])
    dying = spark.range(50).select("id", F.lit("n").alias("NAME"), F.when(F.col("id") == 40, F.raise_error(F.lit("killed")).cast("int")).otherwise(1).alias("PAGES")).withColumnRenamed("id", "ID")
    with pytest.raises(Exception, match="killed"):
        database.merge(dying.repartition(4), "docs", ["ID"])
    assert rows(database.table("docs")) == before
    left = database.query("SELECT tablename FROM sys.systables WHERE tabletype = 'T'").collect()
    assert [r[0] for r in left] == ["DOCS"]


def test_reading_splits_the_key_and_pushes_filters(spark, database):
    database.merge(spark.range(1000).select(F.col("id").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"), F.lit(3).alias("PAGES")), "docs", ["ID"])
    df = database.table("docs", "ID", 4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 1000
    some = df.where("ID > 10 AND NAME = 'n77'").select("ID", "NAME")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(ID,10)" in plan and "EqualTo(NAME,n77)" in plan and "PAGES" not in plan
    assert rows(some) == [(77, "n77")]
    database.execute("DELETE FROM docs")
    assert database.table("docs", "ID", 4).count() == 0


# ------------------------------------------------------------------------ progress
EVENTS = "document_id string, job_id string, status string, stage string, percent int, at_ms long"


@pytest.fixture
def progress(spark):
    progress_source.register_source(spark)


def events(spark, folder, rows_):
    spark.createDataFrame(rows_, EVENTS).repartition(3).write.mode("append").parquet(folder)


def event(i, percent):
    return (f"d{i}", f"j{i}", "PROCESSING", "OCR", percent, 1000 + percent)


def publish(spark, folder, path, checkpoint):
    q = spark.readStream.schema(EVENTS).parquet(folder).writeStream.format("progress").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def follow(spark, path, checkpoint, out, **options):
    df = spark.readStream.format("progress").option("path", path).options(**options).load()
    q = df.writeStream.foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(((r.document_id, r.percent) for r in spark.read.schema(progress_source.EVENT).parquet(out).collect()), key=str)


def test_progress_flows_from_stream_to_stream(spark, tmp_path, progress):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/progress"
    events(spark, folder, [event(i, 10) for i in range(30)] + [(None, None, "PROCESSING", None, None, None)])
    publish(spark, folder, path, f"{tmp_path}/w")
    got = follow(spark, path, f"{tmp_path}/r", f"{tmp_path}/out")
    assert len(got) == 31 and ("d7", 10) in got and (None, None) in got
    events(spark, folder, [event(7, 60), event(8, 70)])
    publish(spark, folder, path, f"{tmp_path}/w")
    assert follow(spark, path, f"{tmp_path}/r", f"{tmp_path}/out") == sorted([*got, ("d7", 60), ("d8", 70)], key=str)
    assert follow(spark, path, f"{tmp_path}/one", f"{tmp_path}/of7", document="d7") == [("d7", 10), ("d7", 60)]
    batch = spark.read.format("progress").option("path", path).load()
    one = spark.read.format("progress").option("path", path).option("document", "d8").load()
    assert batch.where("document_id = 'd8'").count() == 2
    assert sorted(r.percent for r in one.collect()) == [10, 70] and batch.count() == 33
    assert one.rdd.getNumPartitions() < batch.rdd.getNumPartitions()


@pytest.mark.parametrize("at", ["before", "after"])
def test_a_writer_that_stops_around_its_commit_loses_and_doubles_nothing(spark, tmp_path, progress, at):
    """The batch's offset is noted and the stream stops before the batch's entry, or after it but before Spark's own commit."""
    folder, path, cp = f"{tmp_path}/in", f"{tmp_path}/progress", f"{tmp_path}/w"
    events(spark, folder, [event(i, 10) for i in range(20)])
    publish(spark, folder, path, cp)
    name = max(os.listdir(f"{cp}/commits"), key=lambda n: (n.isdigit(), n))
    os.remove(f"{cp}/commits/{name}")
    crc = f"{cp}/commits/.{name}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    if at == "before":
        os.remove(f"{path}/_entries/{int(name):012d}.json")
        assert spark.read.format("progress").option("path", path).load().count() == 0  # its files are there, but no entry names them
    publish(spark, folder, path, cp)
    assert sorted((r.document_id, r.percent) for r in spark.read.format("progress").option("path", path).load().collect()) == sorted((f"d{i}", 10) for i in range(20))


def test_a_reader_that_stops_reads_the_same_again(spark, tmp_path, progress):
    folder, path, cp, out = f"{tmp_path}/in", f"{tmp_path}/progress", f"{tmp_path}/r", f"{tmp_path}/out"
    events(spark, folder, [event(i, 10) for i in range(20)])
    publish(spark, folder, path, f"{tmp_path}/w")
    seen = []

    def dying(batch, number):
        seen.append((number, sorted(r.document_id for r in batch.collect())))
        if len(seen) == 1:
            raise SystemError("stopped")

    def run():
        q = spark.readStream.format("progress").option("path", path).load().writeStream.foreachBatch(dying).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="stopped"):
        run()
    events(spark, folder, [event(99, 5)])
    publish(spark, folder, path, f"{tmp_path}/w")
    run()
    run()
    assert seen[0] == seen[1] and [d for _, d in seen[2:]] == [["d99"]] and not os.path.exists(out)


# ----------------------------------------------------------------- table functions
def test_html_cells_from_sql(spark):
    html_tables.register_functions(spark)
    nested = "<table><tr><td>a<table><tr><td>inner</td></tr></table></td><td rowspan=2>b</td></tr><tr><td>c</table>"
    open_ = "<p>x</p><table><tr><th colspan='2'>head<tr><td>1<td>2"
    pages = spark.createDataFrame([(1, nested), (2, open_), (3, None), (4, "no table"), (5, "<table></table>")], "page_id int, html string").coalesce(1)
    pages.createOrReplaceTempView("html_pages")
    want = sorted(map(tuple, html_tables.table_cells(pages).collect()))
    got = spark.sql("SELECT page_id, c.* FROM html_pages, LATERAL html_cells(html) AS c")
    assert want and sorted(map(tuple, got.collect())) == want
    # a page in two parts: the numbers of its tables go on
    spark.createDataFrame([(1, 0, "<table><tr><td>a</table>"), (1, 1, "<table><tr><td>b</table>"), (2, 0, "<table><tr><td>c</table>")], "page_id int, part int, html string").createOrReplaceTempView("html_parts")
    parts = spark.sql("SELECT * FROM html_cells(TABLE(SELECT page_id, part, html FROM html_parts) PARTITION BY page_id ORDER BY part)")
    assert sorted((r.table_no, r.text) for r in parts.collect()) == [(0, "a"), (0, "c"), (1, "b")]
    assert spark.sql("SELECT org_fuzzy('DIREOTORATE OF X') AS a, org_fuzzy('great book') AS b, org_fuzzy(null) AS c").first()[:] == (True, False, False)
