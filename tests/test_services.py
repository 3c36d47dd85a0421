"""Batches, registers and documents on small tables with their odd cases."""

import datetime as dt

from pyspark.sql import functions as F

from leafwork.operators import batches, documents, registers

ITEM = "item_id string, batch_id string, document_id string, processing_job_id string, position int, state string, priority_score double, attempts int, error_message string, claimed_at timestamp"
NOW = dt.datetime(2024, 5, 1, 12)


def now():
    return F.lit("2024-05-01 12:00:00").cast("timestamp")


def items(spark, *rows):
    return spark.createDataFrame([(f"i{n}", b, f"d{n}", f"j{n}", n, state, score, 0, None, claimed) for n, (b, state, score, claimed) in enumerate(rows)], ITEM)


def by(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_a_batch_starts_once_and_reverts(spark):
    i = items(spark, ("a", "pending", 1.0, None), ("a", "duplicate", 0.0, None), ("b", "pending", 1.0, None))
    b = spark.createDataFrame([("a", None), ("b", NOW), ("c", None)], "batch_id string, started_at timestamp")
    b2, i2 = batches.start(b, i, b, now())
    assert by(i2, "item_id", "state") == {"i0": "queued", "i1": "duplicate", "i2": "pending"}
    assert {k: v is not None for k, v in by(b2, "batch_id", "started_at").items()} == {"a": True, "b": True, "c": False}
    assert by(batches.start(b2, i2, b2, now())[1], "item_id", "state") == by(i2, "item_id", "state")
    b3, i3 = batches.revert_start(b2, i2, b2.where("batch_id = 'a'"))
    assert by(i3, "item_id", "state")["i0"] == "pending" and by(b3, "batch_id", "started_at")["a"] is None


def test_ties_go_to_the_last_position_on_the_long_lane(spark):
    i = items(spark, ("a", "queued", 9.0, None), ("a", "queued", 9.0, None), ("a", "queued", 1.0, None), ("a", "running", 2.0, None))
    _, out = batches.claim(i, i.where("false").select("document_id"), now(), 4)
    assert by(out, "batch_id", "item_id") == {"a": "i1"}
    _, out = batches.claim(i, i.where("false").select("document_id"), now(), 1)
    assert by(out, "batch_id", "item_id") == {"a": "i2"}  # one lane: the smallest


def test_claims_count_leases_and_recent_claims(spark):
    old, fresh = NOW - dt.timedelta(seconds=121), NOW - dt.timedelta(seconds=119)
    i = items(spark, ("a", "queued", 3.0, None), ("b", "queued", 3.0, None), ("c", "running", 3.0, old), ("c", "running", 3.0, fresh), ("d", "failed", 3.0, None))
    live = spark.createDataFrame([("d3",), ("x",)], "document_id string")
    assert {r[0] for r in batches.busy_documents(i, live, now()).collect()} == {"d3", "x"}
    after, out = batches.claim(i, live, now(), 3)
    assert by(out, "batch_id", "outcome") == {"a": "claimed", "b": "no_capacity", "c": "empty", "d": "empty"}
    assert by(after, "item_id", "state", "attempts") == {"i0": ("running", 1), "i1": ("queued", 0), "i2": ("running", 0), "i3": ("running", 0), "i4": ("failed", 0)}
    assert by(batches.claim(i, live, now(), 2)[1], "batch_id", "outcome")["a"] == "no_capacity"


def test_retry_needs_a_failed_item_and_its_document(spark):
    i = items(spark, ("a", "failed", 1.0, NOW), ("a", "completed", 1.0, None), ("a", "cancelled", 1.0, None))
    docs = spark.createDataFrame([("d0", False), ("d1", False), ("d2", True)], "document_id string, is_deleted boolean")
    asked = spark.createDataFrame([(k, "new") for k in ("i0", "i1", "i2", "i9")], "item_id string, new_job_id string")
    after, refused = batches.retry(i, docs, asked)
    assert by(after, "item_id", "state", "processing_job_id", "claimed_at") == {"i0": ("queued", "new", None), "i1": ("completed", "j1", None), "i2": ("cancelled", "j2", None)}
    assert by(refused, "item_id", "reason") == {"i1": "not failed or cancelled", "i2": "no document", "i9": "no item"}


def test_cancel_and_labels(spark):
    i = items(spark, ("a", "queued", 1.0, None), ("a", "running", 1.0, None), ("b", "completed", 1.0, None), ("b", "duplicate", 0.0, None), ("c", "cancelled", 1.0, None), ("d", "failed", 1.0, None), ("d", "completed", 1.0, None))
    b = spark.createDataFrame([(x, NOW) for x in "abcd"] + [("e", None)], "batch_id string, started_at timestamp")
    assert by(batches.labels(b, i), "batch_id", "label") == {"a": "processing", "b": "completed", "c": "cancelled", "d": "completed_with_errors", "e": "uploading"}
    after, asked = batches.cancel(i, b)
    assert by(after, "item_id", "state")["i0"] == "cancelled" and [r[0] for r in asked.collect()] == ["d1"]
    pages = spark.createDataFrame([("d1", 1), ("d2", 1)], "document_id string, page int")
    assert [r.document_id for r in batches.without_cancelled(pages, asked).collect()] == ["d2"]


def test_finished_items_stay(spark):
    i = items(spark, ("a", "running", 1.0, None), ("a", "failed", 1.0, None), ("a", "queued", 1.0, None), ("a", "running", 1.0, None))
    jobs = spark.createDataFrame([("j0", "FAILED", ""), ("j1", "COMPLETED", None), ("j2", "CANCELLED", None), ("j3", "PROCESSING", None)], "job_id string, status string, error_message string")
    assert by(batches.sync(i, jobs), "item_id", "state", "error_message") == {"i0": ("failed", "Processing failed"), "i1": ("failed", None), "i2": ("cancelled", None), "i3": ("running", None)}


def test_leases(spark):
    later, gone = NOW + dt.timedelta(seconds=5), NOW
    held = spark.createDataFrame([("a", "t1", later), ("b", "t1", gone), ("c", "t1", later), ("d", "t1", later)], "document_id string, token string, expires_at timestamp")
    asked = spark.createDataFrame([("a", "t2", "acquire", 1), ("b", "t2", "acquire", 2), ("b", "t3", "acquire", 3), ("c", "t1", "release", 1), ("d", "t2", "release", 1), ("e", "t9", "renew", 1)], "document_id string, token string, action string, ordinal int")
    got = by(batches.leases(held, asked, now()), "document_id", "token", "expires_at")
    assert got == {"a": ("t1", later), "b": ("t2", NOW + dt.timedelta(seconds=600)), "d": ("t1", later)}


def test_numbers_stay_and_never_collide(spark):
    records = spark.createDataFrame([("d1", "D-7", "old", None, dt.date(2020, 1, 1))], "document_id string, accession_number string, book_name string, extraction_notes string, record_date date")
    read = spark.createDataFrame([("d1", "D-99", "new", ["n"]), ("d2", "D-7", "taken", []), ("d3", "D-20", "own", []), ("d4", "D-20", "same", []), ("d5", None, "none", []), ("d6", "", "blank", [])], "document_id string, accession_number string, book_name string, notes array<string>")
    got = by(registers.upsert_records(records, read, F.lit("2024-01-01").cast("date")), "document_id", "accession_number", "book_name")
    assert got == {"d1": ("D-7", "new"), "d2": ("D-21", "taken"), "d3": ("D-20", "own"), "d4": ("D-22", "same"), "d5": ("D-23", "none"), "d6": ("D-24", "blank")}
    none = registers.upsert_records(records.limit(0), read.where("document_id = 'd5'"), F.lit("2024-01-01").cast("date"))
    assert by(none, "document_id", "accession_number") == {"d5": "D-1"}
    assert registers.header_matches(spark.createDataFrame([], ", ".join(f"`{h}` string" for h in registers.HEADERS))) and not registers.header_matches(records)


def test_uploads_become_documents_once(spark):
    up = spark.createDataFrame([("u1", "a b.pdf", b"x", 2, None, False), ("u2", "c.pdf", b"x", 2, None, False), ("u3", "c.pdf", b"x", 2, None, True), ("u4", "d.exe", b"y", 0, "extension", False), ("u5", "e.pdf", b"held", 1, None, False)], "document_id string, filename string, content binary, page_count int, reject_reason string, force boolean")
    held = spark.createDataFrame([("h1", b"held", False), ("h0", b"held", True)], "document_id string, content binary, is_deleted boolean").withColumn("document_hash", F.sha2("content", 256))
    made, jobs, twins = documents.create(up, held, now())
    assert by(made, "document_id", "original_filename", "storage_original_path") == {"u1": ("a_b.pdf", "original/u1/a_b.pdf"), "u3": ("c.pdf", "original/u3/c.pdf")}
    assert {r.document_id for r in jobs.collect()} == {"u1", "u3"} and by(twins, "document_id", "existing_id") == {"u2": "u1", "u5": "h1"}


def test_maps_merge_and_pages_resume(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": "2"}, {"b": "3"}), (2, None, {"b": "3"}), (3, {"a": "1"}, None)], "i int, x map<string,string>, y map<string,string>")
    assert by(df.select("i", documents.merge_maps(F.col("x"), F.col("y")).alias("m")), "i", "m") == {1: {"a": "1", "b": "3"}, 2: {"b": "3"}, 3: {"a": "1"}}
    key = lambda p, n: documents.config_hash(F.lit(p), F.lit(n), F.lit("FAST"))
    pages = spark.range(3).select("id", F.when(F.col("id") > 0, "{}").alias("document_json"), F.lit("x.png").alias("processed_image_path"), F.when(F.col("id") == 1, key("a", 300)).otherwise(key("a", 150)).alias("config_hash"))
    assert [r.id for r in documents.resumable(pages, key("a", 300)).collect()] == [1]
    same = spark.createDataFrame([(1, 0.0, None, 5, 5, 5, 5), (2, 90.0, 0.0, 5, 5, 5, 5), (3, None, None, 5, 5, 4, 5)], "i int, rotation double, skew double, original_width int, original_height int, width int, height int")
    assert by(same.select("i", documents.geometry_unchanged(same).alias("g")), "i", "g") == {1: True, 2: False, 3: False}


def test_rounds_end(spark, tmp_path):
    n = iter(range(100))

    def store(df):
        path = f"file://{tmp_path}/r{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    taken = []

    def work(claimed):
        rows = claimed.collect()
        taken.append(len(rows))
        # one job is lost, one fails
        ends = {"i0": "COMPLETED", "i1": "FAILED", "i2": "COMPLETED", "i4": "COMPLETED"}
        return spark.createDataFrame([(r.processing_job_id, ends[r.item_id], None) for r in rows if r.item_id in ends], "job_id string, status string, error_message string")

    i = items(spark, ("a", "queued", 1.0, None), ("a", "queued", 2.0, None), ("b", "queued", 1.0, None), ("b", "queued", 5.0, None), ("c", "queued", 1.0, None), ("c", "completed", 1.0, None))
    out = by(batches.run_rounds(i, work, now, 2, store), "item_id", "state")
    assert out == {"i0": "completed", "i1": "failed", "i2": "completed", "i3": "failed", "i4": "completed", "i5": "completed"}
    assert max(taken) == 2 and sum(taken) == 5


def test_refresh_and_quality(spark):
    import numpy as np

    from leafwork.sources import images

    records = spark.createDataFrame([("d1", "D-7", "old", None, dt.date(2020, 1, 1)), ("d2", "D-8", "x", None, dt.date(2020, 1, 1))], "document_id string, accession_number string, book_name string, extraction_notes string, record_date date")
    read = spark.createDataFrame([("d1", None, "new", []), ("d9", None, "unknown", [])], "document_id string, accession_number string, book_name string, notes array<string>")
    docs = spark.createDataFrame([("d1", "ACC_NO_55.pdf"), ("d2", "plain.pdf")], "document_id string, original_filename string")
    out, summary = registers.refresh(records, read, docs, F.lit("2024-01-01").cast("date"))
    assert by(out, "document_id", "accession_number", "book_name") == {"d1": ("D-55", "new"), "d2": ("D-8", "x")}
    assert tuple(summary.first()) == (1, 0, 1)
    png = lambda v: images.encode_png(np.full((20, 20), v, np.uint8))
    pages = spark.createDataFrame([(1, png(9)), (2, png(9)), (3, None)], "page int, image binary")
    again = spark.createDataFrame([(1, png(9)), (3, png(9))], pages.schema)
    got = by(documents.quality_pass(pages, again, ["page"]), "page", "visual_similarity_score")
    assert round(got[1], 6) == 1.0 and got[2] is None and got[3] is None


def test_numbers_are_dealt_in_parts(spark):
    from leafwork.operators import service

    data = [(f"D-{n}", n) for n in (1, 10, 2, 300000, 5000, 4097, 12, 4095)] + [("x", -1), (" d-7 ", 7), (None, -2)]
    df = spark.createDataFrame(data, "number string, n int").repartition(4)
    text = by(service.renumber(df, "number"), "n", "serial")
    want = sorted(data, key=lambda r: (r[0] is not None, (r[0] or "").strip().lower()))
    assert [text[n] for _, n in want] == list(range(1, len(data) + 1))
    number = by(service.renumber(df.where("n > 0"), "number", numeric=True), "n", "serial")
    assert sorted(number, key=number.get) == sorted(n for _, n in data if n > 0)
    plain = by(service.numbered(df, "k", [F.asc("n")]), "n", "k")
    assert [plain[n] for n in sorted(plain, key=lambda n: n)] == list(range(1, len(data) + 1))
    assert service.numbered(df.limit(0), "k", [F.asc("n")]).count() == 0


def test_numbers_of_values_that_begin_alike(spark):
    """Each range has twice the mean at most, though all values have one long beginning; ties and nulls have numbers of their own."""
    from leafwork.operators.numbering import number_rows

    df = spark.range(40_000).select(F.concat(F.lit("a-long-common-beginning-"), F.lpad(F.pmod(F.col("id") * 7919, F.lit(40_000)).cast("string"), 6, "0")).alias("v"))
    got = number_rows(df, [F.asc("v")], ranges=8)
    assert got.where(F.col("number") != F.substring("v", -6, 6).cast("long") + 1).count() == 0 and got.count() == 40_000
    dealt = df.repartitionByRange(8, F.asc("v")).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) <= 2 * 5000
    some = spark.createDataFrame([(None,), ("b",), ("b",), ("a",), (None,)], "v string").withColumn("number", F.lit("replaced"))
    rows = number_rows(some, [F.desc_nulls_last("v")]).orderBy("number").collect()
    assert [(r.number, r.v) for r in rows] == [(1, "b"), (2, "b"), (3, "a"), (4, None), (5, None)]


def test_a_register_is_refreshed_by_changes(spark):
    from leafwork.operators import changes, registers

    def tables(records, documents, jobs, exports):
        value = lambda i, n: (i, n, f"book {n}", "a", "p", 3, "en")
        return {
            "records": spark.createDataFrame([value(i, n) for i, n in records], "document_id long, accession_number string, book_name string, author string, publisher string, total_pages int, language string"),
            "documents": spark.createDataFrame(documents, "document_id long, is_deleted boolean"),
            "jobs": spark.createDataFrame(jobs, "document_id long, job_id long, status string, created_at long"),
            "exports": spark.createDataFrame(exports, "document_id long, export_type string"),
        }

    n = range(1, 40)
    before = tables([(i, f"D-{i}") for i in n], [(i, False) for i in n], [(i, i, "COMPLETED", 1) for i in n], [(i, "SEARCHABLE_PDF") for i in n if i != 7])
    records = [(i, f"D-{i}" if i != 3 else "D-333") for i in n if i != 4]  # one renamed, one gone
    jobs = [(i, i, "COMPLETED", 1) for i in n] + [(9, 900, "FAILED", 2)]  # a later job failed
    after = tables(records, [(i, i == 5) for i in n] + [(50, False)], jobs, [(i, "SEARCHABLE_PDF") for i in n])  # one deleted, one made, one exported
    old = registers.listed(*before.values())
    new, touched = registers.refresh_listed(old, before, after)
    assert {r.document_id for r in touched.collect()} == {3, 4, 5, 7, 9, 50}
    want = registers.register_rows(*after.values())
    assert sorted(map(tuple, registers.sheet(new).collect())) == sorted(map(tuple, want.collect())) and want.count() == 36
    feed = changes.changes(before["records"], after["records"], ["document_id"])
    assert {(r.document_id, r._change) for r in feed.collect()} == {(3, "changed"), (4, "gone")}
    assert changes.changes(after["records"], after["records"], ["document_id"]).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k int, v string")
    assert [r.k for r in changes.changed_keys(twice, twice.distinct(), ["k"]).collect()] == [1]
