"""Queries of batches, registers and documents.

Their items, jobs, records and pages are columns of the driver's tables; the SQL
states the rules anew, by windows and CASE, not by the operators' plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.operators import batches, documents, registers
from leafwork.plans.queries import query
from leafwork.session import table

# ---------------------------------------------------------------- batches
ITEMS = """items AS (SELECT o_orderkey AS item_id, o_custkey AS batch_id, o_orderkey AS document_id, o_orderkey AS processing_job_id, o_orderkey AS position,
 CASE o_orderstatus WHEN 'F' THEN CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'duplicate' ELSE 'completed' END WHEN 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'queued' END ELSE 'running' END AS state,
 ceil(o_totalprice / 100000)::DOUBLE AS priority_score, (o_orderkey % 3)::INTEGER AS attempts, CASE WHEN o_orderkey % 4 = 0 THEN 'old' END AS error_message, o_orderdate AS claimed_at FROM orders)"""
JOBS = "jobs AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 7 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'CANCELLED' ELSE 'PROCESSING' END AS status, CASE WHEN o_orderkey % 14 = 1 THEN 'boom' END AS error_message, (o_orderkey % 100)::INTEGER AS progress_percent, o_orderdate AS started_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 90 SECOND END AS finished_at FROM orders)"
BATCHES = "batches AS (SELECT c_custkey AS batch_id, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2020-01-01' END AS started_at FROM customer)"


def items_of(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    done = F.when(k % 5 == 0, "failed").when(k % 5 == 1, "cancelled").when(k % 5 == 2, "duplicate").otherwise("completed")
    state = F.when(F.col("o_orderstatus") == "F", done).when(F.col("o_orderstatus") == "O", F.when(k % 3 == 0, "pending").otherwise("queued")).otherwise("running")
    same = {c: k.alias(c) for c in ("item_id", "document_id", "processing_job_id", "position")}
    return table(spark, d, "orders").select(*same.values(), F.col("o_custkey").alias("batch_id"), state.alias("state"), F.ceil(F.col("o_totalprice") / 100000).cast("double").alias("priority_score"), (k % 3).cast("int").alias("attempts"), F.when(k % 4 == 0, "old").alias("error_message"), F.col("o_orderdate").cast("timestamp").alias("claimed_at"))


def jobs_of(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, "COMPLETED").when(k % 7 == 1, "FAILED").when(k % 7 == 2, "CANCELLED").otherwise("PROCESSING")
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(k.alias("job_id"), status.alias("status"), F.when(k % 14 == 1, "boom").alias("error_message"), (k % 100).cast("int").alias("progress_percent"), at.alias("started_at"), F.when(k % 2 == 0, at + F.expr("interval 90 seconds")).alias("finished_at"))


def batches_of(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("batch_id"), F.when(F.col("c_custkey") % 3 == 0, F.lit("2020-01-01").cast("timestamp")).alias("started_at"))


@query(f"""WITH {ITEMS}, {BATCHES}, f AS (SELECT batch_id FROM batches WHERE started_at IS NULL AND batch_id % 2 = 0 AND batch_id IN (SELECT batch_id FROM items))
SELECT item_id, CASE WHEN state = 'pending' AND batch_id IN (SELECT batch_id FROM f) THEN 'queued' ELSE state END AS state, coalesce(b.started_at, CASE WHEN i.batch_id IN (SELECT batch_id FROM f) THEN TIMESTAMP '2024-05-01' END) IS NOT NULL AS started FROM items i LEFT JOIN batches b USING (batch_id)""")
def batch_start(spark, d):
    b, i = batches_of(spark, d), items_of(spark, d)
    b, i = batches.start(b, i, b.where("batch_id % 2 = 0"), F.lit("2024-05-01").cast("timestamp"))
    return i.join(b, "batch_id", "left").select("item_id", "state", F.col("started_at").isNotNull().alias("started"))


@query(f"WITH {ITEMS} SELECT item_id, CASE WHEN state = 'queued' AND batch_id % 4 = 0 THEN 'pending' ELSE state END AS state FROM items")
def batch_revert(spark, d):
    b = batches_of(spark, d)
    return batches.revert_start(b, items_of(spark, d), b.where("batch_id % 4 = 0"))[1].select("item_id", "state")


@query(f"""WITH {ITEMS}, {JOBS}, m AS (SELECT i.*, j.status, j.error_message AS e, i.state IN ('pending', 'queued', 'running') AND j.status <> 'PROCESSING' AS moves FROM items i JOIN jobs j ON j.job_id = i.processing_job_id)
SELECT item_id, CASE WHEN moves THEN lower(status) ELSE state END AS state, CASE WHEN moves AND status = 'FAILED' THEN coalesce(e, 'Processing failed') ELSE error_message END AS error_message FROM m""")
def batch_sync(spark, d):
    return batches.sync(items_of(spark, d), jobs_of(spark, d)).select("item_id", "state", "error_message")


@query(f"""WITH {ITEMS}, c AS (SELECT *, CASE WHEN batch_id % 5 = 0 AND state IN ('pending', 'queued') THEN 'cancelled' ELSE state END AS s FROM items),
a AS (SELECT *, item_id % 2 = 0 AND s IN ('failed', 'cancelled') AND document_id % 3 <> 0 AS again FROM c)
SELECT item_id, CASE WHEN again THEN 'queued' ELSE s END AS state, CASE WHEN again THEN 7000000000 + item_id ELSE processing_job_id END AS job, CASE WHEN again THEN NULL ELSE error_message END AS error_message FROM a""")
def batch_cancel_retry(spark, d):
    """Some batches are cancelled; then every second item asks for a retry, of which some documents are gone."""
    i = items_of(spark, d)
    i, _ = batches.cancel(i, batches_of(spark, d).where("batch_id % 5 = 0"))
    docs = i.select("document_id", (F.col("document_id") % 3 == 0).alias("is_deleted"))
    asked = i.where("item_id % 2 = 0").select("item_id", (F.lit(7000000000) + F.col("item_id")).alias("new_job_id"))
    return batches.retry(i, docs, asked)[0].select("item_id", "state", F.col("processing_job_id").alias("job"), "error_message")


@query(f"""WITH {ITEMS}, s AS (SELECT * FROM items WHERE state IN ('queued', 'running')),
g AS (SELECT batch_id, median(priority_score) AS mid, max(priority_score) FILTER (state = 'running') AS longest, count(*) FILTER (state = 'queued') AS q, count(*) FILTER (state = 'running') AS r FROM s GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY priority_score, position) AS up, row_number() OVER (PARTITION BY batch_id ORDER BY priority_score DESC, position DESC) AS down FROM s WHERE state = 'queued'),
c AS (SELECT k.batch_id, k.item_id, k.attempts, row_number() OVER (ORDER BY k.batch_id) AS n FROM g JOIN k ON k.batch_id = g.batch_id AND CASE WHEN g.q > 1 AND g.r > 0 AND g.longest < g.mid THEN k.down = 1 ELSE k.up = 1 END)
SELECT b.batch_id, CASE WHEN c.item_id IS NULL THEN 'empty' WHEN n > 40 THEN 'no_capacity' ELSE 'claimed' END AS outcome, CASE WHEN n <= 40 THEN c.item_id END AS item_id, CASE WHEN n <= 40 THEN attempts + 1 END AS attempts, CASE WHEN n <= 40 THEN 'running' END AS state FROM (SELECT DISTINCT batch_id FROM items) b LEFT JOIN c USING (batch_id)""")
def batch_claim(spark, d):
    """A round of claims on a host with 40 free lanes."""
    i, now = items_of(spark, d), F.lit("1997-01-01").cast("timestamp")
    live = i.where("document_id % 211 = 0").select("document_id")
    lanes = batches.busy_documents(i, live, now).count() + 40
    after, outcomes = batches.claim(i, live, now, lanes)
    return outcomes.join(after.select("item_id", "attempts", "state"), "item_id", "left").select("batch_id", "outcome", "item_id", "attempts", "state")


@query(f"WITH {ITEMS} SELECT count(DISTINCT document_id) AS busy FROM items WHERE document_id % 211 = 0 OR (state = 'running' AND claimed_at >= TIMESTAMP '1997-01-01' - INTERVAL 120 SECOND)")
def busy_documents(spark, d):
    i = items_of(spark, d)
    return batches.busy_documents(i, i.where("document_id % 211 = 0").select("document_id"), F.lit("1997-01-01").cast("timestamp")).agg(F.count("*").alias("busy"))


@query(f"""WITH {ITEMS}, {BATCHES}, n AS (SELECT batch_id, list_sort(list_distinct(list(state))) AS s FROM items GROUP BY 1)
SELECT batch_id, CASE WHEN started_at IS NULL THEN 'uploading' WHEN len(list_filter(s, lambda x: x IN ('pending', 'queued', 'running'))) > 0 THEN 'processing' WHEN s IS NULL OR len(list_filter(s, lambda x: x NOT IN ('completed', 'duplicate'))) = 0 THEN 'completed' WHEN s = ['cancelled'] THEN 'cancelled' ELSE 'completed_with_errors' END AS label FROM batches LEFT JOIN n USING (batch_id)""")
def batch_labels(spark, d):
    return batches.labels(batches_of(spark, d), items_of(spark, d))


@query(f"""WITH {ITEMS}, {JOBS} SELECT item_id, CASE WHEN state = 'completed' THEN 100 ELSE j.progress_percent END AS percent, coalesce(i.error_message, CASE WHEN j.status = 'FAILED' THEN j.error_message END) AS error_message, CASE WHEN j.finished_at IS NOT NULL THEN 90.0::DOUBLE END AS duration_s FROM items i JOIN jobs j ON j.job_id = i.processing_job_id""")
def batch_item_reads(spark, d):
    return batches.item_reads(items_of(spark, d), jobs_of(spark, d)).select("item_id", "percent", "error_message", "duration_s")


@query("WITH f AS (SELECT doc_id AS document_id, n_chars AS file_size_bytes FROM documents) SELECT o_custkey AS batch_id, coalesce(sum(file_size_bytes), 0)::BIGINT AS bytes FROM orders LEFT JOIN f ON f.document_id = o_orderkey GROUP BY 1")
def batch_bytes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("file_size_bytes"))
    return batches.batch_bytes(items_of(spark, d), docs)


@query("""WITH h AS (SELECT sha256(text) AS hash, min(doc_id) AS same FROM documents WHERE doc_id % 4 = 0 GROUP BY 1),
n AS (SELECT d.doc_id, d.doc_id % 6 AS batch_id, sha256(d.text) AS hash, d.n_chars, row_number() OVER (PARTITION BY d.doc_id % 6 ORDER BY d.doc_id) - 1 AS nth, sum(d.n_chars) OVER (PARTITION BY d.doc_id % 6 ORDER BY d.doc_id) AS total FROM documents d WHERE d.doc_id % 4 <> 0)
SELECT doc_id, nth::INTEGER AS position, CASE WHEN batch_id = 3 THEN 'started' WHEN nth >= 60 THEN 'too many files' WHEN total > 100000 THEN 'too many bytes' END AS refused, CASE WHEN batch_id = 3 OR nth >= 60 OR total > 100000 THEN NULL WHEN same IS NOT NULL THEN 'duplicate' ELSE 'pending' END AS state, coalesce(same, doc_id) AS document_id FROM n LEFT JOIN h USING (hash)""")
def batch_add_files(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("document_hash"), F.col("n_chars").alias("file_size_bytes"))
    files = docs.where("doc_id % 4 <> 0").withColumn("batch_id", F.col("doc_id") % 6).withColumn("priority_score", F.lit(1.0)).withColumn("ordinal", F.col("doc_id"))
    heads = spark.range(6).select(F.col("id").alias("batch_id"), F.when(F.col("id") == 3, F.lit("2020-01-01").cast("timestamp")).alias("started_at"))
    out = batches.add_files(heads, items_of(spark, d).where("item_id < 0"), files, docs.where("doc_id % 4 = 0").withColumn("is_deleted", F.lit(False)), 60, 100_000)
    return out.select("doc_id", "position", "refused", "state", "document_id")


@query("""WITH h AS (SELECT c_custkey AS document_id, 'a' || c_custkey % 3 AS token, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2023-12-31' END AS expires_at FROM customer WHERE c_custkey % 4 <> 3),
r AS (SELECT * FROM (SELECT o_custkey AS document_id, 'a' || o_orderkey % 3 AS token, CASE o_orderkey % 3 WHEN 0 THEN 'acquire' WHEN 1 THEN 'renew' ELSE 'release' END AS action, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1),
m AS (SELECT coalesce(h.document_id, r.document_id) AS document_id, h.token AS ht, h.expires_at, r.token AS rt, r.action FROM (SELECT * FROM h WHERE expires_at > TIMESTAMP '2024-01-01') h FULL JOIN r USING (document_id))
SELECT document_id, coalesce(ht, rt) AS token, epoch(CASE WHEN ht IS NULL OR (action = 'renew' AND rt = ht) THEN TIMESTAMP '2024-01-01 00:10:00' ELSE expires_at END)::BIGINT AS until FROM m WHERE (ht IS NULL AND action = 'acquire') OR (ht IS NOT NULL AND NOT coalesce(action = 'release' AND rt = ht, false))""")
def lease_round(spark, d):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    held = table(spark, d, "customer").where("c_custkey % 4 <> 3").select(c.alias("document_id"), F.concat(F.lit("a"), (c % 3).cast("string")).alias("token"), F.when(c % 2 == 0, F.lit("2024-01-02")).otherwise("2023-12-31").cast("timestamp").alias("expires_at"))
    action = F.when(o % 3 == 0, "acquire").when(o % 3 == 1, "renew").otherwise("release")
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.concat(F.lit("a"), (o % 3).cast("string")).alias("token"), action.alias("action"), o.alias("ordinal"))
    return batches.leases(held, asked, F.lit("2024-01-01").cast("timestamp")).select("document_id", "token", F.unix_seconds("expires_at").alias("until"))


# --------------------------------------------------------------- register
RECORDS = "records AS (SELECT s_suppkey AS document_id, 'D-' || (s_suppkey * 3 + 100)::VARCHAR AS accession_number, s_name AS book_name, 'en' AS language, NULL::VARCHAR AS notes FROM supplier)"


def records_of(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("document_id"), F.concat(F.lit("D-"), (F.col("s_suppkey") * 3 + 100).cast("string")).alias("accession_number"), F.col("s_name").alias("book_name"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("extraction_notes"), F.lit("2023-01-01").cast("date").alias("record_date"))


@query(f"""WITH {RECORDS}, r AS (SELECT p_partkey AS document_id, CASE p_partkey % 3 WHEN 0 THEN 'D-' || (p_partkey // 2)::VARCHAR WHEN 1 THEN 'D-' || (900000 + p_partkey // 6)::VARCHAR END AS number, p_name AS book_name FROM part),
o AS (SELECT s.document_id, s.accession_number, coalesce(r.book_name, s.book_name) AS book_name, NULL::VARCHAR AS extraction_notes FROM records s LEFT JOIN r USING (document_id)),
n AS (SELECT *, number IS NOT NULL AND number NOT IN (SELECT accession_number FROM records) AND row_number() OVER (PARTITION BY number ORDER BY document_id) = 1 AS free FROM r WHERE document_id NOT IN (SELECT document_id FROM records)),
u AS (SELECT max(x) AS top FROM (SELECT split_part(accession_number, '-', 2)::BIGINT AS x FROM records UNION ALL SELECT split_part(number, '-', 2)::BIGINT FROM n WHERE free))
SELECT * FROM o UNION ALL SELECT document_id, number, book_name, NULL FROM n WHERE free
UNION ALL SELECT document_id, 'D-' || ((SELECT top FROM u) + row_number() OVER (ORDER BY document_id))::VARCHAR, book_name, CASE WHEN number IS NOT NULL THEN 'accession_number: extracted ''' || number || ''' is already assigned to another document; generated a new one instead' END FROM n WHERE NOT free""")
def register_upsert(spark, d):
    p = F.col("p_partkey")
    number = F.when(p % 3 == 0, F.floor(p / 2)).when(p % 3 == 1, 900000 + F.floor(p / 6)).cast("string")
    read = table(spark, d, "part").select(p.alias("document_id"), F.concat(F.lit("D-"), number).alias("accession_number"), F.col("p_name").alias("book_name"), F.lit("en").alias("language"), F.array().cast("array<string>").alias("notes"))
    return registers.upsert_records(records_of(spark, d), read, F.current_date()).select("document_id", "accession_number", "book_name", "extraction_notes")


@query(f"""WITH {RECORDS}, f AS (SELECT document_id, accession_number, 'D-' || (CASE document_id % 4 WHEN 0 THEN document_id * 3 + 100 WHEN 1 THEN 500000 + document_id // 8 WHEN 2 THEN document_id * 3 + 103 END)::VARCHAR AS found FROM records WHERE document_id % 7 <> 0),
w AS (SELECT *, CASE WHEN found <> accession_number THEN found END AS want FROM f),
k AS (SELECT *, want IS NOT NULL AND want NOT IN (SELECT accession_number FROM records) AND row_number() OVER (PARTITION BY want ORDER BY document_id) = 1 AS wins FROM w)
SELECT r.document_id, CASE WHEN k.wins THEN want ELSE r.accession_number END AS accession_number, CASE WHEN k.document_id IS NULL THEN 'no_document' WHEN want IS NULL THEN 'unchanged' WHEN wins THEN 'updated' ELSE 'skipped_taken' END AS outcome FROM records r LEFT JOIN k USING (document_id)""")
def number_backfill(spark, d):
    r, k = records_of(spark, d), F.col("document_id")
    n = F.when(k % 4 == 0, k * 3 + 100).when(k % 4 == 1, 500000 + F.floor(k / 8)).when(k % 4 == 2, k * 3 + 103).cast("string")
    docs = r.where("document_id % 7 <> 0").select("document_id", F.coalesce(F.concat(F.lit("scan_ACC_NO_"), n, F.lit("_x.pdf")), F.lit("plain.pdf")).alias("original_filename"))
    return registers.backfill_numbers(r, docs).select("document_id", "accession_number", "outcome")


@query("""WITH l AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT (row_number() OVER (ORDER BY 'd-' || c_custkey::VARCHAR))::INTEGER AS serial, c_name AS book_name, 'D-' || c_custkey::VARCHAR AS accession_number, (c_custkey % 90)::INTEGER AS pages FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 2 = 0 AND c_custkey IN (SELECT o_custkey FROM l WHERE n = 1 AND o_orderstatus = 'F')""")
def register_rebuild(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    records = c.select(k.alias("document_id"), F.concat(F.lit("D-"), k.cast("string")).alias("accession_number"), F.col("c_name").alias("book_name"), F.lit("a").alias("author"), F.lit("p").alias("publisher"), (k % 90).cast("int").alias("total_pages"), F.lit("en").alias("language"))
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("job_id"))
    docs = c.select(k.alias("document_id"), (k % 5 == 0).alias("is_deleted"))
    exports = c.select(k.alias("document_id"), F.when(k % 2 == 0, "SEARCHABLE_PDF").otherwise("DOCX").alias("export_type"))
    return registers.register_rows(records, docs, jobs, exports).select(F.col("`S.No`").alias("serial"), F.col("Book Name").alias("book_name"), F.col("Accession Number").alias("accession_number"), F.col("Pages").alias("pages"))


@query("SELECT o_orderkey, total FROM (SELECT o_orderkey, count(*) OVER () AS total, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 3) WHERE n BETWEEN 21 AND 40")
def records_page(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderdate").alias("record_date"), F.col("o_orderkey").alias("accession_number"))
    page, total = registers.list_records(r, 2, 20, 1996, 3)
    return page.crossJoin(total).select(F.col("accession_number").alias("o_orderkey"), "total")  # a page and one row


# -------------------------------------------------------------- documents
@query("""WITH u AS (SELECT doc_id, sha256(text) AS h, text, n_chars, doc_id % 50 = 7 AS force FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 11 <> 0),
h AS (SELECT sha256(text) AS h, min(doc_id) AS held FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), f AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM u)
SELECT doc_id, h AS document_hash, CASE WHEN force THEN NULL ELSE coalesce(held, CASE WHEN first <> doc_id THEN first END) END AS existing_id, CASE WHEN force OR (held IS NULL AND first = doc_id) THEN 'original/' || doc_id::VARCHAR || '/my_file_' || doc_id::VARCHAR || '.pdf' END AS path FROM f LEFT JOIN h USING (h)""")
def create_documents(spark, d):
    t = table(spark, d, "documents")
    up = t.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("up/my file "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.col("text").cast("binary").alias("content"), F.lit(1).alias("page_count"), F.when(F.col("doc_id") % 11 == 0, "content").alias("reject_reason"), (F.col("doc_id") % 50 == 7).alias("force"))
    held = t.where("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("document_hash"), F.lit(False).alias("is_deleted"))
    made, jobs, twins = documents.create(up, held, F.current_timestamp())
    made = made.join(jobs.select("document_id", "job_id"), "document_id")
    none = F.lit(None)
    hashes = up.select("document_id", F.sha2("content", 256).alias("document_hash"))
    out = made.select("document_id", none.cast("long").alias("existing_id"), F.col("storage_original_path").alias("path")).union(twins.select("document_id", "existing_id", none.cast("string")))
    return out.join(hashes, "document_id").select(F.col("document_id").alias("doc_id"), "document_hash", "existing_id", "path")


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 4 = 0), c AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS confidence FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM p) UNION ALL SELECT k, 99, 0.5 FROM p)
SELECT k, count(*) AS n, sum(n)::BIGINT AS lines, round(avg(confidence), 6) AS confidence FROM c GROUP BY 1""")
def replace_page_results(spark, d):
    """Pages are processed again: their old children go, the new ones come, and averages follow."""
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("confidence"))
    pages = c.where("k % 4 = 0").select("k").distinct()
    now = documents.replace_children(c, pages.withColumn("n", F.lit(99)).withColumn("confidence", F.lit(0.5)), pages, ["k"])
    heads = documents.page_averages(now.select("k").distinct(), now, now, now, ["k"])
    n = now.groupBy("k").agg(F.count("*").alias("n"), F.sum("n").cast("long").alias("lines"))
    return heads.join(n, "k").select("k", "n", "lines", F.round("ocr_confidence_avg", 6).alias("confidence"))


@query("SELECT l_orderkey AS page, count(*) AS n FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_linenumber % 2 = 0) GROUP BY 1")
def delete_cells_of_pages(spark, d):
    """Cells go with their table: that of a page of every third number, if the table is even."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("table_id"), "l_linenumber")
    left = documents.delete_cells_of(t, t.where("l_linenumber % 2 = 0"), t.where("page % 3 = 0"), ["page"])
    return left.groupBy("page").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT p_partkey AS id, p_name AS text, p_brand AS font, p_partkey % 5 = 0 AS hit FROM part)
SELECT id, CASE WHEN hit THEN 'edited ' || id::VARCHAR ELSE text END AS text, hit AS is_edited, CASE WHEN id % 10 = 0 THEN 'bold' ELSE font END AS font, CASE WHEN id % 10 = 0 THEN 'red' END AS color, 'left' AS align FROM e""")
def edit_blocks(spark, d):
    p = F.col("p_partkey")
    b = table(spark, d, "part").select(p.alias("block_id"), F.col("p_name").alias("text"), F.lit(None).cast("string").alias("edited_text"), F.lit(False).alias("is_edited"), F.create_map(F.lit("font"), F.col("p_brand"), F.lit("align"), F.lit("left")).alias("style"))
    style = F.when(F.col("block_id") % 10 == 0, F.create_map(F.lit("font"), F.lit("bold"), F.lit("color"), F.lit("red")))
    new = b.where("block_id % 5 = 0").select("block_id", F.concat(F.lit("edited "), F.col("block_id").cast("string")).alias("text"), style.alias("style"), F.lit(2).alias("ordinal"))
    old = new.select("block_id", F.lit("first try").alias("text"), F.lit(None).cast("map<string,string>").alias("style"), F.lit(1).alias("ordinal"))
    out = documents.edit_blocks(b, new.union(old))
    s = lambda k: F.try_element_at("style", F.lit(k)).alias(k)
    return out.select(F.col("block_id").alias("id"), "text", "is_edited", s("font"), s("color"), s("align"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_partkey % 6 = 0 THEN 'new' ELSE l_returnflag END AS text, CASE WHEN l_partkey % 4 = 0 THEN 2 ELSE 1 END AS rowspan, CASE WHEN l_partkey % 4 = 0 THEN 'center' ELSE 'left' END AS align_h, l_partkey % 6 = 0 AS is_edited FROM lineitem""")
def edit_cells(spark, d):
    k = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey")
    c = table(spark, d, "lineitem").select(k.alias("cell_id"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("text"), F.lit("left").alias("align_h"), F.lit("top").alias("align_v"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(None).cast("string").alias("edited_text"), F.lit(False).alias("is_edited"))
    p = F.col("l_partkey")
    patch = c.where("l_partkey % 6 = 0 or l_partkey % 4 = 0").select("cell_id", F.when(p % 6 == 0, "new").alias("text"), F.when(p % 4 == 0, "center").alias("align_h"), F.lit(None).cast("string").alias("align_v"), F.when(p % 4 == 0, 2).alias("rowspan"), F.lit(None).cast("int").alias("colspan"), F.lit(1).alias("ordinal"))
    return documents.edit_cells(c, patch).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "text", "rowspan", "align_h", "is_edited")


@query("""WITH t AS (SELECT s_suppkey AS id, s_suppkey % 10 AS page, CASE WHEN s_suppkey % 2 = 0 THEN 'b' || s_suppkey::VARCHAR END AS block FROM supplier)
SELECT id AS table_id, coalesce(block, 'b' || id::VARCHAR) AS block_id FROM t WHERE id % 5 <> 0 OR block IS NOT NULL""")
def link_tables(spark, d):
    """Tables of even number name their block; the others have an equal box, but every fifth of them has none."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))
    i = F.col("i")
    page, box = (i % 10).alias("page"), [i.cast("double").alias("x1"), F.lit(0.0).alias("y1"), (i + 5).cast("double").alias("x2"), F.lit(9.0).alias("y2")]
    blocks = s.select(page, F.concat(F.lit("b"), i.cast("string")).alias("block_id"), F.lit("table").alias("type"), i.alias("z_order"), *box)
    far = F.when((i % 5 == 0) | (i % 2 == 0), -1.0).otherwise(0.0)
    tables = s.select(page, i.alias("table_id"), F.when(i % 2 == 0, F.concat(F.lit("b"), i.cast("string"))).alias("layout_block_id"), box[0], far.alias("y1"), box[2], box[3])
    return documents.link_tables(blocks, tables, ["page"]).select("table_id", "block_id")


@query("SELECT o_custkey AS table_id, count(DISTINCT (n // 3)) AS n_rows, string_agg(o_orderpriority, '|' ORDER BY n) AS texts FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders) GROUP BY 1")
def table_trees(spark, d):
    from leafwork.plans.queries import cells_of

    t = documents.table_trees(cells_of(spark, d))
    texts = F.flatten(F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["text"])))
    return t.select("table_id", F.size("rows").cast("long").alias("n_rows"), F.array_join(texts, "|").alias("texts"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fixed ' || doc_id::VARCHAR ELSE lang END AS text FROM documents")
def read_words(spark, d):
    corrected = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("fixed "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, "")
    w = table(spark, d, "documents").select("doc_id", F.col("lang").alias("text"), corrected.alias("corrected_text"))
    return documents.read_words(w).select("doc_id", "text")


@query("SELECT l_orderkey AS document_id, round(avg(l_quantity / 50), 6) AS confidence, round(avg(CASE WHEN l_returnflag <> 'A' THEN l_discount END), 6) AS similarity, count(*) AS pages FROM lineitem GROUP BY 1")
def document_quality(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_quantity") / 50).alias("ocr_confidence_avg"), F.when(F.col("l_returnflag") != "A", F.col("l_discount")).alias("visual_similarity_score"))
    q = documents.document_quality(p)
    return q.select("document_id", F.round("confidence", 6).alias("confidence"), F.round("similarity", 6).alias("similarity"), "pages")
