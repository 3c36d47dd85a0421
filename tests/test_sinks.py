"""Stores, remote engines, ruled tables, pictures and written documents."""

import datetime as dt
import io
import json
import re
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafwork.plans import resources
from leafwork.sources import images, office, providers, ruled, stores


def test_store_keeps_files_below_its_root(spark, tmp_path):
    s = stores.Store(spark, str(tmp_path / "store"))
    s.write("a/b.bin", b"\x00\x01")
    s.write("a/b.bin", b"new")
    assert s.read("a/b.bin") == b"new" and s.exists("a/b.bin") and s.url_for("a/b.bin") == f"file://{tmp_path}/store/a/b.bin"
    with pytest.raises(ValueError):
        s.write("../out", b"x")
    with pytest.raises(ValueError):
        s.delete_prefix("")
    df = spark.createDataFrame([("x/1.pdf", b"one"), ("x/2.pdf", b"two"), ("../3.pdf", b"no"), ("x/4.pdf", None)], "path string, content binary")
    got = {r.path: (r.size, r.error is None) for r in s.put_all(df).collect()}
    assert got == {"x/1.pdf": (3, True), "x/2.pdf": (3, True), "../3.pdf": (None, False)} and s.read("x/2.pdf") == b"two"
    assert s.delete("x/1.pdf") and not s.exists("x/1.pdf") and s.delete_prefix("x") and not s.exists("x/2.pdf")
    assert s.mime_type("x.pdf") == "application/pdf" and s.mime_type("x") == "application/octet-stream"
    assert stores.resolve("s3://bucket/p/") == "s3a://bucket/p" and stores.resolve("hdfs://n/p") == "hdfs://n/p"
    with pytest.raises(ValueError):
        stores.resolve("s3:///p")


def test_remote_engines_read_arrays_inside_prose():
    said = 'Here: [{"text": " Title ", "bbox": [0, 0.5, 1, 1]}, {"text": "", "bbox": [0,0,1,1]}, {"text": "x", "bbox": [1]}, 7] done'
    image, sent = np.zeros((100, 200), np.uint8), []
    post = lambda url, payload, headers, timeout: sent.append((url, payload, headers, timeout)) or {"choices": [{"message": {"content": said}}], "message": {"content": said}}
    engine = providers.Nvidia("http://host/v1", "m", "k", post)
    assert engine.available() and not providers.Nvidia("http://host/v1", "m", "", post).available()
    got = engine.recognize(image, 1, 72)
    assert [(w["text"], w["x1"], w["y1"], w["x2"], w["y2"], w["confidence"], w["font_size"]) for w in got] == [("Title", 0.0, 50.0, 200.0, 100.0, 0.75, 50.0)]
    assert sent[0][2] == {"Authorization": "Bearer k"} and sent[0][1]["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/png;base64,")
    local = providers.Ollama("http://127.0.0.1:9/api/chat", "m", "", post)
    assert not local.available()
    assert providers.region_words(local.answer(post("", {}, {}, 0)), 200, 100, local.sure, 72)[0]["confidence"] == 0.7
    assert providers.json_array("no") == [] and providers.json_array("[1, {}]") == [{}] and providers.json_array('{"a": 1}') == []
    assert {"nvidia", "ollama"} <= set(providers.REGISTRY)


def test_passes_of_two_languages_are_merged():
    quad = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]

    class Engine:
        def __init__(self, rows):
            self.rows = rows

        def ocr(self, image):
            return [self.rows]

    rows = {"hi": [(quad(0, 50, 40, 10), ("low", 0.4)), (quad(0, 0, 40, 10), ("top", 0.9))], "en": [(quad(2, 50, 40, 10), ("LOW", 0.8)), (quad(2, 0, 40, 10), ("TOP", 0.5)), (quad(80, 0, 9, 10), ("more", 0.5))]}
    got = providers.Paddle(engine=lambda lang: Engine(rows[lang])).recognize(None, 1, 72)
    assert [(w["text"], w["line_id"]) for w in got] == [("top", "0"), ("more", "1"), ("LOW", "2")]


def test_failed_pages_are_tried_again(spark):
    class Once(providers.Provider):
        name = "once"

        def available(self):
            return True

        def recognize(self, image, page, dpi):
            if page == 3:
                raise OSError("again")
            return [{"text": f"p{page}", "x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "confidence": 1.0}]

    pages = spark.createDataFrame([(1, p, b"") for p in (1, 2, 3, 4)], "doc_id long, page int, image binary")
    first = providers.recognize_pages(pages.where("page = 1"), Once, bytes).unionByName(providers.recognize_pages(pages.where("page = 3"), Once, bytes))
    got = providers.retry_sweep(pages, first, Once, bytes)
    assert sorted((r.page, r.text, r.error) for r in got.collect()) == [(1, "p1", None), (2, "p2", None), (3, None, "OSError: again"), (4, "p4", None)]
    assert [tuple(r) for r in providers.failed_documents(got).collect()] == [(1, "OSError: again")]


# --------------------------------------------------------------- ruled tables
def ruled_page(merged: bool = False) -> tuple[np.ndarray, pd.DataFrame]:
    """A 3 x 3 grid from (50, 40), cells of 100 x 60; with ``merged``, no line between the first two cells above."""
    g = np.full((300, 400), 255, np.uint8)
    for k in range(4):
        g[40 + 60 * k - 1 : 40 + 60 * k + 1, 50:351] = 0
        g[40:221, 50 + 100 * k - 1 : 50 + 100 * k + 1] = 0
    if merged:
        g[43:97, 145:155] = 255
    words = [(f"{r}{c}", 80 + 100 * c, 60 + 60 * r, 110 + 100 * c, 75 + 60 * r, 0.9) for r in range(3) for c in range(3)]
    return g, pd.DataFrame(words, columns=["text", "x1", "y1", "x2", "y2", "confidence"])


def test_table_structure():
    g, w = ruled_page()
    t = ruled.table_structure(g, (40, 30, 360, 230), w)
    assert sorted(zip(t["row"], t["column"], t.rowspan, t.colspan, t.text, strict=True)) == [(r, c, 1, 1, f"{r}{c}") for r in range(3) for c in range(3)]
    assert t.is_header.sum() == 3 and t.table_confidence.iloc[0] == pytest.approx(0.9)
    assert abs(t.x1.min() - 50) <= 2 and abs(t.y2.max() - 220) <= 2
    g, w = ruled_page(merged=True)
    t = ruled.table_structure(g, (40, 30, 360, 230), w)
    assert (0, 0, 1, 2, "00 01") in set(zip(t["row"], t["column"], t.rowspan, t.colspan, t.text, strict=True)) and len(t) == 8
    assert ruled.table_structure(g, (40, 30, 360, 230), w.iloc[:2]) is None  # mostly empty
    assert ruled.table_structure(np.full((300, 400), 255, np.uint8), (40, 30, 360, 230), w.iloc[:0]) is None
    assert ruled.table_structure(g, (10, 10, 10, 50), w) is None


def test_separators():
    mask = np.zeros((60, 60), bool)
    mask[0:60, 30] = True
    assert ruled.line_present(mask, 31, 0, 60, True) and not ruled.line_present(mask, 40, 0, 60, True)
    assert ruled.line_present(mask.T, 30, 0, 60, False) and not ruled.line_present(mask, 30, 20, 20, True)
    mask[:] = False
    mask[0:20, 30] = True  # a third of the span, a sixth of its band
    assert not ruled.line_present(mask, 30, 0, 60, True)


def test_ruled_tables_and_model_tables(spark):
    g, w = ruled_page()
    pages = spark.createDataFrame([(1, 0, images.encode_png(g)), (2, 0, None)], "doc_id long, page int, image binary")
    words = spark.createDataFrame(w.assign(doc_id=1, page=0))
    got = ruled.ruled_tables(pages, words).collect()
    assert sorted((r["row"], r["column"], r.text) for r in got) == [(r, c, f"{r}{c}") for r in range(3) for c in range(3)] and {r.doc_id for r in got} == {1}
    model = ruled.structure_model(pages.where("doc_id = 1"), lambda image: [(0, 0, 9, 9, "<table><tr><td colspan=2>a</td></tr><tr><td>b</td><td>c</td></tr></table>")])
    assert sorted((r["row"], r["column"], r.colspan, r.text, r.confidence) for r in model.collect()) == [(0, 0, 2, "a", 0.8), (1, 0, 1, "b", 0.8), (1, 1, 1, "c", 0.8)]


def test_pictures_are_found_and_cropped(spark):
    g = np.full((500, 500), 255, np.uint8)
    g[50:120, 60:130] = 0  # a stamp
    g[300:400, 50:350] = 60  # a picture under words
    g[200, 10:490] = 0  # a thin line
    assert len(ruled.blots(g)) == 2
    pages = spark.createDataFrame([(1, 0, images.encode_png(g), 500, 500)], "doc_id long, page int, image binary, page_width int, page_height int")
    w = spark.createDataFrame([(1, 0, 60.0, 310.0, 340.0, 390.0, 0.9)], "doc_id long, page int, x1 double, y1 double, x2 double, y2 double, confidence double")
    none = w.limit(0).select("doc_id", "page", "x1", "y1", "x2", "y2")
    got = ruled.graphic_regions(pages, w, none).collect()
    assert [(r.block_type, abs(r.x1 - 60) <= 9, abs(r.y2 - 120) <= 9) for r in got] == [("STAMP", True, True)]
    covered = spark.createDataFrame([(1, 0, 40.0, 40.0, 150.0, 150.0)], none.schema)
    assert not ruled.graphic_regions(pages, w, covered).collect()
    b = spark.createDataFrame([(1, 0, 0, "STAMP", 60.0, 50.0, 130.0, 120.0), (1, 0, 1, "IMAGE", 480.0, 480.0, 900.0, 900.0), (1, 0, 2, "PARAGRAPH", 0.0, 0.0, 5.0, 5.0), (1, 0, 3, "IMAGE", 5.0, 5.0, 5.0, 9.0)], "doc_id long, page int, z_order int, block_type string, x1 double, y1 double, x2 double, y2 double")
    p = pages.select("doc_id", "page", "image", F.lit(None).cast("binary").alias("original"), F.lit(True).alias("geometry_unchanged"))
    crops = {r.z_order: r.crop for r in ruled.crop_blocks(b, p).collect()}
    assert set(crops) == {0, 1, 3} and crops[3] is None
    assert (images.decode_png(bytes(crops[0])) == 0).all() and images.decode_png(bytes(crops[1])).shape == (20, 20)


# -------------------------------------------------------------------- writers
CELLS = [dict(row=0, column=0, rowspan=1, colspan=2, text="Head & <x>", align_h="CENTER", is_header=True, x1=0, y1=0, x2=200, y2=40), dict(row=1, column=0, rowspan=2, colspan=1, text="a", x1=0, y1=40, x2=100, y2=80), dict(row=1, column=1, rowspan=1, colspan=1, text="b", x1=100, y1=40, x2=200, y2=60), dict(row=2, column=1, rowspan=1, colspan=1, text="", x1=100, y1=60, x2=200, y2=80)]


def page_blocks() -> pd.DataFrame:
    png = images.encode_png(np.zeros((20, 40), np.uint8))
    rows = [("TITLE", "A title", None, None), ("TABLE", "", CELLS, None), ("HLINE", "", None, None), ("VLINE", "", None, None), ("IMAGE", "", None, png), ("FOOTNOTE", "note", None, None), ("IMAGE", "", None, b"broken"), ("PARAGRAPH", "  ", None, None)]
    return pd.DataFrame([dict(block_type=k, text=t, cells=c, image=i, page=0, page_width=600, page_height=800, x1=10.0, y1=10.0 + 50 * n, x2=300.0, y2=50.0 + 50 * n, alignment="RIGHT" if k == "TITLE" else "LEFT") for n, (k, t, c, i) in enumerate(rows)])


def test_documents_have_tables_rules_and_pictures():
    import xml.etree.ElementTree as ET

    b = page_blocks()
    data = office.text_document(pd.concat([b, b.assign(page=1)]), 150)
    z = zipfile.ZipFile(io.BytesIO(data))
    xml = z.read("word/document.xml").decode()
    ET.fromstring(xml)
    assert sorted(n for n in z.namelist() if "media" in n) == ["word/media/image1.png", "word/media/image2.png"]
    assert xml.count("<w:tbl>") == 2 and xml.count('w:gridSpan w:val="2"') == 2 and xml.count('<w:vMerge w:val="restart"/>') == 2 and xml.count("<w:vMerge/>") == 2
    assert xml.count("w:pBdr") == 4 and xml.count("<w:sectPr>") == 2 and "Head &amp; &lt;x&gt;" in xml and '<w:jc w:val="right"/>' in xml
    assert f'w:w="{round(600 / 150 * 1440)}"' in xml and xml.count("<w:i/>") == 2


def streams(pdf: bytes) -> str:
    return "".join(zlib.decompress(m).decode("latin-1") for m in re.findall(rb"stream\n(.*?)\nendstream", pdf, re.S) if b"\x00" * 8 not in m)


def test_reconstructed_pages():
    data, errors = office.reconstructed_pdf([(600.0, 800.0, page_blocks())], 150)
    assert data.startswith(b"%PDF") and len(errors) == 1 and "IMAGE" in errors[0]
    text = streams(data)
    assert text.count(" re S") == len(CELLS) and text.count(" l S") == 2 and "(A title) Tj" in text and "/B 16.00 Tf" in text and "/I1 Do" in text
    assert "(b) Tj" in text and "() Tj" not in text


def test_text_fits_or_falls_to_the_floor():
    assert office.fit_text("short", 200, 20, 10.0) == (10.0, ["short"])
    size, lines = office.fit_text("several words in a narrow box", 40, 40, 10.0)
    assert 5.0 <= size < 10.0 and " ".join(lines) == "several words in a narrow box"
    assert office.fit_text("word " * 400, 20, 10, 10.0)[0] == office.FLOOR
    # a low cell keeps its text
    items = office.table_items([dict(text="42", x1=0, y1=0, x2=30, y2=3)], lambda c: (c["x1"], c["y1"], c["x2"], c["y2"]))
    assert [i[0] for i in items] == ["box", "text"] and items[1][4] == "42"
    assert office.font_covers("Über 1") and not office.font_covers("हिन्दी")


def test_register_workbook():
    import xml.etree.ElementTree as ET

    records = pd.DataFrame([dict(record_date=dt.date(2023, m, 5), accession_number=f"D-{m}", book_name=f"b{m}", creator=None, language="ENGLISH", year_of_publication="1990", total_pages=3, record_type="BOOK", needs_review=m == 2) for m in (2, 1, 2)])
    docs = pd.DataFrame([dict(id="d", original_filename="f.pdf", created_at=dt.datetime(2023, 1, 2, 3, 4), page_count=1, status=s, error_message=None, document_hash="h") for s in ("COMPLETED", "FAILED", "QUEUED")])
    z = zipfile.ZipFile(io.BytesIO(office.register_workbook(records, docs)))
    names = re.findall(r'<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
    assert names == ["Common", "January 2023", "February 2023", "Document Register", "Summary"]
    for n in z.namelist():
        if n.endswith(".xml"):
            ET.fromstring(z.read(n))
    last = z.read("xl/worksheets/sheet5.xml").decode()
    values = re.findall(r"<v>([^<]*)</v>", last)
    assert values == ["3", "1", "1", "3", "2", "2023", "3", "1", "2"]
    assert "05-02-2023" in z.read("xl/worksheets/sheet3.xml").decode()
    assert len(office.register_workbook(records.iloc[:0].assign(needs_review=pd.Series([], dtype=bool)))) > 0


def test_resources(tmp_path):
    (tmp_path / "cpu.max").write_text("200000 100000\n")
    (tmp_path / "memory.max").write_text(f"{512 << 20}\n")
    cpus, memory = resources.host(str(tmp_path))
    assert cpus <= 2 and memory <= 512
    assert resources.host(str(tmp_path / "none"))[0] >= 1
    assert resources.workers(4, 16, None) == 4 and resources.workers_each("paddleocr", 2, 14, 24000) == 2 and resources.workers_each("tesseract", 2, 14, 24000) is None
    resources.check_disk(1030, 1)
    with pytest.raises(ValueError):
        resources.check_disk(1029, 1)


def test_progress_is_published(spark, tmp_path):
    from leafwork.sources import progress_source

    progress_source.register_source(spark)
    src, kind = f"file://{tmp_path}/in", "document_id long, job_id long, status string, percent int"
    spark.createDataFrame([(7, 1, "COMPLETED", 100)], kind).write.parquet(src)
    stream = spark.readStream.schema(kind).parquet(src)
    q = stream.writeStream.format("progress").option("path", f"{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.read.format("progress").option("path", f"{tmp_path}/out").load().first()
    assert (r.document_id, r.job_id, r.status, r.percent, r.stage) == ("7", "1", "COMPLETED", 100, None)


def test_engine_facade(spark, sf, tmp_path):
    from leafwork.engine import Engine

    e = Engine(spark, f"file://{tmp_path}/corpus")
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 12").unionByName(spark.createDataFrame([(900, None)], "doc_id long, text string"))
    n = texts.count()
    assert e.process(texts) == n and e.process(texts) == 0  # a text without words is not taken up again
    assert e.layout(3).select("doc_id").distinct().count() == 1 and e.layout().count() == e.blocks().count()
    assert e.export(texts.where("doc_id = 3"), "DOCX").select("export_type").collect()[0][0] == "DOCX" and e.words(texts).count() > 0 and e.tables(texts).count() >= 0
    with pytest.raises(ValueError):
        e.export(texts, "XYZ")
    assert e.regenerate("PDF").where("error is null and size > 0").count() == e.blocks().where("trim(text) <> ''").select("doc_id").distinct().count()
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    e.upsert("things", t, ["k"])
    seen = e.table("things")
    e.upsert("things", t.where("k = 1").withColumn("v", F.lit("new")), ["k"])
    assert sorted(map(tuple, seen.collect())) == [(1, "a"), (2, "b")]  # a reader that began keeps its version
    e.upsert("things", t.where("k = 2").withColumn("k", F.lit(3)), ["k"])
    assert sorted(map(tuple, e.table("things").collect())) == [(1, "new"), (2, "b"), (3, "b")]
    assert e.documents().count() == 0 and e.batches().count() == 0


def test_deleting_a_document_takes_its_files(spark, tmp_path):
    from leafwork import schemas
    from leafwork.engine import Engine

    e = Engine(spark, f"file://{tmp_path}/corpus")
    d = spark.createDataFrame([{"id": i, "original_filename": "f", "is_deleted": False, "status": "QUEUED"} for i in ("a", "b")], schemas.TABLES["documents"])
    e.upsert("documents", d, ["id"])
    s = stores.Store(spark, f"file://{tmp_path}/corpus")
    for i in ("a", "b"):
        s.write(f"original/{i}/f.pdf", b"x")
    e.delete(["a"])
    assert [(r.id, r.total) for r in e.documents().collect()] == [("b", 1)]
    assert not s.exists("original/a") and s.exists("original/b/f.pdf")
