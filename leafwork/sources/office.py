"""Files of results: workbooks, text documents and PDF, by the standard library.

Writers take what one document holds; write_exports() maps them over documents
on the executors and returns the bytes as rows, which a sink then stores."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions.geometry import GRAPHICS
from leafwork.functions.text import DEFAULT_FONTS
from leafwork.session import ship
from leafwork.sources.images import decode_png

_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _text(v) -> str:
    return escape(_BAD.sub("", str(v)))


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def workbook(sheets: dict[str, list[list]], merges: dict[str, list[tuple[int, int, int, int]]] | None = None) -> bytes:
    """An XLSX file.  Text stays text; ints and floats are numbers; the first row is bold.
    merges: (row, column, rows, columns) by sheet."""
    names = {s: re.sub(r"[\[\]:*?/\\]", "_", s)[:31] or f"Sheet{i}" for i, s in enumerate(sheets, 1)}
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "[Content_Types].xml": _XML + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>",
        "_rels/.rels": _XML + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": _XML + f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names.values(), 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": _XML + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="s" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": _XML + f'<styleSheet xmlns="{main}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    for i, (name, rows) in enumerate(sheets.items(), 1):
        body = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row):
                at, style = f"{_column(c)}{r}", ' s="1"' if r == 1 else ""
                if v is None:
                    continue
                if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool):
                    cells.append(f'<c r="{at}"{style}><v>{v}</v></c>')
                else:
                    cells.append(f'<c r="{at}"{style} t="inlineStr"><is><t xml:space="preserve">{_text(v)}</t></is></c>')
            body.append(f'<row r="{r}">{"".join(cells)}</row>')
        width = max(map(len, rows), default=1)
        columns = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{max(8, min(48, 4 + max((len(str(row[c])) for row in rows if c < len(row) and row[c] is not None), default=0)))}" customWidth="1"/>' for c in range(width))
        joined = [f'<mergeCell ref="{_column(c)}{r + 1}:{_column(c + w - 1)}{r + h}"/>' for r, c, h, w in (merges or {}).get(name, []) if h * w > 1]
        tail = f'<mergeCells count="{len(joined)}">{"".join(joined)}</mergeCells>' if joined else ""
        parts[f"xl/worksheets/sheet{i}.xml"] = _XML + f'<worksheet xmlns="{main}"><cols>{columns}</cols><sheetData>{"".join(body)}</sheetData>{tail}</worksheet>'
    return _zip(parts)


def tables_workbook(filename: str, cells: pd.DataFrame) -> bytes:
    """Document_Info, Table_Index and one sheet for each table of a document; a
    table's cells have table_no, row, column, rowspan, colspan and text."""
    tables = [(n, g) for n, g in cells.groupby("table_no")]
    sheets: dict[str, list[list]] = {"Document_Info": [["Field", "Value"], ["Source file", filename], ["Tables", len(tables)]], "Table_Index": [["Table", "Rows", "Columns", "Sheet"]]}
    merges = {}
    for k, (n, g) in enumerate(tables, 1):
        name, h, w = f"Table_{k:03d}", int((g.row + g.rowspan).max()), int((g.column + g.colspan).max())
        grid = [[None] * w for _ in range(h)]
        for c in g.itertuples():
            grid[c.row][c.column] = c.text
        sheets[name] = grid
        merges[name] = [(c.row, c.column, c.rowspan, c.colspan) for c in g.itertuples()]
        sheets["Table_Index"].append([int(n), h, w, name])
    return workbook(sheets, merges)


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
_LEVEL = {"TITLE": "Title", "HEADING": "Heading1", "SUBHEADING": "Heading2"}
_ALIGN = {"CENTER": "center", "RIGHT": "right", "JUSTIFY": "both"}


def _paragraph(text: str, style: str = "", align: str | None = None, size: float | None = None, bold: bool = False, italic: bool = False) -> str:
    about = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:jc w:val="{_ALIGN[align]}"/>' if align in _ALIGN else "")
    run = ("<w:b/>" if bold else "") + ("<w:i/>" if italic else "") + (f'<w:sz w:val="{int(2 * size)}"/>' if size else "")
    lines = "<w:br/>".join(f'<w:t xml:space="preserve">{_text(x)}</w:t>' for x in text.split("\n"))
    return f"<w:p>{f'<w:pPr>{about}</w:pPr>' if about else ''}<w:r>{f'<w:rPr>{run}</w:rPr>' if run else ''}{lines}</w:r></w:p>"


def _grid(cells: list[dict]) -> str:
    """A table; merged cells span columns, and go on in the rows below."""
    h, w = max(c["row"] + c["rowspan"] for c in cells), max(c["column"] + c["colspan"] for c in cells)
    owner: dict[tuple[int, int], dict] = {}
    for c in cells:
        for r in range(c["row"], c["row"] + c["rowspan"]):
            for k in range(c["column"], c["column"] + c["colspan"]):
                owner.setdefault((r, k), c)
    edge = "".join(f'<w:{side} w:val="single" w:sz="4" w:space="0" w:color="000000"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
    rows = []
    for r in range(h):
        k, out = 0, []
        while k < w:
            c = owner.get((r, k))
            if c is None:
                out.append("<w:tc><w:p/></w:tc>")
                k += 1
                continue
            span = 1
            while k + span < w and owner.get((r, k + span)) is c:
                span += 1
            about = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + ("" if c["rowspan"] == 1 else '<w:vMerge w:val="restart"/>' if r == c["row"] else "<w:vMerge/>")
            text = _paragraph(c["text"] or "", align=c.get("align_h"), size=9, bold=bool(c.get("is_header"))) if r == c["row"] else "<w:p/>"
            out.append(f"<w:tc><w:tcPr>{about}</w:tcPr>{text}</w:tc>")
            k += span
        rows.append(f"<w:tr>{''.join(out)}</w:tr>")
    return f'<w:tbl><w:tblPr><w:jc w:val="center"/><w:tblBorders>{edge}</w:tblBorders></w:tblPr><w:tblGrid>{"<w:gridCol/>" * w}</w:tblGrid>{"".join(rows)}</w:tbl>'


def _picture(n: int, width: int, height: int) -> str:
    size = f'cx="{width}" cy="{height}"'
    shape = f'<pic:pic xmlns:pic="{_DRAWING}/picture"><pic:nvPicPr><pic:cNvPr id="{n}" name="image{n}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="i{n}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic>'
    return f'<w:p><w:r><w:drawing><wp:inline xmlns:wp="{_DRAWING}/wordprocessingDrawing"><wp:extent {size}/><wp:docPr id="{n}" name="image{n}"/><a:graphic xmlns:a="{_DRAWING}/main"><a:graphicData uri="{_DRAWING}/picture">{shape}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'


def text_document(blocks: pd.DataFrame, dpi: int = 150) -> bytes:
    """A DOCX file of blocks in order: titles and headings by level, other text as
    paragraphs, tables with merged cells, horizontal rules and pictures; upright rules
    have no counterpart.  Blocks have block_type and text, and may have page,
    page_width and page_height (a section each page), alignment, font_size, cells
    (a list of dicts), image (PNG) and x1, x2.  A block that fails is left out."""
    body, media = [], []
    section = lambda w, h: f'<w:sectPr><w:pgSz w:w="{round(w / dpi * 1440)}" w:h="{round(h / dpi * 1440)}"/><w:pgMar w:top="720" w:right="720" w:bottom="720" w:left="720"/></w:sectPr>'
    size = None
    for b in blocks.to_dict("records"):
        now = (b.get("page", 0), b.get("page_width"), b.get("page_height"))
        if size and now[0] != size[0]:
            body.append(f"<w:p><w:pPr>{section(*size[1:]) if size[1] else ''}</w:pPr></w:p>" if size[1] else '<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        size = now
        try:
            kind, cells, image = b["block_type"], b.get("cells"), b.get("image")
            if kind == "TABLE" and isinstance(cells, list) and cells:
                body.append(_grid(cells))
            elif kind == "HLINE":
                body.append('<w:p><w:pPr><w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="000000"/></w:pBdr></w:pPr></w:p>')
            elif kind in GRAPHICS:
                if isinstance(image, bytes):
                    pixels = decode_png(image)
                    width = round((b["x2"] - b["x1"]) / dpi * 914400)
                    body.append(_picture(len(media) + 1, width, round(width * pixels.shape[0] / pixels.shape[1])))
                    media.append(image)
            elif kind != "VLINE" and b["text"].strip():
                own = b.get("font_size")
                own = float(own) if own else DEFAULT_FONTS.get(kind, 10.0)
                body.append(_paragraph(b["text"], _LEVEL.get(kind, ""), b.get("alignment"), own, italic=kind == "FOOTNOTE"))
        except Exception:  # noqa: BLE001  one bad block must not lose the document
            continue
    last = section(*size[1:]) if size and size[1] else ""
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{n}"/></w:style>' for s, n in (("Title", "Title"), ("Heading1", "heading 1"), ("Heading2", "heading 2")))
    kinds = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    images = "".join(f'<Relationship Id="i{i}" Type="{_REL}/image" Target="media/image{i}.png"/>' for i in range(1, len(media) + 1))
    return _zip(
        {
            "[Content_Types].xml": _XML + f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="{kinds}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kinds}.styles+xml"/></Types>',
            "_rels/.rels": _XML + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="word/document.xml"/></Relationships>',
            "word/_rels/document.xml.rels": _XML + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_REL}/styles" Target="styles.xml"/>{images}</Relationships>',
            "word/styles.xml": _XML + f'<w:styles xmlns:w="{_W}">{styles}</w:styles>',
            "word/document.xml": _XML + f'<w:document xmlns:w="{_W}" xmlns:r="{_REL}"><w:body>{"".join(body)}{last}</w:body></w:document>',
            **{f"word/media/image{i}.png": data for i, data in enumerate(media, 1)},
        }
    )


def _literal(text: str) -> str:
    raw = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return raw.decode("latin-1")


def font_covers(text: str) -> bool:
    """Whether the writers' font has every character of a text that is not white space."""
    try:
        "".join(text.split()).encode("cp1252")
    except UnicodeEncodeError:
        return False
    return True


class Pdf:
    """A PDF file with pages of text and images; text in Helvetica, Latin-1."""

    def __init__(self):
        self.objects: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
        self.pages: list[int] = []
        self.bold: int | None = None

    def _add(self, data: bytes) -> int:
        self.objects.append(data)
        return len(self.objects)

    def _stream(self, head: str, data: bytes) -> int:
        z = zlib.compress(data)
        return self._add(f"<< {head} /Filter /FlateDecode /Length {len(z)} >>\nstream\n".encode() + z + b"\nendstream")

    def page(self, width: float, height: float, words: list[tuple[str, float, float, float]], image: np.ndarray | None = None, place: tuple[float, float, float, float] | None = None, visible: bool = True) -> None:
        """words: (text, left, baseline from the top, size) in points; image: pixels, at (x1, y1, x2, y2) from the top."""
        ops, use = [], ""
        if image is not None:
            h, w = image.shape[:2]
            space = "/DeviceGray" if image.ndim == 2 else "/DeviceRGB"
            n = self._stream(f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace {space} /BitsPerComponent 8", np.ascontiguousarray(image, np.uint8).tobytes())
            x1, y1, x2, y2 = place or (0, 0, width, height)
            ops.append(f"q {x2 - x1:.3f} 0 0 {y2 - y1:.3f} {x1:.3f} {height - y2:.3f} cm /I Do Q")
            use = f"/XObject << /I {n} 0 R >>"
        ops.append(f"BT {0 if visible else 3} Tr")
        for text, x, y, size in words:
            ops.append(f"/F {size:.2f} Tf 1 0 0 1 {x:.3f} {height - y:.3f} Tm ({_literal(text)}) Tj")
        ops.append("ET")
        content = self._stream("", "\n".join(ops).encode("latin-1"))
        self.pages.append(self._add(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width:.3f} {height:.3f}] /Contents {content} 0 R /Resources << /Font << /F 3 0 R >> {use} >> >>".encode()))

    def drawing(self, width: float, height: float, items: list[tuple]) -> None:
        """A page of items in points from the top left: ("text", x, baseline, size, text,
        bold), ("box", x1, y1, x2, y2, line width), ("line", x1, y1, x2, y2, line width)
        and ("image", pixels, x1, y1, x2, y2)."""
        if self.bold is None:
            self.bold = self._add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding /WinAnsiEncoding >>")
        ops, images = [], []
        for kind, *v in items:
            if kind == "text":
                x, y, size, text, bold = v
                ops.append(f"BT /{'B' if bold else 'F'} {size:.2f} Tf 1 0 0 1 {x:.3f} {height - y:.3f} Tm ({_literal(text)}) Tj ET")
            elif kind == "box":
                x1, y1, x2, y2, pen = v
                ops.append(f"{pen} w {x1:.3f} {height - y2:.3f} {x2 - x1:.3f} {y2 - y1:.3f} re S")
            elif kind == "line":
                x1, y1, x2, y2, pen = v
                ops.append(f"{pen} w {x1:.3f} {height - y1:.3f} m {x2:.3f} {height - y2:.3f} l S")
            else:
                pixels, x1, y1, x2, y2 = v
                h, w = pixels.shape[:2]
                space = "/DeviceGray" if pixels.ndim == 2 else "/DeviceRGB"
                images.append(self._stream(f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace {space} /BitsPerComponent 8", np.ascontiguousarray(pixels, np.uint8).tobytes()))
                ops.append(f"q {x2 - x1:.3f} 0 0 {y2 - y1:.3f} {x1:.3f} {height - y2:.3f} cm /I{len(images)} Do Q")
        content = self._stream("", "\n".join(ops).encode("latin-1"))
        use = f"/XObject << {' '.join(f'/I{i} {n} 0 R' for i, n in enumerate(images, 1))} >>" if images else ""
        self.pages.append(self._add(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width:.3f} {height:.3f}] /Contents {content} 0 R /Resources << /Font << /F 3 0 R /B {self.bold} 0 R >> {use} >> >>".encode()))

    def save(self) -> bytes:
        self.objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
        self.objects[1] = f"<< /Type /Pages /Count {len(self.pages)} /Kids [{' '.join(f'{p} 0 R' for p in self.pages)}] >>".encode()
        out, at = bytearray(b"%PDF-1.4\n"), []
        for i, o in enumerate(self.objects, 1):
            at.append(len(out))
            out += f"{i} 0 obj\n".encode() + o + b"\nendobj\n"
        xref = len(out)
        out += f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{a:010d} 00000 n \n".encode() for a in at)
        out += f"trailer << /Size {len(at) + 1} /Root 1 0 R >>\nstartxref\n{xref}\n%%EOF\n".encode()
        return bytes(out)


def word_size(box_width: float, box_height: float, text: str) -> float:
    """The size of a word in its box: 0.85 of the height, at least 3, less where the text is over 1.15 of the box wide."""
    size = max(3.0, 0.85 * box_height)
    wide = 0.5 * size * len(text)
    return size * min(1.0, 1.15 * box_width / wide) if wide and box_width > 0 else size


def searchable_pdf(pages: list[tuple[float, float, np.ndarray | None, pd.DataFrame]], dpi: int, visible: bool = False) -> bytes:
    """Pages (width, height in pixels, image, words with boxes): the image, and the words at their places, unseen unless ``visible``."""
    pdf, k = Pdf(), 72.0 / dpi
    for width, height, image, words in pages:
        placed = [(w.text, w.x1 * k, w.y2 * k - 0.2 * (w.y2 - w.y1) * k, word_size((w.x2 - w.x1) * k, (w.y2 - w.y1) * k, w.text)) for w in words.itertuples() if w.text.strip()]
        pdf.page(width * k, height * k, placed, image, visible=visible)
    return pdf.save()


# Sizes of text that is made to fit, in points.
STEP, LEGIBLE, FLOOR = 0.5, 5.0, 2.5
LEADING, EM = 1.2, 0.5


def _wrapped(text: str, width: float, size: float) -> list[str]:
    """The lines of a text at a size, broken at spaces; a longer word is a line of its own."""
    most, out = max(1, int(width / (EM * size))), []
    for line in text.split("\n"):
        now = ""
        for word in line.split(" "):
            if now and len(now) + 1 + len(word) > most:
                out.append(now)
                now = word
            else:
                now = f"{now} {word}" if now else word
        out.append(now)
    return out


def fit_text(text: str, width: float, height: float, size: float, least: float = LEGIBLE) -> tuple[float, list[str]]:
    """(size, lines): the largest size in half points that fits the box, not below
    ``least``; where none does, FLOOR, so that nothing is lost."""
    while True:
        lines = _wrapped(text, width, size)
        if len(lines) * LEADING * size <= height and all(len(x) * EM * size <= width for x in lines):
            return size, lines
        if size <= least:
            return FLOOR, _wrapped(text, width, FLOOR)
        size = max(least, size - STEP)


def _placed(text: str, x1: float, y1: float, x2: float, y2: float, size: float, align: str | None, bold: bool, least: float = LEGIBLE) -> list[tuple]:
    size, lines = fit_text(text, x2 - x1, y2 - y1, size, least)
    out = []
    for i, line in enumerate(lines):
        free = max(0.0, x2 - x1 - len(line) * EM * size)
        shift = free / 2 if align == "CENTER" else free if align == "RIGHT" else 0.0
        out.append(("text", x1 + shift, y1 + (i + 0.8) * LEADING * size, size, line, bold))
    return out


def table_items(cells: list[dict], place) -> list[tuple]:
    """A table's borders, and its texts at a size that fits each cell."""
    out = []
    for c in cells:
        x1, y1, x2, y2 = place(c)
        out.append(("box", x1, y1, x2, y2, 0.6))
        if not (c["text"] or "").strip():
            continue
        pad = min(2.0, max(0.0, (y2 - y1) * 0.15))
        a, b, d, e = (x1 + pad, y1 + pad, x2 - pad, y2 - pad) if x2 - x1 > 2 * pad and y2 - y1 > 2 * pad else (x1, y1, x2, y2)
        out += _placed(c["text"], a, b, d, e, min(9.0, max(3.0, (e - b) * 0.85)), c.get("align_h"), False, FLOOR)
    return out


def reconstructed_pdf(pages: list[tuple[float, float, pd.DataFrame]], dpi: int, place=None) -> tuple[bytes, list[str]]:
    """(file, errors) of pages (width, height in pixels, blocks): every block at its place
    as text, table, rule or picture.  ``place`` maps a box in pixels to points on the
    page (the page's own scale by default).  A block that fails is an error, not the end."""
    pdf, errors, k = Pdf(), [], 72.0 / dpi
    place = place or (lambda b: (b["x1"] * k, b["y1"] * k, b["x2"] * k, b["y2"] * k))
    for n, (width, height, blocks) in enumerate(pages):
        items: list[tuple] = []
        for b in blocks.to_dict("records"):
            try:
                kind = b["block_type"]
                x1, y1, x2, y2 = place(b)
                if kind == "TABLE" and isinstance(b.get("cells"), list):
                    items += table_items(b["cells"], place)
                elif kind == "HLINE":
                    items.append(("line", x1, (y1 + y2) / 2, x2, (y1 + y2) / 2, 0.75))
                elif kind == "VLINE":
                    items.append(("line", (x1 + x2) / 2, y1, (x1 + x2) / 2, y2, 0.75))
                elif kind in GRAPHICS:
                    if isinstance(b.get("image"), bytes):
                        items.append(("image", decode_png(b["image"]), x1, y1, x2, y2))
                elif b["text"].strip():
                    size = b.get("font_size")
                    size = float(size) if size and size == size else DEFAULT_FONTS.get(kind, 10.0)
                    items += _placed(b["text"], x1, y1, x2, y2, size, b.get("alignment"), kind in ("TITLE", "HEADING"))
            except Exception as e:  # noqa: BLE001  one bad block must not lose the page
                errors.append(f"page {n}, {b.get('block_type')}: {type(e).__name__}: {e}")
        pdf.drawing(width * k, height * k, items)
    return pdf.save(), errors


# The columns of the register's sheets.
REGISTER = ["Date", "Accession Number", "Title / Book Name", "Organisation / Author Name", "Language", "Year of Publication", "Total Pages of Book", "Type"]
DOCUMENTS = ["Document ID", "Filename", "Upload Date", "Pages", "Status", "Error", "Document Hash"]


def register_workbook(records: pd.DataFrame, documents: pd.DataFrame | None = None) -> bytes:
    """The register of a corpus: all records, a sheet for each month in order, the
    documents, and a summary.  A workbook holds what one sheet can; larger registers
    are tables."""

    def sheet(rows: pd.DataFrame) -> list[list]:
        fields = ["accession_number", "book_name", "creator", "language", "year_of_publication", "total_pages", "record_type"]
        return [REGISTER, *([f"{r['record_date']:%d-%m-%Y}", *[None if pd.isna(r[f]) else r[f] for f in fields]] for r in rows.to_dict("records"))]

    records = records.assign(_month=pd.to_datetime(records.record_date).dt.to_period("M"))
    sheets = {"Common": sheet(records)}
    for month, rows in records.groupby("_month", sort=True):
        sheets[f"{month.strftime('%B %Y')}"[:31]] = sheet(rows)
    if documents is not None:
        sheets["Document Register"] = [DOCUMENTS, *([d["id"], d["original_filename"], f"{d['created_at']:%d-%m-%Y %H:%M}" if not pd.isna(d["created_at"]) else None, d["page_count"], d["status"], d["error_message"], d["document_hash"]] for d in documents.to_dict("records"))]
    status = documents.status if documents is not None else pd.Series([], dtype=str)
    summary = [["Master Register Summary", None], [None, None], ["Total PDFs processed", len(status)], ["Successful documents", int((status == "COMPLETED").sum())], ["Failed documents", int((status == "FAILED").sum())], ["Total records extracted", len(records)], ["Records needing review", int(records.needs_review.fillna(False).sum())], [None, None], ["Records by year", None]]
    summary += [[int(y), int(n)] for y, n in records.groupby(records["_month"].dt.year).size().items()]
    summary += [[None, None], ["Records by month", None], *[[m.strftime("%B %Y"), int(n)] for m, n in records.groupby("_month").size().items()]]
    return workbook(sheets | {"Summary": summary})


def write_exports(blocks: DataFrame, words: DataFrame, pages: DataFrame, dpi: int = 150) -> DataFrame:
    """(doc_id, export_type, content, size, error) of each document: its text
    document and its PDF.  A document's own rows meet in one task; an export that
    fails is a row with its error and leaves the others."""
    ship(blocks.sparkSession)
    b = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "z_order", "block_type", "text"))).alias("blocks"))
    w = words.join(pages.select("doc_id", "page", "page_width", "page_height"), ["doc_id", "page"])
    w = w.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "page_width", "page_height", "li", "wi", "text", "x1", "y1", "x2", "y2"))).alias("words"))

    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, bl, wo in zip(pdf.doc_id, pdf.blocks, pdf.words, strict=True):
                frame = pd.DataFrame([dict(x) for x in wo])
                makers = {
                    "DOCX": lambda bl=bl: text_document(pd.DataFrame([dict(x) for x in bl])),
                    "PDF": lambda f=frame: searchable_pdf([(float(g.page_width.iloc[0]), float(g.page_height.iloc[0]), None, g) for _, g in f.groupby("page")], dpi, visible=True),
                }
                for kind, make in makers.items():
                    try:
                        data, error = make(), None
                    except Exception as e:  # noqa: BLE001  kept as a row
                        data, error = None, f"{type(e).__name__}: {e}"
                    out.append((doc_id, kind, data, len(data) if data else 0, error))
            yield pd.DataFrame(out, columns=["doc_id", "export_type", "content", "size", "error"])

    return b.join(w, "doc_id").mapInPandas(run, "doc_id long, export_type string, content binary, size long, error string")


def write_register(rows: DataFrame, path: str, most_rows: int = 1_000_000) -> int:
    """The register as a workbook at path, put in place by a rename so that readers
    see the old or the new one.  A sheet holds ``most_rows`` at most; more is an error."""
    import os

    n = rows.count()
    if n > most_rows:
        raise ValueError(f"{n} rows do not fit a sheet")
    found = [list(r) for r in rows.toLocalIterator()]
    temporary = f"{path}.tmp"
    with open(temporary, "wb") as f:
        f.write(workbook({"Register": [rows.columns, *found]}))
    os.replace(temporary, path)
    return n
