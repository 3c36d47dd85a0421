"""Grids of HTML tables: a table function over the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.session import ship

FIELDS = "table_no int, row int, column int, rowspan int, colspan int, text string"


class _Tables(HTMLParser):
    """Places each cell at the first column of its row that no span fills."""

    def __init__(self):
        super().__init__()
        self.open: list[dict] = []
        self.found: list[tuple] = []
        self.count = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"no": self.count, "row": -1, "filled": set(), "cell": None})
            self.count += 1
        elif self.open and tag == "tr":
            self._close()
            self.open[-1]["row"] += 1
        elif self.open and tag in ("td", "th"):
            self._close()
            self.open[-1]["cell"] = (dict(attrs), [])

    def handle_data(self, data):
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][1].append(data)

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.open.pop()

    def _close(self):
        t = self.open[-1]
        if not t["cell"]:
            return
        attrs, text = t["cell"]
        t["cell"], row = None, max(t["row"], 0)
        down, across = (max(1, min(1000, int(v))) if (v := attrs.get(k) or "1").isdigit() else 1 for k in ("rowspan", "colspan"))
        column = 0
        while (row, column) in t["filled"]:
            column += 1
        t["filled"].update((r, c) for r in range(row, row + down) for c in range(column, column + across))
        self.found.append((t["no"], row, column, down, across, " ".join("".join(text).split())))


def grid(html: str | None) -> list[tuple]:
    p = _Tables()
    p.feed(html or "")
    p.close()
    while p.open:
        p._close()
        p.open.pop()
    return p.found


def table_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each cell of each table in ``html``, beside the other columns.  Null or plain text: no rows."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            cells = [grid(x) if isinstance(x, str) and "<t" in x.lower() else [] for x in pdf.pop("_html")]
            at = [i for i, c in enumerate(cells) for _ in c]
            flat = pd.DataFrame([c for x in cells for c in x], columns=["table_no", "row", "column", "rowspan", "colspan", "text"])
            yield pd.concat([pdf.iloc[at].reset_index(drop=True), flat], axis=1)

    ship(pages.sparkSession)
    keep = [c for c in pages.columns if c != html]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema.fields)
    return pages.select(*keep, F.col(html).alias("_html")).mapInPandas(run, fields + FIELDS)


class HtmlCells:
    """The cells of the tables of a page, as a table function.

    Lateral: SELECT ... FROM pages, LATERAL html_cells(html).  By partitions:
    SELECT * FROM html_cells(TABLE(SELECT page_id, html FROM pages) PARTITION BY page_id), where
    table_no goes on from one row of a partition to the next, as in one page sent in parts.
    Null or plain text has no cells; nested tables and ones that are never closed are found."""

    def __init__(self):
        self.tables = 0

    def eval(self, page):
        # a lateral call is a page of its own, though one instance may serve many
        part = page is not None and not isinstance(page, str)
        html = page["html"] if part else page
        found = grid(html) if html and "<t" in html.lower() else []
        for table_no, *rest in found:
            yield (self.tables + table_no, *rest)
        self.tables += part * (max((c[0] for c in found), default=-1) + 1)


def register_functions(spark: SparkSession) -> None:
    """Makes html_cells(page), and org_fuzzy(text) of the cover reader, callable from SQL."""
    from leafwork.operators.covers import org_fuzzy

    ship(spark)
    spark.udtf.register("html_cells", F.udtf(HtmlCells, returnType=FIELDS))
    spark.udf.register("org_fuzzy", org_fuzzy)
