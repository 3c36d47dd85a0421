"""Operators whose result depends on an order of visits: greedy choices among the
boxes of one page, over whole pages in Arrow batches, and what tables with rules
need of a page's words beside its image.  Folds that need no Python are in bands.py.

Every fold sorts by a total order first, so results do not depend on how rows
arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.session import ship

PAGE = ["doc_id", "page"]
BOX = ["x1", "y1", "x2", "y2"]


def running_mean_rows(y: np.ndarray, height: np.ndarray, reach: float) -> np.ndarray:
    """Numbers of clusters of sorted positions: a position joins while it is within
    reach * its height of the mean of the cluster so far."""
    if not len(y):
        return np.zeros(0, int)
    h = np.where(height > 0, height, 1)
    # words at one height with one size share a fate: the first one decides, and the mean only comes nearer
    begin = np.flatnonzero(np.concatenate(([True], (y[1:] != y[:-1]) | (h[1:] != h[:-1]))))
    count = np.diff(np.append(begin, len(y)))
    rows, total, n, row = [], 0.0, 0, 0
    for v, size, c in zip(y[begin].tolist(), h[begin].tolist(), count.tolist(), strict=True):
        if n and abs(v - total / n) > reach * size:
            row, total, n = row + 1, 0.0, 0
        total, n = total + v * c, n + c
        rows.append(row)
    return np.repeat(rows, count)


def meetings(page: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, area) of pairs of boxes that meet on a page, first < second.  Boxes
    are swept from the left, so those are compared whose x-ranges meet; about ``most`` at a time."""
    lost = (np.empty(0, int), np.empty(0, int), np.empty(0))
    ok = np.flatnonzero(np.isfinite(x1 + y1 + x2 + y2))
    if len(ok) < 2:
        return lost
    o = ok[np.lexsort((x1[ok], page[ok]))]
    p, a, b, c, d = page[o], x1[o], x2[o], y1[o], y2[o]
    # one line of all pages, with a little room, as what is found is compared in full
    low = a.min()
    room = max(a.max(), b.max()) - low + 2
    end = np.searchsorted(p * room + (a - low), p * room + np.minimum(b - low + 1, room), "right")
    n = np.maximum(np.minimum(end, np.searchsorted(p, p, "right")) - np.arange(len(o)) - 1, 0)
    cuts = np.searchsorted(np.cumsum(n), np.arange(most, n.sum(), most))
    found = [lost]
    for s, e in zip([0, *cuts + 1], [*cuts + 1, len(o)], strict=True):
        i = np.repeat(np.arange(s, e), n[s:e])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[s:e]) - n[s:e], n[s:e])
        w, h = np.minimum(b[i], b[j]) - np.maximum(a[i], a[j]), np.minimum(d[i], d[j]) - np.maximum(c[i], c[j])
        met = (w > 0) & (h > 0)
        u, v = o[i[met]], o[j[met]]
        found.append((np.minimum(u, v), np.maximum(u, v), (w * h)[met]))
    first, second, area = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((first, second))
    return first[order], second[order], area[order]


def _pages(rows: DataFrame, order: list, choose: Callable[[dict[str, np.ndarray]], np.ndarray], need: list[str], out: list[str]) -> DataFrame:
    """The rows that ``choose`` keeps of pages, which it has whole and in order, many at a
    time: it gets arrays of the columns ``need`` and of the page's number, and returns flags."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("_n").to_numpy() == 1)
            if len(begins):
                if held or begins[-1]:
                    yield pa.Table.from_batches([*held, batch.slice(0, begins[-1])])
                held, batch = [], batch.slice(begins[-1])
            held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches):
            arrays = {c: t.column(c).to_numpy().astype(float) for c in need} | {"page": np.cumsum(t.column("_n").to_numpy() == 1)}
            yield from t.select(out).filter(pa.array(choose(arrays))).to_batches()

    ship(rows.sparkSession)
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)))
    return numbered.mapInArrow(kept, rows.select(*out).schema)


def greedy_suppression(regions: DataFrame, region: str, share: float = 0.6) -> DataFrame:
    """Regions, largest first, without those that a kept one covers by ``share`` or more."""

    def choose(r: dict[str, np.ndarray]) -> np.ndarray:
        area = np.clip(r["x2"] - r["x1"], 0, None) * np.clip(r["y2"] - r["y1"], 0, None)
        first, second, common = meetings(r["page"], *[r[c] for c in BOX])
        covered = common >= share * np.maximum(1.0, area[second])
        keep = np.ones(len(area), bool)
        for k, i in zip(first[covered].tolist(), second[covered].tolist(), strict=True):  # by the smaller one, so what is before it is settled
            if keep[k]:
                keep[i] = False
        return keep

    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return _pages(regions, [area.desc(), F.col(region)], choose, BOX, regions.columns)


def merged(page: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, sure: np.ndarray, further: np.ndarray, share: float) -> np.ndarray:
    """The places that boxes of pages have in the end, first ones and ``further`` ones, in
    order; -1 if they do not stay.  A further one that meets a kept one by ``share`` of the
    smaller box takes its place if it is surer.  Boxes that meet one other box, and it no
    third, are settled at once."""
    area = np.clip(x2 - x1, 0, None) * np.clip(y2 - y1, 0, None)
    first, second, common = meetings(page, x1, y1, x2, y2)
    hit = further[second] & (common >= share * np.minimum(area[first], area[second]))
    first, second = first[hit], second[hit]
    place = np.arange(len(x1))
    degree = np.bincount(first, minlength=len(x1)) + np.bincount(second, minlength=len(x1))
    alone = (degree[first] == 1) & (degree[second] == 1)
    k, i = first[alone], second[alone]
    surer = sure[i] > sure[k]
    place[i], place[k] = np.where(surer, k, -1), np.where(surer, -1, k)
    met: dict[int, list[int]] = {}
    for k, i in zip(first[~alone].tolist(), second[~alone].tolist(), strict=True):
        met.setdefault(i, []).append(k)
    for i, before in met.items():
        held = [k for k in before if place[k] >= 0]
        if held:
            k = min(held, key=place.__getitem__)
            place[i] = -1
            if sure[i] > sure[k]:
                place[i], place[k] = place[k], -1
    return place


def merged_places(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, sure: np.ndarray, n: int, share: float) -> np.ndarray:
    """Which boxes of one page stay, by their places; the first ``n`` are those of the first pass."""
    every = np.arange(len(x1))
    place = merged(np.zeros(len(x1), int), x1, y1, x2, y2, sure, every >= n, share)
    return np.argsort(np.where(place < 0, len(x1), place), kind="stable")[: (place >= 0).sum()]


def overlap_merge(existing: DataFrame, new: DataFrame, item: str, share: float = 0.5) -> DataFrame:
    """Detections of two passes: a new one that meets a kept one by ``share`` of the
    smaller box takes its place if it is surer, and is dropped if not; others are added."""

    def choose(r: dict[str, np.ndarray]) -> np.ndarray:
        return merged(r["page"], *[r[c] for c in BOX], r["confidence"], r["_pass"] == 1, share) >= 0

    both = existing.withColumn("_pass", F.lit(0)).unionByName(new.withColumn("_pass", F.lit(1)))
    return _pages(both, ["_pass", item], choose, [*BOX, "confidence", "_pass"], existing.columns)


def grid_cells(boundaries: DataFrame, walls: DataFrame) -> DataFrame:
    """Merged cells of ruled grids: cells of a table are joined across boundaries
    without a wall.  boundaries: (table_id, n_rows, n_columns); walls: (table_id,
    row, column, side) with side right or bottom.  Returns (table_id, row, column,
    rowspan, colspan) of each component's hull."""

    def table(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["table_id", "row", "column", "rowspan", "colspan"])
        rows, columns = int(left.n_rows.iloc[0]), int(left.n_columns.iloc[0])
        shut = set(zip(right["row"], right["column"], right["side"], strict=True))
        label = np.arange(rows * columns).reshape(rows, columns)
        changed = True
        while changed:
            before = label.copy()
            for r in range(rows):
                for c in range(columns):
                    for dr, dc, side in ((0, 1, "right"), (1, 0, "bottom")):
                        if r + dr < rows and c + dc < columns and (r, c, side) not in shut:
                            label[r, c] = label[r + dr, c + dc] = min(label[r, c], label[r + dr, c + dc])
            changed = (label != before).any()
        out = []
        for v in np.unique(label):
            rr, cc = np.nonzero(label == v)
            out.append((key[0], rr.min(), cc.min(), np.ptp(rr) + 1, np.ptp(cc) + 1))
        return pd.DataFrame(out, columns=["table_id", "row", "column", "rowspan", "colspan"])

    ship(boundaries.sparkSession)
    return boundaries.groupBy("table_id").cogroup(walls.groupBy("table_id")).applyInPandas(table, "table_id long, row int, column int, rowspan int, colspan int")


def text_row_bounds(words: pd.DataFrame, offset: float, length: int, reach: float = 0.7) -> list[int]:
    """Boundaries of rows from words alone: the outer edges and the middles of the
    gaps between clusters, from ``offset``; none if there is one cluster only."""
    mid = (words.y1 + words.y2) / 2
    w = words.assign(_mid=mid).sort_values(["_mid", "x1"], kind="stable")
    if not len(w):
        return []
    row = running_mean_rows(w._mid.to_numpy(float), (w.y2 - w.y1).to_numpy(float), reach)
    g = w.groupby(row).agg(top=("y1", "min"), bottom=("y2", "max"))
    if len(g) < 2:
        return []
    above, below = g.bottom.to_numpy(float)[:-1], g.top.to_numpy(float)[1:]
    edges = [g.top.iloc[0], *np.where(below > above, (above + below) / 2, above), g.bottom.iloc[-1]]
    return [int(round(min(max(0.0, e - offset), length))) for e in edges]


def text_column_bounds(words: pd.DataFrame, offset: float, length: int, gap: int = 8, least_rows: int = 4, share: float = 0.75) -> list[int]:
    """Boundaries of columns: left edges that recur in most rows give a column's place, their
    mean; inner boundaries are midway between places.  None with fewer than ``least_rows`` rows or two columns."""
    w = words.assign(_mid=(words.y1 + words.y2) / 2).sort_values(["_mid", "x1"], kind="stable")
    w["row"] = running_mean_rows(w._mid.to_numpy(float), (w.y2 - w.y1).to_numpy(float), 0.6)
    rows = w.row.nunique()
    if rows < least_rows:
        return []
    tolerance = max(gap, 0.03 * length)
    w = w.sort_values("x1")
    w["place"] = w.x1.groupby((w.x1.diff().fillna(0) > tolerance).cumsum()).transform("mean")
    hits = w[(w.x1 - w.place).abs() <= tolerance].groupby("place").row.nunique()
    good = hits.index[hits >= max(3, int(share * rows))].to_numpy()
    if len(good) < 2:
        return []
    edges = [good[0], *(good[:-1] + good[1:]) / 2, w.x2.max()]
    return [int(round(min(max(0.0, e - offset), length))) for e in edges]


def cluster_positions(positions: list[int], gap: float) -> list[int]:
    """Centres of chains of positions, rounded half to even."""
    p = np.sort(np.asarray(positions, float))
    return [int(round(float(c.mean()))) for c in np.split(p, np.flatnonzero(np.diff(p) > gap) + 1)] if len(p) else []


def supplement_bounds(lines: list[int], text: list[int], gap: int = 8) -> tuple[list[int], set[int]]:
    """Ruled boundaries with those of the text where the text shows more than one
    band beyond them; and which of the result no ruled line backs."""
    if max(0, len(text) - 1) <= max(0, len(lines) - 1) + 1:
        return lines, set()
    union = sorted({*lines, *text})
    steps = sorted(np.diff(union).tolist())
    reach = max(gap, int(steps[len(steps) // 2] * 0.4)) if steps else gap
    bounds = cluster_positions(union, reach)
    return bounds, {b for b in bounds if all(abs(b - x) > reach for x in lines)}
