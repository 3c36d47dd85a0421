"""Page images: a PNG codec without libraries, and kernels on grey pixels.

Pages are BINARY columns; kernels decode, work with numpy and encode inside one
Arrow batch, so pixels never become rows."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from leafwork.session import ship


def encode_png(pixels: np.ndarray) -> bytes:
    """8-bit grey (H, W) or colour (H, W, 3)."""
    p = np.ascontiguousarray(pixels, np.uint8)
    h, w = p.shape[:2]
    kind = 0 if p.ndim == 2 else 2
    raw = np.concatenate((np.zeros((h, 1), np.uint8), p.reshape(h, -1)), axis=1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """8-bit grey, colour or either with alpha (dropped), not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", part) if name == b"IHDR" else head
        body += [part] if name == b"IDAT" else []
        at += size + 12
    w, h, depth, kind, _, _, lace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if depth != 8 or channels is None or lace:
        raise ValueError("an unsupported kind of PNG")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    out, above = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.int32)
    for y in range(h):
        line, how = rows[y, 1:].astype(np.int32), rows[y, 0]
        if how == 2:
            line = (line + above) & 255
        elif how:
            for x in range(len(line)):
                a, c = (line[x - channels], above[x - channels]) if x >= channels else (0, 0)
                b = above[x]
                if how == 1:
                    guess = a
                elif how == 3:
                    guess = (a + b) // 2
                else:
                    d = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
                    guess = (a, b, c)[d.index(min(d))]
                line[x] = (line[x] + guess) & 255
        out[y], above = line, line
    image = out.reshape(h, w, channels)
    return image[:, :, 0] if channels < 3 else image[:, :, :3]


def to_gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.rint(image @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def box_mean(gray: np.ndarray, size: int) -> np.ndarray:
    """The mean of the square around each pixel, by a summed-area table; edges repeat."""
    r = size // 2
    p = np.pad(gray.astype(np.float64), r, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * r + 1
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def adaptive_threshold(gray: np.ndarray, block: int = 35, c: int = 15) -> np.ndarray:
    return np.where(gray > box_mean(gray, block) - c, 255, 0).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """The threshold that parts the histogram with the largest variance between the parts."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    low, mean = n.cumsum(), (n * np.arange(256)).cumsum()
    high = low[-1] - low
    with np.errstate(all="ignore"):
        spread = low * high * (mean / low - (mean[-1] - mean) / high) ** 2
    return int(np.nanargmax(np.where(np.isfinite(spread), spread, -1)))


def crop_dark_borders(gray: np.ndarray, dark: int = 40, margin: int = 2, least: float = 0.5) -> np.ndarray:
    """Without dark edges, unless too little would be left."""
    light = gray > dark
    ys, xs = np.flatnonzero(light.any(1)), np.flatnonzero(light.any(0))
    if not len(ys):
        return gray
    y1, y2, x1, x2 = max(0, ys[0] - margin), ys[-1] + 1 + margin, max(0, xs[0] - margin), xs[-1] + 1 + margin
    cut = gray[y1:y2, x1:x2]
    return cut if cut.size >= least * gray.size else gray


def projection_boundaries(mask: np.ndarray, axis: int, gap: int = 8, share: float = 0.4) -> list[int]:
    """Centres of lines of a mask: where its row or column sums reach a share of the largest."""
    profile = mask.astype(np.int64).sum(axis=axis)
    at = np.flatnonzero(profile > max(profile.max(initial=0) * share, 1))
    if not len(at):
        return []
    return [int(round(float(c.mean()))) for c in np.split(at, np.flatnonzero(np.diff(at) > gap) + 1)]


def runs_mask(ink: np.ndarray, least: int, axis: int) -> np.ndarray:
    """Ink that belongs to straight runs of at least ``least`` pixels along an axis."""
    m = ink if axis == 1 else ink.T
    edge = np.diff(np.pad(m.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    out = np.zeros_like(m)
    for r, a, b in zip(row, start, stop, strict=True):
        if b - a >= least:
            out[r, a:b] = True
    return out if axis == 1 else out.T


def grid_mask(gray: np.ndarray, share: int = 30) -> np.ndarray:
    """Ruling lines: dark runs longer than a thirtieth of the page along either axis."""
    ink = gray <= otsu(gray)
    h, w = gray.shape
    return runs_mask(ink, max(2, w // share), 1) | runs_mask(ink, max(2, h // share), 0)


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x1, y1, x2, y2, pixels) of each 4-connected region, by runs of rows."""
    boxes, up, before = [], [], []

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for y, row in enumerate(mask):
        d = np.diff(np.pad(row.astype(np.int8), 1))
        now = []
        for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1), strict=True):
            i = len(up)
            up.append(i)
            boxes.append([int(a), y, int(b), y + 1, int(b - a)])
            for pa, pb, j in before:
                if pa < b and a < pb:
                    p, q = sorted((find(i), find(j)))
                    up[q] = p
            now.append((a, b, i))
        before = now
    out: dict[int, list[int]] = {}
    for i, (x1, y1, x2, y2, n) in enumerate(boxes):
        o = out.setdefault(find(i), [x1, y1, x2, y2, 0])
        o[:] = [min(o[0], x1), min(o[1], y1), max(o[2], x2), max(o[3], y2), o[4] + n]
    return [tuple(o) for o in out.values()]


def rotation_score(ink: np.ndarray) -> float:
    """Variance of the row sums: large where lines of text lie level."""
    return float(np.var(ink.sum(1)))


def similarity(a: np.ndarray, b: np.ndarray, size: int = 7) -> tuple[float, float, float]:
    """(SSIM, MSE, share of places with SSIM below 0.5) of two grey images of one size."""
    x, y = a.astype(float), b.astype(float)
    n = size * size / (size * size - 1)
    mx, my = box_mean(x, size), box_mean(y, size)
    vx, vy, cov = (n * (box_mean(p * q, size) - r * s) for p, q, r, s in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ssim = (2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))
    r = size // 2
    inner = ssim[r:-r, r:-r] if min(ssim.shape) > 2 * r else ssim
    return float(inner.mean()), float(((x - y) ** 2).mean()), float((inner < 0.5).mean())


def _page_similarity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Of two PNG columns; null where one is missing or the sizes differ."""
    out = []
    for p, q in zip(a, b, strict=True):
        x, y = (to_gray(decode_png(v)) if v is not None else None for v in (p, q))
        out.append(similarity(x, y) if x is not None and y is not None and x.shape == y.shape else (None, None, None))
    return pd.DataFrame(out, columns=["ssim", "mse", "low"])


def _table_regions(png: pd.Series) -> pd.Series:
    """Boxes of ruled regions of pages: at least 15 % of the width and 3 % of the height."""
    out = []
    for data in png:
        if data is None:
            out.append([])
            continue
        g = to_gray(decode_png(data))
        h, w = g.shape
        out.append([dict(zip(("x1", "y1", "x2", "y2", "pixels"), c, strict=True)) for c in components(grid_mask(g)) if c[2] - c[0] >= 0.15 * w and c[3] - c[1] >= 0.03 * h and c[4] >= 200])
    return pd.Series(out)


def _clean_page(png: pd.Series) -> pd.Series:
    """Grey, without dark borders, thresholded against its surroundings."""
    return pd.Series([None if d is None else encode_png(adaptive_threshold(crop_dark_borders(to_gray(decode_png(d))))) for d in png])


def page_similarity(a: Column, b: Column) -> Column:
    ship(SparkSession.active())
    return F.pandas_udf(_page_similarity, "struct<ssim:double,mse:double,low:double>")(a, b)


def table_regions(png: Column) -> Column:
    ship(SparkSession.active())
    return F.pandas_udf(_table_regions, "array<struct<x1:int,y1:int,x2:int,y2:int,pixels:int>>")(png)


def clean_page(png: Column) -> Column:
    ship(SparkSession.active())
    return F.pandas_udf(_clean_page, "binary")(png)
