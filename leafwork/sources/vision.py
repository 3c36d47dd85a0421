"""Cleaning of page images with numpy alone, and the profiles that combine it.

Grey images are (H, W) uint8, 0 is ink.  clean_pages() maps a profile over a
PNG column; a page that cannot be decoded keeps its image and gets an error."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.session import ship
from leafwork.sources.images import adaptive_threshold, box_mean, components, crop_dark_borders, decode_png, encode_png, otsu, rotation_score, runs_mask, to_gray

# Sizes in millimetres, angles in degrees.
SPECKLE_MM, ALONE_MM, SPECKLE_ASPECT = 0.9, 5.0, 2.2
MOST_SKEW, LEAST_INK = 20.0, 50


def sample(gray: np.ndarray, x: np.ndarray, y: np.ndarray, outside: int = 255) -> np.ndarray:
    """Pixels at fractional places, from their four neighbours."""
    h, w = gray.shape
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    inside = (x > -1) & (y > -1) & (x < w) & (y < h)

    def at(i, j):
        return gray[np.clip(j, 0, h - 1), np.clip(i, 0, w - 1)].astype(float)

    v = (at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx) * (1 - fy) + (at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx) * fy
    return np.where(inside, np.rint(v), outside).astype(np.uint8)


def rotate(gray: np.ndarray, degrees: float) -> np.ndarray:
    """Turned anticlockwise on a canvas that holds all of it."""
    if degrees % 90 == 0:
        return np.rot90(gray, int(degrees // 90) % 4).copy()
    a = math.radians(degrees)
    h, w = gray.shape
    c, s = math.cos(a), math.sin(a)
    nw, nh = math.ceil(w * abs(c) + h * abs(s)), math.ceil(w * abs(s) + h * abs(c))
    x, y = np.meshgrid(np.arange(nw) - (nw - 1) / 2, np.arange(nh) - (nh - 1) / 2)
    return sample(gray, c * x - s * y + (w - 1) / 2, s * x + c * y + (h - 1) / 2)


def skew_angle(gray: np.ndarray, most: float = 5.0, step: float = 0.25) -> float:
    """The turn that makes lines of text level: that with the largest variance of row
    sums, from ink points without turning the image; 0 with hardly any ink."""
    ys, xs = np.nonzero(gray <= otsu(gray))
    if len(xs) < LEAST_INK or gray.max() - gray.min() < 10:
        return 0.0
    if len(xs) > 50_000:
        every = len(xs) // 50_000 + 1
        xs, ys = xs[::every], ys[::every]
    best, found = -1.0, 0.0
    for d in sorted(np.arange(-most, most + step / 2, step), key=abs):
        a = math.radians(d)
        rows = np.rint(ys * math.cos(a) - xs * math.sin(a)).astype(int)
        n = np.bincount(rows - rows.min())
        score = float((n.astype(float) ** 2).sum())
        if score > best * 1.0001:
            best, found = score, float(d)
    return found


def deskew(gray: np.ndarray) -> tuple[np.ndarray, float]:
    angle = skew_angle(gray)
    return (rotate(gray, angle), angle) if 0 < abs(angle) <= MOST_SKEW else (gray, 0.0)


def coarse_rotation(gray: np.ndarray, margin: float = 1.15) -> int:
    """0 or 90: whether the lines of text stand upright, by a clear margin."""
    ink = gray <= otsu(gray)
    level, upright = rotation_score(ink) / max(1, ink.shape[1]) ** 2, rotation_score(ink.T) / max(1, ink.shape[0]) ** 2
    return 90 if upright > margin * level else 0


def denoise(gray: np.ndarray) -> np.ndarray:
    """The median of each pixel's 3 x 3 square."""
    p = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    return np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def flatten_background(gray: np.ndarray, size: int = 101) -> np.ndarray:
    """Divided by its blurred light parts, so that paper becomes white."""
    light = np.where(gray > otsu(gray), gray, np.median(gray[gray > otsu(gray)]) if (gray > otsu(gray)).any() else 255)
    return np.clip(gray / np.maximum(box_mean(light, size), 1) * 255, 0, 255).astype(np.uint8)


def enhance_contrast(gray: np.ndarray, clip: float = 2.5, tiles: int = 8) -> np.ndarray:
    """Equalised by tiles with a limit on slopes; each pixel blends the four nearest tiles' curves."""
    h, w = gray.shape
    tiles_y, tiles_x = min(tiles, h), min(tiles, w)
    ys, xs = np.linspace(0, h, tiles_y + 1).astype(int), np.linspace(0, w, tiles_x + 1).astype(int)
    curves = np.zeros((tiles_y, tiles_x, 256))
    for i in range(tiles_y):
        for j in range(tiles_x):
            part = gray[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = clip * part.size / 256
            n = np.minimum(n, limit) + np.maximum(n - limit, 0).sum() / 256
            curves[i, j] = n.cumsum() / n.sum() * 255
    fy = np.clip((np.arange(h) + 0.5) * tiles_y / h - 0.5, 0, tiles_y - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles_x / w - 0.5, 0, tiles_x - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles_y - 1), np.minimum(x0 + 1, tiles_x - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda a, b: curves[a[:, None], b[None, :], gray]
    return np.rint((at(y0, x0) * (1 - wx) + at(y0, x1) * wx) * (1 - wy) + (at(y1, x0) * (1 - wx) + at(y1, x1) * wx) * wy).astype(np.uint8)


def remove_speckles(gray: np.ndarray, dpi: int) -> np.ndarray:
    """Without small round marks that stand alone."""
    mm = dpi / 25.4
    boxes = np.array(components(gray <= otsu(gray)), int).reshape(-1, 5)
    out = gray.copy()
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    small = (np.maximum(w, h) <= SPECKLE_MM * mm) & (np.maximum(w, h) <= SPECKLE_ASPECT * np.minimum(w, h))
    for k in np.flatnonzero(small):
        x1, y1, x2, y2 = boxes[k, :4]
        gap = np.maximum(np.maximum(boxes[:, 0] - x2, x1 - boxes[:, 2]), np.maximum(boxes[:, 1] - y2, y1 - boxes[:, 3]))
        gap[k] = 1 << 30
        if gap.min(initial=1 << 30) > ALONE_MM * mm:
            out[y1:y2, x1:x2] = 255
    return out


def page_corners(gray: np.ndarray, least: float = 0.3) -> np.ndarray | None:
    """The corners of the bright page on a dark ground, clockwise from top left; None if it is too small."""
    ys, xs = np.nonzero(gray > otsu(gray))
    if len(xs) < least * gray.size:
        return None
    s, d = xs + ys, xs - ys
    return np.array([(xs[k], ys[k]) for k in (s.argmin(), d.argmax(), s.argmax(), d.argmin())], float)


def straighten(gray: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The four-cornered page as a rectangle of its mean sides."""
    side = lambda a, b: np.linalg.norm(corners[a] - corners[b])
    w, h = int(round((side(0, 1) + side(3, 2)) / 2)) + 1, int(round((side(0, 3) + side(1, 2)) / 2)) + 1
    target = [(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)]
    rows, right = [], []
    for (u, v), (x, y) in zip(target, corners, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v]]
        right += [x, y]
    m = np.append(np.linalg.solve(np.array(rows, float), np.array(right)), 1).reshape(3, 3)
    u, v = np.meshgrid(np.arange(w), np.arange(h))
    x, y, z = (m[k, 0] * u + m[k, 1] * v + m[k, 2] for k in range(3))
    return sample(gray, x / z, y / z)


def ruling_lines(gray: np.ndarray, share: int = 30, thick: int = 12) -> list[tuple[str, int, int, int, int]]:
    """(orientation, x1, y1, x2, y2) of long thin dark runs."""
    ink = gray <= otsu(gray)
    h, w = gray.shape
    level = [("horizontal", *c[:4]) for c in components(runs_mask(ink, max(2, w // share), 1)) if c[3] - c[1] <= thick]
    upright = [("vertical", *c[:4]) for c in components(runs_mask(ink, max(2, h // share), 0)) if c[2] - c[0] <= thick]
    return level + upright


def clean(gray: np.ndarray, profile: str = "BALANCED", dpi: int = 300) -> np.ndarray:
    """FAST: denoise, speckles.  BALANCED: borders, denoise, background, contrast,
    speckles, threshold.  HIGH_QUALITY: the page's outline too, and no threshold."""
    if profile == "FAST":
        return remove_speckles(denoise(gray), dpi)
    if profile == "HIGH_QUALITY":
        corners = page_corners(gray)
        gray = straighten(gray, corners) if corners is not None else gray
    elif profile != "BALANCED":
        raise ValueError(f"unknown profile {profile}")
    gray = deskew(crop_dark_borders(gray))[0]
    gray = remove_speckles(enhance_contrast(flatten_background(denoise(gray))), dpi)
    return gray if profile == "HIGH_QUALITY" else adaptive_threshold(gray)


def clean_pages(pages: DataFrame, image: str = "image", profile: str = "BALANCED", dpi: int = 300) -> DataFrame:
    """Adds cleaned (PNG) and error to pages."""
    ship(pages.sparkSession)

    def run(batches):
        for pdf in batches:
            cleaned, errors = [], []
            for data in pdf[image]:
                try:
                    cleaned.append(encode_png(clean(to_gray(decode_png(data)), profile, dpi)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  kept as a row
                    cleaned.append(data)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(cleaned=cleaned, error=pd.Series(errors, index=pdf.index, dtype=object))

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema.fields)
    return pages.select(*[F.col(f"`{c}`") for c in pages.columns]).mapInPandas(run, fields + "cleaned binary, error string")
