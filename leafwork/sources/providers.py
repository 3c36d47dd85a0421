"""Recognition engines as plug-ins: a registry, a chain of fallbacks and one map over pages.

A provider is a class with available() and recognize(image, page, dpi), which
returns dicts of text, x1, y1, x2, y2 and confidence.  Engines need libraries or
services that may be missing; available() says so."""

from __future__ import annotations

import base64
import importlib.util
import json
import os
import re
import shutil
import urllib.request
from abc import ABC, abstractmethod
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from leafwork.operators.folds import merged_places
from leafwork.session import ship
from leafwork.sources.images import encode_png

WORD_FIELDS = "doc_id long, page int, block_id string, line_id string, wi int, text string, x1 double, y1 double, x2 double, y2 double, confidence double, language string, font_size double, error string"


class Provider(ABC):
    name: str

    @abstractmethod
    def available(self) -> bool: ...

    @abstractmethod
    def recognize(self, image, page: int, dpi: int) -> list[dict]: ...


REGISTRY: dict[str, type[Provider]] = {}
#: The order of fallbacks.
FALLBACKS = ["paddleocr", "tesseract"]


def register(cls: type[Provider]) -> type[Provider]:
    REGISTRY[cls.name] = cls
    return cls


def chain(requested: str | None) -> list[str]:
    """The requested provider and the fallbacks, each once."""
    return list(dict.fromkeys([*([requested] if requested else []), *FALLBACKS]))


def choose(requested: str | None = None) -> Provider:
    """The first of the chain that is available."""
    for name in chain(requested):
        if name in REGISTRY and (p := REGISTRY[name]()).available():
            return p
    raise RuntimeError(f"none of these is available: {', '.join(chain(requested))}")


@register
class Tesseract(Provider):
    name = "tesseract"

    def available(self) -> bool:
        return importlib.util.find_spec("pytesseract") is not None and shutil.which("tesseract") is not None

    def recognize(self, image, page: int, dpi: int) -> list[dict]:
        import pytesseract

        d = pd.DataFrame(pytesseract.image_to_data(image, output_type=pytesseract.Output.DICT))
        return tesseract_words(d, dpi)


def tesseract_words(d: pd.DataFrame, dpi: int) -> list[dict]:
    """Words of a recognition table: blanks dropped, confidence in [0, 1], dense line numbers."""
    d = d[d.text.fillna("").str.strip() != ""].reset_index(drop=True)
    key = d[["block_num", "par_num", "line_num"]]
    line = (key != key.shift()).any(axis=1).cumsum() - 1
    return [
        {"text": r.text.strip(), "x1": float(r.left), "y1": float(r.top), "x2": float(r.left + r.width), "y2": float(r.top + r.height), "confidence": max(0.0, float(r.conf) / 100), "block_id": str(r.block_num), "line_id": str(n), "font_size": round(r.height / dpi * 72, 1)}
        for r, n in zip(d.itertuples(), line, strict=True)
    ]


@lru_cache(maxsize=8)
def _paddle(lang: str):
    from paddleocr import PaddleOCR

    return PaddleOCR(lang=lang)


@register
class Paddle(Provider):
    """One pass for each language, with an engine that a worker makes once; the passes'
    words are merged and numbered in reading order."""

    name = "paddleocr"

    def __init__(self, languages: tuple[str, ...] = ("hi", "en"), engine=_paddle):
        self.languages, self.engine = languages, engine

    def available(self) -> bool:
        return importlib.util.find_spec("paddleocr") is not None

    def recognize(self, image, page: int, dpi: int) -> list[dict]:
        passes = [[w for row in self.engine(lang).ocr(image)[0] or [] if (w := polygon_word(row, dpi))] for lang in self.languages]
        words: list[dict] = []
        for found in passes:
            words = merge_words(words, found)
        words.sort(key=lambda w: (round(w["y1"] / 10), w["x1"]))
        return [w | {"line_id": str(i)} for i, w in enumerate(words)]


def merge_words(first: list[dict], second: list[dict], share: float = 0.5) -> list[dict]:
    """Words of two passes over one page: of two that meet, the surer one."""
    both = [*first, *second]
    if not first or not second:
        return both
    x1, y1, x2, y2, sure = (np.array([w[c] for w in both], float) for c in ("x1", "y1", "x2", "y2", "confidence"))
    return [both[i] for i in merged_places(x1, y1, x2, y2, sure, len(first), share)]


# ---------------------------------------------------------- models behind a URL
PROMPT = (
    "Transcribe all text of this scanned page exactly as it stands, in Hindi and English, with all numbers and tables. "
    'Answer with a JSON array only, one element for each line in reading order: {"text": "...", "bbox": [x1, y1, x2, y2]}, with coordinates as shares of the width and height.'
)


def post_json(url: str, payload: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def json_array(text: str) -> list[dict]:
    """A JSON array; where the text is not one, the one inside it; else empty."""
    found = re.search(r"\[.*\]", text, re.DOTALL)
    for part in (text, found[0] if found else ""):
        try:
            out = json.loads(part)
        except ValueError:
            continue
        return [x for x in out if isinstance(x, dict)] if isinstance(out, list) else []
    return []


def region_words(text: str, width: int, height: int, sure: float, dpi: int) -> list[dict]:
    """Words of a model's answer: boxes in pixels, one line each, a fixed confidence; odd elements are dropped."""
    out = []
    for i, r in enumerate(json_array(text)):
        said, box = str(r.get("text", "")).strip(), r.get("bbox")
        if not said or not isinstance(box, list) or len(box) != 4:
            continue
        x1, y1, x2, y2 = (float(v) for v in box)
        out.append({"text": said, "x1": x1 * width, "y1": y1 * height, "x2": x2 * width, "y2": y2 * height, "confidence": sure, "block_id": str(i), "line_id": str(i), "font_size": round((y2 - y1) * height / dpi * 72, 1)})
    return out


class Remote(Provider):
    """A model that reads a page over HTTP; its confidence is no probability, so it is fixed."""

    sure, timeout = 0.7, 180.0

    def __init__(self, url: str = "", model: str = "", key: str = "", post=post_json):
        self.url, self.model, self.key, self.post = url or os.environ.get(f"LEAFWORK_{self.name.upper()}_URL", ""), model, key or os.environ.get(f"LEAFWORK_{self.name.upper()}_KEY", ""), post

    def payload(self, image: str) -> dict: ...

    def answer(self, reply: dict) -> str: ...

    def headers(self) -> dict:
        return {}

    def recognize(self, image, page: int, dpi: int) -> list[dict]:
        if not self.available():
            raise RuntimeError(f"{self.name} is not set up")
        data = base64.b64encode(encode_png(image)).decode()
        reply = self.post(self.url, self.payload(data), self.headers(), self.timeout)
        return region_words(self.answer(reply), image.shape[1], image.shape[0], self.sure, dpi)


@register
class Nvidia(Remote):
    name, sure, timeout = "nvidia", 0.75, 90.0

    def available(self) -> bool:
        return bool(self.url and self.key)

    def headers(self) -> dict:
        return {"Authorization": f"Bearer {self.key}"}

    def payload(self, image: str) -> dict:
        parts = [{"type": "text", "text": PROMPT}, {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{image}"}}]
        return {"model": self.model, "messages": [{"role": "user", "content": parts}], "max_tokens": 4096, "temperature": 0.0}

    def answer(self, reply: dict) -> str:
        return reply["choices"][0]["message"]["content"]


@register
class Ollama(Remote):
    name, sure = "ollama", 0.7

    def available(self) -> bool:
        if not self.url:
            return False
        try:
            with urllib.request.urlopen(self.url.rsplit("/", 1)[0] + "/tags", timeout=3.0) as answer:
                return answer.status == 200
        except OSError:
            return False

    def payload(self, image: str) -> dict:
        return {"model": self.model, "messages": [{"role": "user", "content": PROMPT, "images": [image]}], "stream": False, "options": {"temperature": 0.0}}

    def answer(self, reply: dict) -> str:
        return reply.get("message", {}).get("content", "")


def polygon_word(row, dpi: int) -> dict | None:
    """A word of (polygon, (text, confidence)); None for blanks and odd shapes."""
    try:
        polygon, (text, sure) = row[0], row[1]
        xs, ys = [float(p[0]) for p in polygon], [float(p[1]) for p in polygon]
    except (TypeError, ValueError, IndexError):
        return None
    if not text or not text.strip():
        return None
    return {"text": text.strip(), "x1": min(xs), "y1": min(ys), "x2": max(xs), "y2": max(ys), "confidence": float(sure), "font_size": round((max(ys) - min(ys)) / dpi * 72, 1)}


def script(text: str) -> str:
    deva, latin = re.search("[ऀ-ॿ]", text), re.search("[A-Za-z]", text)
    return "hi-en" if deva and latin else "hi" if deva else "en" if latin else "num" if re.search("[0-9०-९]", text) else "und"


def recognize_pages(pages: DataFrame, provider: type[Provider], decode, dpi: int = 300) -> DataFrame:
    """Words of pages (doc_id, page, image): one engine for each Python worker; a
    page that fails gives one row with its error, so that a retry finds it."""

    def run(batches):
        engine = provider()
        for pdf in batches:
            out = []
            for doc_id, page, image in zip(pdf.doc_id, pdf.page, pdf.image, strict=True):
                try:
                    words = engine.recognize(decode(image), page, dpi)
                    words = sorted(words, key=lambda w: (round(w["y1"] / 10), w["x1"]))
                    out += [{"doc_id": doc_id, "page": page, "wi": i, "language": script(w["text"]), **w} for i, w in enumerate(words)]
                except Exception as e:  # noqa: BLE001  kept as a row
                    out.append({"doc_id": doc_id, "page": page, "error": f"{type(e).__name__}: {e}"})
            names = [f.split()[0] for f in WORD_FIELDS.split(", ")]
            table = pd.DataFrame(out).reindex(columns=names)
            yield table.astype(object).where(table.notna(), None)

    ship(pages.sparkSession)
    return pages.select("doc_id", "page", "image").mapInPandas(run, WORD_FIELDS)


def merge_passes(first: DataFrame, second: DataFrame, share: float = 0.5) -> DataFrame:
    """Words of two recognition passes, see overlap_merge."""
    from leafwork.operators.folds import overlap_merge

    return overlap_merge(first, second, "wi", share)


def retry_sweep(pages: DataFrame, words: DataFrame, provider: type[Provider], decode, dpi: int = 300) -> DataFrame:
    """The words with those of a second try of pages that failed or are missing; a page
    that fails again keeps its error."""
    good = words.where("error is null")
    todo = pages.join(good.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return good.unionByName(recognize_pages(todo, provider, decode, dpi))


def failed_documents(words: DataFrame) -> DataFrame:
    """(doc_id, error): documents with a page that failed, and the first page's error."""
    from pyspark.sql import functions as F

    return words.where("error is not null").groupBy("doc_id").agg(F.min_by("error", "page").alias("error"))
