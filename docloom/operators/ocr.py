"""Text of page images through engines that the caller gives: selection, retries, page rows."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)
PAGES = "source string, page_no int, text string, confidence double"
#: A page gives its text, or its text and a confidence.
Read = Callable[[bytes], "str | tuple[str, float | None]"]


@dataclass(frozen=True)
class Engine:
    """``read`` turns one page image into text. With ``until_empty`` a document ends at its first page without text."""

    name: str
    kinds: frozenset[str]
    read: Read
    until_empty: bool = False
    tries: int = 1
    page_limit: int | None = None


def vision(describe: Callable[[bytes], str], page_limit: int | None = 5) -> Engine:
    """A vision model: one retry a page, ends at the first empty page."""
    return Engine("vision", frozenset({"scanned_pdf", "image", "handwritten"}), describe, True, 2, page_limit)


class NoEngine(LookupError):
    """No registered engine reads this kind."""


class OcrService:
    """Engines in the order of registration; the first that reads a kind is chosen."""

    def __init__(self, *engines: Engine):
        self.engines = list(engines)

    def register(self, engine: Engine) -> None:
        self.engines.append(engine)

    def select(self, kind: str, engine: str = "auto") -> Engine:
        for e in self.engines:
            if kind in e.kinds and engine in ("auto", e.name):
                return e
        raise NoEngine(f"no engine {engine} for {kind}")

    def read(self, pages: DataFrame, kind: str, engine: str = "auto") -> DataFrame:
        return read_pages(pages, self.select(kind, engine))


def _page(engine: Engine, image: bytes) -> tuple[str, float | None]:
    for attempt in range(engine.tries):
        try:
            found = engine.read(image)
            return found if isinstance(found, tuple) else (found, None)
        except Exception:
            log.warning("page failed, attempt %d of %d", attempt + 1, engine.tries, exc_info=True)
    return "", None


def read_pages(pages: DataFrame, engine: Engine) -> DataFrame:
    """(source, page_no, text, confidence) of page images (source, page_no, image).

    A page that fails on every attempt is empty and ends nothing but what an empty page
    ends. Engines that end at an empty page need a document's pages in order: those are
    grouped by source. Others read page by page without a shuffle.
    """
    chosen = pages.select("source", "page_no", "image")
    if engine.page_limit is not None:
        chosen = chosen.where(chosen.page_no < engine.page_limit)

    def rows(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for f in b.sort_values("page_no").itertuples():
            text, confidence = _page(engine, bytes(f.image) if f.image is not None else b"")
            out.append((f.source, f.page_no, text, confidence))
            if engine.until_empty and not text.strip():
                break
        return pd.DataFrame(out, columns=["source", "page_no", "text", "confidence"]).astype({"confidence": "float64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield rows(b)

    return chosen.groupBy("source").applyInPandas(rows, PAGES) if engine.until_empty else chosen.mapInPandas(run, PAGES)


def transcribe(files: DataFrame, hear: Callable[[bytes], list[str]]) -> DataFrame:
    """(source, text) of audio files (source, content): the segments joined by blanks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"source": b["source"], "text": [" ".join(hear(bytes(c))).strip() if c is not None else "" for c in b["content"]]})

    return files.select("source", "content").mapInPandas(run, "source string, text string")
