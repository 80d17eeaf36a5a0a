"""Named extension points: readers, tokenizers, detectors, extractors, hooks, processors."""

from __future__ import annotations

import logging
from collections.abc import Callable
from importlib import import_module
from typing import Generic, TypeVar

from pyspark.sql import DataFrame

T = TypeVar("T")
log = logging.getLogger(__name__)


class Registry(Generic[T]):
    """Names to objects; a later registration of a name replaces the earlier one.

    What comes with the package is named by module and attribute and imported when it is first asked for.
    """

    def __init__(self, what: str, **built_in: str):
        self.what, self.items = what, dict(built_in)
        self.built_in = set(built_in.values())

    def register(self, name: str, item: T) -> T:
        self.items[name] = item
        return item

    def get(self, name: str) -> T:
        if name not in self.items:
            raise KeyError(f"unknown {self.what}: {name}; expected one of: {', '.join(self.names())}")
        found = self.items[name]
        if isinstance(found, str) and found in self.built_in:
            module, attribute = found.rsplit(".", 1)
            found = getattr(import_module(module), attribute)
        return found

    def names(self) -> list[str]:
        return sorted(self.items)


Transform = Callable[[DataFrame], DataFrame]


class Rejected(ValueError):
    """A hook refuses the input; this is not swallowed."""


class Hooks:
    """An ordered chain of named table transforms; a failing hook is skipped unless it rejects."""

    def __init__(self) -> None:
        self.chain: list[tuple[str, Transform]] = []

    def register(self, name: str, hook: Transform) -> None:
        self.chain = [(n, h) for n, h in self.chain if n != name] + [(name, hook)]

    def run(self, df: DataFrame) -> DataFrame:
        for name, hook in self.chain:
            try:
                df = hook(df)
            except Rejected:
                raise
            except Exception:
                log.warning("hook %s failed and was skipped", name, exc_info=True)
        return df


sentence_splitters: Registry = Registry("sentence splitter", heuristic="docloom.operators.boundaries.BUILT_IN")
language_detectors: Registry = Registry("language detector", stop_words="docloom.functions.columns.language")
metadata_extractors: Registry = Registry("metadata extractor")
table_extractors: Registry = Registry("table extractor", csv="docloom.operators.tables.csv_table")
processors: Registry = Registry("processor")
before_ingest, after_ingest = Hooks(), Hooks()


def sentence_splitter(name="auto"):
    """The sentence engine of this name, or the engine itself (``docloom.operators.boundaries.Engine``).

    "auto" is the engine registered as "trained" where there is one, else the heuristic. An unknown name is an error.
    """
    if not isinstance(name, str):
        return name
    if name != "auto":
        return sentence_splitters.get(name)
    return sentence_splitters.get("trained" if "trained" in sentence_splitters.names() else "heuristic")


def language_detector(name: str = "stop_words") -> Callable:
    """The language detector of this name: a function from a text column to struct(language, confidence)."""
    return language_detectors.get(name)
