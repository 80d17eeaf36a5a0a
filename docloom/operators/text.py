"""Column forms of the Markdown and entity functions, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from heapq import merge

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import markdown as M
from docloom.functions.tables import ENTITY_PATTERNS
from docloom.operators.boundaries import Engine
from docloom.operators.registry import sentence_splitter

CHUNK = "array<struct<chunk_index:int,text:string,start_char:int,end_char:int,metadata:map<string,string>>>"
SECTION = "array<struct<ord:int,section_id:string,title:string,level:int,parent_id:string,start_char:int,end_char:int,blocks:array<struct<block_id:string,type:string,text:string,start_char:int,end_char:int>>>>"
MENTION = "array<struct<entity_id:string,label:string,entity_type:string,start_char:int,end_char:int>>"


def per_text(body: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    """A column function from a function of one text; null counts as empty."""

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([body(t if isinstance(t, str) else "") for t in texts], dtype=object)

    # Made on use: workers import this module without a session.
    return lambda column: F.pandas_udf(batch, kind)(column)


clean_text = per_text(M.clean_text, "string")
sentences = per_text(M.sentences, "array<string>")


def per_bounded_text(body: Callable[[str, M.Boundaries], object], kind: str, shared: M.Boundaries) -> Callable[[Column, Column, Column], Column]:
    """A column function of texts and their own learned abbreviations and starters (null: the shared ones are all)."""

    def batch(texts: pd.Series, abbreviations: pd.Series, starters: pd.Series) -> pd.Series:
        own = [shared if a is None and s is None else M.Boundaries([*shared.abbreviations, *(a if a is not None else ())], s if s is not None else ()) for a, s in zip(abbreviations, starters, strict=True)]
        return pd.Series([body(t if isinstance(t, str) else "", b) for t, b in zip(texts, own, strict=True)], dtype=object)

    return lambda *columns: F.pandas_udf(batch, kind)(*columns)


def chunk_rows(options: M.ChunkOptions = M.ChunkOptions(), shared: M.Boundaries = M.HEURISTIC) -> Callable[[Column, Column, Column], Column]:
    body = lambda t, b: [(i, c.text, c.start, c.end, c.metadata) for i, c in enumerate(M.chunks(t, options, b))]
    return per_bounded_text(body, CHUNK, shared)


def split_sentences(docs: DataFrame, text: str = "text", splitter: str | Engine = "auto") -> DataFrame:
    """``docs`` with ``sentences``, by an engine or the registered one of this name; a null text has none."""
    engine = sentence_splitter(splitter)
    split = per_bounded_text(M.sentences, "array<string>", engine.shared)
    rows = engine.attach(docs, text).withColumn("sentences", split(F.col(text), F.col("__abbreviations"), F.col("__starters")))
    return rows.drop("__abbreviations", "__starters")


sections = per_text(lambda t: [(i, s.id, s.title, s.level, s.parent_id, s.start, s.end, s.blocks) for i, s in enumerate(M.sections(t))], SECTION)

_PATTERNS = [(kind, re.compile(pattern), group) for kind, pattern, group in ENTITY_PATTERNS]


def find_entities(text: str) -> list[tuple[str, str, str, int, int]]:
    """(id, label, type, start, end): earlier patterns claim their spans first."""
    found: list[tuple[int, int, str]] = []  # sorted: claimed spans never overlap
    for kind, pattern, group in _PATTERNS:
        own: list[tuple[int, int, str]] = []
        at = 0
        for hit in pattern.finditer(text):  # from left to right, as the claimed spans
            a, b = hit.span(group)
            while at < len(found) and found[at][1] <= a:
                at += 1
            if (at == len(found) or found[at][0] >= b) and not (own and own[-1][1] > a):
                own.append((a, b, kind))
        found = list(merge(found, own))
    slug = lambda label: label.strip().lower().replace(" ", "_")
    return [(f"{kind}::{slug(text[a:b])}", text[a:b], kind, a, b) for a, b, kind in found]


entities = per_text(find_entities, MENTION)


def find_mentions(text: str) -> list[tuple[str | None, str, str, str, int, int]]:
    """(section id, entity) of a text's blocks that bear text, or of the whole text where it has no sections."""
    found = M.sections(text)
    if not found:
        return [(None, *e) for e in find_entities(text)]
    blocks = ((s.id, body, at) for s in found for _, kind, body, at, _ in s.blocks if kind in ("paragraph", "list", "blockquote", "table"))
    return [(section, name, label, kind, a + at, b + at) for section, body, at in blocks for name, label, kind, a, b in find_entities(body)]


placed_entities = per_text(find_mentions, MENTION.replace("struct<", "struct<section_id:string,"))


def chunks(docs: DataFrame, source: str = "source", text: str = "text", source_type: Column | None = None, options: M.ChunkOptions = M.ChunkOptions(), splitter: str | Engine = "auto") -> DataFrame:
    """One row per chunk with its id `source::chunk_i`; long paragraphs are cut at the sentence ends of the registered splitter."""
    engine = sentence_splitter(splitter)
    given = docs.select(F.col(source).alias("source"), (source_type if source_type is not None else F.lit("text")).alias("source_type"), F.col(text).alias("text"))
    cut = chunk_rows(options, engine.shared)(F.col("text"), F.col("__abbreviations"), F.col("__starters"))
    rows = engine.attach(given, "text").select("source", "source_type", F.inline(cut))
    return rows.select(F.concat(F.col("source").cast("string"), F.lit("::chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "*")


def section_rows(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    return docs.select(F.col(source).alias("source"), F.inline(sections(F.col(text))))


def block_rows(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    return section_rows(docs, source, text).select("source", "section_id", F.inline("blocks"))


def mentions(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Entity mentions: per text-bearing block where a text has sections, else over the whole text."""
    found = docs.select(F.col(source).alias("source"), F.inline(placed_entities(F.col(text))))
    order = Window.partitionBy("source").orderBy("start_char", "end_char")
    return found.withColumn("ord", F.row_number().over(order))


def entity_table(found: DataFrame) -> DataFrame:
    """One row per source and entity: the first label, and all references in order."""
    ref = F.struct("ord", "section_id", "start_char", "end_char", F.col("label").alias("snippet"))
    return found.groupBy("source", "entity_id").agg(
        F.min_by("label", "ord").alias("label"), F.min_by("entity_type", "ord").alias("entity_type"), F.array_sort(F.collect_list(ref)).alias("references"), F.count("*").alias("n_mentions")
    )
