"""Documents through the processor of their kind: one plan for all kinds.

Processors that need no model are one projection. A processor that has a service, given
here or registered under its name (``docloom.operators.registry.processors``), gets the
rows of its kinds alone and answers with (source, text); those rows are joined with the
answers, all others pass by without a shuffle.

Odd input: an unknown or null kind is text. A document that its service does not answer
keeps its own text, as does one without bytes. Null texts are empty. Without title and
file name the source is the title. Sources are expected to be unique among the rows of a
service; repeated sources of it get the answers joined by line ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.functions.tables import PROCESSED_AS
from docloom.operators import ocr, registry
from docloom.operators.tables import drawio_drawing, flowchart

Service = Callable[[DataFrame], DataFrame]


def hearing(hear: Callable[[bytes], list[str]]) -> Service:
    """A service of a transcription engine, over the column ``content``."""
    return lambda docs: ocr.transcribe(docs, hear)


def reading(service: ocr.OcrService, pages: DataFrame, kind: str, engine: str = "auto") -> Service:
    """A service of an OCR engine, over the pages (source, page_no, image) of the documents; pages are joined by blank lines."""

    def read(docs: DataFrame) -> DataFrame:
        own = pages.join(docs.select("source"), "source", "left_semi")
        found = service.read(own, kind, engine).where(F.trim(F.coalesce("text", F.lit(""))) != "")
        inner = F.array_sort(F.collect_list(F.struct("page_no", "text")))
        return found.groupBy("source").agg(F.array_join(F.transform(inner, lambda p: p["text"]), "\n\n").alias("text"))

    return read


def _spec(place: int, type_: str) -> Column:
    values = {name: F.lit(spec[place]) for name, spec in PROCESSED_AS.items()}
    return F.create_map(*(x for name, v in values.items() for x in (F.lit(name), v.cast(type_))))[F.col("processor")]


def process(documents: DataFrame, services: dict[str, Service] | None = None, diagrams: bool = True) -> DataFrame:
    """(source, kind, processor, model, title, content, markdown, source_type, confidence, model_used) of each document.

    ``documents`` has source, kind, source_type, filename, title, text and content (bytes). ``services``
    maps names of processors to services and goes before those that are registered.
    """
    served = {n: registry.processors.get(n) for n in registry.processors.names()} | (services or {})
    unknown = sorted(set(served) - set(PROCESSED_AS))
    if unknown:
        raise KeyError(f"unknown processors: {', '.join(unknown)}")
    rows = documents.select("source", "kind", "source_type", "filename", "title", F.coalesce("text", F.lit("")).alias("text"), "content")
    rows = rows.withColumns({"processor": C.processor(F.col("kind")), "model": C.model(F.col("kind"))})
    parts = [rows.where(~F.col("processor").isin(*served)).withColumn("read", F.lit(None).cast("string")) if served else rows.withColumn("read", F.lit(None).cast("string"))]
    for name, service in served.items():
        own = rows.where(F.col("processor") == name)
        said = service(own).groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("read"))
        parts.append(own.join(said, "source", "left").select(parts[0].columns))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if diagrams:
        is_drawing = (F.col("processor") == "DiagramProcessor") & F.lower("filename").endswith(".drawio") & F.col("content").isNotNull()
        # Only drawings reach the parser with a text.
        drawn = flowchart(drawio_drawing(F.when(is_drawing, F.make_valid_utf8(F.col("content").cast("string")))))
        whole = whole.withColumn("drawn", F.when(is_drawing, F.nullif(drawn, F.lit(""))))
    else:
        whole = whole.withColumn("drawn", F.lit(None).cast("string"))
    with_model = F.col("processor").isin(*served) if served else F.lit(False)
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("filename", F.lit("")), F.col("source"))
    content = F.coalesce("drawn", "read", "text")
    body = F.when(F.col("drawn").isNotNull(), F.concat(F.lit("```mermaid\n"), "drawn", F.lit("\n```"))).otherwise(content)
    return whole.select(
        "source", "kind", "processor", "model", title.alias("title"), content.alias("content"), F.concat(F.lit("# "), title, F.lit("\n\n"), body).alias("markdown"),
        F.coalesce(_spec(0, "string"), "source_type").alias("source_type"), F.when(with_model, _spec(2, "double")).otherwise(_spec(1, "double")).alias("confidence"),
        with_model.alias("model_used"),
    )
