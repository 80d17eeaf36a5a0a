"""Files as a document table: scan, classify, parse, and set failures aside.

A scan is one `binaryFile` read with suffix and size tests on its columns; parsing is
one Arrow pass. Failures are rows of the same pass, told apart by `reason`, so a bad
file never fails a task.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.functions.tables import KIND_BY_EXTENSION, READER_BY_EXTENSION
from docloom.observability import Counters
from docloom.operators.registry import after_ingest, before_ingest
from docloom.sources.formats import READERS, Unreadable

MAX_BYTES = 50 << 20
MAX_ATTACHMENTS = 20
_PARSED = "source string, source_path string, source_type string, filename string, text string, title string, extra string, modified_at timestamp, size_bytes long, attachments array<struct<filename:string,content:binary>>, reason string"


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def watchable(path: Column) -> Column:
    """Supported, not hidden in any path part, not a temporary name."""
    name = filename(path)
    known = C.extension(name).isin(*sorted({*KIND_BY_EXTENSION, *READER_BY_EXTENSION}))
    return known & ~path.rlike(r"/\.[^/]") & ~name.rlike(r"(^~|~$|\.tmp$)")


def supported_extensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, k) for e, k in KIND_BY_EXTENSION.items()], "extension string, kind string").orderBy("extension")


def classify(docs: DataFrame) -> DataFrame:
    """Add extension, kind, confidence, processor, model and needs from filename and source_type."""
    kind = F.col("kind")
    return docs.withColumn("extension", C.extension(F.col("filename"))).withColumn("kind", C.kind(F.col("extension"), F.col("source_type"))).withColumns(
        {
            "confidence": C.kind_confidence(kind),
            "processor": C.processor(kind),
            "model": C.model(kind),
            "requires_ocr": kind.isin("scanned_pdf", "handwritten", "image"),
            "requires_vision": kind.isin("image", "handwritten", "video"),
            "requires_table_extraction": kind.isin("csv", "spreadsheet", "database"),
            "requires_code_parsing": kind == "code",
        }
    )


def unique_names(names: list[str]) -> list[str]:
    """Each name once: a later equal one gets the first free number before its suffix."""
    taken: dict[str, None] = {}
    for name in names:
        stem, suffix = os.path.splitext(name)
        free, n = name, 0
        while free in taken:
            n += 1
            free = f"{stem}-{n}{suffix}"
        taken[free] = None
    return list(taken)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        rows = []
        for f in files.itertuples():
            text = title = extra = reason = None
            attachments: list = []
            kind = f.kind
            try:
                if f.size > f.most:
                    raise Unreadable(f"{f.filename} is larger than {f.most} bytes")
                if kind not in READERS:
                    raise Unreadable(f"no reader for {f.filename}")
                text, title, found = READERS[kind](bytes(f.content), f.filename)
                parts = found.pop("attachments", [])
                attachments = [{"filename": n, "content": c} for n, (_, c) in zip(unique_names([n for n, _ in parts]), parts, strict=True)]
                kind = "scanned_pdf" if kind == "pdf" and not text else kind
                extra = json.dumps(found, sort_keys=True, default=str)
            except Unreadable as error:
                reason = str(error)
            except Exception as error:  # a broken file of any kind is set aside
                reason = f"{f.filename}: {type(error).__name__}"
            rows.append((f.path, f.path, kind, f.filename, text, title, extra, f.modified, f.size, attachments, reason))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARSED.split(", ")])


def parse(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Parsed rows of scanned files; `reason` is set where a file is set aside. Content above the limit is never sent to Python."""
    name = filename(F.col("path"))
    rows = files.select(
        "path", name.alias("filename"), C.reader(name, F.lit("")).alias("kind"), F.col("length").alias("size"), F.lit(max_bytes).alias("most"),
        F.col("modificationTime").alias("modified"), F.when(F.col("length") <= max_bytes, F.col("content")).otherwise(F.lit(b"")).alias("content"),
    )
    return rows.mapInPandas(_parse, _PARSED)


def children(parsed: DataFrame, most: int = MAX_ATTACHMENTS) -> DataFrame:
    """First attachments of each message as parsed rows with parent_id; attachments of attachments stay unread."""
    parts = parsed.where("reason is null").select(F.col("source").alias("parent_id"), "modified_at", F.posexplode("attachments").alias("at", "part")).where(F.col("at") < most)
    files = parts.select(
        F.concat("parent_id", F.lit("/"), "part.filename").alias("path"), F.col("part.content").alias("content"), F.octet_length("part.content").cast("long").alias("length"), F.col("modified_at").alias("modificationTime"), "parent_id"
    )
    return parse(files).where("reason is null").withColumn("parent_id", F.regexp_extract("source", r"^(.*)/[^/]*$", 1))


def ingest(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, counters: Counters | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with their attachments as children, quarantine with reasons).

    Files are parsed once: the parsed rows are staged, and all three results read them. Hooks registered before
    ingest see the scanned files, those after it the documents. Parsed and rejected files are counted in the pass that
    stages them, in ``counters`` where given.
    """
    files = before_ingest.run(scan(spark, path).where(watchable(F.col("path"))))
    parsed = (counters or Counters(spark, "ingest")).staged(parse(files, max_bytes), "parsed-files", F.col("reason").isNull())
    good = parsed.where("reason is null").withColumn("parent_id", F.lit(None).cast("string")).unionByName(children(parsed)).drop("reason", "attachments")
    return after_ingest.run(good), parsed.where("reason is not null").select("source", "source_path", "source_type", "reason")


def remote_sources(urls: DataFrame) -> DataFrame:
    """URL sources told apart: video id or repository coordinates; fetching needs a network client given by the caller."""
    video, repo = C.video_id(F.col("url")), C.repository(F.col("url"))
    kind = F.when(video.isNotNull(), "youtube").when(repo.isNotNull(), "github").when(F.col("url").rlike("^https?://[^/]+"), "url").otherwise("path")
    return urls.withColumns({"video_id": video, "repository": repo, "source_type": kind})
