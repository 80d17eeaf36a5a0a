"""Processing state as tables: manifest, queue, counters, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per repeated text: its hash, first id and number of copies. Only hashes are shuffled."""
    hashed = docs.select(content_hash(F.col(text)).alias("sha256"), F.col(key))
    return hashed.groupBy("sha256").agg(F.min(key).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose hash is not in the manifest."""
    return files.join(manifest.select("sha256").distinct(), "sha256", "left_anti")


def queue(arrivals: DataFrame, path: str = "path", arrived: str = "created_at", order: str = "event_id") -> DataFrame:
    """First-in-first-out queue: each path once, at its first arrival, with its position."""
    first = arrivals.groupBy(path).agg(F.min(F.struct(arrived, order)).alias("f")).select(path, F.col(f"f.{arrived}").alias(arrived), F.col(f"f.{order}").alias(order))
    return first


def with_position(queued: DataFrame, arrived: str = "created_at", order: str = "event_id") -> DataFrame:
    """Position in the queue. The window has one row per queued path; take a top-k of it for large queues."""
    return queued.withColumn("position", F.row_number().over(Window.orderBy(arrived, order)))


def runtime_stats(items: DataFrame) -> DataFrame:
    """One row of counters from (status, duplicate, seconds): averages are 0 where nothing was processed."""
    done = (F.col("status") == "DONE") & ~F.col("duplicate")
    return items.agg(
        F.count_if(done).alias("processed"),
        F.count_if(F.col("duplicate")).alias("skipped_duplicates"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count("*").alias("detection_events"),
        F.coalesce(F.avg(F.when(done, F.col("seconds"))), F.lit(0.0)).alias("average_seconds"),
    )


def recoverable(items: DataFrame) -> DataFrame:
    """Items to run again after a stop: those in processing first, then the pending, all as PENDING."""
    return items.where(F.col("status").isin("PROCESSING", "PENDING")).withColumns({"first": F.col("status") == "PROCESSING", "status": F.lit("PENDING")})
