"""A watched folder as a Structured Streaming query.

Files arrive as `binaryFile` rows; each micro-batch drops what the manifest knows
(by content hash), parses the rest and appends documents, quarantine rows and
manifest rows. Batches are idempotent: the manifest is read inside the batch, and
each write goes to a folder of the batch, so a batch that runs again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from docloom.functions.tables import PROCESSABLE_EXTENSIONS
from docloom.functions import columns as C
from docloom.runtime import stage
from docloom.sources.files import filename, parse, watchable

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
MANIFEST_SCHEMA = "sha256 string, original_filename string, original_path string, processed_at string, extension string, status string"


def file_stream(spark: SparkSession, folder: str, per_batch: int = 1000, recursive: bool = True, archive: str | None = None) -> DataFrame:
    """New files of a folder; ``per_batch`` bounds a batch, finished files may be archived."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def settled(seconds: int) -> Column:
    """Files that nobody has written to for some seconds; others are left out, as a file that still grows would be."""
    return F.col("modificationTime") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(seconds)))


def destinations(paths: DataFrame, folder: str, taken: DataFrame) -> DataFrame:
    """(path, destination): each file below a folder under its own name; a name that is taken (name) gets the next free number, from 2 on.

    Names that differ from a numbered one only by chance are kept apart by numbering behind the taken ones.
    """
    name = filename(F.col("path"))
    stem, suffix = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    mine = paths.select("path", name.alias("name"), stem.alias("stem"), suffix.alias("suffix"))
    number = F.coalesce(F.regexp_extract("name", r" (\d+)(\.[^.]*)?$", 1).try_cast("int"), F.lit(1))
    base = F.regexp_replace("name", r" \d+(\.[^.]*)?$", "$1")
    used = taken.select(base.alias("name"), number.alias("n")).unionByName(taken.select("name", F.lit(1).alias("n"))).groupBy("name").agg(F.max("n").alias("used"))
    turn = F.row_number().over(Window.partitionBy("name").orderBy("path")) + F.coalesce("used", F.lit(0))
    free = F.when(turn == 1, F.col("name")).otherwise(F.concat("stem", F.lit(" "), turn.cast("string"), "suffix"))
    return mine.join(used, "name", "left").select("path", F.concat(F.lit(folder.rstrip("/") + "/"), free).alias("destination"))


def move(moves: DataFrame) -> int:
    """Rename files (path, destination), a batch's at most; returns how many were moved."""
    spark = moves.sparkSession
    jvm, conf, done = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for r in moves.collect():
        source, to = jvm.org.apache.hadoop.fs.Path(r["path"]), jvm.org.apache.hadoop.fs.Path(r["destination"])
        fs = source.getFileSystem(conf)
        fs.mkdirs(to.getParent())
        done += bool(fs.exists(source) and fs.rename(source, to))
    return done


def _read_names(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files in a folder; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(),) for s in fs.listStatus(path)] if fs.exists(path) else []
    return spark.createDataFrame(found, "name string")


def process_batch(batch: DataFrame, number: int, out: str, settle: int = 0, failed: str | None = None) -> None:
    """Hash, drop known content, parse, append: `documents`, `quarantine`, `manifest`, `stats` under ``out``.

    Files that cannot be read are moved to the folder ``failed``, if there is one.
    """
    spark = batch.sparkSession
    known = _read(spark, f"{out}/manifest/*", MANIFEST_SCHEMA).select("sha256").distinct()
    files = batch.where(watchable(F.col("path")))
    if settle:
        files = files.where(settled(settle))
    files = files.withColumn("sha256", F.sha2("content", 256))
    # Paths are chosen by hash alone; the bytes of the files are not shuffled.
    names = stage(files.select("sha256", "path", "modificationTime"), "watched-names")
    first = names.join(known, "sha256", "left_anti").groupBy("sha256").agg(F.min_by("path", F.struct("modificationTime", "path")).alias("path"))
    chosen = stage(first, "watched-first")
    once = files.join(F.broadcast(chosen.select("path")), "path")  # at most the files of a batch
    able = C.extension(filename(F.col("path"))).isin(*sorted(PROCESSABLE_EXTENSIONS))
    parsed = parse(once.where(able))
    parsed.write.mode("overwrite").parquet(f"{out}/parsed/batch={number}")
    rows = spark.read.parquet(f"{out}/parsed/batch={number}")
    rows.where("reason is null").drop("reason", "attachments").write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
    unable = once.where(~able).select(F.col("path").alias("source"), F.lit("extension is not processed").alias("reason"))
    bad = rows.where("reason is not null").select("source", "reason").unionByName(unable)
    bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
    done = once.join(rows.where("reason is null").select(F.col("source").alias("path")), "path").select(
        "sha256", filename(F.col("path")).alias("original_filename"), F.col("path").alias("original_path"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("processed_at"),
        C.extension(filename(F.col("path"))).alias("extension"), F.lit("DONE").alias("status"),
    )
    counts = names.agg(F.count("*").alias("detected")).crossJoin(rows.agg(F.count_if(F.col("reason").isNull()).alias("processed"))).crossJoin(bad.agg(F.count("*").alias("failed")))
    counts.withColumns({"batch": F.lit(number), "skipped_duplicates": F.col("detected") - F.col("processed") - F.col("failed")}).write.mode("overwrite").parquet(f"{out}/stats/batch={number}")
    # Only a finished batch makes its content known.
    done.write.mode("overwrite").parquet(f"{out}/manifest/batch={number}")
    # The batch is done: one that runs again skips files that have gone.
    if failed:
        bad_files = spark.read.parquet(f"{out}/quarantine/batch={number}").select(F.col("source").alias("path"))
        there = _read_names(spark, failed)
        move(destinations(bad_files, failed, there))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, per_batch: int = 1000, drain: bool = True, interval: str = "10 seconds", recursive: bool = True, archive: str | None = None, settle: int = 0, failed: str | None = None) -> StreamingQuery:
    """Start watching; ``drain`` processes what is there and stops."""
    writer = file_stream(spark, folder, per_batch, recursive, archive).writeStream.foreachBatch(lambda df, n: process_batch(df, n, out, settle, failed)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)).start()


def first_seen(stream: DataFrame, keys: list[str], event_time: str, horizon: str) -> DataFrame:
    """Drop repeats within a horizon of event time; the state is bounded by it."""
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)


def windowed_stats(stream: DataFrame, event_time: str, size: str, late: str, *groups: str) -> DataFrame:
    """Counts and mean value per event-time window and group; later rows than ``late`` are dropped by the watermark."""
    base = stream.withWatermark(event_time, late) if stream.isStreaming else stream
    grouped = base.groupBy(F.window(event_time, size).alias("w"), *groups).agg(F.count("*").alias("events"), F.avg("value").alias("mean_value"))
    return grouped.select(F.col("w.start").alias("window_start"), *groups, "events", "mean_value")


def replay(spark: SparkSession, folder: str, schema: str, transform: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, mode: str = "complete", per_batch: int = 1) -> DataFrame:
    """Run a stream over Parquet files to its end and return its result as a table."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    query = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
