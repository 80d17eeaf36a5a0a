"""A watched folder as transactions over many tables.

Each batch of files goes through the whole workflow: hash, drop what is known, parse,
chunk, embed, link, note, graph, counters. Every step writes a folder of its own, and
one commit record, written last, names the folders of all tables. Readers go by the
commit records, so they see all of a batch or nothing. A batch that was lost half way
and runs again writes new folders; what it left is in no record. A batch that has a
record is not run again.

Vectors belong to content: a text is embedded once for each model, however many chunks
or documents hold it and however often they come. Links, notes and graph rows are
deltas: of rows of one key the newest batch's is the valid one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import columns as C
from docloom.functions.tables import PROCESSABLE_EXTENSIONS
from docloom.operators import notes as N
from docloom.operators import retrieval as R
from docloom.operators import text as X
from docloom.operators.models import Embedder, embed_column
from docloom.operators.registry import after_ingest, before_ingest
from docloom.operators.threshold_join import threshold_join
from docloom.runtime import drop, importable, stage
from docloom.sources.files import filename, parse, watchable
from docloom.streaming import watch as W

TABLES = {
    "documents": "source string, source_path string, source_type string, filename string, text string, title string, extra string, modified_at timestamp, size_bytes long",
    "quarantine": "source string, reason string",
    "chunks": "chunk_id string, source string, source_type string, chunk_index int, text string, start_char int, end_char int, metadata map<string,string>, text_hash string",
    "vectors": "text_hash string, model string, embedding array<double>",
    "links": "source string, other string, score double",
    "notes": "source string, title string, filename string, markdown string",
    "nodes": "id string, label string, node_type string, source string",
    "edges": "source_id string, target_id string, edge_type string, weight double",
    "manifest": W.MANIFEST_SCHEMA,
    "counters": "step string, rows long",
}
COMMIT = "batch long, name string, folder string, rows long"
LINK_LEAST, LINK_TOP, LINK_CHUNKS = 0.7, 3, 3


@dataclass
class Workflow:
    """What a batch is put through: the model that embeds chunks (none: no vectors and links), and how files are treated."""

    embedder: Embedder | None = None
    model: str = "none"
    settle: int = 0
    failed: str | None = None
    link_least: float = LINK_LEAST


# -------------------------------------------------------------------- commits


def _folders(spark: SparkSession, out: str) -> list[str]:
    """Folders of finished commit records, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if fs.exists(done(s.getPath(), "_SUCCESS")))


def commits(spark: SparkSession, out: str) -> DataFrame:
    """(batch, name, folder, rows) of all tables of all finished batches."""
    found = _folders(spark, out)
    return spark.read.schema(COMMIT).parquet(*found) if found else spark.createDataFrame([], COMMIT)


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table as of the newest commit, each row with its batch."""
    some = commits(spark, out).where((F.col("name") == name) & (F.col("rows") > 0)).select("batch", "folder").orderBy("batch").collect()
    rows = spark.read.schema(TABLES[name]).parquet(*(r["folder"] for r in some)) if some else spark.createDataFrame([], TABLES[name])
    if not some:
        return rows.withColumn("batch", F.lit(None).cast("long"))
    return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)-", 1).cast("long"))


def newest(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows of one key those of the newest batch."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")


class _Batch:
    """The folders that one attempt of a batch writes."""

    def __init__(self, spark: SparkSession, out: str, number: int):
        self.spark, self.out, self.number, self.attempt = spark, out, number, uuid.uuid4().hex[:12]
        self.written: list[tuple[int, str, str, int]] = []

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a table's rows of this batch, count them on the way, and read them back."""
        folder = f"{self.out}/{name}/batch={self.number:010d}-{self.attempt}"
        seen = Observation()
        fields = [c.split()[0] for c in TABLES[name].replace("map<string,string>", "map").split(", ")]
        rows.select(*fields).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
        self.written.append((self.number, name, folder, seen.get["rows"]))
        return self.spark.read.schema(TABLES[name]).parquet(folder)

    def rows(self, name: str) -> int:
        return next((n for _, table, _, n in self.written if table == name), 0)

    def commit(self) -> None:
        record = self.spark.createDataFrame(self.written, COMMIT).coalesce(1)
        record.write.mode("overwrite").parquet(f"{self.out}/commits/batch={self.number:010d}")


# -------------------------------------------------------------------- steps


def _chosen(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a batch's names; of each content that is not known the first file). Hashes are shuffled, contents are not."""
    names = stage(files.select("sha256", "path", "modificationTime"), "watched-names")
    first = names.join(known.select("sha256").distinct(), "sha256", "left_anti").groupBy("sha256").agg(F.min_by("path", F.struct("modificationTime", "path")).alias("path"))
    return names, stage(first, "watched-first")


def new_vectors(chunks: DataFrame, stored: DataFrame, embedder: Embedder, model: str) -> DataFrame:
    """(text_hash, model, embedding) of the texts that have no vector of a model yet, each embedded once."""
    known = stored.where(F.col("model") == model).select("text_hash")
    fresh = chunks.select("text_hash", "text").where(F.trim("text") != "").join(known, "text_hash", "left_anti")
    once = fresh.groupBy("text_hash").agg(F.any_value("text").alias("text"))
    return once.select("text_hash", F.lit(model).alias("model"), embed_column(F.col("text"), embedder).alias("embedding"))


def _links(made: DataFrame, chunks: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(source, other, score): other documents among the nearest chunks of each new document's first ones.

    Vectors are compared, not chunks: each once, under the name of its first chunk. Of the chunks of one vector only the
    first LINK_TOP ones can be among the nearest.
    """
    order = Window.partitionBy("text_hash").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = chunks.select("text_hash", "chunk_id").withColumns({"place": F.row_number().over(order), "first": F.first("chunk_id").over(order)})
    held = stage(placed.where(F.col("place") <= LINK_TOP), "watched-held")
    # A chunk that was made anew has its id twice, with two texts. No id holds the separator, so names sort as ids do.
    name = F.concat("first", F.lit("\0"), "text_hash")
    store = stage(held.where("place = 1").join(vectors, "text_hash").select(name.alias("id"), F.lit(0).alias("seq"), "embedding"), "watched-store")
    first = made.where(F.col("chunk_index") < LINK_CHUNKS).select("chunk_id", "text_hash")
    asks = first.select("text_hash").distinct().join(vectors, "text_hash").select(F.col("text_hash").alias("query"), "embedding", F.lit(None).cast("long").alias("last"))
    near = threshold_join(store, asks, least, LINK_TOP).select("query", F.substring_index("id", "\0", -1).alias("text_hash"), "score").join(held, "text_hash")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("chunk_id")))
    best = near.withColumn("rank", rank).where(F.col("rank") <= LINK_TOP).select(F.col("query").alias("text_hash"), F.col("chunk_id").alias("id"), "score")
    source = lambda c: F.regexp_extract(c, r"^(.*)::chunk_\d+$", 1)
    pairs = first.join(best, "text_hash").select(source(F.col("chunk_id")).alias("source"), source(F.col("id")).alias("other"), "score").where("source <> other")
    return pairs.groupBy("source", "other").agg(F.max("score").alias("score"))


def _notes(documents: DataFrame, links: DataFrame, stored: DataFrame) -> DataFrame:
    """(source, title, filename, markdown): a note for each document, under a name that no other note has."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(stem)
    named = documents.select("source", title.alias("title"), F.concat(N.safe_name(title), F.lit(".md")).alias("filename"), C.snippet(F.coalesce("text", F.lit(""))).alias("excerpt"))
    taken = stored.select(F.col("filename").alias("taken"), F.regexp_replace("filename", r"( \d+)?\.md$", ".md").alias("filename"))
    used = taken.groupBy("filename").agg(F.count("*").alias("used"), F.max(F.coalesce(F.regexp_extract("taken", r" (\d+)\.md$", 1).try_cast("int"), F.lit(1))).alias("last"))
    turn = F.row_number().over(Window.partitionBy("filename").orderBy("source")) + F.coalesce("last", F.lit(0))
    placed = named.join(used, "filename", "left").withColumn("turn", turn)
    name = F.when(F.col("turn") == 1, F.col("filename")).otherwise(F.concat(F.regexp_replace("filename", r"\.md$", " "), F.col("turn").cast("string"), F.lit(".md")))
    # LINK_CHUNKS · LINK_TOP links a document at most.
    related = links.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), N.wiki_link(F.col("other"))))), "\n").alias("related"))
    made = placed.select("source", "title", name.alias("filename"), "excerpt").join(related, "source", "left").withColumn("tags", F.expr("cast(array() as array<string>)"))
    return N.render(made, [("Excerpt", F.col("excerpt")), ("Related", F.col("related"))]).select("source", "title", "filename", "markdown")


def _graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and the entities that they name, and a mention for each pair."""
    found = stage(X.entity_table(X.mentions(documents)).select("source", "entity_id", "label", "entity_type", "n_mentions"), "watched-entities")
    entities = found.groupBy(F.col("entity_id").alias("id")).agg(F.min_by(F.struct("label", "source"), "source").alias("f")).select("id", "f.label", F.lit("entity").alias("node_type"), "f.source")
    own = documents.select(F.concat(F.lit("document::"), "source").alias("id"), F.col("filename").alias("label"), F.lit("document").alias("node_type"), "source")
    edges = found.select(F.concat(F.lit("document::"), "source").alias("source_id"), F.col("entity_id").alias("target_id"), F.lit("mentions").alias("edge_type"), F.col("n_mentions").cast("double").alias("weight"))
    return own.unionByName(entities), edges


def process(batch: DataFrame, number: int, out: str, flow: Workflow = Workflow()) -> None:
    """Put a batch of files (path, modificationTime, length, content) through the workflow and commit it as one."""
    spark = batch.sparkSession
    importable(spark)
    if any(f.endswith(f"batch={number:010d}") for f in _folders(spark, out)):
        return
    b = _Batch(spark, out, number)
    files = before_ingest.run(batch.where(watchable(F.col("path"))))
    if flow.settle:
        files = files.where(W.settled(flow.settle))
    files = files.withColumn("sha256", F.sha2("content", 256))
    names, chosen = _chosen(files, read(spark, out, "manifest"))
    once = files.join(F.broadcast(chosen.select("path")), "path")  # at most the files of a batch
    able = C.extension(filename(F.col("path"))).isin(*sorted(PROCESSABLE_EXTENSIONS))
    parsed = stage(parse(once.where(able)), "watched-parsed")
    good = after_ingest.run(parsed.where("reason is null"))
    documents = b.write("documents", good)
    unable = once.where(~able).select(F.col("path").alias("source"), F.lit("extension is not processed").alias("reason"))
    quarantine = b.write("quarantine", parsed.where("reason is not null").select("source", "reason").unionByName(unable))
    drop(parsed)  # all texts of the batch, which documents holds from here on

    chunks = b.write("chunks", X.chunks(documents, source_type=F.col("source_type")).withColumn("text_hash", F.sha2("text", 256)))
    stored = read(spark, out, "vectors").drop("batch")
    if flow.embedder is not None:
        vectors = b.write("vectors", new_vectors(chunks, stored, flow.embedder, flow.model))
        every = stored.unionByName(vectors).where(F.col("model") == flow.model).select("text_hash", "embedding")
        before = read(spark, out, "chunks").select("chunk_id", "text_hash")
        links = b.write("links", _links(chunks, before.unionByName(chunks.select("chunk_id", "text_hash")), every, flow.link_least))
    else:
        links = b.write("links", spark.createDataFrame([], TABLES["links"]))
    b.write("notes", _notes(documents, links, newest(read(spark, out, "notes"), "source")))
    nodes, edges = _graph(documents)
    b.write("nodes", nodes)
    b.write("edges", edges)

    done = chosen.join(documents.select(F.col("source").alias("path")), "path", "left_semi").select(
        "sha256", filename(F.col("path")).alias("original_filename"), F.col("path").alias("original_path"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("processed_at"),
        C.extension(filename(F.col("path"))).alias("extension"), F.lit("DONE").alias("status"),
    )
    b.write("manifest", done)
    # Every count but the first was seen while its table was written.
    detected = names.count()
    counts = {"detected": detected, "processed": b.rows("documents"), "failed": b.rows("quarantine"), "skipped_duplicates": detected - b.rows("documents") - b.rows("quarantine")}
    counts |= {name: b.rows(name) for name in ("chunks", "vectors", "links", "notes", "nodes", "edges")}
    b.write("counters", spark.createDataFrame(list(counts.items()), TABLES["counters"]).coalesce(1))
    b.commit()
    if flow.failed:
        W.move(W.destinations(quarantine.select(F.col("source").alias("path")), flow.failed, W._read_names(spark, flow.failed)))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, flow: Workflow = Workflow(), per_batch: int = 1000, drain: bool = True, interval: str = "10 seconds", each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Put the files of a folder through the workflow as they come; ``drain`` takes what is there and stops."""
    run = each or (lambda df, n: process(df, n, out, flow))
    writer = W.file_stream(spark, folder, per_batch).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """(step, rows): the counters of all committed batches together."""
    return read(spark, out, "counters").groupBy("step").agg(F.sum("rows").alias("rows"))


def searchable(spark: SparkSession, out: str, model: str) -> R.Corpus:
    """Chunks and their vectors as a search corpus, as of the newest commit."""
    rows = newest(read(spark, out, "chunks"), "chunk_id").select(F.col("chunk_id").alias("id"), F.xxhash64("chunk_id").alias("seq"), "text", "source", "source_type", "chunk_index", "metadata", "text_hash")
    vectors = read(spark, out, "vectors").where(F.col("model") == model).select("text_hash", "embedding")
    held: Column = F.col("embedding")
    return R.Corpus(rows.drop("text_hash"), rows.select("id", "text_hash").join(vectors, "text_hash").select("id", held))
