"""Spark plumbing of the corpus operators: shared storage, Arrow batches, tables."""

from __future__ import annotations

import atexit
import ctypes
import os
import pickle
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows of an Arrow batch sent to Python, unless the session has its own setting.
BATCH_ROWS = 1000
ROW_KEY = ("file", "row")
_OWN: list[str] = []
#: What passes keep in a worker between their tasks, such as a tokenizer with its pieces.
KEPT: dict[str, object] = {}
Batches = Iterator[pa.RecordBatch]


def let_go(keep: tuple[str, ...] = ()) -> None:
    """Drop what other passes kept in this worker, and give freed memory back to the system where the C library can."""
    for name in KEPT.keys() - set(keep):
        del KEPT[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(run: Callable[[Batches], Batches], *keep: str) -> Callable[[Batches], Batches]:
    """``run`` as a task of a worker that is used again: of KEPT only ``keep`` stays, freed memory goes back at the end."""

    def task(batches: Batches) -> Batches:
        let_go(keep)
        yield from run(batches)
        let_go(keep)

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on one machine a folder of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="docloom-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    jvm = staged.sparkSession._jvm
    conf = staged.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fit_in_task(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """A model that one executor task fits on a bounded sample; only the model comes to the driver.

    ``fit`` must not depend on the order of the rows: a repeated task then gives the same model.
    """
    prepare(rows.sparkSession)
    names = pa.schema([("model", pa.binary())])
    schema = pa.schema([(f.name, t) for f, t in zip(rows.schema.fields, (to_arrow_type(f.dataType) for f in rows.schema.fields), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.Table.from_batches([b]).cast(schema) for b in batches if b.num_rows]
        model = fit(pa.concat_tables(held) if held else schema.empty_table())
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(model), 1)], pa.binary())], schema=names)

    # An empty sample has no task of its own: fit on nothing here.
    found = rows.repartition(1).mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(zlib.decompress(found[0]["model"])) if found else fit(schema.empty_table())


def salted(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join where a key may hold a large share of the left rows: its rows are dealt over ``salts`` tasks, the right rows copied to each.

    Neither side may have columns named as the salt.
    """
    name = "salt" + "_" * max(map(len, [*left.columns, *right.columns]))
    dealt = left.withColumn(name, F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    copied = right.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copied, [*on, name], how).drop(name)


def row_keys(docs: DataFrame) -> DataFrame | None:
    """docs with two more columns that tell rows apart, from the files they are read from; None where that is not known.

    Right for scans with filters and chosen columns only: after an explode or a join, rows share the keys of their file.
    """
    if "_metadata" in docs.columns:
        return None
    file, row = ROW_KEY
    pad = "_" * max(map(len, docs.columns))
    try:
        return docs.select("*", F.col("_metadata.file_path").alias(file + pad), F.col("_metadata.row_index").alias(row + pad))
    except AnalysisException:
        return None


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by rows, and let workers import this package where the driver got it from."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, one: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from one(batch)

    return df.mapInArrow(lean(run), schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema=schema)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def hash_edge(rows: int, many: int) -> int:
    """A bound below which about twice ``rows`` of ``many`` evenly spread 63-bit hashes lie."""
    return min(2**63 - 1, (2 * rows + 100) * 2**63 // max(1, many))


def sample_hash(df: DataFrame, rows: int, key: Column, salt: str) -> tuple[Column, int]:
    """(a hash of ``key``, its largest value in the sample): at most ``rows`` different hashes lie up to it; -1: no rows.

    About twice the hashes pass a first threshold; only they, each once, are sorted.
    """
    rank = F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 1)
    many = df.agg(F.approx_count_distinct(rank, 0.02).alias("n")).first()["n"]
    near = df.select(rank.alias("h")).where(F.col("h") <= hash_edge(rows, many)).distinct()
    last = near.orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return rank, -1 if last is None else last


def hashed_sample(df: DataFrame, rows: int, key: Column, salt: str = "train") -> DataFrame:
    """At most ``rows`` rows, those with the smallest salted hashes of ``key``: independent of row order.

    Rows that are equal in ``key`` count once and give one row, so ``key`` should hold all that is used.
    """
    name = "h" + "_" * max(map(len, df.columns))
    rank, last = sample_hash(df, rows, key, salt)
    return df.withColumn(name, rank).where(F.col(name) <= F.lit(last)).dropDuplicates([name]).drop(name)


def filter_batches(docs: DataFrame, column: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows whose ``column`` passes ``keep`` (a function of the column's Arrow values), without a shuffle or join."""
    prepare(docs.sparkSession)
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
