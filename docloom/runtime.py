"""What every operator may need of the session: shared storage, importable workers, tables."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on one machine a folder of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="docloom-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver got it (clusters ship it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts a growing plan, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(staged: DataFrame) -> None:
    """Delete the folder of a staged table that nothing reads any more."""
    spark = staged.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over the cores where the input has fewer splits than cores because it is small, as one file of one row group is.

    A split of full size is work enough for a core: a large input is never shuffled for this.
    """
    spark = df.sparkSession
    cores, splits = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    full = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = sum(x for _, x, _ in files_of(df))
    return df.repartition(cores) if splits < cores and size < cores * full // 4 else df


def files_of(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of the files that a plan reads, from listings of their folders; no row is read."""
    spark = df.sparkSession
    conf, found = spark._jsc.hadoopConfiguration(), []
    names = set(df.inputFiles())
    for folder in sorted({f.rsplit("/", 1)[0] for f in names}):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for s in path.getFileSystem(conf).listStatus(path):
            found.append((s.getPath().toUri().getPath(), s.getLen(), s.getModificationTime()))
    wanted = {_path_of(f) for f in names}
    return sorted(f for f in found if f[0] in wanted)


def _path_of(uri: str) -> str:
    """The path of a file's URI, without scheme, host and escapes."""
    return unquote(urlsplit(uri).path)


def file_version(df: DataFrame) -> str | None:
    """A name for the files that a plan reads: their paths, sizes and times; None where it reads none."""
    found = files_of(df)
    return hashlib.sha256(repr(found).encode()).hexdigest() if found else None
