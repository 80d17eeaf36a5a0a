"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Language ID → toxicity → SimHash near-dedup → benchmark decontamination → packing.
Every stage works on all that its predecessor kept. The first four return the columns
of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.langid_crf import keep_identified
from docloom.llm.packing import pack
from docloom.llm.plumbing import stage, table
from docloom.llm.simhash_golay import drop_near_duplicates
from docloom.llm.toxicity_nnpu import drop_toxic
from docloom.llm.winnow import drop_contaminated


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; `und` ones go."""
    return keep_identified(docs)


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component. A stage's docs are Parquet rows that were just read again."""
    return drop_near_duplicates(docs, scanned=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", identify),
    ("toxicity", detoxify),
    ("simhash_near_dedup", deduplicate),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack_sequences),
]

#: The trained stages have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
