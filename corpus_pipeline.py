"""The training-corpus pipeline: language, repeated lines, near copies, mixture, sequences.

Each stage takes all that its predecessor kept, and is written as Parquet before the
next one reads it.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fusegrid.llm import langid, linededup, mixing, ngramjoin, packing
from fusegrid.plans.scratch import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Learnt networks and hash draws have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the byte network knows; texts without letters or any likely language go."""
    return langid.keep_known(docs.select(COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one."""
    return linededup.dedup(docs.select(COLUMNS)).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8."""
    return ngramjoin.drop_copies(docs.select(COLUMNS)).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each source in its target amount; a document used twice is there twice."""
    return mixing.mixed_documents(docs).select(COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("sequences", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
