"""The corpus pipeline: quality, near duplicates, repeated passages, mixture, packing.

Each stage takes the documents that the stage before it kept and returns
documents (the last one: pieces of packed sequences). Stages are written as
Parquet in the shared folder and read again. A stage begins by releasing what
the stages before it left in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import rested, stored, table, vocabulary
from sievelight.llm.mixing import mixed
from sievelight.llm.ngram_join import one_of_each
from sievelight.llm.packing import pack
from sievelight.llm.quality_model import keep_quality
from sievelight.llm.suffix_dedup import without_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now; other columns are left behind."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the positive-unlabelled classifier rejects."""
    return _documents(keep_quality(_documents(docs), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near duplicates."""
    rested(spark)
    return _documents(one_of_each(_documents(docs)))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what repeats over 200 bytes or more; a document with nothing left stays, empty."""
    rested(spark)
    return _documents(without_repeats(_documents(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts and drops documents so that the sources reach their shares."""
    rested(spark)
    return _documents(mixed(_documents(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens along the curve."""
    rested(spark)
    return pack(docs, vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("packing", packing)]

#: A learnt classifier and Hilbert keys have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
