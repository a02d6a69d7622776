"""Token-id output: Parquet list columns in document order, and their readers.

Documents are range-partitioned and sorted by id, encoded where they lie, and
written as one file a partition, so that the file order is the document order.
Ids are delta- or dictionary-encoded (Parquet v2 pages), row groups and pages
are bounded, and pages carry an index: a reader that needs only ``doc_id`` and
``n_tokens`` never touches the ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.llm.common import chunk_encoder, shared_dir, shuffle_partitions, stored, table, trimmed, utf8, vocabulary

#: Rows of a table of files that may be broadcast.
FEW_FILES = 100_000
SCHEMA = "doc_id long, file_start long, n_tokens long, ids array<int>"


def parquet_options(encoding: str = "dictionary", row_group_mb: int = 32, page_kb: int = 256) -> dict[str, str]:
    """Writer settings of a token file: v2 pages, list values by dictionary or by delta."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding: {encoding}")
    return {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true" if encoding == "dictionary" else "false",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.page.write-checksum.enabled": "true",
    }


def _encoded(tokenizer: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder, start = chunk_encoder(tokenizer), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ids = [x + end for x in encoder.encode(utf8(part.column(1)))]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + ends - n), pa.array(n), lists], ["doc_id", "file_start", "n_tokens", "ids"])
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, encoding: str = "dictionary", partitions: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write token files under ``path``.

    A null text counts as empty and yields its end id alone; documents without
    an id come first; rows with equal ids follow one another in text order.
    Other columns are ignored. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(trimmed(_encoded(tokenizer, end_id)), SCHEMA).write.options(**parquet_options(encoding)).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of the files under ``path``.

    Only the counts are read to place the files; their running total has one
    row a file.
    """
    files = spark.read.schema(SCHEMA).parquet(path).withColumn("file", F.col("_metadata.file_name"))
    totals = files.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1))
    bases = stored(totals.select("file", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    # one row a file; its size is checked before it is sent to all executors
    bases = F.broadcast(bases) if bases.count() <= FEW_FILES else bases
    return files.join(bases, "file").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def _digested(batches):
    for batch in batches:
        lists = batch.column(3)
        values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op2_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = shared_dir(spark, "op2")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer or vocabulary(), end_id=2)
    return read_tokens(spark, path).mapInArrow(trimmed(_digested), "doc_id long, start long, n_tokens long, ids_crc32 long")
