"""Packing along a space-filling curve.

A document's tokens are hashed into a signed vector, projected to a few
dimensions and quantised; the cell's place on a Hilbert curve is the sort key.
Documents are range-sorted by that key, so neighbours on the curve share
sequences, and each range is cut into full sequences. What is left at the end
of a range is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import batches as arrow_batches
from sievelight.llm.common import chunk_encoder, shuffle_partitions, stored, table, trimmed, utf8, vocabulary

#: Buckets of the hashed vector, dimensions of the curve, bits of each.
BUCKETS, DIMENSIONS, BITS = 512, 4, 12


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (points x dimensions, below 2**bits) on the Hilbert curve.

    Skilling's transposition (2004): undo the excess work from the top bit
    down, Gray-encode, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@lru_cache(maxsize=2)
def _projection(size: int, seed: int) -> np.ndarray:
    """For each token id its bucket's projection with its sign: size x DIMENSIONS."""
    ids = np.arange(size, dtype=np.uint64)
    mixed = (ids + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    bucket, sign = (mixed >> np.uint64(40)) % np.uint64(BUCKETS), 1.0 - 2.0 * ((mixed >> np.uint64(20)) & np.uint64(1)).astype(np.float64)
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))[bucket.astype(np.int64)] * sign[:, None]


def curve_keys(ids: list[np.ndarray], vocabulary_size: int, seed: int = 11) -> np.ndarray:
    """Hilbert keys of documents: distinct tokens, signed hashing, projection, unit scale, normal quantisation."""
    table_ = _projection(vocabulary_size, seed)
    points = np.zeros((len(ids), DIMENSIONS))
    for i, x in enumerate(ids):
        own = np.unique(x)
        points[i] = table_[own].sum(axis=0) / np.sqrt(max(1, len(own)))
    spread = 1.0 / (1.0 + np.exp(-np.clip(1.7 * points, -30, 30)))
    return hilbert(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _keyed(tokenizer: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = chunk_encoder(tokenizer)
        size = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        width = "<u2" if size <= 1 << 16 else "<u4"
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ids = [np.frombuffer(x + end, "<u4") for x in encoder.encode(utf8(part.column(1)))]
                keys = curve_keys(ids, size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(width).tobytes() for x in ids], pa.binary())], ["doc_id", "curve", "doc_tokens", "ids"])

    return run


#: Bytes of ids in a range, about, at most.
RANGE_BYTES = 64 << 20

PIECE = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


def cut(remainder: int) -> list[int]:
    """A length as descending powers of two."""
    return [1 << b for b in range(remainder.bit_length() - 1, -1, -1) if remainder >> b & 1]


def _packed(length: int):
    def run(batches):
        sequence, used, open_ = TaskContext.get().partitionId() << 40, 0, []
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ids, at = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4"), 0
                while at < n:
                    take = min(length - used, n - at)
                    open_.append((doc_id, at, ids[at : at + take], n))
                    at, used = at + take, used + take
                    if used == length:
                        rows += _placed(open_, [length], sequence)
                        sequence, used, open_ = sequence + 1, 0, []
            if rows:
                yield from arrow_batches(PIECE, rows)
        if open_:
            yield from arrow_batches(PIECE, _placed(open_, cut(used), sequence))

    return run


def _placed(pieces: list[tuple], lengths: list[int], sequence: int) -> list[tuple]:
    """The pieces, cut further where a sequence of ``lengths`` ends."""
    rows, used, k = [], 0, 0
    for doc_id, start, ids, n in pieces:
        at = 0
        while at < len(ids):
            take = min(lengths[k] - used, len(ids) - at)
            rows.append((doc_id, start + at, take, zlib.crc32(ids[at : at + take].tobytes()), n, sequence + k, used))
            at, used = at + take, used + take
            if used == lengths[k]:
                used, k = 0, k + 1
    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, partitions: int | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``length`` tokens.

    A null text counts as empty and is its end id alone; ids may be null or
    repeat (each row is packed); other columns are ignored; an empty table
    gives no pieces. Equal keys are split by id, so copies of one text spread
    over ranges; ranges hold about ``RANGE_BYTES`` of ids or less. The ids of
    one text, of any length, are held by one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = stored(rows.mapInArrow(trimmed(_keyed(tokenizer, end_id)), "doc_id long, curve long, doc_tokens long, ids binary"), "pack", compression="zstd")
    held = keyed.agg(F.sum(F.length("ids"))).first()[0] or 0
    partitions = partitions or max(shuffle_partitions(spark), -(-held // RANGE_BYTES))
    sorted_ = keyed.repartitionByRange(partitions, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")
    schema = ", ".join(f"{c} long" for c in PIECE)
    return sorted_.mapInArrow(trimmed(_packed(length)), schema)


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or vocabulary())
