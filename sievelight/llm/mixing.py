"""Mixing sources to target weights with Sainte-Lague apportionment.

Targets come from the sources' sizes and weights. The mix is made of blocks of
equal size: the blocks go to sources, each source's blocks to groups of its
shards, and each group's to its shards, by highest quotients, so every shard
has an integer quota and no step deals to more than a few thousand. A shard's documents
lie on a line in seeded order; whole passes over the line and then a run of
blocks from a seeded start, round the end, fill the quota.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.llm.common import BLANKS, spaced_words, stored, table, word_count

#: Weights that sources take in turn, in order of their names.
WEIGHTS = (3, 1, 2)
#: What sources share, as a multiple of all sizes, and what one source may give, as a multiple of its own.
SHARE, MOST = 1.5, 2.0
#: Words in a block, words in a shard, shards of a group and groups of a source (at most), and rows of a frame that may be broadcast.
BLOCK, SHARD_WORDS, SHARDS, SMALL = 32, 250_000, 4096, 10_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """``share`` times the total, dealt by weight; above ``most`` times its size a source stops and the rest is dealt again."""
    left, open_, out = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
        left = max(left, 0.0)
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1); none gets more than ``most``; ties go to the earlier one.

    All but a few seats are given at once by a common divisor that gives no
    seat too many, the rest one by one.
    """
    v = np.asarray(votes, np.float64)
    cap = np.full(len(v), seats, np.int64) if most is None else np.asarray(most, np.int64)
    cap = np.where(v > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(v)

    def given(unit: float) -> np.ndarray:
        return np.minimum(np.floor(np.minimum(v * unit + 0.5, 2.0**62)).astype(np.int64), cap)

    low, high = 0.0, (seats + 1.0) / v[v > 0].min()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if given(mid).sum() <= seats else (low, mid)
    got = given(low)
    queue = [(-v[i] / (2 * got[i] + 1), i) for i in range(len(v)) if got[i] < cap[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(queue, (-v[i] / (2 * got[i] + 1), i))
    return got.tolist()


def _quotas(rows: pd.DataFrame) -> pd.DataFrame:
    """The blocks of ``quota`` dealt to ``item`` by size; none gets more than twice the blocks that it has."""
    rows = rows.sort_values("item", ignore_index=True)
    return rows.assign(dealt=sainte_lague(rows["size"].tolist(), int(rows["quota"].iloc[0]), (2 * rows["blocks"]).tolist()))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, block: int = BLOCK, seed: int = 7, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of ``docs`` (doc_id, text, source), and the columns in ``carry``.

    With ``carry`` each row also has ``copies``, how often it is taken whole by
    passes over its shard's line, and ``runs``, the runs of its words (start,
    stop) that the run of blocks takes: ``taken`` words in all.

    Sources are ordered by code point, null last, and take ``weights`` in
    turn. A null or blank text has size 0 and is not taken; a row whose id is
    null or repeats is a document like any other. Names of other columns don't
    matter. An empty table gives no rows. The list of sources (with their
    weights, the configuration of a mix) is held by the driver; shards are
    apportioned in groups of at most ``SHARDS``. A long document is one row; its words are counted, never listed.
    """
    spark = docs.sparkSession
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")]
    rows = stored(docs.select(*own, F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"))).alias("mix_at"), F.xxhash64(F.col("text").cast("string")).alias("mix_text"), *(F.struct(*[F.col(c) for c in carry]).alias("mix_carry") for _ in carry[:1])), "mix")
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["source_size"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share)
    quotas = sainte_lague(goal, round(sum(goal) / block), [2 * -(-s // block) for s in sizes])
    plan = [(i, r["source"], s, g, q, max(1, min(SHARDS * SHARDS, s // SHARD_WORDS))) for i, (r, s, g, q) in enumerate(zip(found, sizes, goal, quotas, strict=True))]
    types = [("rank", T.LongType()), ("mix_source", T.StringType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("quota", T.LongType()), ("shards", T.LongType())]
    sources = spark.createDataFrame(plan, T.StructType([T.StructField(n, t) for n, t in types]))
    small = F.broadcast if len(plan) <= SMALL else lambda df: df
    placed = rows.join(small(sources), F.col("source").eqNullSafe(F.col("mix_source"))).withColumn("shard", F.pmod("mix_at", "shards"))
    shards = placed.groupBy("rank", "quota", "shard").agg(F.sum("size").alias("size")).withColumns({"blocks": F.ceil(F.col("size") / block), "group": F.floor(F.col("shard") / SHARDS)})
    dealt = "rank long, item long, size long, blocks long, quota long, dealt long"
    groups = shards.groupBy("rank", "quota", F.col("group").alias("item")).agg(F.sum("size").alias("size"), F.sum("blocks").alias("blocks"))
    groups = groups.select("rank", "item", "size", "blocks", "quota").groupBy("rank").applyInPandas(_quotas, dealt).select("rank", F.col("item").alias("group"), F.col("dealt").alias("quota"))
    within = shards.drop("quota").join(groups, ["rank", "group"]).select("rank", F.col("shard").alias("item"), "size", "blocks", "quota", "group")
    quota = within.groupBy("rank", "group").applyInPandas(_quotas, dealt.replace("quota long", "quota long, group long")).select("rank", F.col("item").alias("shard"), "blocks", F.col("dealt").alias("shard_quota"))
    line = Window.partitionBy("rank", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "mix_at"), "mix_at", "doc_id", "size", "mix_text")
    laid = placed.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.join(quota, ["rank", "shard"]).withColumn("begin", F.col("end") - F.col("size"))
    passes = F.floor(F.col("shard_quota") / F.greatest("blocks", F.lit(1)))
    rest = F.col("shard_quota") - passes * F.col("blocks")
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "shard"), F.greatest("blocks", F.lit(1)))
    tail = F.greatest(first + rest - F.col("blocks"), F.lit(0))

    ends = [(first, first + rest - tail), (F.lit(0), tail)]

    def shared(a, b):
        return F.greatest(F.least("end", b * block) - F.greatest("begin", a * block), F.lit(0))

    taken = passes * F.col("size") + shared(*ends[0]) + shared(*ends[1])
    runs = F.array(*[F.struct((F.greatest("begin", a * block) - F.col("begin")).cast("long").alias("start"), (F.least("end", b * block) - F.col("begin")).cast("long").alias("stop")) for a, b in ends])
    parts = [passes.cast("int").alias("copies"), F.filter(runs, lambda r: r["start"] < r["stop"]).alias("runs")] if carry else []
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *parts, *[F.col(f"mix_carry.{c}").alias(f"carry_{c}") for c in carry])


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix takes them: a row for each whole copy, and one for each run of words that blocks take from within a document.

    A run is cut from the text as it stands, from its first word to the end of its last.
    """
    laid = mix(docs, carry=docs.columns, **settings).filter("taken > 0")
    whole = F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("stop"))
    rows = laid.withColumn("run", F.explode(F.concat(F.array_repeat(whole, F.col("copies")), F.col("runs"))))
    start, stop = F.col("run.start"), F.col("run.stop")
    cut = F.array_join(F.slice(spaced_words(F.col("carry_text")), (start + 1).cast("int"), (stop - start).cast("int")), "")
    text = F.when(stop - start == F.col("size"), F.col("carry_text")).otherwise(F.rtrim(cut, F.lit(BLANKS)))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"carry_{c}").alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
