"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.llm.common import batches as arrow_batches
from sievelight.llm.common import held_out, table

#: Longest n-gram, n-grams in a profile, training rows of a language at most, and the fold that is never learnt from.
LONGEST, RANKS, TRAINING, FOLDS, FOLD = 4, 400, 6_000, 4, 2
UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")
#: The low bits of a gram's hash are free, to carry a count while grams are sorted.
_LOW = np.int64(0xFFFF)
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=400_000)
def _word_grams(word: str) -> bytes:
    """Hashed n-grams of a lower-case word between marks of its ends, eight bytes each: joining bytes is cheaper than arrays."""
    code = np.frombuffer(f"\x02{word}\x03".encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    out, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, min(LONGEST, len(code)) + 1):
        h = (h[: len(code) - n + 1] * _ODD) + code[n - 1 :]
        mixed = (h ^ (h >> np.uint64(31))) * _MIX
        out.append(mixed[1:-1] if n == 1 else mixed)
    return (np.concatenate(out).view(np.int64) & ~_LOW).tobytes()


def letter_runs(text: str) -> dict[str, int]:
    """Counts of the lower-case runs of letters in a text."""
    counts = Counter(_RUN.findall(text.lower()))
    if not text.isascii():
        # other alphabets' numerals are no letters
        for w in [w for w in counts if not w.isalpha() and not any(map(str.isalpha, w))]:
            del counts[w]
    return counts


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole text and how often each occurs."""
    runs = letter_runs(text)
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = list(map(_word_grams, runs))
    weight = np.repeat(np.fromiter(runs.values(), np.int64, len(runs)), np.fromiter(map(len, grams), np.int64, len(grams)) >> 3)
    keys = np.frombuffer(b"".join(grams), np.int64)
    if weight.max() > _LOW:
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, weight, minlength=len(keys)).astype(np.int64)
    both = np.sort(keys | weight)
    keys = both & ~_LOW
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(both & _LOW, first)


def ranked(keys: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by hash."""
    if len(keys) > 4 * ranks:
        part = counts >= np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        keys, counts = keys[part], counts[part]
    return keys[np.lexsort((keys, -counts))][:ranks]


class Profiles:
    """Language profiles; ``predict`` gives the nearest one by mean out-of-place distance."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.langs = sorted(grams)
        self.sorted = [np.sort(grams[k]) for k in self.langs]
        self.rank = [np.argsort(grams[k], kind="stable") for k in self.langs]

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*gram_counts(text or ""))
        if not len(own):
            return UNKNOWN, 0.0
        if not self.langs:
            return UNKNOWN, 0.0
        place, far = np.arange(len(own)), []
        for keys, rank in zip(self.sorted, self.rank, strict=True):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            far.append(int(np.where(keys[at] == own, np.abs(rank[at] - place), RANKS).sum()) / (len(own) * RANKS))
        near = np.exp(-30 * (np.array(far) - min(far)))
        best = int(np.argmin(far))
        return self.langs[best], float(near[best] / near.sum())


def _training_counts(batches):
    for batch in batches:
        by: dict[str, dict[int, int]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = by.setdefault(lang, {})
            for k, n in zip(*(x.tolist() for x in gram_counts(text or "")), strict=True):
                own[k] = own.get(k, 0) + n
        rows = [(lang, k, n) for lang, own in by.items() for k, n in own.items()]
        yield from arrow_batches({"lang": pa.string(), "gram": pa.int64(), "n": pa.int64()}, rows)


def learn(docs: DataFrame, most: int = TRAINING) -> Profiles:
    """Profiles from at most ``most`` different training rows of each language (those with the smallest hash of id and text), counted on the executors."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD)).select("text", "lang", F.xxhash64("doc_id", "text").alias("at"))
    ids = rows.groupBy("lang").agg(F.approx_count_distinct("at").alias("ids"))
    # hashes are even, so about twice what is wanted lies below this bound, and only that meets in one place
    low = rows.select("lang", "at").join(F.broadcast(ids), "lang").filter(F.col("at") / 2.0**64 + 0.5 < (2.0 * most + 100) / F.col("ids"))
    placed = low.select("lang", "at").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("at")))
    drawn = placed.filter(F.col("place") <= most).groupBy("lang").agg(F.max("at").alias("last"))
    sample = rows.join(F.broadcast(drawn), "lang").filter(F.col("at") <= F.col("last")).dropDuplicates(["lang", "at"]).select("text", "lang")
    counts = sample.mapInArrow(_training_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= RANKS)
    grams: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "gram", "place").collect():
        grams.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return Profiles({k: np.array([g for _, g in sorted(v)], np.int64) for k, v in grams.items()})


def _predicted(profiles: Profiles):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                found = [profiles.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, training: int = TRAINING) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs`` (doc_id, text, lang).

    ``lang`` serves only to learn, from rows outside the held-out fold. A text
    that is null or has no letter gets ``und`` and score 0, as does every text
    where nothing could be learnt. A null id is never held out; a row that
    repeats is learnt from once and predicted as often as it stands there;
    equally near languages go by name; other columns are ignored. An empty
    table gives no rows. A text is read whole, with one count for each of its
    n-grams.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    profiles = learn(rows, training)
    return rows.select("doc_id", "text", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out")).mapInArrow(_predicted(profiles), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
