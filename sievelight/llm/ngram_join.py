"""Near duplicates: an exact Jaccard self-join of 5-word shingle sets.

Prefix filtering over several global token orders. Every order puts frequent
tokens (by a count sketch of all documents) last and breaks ties by another
hash. Under each order two sets with Jaccard similarity of at least 0.8 share
a token of their prefixes. The first order's prefixes deal the sets to
buckets, with the size and positional filters. A pair stays only if the sets'
profiles leave room for enough overlap and the prefixes of every other order
meet, too, which each set brings along; the texts of what is left travel to
each other and are compared exactly.

Equal sets are one class from the start. In a large bucket every row is first
compared to one representative. What then still lies in different components
is compared by component: Jaccard distance is a metric, so two components
whose roots are farther apart than the threshold and both radii together hold
no link, and of the others only rows that the same bound admits are paired. A
large group of near copies so costs about its size, and so do many groups
that share boilerplate. All links between components are found; links inside
one may be left out. ``all_links`` gives those, too.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import released, stored, table, trimmed, utf8
from sievelight.llm.components import components

SHINGLE = 5
#: Similarity of 4/5, as integers: 5 * intersection >= 4 * union.
NUM, DEN = 4, 5
#: Counters of the sketch, at least and at most (between, one for 256 characters), and the excess over the usual count from which a token is frequent, at least.
SLOTS, FREQUENT = (1 << 18, 1 << 24), 64
#: Rows of a bucket up to which all its pairs are formed at once.
ALL_PAIRS = 32
#: Rows of one key that a task joins, and keys that may be broadcast.
DEALT, SMALL = 1024, 100_000
#: Multipliers of the orders beside the first.
ORDERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULT = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(SHINGLE)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word 5-grams; a shorter text is one shingle, an empty one none."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < SHINGLE:
        return _mixed(np.array([(w * np.array(_MULT[:n], np.uint64)).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    h = w[: n - SHINGLE + 1] * _MULT[0]
    for k in range(1, SHINGLE):
        h = h + w[k : n - SHINGLE + 1 + k] * _MULT[k]
    return np.unique(_mixed(h))


def class_key(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=12).digest() if len(tokens) else None


def profile(tokens: np.ndarray) -> bytes:
    """How many tokens fall to each of 256 slots; empty where a count leaves a byte."""
    counts = np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def may_meet(x: bytes, y: bytes) -> bool:
    """Whether the profiles leave room for the overlap that the sizes ask for: no intersection exceeds the sum of the slots' minima."""
    if not x or not y:
        return True
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    most, total = int(np.minimum(a, b).sum(dtype=np.int64)), int(a.sum(dtype=np.int64) + b.sum(dtype=np.int64))
    return (NUM + DEN) * most >= NUM * total


def probe_length(n):
    """Prefix that meets every set of at least 0.8 n tokens."""
    return n + NUM * -n // DEN + 1


def index_length(n):
    """Prefix that meets every set of at least n tokens."""
    return n + 2 * NUM * -n // (NUM + DEN) + 1


# ---------------------------------------------------------------- first pass: classes and sketch


def slots_for(rows: DataFrame) -> int:
    """Counters of the sketch for a corpus: they follow its size up to a bound, beyond which only the noise of the counts grows."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(max(SLOTS[0], 1 << (int(chars) // 256).bit_length()), SLOTS[1])


def _surveyed(slots: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("profile", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        seen: set[bytes] = set()
        counts = np.zeros(slots, np.uint32)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                sizes, keys, profiles = [], [], []
                for t in utf8(part.column(1)):
                    tokens = shingles(t)
                    key = class_key(tokens)
                    sizes.append(len(tokens))
                    keys.append(key)
                    new = key is not None and key not in seen
                    # a task names the profile of a class once
                    profiles.append(profile(tokens) if new else None)
                    if new:
                        if len(seen) < 1_000_000:
                            seen.add(key)
                        np.add.at(counts, (tokens & np.uint64(slots - 1)).astype(np.int64), np.uint32(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(profiles, pa.binary()), pa.nulls(len(keys), pa.binary())], schema=schema)
        if counts.any():
            data = zlib.compress(np.minimum(counts, 65535).astype("<u2").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:5]), pa.array([data], pa.binary())], schema=schema)

    return run


def _added(slots: int, width: str, last: bool):
    """Adds sketches of ``width`` bytes a counter; the last step gives the frequency classes instead."""

    def run(batches):
        total = np.zeros(slots, np.uint64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(data), width)
        out = frequency_classes(total) if last else np.minimum(total, 0xFFFFFFFF).astype("<u4")
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], ["sketch"])

    return run


def frequency_classes(total: np.ndarray) -> np.ndarray:
    """For each counter 0, or the binary order of magnitude by which it exceeds what other tokens in a slot bring.

    Beyond the slots' median and six robust deviations a count is the token's
    own, however full the sketch is.
    """
    middle = np.median(total)
    excess = total - middle
    usual = max(FREQUENT, 6 * 1.4826 * float(np.median(np.abs(excess))))
    out = np.zeros(len(total), np.uint8)
    for k in range(40):
        out[excess > usual * (1 << k)] = k + 1
    return out


def token_classes(sketches: DataFrame, slots: int) -> np.ndarray:
    """The frequency class of each slot. The tasks' sketches are added on executors, in two steps; one byte a slot reaches the driver."""
    width = max(1, min(16, sketches.sparkSession.sparkContext.defaultParallelism))
    sums = sketches.repartition(width).mapInArrow(trimmed(_added(slots, "<u2", False)), "sketch binary")
    found = sums.repartition(1).mapInArrow(trimmed(_added(slots, "<u4", True)), "sketch binary").first()
    return np.frombuffer(zlib.decompress(found["sketch"]), np.uint8) if found else np.zeros(slots, np.uint8)


def ordered(tokens: np.ndarray, classes: np.ndarray, order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in a global order, and their frequency classes."""
    rank = classes[(tokens & np.uint64(len(classes) - 1)).astype(np.int64)]
    by = tokens if order == 0 else _mixed(tokens * np.uint64(ORDERS[order - 1]))
    # ties keep the order of the tokens themselves, which is the same in every set
    at = np.argsort((rank.astype(np.uint64) << np.uint64(58)) | (by >> np.uint64(6)), kind="stable")
    return tokens[at], rank[at]


# ---------------------------------------------------------------- second pass: prefixes of the first order

EMITTED = "spread long, token long, cls binary, n int, pos int, frequent boolean"


def _prefixes(shared):
    def run(batches):
        classes, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                tokens_, keys, counts, positions, ranks = [], [], [], [], []
                for t in utf8(batch.column(0).slice(i, 512)):
                    own = shingles(t)
                    key = class_key(own)
                    if key is None or key in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    n, p = len(own), probe_length(len(own))
                    tokens, rank = ordered(own, classes)
                    tokens_.append(tokens[:p])
                    ranks.append(rank[:p])
                    keys += [key] * p
                    counts.append(np.full(p, n, np.int32))
                    positions.append(np.arange(p, dtype=np.int32))
                if not keys:
                    continue
                token, frequent = np.concatenate(tokens_), np.concatenate(ranks) > 0
                salt = np.frombuffer(b"".join(k[:8] for k in keys), "<u8")
                spread = np.where(frequent, _mixed(token ^ salt), token)
                yield pa.RecordBatch.from_arrays([pa.array(spread.view(np.int64)), pa.array(token.view(np.int64)), pa.array(keys, pa.binary()), pa.array(np.concatenate(counts)), pa.array(np.concatenate(positions)), pa.array(frequent)], ["spread", "token", "cls", "n", "pos", "frequent"])

    return run


BUCKETED = "a binary, b binary, token long, n int, pos int"


def _passes(na, pa_, nb, pb):
    """Size and positional filters at a common token that is the pair's first one; a is not the larger."""
    least = -(-NUM * (na + nb) // (NUM + DEN))
    return (DEN * na >= NUM * nb) & (pa_ < index_length(na)) & (1 + np.minimum(na - pa_, nb - pb) - 1 >= least)


def _as_they_are(rows: pa.Table):
    cls = rows.column("cls").combine_chunks()
    yield from pa.table([cls, pa.nulls(len(cls), pa.binary()), *(rows.column(c) for c in ("token", "n", "pos"))], names=["a", "b", "token", "n", "pos"]).to_batches(1 << 14)


def _bucketed(most: int):
    """Rows sorted by spread: pairs of small buckets, and the rows of larger and of frequent ones as they are.

    Of a bucket that goes on in the next batch at most ``most`` rows are held;
    a larger one is passed on row by row.
    """

    def run(batches):
        held, opened = None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if opened is not None:
                of = rows.column("token").to_numpy() == opened
                of &= ~rows.column("frequent").to_numpy()
                more = len(of) if of.all() else int(np.flatnonzero(~of)[0])
                yield from _as_they_are(rows.slice(0, more))
                rows, opened = rows.slice(more), opened if more == len(of) else None
            held = None
            if not rows.num_rows:
                continue
            if not rows.column("frequent")[rows.num_rows - 1].as_py():
                token = rows.column("token").to_numpy()
                other = np.flatnonzero(token != token[-1])
                cut = int(other[-1]) + 1 if len(other) else 0
                held, rows = rows.slice(cut), rows.slice(0, cut)
            yield from _buckets(rows, most)
            if held is not None and held.num_rows > most:
                opened = held.column("token")[0].as_py()
                yield from _as_they_are(held)
                held = None
        if held is not None:
            yield from _buckets(held, most)

    return run


def _buckets(rows: pa.Table, most: int):
    if not rows.num_rows:
        return
    token, n, pos = (rows.column(c).to_numpy().astype(np.int64) for c in ("token", "n", "pos"))
    frequent = rows.column("frequent").to_numpy()
    start = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | frequent[1:] | frequent[:-1])))
    size = np.diff(np.append(start, len(token)))
    members = np.repeat(size, size)
    large = frequent | (members > most)
    if large.any():
        yield from _as_they_are(rows.filter(pa.array(large)))
    few = np.flatnonzero((members > 1) & ~large)
    token, n, pos = token[few], n[few], pos[few]
    firsts, seconds = [], []
    for d in range(1, most):
        i = np.flatnonzero(token[d:] == token[:-d])
        if not len(i):
            break
        j = i + d
        swap = n[i] > n[j]
        x, y = np.where(swap, j, i), np.where(swap, i, j)
        keep = _passes(n[x], pos[x], n[y], pos[y]) | (n[x] == n[y]) & _passes(n[y], pos[y], n[x], pos[x])
        firsts.append(few[x[keep]])
        seconds.append(few[y[keep]])
    if firsts and sum(map(len, firsts)):
        cls = rows.column("cls").combine_chunks()
        a, b = cls.take(pa.array(np.concatenate(firsts))), cls.take(pa.array(np.concatenate(seconds)))
        none = pa.nulls(len(a), pa.int32())
        yield from pa.table([a, b, pa.nulls(len(a), pa.int64()), none, none], names=["a", "b", "token", "n", "pos"]).to_batches(1 << 14)


def _index(n: Column) -> Column:
    """``index_length`` as a Column: integer division rounds down for these signs."""
    return n - F.floor((2 * NUM * n + NUM + DEN - 1) / (NUM + DEN)) + 1


def _met(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """``_passes`` for either side as the smaller one, as a Column."""

    def one(n, p, m, q):
        least = F.floor((NUM * (n + m) + NUM + DEN - 1) / (NUM + DEN))
        return (n <= m) & (DEN * n >= NUM * m) & (p < _index(n)) & (F.least(n - p, m - q) >= least)

    return one(na, pa_, nb, pb) | one(nb, pb, na, pa_)


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()


# ---------------------------------------------------------------- verification


def overlap(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets meet the threshold."""
    both, either = overlap(x, y)
    return DEN * both >= NUM * either


def probes(tokens: np.ndarray, classes: np.ndarray) -> list[bytes]:
    """The upper halves of a set's prefix tokens under each order beside the first, sorted."""
    return [np.unique((ordered(tokens, classes, k)[0][: probe_length(len(tokens))] >> np.uint64(32)).astype("<u4")).tobytes() for k in range(1, len(ORDERS) + 1)]


def _probed(shared):
    def run(batches):
        classes = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [probes(shingles(t), classes) for t in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.binary()))], ["cls", "text", "probes"])

    return run


def _chosen(test):
    """The pairs whose two sides pass ``test``."""

    def run(batches):
        for batch in batches:
            good = [test(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def prefixes_meet(x: list[bytes], y: list[bytes]) -> bool:
    """Whether the prefixes meet under every order; equal halves of different tokens only let more pass."""
    return all(len(np.intersect1d(np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4"), assume_unique=True)) for p, q in zip(x, y, strict=True))


def _apart(batches):
    """Pairs with what their profiles say of their distance, at least."""
    for batch in batches:
        least = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = (np.frombuffer(m or b"", np.uint8) for m in (x, y))
            most = int(np.minimum(a, b).sum(dtype=np.int64)) if len(a) and len(b) else 0
            total = int(a.sum(dtype=np.int64) + b.sum(dtype=np.int64))
            least.append(1 - most / (total - most) if len(a) and len(b) else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.float64())], ["a", "b", "least"])


def _compared(batches):
    of = lru_cache(maxsize=256)(shingles)
    for batch in batches:
        found = [overlap(of(x), of(y)) for x, y in zip(utf8(batch.column(2)), utf8(batch.column(3)), strict=True)]
        linked, far = [DEN * i >= NUM * u for i, u in found], [1 - i / max(u, 1) for i, u in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(far, pa.float64())], ["a", "b", "linked", "far"])


def _crowded(rows: DataFrame, *keys: str) -> DataFrame | None:
    """key and parts, for the values of ``keys`` that more than ``DEALT`` rows hold; None where there are none.

    They are counted on executors. As many as ``SMALL`` are broadcast, more
    are joined like any table.
    """
    held = rows.select(F.col(keys[0]).alias("key"))
    for k in keys[1:]:
        held = held.union(rows.select(k))
    counts = held.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > DEALT).select("key", F.ceil(F.col("rows") / DEALT).cast("int").alias("parts"))
    few = counts.limit(SMALL + 1).collect()
    if not few:
        return None
    return F.broadcast(rows.sparkSession.createDataFrame(few, counts.schema)) if len(few) <= SMALL else counts


def _parts(rows: DataFrame, crowded: DataFrame | None, key: str, by: str | None) -> DataFrame:
    """``rows`` with ``part``: one of those of a crowded key, by ``by``; without ``by`` a row for each of them."""
    if crowded is None:
        return rows.withColumn("part", F.lit(0))
    each = rows.join(crowded.withColumnRenamed("key", key), key, "left")
    part = F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int") if by else F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    return each.withColumn("part", part).drop("parts")


def _dealt(rows: DataFrame, lookup: DataFrame, crowded: DataFrame | None, key: str, by: str) -> DataFrame:
    """``rows`` joined to ``lookup`` (one row for each ``key``), the rows of a crowded key in parts by ``by``."""
    if crowded is None:
        return rows.join(lookup, key)
    return _parts(rows, crowded, key, by).join(_parts(lookup, crowded, key, None), [key, "part"]).drop("part")


def _ended(pairs: DataFrame, of: DataFrame, column: str, crowded: DataFrame | None) -> DataFrame:
    """``pairs`` with ``column`` of both classes, as xa and xb; only rows of classes in pairs travel, and no task meets all pairs of one class."""
    own = of.join(_members(pairs), "cls", "left_semi").select("cls", column).dropDuplicates(["cls"])
    for k, other in ("ab", "ba"):
        pairs = _dealt(pairs, own.select(F.col("cls").alias(k), F.col(column).alias(f"x{k}")), crowded, k, other)
    return pairs.select("a", "b", "xa", "xb")


def _texts(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One text of each class in pairs. Their keys are written and counted first: while they are few, no text is shuffled to find them."""
    reps = stored(classes.join(_members(pairs), "cls", "left_semi").select("cls", F.col("rep.text_key").alias("key"), F.col("rep.doc_id").alias("id")), "reps")
    reps = F.broadcast(reps) if reps.count() <= SMALL else reps
    return docs.join(reps, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("cls", "text")


def _measured(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, whether they are linked and their distance, from the texts of the (stored) pairs' classes."""
    texts = stored(_texts(pairs, docs, classes), "texts", compression="zstd")
    found = stored(_ended(pairs, texts, "text", _crowded(pairs, "a", "b")).mapInArrow(trimmed(_compared), "a binary, b binary, linked boolean, far double"), "links")
    released(docs.sparkSession)
    return found


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shared) -> tuple[DataFrame, DataFrame]:
    """``pairs``, stored, and those of them that are similar.

    First the profiles must leave room for enough overlap. Then one text of
    each class left is fetched, and gets its prefixes under the other orders.
    Only where all of these meet do both texts of a pair travel to each other.
    """
    pairs = stored(pairs, "pairs")
    crowded = _crowded(pairs, "a", "b")
    near = stored(_ended(pairs, classes, "profile", crowded).mapInArrow(trimmed(_chosen(may_meet)), "a binary, b binary"), "near")
    texts = stored(_texts(near, docs, classes).mapInArrow(trimmed(_probed(shared)), "cls binary, text string, probes array<binary>"), "texts", compression="zstd")
    met = stored(_ended(near, texts, "probes", crowded).mapInArrow(trimmed(_chosen(prefixes_meet)), "a binary, b binary"), "met")
    links = stored(_ended(met, texts, "text", crowded).mapInArrow(trimmed(_compared), "a binary, b binary, linked boolean, far double").filter("linked").select("a", "b"), "links")
    released(docs.sparkSession)
    return pairs, links


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))


def _candidates(rows: DataFrame):
    """The surveyed rows, the frequency classes of tokens, the classes of equal sets, and the buckets of the first order."""
    spark = rows.sparkSession
    slots = slots_for(rows)
    survey = stored(rows.mapInArrow(trimmed(_surveyed(slots)), "doc_id long, text_key long, n_shingles long, cls binary, profile binary, sketch binary"), "survey", compression="zstd")
    members = survey.filter("sketch IS NULL").drop("sketch", "profile")
    shared = spark.sparkContext.broadcast(token_classes(survey.filter("sketch IS NOT NULL").select("sketch"), slots).tobytes())
    own = survey.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("least"), F.min("profile").alias("profile"))
    classes = stored(own, "classes", compression="zstd")

    emitted = rows.select("text").mapInArrow(trimmed(_prefixes(shared)), EMITTED).repartition("spread").sortWithinPartitions("spread")
    # copies in different tasks send the same rows
    buckets = stored(emitted.select("token", "cls", "n", "pos", "frequent").mapInArrow(trimmed(_bucketed(ALL_PAIRS)), BUCKETED), "buckets", compression="zstd")
    del emitted
    released(spark)
    return members, shared, classes, buckets


def _large(buckets: DataFrame) -> DataFrame:
    return stored(buckets.filter("b IS NULL").select("token", F.col("a").alias("cls"), F.col("n").cast("long"), F.col("pos").cast("long")).distinct(), "large", compression="zstd")


def _blockwise(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Two sides of a self-join on (token, part) in which every row meets all of its token, dealt by ``DEALT`` rows."""
    crowded = _crowded(rows, "token")
    return _parts(rows, crowded, "token", by), _parts(rows, crowded, "token", None)


def _between(large: DataFrame, crowded: DataFrame | None, roots: DataFrame, tried: DataFrame, rows: DataFrame, classes: DataFrame, shared, links: DataFrame) -> DataFrame:
    """Links between the components that large buckets still hold, by the triangle inequality of Jaccard distance."""
    edge, slack = 1 - NUM / DEN, 1e-9
    placed = large.join(roots, F.col("cls") == F.col("node"), "left").select("token", "cls", "n", "pos", F.coalesce("root", "cls").alias("root"))
    torn = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    placed = stored(_dealt(placed, torn, crowded, "token", "cls"), "placed", compression="zstd")
    groups = stored(placed.groupBy("token", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("pos") < _index(F.col("n"))).alias("early"), F.count("*").alias("size")), "groups")
    left, right = _blockwise(groups, "root")
    left, right = left.select("token", "part", F.col("root").alias("a"), "lo", "hi", "early"), right.select("token", "part", F.col("root").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("early").alias("early2"))
    sizes = (DEN * F.col("hi") >= NUM * F.col("lo2")) & (DEN * F.col("hi2") >= NUM * F.col("lo")) & (F.col("early") | F.col("early2"))
    tops = stored(left.join(right, ["token", "part"]).filter((F.col("a") < F.col("b")) & sizes).select("a", "b").distinct(), "tops")
    if tops.isEmpty():
        return links

    # how far each row of these components lies from its root
    inner = placed.filter("cls <> root").select("cls", "root").distinct()
    inner = _dealt(inner, _members(tops).withColumnRenamed("cls", "root"), _crowded(inner, "root"), "root", "cls")
    rays = _measured(stored(inner.select(F.col("cls").alias("a"), F.col("root").alias("b")), "inner"), rows, classes).select(F.col("a").alias("cls"), F.col("b").alias("root"), "far")
    radius = stored(rays.groupBy(F.col("root").alias("of")).agg(F.max("far").alias("radius")), "radius")

    def reaching(pairs, distance):
        for k in "ab":
            pairs = pairs.join(radius.select(F.col("of").alias(k), F.col("radius").alias(f"r{k}")), k, "left").fillna(0.0, [f"r{k}"])
        return pairs.filter(F.col(distance) <= edge + F.col("ra") + F.col("rb") + slack)

    near = stored(reaching(_ended(tops, classes, "profile", _crowded(tops, "a", "b")).mapInArrow(trimmed(_apart), "a binary, b binary, least double"), "least").select("a", "b"), "near")
    known = _measured(near, rows, classes)
    links = links.union(known.filter("linked").select("a", "b"))
    # of the others the component with fewer rows is sent to the rows of the other one
    weight = groups.groupBy(F.col("root").alias("of")).agg(F.sum("size").alias("size"))
    open_ = reaching(known.filter("NOT linked"), "far")
    for k in "ab":
        open_ = open_.join(weight.select(F.col("of").alias(k), F.col("size").alias(f"w{k}")), k)
    few = F.col("wa") < F.col("wb")
    open_ = stored(open_.select(F.when(few, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(few, F.col("a")).otherwise(F.col("b")).alias("b"), F.col("far").alias("gap"), F.when(few, F.col("rb")).otherwise(F.col("ra")).alias("reach")), "open")
    if open_.isEmpty():
        return links

    own = placed.join(rays, ["cls", "root"], "left").fillna(0.0, ["far"])
    y = own.select("token", F.col("root").alias("b"), F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("far").alias("fy"))
    sent = open_.join(y, "b").filter(F.col("gap") <= edge + F.col("reach") + F.col("fy") + slack)
    x = own.select("token", F.col("root").alias("a"), F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("far").alias("fx"))
    met = _parts(sent, crowded, "token", None).join(_parts(x, crowded, "token", "x"), ["token", "a", "part"])
    met = met.filter((F.col("gap") <= edge + F.col("fx") + F.col("fy") + slack) & _met(F.col("nx"), F.col("px"), F.col("ny"), F.col("py")))
    untried = _pairs(met.select(F.col("x").alias("a"), F.col("y").alias("b"))).join(tried, ["a", "b"], "left_anti")
    return links.union(_verified(untried, rows, classes, shared)[1])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and text_key (the text's hash) for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and are linked with nothing.
    ``component_id`` is the smallest id among the rows reachable by links
    (ids may repeat; rows without id never give the name, unless all of a
    component lack one). Other columns are ignored; an empty table gives no
    rows. A text is held whole, with eight bytes for each of its words; there
    is no limit to its length.
    """
    rows = _keyed(docs)
    members, shared, classes, buckets = _candidates(rows)
    large = _large(buckets)
    crowded = _crowded(large, "token")
    heads = large.groupBy("token").agg(F.min(F.struct("pos", "n", "cls")).alias("head"))
    star = _dealt(large, heads, crowded, "token", "cls").filter((F.col("cls") != F.col("head.cls")) & _met(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos")))
    pairs, links = _verified(_pairs(buckets.filter("b IS NOT NULL").select("a", "b").union(star.select(F.col("cls").alias("a"), F.col("head.cls").alias("b")))), rows, classes, shared)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    more = _between(large, crowded, roots, pairs, rows, classes, shared, links)
    if more is not links:
        roots = components(more.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # only classes that are linked have another name than their own least id
    linked = roots.select(F.col("node").alias("cls"), "root").union(roots.select("root", "root").distinct()).join(classes.select("cls", "least"), "cls")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = _dealt(linked.select("cls", "root"), names, _crowded(roots, "root"), "root", "cls").select("cls", "component_id")
    own = classes.select("cls", "least").join(of, "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id"))
    # copies of one text are dealt over tasks, too
    worded = members.filter("cls IS NOT NULL")
    named_rows = _dealt(worded, own, _crowded(worded, "cls"), "cls", "doc_id").select("doc_id", "n_shingles", "component_id", "text_key")
    return named_rows.union(members.filter("cls IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key"))


def all_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All verified pairs (a, b) of classes, each once, and doc_id, text_key, n_shingles, cls and n_links for every row of ``docs``.

    Rows of one class have equal sets and are linked with each other and with
    all rows of the classes that theirs is paired with; ``n_links`` counts
    them, without the row itself. Nothing is left out inside a component, so
    the work grows with the square of a group of near copies, as the pairs do;
    a bucket's pairs are dealt over tasks by ``DEALT`` of its rows.
    """
    rows = _keyed(docs)
    members, shared, classes, buckets = _candidates(rows)
    left, right = _blockwise(_large(buckets), "cls")
    met = left.select("token", "part", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa")).join(right.select("token", "part", F.col("cls").alias("b"), "n", "pos"), ["token", "part"])
    met = met.filter((F.col("a") < F.col("b")) & _met(F.col("na"), F.col("pa"), F.col("n"), F.col("pos")))
    links = _verified(_pairs(buckets.filter("b IS NOT NULL").select("a", "b").union(met.select("a", "b"))), rows, classes, shared)[1]
    copies = members.filter("cls IS NOT NULL").groupBy(F.col("cls").alias("key")).agg(F.count("*").alias("copies"))
    ends = links.select(F.col("a").alias("at"), F.col("b").alias("key")).union(links.select("b", "a"))
    linked = ends.join(copies, "key").groupBy(F.col("at").alias("key")).agg(F.sum("copies").alias("others"))
    own = copies.join(linked, "key", "left").select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    counted = members.join(own, F.col("cls") == F.col("key"), "left")
    return links, counted.select("doc_id", "text_key", "n_shingles", "cls", F.coalesce("links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component; repeated rows count once.

    Texts without words all stay; other columns may have any names. Of a component whose rows all lack ids
    every row stays.
    """
    found = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = found.select("doc_id", "text_key").distinct().alias("heads")
    kept = docs.alias("docs").join(heads, F.col("docs.doc_id").cast("long").eqNullSafe(F.col("heads.doc_id")) & (F.xxhash64(F.col("docs.text").cast("string")) == F.col("heads.text_key")), "left_semi")
    ids = docs.groupBy("doc_id").count().filter(F.col("doc_id").isNotNull() & (F.col("count") > 1))
    return kept if ids.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
