"""Removal of repeated 200-byte strings, by a sparse suffix array that is sorted in a distributed merge.

Sparse suffixes. Every 200-byte window names an anchor: the position of the
least hash of its 64-grams, leftmost first. Equal windows name the same place,
so only suffixes at anchors have to be sorted, and of those only suffixes
whose 64-gram occurs at more than one place. A suffix stands for the windows
in a row that share its anchor: it is the text from the anchor to the end of
their last one (at most 200 bytes), followed by the bytes before the anchor,
backwards (at most 136).

Merge sort. Every task sorts its suffixes into a run and writes it front-coded
(shared prefix length and rest). The first keys of the runs' blocks are sorted
and one in so many is a splitter, whole, so a range holds about as many
suffixes however long the prefixes are that they share. Splitters cut the
runs (beyond ``FAN`` of them in two levels, the second from a table), the
pieces are exchanged, and each range merges its pieces with a loser tree that carries
prefix lengths: of two suffixes the one that shares more with the last output
is smaller, and only at equal lengths are bytes compared, from there on. The
merged order and its prefix lengths show which windows are equal: those whose
suffixes share the part right of the anchor, and the same bytes left of it.
A group of suffixes that a splitter may have cut reports its windows by hash,
and these meet in one more aggregation. What repeats of a suffix is then one
span, and each place of the suffix takes it from one row.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.common import released, stored, table, trimmed, utf8

#: Bytes of a string that counts, of the grams that anchor it, and grams in it.
LENGTH, GRAM = 200, 64
GRAMS = LENGTH - GRAM + 1
#: Windows that are scanned at once, bytes of a run, suffixes in a block, and in a range.
STRETCH, RUN_BYTES, BLOCK, RANGE = 1 << 20, 48 << 20, 512, 40_000
#: Splitters that a task may hold, and ranges whose splitters are chosen in one task.
FAN, CHOSEN = 2048, 64
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h, n = (data.astype(np.uint64) + np.uint64(1)) * _A, 1
    while n < GRAM:
        h = _mixed(h[:-n] * _C + h[n:])
        n *= 2
    return h


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchored(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, first window, last window and anchor of each row of windows with one anchor, in text order."""
    data, parts = np.frombuffer(text, np.uint8), []
    for o in range(0, len(data) - LENGTH + 1, STRETCH):
        h = _gram_hashes(data[o : o + STRETCH + LENGTH - 1])
        low = np.uint64((1 << 21) - 1)
        at = (_window_least((h & ~low) | np.arange(len(h), dtype=np.uint64), GRAMS) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        parts.append((h[at[first]], first + o, last + o, at[first] + o))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _grams(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            found = [anchored(t)[0] for t in utf8(batch.column(0).slice(i, 512))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["gram"])


def _places(batches):
    """gram, text id and place: first window << 16 | windows - 1 << 8 | anchor - first window. A text is listed once a task."""
    seen: set[bytes] = set()
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            grams, ids, places = [], [], []
            for tid, t in zip(batch.column(0).slice(i, 512).to_pylist(), utf8(batch.column(1).slice(i, 512)), strict=True):
                if len(t) < LENGTH or tid in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(tid)
                g, first, last, at = anchored(t)
                grams.append(g)
                places.append(first << 16 | (last - first) << 8 | (at - first))
                ids += [tid] * len(g)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(ids, pa.binary()), pa.array(np.concatenate(places))], ["gram", "tid", "place"])


# ---------------------------------------------------------------- runs

RUNS = "first binary, n int, lcp binary, size binary, rest binary, meta binary, uid binary, tid binary, at long"
_META = np.dtype([("uid", "S16"), ("right", "<u2"), ("left", "<u2"), ("weight", "<u4")])


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that share their first ``start`` bytes."""
    most, i = min(len(a), len(b)), start
    while i + 32 <= most and a[i : i + 32] == b[i : i + 32]:
        i += 32
    while i < most and a[i] == b[i]:
        i += 1
    return i


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Shared prefix lengths, sizes and rests of sorted keys; the first key is whole."""
    lcp = np.zeros(len(keys), np.uint16)
    for i in range(1, len(keys)):
        lcp[i] = common_prefix(keys[i - 1], keys[i])
    return lcp, np.array([len(k) for k in keys], np.uint16), b"".join(k[n:] for k, n in zip(keys, lcp.tolist(), strict=True))


def decoded(lcp: np.ndarray, size: np.ndarray, rest: bytes) -> list[bytes]:
    keys, at, last = [], 0, b""
    for n, s in zip(lcp.tolist(), size.tolist(), strict=True):
        last = last[:n] + rest[at : at + s - n]
        at += s - n
        keys.append(last)
    return keys


def _runs(batches, block: int = BLOCK):
    schema = pa.schema([("first", pa.binary()), ("n", pa.int32()), ("lcp", pa.binary()), ("size", pa.binary()), ("rest", pa.binary()), ("meta", pa.binary()), ("uid", pa.binary()), ("tid", pa.binary()), ("at", pa.int64())])
    pool: dict[bytes, list] = {}
    held, seen = 0, set()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            uids, tids, ats = [], [], []
            for tid, t, places, copies in zip(part.column(0).to_pylist(), utf8(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if tid in seen:
                    continue
                if copies > 1 and len(seen) < 1_000_000:
                    seen.add(tid)
                for place in places:
                    first = place >> 16
                    last, anchor = first + (place >> 8 & 255), first + (place & 255)
                    uid = hashlib.blake2b(t[first : last + LENGTH], digest_size=15, salt=bytes([anchor - first])).digest() + b"\x01"
                    own = pool.get(uid)
                    if own is None:
                        right, left = t[anchor : last + LENGTH], t[first:anchor][::-1]
                        pool[uid] = [right + left, len(right), len(left), min(copies, 2)]
                        held += len(right) + len(left) + 200
                    else:
                        own[3] = 2
                    uids.append(uid)
                    tids.append(tid)
                    ats.append(first)
            if uids:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(uids), f.type) for f in list(schema)[:6]), pa.array(uids, pa.binary()), pa.array(tids, pa.binary()), pa.array(ats, pa.int64())], schema=schema)
            if held > RUN_BYTES:
                yield from _blocks(pool, schema, block)
                pool, held = {}, 0
    yield from _blocks(pool, schema, block)


def _blocks(pool: dict[bytes, list], schema: pa.Schema, block: int):
    run = sorted((own[0], uid, *own[1:]) for uid, own in pool.items())
    for i in range(0, len(run), block):
        part = run[i : i + block]
        lcp, size, rest = front_coded([x[0] for x in part])
        meta = np.array([x[1:] for x in part], _META)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part[0][0], len(part), lcp.tobytes(), size.tobytes(), rest, meta.tobytes(), None, None, None), schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- exchange and merge

PIECES = "range long, run string, block long, lcp binary, size binary, rest binary, meta binary"
_PIECES = pa.schema([("range", pa.int64()), ("run", pa.string()), ("block", pa.int64()), *((c, pa.binary()) for c in ("lcp", "size", "rest", "meta"))])


def _every(step: int, coarse: int):
    """Of sorted keys one in ``step``, and whether it is one in ``coarse`` of these; of equal keys one."""

    def run(batches):
        at, n, last = 0, 0, None
        for batch in batches:
            keys, marks = [], []
            for key in batch.column(0).to_pylist():
                if at % step == 0 and key != last:
                    keys.append(key)
                    marks.append(n % coarse == 0)
                    n, last = n + 1, key
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(marks, pa.bool_())], ["key", "coarse"])

    return run


def _pieces_of(block: tuple, splitters: list[bytes]):
    """The parts of a front-coded block (lcp, size, rest, meta) between splitters, each with the number of splitters up to it."""
    lcp, size, rest, meta = block
    lcp, size, meta = np.frombuffer(lcp, np.uint16), np.frombuffer(size, np.uint16), np.frombuffer(meta, _META)
    keys = decoded(lcp, size, rest)
    lo, hi = _range(splitters, keys[0]), _range(splitters, keys[-1])
    at = 0
    for r in range(lo, hi + 1):
        a, b = at, len(keys)
        while r < hi and a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if keys[m] < splitters[r] else (a, m)
        end = a if r < hi else len(keys)
        if at < end:
            own = lcp[at:end].copy()
            own[0] = 0
            sizes = size[at:end]
            skip = int((size[:at].astype(np.int64) - lcp[:at]).sum())
            start = skip + int(sizes[0]) - int(lcp[at])
            took = int((sizes[1:].astype(np.int64) - own[1:]).sum())
            yield r, (own.tobytes(), sizes.tobytes(), keys[at] + rest[start : start + took], meta[at:end].tobytes())
        at = end


def _cut(shared):
    """Cuts blocks at the splitters. Blocks of one partition file order are runs in order of their first keys."""

    def run(batches):
        from pyspark import TaskContext

        task, block = str(TaskContext.get().partitionId()), 0
        for batch in batches:
            rows = []
            for own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows += [(r, task, block, *part) for r, part in _pieces_of(own, shared.value)]
                block += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def _cut_again(batches):
    """Cuts pieces at the splitters that lie within their range; ranges are numbered anew."""
    for batch in batches:
        rows = []
        for r, task, block, lcp, size, rest, meta, inner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(r << 24 | k, task, block, *part) for k, part in _pieces_of((lcp, size, rest, meta), inner or [])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def _placed(shared):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_range(shared.value, k) for k in batch.column(0).to_pylist()], pa.int64()), batch.column(0)], ["range", "key"])

    return run


def ranged(blocks: DataFrame, per_range: int, block: int, fan: int) -> DataFrame:
    """The pieces of all runs, in ranges of about ``per_range`` suffixes.

    At most some ``fan`` splitters reach the driver and the tasks; where there
    are more, the rest come from a table, each to the pieces of its range.
    """
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n")).first()[0] or 0
    ranges = -(-total // per_range)
    tasks = max(1, -(-ranges // CHOSEN))
    firsts = blocks.select("first").repartitionByRange(tasks, "first").sortWithinPartitions("first")
    keys = stored(firsts.mapInArrow(_every(max(1, per_range // block), max(1, -(-ranges // fan))), "key binary, coarse boolean"), "splitters")
    shared = spark.sparkContext.broadcast(sorted(bytes(r["key"]) for r in keys.filter("coarse").select("key").collect()))
    pieces = blocks.select("lcp", "size", "rest", "meta").mapInArrow(trimmed(_cut(shared)), PIECES)
    if ranges <= fan:
        return pieces
    inner = keys.filter("NOT coarse").select("key").mapInArrow(_placed(shared), "range long, key binary").groupBy("range").agg(F.array_sort(F.collect_list("key")).alias("inner"))
    return pieces.join(inner, "range", "left").select(*[f.name for f in _PIECES], "inner").mapInArrow(trimmed(_cut_again), PIECES)


def _range(splitters: list[bytes], key: bytes) -> int:
    """Number of splitters that are not above the key."""
    a, b = 0, len(splitters)
    while a < b:
        m = (a + b) // 2
        a, b = (m + 1, b) if splitters[m] <= key else (a, m)
    return a


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs, each with its shared prefix lengths; gives (run, place) in order and the output's prefix lengths.

    A loser tree over the runs. A contender's length is what it shares with
    the last output; a run's next key brings it from the front coding.
    """
    runs_n = len(runs)
    leaves = 1 << max(0, runs_n - 1).bit_length()
    keys, lens = [r[0] for r in runs], [r[1] for r in runs]
    place, shared = [0] * leaves, [0] * leaves
    loser = [-1] * leaves

    def better(a: int, b: int) -> int:
        """The run whose head is smaller; sets what the other shares with it."""
        if a < 0 or a >= runs_n or place[a] >= len(keys[a]):
            return b
        if b < 0 or b >= runs_n or place[b] >= len(keys[b]):
            return a
        if shared[a] != shared[b]:
            return a if shared[a] > shared[b] else b
        x, y = keys[a][place[a]], keys[b][place[b]]
        h = common_prefix(x, y, shared[a])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            shared[b] = h
            return a
        shared[a] = h
        return b

    winner = list(range(leaves)) if leaves > 1 else [0]
    level = winner
    node = leaves
    tree = [-1] * (2 * leaves)
    tree[leaves:] = level
    for node in range(leaves - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        w = better(a, b)
        tree[node], loser[node] = w, b if w == a else a
    top = tree[1] if leaves > 1 else 0
    order, lcp = [], []
    for _ in range(sum(map(len, keys))):
        i = place[top]
        order.append((top, i))
        lcp.append(shared[top])
        place[top] = i + 1
        if i + 1 < len(keys[top]):
            shared[top] = lens[top][i + 1]
        node = (leaves + top) >> 1
        while node:
            other = loser[node]
            w = better(top, other)
            if w != top:
                loser[node], top = top, other
            node >>= 1
    return order, lcp


FOUND = "uid binary, low int, high int, window long, times int"


def _resolved(keys: list[bytes], lcp: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, ...]:
    """Repeated windows of sorted distinct suffixes, and windows of groups that may go on in another range.

    Five arrays (suffix, low, high, window hash, times): the windows low to
    high of a suffix, counted from its first, repeat (times is 0), or the one
    window low occurs ``times`` times here and may occur in another range.
    """
    count = len(keys)
    right, left, weight = meta["right"].astype(np.int64), meta["left"].astype(np.int64), meta["weight"].astype(np.int64)
    width = LENGTH - GRAM
    before = np.zeros((width, count), np.uint8)
    for i, k in enumerate(keys):
        before[: len(k) - right[i], i] = np.frombuffer(k, np.uint8)[right[i] :]
    # what each suffix shares with the first and with the last of the range: only what reaches an end can go on beyond it
    reach = np.full(count, LENGTH, np.int64)
    if count > 1:
        down, up = np.minimum.accumulate(lcp[1:]), np.minimum.accumulate(lcp[:0:-1])[::-1]
        reach[1:-1] = np.maximum(down[:-1], up[1:])
    ends = np.flatnonzero(reach >= GRAM)
    place = np.zeros(count, np.int64)
    place[ends] = np.arange(len(ends))
    # hashes of what stands right of the anchor, for the groups at the ends alone
    after = np.zeros((LENGTH, len(ends)), np.uint8)
    for j, i in enumerate(ends.tolist()):
        after[: right[i], j] = np.frombuffer(keys[i], np.uint8)[: right[i]]
    sums = np.zeros((LENGTH + 1, len(ends)), np.uint64)
    for t in range(LENGTH):
        sums[t + 1] = sums[t] * _A + (after[t].astype(np.uint64) + np.uint64(1))
    hit = np.zeros((width + 1, count), bool)
    parts: list[tuple] = []
    h = np.zeros(count, np.uint64)
    for x in range(width + 1):
        if x:
            h = h * _C + (before[x - 1].astype(np.uint64) + np.uint64(1))
        own = np.flatnonzero((LENGTH - right <= x) & (x <= left))
        if not len(own):
            continue
        group = np.cumsum(lcp < LENGTH - x)[own].astype(np.uint64)
        key = _mixed(group * _A + h[own] * _B)
        _, at, times = np.unique(key, return_inverse=True, return_counts=True)
        hit[x, own] = (times[at] > 1) | (weight[own] > 1)
        e = own[reach[own] >= LENGTH - x]
        if len(e):
            whole = _mixed(_mixed(sums[LENGTH - x, place[e]] * _B + h[e]) + np.uint64(x * int(_A) & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
            parts.append((e, left[e] - x, left[e] - x, whole, weight[e]))
    step = np.diff(np.vstack([np.zeros((1, count), bool), hit, np.zeros((1, count), bool)]).astype(np.int8), axis=0)
    (of, start), (_, stop) = np.nonzero((step > 0).T), np.nonzero((step < 0).T)
    none = np.zeros(len(of), np.int64)
    parts.append((of, left[of] - (stop - 1), left[of] - start, none, none))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _merged(table_: pa.Table) -> pa.Table:
    pieces: dict[str, list] = {}
    for row in table_.select(["run", "block", "lcp", "size", "rest", "meta"]).to_pylist():
        pieces.setdefault(row["run"], []).append(row)
    runs, metas = [], []
    for own in pieces.values():
        keys, lens, meta, last = [], [], [], b""
        for row in sorted(own, key=lambda r: r["block"]):
            lcp = np.frombuffer(row["lcp"], np.uint16)
            more = decoded(lcp, np.frombuffer(row["size"], np.uint16), row["rest"])
            if keys and more[0] < last:  # the task began another run
                runs.append((keys, lens))
                metas.append(np.concatenate(meta))
                keys, lens, meta, last = [], [], [], b""
            lens += [common_prefix(last, more[0]), *lcp[1:].tolist()]
            keys += more
            last = more[-1]
            meta.append(np.frombuffer(row["meta"], _META))
        runs.append((keys, lens))
        metas.append(np.concatenate(meta))
    order, shared = merge_runs(runs)
    kept: list[tuple[int, int]] = []
    lcp, weight, names, low = [], [], {}, 1 << 30
    for (r, i), n in zip(order, shared, strict=True):
        m = metas[r][i]
        low = min(low, n)
        if (own := names.get(m["uid"])) is not None:
            weight[own] += int(m["weight"])
            continue
        names[m["uid"]] = len(kept)
        kept.append((r, i))
        lcp.append(low)
        weight.append(int(m["weight"]))
        low = 1 << 30
    meta = np.array([metas[r][i] for r, i in kept], _META)
    meta["weight"] = np.minimum(weight, 2)
    lcp[0] = 0
    of, low, high, window, times = _resolved([runs[r][0][i] for r, i in kept], np.array(lcp, np.int64), meta)
    uids = pa.array(meta["uid"].tolist(), pa.binary()).take(pa.array(of))
    seen = times == 0
    return pa.table([uids, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(window, mask=seen), pa.array(times.astype(np.int32), mask=seen)], names=["uid", "low", "high", "window", "times"])


# ---------------------------------------------------------------- the operator

SPANS = "array<struct<a:long,b:long>>"


def repeated_spans(rows: DataFrame) -> DataFrame:
    """tid, copies and covered byte spans [a, b) of every distinct text of ``rows`` (tid, text)."""
    grams = rows.select("text").mapInArrow(trimmed(_grams), "gram long").groupBy("gram").agg(F.count("*").alias("times")).filter("times > 1").select("gram")
    grams = stored(grams, "grams")
    places = rows.select("tid", "text").mapInArrow(trimmed(_places), "gram long, tid binary, place long").join(grams, "gram").groupBy("tid").agg(F.collect_set("place").alias("places"))
    copies = stored(rows.groupBy("tid").agg(F.count("*").alias("copies")), "copies")
    places = stored(places.join(copies, "tid").select("tid", F.array_sort("places").alias("places"), "copies"), "places", compression="zstd")
    released(rows.sparkSession)
    # copies of one text beyond the first in a task add nothing; a text that only repeats as a whole is listed too
    block = min(BLOCK, max(1, RANGE // 8))
    runs = stored(rows.join(places, "tid").select("tid", "text", "places", "copies").mapInArrow(trimmed(partial(_runs, block=block)), RUNS), "runs", compression="zstd")
    released(rows.sparkSession)
    pieces = ranged(runs.filter("n IS NOT NULL"), RANGE, block, FAN)
    found = stored(pieces.groupBy("range").applyInArrow(_merged, FOUND), "found", compression="zstd")
    cut = found.filter("window IS NOT NULL")
    again = cut.groupBy("window").agg(F.sum("times").alias("all")).filter("all > 1").select("window")
    hits = found.filter("window IS NULL").select("uid", "low", "high").union(cut.join(again, "window").select("uid", "low", "high"))
    # windows of one suffix start less than a window's length apart, so the first to the last that repeat cover one span: a place meets one row
    hits = stored(hits.groupBy("uid").agg(F.min("low").alias("low"), F.max("high").alias("high")), "hits", compression="zstd")
    listed = runs.filter("n IS NULL").select("uid", "tid", "at")
    spans = listed.join(hits, "uid").groupBy("tid").agg(F.collect_set(F.struct((F.col("at") + F.col("low")).alias("a"), (F.col("at") + F.col("high") + LENGTH).alias("b"))).alias("spans"))
    out = copies.join(spans, "tid", "left").select("tid", "copies", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return stored(out, "spans", compression="zstd")


def cut_out(text: bytes, spans: list[tuple[int, int]], copies: int) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the maximal runs they form."""
    if copies > 1 and len(text) >= LENGTH:
        return b"", len(text), 1
    kept, removed, runs, at = [], 0, 0, 0
    for a, b in sorted(spans):
        if a > at or not runs:
            kept.append(text[at:a])
            runs += 1
            at = a
        if b > at:
            removed += b - at
            at = b
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def _kept(width: int, as_text: bool):
    """The first ``width`` columns, what is kept of the text after them (as text without the characters that a cut splits, or as bytes), and counts."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                text, copies, spans = part.columns[width:]
                rows = [cut_out(t, [(s["a"], s["b"]) for s in own], n) + (len(t),) for t, n, own in zip(utf8(text), copies.to_pylist(), spans.to_pylist(), strict=True)]
                kept, removed, runs, size = zip(*rows, strict=True)
                left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:width], left, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], [*part.schema.names[:width], "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def _cut_rows(docs: DataFrame, carry: list, as_text: bool = False) -> DataFrame:
    """The columns of ``carry`` as c0, c1 and so on, kept, n_bytes, n_removed and n_spans."""
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tid", F.unhex(F.md5("text")))
    spans = repeated_spans(rows.select("tid", "text"))
    names = rows.columns[: len(carry)]
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{kinds}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long"
    return rows.join(spans, "tid").select(*names, "text", "copies", "spans").mapInArrow(trimmed(_kept(len(carry), as_text)), schema)


def remove_repeats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the ``carry`` columns), kept (bytes), n_bytes, n_removed and n_spans for every row of ``docs``.

    A null text is empty and stays so; texts under 200 bytes are never
    touched; a text that occurs in two rows repeats itself there and is
    removed whole. Ids may be null or repeat and play no part. An empty table
    gives no rows. Cuts may fall within a character. Texts of any length are
    scanned whole, by ``STRETCH`` bytes at a time.
    """
    carry = carry or ["doc_id"]
    found = _cut_rows(docs, [F.col(c) for c in carry])
    return found.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]).alias("row"), "kept", "n_bytes", "n_removed", "n_spans")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeats cut out of ``text``; a null text stays null, a character that a cut splits goes."""
    others = [c for c in docs.columns if c != "text"]
    found = _cut_rows(docs, [F.col("text").isNull(), *[F.col(c) for c in others]], as_text=True)
    at = {c: F.col(f"c{i + 1}").alias(c) for i, c in enumerate(others)}
    return found.select(*[F.when(~F.col("c0"), F.col("kept")).alias("text") if c == "text" else at[c] for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
