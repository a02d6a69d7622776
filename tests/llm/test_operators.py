"""Corpus operators on small tables with nulls, blanks, copies and odd columns, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelight.llm import chat, language_id, media, mixing, ngram_join, packing, quality_model, quality_rules, queries, suffix_dedup, token_files
from sievelight.llm.common import chunk_encoder, shared_dir, vocabulary
from tests.oracle import compare

SCHEMA = "doc_id long, text string, lang string, source string, size long, cls string"


def _texts(seed: int = 3) -> list:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéüñ") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(160)) for _ in range(12)]
    near = []
    for k in range(90):  # a large group of near copies
        w = base[0].split()
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = word()
        near.append(" ".join(w))
    passage = " ".join(word() for _ in range(70))
    shared = [f"{' '.join(word() for _ in range(40))} {passage} {' '.join(word() for _ in range(40))}" for _ in range(50)]
    return [None, "", " \n ", "a", "One two", "one TWO", "and " * 120, *base, *base[1:4], *near, *shared, "x" * 900, "é" * 300, "İstanbul don't <|endoftext|> ™,  J̌ ok."]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", None, "de")[i % 3], ("b", "a", None, "c")[i % 4], 1, "z") for i, t in enumerate(_texts())]
    return spark.createDataFrame([*rows, (5, "one TWO", None, None, 1, "z"), (None, "no id at all", None, "a", None, None)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_encoder_equals_library():
    e = chunk_encoder(vocabulary())
    for t in [x or "" for x in _texts()]:
        assert e.encode([t.encode()])[0] == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files(spark, docs, rows):
    path = shared_dir(spark, "t")
    token_files.write_tokens(docs, path, vocabulary(), 2, partitions=4)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        at += r["n_tokens"]
    assert len(got) == len(rows) and [r["doc_id"] for r in got][1:] == sorted(d for d, _ in rows if d is not None)
    assert token_files.read_tokens(spark, path).select("n_tokens").count() == len(rows)
    library = chunk_encoder(vocabulary()).tokenizer
    want = Counter((d, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for d, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want


def test_media_round_trip(spark, docs, rows):
    path = shared_dir(spark, "t")
    media.write_media(docs, path)
    got = Counter((r["doc_id"], r["payload_sha256"], r["n_bytes"], r["tail_crc32"]) for r in media.media_features(media.read_media(spark, path, rangeMb="1")).collect())
    want = Counter()
    for d, t in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want[d, hashlib.sha256(p).hexdigest(), len(b), zlib.crc32(p[-32:])] += 1
    assert got == want


def test_media_ranges_and_retries(spark, docs, rows, monkeypatch):
    """Every member is read once, whatever the ranges; one that fails is read again by itself, one that stays damaged stops the read."""
    path = shared_dir(spark, "t").removeprefix("file://")
    docs.sparkSession.dataSource.register(media.ArchiveSource)
    images = docs.select("doc_id", "text").mapInArrow(media._imaged, "member string, comment string, media binary")
    images.write.format("sievelight_archive").option("archiveMb", "0.02").mode("append").save(path)
    reader = media.ArchiveReader({"path": path, "rangeMb": "0.004"})
    parts = reader.partitions()
    real, reads = media._open, Counter()

    class Flaky:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            return getattr(self.store, name)

        def open_input_file(self, at):
            reads[at] += 1
            if not at.endswith(".idx") and reads[at] % 3 == 1:
                raise OSError("lost")
            return self.store.open_input_file(at)

    monkeypatch.setattr(media, "_open", lambda at: (lambda store, root: (Flaky(store), root))(*real(at)))
    monkeypatch.setattr(media.time, "sleep", lambda _: None)
    got = Counter(bytes(m) for p in parts for b in reader.read(p) for m in b.column(2).to_pylist())
    want = Counter(media.png_encode(media.padded((t or "").encode())) for _, t in rows)
    assert got == want and len(parts) > 4 and len({p.path for p in parts}) > 1
    target = next(p for p in parts if list(reader.read(p)))
    with open(f"{path}/{target.path}", "r+b") as f:
        f.seek(60)
        f.write(b"\x00" * 40)
    with pytest.raises(OSError):
        list(reader.read(media.Range(target.path, 0, 1)))


def _grouped(rows):
    """doc_id, n_shingles and component_id of all rows, by comparing all of them."""
    sets = []
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    group = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        group[find(i)].append(d)
    return Counter((d, len(s), min((x for x in group[find(i)] if x is not None), default=None)) for i, (d, s) in enumerate(sets))


def _found(docs):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect())


def test_near_duplicates(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 8)
    monkeypatch.setattr(ngram_join, "ALL_PAIRS", 4)
    assert _found(docs) == _grouped(rows)


def _templated(rng, n, sections=6, words=60):
    body = [" ".join(f"s{k}w{i}" for i in range(words)) for k in range(sections)]
    return [f"{' '.join(body[k] for k in rng.sample(range(sections), 2))} own{i}" for i in range(n)]


def test_components_in_one_bucket(spark, monkeypatch):
    """Large buckets that hold many components: boilerplate, walks of small edits whose ends are far apart, and copies of them."""
    for name, value in (("FREQUENT", 4), ("ALL_PAIRS", 2), ("DEALT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    rng, texts = random.Random(11), []
    for k in range(3):
        w = [f"{k}v{i}" for i in range(100)]
        for _ in range(40):
            texts.append(" ".join(w))
            for _ in range(rng.choice((1, 1, 2, 4, 9))):
                w[rng.randrange(100)] = rng.choice(("and", f"n{rng.randrange(10**6)}"))
    texts += _templated(rng, 90)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert _found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == _grouped(rows)


def test_pairs_grow_with_the_documents(spark, monkeypatch):
    """Documents of shared sections and a word of their own: what is compared grows as their number does."""
    monkeypatch.setattr(ngram_join, "ALL_PAIRS", 4)
    seen = []
    measured = ngram_join._measured
    monkeypatch.setattr(ngram_join, "_measured", lambda pairs, *rest: (seen.append(pairs.count()), measured(pairs, *rest))[1])
    counts = []
    for n in (400, 1600):
        seen.clear()
        texts = _templated(random.Random(2), n, 8)
        got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
        assert got.select("component_id").distinct().count() == len({frozenset(w.split("w")[0] for w in t.split()[:-1]) for t in texts})
        counts.append(sum(seen))
    assert 1000 < counts[1] <= 5 * counts[0]


def test_all_links(docs, rows, monkeypatch):
    for name, value in (("FREQUENT", 8), ("ALL_PAIRS", 4), ("DEALT", 7)):
        monkeypatch.setattr(ngram_join, name, value)
    sets = [(d, set(ngram_join.shingles((t or "").encode()).tolist())) for d, t in rows]
    want, pairs = Counter(), set()
    for i, (d, a) in enumerate(sets):
        near = [j for j, (_, b) in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)]
        want[d, len(a), len(near)] += 1
        pairs |= {frozenset((frozenset(a), frozenset(sets[j][1]))) for j in near if sets[j][1] != a}
    links, counts = ngram_join.all_links(docs)
    assert Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in counts.collect()) == want
    got = [(bytes(r["a"]), bytes(r["b"])) for r in links.collect()]
    assert len(got) == len(pairs) == len({frozenset(x) for x in got}) > 100


def test_other_orders_before_texts():
    """Similar sets pass the other orders' prefixes; sets whose prefixes part under one order go before their texts are met."""
    rng, classes = np.random.default_rng(5), np.zeros(1 << 21, np.uint8)
    some = lambda k: rng.integers(0, 1 << 63, k).astype(np.uint64)
    pairs = []
    for share in (0, 0.1, 0.5, 0.8, 0.9, 1):
        for _ in range(40):
            n = int(rng.integers(1, 200))
            both = some(round(share * n))
            pairs.append([np.unique(np.concatenate([both, some(n - len(both))])) for _ in "ab"])
    sent = [[ngram_join.probes(x, classes) for x in p] for p in pairs]
    kinds = {"a": pa.int64(), "b": pa.int64(), "xa": pa.list_(pa.binary()), "xb": pa.list_(pa.binary())}
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([range(len(pairs)), range(len(pairs)), *zip(*sent, strict=True)], kinds.values(), strict=True)], list(kinds))
    left = {i for out in ngram_join._chosen(ngram_join.prefixes_meet)([batch]) for i in out.column(0).to_pylist()}
    assert {i for i, p in enumerate(pairs) if ngram_join.similar(*p)} <= left and not left & set(range(40))
    for i, (x, y) in enumerate(pairs):
        heads = [[set(ngram_join.ordered(z, classes, k)[0][: ngram_join.probe_length(len(z))].tolist()) for z in (x, y)] for k in (1, 2)]
        assert (i in left) == all(a & b for a, b in heads)


@pytest.mark.parametrize(("per_range", "fan"), [(40_000, 2048), (60, 2048), (60, 3)])
def test_repeats(docs, rows, monkeypatch, per_range, fan):
    monkeypatch.setattr(suffix_dedup, "RANGE", per_range)
    monkeypatch.setattr(suffix_dedup, "FAN", fan)
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = Counter()
    for (d, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[d, sum(gone), runs, bytes(c for c, g in zip(t, gone, strict=True) if not g)] += 1
    got = suffix_dedup.remove_repeats(docs).collect()
    assert Counter((r["row"]["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


@pytest.mark.parametrize("fan", [2048, 4])
def test_ranges_of_a_shared_passage(spark, monkeypatch, fan):
    """Suffixes that share more than half of their bytes still spread over ranges, and their windows are found across the borders."""
    monkeypatch.setattr(suffix_dedup, "RANGE", 100)
    monkeypatch.setattr(suffix_dedup, "FAN", fan)
    rng, sizes, ranged = random.Random(4), [], suffix_dedup.ranged

    def watched(*given):
        pieces = ranged(*given)
        sizes.extend(r["n"] for r in pieces.groupBy("range").agg(F.sum(F.length("size") / 2).alias("n")).collect())
        return pieces

    monkeypatch.setattr(suffix_dedup, "ranged", watched)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = [f"{' '.join(word() for _ in range(30))} {passage} {' '.join(word() for _ in range(30))}" for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    at = {i: t.index(passage) for i, t in enumerate(texts)}
    got = {r["row"]["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, t in enumerate(texts):
        kept = bytes(got[i]["kept"]).decode()
        assert got[i]["n_spans"] == 1 and len(passage) <= got[i]["n_removed"] <= len(passage) + 20 and kept[: at[i] - 12] == t[: at[i] - 12]
    assert len(sizes) > 10 and max(sizes) <= 200


@pytest.mark.parametrize("per_range", [40_000, 8])
def test_one_span_for_each_place(spark, monkeypatch, per_range):
    """A place of a suffix meets one row of what repeats, although suffixes at the ends of a range report each window on its own."""
    kept, stored = {}, suffix_dedup.stored

    def watched(df, name, **options):
        kept[name] = stored(df, name, **options)
        return kept[name]

    monkeypatch.setattr(suffix_dedup, "RANGE", per_range)
    monkeypatch.setattr(suffix_dedup, "stored", watched)
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    passage = some(400)
    texts = {bytes([i]): some(120) + passage + some(120) for i in range(50)}
    rows = spark.createDataFrame(list(texts.items()), "tid binary, text string").repartition(3)
    got = {bytes(r["tid"]): [(s["a"], s["b"]) for s in r["spans"]] for r in suffix_dedup.repeated_spans(rows).collect()}
    places, cut = kept["runs"].filter("n IS NULL").count(), kept["found"].filter("window IS NOT NULL").count()
    assert cut and sum(map(len, got.values())) <= places
    for tid, t in texts.items():
        at = [i for a, b in got[tid] for i in range(a, b)]
        assert set(range(120, 520)) <= set(at) and len(set(at)) < 420 and t[120:520] == passage


def test_repeats_of_long_texts(spark):
    """Repeats on both sides of, and across, the borders of the stretches that a long text is scanned by."""
    rng = np.random.default_rng(3)
    body = bytes(rng.integers(97, 123, suffix_dedup.STRETCH + 5000).astype(np.uint8)).decode()
    at = suffix_dedup.STRETCH
    rows = [(1, body), (2, "A" * 150 + body[at - 300 : at + 300] + "B" * 150), (3, body[at - 1 : at + 199]), (4, body[at : at + 199])]
    got = {r["row"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (len(body), 600, 1), 2: (900, 600, 1), 3: (200, 200, 1), 4: (199, 0, 0)}


def test_merge_of_runs():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(300)})
    runs = [sorted(keys[i::7]) for i in range(7)]
    coded = [(r, suffix_dedup.front_coded(r)[0].tolist()) for r in runs]
    order, lcp = suffix_dedup.merge_runs(coded)
    out = [runs[r][i] for r, i in order]
    assert out == keys and lcp[1:] == [suffix_dedup.common_prefix(a, b) for a, b in zip(out, out[1:])]


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    total = sum(r["size"] for r in got)
    by = defaultdict(int)
    goal = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert r["target"] <= 2 * r["source_size"] + 1e-6
    assert sum(goal.values()) == pytest.approx(1.5 * total)
    for s, t in by.items():
        assert abs(t - goal[s]) <= 3 * mixing.BLOCK
    assert mixing.sainte_lague([53, 24, 23], 7) == [3, 2, 2] and mixing.sainte_lague([0, 1], 3, [5, 2]) == [0, 2]


def _highest_quotients(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))):
        i = max((i for i in range(len(votes)) if votes[i] > 0 and got[i] < most[i]), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_quotas_by_hand():
    rng = random.Random(8)
    for _ in range(200):
        votes = [rng.choice((0, rng.randint(1, 50), rng.random() * 9)) for _ in range(rng.randint(1, 8))]
        seats, most = rng.randint(0, 60), [rng.randint(0, 20) for _ in votes]
        assert mixing.sainte_lague(votes, seats, most) == _highest_quotients(votes, seats, most)


@pytest.mark.parametrize("shards", [4096, 3])
def test_mix_by_hand(spark, monkeypatch, shards):
    """Targets, quotas of sources, groups and shards, and the words of the blocks taken, worked out one by one."""
    for name, value in (("SHARD_WORDS", 60), ("SHARDS", shards)):
        monkeypatch.setattr(mixing, name, value)
    rng = random.Random(6)
    rows = [(i if i % 9 else None, " ".join(f"w{i}x{j}" for j in range(rng.choice((0, 1, 5, 40, 90)))), rng.choice(("a", "b", None))) for i in range(60)]
    rows.append(rows[3])
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    hashes = {(r["doc_id"], r["text"]): r for r in table.selectExpr("doc_id", "text", "xxhash64(7, coalesce(cast(doc_id AS string), text)) AS at", "xxhash64(text) AS tie").collect()}
    line = {r["at"]: r["h"] for r in spark.createDataFrame([(h["at"],) for h in hashes.values()], "at long").selectExpr("at", "xxhash64(8, at) AS h").collect()}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(t.split()) for _, t, s in rows if s == k) for k in sources]
    weights, left, goal = [mixing.WEIGHTS[i % 3] for i in range(3)], 1.5 * sum(sizes), [None] * 3
    while None in goal:
        open_ = [i for i, g in enumerate(goal) if g is None]
        over = [i for i in open_ if left * weights[i] / sum(weights[j] for j in open_) >= 2 * sizes[i]]
        for i in over or open_:
            goal[i] = 2.0 * sizes[i] if over else left * weights[i] / sum(weights[j] for j in open_)
        left -= sum(goal[i] for i in over)
    up = lambda n: -(-n // mixing.BLOCK)
    quota = _highest_quotients(goal, round(sum(goal) / mixing.BLOCK), [2 * up(s) for s in sizes])
    want = Counter()
    for rank, k in enumerate(sources):
        count, by = max(1, min(shards**2, sizes[rank] // 60)), defaultdict(list)
        for d, t, s in rows:
            if s == k:
                by[hashes[d, t]["at"] % count].append((d, t))
        size = {x: sum(len(t.split()) for _, t in own) for x, own in by.items()}
        groups = sorted({x // shards for x in by})
        dealt = _highest_quotients([sum(size[x] for x in by if x // shards == g) for g in groups], quota[rank], [2 * sum(up(size[x]) for x in by if x // shards == g) for g in groups])
        for g, n in zip(groups, dealt, strict=True):
            own = sorted(x for x in by if x // shards == g)
            for x, q in zip(own, _highest_quotients([size[x] for x in own], n, [2 * up(size[x]) for x in own]), strict=True):
                blocks = up(size[x])
                first = spark.sql(f"SELECT pmod(xxhash64(9, {rank}L, {x}L), {max(blocks, 1)}L)").first()[0]
                taken = Counter((first + i) % max(blocks, 1) for i in range(q))
                at = 0
                ordered = sorted(by[x], key=lambda r: (line[hashes[r]["at"]], hashes[r]["at"], r[0] is not None, r[0] or 0, len(r[1].split()), hashes[r]["tie"]))
                for d, t in ordered:
                    n_words = len(t.split())
                    want[d, k, n_words, sizes[rank], round(goal[rank], 6), sum(taken[(at + i) // mixing.BLOCK] for i in range(n_words))] += 1
                    at += n_words
    assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(table).collect()) == want


def test_mixed_cuts_the_blocks(spark):
    """Runs of blocks come out as they stand in the text, wherever in it they begin."""
    gaps, n, block = (" ", "\n", " \t", "\r\n  "), 100, mixing.BLOCK
    text = "  " + "".join(f"w{i}{gaps[i % 4]}" for i in range(n))
    at = [text.index(f"w{i}{gaps[i % 4]}") for i in range(n)]
    cut = lambda a, b: text[at[a] : at[b - 1] + len(f"w{b - 1}")]
    one = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    blocks, seen = -(-n // block), set()
    allowed = [{cut(f * block, min((f + 2) * block, n))} if f + 2 <= blocks else {cut(f * block, n), cut(0, block)} for f in range(blocks)]
    for seed in range(8):
        got = mixing.mixed(one, share=0.6, seed=seed).collect()
        found = {r["text"] for r in got}
        assert found in allowed and len(found) == len(got)
        seen.add(allowed.index(found))
    assert len(seen) > 1
    twice = mixing.mixed(one, share=1.7, seed=1).collect()
    assert text in [r["text"] for r in twice] and len(twice) > 1 and all(r["text"].strip() in text for r in twice)


def test_mixed_words(docs):
    got = Counter()
    for r in mixing.mixed(docs).collect():
        got[r["source"]] += len((r["text"] or "").encode().split())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["source"]] += r["taken"]
    assert got == want


def test_packing(docs, rows):
    e, got = chunk_encoder(vocabulary()), packing.pack(docs.filter("doc_id IS NOT NULL AND doc_id <> 5"), vocabulary(), partitions=3).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, t in rows:
        if d is not None and d != 5:
            ids, at = np.frombuffer(e.encode([(t or "").encode()])[0] + b"\x01\x00\x00\x00", "<u4"), 0
            for r in sorted(by[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(ids) == by[d][0]["doc_tokens"]
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_hilbert_steps():
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    path = cells[np.argsort(packing.hilbert(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_rules_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for d, t in rows:
        w = (t or "").encode().split()
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["kept"] and r["base_failed"])


def test_rules_by_hand(spark):
    """Every column of the verdict on the smallest test table, from counts, shares and distances of single texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "q " * 80, "xx"), (-4, "#$ % & | <b> *", "en"), (-5, "one\none\n \n \ntwo", None), (-6, "k7# " * 30 + "zq9 " * 30, "en"), (-6, "and so", "en")], "doc_id long, text string, lang string"))
    rows, f = [tuple(r) for r in docs.collect()], {}
    plain = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w).rstrip(b".,;:!?")
    kinds = [(b"\n", "newline"), (b" \t\r\x0b\x0c", "blank"), (b".,;:", "stop"), (b"!?", "exclamation"), (b"\"'()-", "quote"), (b"#*$%&|<>", "symbol")]

    def kind(c):
        for chars, name in kinds:
            if c in chars:
                return name
        return "lower" if 97 <= c <= 122 else "upper" if 65 <= c <= 90 else "digit" if 48 <= c <= 57 else None if 128 <= c < 192 else "wide" if c >= 192 else "punctuation" if 33 <= c <= 126 else "control"

    for i, (_, t, lang) in enumerate(rows):
        b = (t or "").encode()
        w = b.split()
        counts = Counter(kind(c) for c in b)
        f[i] = (lang, Counter(map(plain, w)), len(w), [counts[k] for k in quality_rules.CLASSES])
    langs = sorted({x[0] for x in f.values() if x[0] is not None and sum(1 for y in f.values() if y[0] == x[0] and y[2] >= 50) >= quality_rules.REFERENCE_TEXTS})
    assert "en" in langs and "xx" not in langs
    common = {}
    for lang in langs:
        df = Counter(w for x in f.values() if x[0] == lang and x[2] >= 50 for w in x[1] if w and len(w) <= quality_rules.WORD_BYTES)
        common[lang] = sorted(df, key=lambda w: (-df[w], w))[: quality_rules.COMMON_WORDS]
    part = lambda x: [v / max(sum(x), 1) for v in x]
    words = lambda x, lang: (lambda own: part([*own, x[2] - sum(own)]))([x[1][w] for w in common[lang]])

    def far(p, q):
        h = lambda a, b: sum(x * np.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x > 0)
        return float(np.sqrt(max((h(p, q) + h(q, p)) / 2, 0)))

    mean = lambda of: part(np.sum([[round(1e6 * v) for v in x] for x in of], axis=0).tolist())

    def fit(x, refs):
        by = {k: far(words(x, k), refs[k][1]) for k in langs}
        best = min(langs, key=lambda k: (by[k], k))
        return best, by[best], far(part(x[3]), refs[best][0])

    def made(most, before):
        out = {}
        for k in langs:
            own = [x for x in f.values() if x[0] == k and x[2] >= 50 and (most is None or (lambda b, _, c: c <= most[b])(*fit(x, before)))]
            out[k] = (mean([part(x[3]) for x in own]), mean([words(x, k) for x in own]))
        return out

    def medians(refs):
        by = defaultdict(list)
        for x in f.values():
            if x[2] >= 50:
                best, _, char = fit(x, refs)
                by[best].append(min(int(char * quality_rules.BINS), quality_rules.BINS - 1))
        return {k: (sorted(v)[(len(v) + 1) // 2 - 1] + 1) / quality_rules.BINS for k, v in by.items()}

    first = made(None, None)
    last = made(medians(first), first)
    middle = medians(last)
    want = Counter()
    for i, (d, t, lang) in enumerate(rows):
        x, text = f[i], t or ""
        b = text.encode().split()
        tri = Counter(zip(b, b[1:], b[2:]))
        hit = {i + k for i in range(len(b) - 2) if tri[tuple(b[i : i + 3])] > 1 for k in range(3)}
        lines = [y for y in text.split("\n") if y.encode().strip()]
        failed = len(b) < 50 or 100 * len(hit) > 50 * len(b)
        odd = False
        if lang is None or lang in langs:
            best, word, char = fit(x, last)
            none = far([0] * len(common[best]) + [1], last[best][1])
            odd = (word > quality_rules.WORD_PART * none and len(b) >= 50) or (char > max(quality_rules.CLASS_DISTANCE, quality_rules.CLASS_SPREAD * middle[best]) and sum(x[3]) >= 200)
        want[d, len(b), sum(len(y.decode()) for y in b), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed, not failed and not odd] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = Counter(tuple(r[c] for c in names) for r in quality_rules.quality_rules(docs).collect())
    assert got == want and 0 < sum(n for r, n in got.items() if r[-1]) < len(rows)


def test_rules_rare_language(spark):
    """Neither a small share of the words nor a language without a reference makes a clean text fail."""
    d = "/root/testdata/sf0.01"
    clean = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1"), "doc_id").filter("lang IN ('de', 'en')").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in clean.collect() if len((r["text"] or "").split()) >= 50]
    rare = [r for r in rows if r[2] == "de"][: quality_rules.REFERENCE_TEXTS]
    assert len(rare) == quality_rules.REFERENCE_TEXTS
    words = " ".join(t for _, t, k in rows if k == "en").split()
    huge = " ".join(words * (1 + 1100 * sum(len(t.split()) for _, t, _ in rare) // len(words)))
    alone = [(-2, rare[0][1], "pt"), (-3, rare[1][1], "pt")]
    table = spark.createDataFrame([r for r in rows if r[2] == "en"] + rare + alone + [(-1, huge, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(table).collect()}
    for i, _, lang in [*rare, *alone]:
        assert got[i]["kept"] == (not got[i]["base_failed"]), (i, lang)
    assert all(got[i]["language"] == "de" for i, _, _ in rare) and got[-2]["language"] is None
    assert sum(got[i]["kept"] for i, _, _ in rare) > 0.9 * len(rare)


def test_risk_gradient_is_the_risk_s():
    """The network's step against differences of the non-negative risk, on both sides of its bend."""
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (40, 5)), rng.normal(0, 1, (60, 5))
    for prior, shift in ((0.3, 0.0), (0.9, -3.0)):
        model = quality_model.Network(5, hidden=4, seed=2)
        model.w[3] = model.w[3] + shift

        def parts():
            f, g = model._forward(p)[1], model._forward(u)[1]
            return prior * np.logaddexp(0, -f).mean(), np.logaddexp(0, g).mean() - prior * np.logaddexp(0, f).mean()

        up, down, _, as_zero = model.gradients(p)
        _, other, _, loss = model.gradients(u)
        got = quality_model.risk_gradient(up, down, as_zero, other, loss, prior)
        falls = parts()[1] < 0
        for w, g in zip(model.w, got, strict=True):
            for i in range(w.size):
                flat, keep = w.ravel(), w.ravel()[i]
                flat[i] = keep + 1e-6
                above = parts()
                flat[i] = keep - 1e-6
                below = parts()
                flat[i] = keep
                rises = [(a - b) / 2e-6 for a, b in zip(above, below, strict=True)]
                assert g.ravel()[i] == pytest.approx(-rises[1] if falls else sum(rises), abs=1e-5)


def test_estimated_prior():
    rng = np.random.default_rng(2)
    for prior in (0.2, 0.5, 0.9):
        good, mixed_ = rng.beta(6, 2, 20_000), np.concatenate([rng.beta(6, 2, int(40_000 * prior)), rng.beta(1, 6, int(40_000 * (1 - prior)))])
        logit = lambda x: np.log(x / (1 - x))
        positive, rest = quality_model._bins(logit(good)), quality_model._bins(logit(mixed_))
        found = quality_model.estimated_prior(positive, rest)
        assert abs(found - prior) < 0.05
        # the score is the share of good text among rows like these, and it rises
        xs, ys = quality_model.posterior(positive, rest, prior)
        assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and np.interp(logit(0.05), xs, ys) < 0.1 and np.interp(logit(0.9), xs, ys) > 0.85


def test_learnt_models(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    both = quality_model.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in both]) > 0.95
    lang = language_id.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in lang]) > 0.98


def test_languages_by_hand(spark):
    """Profiles, distances and predictions from n-grams counted one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(90)
    docs = docs.union(spark.createDataFrame([(-1, None, "en"), (-2, "123 ...", "de"), (-3, "Größe ÉTÉ x²", None), (-4, "", "fr"), (None, "the same", "en"), (None, "the same", "en")], "doc_id long, text string, lang string"))
    rows, mask = [tuple(r) for r in docs.collect()], (1 << 64) - 1

    def hashed(gram):
        h = 0
        for c in gram:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & mask
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & mask
        return (h - (1 << 64) if h >> 63 else h) & ~0xFFFF

    def grams(text):
        counts, runs, run = Counter(), [], ""
        for c in (text or "").lower() + " ":
            if c.isalnum() and not c.isdecimal():
                run += c
            else:
                runs += [run] if any(x.isalpha() for x in run) else []
                run = ""
        for w in runs:
            marked = f"\x02{w}\x03"
            for n in range(1, min(language_id.LONGEST, len(marked)) + 1):
                for i in range(len(marked) - n + 1):
                    if n > 1 or 0 < i < len(marked) - 1:
                        counts[hashed(marked[i : i + n])] += 1
        return counts

    best = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: language_id.RANKS]]
    learnt = defaultdict(Counter)
    for d, t, lang in set(rows):
        if lang is not None and t is not None and (d is None or zlib.crc32(str(d).encode()) % 4 != 2):
            learnt[lang] += grams(t)
    profiles = {k: best(c) for k, c in learnt.items() if c}
    want = Counter()
    for d, t, _ in rows:
        own = best(grams(t))
        far = {k: np.mean([abs(p.index(g) - i) if g in p else language_id.RANKS for i, g in enumerate(own)]) / language_id.RANKS for k, p in profiles.items()} if own else {}
        pred = min(far, key=lambda k: (far[k], k)) if far else "und"
        score = 1 / sum(np.exp(-30 * (x - far[pred])) for x in far.values()) if far else 0.0
        want[d, d is not None and zlib.crc32(str(d).encode()) % 4 == 2, pred, round(float(score), 6)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in language_id.identify_language(docs).collect())
    assert got == want


def test_rare_languages_are_learnt(spark):
    texts = [(i, "the house and the garden of the king", "en") for i in range(600)] + [(1000 + i, "der hund und die katze sind im haus", "de") for i in range(8)] + [(None, "la maison est dans le jardin", "fr")]
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert language_id.learn(table, 5).langs == ["de", "en", "fr"]
    got = language_id.identify_language(table, 5).collect()
    assert Counter(r["lang_pred"] for r in got) == {"en": 600, "de": 8, "fr": 1}


def test_odd_rows_in_models(spark, docs, rows):
    labels = spark.createDataFrame([(7, 1, 0), (8, None, 0), (None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_model.score_quality(docs, labels).count() == len(rows)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_language(docs).collect()}
    assert got[0] == got[1] == "und"


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (quality_rules.quality_rules(none), quality_model.score_quality(none, labels), language_id.identify_language(none), mixing.mix(none), ngram_join.near_duplicates(none), suffix_dedup.remove_repeats(none), packing.pack(none, vocabulary())):
        assert df.count() == 0


def test_empty_files_and_rows(spark, docs):
    """Empty tables through what is written and read again, and through the forms that keep whole rows."""
    none = docs.limit(0)
    media.write_media(none, at := shared_dir(spark, "t"))
    assert media.media_features(media.read_media(spark, at)).count() == 0
    token_files.write_tokens(none, at := shared_dir(spark, "t"), vocabulary(), 2, partitions=2)
    assert token_files.read_tokens(spark, at).count() == 0
    assert chat.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for df in (quality_model.keep_quality(none, labels), ngram_join.one_of_each(none), suffix_dedup.without_repeats(none), mixing.mixed(none)):
        assert df.count() == 0 and df.columns == none.columns
    links, counts = ngram_join.all_links(none)
    assert links.count() == counts.count() == 0


def test_names_that_clash(spark):
    """Columns named as the operators name their own change nothing."""
    names = ("cls", "root", "text_key", "heads", "component_id", "near_id", "row", "kept", "tid", "copies", "spans", "features", "held_out", "score", "run", "runs", "size", "shard", "quota", "mix_at", "rank", "target", "at", "times", "lang_pred", "media", "start")
    texts = _texts()[:40]
    rows = [(i, t, "en", "a", *["x"] * len(names)) for i, t in enumerate(texts)]
    wide = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {', '.join(f'{n} string' for n in names)}")
    thin = wide.select("doc_id", "text", "lang", "source")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    same = lambda run: sorted(map(str, run(wide).collect())) == sorted(map(str, run(thin).collect()))
    assert all(map(same, (ngram_join.near_duplicates, quality_rules.quality_rules, language_id.identify_language, mixing.mix, suffix_dedup.remove_repeats, lambda d: packing.pack(d, vocabulary()), lambda d: quality_model.score_quality(d, labels))))
    for run in (ngram_join.one_of_each, suffix_dedup.without_repeats, mixing.mixed, lambda d: quality_model.keep_quality(d, labels)):
        got = run(wide)
        assert got.columns == wide.columns and sorted(map(str, got.select(thin.columns).collect())) == sorted(map(str, run(thin).collect()))


def test_very_long_text(spark):
    """A text of some megabytes, and its near copy, through every operator on documents."""
    rng = random.Random(12)
    words = [rng.choice(("the", "of", "and", "house", "Garden.", f"n{rng.randrange(200_000)}")) for _ in range(400_000)]
    long, near = " ".join(words), " ".join([*words[:-9], "other"])
    rows = [(1, long, "en", "a"), (2, near, "en", "a"), (3, "the house", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in (long, near))]
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()} == {(1, len(sets[0]), 1), (2, len(sets[1]), 1), (3, 1, 3)}
    tokens = len(chunk_encoder(vocabulary()).encode([long.encode()])[0]) // 4
    packed = [r for r in packing.pack(docs, vocabulary()).collect() if r["doc_id"] == 1]
    assert sum(r["length"] for r in packed) == tokens + 1 == packed[0]["doc_tokens"]
    got = {r["row"]["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    same = next(i for i, (a, b) in enumerate(zip(long, near)) if a != b)
    assert got[1] == (len(long), same) and got[2] == (len(near), same) and got[3] == (9, 0)
    rules = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert (rules[1]["n_words"], rules[1]["word_chars"], rules[1]["n_dup_lines"]) == (len(words), sum(map(len, words)), 0)
    assert {r["lang_pred"] for r in language_id.identify_language(docs).collect()} == {"en"}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: len(words), 2: len(words) - 8, 3: 2}
    assert all(0 <= r["score"] <= 1 for r in quality_model.score_quality(docs, spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")).collect())
    media.write_media(docs, at := shared_dir(spark, "t"))
    assert {(r["doc_id"], r["n_bytes"]) for r in media.media_features(media.read_media(spark, at)).collect()} == {(1, len(long)), (2, len(near)), (3, 9)}
    token_files.write_tokens(docs, at := shared_dir(spark, "t"), vocabulary(), 2, partitions=2)
    assert {r["doc_id"]: r["n_tokens"] for r in token_files.read_tokens(spark, at).collect()}[1] == tokens + 1


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "c"), (4, 0, "user", "c"), (5, None, None, None), (None, 0, "user", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["rendered"] for r in chat.chat_format(df).collect()}
    assert set(got) == {2, 4, 5, None} and got[2] == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n"
    long = spark.createDataFrame([(c, t, "user", str(t)) for c, n in ((1, 3000), (2, 2500)) for t in range(n)], "conv_id long, turn long, role string, text string")
    assert [(r["conv_id"], r["n_turns"]) for r in chat.chat_format(long).collect()] == [(1, 3000)]


def test_chat_nulls(spark):
    """Null equals null alone: not the empty text, not the text of a null byte, not turn -1."""
    rows = [(1, 0, "user", None), (2, 0, "user", ""), (3, 0, "user", "\x00"), (4, None, "user", "x"), (5, -1, "user", "x"), (6, 0, None, "x"), (7, 0, "", "x"), (8, 0, "user", None), (9, 0, "user", None), (9, 0, "user", "")]
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 9} and got[1] == (1, "<|user|>\n<|end|>\n") and got[6] == (1, "<||>\nx<|end|>\n") and got[9][0] == 2


def test_chunk_encoder_equals_library():
    from array import array
    from random import Random

    from tokenizers import Tokenizer

    from sievelight.llm.common import ChunkEncoder, vocabulary

    random = Random(3)
    letters = list("abcÉéßÀ÷×ÿ'.,!?<|>*&́  \n\t019'sllKİ\x1c\x85ñ'tÐþ{}~^`@[]_-+=:;#$%/\\\"()")
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += ["x<|endoftext|>y a'S b'S. don't! Isn't,,. l'LL.", "", "a" * 200, "Über-Maß!!! 1995."]
    library, own = Tokenizer.from_file(vocabulary()), ChunkEncoder(vocabulary(), half=500)
    for _ in range(2):
        got = own.encode([t.encode() for t in texts])
        assert got == [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        assert len(own) <= 500 + 64 * 40


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", name, queries.queries()[name], queries.oracle_sql()[name]) == ""
