"""Stages of the pipeline and the whole of it, on a small table with odd rows and clashing columns, against brute force."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from sievelight.llm import mixing, ngram_join
from sievelight.llm.common import chunk_encoder, rested, vocabulary
from tests.llm.test_operators import _texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, cls string, copies int, run string, kept string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    odd = (None, "x", "y", 3, "z", None)
    rows = [(i, t, ("en", None, "de")[i % 3], ("b", "a", None)[i % 3], -1, *odd) for i, t in enumerate(_texts()[:60])]
    rows += [rows[5], rows[9], (None, "no id at all", None, "a", None, *odd), (None, rows[10][1], None, "a", None, *odd)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, 0) for i in range(8)], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def _found(df):
    assert tuple(df.columns) == pipeline.COLUMNS
    rows = df.collect()
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows)


def test_quality_stage(spark, docs, tmp_path):
    given = Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect())
    for name, quality, want in (("bad", 0, Counter()), ("good", 1, given)):
        spark.createDataFrame([(i, quality, 0) for i in range(8)], LABELS).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert _found(pipeline.quality(spark, docs, f"{tmp_path}/{name}")) == want


def test_near_duplicate_stage(spark, docs, folder):
    rows = list({(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()})
    sets = [set(ngram_join.shingles((t or "").encode()).tolist()) for _, t, _, _ in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                group = [group[i] if g == group[j] else g for g in group]
    ids = defaultdict(set)
    for g, (d, *_) in zip(group, rows, strict=True):
        ids[g].add(d)
    want = Counter(r for g, r, s in zip(group, rows, sets, strict=True) if not s or r[0] == min(ids[g] - {None}, default=None))
    assert _found(pipeline.near_duplicates(spark, docs, folder)) == want


def test_repeat_stage(spark, docs, folder):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = Counter()
    for (d, text, *rest), t in zip(rows, texts, strict=True):
        gone = {i + k for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1 for k in range(200)}
        left = bytes(c for i, c in enumerate(t) if i not in gone).decode(errors="ignore")
        want[d, None if text is None else left, *rest] += 1
    assert _found(pipeline.repeats(spark, docs, folder)) == want


def test_mixture_stage(spark, docs, folder):
    of, got, want = defaultdict(list), Counter(), Counter()
    for r in docs.collect():
        of[r["doc_id"], r["source"]].append(r["text"] or "")
    for (d, text, _, source), n in _found(pipeline.mixture(spark, docs, folder)).items():
        assert any(text in t for t in of[d, source])
        got[d, source] += n * len(text.encode().split())
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    assert got == +want


def test_whole_run(spark, docs, folder):
    left = docs
    for _, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, folder)
    e = chunk_encoder(vocabulary())
    tokens = Counter()
    for d, text, *_ in _found(left).elements():
        tokens[d] += len(e.encode([(text or "").encode()])[0]) // 4 + 1
    got = Counter()
    for r in pipeline.run(spark, folder).collect():
        got[r["doc_id"]] += r["length"]
    assert got == tokens and len(got) > 20


def test_empty_run(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_rest_executors(spark, docs, folder, monkeypatch):
    """Stages begin by having executors give memory back; the collections run in tasks, beside the driver's own."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    before = full()
    rested(spark)
    assert full() - before > 1
    called = []
    monkeypatch.setattr(pipeline, "rested", called.append)
    pipeline.packing(spark, docs.limit(3), folder)
    assert called == [spark]
