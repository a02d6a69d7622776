"""Review of clusters and the clean export on small tables."""

from sievelight.operators import golden, review


def _tables(spark):
    clusters = spark.createDataFrame([("a", "pending", 0.9), ("b", "pending", 0.8), ("c", "split", 0.7), ("d", "pending", 0.6)], "cluster string, status string, cohesion double")
    members = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("c", 6), ("d", 7)], "cluster string, id long")
    pairs = spark.createDataFrame([("a", 1, 2, 0.9), ("a", 1, 3, 0.7), ("b", 4, 5, 0.8)], "cluster string, a long, b long, score double")
    return clusters, members, pairs


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_decide(spark):
    clusters, members, _ = _tables(spark)
    asked = spark.createDataFrame([("a", "confirm"), ("b", "split"), ("c", "confirm"), ("d", "confirm"), ("x", "split")], "cluster string, action string")
    got = {r["cluster"]: (r["status"], r["rejected"]) for r in review.decide(clusters, members, asked).collect()}
    assert got == {"a": ("confirmed", None), "b": ("split", None), "c": ("split", "already reviewed"), "d": ("pending", "fewer than two members")}


def test_exclude(spark):
    clusters, members, pairs = _tables(spark)
    gone = spark.createDataFrame([("a", 2), ("b", 4), ("c", 6), ("a", 99)], "cluster string, id long")
    left, kept = review.exclude(clusters, members, pairs, gone)
    assert _rows(left, "cluster", "status", "cohesion") == [("a", "pending", 0.7), ("b", "split", 0.8), ("c", "split", 0.7), ("d", "pending", 0.6)]
    assert _rows(kept, "id") == [(1,), (3,), (5,), (6,), (7,)]


def test_merge(spark):
    clusters, members, pairs = _tables(spark)
    asked = spark.createDataFrame([("a", "b"), ("a", "c")], "cluster string, other string")
    left, moved, scores = review.merge(clusters, members, pairs, asked)
    assert _rows(left, "cluster", "cohesion") == [("a", 0.9), ("c", 0.7), ("d", 0.6)]
    assert _rows(moved.filter("cluster = 'a'"), "id") == [(1,), (2,), (3,), (4,), (5,)]
    assert _rows(scores, "cluster") == [("a",)] * 3
    assert tuple(review.status_counts(clusters).first()) == (4, 3, 0, 1)


def test_clean_without_golden(spark):
    rows = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, None)], "id long, v string")
    members = spark.createDataFrame([(0, "a", "confirmed"), (1, "a", "confirmed"), (2, "b", "confirmed"), (9, "b", "confirmed")], "id long, cluster string, status string")
    goldens = spark.createDataFrame([("a", "X")], "cluster string, v string")
    got = {r["id"]: (r["v"], r["_dq_status"], r["_dq_source_rows"]) for r in golden.clean(rows, "id", members, goldens).collect()}
    assert got == {0: ("X", "golden_record", "r-0,r-1"), 2: ("y", "pending_review", None), 3: (None, "unique", None)}


def test_dictionary_hides_personal_data(spark):
    profiles = spark.createDataFrame([("e", 1.0), ("s", 0.5)], "column string, completeness double")
    tops = spark.createDataFrame([("e", "a@b.id", 3), ("s", "on", 2), ("s", "off", 5)], "column string, value string, count long")
    rules = spark.createDataFrame([("e", "email_format"), ("e", "not_null")], "column string, rule string")
    pii = spark.createDataFrame([("e", "Email", "a*@b.id")], "column string, pii_label string, sample_masked string")
    got = _rows(review.dictionary(profiles, tops, rules, pii), "column", "top_values", "rules", "pii")
    assert got == [("e", "[PII: Email] contoh: a*@b.id", "email_format; not_null", "Email"), ("s", "off (5); on (2)", "", "")]
