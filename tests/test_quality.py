"""Operators on small tables, and every query against its SQL on the smallest test data."""

import datetime
import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievelight.functions import similarity as sim
from sievelight.functions import text as tx
from sievelight.operators import crosscheck, golden, privacy, profile, resolve
from sievelight.operators.rules import Rule, check_config, column_text, json_record, key_digest, proposed_rule, rule_from_words, run_rules, suggest, violations
from sievelight.plans import catalogue
from sievelight.sources.files import coerce, read_delimited, sniff
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, name, catalogue.queries()[name], catalogue.oracle_sql()[name]) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_normalisers(spark):
    df = spark.createDataFrame([("Dr.  Budi Santóso", " BUDI@Gmial.com ", "Jl. Merdeka No. 10", "00-123.45", "31/12/2025", "Muhammad", "Mohamad")], "n string, e string, a string, i string, d string, p string, q string")
    r = df.select(tx.person_name(F.col("n")), tx.email(F.col("e")), tx.address(F.col("a")), tx.identifier(F.col("i")), tx.date_text(F.col("d")), tx.phonetic(F.col("p")) == tx.phonetic(F.col("q"))).first()
    assert tuple(r) == ("budi santoso", "budi@gmail.com", "jalan merdeka nomor 10", "0012345", "2025-12-31", True)


def test_referential_integrity(spark):
    child = spark.createDataFrame([("C-1",), ("C-2",), ("C-9",), ("",), (None,)], "k string")
    parent = spark.createDataFrame([("C-1",), ("C-2",), ("C-3",)], "k string")
    r = crosscheck.referential_integrity(child, "k", parent, "k").first()
    assert (r["checked"], r["matched"], r["violations"]) == (3, 2, 1)
    none = crosscheck.referential_integrity(child.limit(0), "k", parent, "k").first()
    assert (none["checked"], none["key_overlap"]) == (0, None)


def test_profile_numbers(spark):
    df = spark.createDataFrame([(1, 10, "08123456", "active"), (2, 20, "081234567", "active"), (3, 30, None, "x"), (4, 100, "081234567", "y")], "id long, amount long, phone string, status string")
    rows = {r["column"]: r for r in profile.profile(df).collect()}
    assert rows["id"]["is_candidate_key"] and not rows["phone"]["is_candidate_key"]
    assert profile.profile(df.limit(0)).select("rows", "completeness", "uniqueness").distinct().collect() == [(0, 0.0, None)]
    p, s = rows["phone"], rows["status"]
    assert (p["null_count"], p["blank_count"], p["min_length"], p["max_length"], p["median_length"], p["duplicate_count"]) == (1, 0, 8, 9, 9.0, 1) and p["mean_length"] == pytest.approx(26 / 3)
    assert (s["top_values"][0]["value"], s["top_values"][0]["count"], s["top_values"][0]["share"], s["duplicate_count"]) == ("active", 2, 0.5, 1)
    a = rows["amount"]
    assert (a["minimum"], a["maximum"], a["mean"], a["median"], a["q1"], a["q3"]) == (10, 100, 40, 25, 17.5, 47.5)
    assert rows["phone"]["completeness"] == 0.75


def test_profile_odd_columns(spark):
    df = spark.createDataFrame([(None, "yes", 5, "2024-01-05"), ("", "no", None, "31/12/2023"), ("  ", "yes", None, None)], "empty string, flag string, one long, day string")
    rows = {r["column"]: r for r in profile.profile(df).collect()}
    e, f, o, d = (rows[c] for c in ("empty", "flag", "one", "day"))
    assert (e["inferred_type"], e["completeness"], e["uniqueness"], e["null_count"], e["blank_count"], e["top_values"], e["min_length"]) == ("text", 0.0, None, 3, 2, [], None)
    assert (f["inferred_type"], f["is_candidate_key"]) == ("boolean", False)
    assert (o["inferred_type"], o["std"], o["median"], o["completeness"], o["notes"]) == ("numeric", 0.0, 5.0, pytest.approx(1 / 3), "67% nilai kosong")
    assert (d["inferred_type"], str(d["min_date"]), str(d["max_date"])) == ("date", "2023-12-31", "2024-01-05")


def test_profile_skewed(spark):
    """A column with one value, and one with all different, through several ranges."""
    df = spark.range(5000).select("id", F.lit(7.5).alias("same"), (F.col("id") * 37 % 5000 / 4).alias("spread"))
    rows = {r["column"]: r for r in profile.profile(df, ["same", "spread"], "id").collect()}
    want = sorted(i * 37 % 5000 / 4 for i in range(5000))
    assert (rows["same"]["q1"], rows["same"]["median"], rows["same"]["std"], rows["same"]["distinct"]) == (7.5, 7.5, 0.0, 1)
    q = rows["spread"]
    assert (q["q1"], q["median"], q["q3"]) == (want[1249] * 0.25 + want[1250] * 0.75, (want[2499] + want[2500]) / 2, want[3749] * 0.75 + want[3750] * 0.25)
    assert q["std"] == pytest.approx(spark.range(5000).select(F.stddev_samp(F.col("id") / 4)).first()[0]) and q["is_candidate_key"]


def test_plain_letters(spark):
    chars = [chr(c) for c in (*range(0x20, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x2200), *range(0x3300, 0x3400), *range(0xFB00, 0xFB10), *range(0xFF00, 0xFF60), 0x1D400, 0x1D7FF, 0x1F600)]
    texts = chars + ["Ångström ﬁn ½ ①②", "ＡＢＣ－１２３", "no change", ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(tx.ascii_only(F.col("t"))).collect()]
    assert got == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_dates(spark):
    forms = {
        "2024-01-05": "2024-01-05", "2024-1-5 10:30": "2024-01-05", "2024-01-05T10:30:00": "2024-01-05", "2024-01-05 10:30:00.123": "2024-01-05", "5/1/2024": "2024-01-05", "05-01-2024": "2024-01-05", "5.1.2024": "2024-01-05",
        "2024/01/05": "2024-01-05", "01/25/2024": "2024-01-25", "5 Jan 2024": "2024-01-05", "5-jan-2024": "2024-01-05", "5 January 2024": "2024-01-05", "Jan 5, 2024": "2024-01-05", "JANUARY 5 2024": "2024-01-05", "20240105": "2024-01-05",
        "44/09/1994": None, "31/02/2024": None, "hello": None, "": None, "12": None, "2024-13-01": None, "12345678": None,
    }
    got = {r["t"]: r["d"] for r in spark.createDataFrame([(t,) for t in forms], "t string").select("t", F.date_format(tx.parsed_date(F.col("t")), "yyyy-MM-dd").alias("d")).collect()}
    assert got == forms


def test_signature_and_masks(spark):
    row = spark.createDataFrame([("AB-cd12", "budi@x.id", "noat", "a@x", "@x", None)], "s string, a string, b string, c string, d string, e string")
    got = row.select(tx.signature(F.col("s")), *[tx.masked(F.col(c), "email_mask") for c in "abcde"]).first()
    assert tuple(got) == ("A-a9", "bu**@x.id", "****", "a*@x", "*@x", None)


def test_personal_data(spark):
    df = spark.createDataFrame([(0, "0812-3456-7890", "3171 0001 0002 0003", None, "x"), (1, "(0813) 3456 789", "31710001-00020004", None, "y")], "id long, kontak string, nomor string, kosong string, no_ktp string")
    got = {r["column"]: (r["pii_type"], r["pii_label"], r["strategy"], r["sample_masked"]) for r in privacy.detect(df, order="id").collect()}
    assert got == {"kontak": ("phone", "Nomor HP", "partial", "0812********90"), "nomor": ("nik", "NIK", "partial", "3171*************03"), "no_ktp": ("nik", "NIK", "partial", "*")}
    first = spark.createDataFrame([(i, "a@b.id" if i < 200 else "none") for i in range(600)], "id long, v string")
    assert [r["column"] for r in privacy.detect(first, order="id").collect()] == ["v"] and privacy.detect(first, ["v"]).isEmpty()


def test_standard_forms(spark):
    df = spark.createDataFrame([(0, "62812345678", "  budi  SANTOSO RT", "jl. mawar no 5", "31/12/2023", " a  b ", 3.0), (1, None, "x", None, "2024-01-05", "c", None)], "id long, no_hp string, nama string, alamat string, tgl string, ket string, kode double")
    out = privacy.standardize(df)
    assert dict(out.dtypes)["kode"] == "bigint"
    assert tuple(out.orderBy("id").first()) == (0, "0812345678", "Budi Santoso RT", "Jl. Mawar No. 5", "2023-12-31", "a b", 3)
    changed = {r["column"]: (r["kind"], r["changed"], [tuple(x) for x in r["samples"]]) for r in privacy.changes(df, order="id").collect()}
    assert changed["tgl"] == ("tanggal_iso", 1, [(0, "31/12/2023", "2023-12-31")]) and changed["nama"][:2] == ("nama", 2) and "kode" not in changed


def test_golden_dates_and_provenance(spark):
    df = spark.createDataFrame([(1, 0, "a", "31/12/2023", "CRM ", "same"), (1, 1, "b", "01/02/2025", "web", "same"), (1, 2, "b", None, "web", "same"), (2, 3, " ", None, None, None)], "k long, o long, v string, last_update string, sumber string, s string")
    got = {r["k"]: r for r in golden.golden(df, "k", "o", {"v": "latest_update", "s": "longest"}, provenance=True).collect()}
    assert got[1]["v"] == "b" and got[1]["provenance"]["v"].asDict() == {"record_index": 1, "rule": "latest_update"} and got[1]["provenance"]["s"].asDict() == {"record_index": 0, "rule": "same_in_all"}
    assert got[2]["v"] is None and got[2]["provenance"]["v"].asDict() == {"record_index": None, "rule": "latest_update"}
    by_source = golden.golden(df, "k", "o", {"v": "source_priority"}, priority=["crm", "web"]).filter("k = 1").first()
    assert by_source["v"] == "a" and golden.golden(df, "k", "o", {"v": "nothing known"}).filter("k = 1").first()["v"] == "b"
    assert golden.golden(df.drop("last_update"), "k", "o", {"v": "nothing known"}).filter("k = 1").first()["v"] == "a"


def test_json_records(spark):
    df = spark.createDataFrame([(1, 5.0, "a\"b", True, None), (2, 2.5, None, None, datetime.date(2024, 1, 5))], "i long, d double, s string, b boolean, t date")
    got = [json.loads(r[0]) for r in df.orderBy("i").select(json_record(df)).collect()]
    assert got == [{"i": 1, "d": 5, "s": 'a"b', "b": True, "t": None}, {"i": 2, "d": 2.5, "s": None, "b": None, "t": "2024-01-05"}] and isinstance(got[0]["d"], int)
    assert df.select(key_digest(F.col("s"))).first()[0] == hashlib.sha256(b'a"b').hexdigest()
    assert [r[0] for r in df.select(column_text(df, "d")).collect()] == ["5.0", "2.5"] and df.filter("i = 1").select(column_text(df.filter("i = 1"), "d")).first()[0] == "5"


def test_proposed_rules():
    rule = proposed_rule('```json\n{"column_name": "age", "rule_type": "numeric_range", "params": {"min": 0}, "description": "ages"}\n```', ["age", "end"])
    assert (rule.column, rule.kind, rule.params, rule.name) == ("age", "numeric_range", {"min": 0}, "ages")
    assert rule_from_words(lambda said: '{"rule_type": "cross_column", "params": {"left": "age", "right": "end", "operator": "lt"}}', "age before end", ["age", "end"]).column == "age"
    for bad in ("[1]", '{"rule_type": "x", "column_name": "age"}', '{"rule_type": "not_null", "column_name": "no"}', '{"rule_type": "not_null", "column_name": "age", "params": 3}', '{"rule_type": "cross_column", "params": {"left": "age", "right": "no", "operator": "lt"}}', "not json"):
        with pytest.raises(ValueError):
            proposed_rule(bad, ["age", "end"])


def test_pages_of_violations(spark):
    df = spark.range(100).select("id", F.lit(None).cast("string").alias("v"))
    rule = Rule("v", "not_null")
    assert [r["id"] for r in violations(df, rule, "id", 3, 10).collect()] == list(range(20, 30))
    for page, size in ((0, 10), (1, 201)):
        with pytest.raises(ValueError):
            violations(df, rule, "id", page, size)
    with pytest.raises(ValueError):
        Rule("v", "regex", {"pattern": "(?P<x>a)"})


def test_similarities():
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-5)
    assert sim.indel_ratio("abcd", "abed") == 0.75
    assert sim.token_set_ratio("a b", "b a c") == 1.0


def test_worked_log_odds(spark):
    df = spark.createDataFrame([(1.0, True, 0.01), (0.0, False, 0.01)], "s double, e boolean, f double")
    p = [r[0] for r in df.select(resolve.probability([resolve.log_odds(F.col("s"), F.col("e"), F.col("f"), F.col("f"))])).collect()]
    assert p[0] == pytest.approx(0.9979, abs=1e-3) and p[1] == pytest.approx(2.34e-4, abs=2e-5)


def test_components_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["cluster"] for r in resolve.components(pairs).collect()}
    assert set(got[i] for i in range(41)) == {0} and got[101] == 100


def test_rules_config():
    for kind, params in (("nope", {}), ("numeric_range", {}), ("numeric_range", {"min": 2, "max": 1}), ("starts_with", {}), ("regex", {}), ("cross_column", {"operator": "x"})):
        with pytest.raises(ValueError):
            check_config(kind, params)
    assert [r.kind for r in suggest(["email", "no_hp", "nik", "tanggal_lahir"])] == ["email_format", "phone_id", "nik", "date_range"]


def test_rules_on_nulls(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("a@b.co",)], "e string")
    got = {r["rule"]: r["violations"] for r in run_rules(df, [Rule("e", "email_format"), Rule("e", "not_null")]).collect()}
    assert got == {"email_format:e": 0, "not_null:e": 2}


def test_golden_ties(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, None), (2, 3, " ")], "k long, o long, v string")
    got = {r["k"]: r["v"] for r in golden.golden(df, "k", "o", {"v": "most_frequent"}).collect()}
    assert got == {1: "a", 2: None}


def test_cross_checks_need_their_columns(spark):
    df = spark.createDataFrame([("a", "x")], "k string, v string")
    for run in (lambda: crosscheck.referential_integrity(df, "no", df, "k"), lambda: crosscheck.orphans(df, "k", df, "no"), lambda: crosscheck.consistency(df, "k", "no", df, "k", "v")):
        with pytest.raises(ValueError):
            run()


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id; code ;v\n1;007;1.5\n2;010;\n")
    df = read_delimited(spark, str(tmp_path / "x.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "code": "string", "v": "double"}
    assert sniff("a|b\n1|é\n".encode("cp1252"))[1] == "|"
    assert coerce(spark.createDataFrame([("1",), (None,)], "a string")).dtypes == [("a", "double")]
