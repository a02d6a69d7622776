"""Files, sheets, databases, sinks and the catalogue."""

import zipfile

import pytest

from sievelight.operators import golden, monitor, privacy, profile, report, review
from sievelight.sources import files, sinks


def test_head_only(spark, tmp_path):
    path = str(tmp_path / "x.bin")
    files.write_bytes(spark, path, bytes(range(256)) * 10)
    assert files.read_bytes(spark, path, 300) == (bytes(range(256)) * 2)[:300] and files.size_of(spark, path) == 2560


def test_encodings():
    assert files.sniff("a;b\n1;é\n".encode()) == ("UTF-8", ";")
    assert files.encoding_of("é".encode() * 9 + b"\xc3") == "UTF-8"
    text = ("nama,kota\n" + "José,São Paulo\nMüller,Köln\n" * 40).encode("cp1252")
    assert text.decode(files.sniff(text)[0]).startswith("nama,kota\nJosé,São")
    assert files.sniff(b"just one column\nx\n")[1] in ",;\t|"


def test_dataset_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text("kode | nama\n" + "".join(f"{i:03d}|n{i}\n" for i in range(2000)))
    df = files.read_dataset(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["_row_id", "kode", "nama"] and dict(df.dtypes)["kode"] == "string"
    assert [r["kode"] for r in df.orderBy("_row_id").collect()] == [f"{i:03d}" for i in range(2000)]
    wide = files.numbered(spark.range(0, 1000, 1, 7).withColumnRenamed("id", "v"))
    assert sorted((r["_row_id"], r["v"]) for r in wide.collect()) == [(i, i) for i in range(1000)]
    for name, size in (("x.exe", 1), ("x.csv", 0), ("x.xlsx", 1 << 40)):
        with pytest.raises(ValueError):
            files.check_upload(name, size)
    (tmp_path / "none.csv").write_text("a,b\n,\n")
    with pytest.raises(ValueError):
        files.read_dataset(spark, str(tmp_path / "none.csv"))


def test_lines_within_values(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,v\n1,"two\nlines"\n2,one\n')
    assert [r["v"] for r in files.read_delimited(spark, str(tmp_path / "x.csv"), multi_line=True).orderBy("id").collect()] == ["two\nlines", "one"]


def test_sheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>nama </t></si><si><r><t>Bu</t></r><r><t>di</t></r></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row><row><c r="B3"><v>8.5</v></c></row></sheetData></worksheet>')
    df = files.read_dataset(spark, str(tmp_path / "x.xlsx"))
    assert [tuple(r) for r in df.orderBy("_row_id").collect()] == [(0, "Budi", 7.0), (1, None, 8.5)]


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(50).selectExpr("cast(id AS int) AS k", "cast(id % 3 AS int) AS v").write.format("jdbc").option("url", url).option("dbtable", "t").save()
    files.test_connection(spark, url, "SELECT 1 AS ok FROM sysibm.sysdummy1")
    assert files.read_database(spark, url, 'SELECT * FROM t WHERE "v" = 1').count() == 17
    parts = files.read_database(spark, url, "SELECT * FROM t", ("k", 0, 50, 4))
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 50
    assert files.refresh(spark, url, 'SELECT "v", count(*) AS "n" FROM t GROUP BY "v"', str(tmp_path / "snap")).count() == 3
    with pytest.raises(ValueError):
        files.read_database(spark, url, 'SELECT * FROM t WHERE "v" = 9')
    with pytest.raises(Exception):
        files.test_connection(spark, url, "SELECT nothing FROM nowhere")
    with pytest.raises(ValueError):
        files.jdbc_url("oracle", "h", None, "d")
    assert files.jdbc_url("mysql", "h", None, "d") == "jdbc:mysql://h:3306/d"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "budi  S", "0812345678", 1), (1, "BUDI s", "62812345678", 2), (2, "siti", "0899999999", 3)], "id long, nama string, no_hp string, n long")
    read = lambda name: spark.read.csv(str(tmp_path / name), header=True)
    sinks.write_standardized(df, str(tmp_path / "standard"))
    assert sorted(r["no_hp"] for r in read("standard").collect()) == ["0812345678", "0812345678", "0899999999"]
    members = spark.createDataFrame([(0, "ec_00001", "confirmed"), (1, "ec_00001", "confirmed")], "id long, cluster string, status string")
    clusters = spark.createDataFrame([("ec_00001", "confirmed", 0.9)], "cluster string, status string, cohesion double")
    goldens = review.goldens(df, "id", members.select("cluster", "id"), clusters, {"nama": "first_non_null", "no_hp": "longest", "n": "latest_update"}).drop("provenance")
    sinks.write_clean(df, str(tmp_path / "clean"), "id", members, goldens)
    got = sorted(read("clean").collect(), key=lambda r: int(r["id"]))
    assert [(r["id"], r["nama"], r["no_hp"], r["_dq_status"], r["_dq_source_rows"]) for r in got] == [("0", "budi  S", "62812345678", "golden_record", "r-0,r-1"), ("2", "Siti", "0899999999", "unique", None)]
    assert golden.export_summary(df, "id", members, goldens).first().asDict() == {"original_rows": 3, "clean_rows": 2, "clusters_merged": 1, "rows_collapsed": 2, "pending_review_rows": 0, "reviewed_distinct_rows": 0}
    sinks.write_clean(df, str(tmp_path / "masked"), "id", members, goldens, mask_pii=True)
    assert "0899****99" in {r["no_hp"] for r in read("masked").collect()}
    out = sinks.apply_standard(spark, df, str(tmp_path / "catalogue"), "x standard", str(tmp_path / "x"))
    sinks.register(spark, str(tmp_path / "catalogue"), "y", "p", 3, 4, 88.5)
    sinks.register(spark, str(tmp_path / "catalogue"), "y", "p", 5, 4, 90.5)
    assert out.count() == 3 and {(r["name"], r["row_count"], r["quality_score"], r["source"]) for r in sinks.entries(spark, str(tmp_path / "catalogue")).collect()} == {("x standard", 3, None, "standardize"), ("y", 5, 90.5, "upload")}


def test_scorecard_and_dictionary(spark, tmp_path):
    df = spark.createDataFrame([(0, "a@x.id", "on"), (1, "b@x.id", "off"), (2, None, "on")], "id long, email string, status string")
    profiles = profile.report(profile.profile(df, ["email", "status"], "id"))
    results = spark.createDataFrame([("email_format:email", "email", 3, 1)], "rule string, column string, checked long, violations long")
    clusters = spark.createDataFrame([("pending",), ("split",)], "status string")
    lines = report.scorecard("x", profiles, results, clusters, monitor.score(profiles, results))
    sinks.write_scorecard(lines, str(tmp_path / "card"))
    said = [r["value"] for r in spark.read.text(str(tmp_path / "card")).collect()]
    assert '"x","3","83.3"' in said and '"completeness","83.3"' in said and '"email","text","0.6667","1.0","0.6667","","33% nilai kosong"' in said and '"email_format:email","email","3","1"' in said and '"2","1","0","1"' in said
    sinks.write_markdown(lines, str(tmp_path / "page"))
    assert "## Kolom" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "page"), wholetext=True).collect())
    tops = profiles.selectExpr("column", "explode(top_values) AS t").selectExpr("column", "t.value", "t.count")
    rules = spark.createDataFrame([("email", "email_format")], "column string, rule string")
    words = review.dictionary(profiles.select("position", "column", "completeness"), tops, rules, privacy.detect(df, ["email", "status"], "id"))
    sinks.write_dictionary(words, str(tmp_path / "words"))
    got = {r["column"]: (r["top_values"], r["rules"], r["pii"]) for r in spark.read.csv(str(tmp_path / "words"), header=True).collect()}
    assert got == {"email": ("[PII: Email] contoh: a*@x.id", "email_format", "Email"), "status": ("on (2); off (1)", None, None)}
