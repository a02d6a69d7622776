"""Scores, timeliness, alerts, notices and whole runs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievelight.operators import monitor, process, review
from sievelight.operators.rules import Rule
from sievelight.streaming.quality import windowed_validity


def test_score(spark):
    profiles = spark.createDataFrame([(0.5, None, 10), (1.0, 0.5, 10)], "completeness double, consistency double, rows long")
    results = spark.createDataFrame([(10, 1), (10, 2)], "checked long, violations long")
    members = spark.createDataFrame([("a", 1), ("a", 2)], "cluster string, id long")
    assert monitor.score(profiles, results, members).first().asDict() == {"completeness": 75.0, "consistency": 50.0, "validity": 85.0, "uniqueness": 80.0, "overall": 72.5}
    none = monitor.score(profiles.limit(0), results.limit(0)).first().asDict()
    assert none == dict.fromkeys(none)


def test_timeliness_and_alerts(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    schema = "dataset string, at timestamp, interval int, completeness double, consistency double, validity double, uniqueness double, overall double"
    runs = spark.createDataFrame([("a", at(0), 5, 90.0, None, 90.0, None, 90.0), ("a", at(0, 30), 5, 70.0, None, 90.0, None, 80.0), ("a", at(0, 39), 5, 70.0, None, 90.0, None, 80.0), ("b", at(0), None, 90.0, None, None, None, 90.0), ("b", at(9), None, 30.0, None, None, None, 30.0)], schema)
    timed = monitor.with_timeliness(runs, "dataset", "at")
    got = [(r["dataset"], r["timeliness"], r["overall"]) for r in timed.orderBy("dataset", "at").collect()]
    assert got == [("a", None, 90.0), ("a", 0.0, 53.3), ("a", 100.0, 86.7), ("b", None, 90.0), ("b", None, 30.0)]
    raised = {(r["dataset"], r["at"].hour * 60 + r["at"].minute, r["alert"], r["severity"]) for r in monitor.alerts(timed, "dataset", "at", "overall").collect()}
    assert raised == {("a", 30, "skor_rendah", "tinggi"), ("a", 30, "data_terlambat", "tinggi"), ("a", 30, "drift_skor", "tinggi"), ("a", 30, "kolom_kosong_naik", "rendah"), ("b", 540, "skor_rendah", "tinggi"), ("b", 540, "drift_skor", "tinggi"), ("b", 540, "kolom_kosong_naik", "rendah")}
    path = str(tmp_path / "history")
    monitor.append_history(runs.filter("at < '2024-01-01 00:10:00'"), path)
    monitor.append_history(runs.filter("at >= '2024-01-01 00:10:00'"), path)
    assert [r["at"].minute for r in monitor.history(spark, path, "a").collect()] == [0, 30, 39]
    assert [r["dataset"] for r in monitor.newest(runs, "at", 2).collect()] == ["b", "a"]


def test_alerts_are_resolved(spark):
    rows = spark.createDataFrame([(1, "open"), (2, "open")], "id long, status string")
    assert sorted(tuple(r) for r in monitor.resolved(rows, spark.createDataFrame([(2,), (9,)], "id long")).collect()) == [(1, "open"), (2, "resolved")]


def test_schedules_and_thresholds():
    assert [monitor.interval(x) for x in ("daily", "manual", 5)] == [1440, None, 5]
    for bad in ("yearly", 4, 50_000):
        with pytest.raises(ValueError):
            monitor.interval(bad)
    with pytest.raises(ValueError):
        monitor.alert_threshold(101)


def test_notices():
    sent = []

    def broken(_):
        raise OSError("no route")

    note = monitor.alert_notice("skor_rendah", "tinggi", "low", "x")
    assert monitor.send(note, {"webhook": sent.append, "slack": broken, "email": None}) == {"webhook": True, "slack": "no route", "email": None}
    assert sent[0]["payload"]["alert_type"] == "skor_rendah" and "gagal" in monitor.processed_notice("x", "error", error="e")["subject"]


def test_run(spark):
    df = spark.createDataFrame([(i, f"n{i % 9}", f"a{i % 9}@x.id" if i else "none", float(i % 7 if i else 900)) for i in range(18)], "id long, nama string, email string, jumlah double")
    out = process.process(df, "id")
    assert set(out) == {"profiles", "clusters", "members", "pairs", "results", "outliers", "pii", "score"}
    assert out["results"].first()["violations"] == 1 and {r["key"] for r in out["outliers"].collect()} == {0} and "di atas" in out["outliers"].first()["explanation"]
    assert {r["column"] for r in out["pii"].collect()} == {"nama", "email"} and 0 < out["score"].first()["overall"] < 100
    assert set(process.process(df, "id", flags=process.Pipeline(dedup=False))) == {"profiles"}
    again = process.rerun_rules(df, "id", [Rule("email", "email_format")], review.duplicates(out["members"], out["clusters"]))
    assert again["score"].first() == out["score"].first()
    with pytest.raises(ValueError):
        process.Pipeline(schedule="yearly")


def test_queue(spark):
    clusters = spark.createDataFrame([("a", "pending", 0.5), ("b", "pending", 0.9), ("c", "split", 1.0)], "cluster string, status string, cohesion double")
    assert [r["cluster"] for r in review.queue(clusters).collect()] == ["b", "a"]


def test_stream_of_events(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(datetime(2024, 1, 1 + i % 3), i) for i in range(30)], "at timestamp, v int").write.parquet(path)
    stream = windowed_validity(spark.readStream.schema("at timestamp, v int").parquet(path), "at", [Rule("v", "numeric_range", {"min": 10})])
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("checked"), F.sum("violations")).first() == (30, 10)
