"""Quality scores, their history, timeliness and alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of a drop that is drift, of the score and of completeness; the score under which an alert is raised.
SCORE_DROP, COMPLETENESS_DROP, THRESHOLD = 10.0, 10.0, 75.0
#: Minutes between runs of a monitored dataset, and of the named schedules (fixed values).
INTERVALS = (5, 30 * 24 * 60)
SCHEDULES = {"hourly": 60, "daily": 24 * 60, "weekly": 7 * 24 * 60, "manual": None}
DIMENSIONS = ("completeness", "consistency", "validity", "uniqueness", "timeliness")


def dimensions(completeness: Column, consistency: Column, checked: Column, violations: Column, duplicates: Column, rows: Column) -> dict[str, Column]:
    """Scores of one run, 0 to 1; a dimension without evidence is null and left out of the overall score (0 to 100)."""
    found = {"completeness": completeness, "consistency": consistency, "validity": F.when(checked > 0, 1 - violations / checked), "uniqueness": F.when(rows > 0, 1 - duplicates / rows)}
    present = F.filter(F.array(*found.values()), lambda x: x.isNotNull())
    return found | {"overall": F.when(F.size(present) > 0, 100 * F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))}


def score(profiles: DataFrame, results: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """One row of dimensions and overall, 0 to 100 with one decimal.

    ``profiles`` gives completeness and consistency, ``results`` (checked,
    violations) validity, ``duplicates`` (members of clusters, one row each)
    uniqueness. Dimensions without evidence are null.
    """
    columns = profiles.agg(F.avg("completeness").alias("c"), F.avg("consistency").alias("k"), F.max("rows").alias("rows"))
    rules = results.agg(F.coalesce(F.sum("checked"), F.lit(0)).alias("checked"), F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))
    copies = duplicates.agg(F.count(F.lit(1)).alias("duplicates")) if duplicates is not None else rules.select(F.lit(0).cast("long").alias("duplicates"))
    one = columns.crossJoin(rules).crossJoin(copies)
    found = dimensions(F.col("c"), F.col("k"), F.col("checked"), F.col("violations"), F.col("duplicates"), F.col("rows"))
    return one.select(*[F.round(e if k == "overall" else 100 * e, 1).alias(k) for k, e in found.items()])


def column_validity(results: DataFrame) -> DataFrame:
    """column and validity, by all rules of it; null where nothing was checked."""
    sums = results.groupBy("column").agg(F.sum("checked").alias("c"), F.sum("violations").alias("v"))
    return sums.select("column", F.when(F.col("c") > 0, F.round(1 - F.col("v") / F.col("c"), 4)).alias("validity"))


def timeliness(elapsed_minutes: Column, interval: Column) -> Column:
    """1 up to twice the interval, then falling to 0 in as long again; null without a run before or without monitoring."""
    late = elapsed_minutes - 2 * interval
    return F.when(late <= 0, 1.0).when(late > 0, F.greatest(F.lit(0.0), 1 - late / (2 * interval)))


def with_timeliness(runs: DataFrame, key: str, at: str) -> DataFrame:
    """``runs`` with elapsed_minutes since the run before, timeliness (0 to 100) and the overall score with it.

    ``runs`` has the dimensions of ``score``, and interval: minutes, null where
    a dataset isn't monitored. The overall score is the mean of the rounded
    dimensions that there are.
    """
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 6e7
    rows = runs.withColumn("elapsed_minutes", F.when(F.col("interval").isNotNull(), gap))
    rows = rows.withColumn("timeliness", F.round(100 * timeliness(F.col("elapsed_minutes"), F.col("interval")), 1))
    present = F.filter(F.array(*[F.col(c).cast("double") for c in DIMENSIONS]), lambda x: x.isNotNull())
    mean = F.round(F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present), 1)
    return rows.withColumn("overall", F.when(F.col("timeliness").isNull(), F.col("overall")).when(F.size(present) > 0, mean))


def alerts(history: DataFrame, key: str, at: str, score: str, threshold: float = THRESHOLD) -> DataFrame:
    """key, at, alert and severity: low scores, late runs, drops of the score and of completeness from the run before.

    Late runs are found where ``history`` has elapsed_minutes and interval,
    drops of completeness where it has completeness (0 to 100).
    """
    before = lambda c: F.lag(c).over(Window.partitionBy(key).orderBy(at))
    named = lambda name, severity: F.struct(F.lit(name).alias("alert"), severity.alias("severity"))
    rows = history.withColumn("_drop", before(score) - F.col(score))
    raised = [F.when(F.col(score) < threshold, named("skor_rendah", F.when(F.col(score) < threshold - 15, "tinggi").otherwise("sedang")))]
    if {"elapsed_minutes", "interval"} <= set(history.columns):
        raised.append(F.when(F.col("elapsed_minutes") > 2 * F.col("interval"), named("data_terlambat", F.when(F.col("elapsed_minutes") > 4 * F.col("interval"), "tinggi").otherwise("sedang"))))
    raised.append(F.when(F.col("_drop") >= SCORE_DROP, named("drift_skor", F.when(F.col("_drop") >= 2 * SCORE_DROP, "tinggi").otherwise("sedang"))))
    if "completeness" in history.columns:
        rows = rows.withColumn("_fell", before("completeness") - F.col("completeness"))
        raised.append(F.when(F.col("_fell") >= COMPLETENESS_DROP, named("kolom_kosong_naik", F.lit("rendah"))))
    return rows.select(key, at, F.explode(F.filter(F.array(*raised), lambda x: x.isNotNull())).alias("a")).select(key, at, "a.alert", "a.severity")


def cross_alerts(results: DataFrame) -> DataFrame:
    """``results`` (check, checked, violations) of checks between tables that found something, with alert and severity."""
    ratio = F.when(F.col("checked") > 0, F.col("violations") / F.col("checked")).otherwise(0.0)
    name = F.when(F.col("check") == "consistency", "konsistensi_lintas_sistem").otherwise("integritas_referensial")
    return results.filter("violations > 0").withColumns({"alert": name, "severity": F.when(ratio > 0.1, "tinggi").otherwise("sedang")})


def append_history(scores: DataFrame, path: str) -> None:
    """Adds one run's scores (dataset, at, dimensions) to the table of runs at ``path``."""
    scores.write.mode("append").parquet(path)


def history(spark, path: str, key: str | None = None) -> DataFrame:
    """The runs at ``path``, oldest first; those of one dataset where ``key`` names it."""
    rows = spark.read.parquet(path)
    return (rows if key is None else rows.filter(F.col("dataset") == key)).orderBy("dataset", "at")


def newest(rows: DataFrame, at: str, most: int, *where: Column) -> DataFrame:
    """The ``most`` newest rows: alerts (50), activity (8), datasets (5)."""
    for test in where:
        rows = rows.filter(test)
    return rows.orderBy(F.desc(at)).limit(most)


def resolved(alerts_: DataFrame, done: DataFrame) -> DataFrame:
    """``alerts_`` (id, status) with the ids of ``done`` resolved."""
    marked = done.select("id").distinct().withColumn("_done", F.lit(True))
    return alerts_.join(marked, "id", "left").withColumn("status", F.when(F.col("_done"), "resolved").otherwise(F.col("status"))).drop("_done")


def interval(schedule: str | int) -> int | None:
    """Minutes of a schedule by name or number; None for manual runs."""
    if isinstance(schedule, str):
        if schedule not in SCHEDULES:
            raise ValueError(f"unknown schedule: {schedule}")
        return SCHEDULES[schedule]
    if not INTERVALS[0] <= schedule <= INTERVALS[1]:
        raise ValueError(f"the interval must lie between {INTERVALS[0]} and {INTERVALS[1]} minutes")
    return schedule


def alert_threshold(value: float) -> float:
    if not 0 <= value <= 100:
        raise ValueError("the threshold must lie between 0 and 100")
    return value


# ---------------------------------------------------------------- notices

def alert_notice(alert: str, severity: str, message: str, dataset: str) -> dict:
    """Subject, text and payload of a raised alert."""
    payload = {"event": "alert.created", "alert_type": alert, "severity": severity, "message": message, "dataset": dataset}
    return {"subject": f"Alert {severity}: {alert}", "text": f"{message}\n\nTingkat: {severity}", "payload": payload}


def processed_notice(dataset: str, status: str, quality_score: float | None = None, error: str | None = None) -> dict:
    """Subject, text and payload of a finished or failed run."""
    ready = status == "ready"
    text = f'Dataset "{dataset}" selesai diproses, skor kualitas {quality_score}' if ready else f'Dataset "{dataset}" gagal diproses: {error}'
    payload = {"event": "dataset.processed", "name": dataset, "status": status, "quality_score": quality_score, "error_message": error}
    return {"subject": f'Dataset "{dataset}" {"selesai" if ready else "gagal"} diproses', "text": text, "payload": payload}


def send(notice: dict, channels: dict[str, Callable[[dict], None] | None]) -> dict[str, bool | str | None]:
    """Hands ``notice`` to each channel (webhook, Slack, mail, ...): True, what went wrong, or None where none is set. One that fails stops no other."""
    said: dict[str, bool | str | None] = {}
    for name, deliver in channels.items():
        if deliver is None:
            said[name] = None
            continue
        try:
            deliver(notice)
            said[name] = True
        except Exception as e:  # noqa: BLE001 - a notice that fails must not fail the run
            said[name] = str(e)
    return said
