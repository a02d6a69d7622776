"""Scorecard and dashboard of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.operators.monitor import DIMENSIONS, column_validity, newest
from sievelight.operators.review import status_counts

#: Sections of a scorecard, in order, with the names of their cells (fixed values).
SECTIONS = (
    ("Dataset", ("name", "row_count", "quality_score")), ("Dimensi", ("dimension", "score")), ("Kolom", ("column", "inferred_type", "completeness", "uniqueness", "validity", "consistency", "notes")),
    ("Rule", ("rule", "column", "checked", "violations")), ("Cluster", ("total", "pending", "confirmed", "split")),
)


def _section(i: int, rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows of a section as cells of text, after a row of names; a section has as many rows as a table has columns or rules."""
    from pyspark.sql import Window

    title, names = SECTIONS[i]
    body = rows.select(F.lit(i).alias("section"), F.row_number().over(Window.partitionBy(F.lit(i)).orderBy(*order)).alias("place"), F.array(*[F.col(c).cast("string") for c in names]).alias("cells"))
    head = rows.sparkSession.range(1).select(F.lit(i).alias("section"), F.lit(0).alias("place"), F.array(*[F.lit(c) for c in names]).alias("cells"))
    return head.union(body).withColumn("title", F.lit(title))


def scorecard(name: str, profiles: DataFrame, results: DataFrame, clusters: DataFrame, score: DataFrame) -> DataFrame:
    """section, place, cells and title of a scorecard's lines; place 0 names the cells.

    ``profiles`` as from ``profile.report``, ``results`` (rule, column,
    checked, violations), ``clusters`` (status), ``score`` as from
    ``monitor.score``.
    """
    spark = profiles.sparkSession
    rows = profiles.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("row_count"))
    whole = rows.crossJoin(score.select(F.col("overall").alias("quality_score"))).withColumn("name", F.lit(name))
    own = [c for c in DIMENSIONS if c in score.columns]
    dims = score.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("score")) for c in own])).alias("at", "d")).select("at", "d.*").filter("score IS NOT NULL")
    columns = profiles.join(column_validity(results), "column", "left")
    tables = [(whole, ["name"]), (dims, ["at"]), (columns, ["position"]), (results, ["column", "rule"]), (status_counts(clusters), ["total"])]
    out = spark.createDataFrame([], "section int, place int, cells array<string>, title string")
    for i, (table, order) in enumerate(tables):
        out = out.union(_section(i, table, [F.col(c) for c in order]))
    return out


def markdown_line() -> Column:
    """A scorecard's line in Markdown: a heading and a table head before a section's rows."""
    row = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("cells")))
    return F.when(F.col("place") == 0, F.concat(F.lit("\n## "), "title", F.lit("\n\n"), row, F.lit("\n"), rule)).otherwise(row)


def pending_by_dataset(clusters: DataFrame) -> DataFrame:
    """dataset and its number of clusters that wait for review."""
    return clusters.filter("status = 'pending'").groupBy("dataset").agg(F.count(F.lit(1)).alias("pending"))


def dashboard(datasets: DataFrame, clusters: DataFrame, alerts: DataFrame) -> DataFrame:
    """total_datasets, avg_quality_score, duplicate_clusters and active_alerts."""
    one = datasets.agg(F.count(F.lit(1)).alias("total_datasets"), F.round(F.avg("quality_score"), 1).alias("avg_quality_score"))
    found = clusters.join(datasets.select(F.col("name").alias("dataset")), "dataset", "left_semi").agg(F.count(F.lit(1)).alias("duplicate_clusters"))
    return one.crossJoin(found).crossJoin(alerts.agg(F.count_if(F.col("status") == "open").alias("active_alerts")))


def recent_datasets(datasets: DataFrame, clusters: DataFrame, most: int = 5) -> DataFrame:
    """The newest datasets with their clusters that wait for review."""
    rows = newest(datasets, "updated_at", most).join(pending_by_dataset(clusters).withColumnRenamed("dataset", "name"), "name", "left")
    return rows.withColumn("pending", F.coalesce("pending", F.lit(0))).orderBy(F.desc("updated_at"))
