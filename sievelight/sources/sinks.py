"""Writing tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators import golden, privacy, report


def write_csv(df: DataFrame, path: str) -> None:
    """``df`` as delimited files with a header, one for each of its partitions, in its order."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_standardized(df: DataFrame, path: str) -> None:
    """The table in standard form."""
    write_csv(privacy.standardize(df), path)


def write_clean(df: DataFrame, path: str, row_id: str, members: DataFrame, goldens: DataFrame, mask_pii: bool = False) -> None:
    """The clean table, with personal data masked where asked for."""
    kinds = {r["column"]: r["pii_type"] for r in privacy.detect(df, [c for c in df.columns if c != row_id]).collect()} if mask_pii else None
    write_csv(golden.clean_export(df, row_id, members, goldens, kinds), path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    write_csv(dictionary.coalesce(1), path)


def write_scorecard(lines: DataFrame, path: str) -> None:
    """The lines of ``report.scorecard`` as one file of delimited text."""
    quoted = F.transform("cells", lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')))
    lines.orderBy("section", "place").select(F.array_join(quoted, ",").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_markdown(lines: DataFrame, path: str) -> None:
    """The scorecard as Markdown, in place of a printed page."""
    lines.select("section", "place", report.markdown_line().alias("value")).orderBy("section", "place").select("value").coalesce(1).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- catalogue


def register(spark: SparkSession, catalogue: str, name: str, path: str, rows: int, columns: int, score: float | None = None, source: str = "upload") -> None:
    """Adds a dataset's entry to the table at ``catalogue``; the newest entry of a name holds."""
    entry = [(name, path, rows, columns, score, source)]
    spark.createDataFrame(entry, "name string, path string, row_count long, column_count long, quality_score double, source string").withColumn("updated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(catalogue)


def entries(spark: SparkSession, catalogue: str) -> DataFrame:
    """The newest entry of each dataset, newest first."""
    newest = spark.read.parquet(catalogue).groupBy("name").agg(F.max_by(F.struct("path", "row_count", "column_count", "quality_score", "source", "updated_at"), "updated_at").alias("e"))
    return newest.select("name", "e.*").orderBy(F.desc("updated_at"), "name")


def apply_standard(spark: SparkSession, df: DataFrame, catalogue: str, name: str, path: str) -> DataFrame:
    """Writes the table in standard form as a new dataset, registers it and reads it back."""
    privacy.standardize(df).write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    register(spark, catalogue, name, path, out.count(), len(out.columns), source="standardize")
    return out
