"""Checks between two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators.rules import as_text

#: Examples that a check shows; texts that stand for no value (fixed values).
SAMPLES, NO_VALUE = 10, ("nan", "None", "<NA>")


def _need(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"unknown column: {column}")


def _keys(df: DataFrame, column: str, *others: str) -> DataFrame:
    _need(df, column)
    v = tx.stripped(as_text(df, column))
    return df.select(v.alias("key"), *others).filter((F.col("key").isNotNull()) & (F.col("key") != ""))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str, order: str | None = None, most: int | None = None) -> DataFrame:
    """The child's keys that the parent lacks, with their number of rows; the ``most`` first seen where ``order`` names the row number."""
    first = [F.min(order).alias("first")] if order else []
    counts = _keys(child, column, *([order] if order else [])).groupBy("key").agg(F.count("*").alias("rows"), *first)
    lost = counts.join(_keys(parent, parent_column).distinct(), "key", "left_anti")
    return lost if most is None else lost.orderBy(*(["first"] if order else []), "key").limit(most)


def referential_integrity(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """checked, matched, violations, key_overlap and orphan_rate; blank and null child keys are not checked."""
    counts = _keys(child, column).groupBy("key").agg(F.count("*").alias("rows"))
    known = _keys(parent, parent_column).distinct().withColumn("known", F.lit(True))
    sums = counts.join(known, "key", "left").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("checked"), F.coalesce(F.sum(F.when(F.col("known"), F.col("rows"))), F.lit(0)).alias("matched"))
    out = sums.withColumn("violations", F.col("checked") - F.col("matched"))
    return out.withColumns({"key_overlap": F.when(F.col("checked") > 0, F.col("matched") / F.col("checked")), "orphan_rate": F.when(F.col("checked") > 0, F.col("violations") / F.col("checked"))})


def _value(c: Column) -> Column:
    return F.when(~c.isin(*NO_VALUE), F.lower(tx.stripped(c)))


def _joined(a: DataFrame, a_key: str, a_value: str, b: DataFrame, b_key: str, b_value: str, order: str | None) -> DataFrame:
    for df, column in ((a, a_key), (a, a_value), (b, b_key), (b, b_value)):
        _need(df, column)
    left = a.select(as_text(a, a_key).alias("key"), as_text(a, a_value).alias("x"), *([F.col(order).alias("at")] if order else [])).dropna(subset=["key", "x"])
    right = b.select(as_text(b, b_key).alias("key"), as_text(b, b_value).alias("y")).dropna()
    # a value that says it is none differs from every value, another such one included
    return left.join(right, "key").withColumn("differ", F.coalesce(_value(F.col("x")) != _value(F.col("y")), F.lit(True)))


def consistency(a: DataFrame, a_key: str, a_value: str, b: DataFrame, b_key: str, b_value: str) -> DataFrame:
    """checked and violations of values that two tables hold under equal keys; case and outer blanks don't count."""
    return _joined(a, a_key, a_value, b, b_key, b_value, None).agg(F.count("*").alias("checked"), F.count_if("differ").alias("violations"))


def inconsistencies(a: DataFrame, a_key: str, a_value: str, b: DataFrame, b_key: str, b_value: str, order: str, most: int = SAMPLES) -> DataFrame:
    """The first ``most`` differing values in order of the first table's rows, as one text each."""
    rows = _joined(a, a_key, a_value, b, b_key, b_value, order).filter("differ").orderBy("at", "y").limit(most)
    return rows.select(F.concat("key", F.lit(': "'), "x", F.lit('" vs "'), "y", F.lit('"')).alias("sample"))
