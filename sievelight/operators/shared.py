"""Tables that a plan settles on, and running counts over a global order without a single task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the cluster names and read from there: lineage ends here.

    Only a local session, as in tests, gets a folder of its own where none is
    named.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="sievelight-"))
    return df.checkpoint()


def running_counts(df: DataFrame, group: str, by: str, n: str, descending: bool = False) -> DataFrame:
    """``df`` with ``below``, the sum of ``n`` over the rows of the same group that come before in order of ``by``, and ``total``.

    Rows of equal (group, by) should be one row. Rows are dealt by range, not
    by group, so that a group of any size is sorted in parts; what travels to
    all tasks is one number for each part and group in it.
    """
    order = F.desc(by) if descending else F.asc(by)
    parts = settled(df.repartitionByRange(F.asc(group), order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(group, "_part").agg(F.sum(n).alias("_sum"))
    whole = Window.partitionBy(group)
    offsets = sums.select(group, "_part", F.coalesce(F.sum("_sum").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.sum("_sum").over(whole).alias("total"))
    within = Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.join(offsets, [group, "_part"]).withColumn("below", F.col("_offset") + F.coalesce(F.sum(n).over(within), F.lit(0)))
    return rows.drop("_part", "_offset")


def quantile(x: str, n: str, share: float) -> Column:
    """The linearly interpolated quantile, as an aggregate over rows of ``running_counts``."""
    at = F.col("total").cast("double") - 1
    low = F.floor(at * share)
    end = F.col("below") + F.col(n)
    first, second = (F.min(F.when(end > k, F.col(x))) for k in (low, F.least(low + 1, F.col("total") - 1)))
    return first + (second - first) * F.max(at * share - low)
