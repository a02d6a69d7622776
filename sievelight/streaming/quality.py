"""Quality of a stream: tumbling windows of rule results. Beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.operators.rules import Rule, predicate


def windowed_validity(events: DataFrame, at: str, rules: list[Rule], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """checked and violations of all ``rules`` together for each window of event time; batch or streaming input."""
    broken = F.lit(0)
    for r in rules:
        broken = broken + (~predicate(events, r)).cast("int")
    rows = events.select(F.col(at).alias("at"), broken.alias("broken"))
    rows = rows.withWatermark("at", late) if events.isStreaming else rows
    return rows.groupBy(F.window("at", width)).agg((F.count("*") * len(rules)).alias("checked"), F.sum("broken").cast("long").alias("violations")).select(F.col("window.start").alias("start"), "checked", "violations")
