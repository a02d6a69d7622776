"""Review of clusters: confirm, split, exclude members, merge; and the reports on a table.

Clusters are (cluster, status, cohesion), members (cluster, id), pairs
(cluster, a, b, score). Decisions come as tables, so a whole review is one
join; what can't be applied keeps its state and says why in ``rejected``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.operators.golden import golden

STATES = {"confirm": "confirmed", "split": "split"}


def decide(clusters: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Clusters after ``decisions`` (cluster, action), at most one for each cluster.

    Only pending clusters are decided, and confirming takes two members.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    rows = clusters.join(decisions.select("cluster", "action"), "cluster", "left").join(sizes, "cluster", "left")
    known = F.col("action").isin(*STATES)
    why = F.when(F.col("action").isNull(), F.lit(None)).when(~known, "unknown action").when(F.col("status") != "pending", "already reviewed").when((F.col("action") == "confirm") & (F.coalesce("_n", F.lit(0)) < 2), "fewer than two members")
    state = F.when(F.col("action") == "confirm", STATES["confirm"]).otherwise(STATES["split"])
    rows = rows.withColumn("rejected", why)
    return rows.withColumn("status", F.when(F.col("action").isNotNull() & F.col("rejected").isNull(), state).otherwise(F.col("status"))).drop("action", "_n")


def exclude(clusters: DataFrame, members: DataFrame, pairs: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters and members without ``excluded`` (cluster, id).

    Only pending clusters change. One with fewer than two members left is
    split; else its cohesion is the mean score of the pairs that are left, if
    any are.
    """
    gone = excluded.select("cluster", "id").distinct().join(clusters.filter("status = 'pending'").select("cluster"), "cluster", "left_semi")
    gone = gone.join(members, ["cluster", "id"], "left_semi")
    left = members.join(gone, ["cluster", "id"], "left_anti")
    counts = left.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    kept = pairs
    for side in "ab":
        kept = kept.join(left.select("cluster", F.col("id").alias(side)), ["cluster", side], "left_semi")
    means = kept.groupBy("cluster").agg(F.round(F.avg("score"), 4).alias("_mean"))
    touched = gone.select("cluster").distinct().withColumn("_touched", F.lit(True))
    rows = clusters.join(touched, "cluster", "left").join(counts, "cluster", "left").join(means, "cluster", "left")
    few = F.col("_touched").isNotNull() & (F.coalesce("_n", F.lit(0)) < 2)
    changed = rows.withColumns({"status": F.when(few, "split").otherwise(F.col("status")), "cohesion": F.when(F.col("_touched").isNotNull() & ~few, F.coalesce("_mean", "cohesion")).otherwise(F.col("cohesion"))})
    return changed.drop("_touched", "_n", "_mean"), left


def merge(clusters: DataFrame, members: DataFrame, pairs: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters, members and pairs with each ``other`` of ``merges`` (cluster, other) moved into ``cluster``.

    Both must be pending; cohesion stays that of ``cluster``. A cluster may
    take others or go into one, not both.
    """
    open_ = clusters.filter("status = 'pending'").select("cluster")
    moves = merges.filter("cluster <> other").join(open_, "cluster", "left_semi").join(open_.select(F.col("cluster").alias("other")), "other", "left_semi")
    moves = moves.join(merges.select(F.col("other").alias("cluster")), "cluster", "left_anti").groupBy("other").agg(F.min("cluster").alias("_to"))

    def moved(df: DataFrame) -> DataFrame:
        return df.join(moves, df["cluster"] == moves["other"], "left").withColumn("cluster", F.coalesce("_to", "cluster")).select(*df.columns)

    return clusters.join(moves.select(F.col("other").alias("cluster")), "cluster", "left_anti"), moved(members), moved(pairs)


def labelled_scores(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """score and is_match of the pairs of clusters that were confirmed or split: what a threshold is calibrated by."""
    decided = clusters.filter(F.col("status").isin(*STATES.values())).select("cluster", (F.col("status") == STATES["confirm"]).alias("is_match"))
    return pairs.join(decided, "cluster").select("score", "is_match")


def duplicates(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """The members of clusters that are pending or confirmed."""
    return members.join(clusters.filter("status IN ('pending', 'confirmed')").select("cluster"), "cluster", "left_semi")


def queue(clusters: DataFrame, status: str = "pending") -> DataFrame:
    """The clusters to review, those that hold together best first."""
    return clusters.filter(F.col("status") == status).orderBy(F.desc("cohesion"), "cluster")


def goldens(rows: DataFrame, row_id: str, members: DataFrame, clusters: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """The golden records (cluster, values, provenance) of the confirmed clusters, from ``rows`` as they are; blanks fill nothing."""
    own = members.join(clusters.filter("status = 'confirmed'").select("cluster"), "cluster", "left_semi").select("cluster", F.col("id").alias(row_id))
    return golden(rows.join(own, row_id), "cluster", row_id, strategies, provenance=True)


def differing(rows: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """cluster and, in order, the columns whose text takes more than one value in it (null is a value)."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    seen = rows.groupBy(cluster).agg(*[(F.min(v) != F.max(v)).alias(c) for c, v in text.items()])
    return seen.select(cluster, F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in columns]), lambda x: x.isNotNull()).alias("columns"))


def status_counts(clusters: DataFrame) -> DataFrame:
    """total, pending, confirmed and split clusters."""
    return clusters.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "confirmed", "split")])


def dictionary(profiles: DataFrame, tops: DataFrame, rules: DataFrame, pii: DataFrame) -> DataFrame:
    """A row a column: its profile, most frequent values, rules and kind of personal data.

    ``profiles`` has column and any measures; ``tops`` column, value, count;
    ``rules`` column and rule; ``pii`` column, pii_label and sample_masked.
    Values of columns with personal data are not shown, but a masked one.
    """
    shown: Column = F.concat("value", F.lit(" ("), F.col("count").cast("string"), F.lit(")"))
    # the few values of a column's profile, never its rows
    best = tops.groupBy("column").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("value").cast("string").alias("v"), shown.alias("s")))).alias("_t"))
    named = rules.groupBy("column").agg(F.array_join(F.array_sort(F.collect_set("rule")), "; ").alias("rules"))
    rows = profiles.join(best, "column", "left").join(named, "column", "left").join(pii, "column", "left")
    values = F.array_join(F.transform(F.slice("_t", 1, 5), lambda x: x["s"]), "; ")
    top = F.when(F.col("pii_label").isNotNull(), F.concat(F.lit("[PII: "), "pii_label", F.lit("] contoh: "), "sample_masked")).otherwise(F.coalesce(values, F.lit("")))
    return rows.select(*profiles.columns, top.alias("top_values"), F.coalesce("rules", F.lit("")).alias("rules"), F.coalesce("pii_label", F.lit("")).alias("pii"))
