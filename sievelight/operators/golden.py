"""Golden records by survivorship, and the clean export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators.privacy import mask, roles, standard_forms, standardize

STRATEGIES = ("latest_update", "first_non_null", "most_frequent", "longest", "source_priority")


#: The rule that provenance names where all rows of a cluster agree.
AGREED = "same_in_all"


def _moment(df: DataFrame, column: str | None) -> Column:
    """When a row was updated: text is read as a date, day first; null where it can't be."""
    if column is None:
        return F.lit(None).cast("timestamp")
    return tx.parsed_timestamp(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)


def golden(df: DataFrame, key: str, order: str, strategies: dict[str, str], updated: str | None = None, source: str | None = None, priority: list[str] | None = None, provenance: bool = False) -> DataFrame:
    """One row a cluster: each column of ``strategies`` by its rule; blanks never win; ties by ``order``.

    ``updated`` and ``source`` name the columns of time and origin; where they
    aren't given they are found by name. A rule that isn't known is
    ``latest_update`` where there is a time, else ``first_non_null``. With
    ``provenance`` a map tells for each column the ``order`` of the row that
    the value comes from and the rule: ``same_in_all`` where all rows agree,
    and a row of null where all are blank. ``order`` is a number.
    """
    known = roles([c for c in df.columns if c not in (key, order)])
    updated, source = updated or known.get("updated"), source or known.get("source")
    default = "latest_update" if updated else "first_non_null"
    rules = {c: s if s in STRATEGIES else default for c, s in strategies.items()}
    o, when = F.col(order), _moment(df, updated)
    ranks = F.array(*[F.lit(p.strip().lower()) for p in priority or []]).cast("array<string>")
    place = F.array_position(ranks, F.lower(tx.stripped(F.col(source).cast("string")))) if source else F.lit(0)
    place = F.when(place > 0, place).otherwise(F.lit(1 << 20))

    def present(c: str) -> Column:
        return F.col(c).isNotNull() & (tx.stripped(F.col(c).cast("string")) != "")

    sums: list[Column] = []
    for i, (c, rule) in enumerate(rules.items()):
        ok, text = present(c), F.col(c).cast("string")
        wins = {"latest_update": F.struct(when.alias("w"), (-o).alias("o")), "source_priority": F.struct((-place).alias("p"), when.alias("w"), (-o).alias("o")), "longest": F.struct(F.length(text).alias("n"), (-o).alias("o"))}.get(rule, F.struct((-o).alias("o")))
        sums.append(F.max_by(F.struct(F.col(c).alias("v"), o.alias("o")), F.when(ok, wins)).alias(f"_{i}"))
        sums.append(((F.min(F.when(ok, text)) == F.max(F.when(ok, text))) & (F.count_if(ok) == F.count(F.lit(1)))).alias(f"_same_{i}"))
    out = df.groupBy(key).agg(*sums)

    voted = [i for i, r in enumerate(rules.values()) if r == "most_frequent"]
    names = list(rules)
    if voted:
        # a cluster's values are counted, then the best of each column is taken: two aggregations for all such columns
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.when(present(names[i]), F.col(names[i]).cast("string")).alias("t")) for i in voted]))
        counts = df.select(key, o.alias("o"), cells.alias("c")).select(key, "o", "c.*").filter("t IS NOT NULL").groupBy(key, "i", "t").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
        best = counts.groupBy(key).agg(*[F.max_by(F.struct(F.col("t"), F.col("o")), F.when(F.col("i") == i, F.struct(F.col("n"), (-F.col("o")).alias("f")))).alias(f"_vote_{i}") for i in voted])
        out = out.join(best, key, "left")
        kinds = dict(df.dtypes)
        out = out.withColumns({f"_{i}": F.when(F.col(f"_vote_{i}").isNotNull(), F.struct(F.col(f"_vote_{i}.t").cast(kinds[names[i]]).alias("v"), F.col(f"_vote_{i}.o").alias("o"))) for i in voted})
    told = []
    for i, (c, rule) in enumerate(rules.items()):
        told += [F.lit(c), F.struct(F.col(f"_{i}.o").cast("long").alias("record_index"), F.when(F.col(f"_same_{i}"), AGREED).otherwise(rule).alias("rule"))]
    return out.select(key, *[F.col(f"_{i}.v").alias(c) for i, c in enumerate(names)], *([F.create_map(*told).alias("provenance")] if provenance else []))


def clean(df: DataFrame, row_id: str, members: DataFrame, goldens: DataFrame) -> DataFrame:
    """One golden row for each confirmed cluster that has one, and all other rows with their status.

    ``members``: row_id, cluster, status; ``goldens``: cluster and values. The
    golden row takes the place of its cluster's first row and lists the rows
    it stands for; sort by ``row_id`` for the order of ``df``.
    """
    status = members.select(F.col(row_id).alias("_id"), F.col("cluster").alias("_dq_cluster_id"), "status").join(df.select(F.col(row_id).alias("_id")), "_id", "left_semi")
    merged = status.filter("status = 'confirmed'").join(goldens.select(F.col("cluster").alias("_dq_cluster_id")), "_dq_cluster_id", "left_semi")
    rest = df.join(merged.select("_id"), F.col(row_id) == F.col("_id"), "left_anti")
    label = F.when(F.col("status").isNull(), "unique").when(F.col("status") == "split", "reviewed_distinct").otherwise("pending_review")
    labelled = rest.join(status, F.col(row_id) == F.col("_id"), "left").withColumn("_dq_status", label).drop("_id", "status")
    names = F.array_join(F.transform(F.array_sort(F.collect_list("_id")), lambda x: F.concat(F.lit("r-"), x.cast("string"))), ",")
    first = merged.groupBy("_dq_cluster_id").agg(F.min("_id").alias(row_id), names.alias("_dq_source_rows"))
    golden_ = goldens.withColumnRenamed("cluster", "_dq_cluster_id").drop(row_id).join(first, "_dq_cluster_id").withColumn("_dq_status", F.lit("golden_record"))
    return labelled.unionByName(golden_, allowMissingColumns=True)


def clean_export(df: DataFrame, row_id: str, members: DataFrame, goldens: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """The clean table in the order of ``df``: rows in standard form, confirmed clusters as their golden rows (as they were), all in order of ``row_id``.

    ``kinds`` (column to kind of personal data) are masked.
    """
    rows = standardize(df, standard_forms(df, [c for c in df.columns if c != row_id]))
    out = clean(rows, row_id, members, goldens)
    return (mask(out, kinds) if kinds else out).orderBy(row_id)


def export_summary(df: DataFrame, row_id: str, members: DataFrame, goldens: DataFrame) -> DataFrame:
    """original_rows, clean_rows, clusters_merged, rows_collapsed, pending_review_rows and reviewed_distinct_rows of ``clean``."""
    inside = members.join(df.select(row_id), row_id, "left_semi").join(goldens.select("cluster").withColumn("_golden", F.lit(True)), "cluster", "left")
    merged = (F.col("status") == "confirmed") & F.col("_golden").isNotNull()
    left = ~F.coalesce(merged, F.lit(False))
    counts = inside.agg(
        F.count_distinct(F.when(merged, F.col("cluster"))).alias("clusters_merged"), F.count_if(merged).alias("rows_collapsed"),
        F.count_if(left & (F.col("status") != "split")).alias("pending_review_rows"), F.count_if(left & (F.col("status") == "split")).alias("reviewed_distinct_rows"),
    )
    whole = df.agg(F.count(F.lit(1)).alias("original_rows")).crossJoin(counts)
    return whole.select("original_rows", (F.col("original_rows") - F.col("rows_collapsed") + F.col("clusters_merged")).alias("clean_rows"), "clusters_merged", "rows_collapsed", "pending_review_rows", "reviewed_distinct_rows")
