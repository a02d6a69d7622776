"""Column profiles from one shuffle: every value of every column, counted, gives all statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions import text as tx
from sievelight.operators.rules import as_text
from sievelight.operators.shared import quantile, running_counts, settled

NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")
#: Words that make a column boolean, and hints of a column of names.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "ya", "tidak")
NAME_HINTS = ("nama", "name")
#: Values of a column's profile, and the least number of values for a pattern consistency.
MOST_VALUES, LEAST_VALUES = 10, 5


def value_counts(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """position, value (text, null where a value is missing, blank where it is blank), n and first (the least ``order``), for each value of each column.

    Every row gives one cell a column, which are counted before they travel. Whole doubles are written without a fraction.
    """
    at = F.col(order).cast("long") if order else F.lit(None).cast("long")
    cells = [F.struct(F.lit(i).alias("position"), as_text(df, c).alias("value")) for i, c in enumerate(columns)]
    rows = df.select(at.alias("at"), F.explode(F.array(*cells)).alias("c")).select("at", "c.position", "c.value")
    return rows.groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


def _shares(present: DataFrame) -> DataFrame:
    """position and what its values read as, as shares of the present ones."""
    v = F.lower(tx.stripped(F.col("value")))
    share = lambda ok: F.sum(F.when(ok, F.col("n")).otherwise(0)) / F.sum("n")
    return present.groupBy("position").agg(share(v.isin(*BOOLEAN_WORDS)).alias("b"), share(tx.number(F.col("value"), comma=False).isNotNull()).alias("x"), share(tx.parsed_date(F.col("value")).isNotNull()).alias("d"))


def _type(b: Column, x: Column, d: Column) -> Column:
    return F.when(b == 1, "boolean").when(x > 0.8, "numeric").when(d > 0.8, "date").otherwise("text")


def profile(df: DataFrame, columns: list[str] | None = None, order: str | None = None) -> DataFrame:
    """One row a column: counts, completeness, uniqueness, key candidate, type, lengths, numeric and date statistics, patterns, top values, notes.

    All of it comes from one grouping by (column, value), whose result is
    written once; quantiles come from running counts over ranges of it, so no
    column is gathered in one task. Null and blank values are missing. Types
    and patterns are judged by all values. Equal counts of top values are in
    order of first sight where ``order`` names the row number, else by value.
    An empty table gives rows of zeros. Statistics are not rounded; ``report``
    rounds them.
    """
    columns = columns or [c for c in df.columns if c != order]
    kinds = dict(df.dtypes)
    named = df.sparkSession.createDataFrame([(i, c, kinds[c], kinds[c] in NUMERIC) for i, c in enumerate(columns)], "position int, column string, physical_type string, is_number boolean")
    counts = settled(value_counts(df, columns, order))
    missing = F.col("value").isNull() | (tx.stripped(F.col("value")) == "")
    n = F.col("n")
    of = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    size = F.when(~missing, F.length("value"))
    sums = counts.groupBy("position").agg(
        F.sum("n").alias("rows"), of(missing).alias("null_count"), of(F.col("value").isNotNull() & missing).alias("blank_count"), of(~missing).alias("non_missing"),
        F.count_if(~missing).alias("distinct"), F.min(size).cast("long").alias("min_length"), F.max(size).cast("long").alias("max_length"), (F.sum(size * n) / of(~missing)).alias("mean_length"),
    )
    present = counts.filter(~missing).join(F.broadcast(named.select("position", "is_number")), "position")
    types = named.join(_shares(present.filter("NOT is_number")), "position", "left").select("position", F.when(F.col("is_number"), "numeric").otherwise(_type(F.col("b"), F.col("x"), F.col("d"))).alias("inferred_type"))
    types = settled(types.select("position", F.coalesce("inferred_type", F.lit("text")).alias("inferred_type")))
    typed = present.join(F.broadcast(types), "position")

    x = F.when(F.col("inferred_type") == "numeric", tx.number(F.col("value"), comma=False))
    numbers = typed.withColumn("x", x).filter("x IS NOT NULL").select(F.concat(F.lit("x"), "position").alias("key"), "x", "n")
    lengths = present.select(F.concat(F.lit("l"), "position").alias("key"), F.length("value").cast("double").alias("x"), "n")
    each = numbers.union(lengths).groupBy("key", "x").agg(F.sum("n").alias("n"))
    means = each.groupBy("key").agg((F.sum(F.col("x") * n) / F.sum("n")).alias("mean"))
    ranked = running_counts(each, "key", "x", "n").join(F.broadcast(means), "key")
    spread = F.sum(n * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")))
    found = ranked.groupBy("key").agg(
        F.min("x").alias("minimum"), F.max("x").alias("maximum"), F.first("mean").alias("mean"), quantile("x", "n", 0.5).alias("median"), quantile("x", "n", 0.25).alias("q1"), quantile("x", "n", 0.75).alias("q3"),
        F.when(F.sum("n") > 1, F.sqrt(spread / (F.sum("n") - 1))).otherwise(F.lit(0.0)).alias("std"),
    )
    at = F.substring("key", 2, 9).cast("int").alias("position")
    numeric = found.filter("key LIKE 'x%'").select(at, "minimum", "maximum", "mean", "median", "q1", "q3", "std")
    medians = found.filter("key LIKE 'l%'").select(at, F.col("median").alias("median_length"))
    dates = typed.filter("inferred_type = 'date'").withColumn("d", tx.parsed_date(F.col("value"))).groupBy("position").agg(F.min("d").alias("min_date"), F.max("d").alias("max_date"))
    shapes = typed.filter("inferred_type = 'text'").groupBy("position", tx.shape(F.col("value")).alias("shape")).agg(F.sum("n").alias("n"))
    same = shapes.groupBy("position").agg(F.when(F.sum("n") >= LEAST_VALUES, F.max("n") / F.sum("n")).alias("consistency"))

    best = Window.partitionBy("position").orderBy(F.desc("n"), F.asc_nulls_last("first"), "value")
    tops = present.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= MOST_VALUES).groupBy("position").agg(F.array_sort(F.collect_list(F.struct("k", F.col("value"), F.col("n").alias("count")))).alias("t"))

    out = F.broadcast(named)
    for part in (sums, types, numeric, medians, dates, same, tops):
        out = out.join(F.broadcast(part), "position", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    counted = {c: zero(F.col(c)) for c in ("rows", "null_count", "blank_count", "non_missing", "distinct")}
    out = out.withColumns(counted).withColumns({
        "completeness": F.when(F.col("rows") > 0, F.col("non_missing") / F.col("rows")).otherwise(0.0), "duplicate_count": F.col("non_missing") - F.col("distinct"),
        "uniqueness": F.when(F.col("non_missing") > 0, F.col("distinct") / F.col("non_missing")),
        "is_candidate_key": (F.col("rows") > 0) & (F.col("non_missing") == F.col("rows")) & (F.col("distinct") == F.col("rows")),
        "top_values": F.coalesce(F.transform("t", lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"), (t["count"] / F.col("non_missing")).alias("share"))), F.array().cast("array<struct<value:string,count:bigint,share:double>>")),
    })
    out = out.withColumn("notes", _notes())
    return out.select(
        "position", "column", "physical_type", "inferred_type", "rows", "null_count", "blank_count", "non_missing", "completeness", "distinct", "duplicate_count", "uniqueness", "is_candidate_key",
        "min_length", "max_length", "mean_length", "median_length", "minimum", "maximum", "mean", "median", "q1", "q3", "std", "min_date", "max_date", "consistency", "top_values", "notes",
    ).orderBy("position")


def _notes() -> Column:
    named = F.lit(False)
    for hint in NAME_HINTS:
        named |= F.lower("column").contains(hint)
    # fixed values: the wording is data
    empty = F.when(F.col("completeness") < 0.9, F.concat(F.round((1 - F.col("completeness")) * 100).cast("int").cast("string"), F.lit("% nilai kosong")))
    uneven = F.when((F.col("inferred_type") == "text") & (F.col("consistency") < 0.85), "format tidak seragam, perlu standardisasi")
    spelling = F.when(named & (F.col("uniqueness") < 0.9), "kemungkinan variasi ejaan / duplikat")
    return F.concat_ws("; ", empty, uneven, spelling)


def report(profiles: DataFrame) -> DataFrame:
    """``profiles`` as it is shown: ratios and statistics with four places, lengths with two."""
    four = ("completeness", "uniqueness", "mean", "median", "q1", "q3", "std", "consistency")
    shown = {c: F.round(c, 4) for c in four} | {c: F.round(c, 2) for c in ("mean_length", "median_length")}
    tops = F.transform("top_values", lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"), F.round(t["share"], 4).alias("share")))
    return profiles.withColumns(shown | {"top_values": tops})


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values with count and share of the present ones; ties by value."""
    v = as_text(df, column)
    rows = df.select(v.alias("value")).filter(F.col("value").isNotNull() & (tx.stripped(F.col("value")) != "")).groupBy("value").agg(F.count("*").alias("count"))
    total = rows.agg(F.sum("count").alias("total"))
    return rows.orderBy(F.desc("count"), "value").limit(k).crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") / F.col("total")).alias("share"))


def patterns(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent shapes of a column's values, with one example each."""
    v = as_text(df, column)
    rows = df.select(v.alias("value")).filter(F.col("value").isNotNull() & (tx.stripped(F.col("value")) != ""))
    return rows.groupBy(tx.shape(F.col("value")).alias("pattern")).agg(F.count("*").alias("count"), F.min("value").alias("example")).orderBy(F.desc("count"), "pattern").limit(k)


def inferred_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and boolean, numeric, date or text, by the share of its values that read as each; one pass for all columns."""
    kinds = dict(df.dtypes)
    counts = value_counts(df, columns).filter(F.col("value").isNotNull() & (tx.stripped(F.col("value")) != ""))
    named = df.sparkSession.createDataFrame([(i, c, kinds[c] in NUMERIC) for i, c in enumerate(columns)], "position int, column string, is_number boolean")
    rows = F.broadcast(named).join(_shares(counts), "position", "left")
    kind = F.when(F.col("is_number"), "numeric").otherwise(F.coalesce(_type(F.col("b"), F.col("x"), F.col("d")), F.lit("text")))
    return rows.select("column", kind.alias("inferred_type"))


def inferred_type(df: DataFrame, column: str) -> DataFrame:
    return inferred_types(df, [column])


def numeric_outliers(df: DataFrame, key: str, column: str, most: int | None = 20) -> DataFrame:
    """Rows outside 1.5 interquartile ranges or three deviations, with severity and a sentence; the first ``most`` by key.

    Quartiles come from running counts over ranges of the values, not from one
    task. Columns with fewer than eight values, fewer than three different
    ones, or no spread have none.
    """
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).filter("x IS NOT NULL")
    counts = running_counts(values.groupBy("x").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(0)), "g", "x", "n")
    quartiles = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), quantile("x", "n", 0.25).alias("q1"), quantile("x", "n", 0.75).alias("q3"))
    stats = quartiles.crossJoin(values.agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std")))
    rows = df.select(F.col(key).alias("key"), x.alias("value")).filter("value IS NOT NULL").crossJoin(F.broadcast(stats)).filter("n >= 8 AND d >= 3 AND NOT (q1 = q3 AND std = 0)")
    iqr = F.col("q3") - F.col("q1")
    far = F.greatest(F.col("q1") - F.col("value"), F.col("value") - F.col("q3"))
    z = F.when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0))
    by_iqr = (iqr > 0) & (far > 1.5 * iqr)
    side = F.when(F.col("value") > F.col("mean"), "di atas").otherwise("di bawah")
    # fixed values: the wording is data
    said = F.format_string("Nilai %s jauh %s rentang tipikal kolom (%s–%s); z-score %.1f. Kemungkinan salah input, salah satuan, atau memang kejadian ekstrem — perlu dicek manual.", *(_short(F.col(c)) if c else side for c in ("value", "", "q1", "q3")), z)
    out = rows.filter(by_iqr | (F.abs(z) > 3)).select("key", "value", F.when(by_iqr, "outlier_iqr").otherwise("outlier_zscore").alias("kind"), F.when(((iqr > 0) & (far > 3 * iqr)) | (F.abs(z) > 4), "tinggi").otherwise("sedang").alias("severity"), said.alias("explanation"))
    return out if most is None else out.orderBy("key").limit(most)


def _short(x: Column) -> Column:
    """Six significant digits, without a fraction of zeros."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(F.abs(x), F.lit(1e-4))))).cast("int")
    fixed = F.element_at(F.array(*[F.format_string(f"%.{k}f", x) for k in range(10)]), F.least(digits, F.lit(9)) + 1)
    return F.when(F.abs(x) >= 1e6, F.format_string("%.5e", x)).otherwise(F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def outliers(df: DataFrame, key: str, most: int | None = 20) -> DataFrame:
    """column and the outliers of every numeric column that isn't an identifier, in order of column and key."""
    found = None
    for c, kind in df.dtypes:
        if kind in NUMERIC and c != key and not is_identifier(c):
            own = numeric_outliers(df, key, c, most).select(F.lit(c).alias("column"), "*")
            found = own if found is None else found.union(own)
    if found is None:
        return df.sparkSession.createDataFrame([], f"column string, key {dict(df.dtypes)[key]}, value double, kind string, severity string, explanation string")
    return found.orderBy("column", "key")


#: Hints of identifier columns.
ID_HINTS = ("nik", "ktp", "hp", "phone", "telp", "kode", "npwp")


def is_identifier(name: str) -> bool:
    low = name.lower()
    return low == "id" or low.endswith("_id") or low.startswith("id_") or any(h in low for h in ID_HINTS)


def latest(df: DataFrame, key: str, at: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key; of equally new ones that with the greatest ``tie``, or any of them."""
    order = [F.desc(at), *([F.desc(tie)] if tie else [])]
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_place = 1").drop("_place")
