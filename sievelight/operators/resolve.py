"""Entity resolution: block keys, candidate pairs, scores, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions import similarity as sim
from sievelight.functions import text as tx
from sievelight.operators.shared import running_counts, settled

#: Rows of a block at most; what is shared by more says nothing. None takes blocks of any size.
BLOCK_ROWS = 60


def block_keys(method: str, values: list[Column], length: int = 3) -> Column:
    """The block keys of a row as an array, from normalised values; none where one of them is missing."""
    present = F.lit(True)
    for v in values:
        present &= v != ""
    v = values[0]
    close = F.regexp_replace(v, r"\s+", "")
    keys = {
        "exact": lambda: F.array(F.concat_ws("|", *values)), "composite_exact": lambda: F.array(F.concat_ws("|", *values)), "prefix": lambda: F.array(F.left(close, F.lit(length))),
        "token_prefix": lambda: F.array(tx.name_block(v)), "phonetic": lambda: F.array(tx.phonetic(v)), "ngram": lambda: tx.ngrams(v, length),
        "email_local": lambda: F.array(F.left(F.split(v, "@")[0], F.lit(length))), "phone_suffix": lambda: F.array(F.right(F.regexp_replace(v, "[^0-9]", ""), F.lit(length))),
    }[method]()
    return F.when(present, F.filter(keys, lambda k: k != "")).otherwise(F.array().cast("array<string>"))


def _labelled(name: str, keys: Column) -> Column:
    return F.transform(keys, lambda x: F.concat(F.lit(f"{name}:"), x))


def _keyed(df: DataFrame, row_id: str, rules: list[tuple[str, Column]]) -> DataFrame:
    return df.select(F.col(row_id).alias("id"), F.explode(F.concat(*[_labelled(n, k) for n, k in rules])).alias("block")).distinct()


def blocks(df: DataFrame, row_id: str, rules: list[tuple[str, Column]], most: int = BLOCK_ROWS) -> DataFrame:
    """block and its member ids (sorted), for blocks of 2 to ``most`` rows; larger ones are counted, never gathered (``left_out`` names them)."""
    keyed = _keyed(df, row_id, rules)
    sizes = keyed.groupBy("block").agg(F.count("*").alias("size")).filter(F.col("size").between(2, most))
    return keyed.join(sizes, "block").groupBy("block").agg(F.array_sort(F.collect_list("id")).alias("members"))


def left_out(df: DataFrame, row_id: str, rules: list[tuple[str, Column]], most: int = BLOCK_ROWS) -> DataFrame:
    """block and size of the blocks of more than ``most`` rows, which ``blocks`` passes over."""
    return _keyed(df, row_id, rules).groupBy("block").agg(F.count("*").alias("size")).filter(F.col("size") > most)


def candidate_pairs(blocks_: DataFrame) -> DataFrame:
    """Distinct pairs a < b of the members of a block."""
    pairs = F.flatten(F.transform("members", lambda x, i: F.transform(F.slice("members", i + 2, F.size("members")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return blocks_.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def pairs_within(df: DataFrame, row_id: str, rules: list[tuple[str, Column]], most: int | None = BLOCK_ROWS) -> DataFrame:
    """Distinct pairs a < b of rows that share a block; ``most`` None takes blocks of any size, whose pairs are joined, never gathered or sorted."""
    if most is not None:
        return candidate_pairs(blocks(df, row_id, rules, most))
    members, linked = classes(df, row_id, rules)
    left, right = members.withColumnRenamed("id", "a"), members.withColumnRenamed("id", "b")
    return left.join(right, "class").filter("a < b").select("a", "b").union(_across(members, linked))


def classes(df: DataFrame, row_id: str, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Blocks of any size without their pairs: class and id of each row that has blocks, and the pairs of classes (x, y) that share one.

    A class is the rows with the same set of blocks: any two of them are a
    pair, and so is any row of one class with any of another that is linked to
    it. Each pair of rows follows from one class or one pair of classes.
    """
    keys = F.array_sort(F.array_distinct(F.concat(*[_labelled(n, k) for n, k in rules])))
    rows = settled(df.select(F.col(row_id).alias("id"), keys.alias("blocks")).filter(F.size("blocks") > 0).distinct().withColumn("class", F.unhex(F.sha2(F.to_json("blocks"), 256))))
    held = rows.select("class", "blocks").distinct().select("class", F.explode("blocks").alias("block"))
    linked = held.withColumnRenamed("class", "x").join(held.withColumnRenamed("class", "y"), "block").filter("x < y").select("x", "y").distinct()
    return rows.select("class", "id"), linked


def _across(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs a < b of rows of classes that are linked."""
    sides = [members.select(F.col("class").alias(k), F.col("id").alias(f"id_{k}")) for k in "xy"]
    return linked.join(sides[0], "x").join(sides[1], "y").select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))


def pair_totals(df: DataFrame, row_id: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """pairs, a and b: the number of pairs that ``pairs_within`` finds in blocks of any size, and the sums of their ids (null without pairs).

    A row stands first in as many pairs of its class as rows come after it,
    second in as many as come before it: pairs inside a class are not built.
    """
    members, linked = classes(df, row_id, rules)
    ranked = running_counts(members.withColumn("n", F.lit(1)), "class", "id", "n").filter("total > 1")
    before = F.col("below").cast("long")
    after = F.col("total") - before - 1
    inside = ranked.agg(F.sum(after).alias("pairs"), F.sum(F.col("id") * after).alias("a"), F.sum(F.col("id") * before).alias("b"))
    across = _across(members, linked).agg(F.count(F.lit(1)).alias("pairs"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return inside.union(across).agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def term_frequencies(df: DataFrame, value: Column) -> DataFrame:
    """Each present normalised value and its share."""
    counts = df.select(value.alias("value")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("value", (F.col("n") / F.col("all")).alias("share"))


METHODS = {
    "exact": lambda a, b: (a == b).cast("double"), "phone": lambda a, b: (a == b).cast("double"), "composite_exact": lambda a, b: (a == b).cast("double"),
    "email": lambda a, b: F.when(a == b, 1.0).otherwise(0.5 * sim.fuzzy_ratio(a, b)), "fuzzy_ratio": sim.fuzzy_ratio, "token_sort": sim.token_sort, "token_set": sim.token_set,
    "jaro_winkler": sim.jaro_winkler_similarity, "phonetic": lambda a, b: sim.jaro_winkler_similarity(tx.phonetic(a), tx.phonetic(b)),
}


def similarity(method: str, a: Column, b: Column) -> Column:
    """A method's score; null where a side is missing."""
    return F.when((a != "") & (b != ""), METHODS[method](a, b))


def log_odds(score: Column, equal: Column, share_a: Column, share_b: Column, weight: float = 2.0, m: float = 0.95, most_u: float = 0.25, fuzzy_u: float = 0.25, penalty: float = 0.0, mismatch: float = 0.2) -> Column:
    """What one rule adds to the log odds of a match; 0 where the score is null."""
    u = F.least(F.greatest(share_a, share_b, F.lit(1e-4)), F.lit(most_u))
    u = F.when(equal, u).otherwise(F.greatest(u, F.lit(fuzzy_u)))
    value = weight * (score * F.log(F.lit(m) / u) + (1 - score) * F.log(F.lit(1 - m) / F.greatest(1 - u, F.lit(1e-4))))
    if penalty > 0:
        value = value + F.when(score <= mismatch, F.log(F.greatest(F.lit(1 - penalty), F.lit(0.001)))).otherwise(0.0)
    return F.coalesce(value, F.lit(0.0))


def probability(terms: list[Column], prior: float = 0.05) -> Column:
    total = F.log(F.lit(prior / (1 - prior)))
    for t in terms:
        total = total + t
    return 1 / (1 + F.exp(-total))


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and cluster (its least id) of every id in ``pairs`` (a, b), by large-star and small-star (Kiveris et al., 2014).

    A round halves the depth of trees and is written to the checkpoint folder;
    two numbers a round reach the driver.
    """
    down = lambda df: df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = settled(down(pairs.filter("a <> b")).distinct())
    mark = None
    for _ in range(most_rounds):
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark or not now[0]:
            roots = edges.select(F.col("u").alias("id"), F.col("v").alias("cluster"))
            return roots.union(roots.select("cluster", "cluster").distinct())
        mark = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        edges = settled(down(small).distinct())
    raise RuntimeError("components did not settle")


def calibrate(scores: DataFrame) -> DataFrame:
    """One row: available, positive and negative pairs, and the threshold with the best balanced accuracy, then specificity, then the highest.

    ``scores`` has score and is_match. Candidates are 0.1, 1 and every score,
    to four places. Without pairs of both kinds nothing is recommended.
    Counts run over ranges of the scores, not in one task.
    """
    rows = scores.filter("score IS NOT NULL AND is_match IS NOT NULL").select("score", F.col("is_match").cast("boolean").alias("m"))
    ends = scores.sparkSession.createDataFrame([(0.1,), (1.0,)], "score double").select("score", F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(True).alias("c"))
    tried = rows.select(F.round("score", 4).alias("score"), F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(True).alias("c"))
    counted = rows.select(F.col("score").cast("double"), F.col("m").cast("int").alias("p"), (~F.col("m")).cast("int").alias("n"), F.lit(False).alias("c"))
    by = ends.union(tried).union(counted).groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("c").alias("c")).withColumn("g", F.lit(0))
    by = running_counts(by, "g", "score", "p").withColumnsRenamed({"below": "p_below", "total": "all_p"})
    by = running_counts(by, "g", "score", "n").withColumnsRenamed({"below": "n_below", "total": "all_n"})
    rates = by.filter("c AND all_p > 0 AND all_n > 0").select(F.round("score", 4).alias("threshold"), (1 - F.col("p_below") / F.col("all_p")).alias("sensitivity"), (F.col("n_below") / F.col("all_n")).alias("specificity"))
    rates = rates.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)
    best = rates.agg(F.max_by(F.struct("threshold", "sensitivity", "specificity", "balanced_accuracy"), F.struct(F.round("balanced_accuracy", 4), F.round("specificity", 4), "threshold")).alias("b"))
    sums = rows.agg(F.count_if("m").alias("positive_pairs"), F.count_if(~F.col("m")).alias("negative_pairs"))
    return sums.crossJoin(best).select((F.col("b").isNotNull()).alias("available"), "positive_pairs", "negative_pairs", "b.threshold", "b.sensitivity", "b.specificity", "b.balanced_accuracy")
