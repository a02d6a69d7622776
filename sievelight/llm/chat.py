"""Chat formatting: collapse of cumulative snapshots, then rendering. DataFrame functions only.

Loggers often write a conversation again after every turn. A conversation
whose turns are the first turns of a longer one, or all the turns of another
with a smaller id, adds nothing. Each turn gets the rolling hash of its
conversation's prefix up to it; an anti-join of whole-conversation hashes
against proper-prefix hashes keeps the maximal conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.llm.common import table

#: Turns of one conversation that are summed in one task.
STRETCH = 1024
_SUMS = ("p0", "p1", "p2")


def _turn_hashes() -> list[Column]:
    """Three hashes of 40 bits of a turn, its number included, and which of its columns are null: their running sums stay exact for eight million turns."""
    parts = [x for c in ("turn", "role", "text") for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(salt), *parts).bitwiseAND(F.lit((1 << 40) - 1)).alias(name) for salt, name in enumerate(_SUMS)]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, last and the hash (p0, p1, p2) of the conversation up to that turn.

    A prefix hash is the sum of the hashes of its numbered turns, so a long
    conversation is summed in stretches of ``STRETCH`` turn numbers by
    different tasks and the stretches' own sums are added after that.
    """
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.lit(1).alias("one")).select("conv_id", F.coalesce(F.col("turn"), F.lit(-1)).alias("turn"), *_turn_hashes())
    at_turn = rows.groupBy("conv_id", "turn").agg(*[F.sum(p).alias(p) for p in _SUMS]).withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    sums = at_turn.groupBy("conv_id", "stretch").agg(*[F.sum(p).alias(p) for p in _SUMS])
    ahead = Window.partitionBy("conv_id").orderBy("stretch")
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("conv_id").alias("conv"), F.col("stretch").alias("at"), *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(f"b{p}") for p in _SUMS], F.lead("stretch").over(ahead).isNull().alias("final"))
    running = at_turn.select("conv_id", "stretch", "turn", *[F.sum(p).over(inside).alias(p) for p in _SUMS], F.lead("turn").over(Window.partitionBy("conv_id", "stretch").orderBy("turn")).isNull().alias("ends"))
    joined = running.join(bases, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("stretch") == F.col("at")))
    return joined.select("conv_id", "turn", (F.col("ends") & F.col("final")).alias("last"), *[(F.col(p) + F.col(f"b{p}")).alias(p) for p in _SUMS])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that no longer one begins with; of equal ones the smallest id (a null id last)."""
    hashes = prefix_hashes(turns)
    whole = hashes.filter("last").groupBy(*_SUMS).agg(F.min("conv_id").alias("conv_id"))
    proper = hashes.filter(~F.col("last")).select(*_SUMS).distinct()
    return whole.join(proper, list(_SUMS), "left_anti").select("conv_id")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and the conversation as marked-up text, turns in order of turn, role and text."""
    turn = F.struct(F.coalesce("turn", F.lit(-1)).alias("at"), "role", "text", "turn")
    shown = lambda c: F.coalesce(c, F.lit(""))
    marked = F.transform("turns", lambda t: F.concat(F.lit("<|"), shown(t["role"]), F.lit("|>\n"), shown(t["text"]), F.lit("<|end|>\n")))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(marked, "").alias("rendered"))


def chat_format(conversations: DataFrame) -> DataFrame:
    """Collapse snapshots of ``conversations`` (conv_id, turn, role, text) and render what stays.

    Repeated rows count once. A null turn stands where turn -1 would, a null
    role or text before an empty one and is rendered empty; in comparison null
    equals null alone. Rows without conv_id form one conversation. A rendered
    conversation is one text, however long. Turn numbers are part of a turn.
    Other columns are ignored; an empty table gives no rows.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kept = maximal_conversations(turns).select(F.col("conv_id").alias("kept_id"))
    return render(turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
convs AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY coalesce(turn, -1), role NULLS FIRST, text NULLS FIRST) AS seq FROM turns GROUP BY conv_id),
firsts AS (SELECT min(conv_id) AS conv_id, seq FROM convs GROUP BY seq),
prefixes AS (SELECT DISTINCT seq[1:k] AS seq FROM (SELECT seq, unnest(range(1, len(seq))) AS k FROM convs)),
kept AS (SELECT conv_id FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.seq = f.seq))
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY coalesce(turn, -1), role NULLS FIRST, text NULLS FIRST) AS rendered
FROM turns WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id
"""
