"""Chat formatting with cumulative-snapshot collapse.

A chat log that is saved after every turn holds each conversation many times,
as prefixes of its last state.  Every turn gets a rolling hash of all turns up
to it; a conversation whose last hash is an inner hash of another one is a
snapshot and goes by an anti-join.  Of equal conversations the smallest id
stays.  What is left is rendered with one mark-up of role and text for each turn.

The rolling hash is the running exclusive-or of two 64-bit hashes of (place,
role, text), computed by a window that streams a conversation; inner hashes are
made distinct before the join, so a first turn that a third of the
conversations share is one row of it.  Rendering collects at most
``part_turns`` turns in a row; longer conversations continue in further parts.

Defined cases: a null role is ``unknown``, a null text is empty.  Turns are
ordered by turn, role and text, a null turn first; a turn that occurs twice
counts twice.  Rows with a null conversation id form one conversation.  An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm._store import stored

PART_TURNS = 512


def rolled(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, k, n, role, text, h1, h2): turns in order with the hashes of their prefix."""
    one = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = one.withColumn("k", F.row_number().over(order))
    running = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first, second = F.xxhash64(F.lit(1), "k", "role", "text"), F.xxhash64(F.lit("second"), "text", "role", "k")
    hashed = placed.withColumn("t1", first).withColumn("t2", second)
    return hashed.select("conv", "k", F.lead("k").over(Window.partitionBy("conv").orderBy("k")).isNull().alias("last"), "role", "text", F.bit_xor("t1").over(running).alias("h1"), F.bit_xor("t2").over(running).alias("h2"))


def maximal(turns: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """The rolled turns, and (conv, n) of the conversations that extend to no other."""
    every = stored(rolled(turns, **columns), "turns")
    ends = every.where("last").select("conv", F.col("k").alias("n"), "h1", "h2")
    inner = every.where(~F.col("last")).select(F.col("k").alias("n"), "h1", "h2").distinct()
    alone = ends.join(inner, ["n", "h1", "h2"], "left_anti")
    return every, alone.groupBy("n", "h1", "h2").agg(F.min("conv").alias("conv")).select("conv", "n")


def render(every: DataFrame, kept: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv, n, part, rendered): the kept conversations as marked-up text."""
    turn = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    key = every.conv.eqNullSafe(kept.conv)
    rows = every.join(kept, key).select(kept.conv, "n", "k", F.floor((F.col("k") - 1) / part_turns).cast("int").alias("part"), turn.alias("turn"))
    texts = F.array_sort(F.collect_list(F.struct("k", "turn")))
    return rows.groupBy("conv", "n", "part").agg(F.array_join(F.transform(texts, lambda x: x["turn"]), "").alias("rendered"))


def format_chats(turns: DataFrame, part_turns: int = PART_TURNS, **columns) -> DataFrame:
    """(conv_id, n_turns, part, rendered) of all maximal conversations."""
    every, kept = maximal(turns, **columns)
    kept = stored(kept, "maximal")
    return render(every, kept, part_turns).select(F.col("conv").alias("conv_id"), F.col("n").cast("long").alias("n_turns"), "part", "rendered")


def op5_chat_format(turns: DataFrame) -> DataFrame:
    """All maximal conversations, rendered."""
    return format_chats(turns)


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k FROM conversations
), r AS (
  SELECT conv_id, k, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n FROM t
), inner_ AS (SELECT DISTINCT k, prefix FROM r WHERE k < n),
whole AS (SELECT min(conv_id) AS conv_id, n, prefix FROM r WHERE k = n GROUP BY n, prefix),
kept AS (SELECT w.* FROM whole w WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.k = w.n AND i.prefix = w.prefix))
SELECT kept.conv_id, kept.n AS n_turns, CAST(floor((t.k - 1) / 512) AS INTEGER) AS part,
  string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.k) AS rendered
FROM kept JOIN t ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY 1, 2, 3
"""
