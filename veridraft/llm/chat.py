"""Chat formatting after the collapse of cumulative snapshots.

Logs often hold a conversation several times, each snapshot some turns longer. A rolling hash
of every turn prefix finds conversations that are the beginning of a longer one; an anti-join
drops them, of equal ones the smallest id stays, and what is left is rendered.

The hash of a prefix is the exclusive or of its turns' 128-bit hashes, each taken with the
turn's distance from the first turn, so that prefixes of a long conversation can be computed
in blocks of turns that are chained afterwards. Texts are rendered turn by turn: no task ever
holds a conversation as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridraft.llm.common import table
from veridraft.session import materialise

#: Turns that are chained one by one; longer conversations are chained block by block.
BLOCK = 256
KEY = ["h1", "h2", "turns"]


def segment(role: Column, text: Column) -> Column:
    """One rendered turn. Marks of the format that occur in a role or text are broken up."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(
        F.lit("<|im_start|>"), plain(F.coalesce(role, F.lit("unknown"))), F.lit("\n"),
        plain(F.coalesce(text, F.lit(""))), F.lit("<|im_end|>\n"),
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, at, h1, h2, turns): hashes of all prefixes, from one hash per turn (conv, at, h1, h2)."""
    turns = turns.withColumn("block", F.floor(F.col("at") / BLOCK))
    blocks = turns.groupBy("conv", "block").agg(
        F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.count("*").alias("n")
    )
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv", "block",
        F.coalesce(F.bit_xor("b1").over(earlier), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("b2").over(earlier), F.lit(0)).alias("b2"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"),
    )
    so_far = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = turns.select(
        "conv", "block", "at",
        F.bit_xor("h1").over(so_far).alias("p1"), F.bit_xor("h2").over(so_far).alias("p2"),
        F.count("*").over(so_far).alias("k"),
    )
    return inside.join(blocks, ["conv", "block"]).select(
        "conv", "at", F.expr("p1 ^ b1").alias("h1"), F.expr("p2 ^ b2").alias("h2"), (F.col("k") + F.col("n")).alias("turns")
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv, turns): conversations that are no prefix of a longer one, the smallest id of equal ones."""
    # A null id and a null turn get values of their own; equal rows are one.
    rows = conversations.select(
        F.struct(F.col("conv_id").isNotNull().alias("known"), F.col("conv_id").alias("id")).alias("conv"), "turn", "role", "text"
    )
    first = rows.groupBy("conv").agg(F.min("turn").alias("first"))
    hashes = rows.select(
        "conv", "turn", F.xxhash64("role", F.col("role").isNull(), "text", F.col("text").isNull()).alias("r1"),
        F.xxhash64(F.lit("second"), F.col("text").isNull(), "text", F.col("role").isNull(), "role").alias("r2"),
    ).distinct()
    at = F.coalesce(F.try_subtract("turn", "first"), F.lit(-1))
    turns = materialise(
        hashes.join(first, "conv").select(
            "conv", at.alias("at"), F.xxhash64(at, "r1").alias("h1"), F.xxhash64("r2", at).alias("h2")
        ).groupBy("conv", "at").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")),
        "chat-turns",
    )
    whole = turns.groupBy("conv").agg(
        F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count("*").alias("turns"), F.max("at").alias("end")
    )
    one = whole.groupBy(*KEY).agg(F.min("conv").alias("conv"))
    proper = prefixes(turns).join(whole.select("conv", "end"), "conv").where(F.col("at") < F.col("end"))
    return one.join(proper.select(*KEY).distinct(), KEY, "left_anti").select("conv", "turns")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn of the maximal conversations: conv_id, turn, role, segment (rendered),
    target (the assistant's turns, which a model learns) and n_turns.

    A conversation's text is its segments by turn. Equal rows are one; different rows of one
    turn belong together and have no order. A null turn comes before all others, a null id is
    an id like any other, a null role is rendered as "unknown" and a null text as empty.
    Further columns are dropped. No rows give no rows.
    """
    kept = materialise(maximal(conversations), "chat-kept").select(
        F.col("conv.known").alias("known"), F.coalesce("conv.id", F.lit(0)).alias("id"), F.col("turns").alias("n_turns")
    )
    rows = conversations.select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("known", F.col("conv_id").isNotNull()).withColumn("id", F.coalesce("conv_id", F.lit(0)))
    return rows.join(kept, ["known", "id"]).select(
        "conv_id", "turn", "role", segment(F.col("role"), F.col("text")).alias("segment"),
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("target"), "n_turns",
    )


def op7_chat_format(spark, folder: str) -> DataFrame:
    return format_chats(table(spark, folder, "conversations"))


OP7_SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
s AS (SELECT *, turn - min(turn) OVER (PARTITION BY conv_id) AS pos FROM d),
c AS (SELECT conv_id, list({'pos': pos, 'role': role, 'text': text} ORDER BY pos, role, text) AS turns FROM s GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, turns FROM c GROUP BY turns),
prefix AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)),
kept AS (SELECT conv_id, len(turns) AS n_turns FROM one ANTI JOIN prefix USING (turns))
SELECT conv_id, turn, role,
       '<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
         || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS segment,
       coalesce(role = 'assistant', false) AS target, CAST(n_turns AS BIGINT) AS n_turns
FROM d JOIN kept USING (conv_id)
"""
