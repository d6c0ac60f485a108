"""Chat formatting of logged conversations, in DataFrame functions only.

A chat service logs a conversation again with each turn, so that a log is full of conversations that are the start of
longer ones. Rolling hashes of every prefix of turns find them: a conversation whose whole hash is that of a proper prefix
of another is dropped by an anti-join, one of several equal ones stays, and only those maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm._shared import materialize

SUMS = ["p0", "p1", "p2", "p3"]


def rolling(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, n, role, text, p0..p3): the position from 1, the number of turns, and the rolling hash of the turns
    so far: four sums of 32 bits of the turns' hashes, which hold the position, so a prefix is known by (pos, p0..p3)."""
    own = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    own = own.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("conv_id")))
    halves = []
    for salt in (0, 1):
        h = F.xxhash64(F.lit(salt), "pos", "role", "text")
        halves += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    own = own.select("conv_id", "pos", "n", "role", "text", *[h.alias(f"__h{i}") for i, h in enumerate(halves)])
    over = W.partitionBy("conv_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return own.select("conv_id", "pos", "n", "role", "text", *[F.sum(f"__h{i}").over(over).alias(p) for i, p in enumerate(SUMS)])


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one starts with; of equal ones, the least id."""
    whole = turns.filter("pos = n").groupBy("n", *SUMS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    starts = turns.filter("pos < n").select(F.col("pos").cast("long").alias("n"), *SUMS).distinct()
    return whole.join(starts, ["n", *SUMS], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(role, text):
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def formatted(conversations: DataFrame, **columns: str) -> DataFrame:
    """conv_id, n_turns, n_copies (equal conversations in the log, itself included) and rendered, for each maximal one.

    Turns follow by turn number, nulls first; turns that share one, by role and text, and repeated rows are turns of their
    own. Null roles and texts are empty. Rows without conv_id are one conversation with a null id. An empty table gives an
    empty result; other columns are not read."""
    turns = materialize(rolling(conversations, **columns), "turns")
    kept = maximal(turns)
    met = turns.select(F.col("conv_id").alias("__id"), "pos", "role", "text").join(kept, F.col("__id").eqNullSafe(F.col("conv_id")))
    lists = met.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("pos", render(F.col("role"), F.col("text")).alias("line")))).alias("lines"))
    return lists.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.col("lines.line"), "").alias("rendered"))


FORMATTED_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations
), p AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos) AS s
  FROM t
), w AS (
  SELECT min(conv_id) AS conv_id, CAST(max(n) AS BIGINT) AS n_turns, count(*) AS n_copies, s AS rendered FROM p WHERE pos = n GROUP BY s
)
SELECT conv_id, n_turns, n_copies, rendered FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.s = w.rendered)
"""
