"""Chat formatting with cumulative-snapshot collapse.

A chat is often logged after each turn, so one conversation appears as a row of snapshots that each begin the next. A
running hash over the turns identifies every prefix of every conversation; an anti-join of whole conversations with the
strict prefixes of others retains the maximal ones, which are rendered. Only hashes are exchanged before that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import cut


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that no other one begins with or repeats; of equal ones the least conv_id."""
    hashed = turns.select("conv_id", "turn", "role", F.md5("text").alias("h")).repartition("conv_id").distinct()
    inside = Window.partitionBy("conv_id")
    order = inside.orderBy(F.col("turn").asc_nulls_last(), "role", "h")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = hashed.withColumn("i", F.row_number().over(order))
    prefix = cut(numbered.select("conv_id", "i", F.count("i").over(inside).alias("n"), F.bit_xor(F.xxhash64("i", "role", "h")).over(running).alias("a"), F.bit_xor(F.xxhash64("h", "role", "i", F.lit(1))).over(running).alias("b")))
    whole = prefix.where("i = n").groupBy("i", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    begun = prefix.where("i < n").select("i", "a", "b")
    return whole.join(begun, ["i", "a", "b"], "left_anti").select("conv_id", F.col("i").alias("n_turns"))


def chat_texts(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text) of the maximal conversations, turns between <|im_start|> and <|im_end|>.

    Rows with a null conv_id are left out. A null role is "unknown" (roles are trimmed and lower-cased), a null text is
    empty, a null turn comes last; turns of one number are ordered by role and hash of text; repeated rows are one turn.
    "<|" inside a text becomes "< |", so that no text can forge a turn. Texts of any length are kept whole: a conversation is one
    row, so it takes memory in proportion to its own text. An empty table gives no row. Other columns are ignored.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.lower(F.trim(F.coalesce("role", F.lit("unknown")))).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = turns.join(cut(maximal(turns)), "conv_id")
    item = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", F.md5("text").alias("h"), "text")
    text = F.transform(F.sort_array(F.collect_set(item)), lambda t: F.concat(F.lit("<|im_start|>"), t.role, F.lit("\n"), F.replace(t.text, F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n")))
    return kept.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.concat_ws("", text).alias("text"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_texts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op1_chat_formatting": op1_chat_formatting}
ORACLE = {
    "op1_chat_formatting": """
WITH t AS (SELECT DISTINCT conv_id, turn, lower(trim(coalesce(role, 'unknown'))) AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS LAST, role, md5(text)) AS turns,
  string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, role, md5(text)) AS text FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n AS INTEGER) AS n_turns, text FROM c a WHERE NOT EXISTS (
  SELECT 1 FROM c b WHERE b.turns[1] = a.turns[1] AND b.conv_id <> a.conv_id
  AND (b.n > a.n AND list_slice(b.turns, 1, a.n) = a.turns OR b.turns = a.turns AND b.conv_id < a.conv_id))""",
}
