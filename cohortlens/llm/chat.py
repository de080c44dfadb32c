r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of the same
role are merged into one block by an array aggregation, and the blocks are concatenated.
A block is ``<turn ROLE>TEXT<also>TEXT</turn>`` and a line feed. Inside roles and texts the
control characters are written as two characters, ``\`` as ``\b``, ``<`` as ``\l`` and
``>`` as ``\g``, so a text can't hold a mark and every text is read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import register
from .tables import table

ALSO = "<also>"
END = "</turn>\n"
TURNS_PER_PART = 4096  # turns collected together before the parts of a conversation meet
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
PROBE = "\\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, ``formatted``.

    ``turns`` has conv_id, turn, role, text. Rows go by turn, ties by role, then text, so
    repeated rows stay, next to one another; a null turn comes first. A null text or role
    is empty. A null conv_id is a conversation of its own. Other columns are left out; an
    empty table gives an empty result. Long conversations are sorted and escaped in parts
    of ``TURNS_PER_PART`` turn numbers before the parts meet.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    part = F.floor(F.col("turn") / TURNS_PER_PART)
    parts = rows.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = parts.select("conv_id", "part", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "turns"))).alias("parts"))
    return whole.select("conv_id", _concatenated(_merged(F.flatten(F.transform("parts", lambda p: p["turns"])))).alias("formatted"))


def _merged(turns: Column) -> Column:
    """Runs of turns of one role as (role, texts) blocks, starts found by position."""
    begins = F.filter(
        F.sequence(F.lit(0), F.size(turns) - 1),
        lambda k: (k == 0) | (F.get(turns, k)["role"] != F.get(turns, k - 1)["role"]),
    )
    texts = F.transform(turns, lambda t: t["text"])
    ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(turns)))
    return F.zip_with(begins, ends, lambda b, e: F.struct(F.get(turns, b)["role"].alias("role"), F.slice(texts, b + 1, e - b).alias("texts")))


def _concatenated(blocks: Column) -> Column:
    piece = lambda b: F.concat(F.lit("<turn "), b["role"], F.lit(">"), F.array_join(b["texts"], ALSO), F.lit(END))
    return F.array_join(F.transform(blocks, piece), "")


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text), read back from ``formatted``, with texts as they were."""

    def block(raw: Column) -> Column:
        body = F.split(F.substring_index(raw, "</turn>", 1), ">", 2)
        return F.struct(unescape(body[0]).alias("role"), F.split(body[1], ALSO).alias("texts"))

    blocks = F.transform(F.filter(F.split("formatted", "<turn "), lambda b: b != ""), block)
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))
    return formatted.withColumn("turns", turns)


def loss_texts(turns: Column, role: str = "assistant") -> Column:
    """The texts under the loss mask: those of ``role``, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"])


SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (
  SELECT *, row_number() OVER w AS k, role IS DISTINCT FROM lag(role) OVER w AS begins,
    length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) AS role_chars,
    length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) AS text_chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN begins THEN 6 + role_chars + 1 + 8 ELSE 6 END + text_chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


@register("op6_chat_format", SQL)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    parsed = parse_formatted(format_conversations(turns.unionByName(probe)))
    loss = F.array_join(loss_texts(F.col("turns")), "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
