"""Chat formatting by prefix-target expansion: every assistant turn becomes its own training example.

An example's text is all turns up to and including the target reply; only the reply is trainable
(``loss_start``/``loss_len``, in code points of the text). A conversation that doesn't end with an assistant turn gets
one more example without a trainable span, so that no turn is lost. Everything is DataFrame expressions.

Template, one turn: ``<turn>`` role newline text ``</turn>`` newline. Inside role and text a backslash becomes
backslash-b, ``<`` backslash-l and, in roles, a newline backslash-n. So ``<`` stands only in control strings and the
escapes are undone by plain replacement.

Defined cases: null text or role is empty; null conv_id is a conversation of its own; equal turn numbers are ordered
by role and text, null turn first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<turn>", "</turn>\n"
PLANTED_ID, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def expand(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, example, text, loss_start, loss_len, is_last."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shaped = convs.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE)).alias("piece"),
                F.length(escape(t["text"])).alias("n"),
                (t["role"] == target_role).alias("target"),
            ),
        ).alias("turns"),
    )
    each = shaped.select("conv_id", "turns", F.size("turns").alias("total"), F.posexplode("turns").alias("at", "turn"))
    kept = each.where(F.col("turn.target") | (F.col("at") == F.col("total") - 1))
    text = F.array_join(F.transform(F.slice("turns", 1, F.col("at") + 1), lambda t: t["piece"]), "")
    target = F.col("turn.target")
    return kept.select(
        "conv_id", F.col("at").alias("example"), text.alias("text"), target.alias("target"), F.col("turn.n").alias("n"),
        (F.col("at") == F.col("total") - 1).alias("is_last"),
    ).select(
        "conv_id", "example", "text",
        F.when(F.col("target"), F.length("text") - len(CLOSE) - F.col("n") + 1).alias("loss_start"),
        F.when(F.col("target"), F.col("n")).otherwise(0).alias("loss_len"),
        "is_last",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, per example: turns (role, text) of the last one, and the unescaped reply."""
    body = F.col("text").substr(F.lit(1), F.length("text") - len(CLOSE))
    pieces = F.split(body, CLOSE)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )
    return examples.select(
        "conv_id", "example", F.length("text").alias("chars"),
        F.when(F.col("is_last"), turns).alias("turns"),
        F.when(F.col("loss_start").isNotNull(), unescape(F.substr("text", F.col("loss_start"), F.col("loss_len")))).alias("reply"),
    )


def digest(back: DataFrame) -> DataFrame:
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    slim = back.select(
        "conv_id", "example", "chars", "reply",
        F.size("turns").alias("n"), F.sha2(F.array_join(told, ""), 256).alias("sha"),
    )
    replies = F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply"))))
    grouped = slim.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(replies, lambda r: r["reply"]), "").alias("_loss"), F.sum("chars").alias("formatted_chars"),
    )
    return grouped.select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(PLANTED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TEXT).alias("text"),
    )
    return digest(read_back(expand(given.unionByName(planted))))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
        count(*) OVER (PARTITION BY conv_id) AS total,
        length(role) + 1 + length(text) + 14
          + length(role) - length(replace(replace(replace(role, '\\', ''), '<', ''), chr(10), ''))
          + length(text) - length(replace(replace(text, '\\', ''), '<', '')) AS piece FROM t),
f AS (SELECT *, sum(piece) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM n)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR rn = total) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
