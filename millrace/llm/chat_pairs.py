"""Preference formatting: one prompt and two masked completions of a chosen and a rejected conversation.

The prompt is the longest run of turns that both conversations begin with, rendered once. What follows in
each is its completion; inside it only the text of assistant turns, with its end mark, is learned from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARN_FROM = "assistant"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def masked(turns: Column) -> Column:
    """Pieces of a completion in order: array of (text, learn)."""
    head = lambda t: F.struct(F.concat(F.lit("<|"), t["role"], F.lit("|>\n")).alias("text"), F.lit(False).alias("learn"))
    tail = lambda t: F.struct(F.concat(t["text"], F.lit("<|end|>\n")).alias("text"), (t["role"] == LEARN_FROM).alias("learn"))
    return F.flatten(F.transform(turns, lambda t: F.array(head(t), tail(t))))


def format_pairs(df: DataFrame, id_col: str = "conv_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """id, n_prompt_turns, prompt, chosen and rejected (arrays of (text, learn) pieces).

    Conversations are arrays of structs with role and text. Turns are equal if role and text are; null
    role, text or conversation counts as empty. Equal conversations are all prompt, with two empty
    completions; conversations without a common turn have an empty prompt. Rows are independent: ids may
    be null or repeat. No other column is read; an empty table gives no rows.
    """
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = df.select(F.col(id_col).alias("_x_id"), clean(chosen_col).alias("_x_a"), clean(rejected_col).alias("_x_b"))
    shorter = F.least(F.size("_x_a"), F.size("_x_b"))
    differ = F.array_position(F.zip_with("_x_a", "_x_b", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    rows = rows.withColumn("_x_n", F.when(differ > 0, differ - 1).otherwise(shorter).cast("int"))
    rest = lambda c: F.slice(c, F.col("_x_n") + 1, F.size(c))
    return rows.select(
        F.col("_x_id").alias(id_col),
        F.col("_x_n").alias("n_prompt_turns"),
        F.array_join(F.transform(F.slice("_x_a", F.lit(1), F.col("_x_n")), rendered), "").alias("prompt"),
        masked(rest("_x_a")).alias("chosen"),
        masked(rest("_x_b")).alias("rejected"),
    )


def conversations(df: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of (role, text) in order of (turn, role, text), nulls first.

    One conversation is one value and so has to fit in one task. Null conv_id is one conversation.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return df.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))).alias("turns"))


def with_echo(df: DataFrame) -> DataFrame:
    """conversations() as pairs: rejected has the turn before it in place of the last assistant turn's text."""
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"] == LEARN_FROM), True)
    rows = df.withColumn("_e_last", F.when(F.array_position(F.transform("turns", lambda t: t["role"] == LEARN_FROM), True) > 0, last))
    before = F.coalesce(F.get(F.col("turns"), F.col("_e_last") - 1)["text"], F.lit(""))
    swapped = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("_e_last"), before).otherwise(t["text"]).alias("text")))
    return rows.select("conv_id", F.col("turns").alias("chosen"), F.when(F.col("_e_last").isNull(), F.col("turns")).otherwise(swapped).alias("rejected"))


def op3_chat_preferences(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = format_pairs(with_echo(conversations(table)))
    text = lambda c, learn: F.array_join(F.transform(F.filter(c, lambda p: p["learn"] == learn) if learn else F.col(c), lambda p: p["text"]), "")
    return found.select("conv_id", "n_prompt_turns", "prompt", text("chosen", False).alias("chosen"), text("rejected", False).alias("rejected"), text("chosen", True).alias("chosen_learned"), text("rejected", True).alias("rejected_learned"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM conversations),
e AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY k), '') AS before,
    max(CASE WHEN role = 'assistant' THEN k END) OVER (PARTITION BY conv_id) AS last FROM t),
r AS (SELECT *, CASE WHEN k = last THEN before ELSE text END AS other,
    coalesce(max(CASE WHEN k = last AND before <> text THEN k END) OVER (PARTITION BY conv_id), 1000000000) AS cut FROM e),
p AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS a,
    '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS b FROM r)
SELECT conv_id, CAST(count(*) FILTER (WHERE k < cut) AS INTEGER) AS n_prompt_turns,
    coalesce(string_agg(a, '' ORDER BY k) FILTER (WHERE k < cut), '') AS prompt,
    coalesce(string_agg(a, '' ORDER BY k) FILTER (WHERE k >= cut), '') AS chosen,
    coalesce(string_agg(b, '' ORDER BY k) FILTER (WHERE k >= cut), '') AS rejected,
    coalesce(string_agg(text || '<|end|>' || chr(10), '' ORDER BY k) FILTER (WHERE k >= cut AND role = 'assistant'), '') AS chosen_learned,
    coalesce(string_agg(other || '<|end|>' || chr(10), '' ORDER BY k) FILTER (WHERE k >= cut AND role = 'assistant'), '') AS rejected_learned
FROM p GROUP BY conv_id
"""
