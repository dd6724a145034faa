"""Punctuation balance and chat-style training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pairloom.functions import lexicons, text
from pairloom.operators import sampling


def keeps_period(c: Column | str, single_letter: bool = False) -> Column:
    """Whether a text must keep its final period: abbreviations, questions, exclamations, several periods; optionally a single capital before it."""
    s = text.strip(c)
    ends = F.lit(False)
    for a in lexicons.ABBREVIATIONS:
        ends = ends | F.endswith(s, F.lit(a))
    periods = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    out = ends | s.contains("?") | s.contains("!") | (periods > 1)
    return out | s.rlike(rf"(^|{text.NON_WORD})[A-Z]\.$") if single_letter else out


def no_period_candidate(c: Column | str) -> Column:
    s = text.strip(c)
    return s.rlike(r"\.$") & ~s.rlike(r"(etc|Mr|Dr)\.$") & ~s.rlike(rf"(^|{text.NON_WORD})[A-Z]\.$")


def balance_punctuation(pairs: DataFrame, *key: str, single_letter: bool = False) -> DataFrame:
    """Rows that must keep their period stay; of the others the second half, in random order, loses all trailing periods.

    Counts are taken again, difficulty is not; source tells which rows changed.
    """
    rows = sampling.halves(pairs.withColumn("keep_", keeps_period("clean", single_letter)), "punctuation", *key, group=["keep_"])
    take = ~F.col("keep_") & F.col("second_half")
    rows = rows.withColumn("punctuation_removed", take)
    for c in ("corrupted", "clean"):
        rows = rows.withColumn(c, F.when(take, text.strip_periods(c)).otherwise(F.col(c)))
    rows = rows.withColumn("source", F.when(take, F.concat("source", F.lit(lexicons.NO_PERIOD))).otherwise(F.col("source")))
    rows = rows.withColumn("word_count", text.n_words("clean")).withColumn("char_count", F.length("clean"))
    return rows.drop("keep_", "second_half")


METADATA = ("domain", "complexity", "error_types", "num_errors", "difficulty_score", "source", "word_count", "char_count")


def chat_format(pairs: DataFrame, *key: str) -> DataFrame:
    """messages (user, assistant) and metadata."""
    user = F.struct(F.lit("user").alias("role"), F.concat(F.lit(lexicons.CHAT_PROMPT), F.col("corrupted")).alias("content"))
    answer = F.struct(F.lit("assistant").alias("role"), F.col("clean").alias("content"))
    return pairs.select(*key, F.array(user, answer).alias("messages"), F.struct(*METADATA).alias("metadata"))


def chatml_text(chats: DataFrame, *key: str) -> DataFrame:
    """The text of chats with exactly two messages."""
    return chats.where(F.size("messages") == 2).select(*key, text.chatml(F.col("messages")).alias("text"))


def adjacent_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, messages: each user's turn with the assistant's next."""
    w = W.Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w)).where("role = 'user' and next_role = 'assistant'")
    return rows.select("conv_id", "turn", F.array(F.struct(F.col("role"), F.col("text").alias("content")), F.struct(F.col("next_role").alias("role"), F.col("next_text").alias("content"))).alias("messages"))


def seq2seq(pairs: DataFrame, prompt: str, *key: str, strip_target: bool = False) -> DataFrame:
    """source_text (prompted) and target_text; rows whose source equals their target teach nothing and go."""
    target = text.strip("clean") if strip_target else F.col("clean")
    return pairs.where(F.col("corrupted") != F.col("clean")).select(*key, text.prompt(prompt, text.strip("corrupted")).alias("source_text"), target.alias("target_text"))
