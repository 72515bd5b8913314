"""Faults that the queries of run detection and conversation repair put into the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of, words_of


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where crc32 of the id ends in 0, words repeat from place a on with period p.

    With n words and the rest g of the checksum, a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)).  Other texts stay as they are; so do
    those without an id.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", text_of("text").alias("text"), h.alias("h"))
    words = split.where("h % 10 = 0").select("doc_id", words_of(F.col("text")).alias("words"), F.floor(F.col("h") / 10).alias("g"))
    filled = words.where(F.size("words") > 0).withColumn("n", F.size("words")).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rest = F.col("n") - F.col("a")
    filled = filled.withColumn("times", (3 + F.col("g") % 8).cast("int")).withColumn("p", (1 + F.floor(rest / F.col("times"))).cast("int"))
    period = F.slice("words", F.col("a") + 1, "p")
    tail = F.slice(F.flatten(F.array_repeat(period, F.col("times"))), F.lit(1), rest)
    planted = filled.select("doc_id", F.array_join(F.concat(F.slice("words", F.lit(1), "a"), tail), " ").alias("text"))
    empty = words.where(F.size("words") == 0).select("doc_id", F.lit("").alias("text"))
    return split.where("h is null or h % 10 <> 0").select("doc_id", "text").unionByName(planted).unionByName(empty)


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``, nulls one space, with a fault by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats
    the row, 4 makes it a user's.
    """
    def said(col: str) -> Column:
        return F.coalesce(F.col(col).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    kept = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    told = kept.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    return told.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("copy", "fault")
