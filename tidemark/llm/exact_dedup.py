"""Exact duplicates by progressive refinement: length, hash of the prefix, hash of the whole text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import struct_of, text_of, with_verdict, written

#: Bytes of a text that the second level hashes.
PREFIX = 256
#: Slots of the two broadcast filters, 64 to a row.  They bound what is broadcast
#: at any input size; a full filter lets more rows on to the next level, never fewer.
LENGTH_SLOTS = 1 << 20
PREFIX_SLOTS = 1 << 24

VERDICT = ["keep_id", "group_size", "kept"]


def _bit(slot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63))


def shared_slots(rows: DataFrame, slot: Column, name: str) -> DataFrame:
    """Slots that hold two rows or more as bits: at most slots / 64 rows of (``{name}``, ``{name}_bits``)."""
    full = rows.groupBy(slot.alias("slot")).count().where("count > 1")
    return F.broadcast(full.groupBy(F.shiftright("slot", 6).alias(name)).agg(F.bit_or(_bit(F.col("slot"))).alias(f"{name}_bits")))


def in_slots(slot: Column, name: str) -> Column:
    bits = F.coalesce(F.col(f"{name}_bits"), F.lit(0).cast("long"))
    return bits.bitwiseAND(_bit(slot)) != 0


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """The rows' ``carry`` columns (default all) with ``keep_id``, ``group_size`` and ``kept``.

    Of rows with identical text the one with the largest id stays; exactly one
    row of a group is kept, also where whole rows repeat.  A null text equals
    an empty one; a null id ranks below all others.  An input column named like
    a verdict column is replaced.

    Only rows whose length, and then length and prefix, occur again have their
    whole text hashed and their row shuffled.  The rest passes straight on.
    """
    carry = list(docs.columns if carry is None else carry)
    return judge_exact(docs, id_col, text_col, carry).select(*with_verdict(carry, VERDICT))


def judge_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """As ``exact_dedup``, with the carried columns in one struct ``doc``."""
    text = text_of(text_col)
    size = F.octet_length(text)
    start = F.substring(text.cast("binary"), 1, PREFIX)
    by_length = F.pmod(F.xxhash64(size), F.lit(LENGTH_SLOTS)).cast("int")
    by_prefix = F.pmod(F.xxhash64(size, start), F.lit(PREFIX_SLOTS)).cast("int")

    packed = docs.select(
        struct_of(docs.columns if carry is None else carry).alias("doc"), F.col(f"`{id_col}`").alias("id"), text.alias("text"), by_length.alias("length_slot"),
        by_prefix.alias("prefix_slot"),
    )
    lengths = shared_slots(packed, F.col("length_slot"), "lengths")
    level1 = packed.join(lengths, F.shiftright("length_slot", 6) == F.col("lengths"), "left")
    shared_length = in_slots(F.col("length_slot"), "lengths")
    prefixes = shared_slots(level1.where(shared_length), F.col("prefix_slot"), "prefixes")
    level2 = level1.join(prefixes, F.when(shared_length, F.shiftright("prefix_slot", 6)) == F.col("prefixes"), "left")
    digest = F.when(shared_length & in_slots(F.col("prefix_slot"), "prefixes"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = level2.select("id", digest.alias("digest"), "doc")
    hashed, alone = rows.where("digest is not null"), rows.where("digest is null")

    by_id = hashed.groupBy("digest", "id").agg(F.count("*").alias("n"))
    groups = by_id.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max(F.struct("id", "n")).alias("keep"))
    # only groups of two rows or more are needed; written, so that the join below can split a large one
    groups = written(groups.where("group_size > 1"), "exact-groups")
    joined = hashed.join(groups, "digest", "left").withColumn("stays", F.col("id").eqNullSafe(F.col("keep.id")) | F.col("keep").isNull())
    again = F.col("stays") & (F.coalesce("keep.n", F.lit(0)) > 1)
    # rows that repeat the kept id and its text: one of them stays
    one = F.row_number().over(Window.partitionBy("digest").orderBy("id")) == 1
    judged = joined.where(~again).withColumn("kept", F.col("stays")).unionByName(joined.where(again).withColumn("kept", one))
    empty = {"group_size": F.lit(None).cast("long"), "keep": F.lit(None).cast(groups.schema["keep"].dataType), "stays": F.lit(True), "kept": F.lit(True)}
    return judged.unionByName(alone.withColumns(empty)).select(
        "doc", F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "kept",
    )
