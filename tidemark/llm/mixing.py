"""Mixing sources to target weights by weighted fair queueing, in SQL functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, tagged, text_of, with_verdict, written

VERDICT = ["size", "source_size", "target", "taken"]


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``source``, ``source_size``, ``target``: shares of all sizes by weight.

    Sources in order of their code points, null last, get the weights in turn.
    A target stops at ``max_repeats`` times its source's size; the excess is
    shared anew by weight until none is above, which is the level at which the
    capped sources and ``level * weight`` of the others add up to all sizes.
    ``sizes`` has one row per source.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (nth % len(weights) + 1).cast("int")).cast("long")
    ratio = F.col("source_size") / F.col("weight")
    up = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, all_rows = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shared = (
        sizes.withColumn("weight", weight).withColumn("ratio", ratio)
        .withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_repeats)
        .withColumn("rest_weight", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(all_rows))
        # the first source, by ratio, that its share does not fill to the cap
        .withColumn("open", (F.col("total") - F.col("capped")) * F.col("weight") <= F.col("source_size") * max_repeats * F.col("rest_weight"))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct("ratio", F.col("source").isNull(), "source", "capped", "rest_weight"))).over(all_rows))
    )
    level = (F.col("total") - F.col("first.capped")) * F.col("weight") / F.col("first.rest_weight")
    top = F.col("source_size") * max_repeats
    return shared.select("source", "source_size", F.when(top <= level, top.cast("double")).otherwise(level.cast("double")).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix", carry: Sequence[str] | None = None,
) -> DataFrame:
    """The rows' ``carry`` columns (default all) with ``size``, ``source_size``, ``target`` and ``taken`` words.

    Each source's documents stand in an order given by a hash of their id.
    Copy ``r`` of a document finishes at (r * source size + sizes up to and
    with it) / target.  All entries are sorted by finish time and cut where the
    sum of all targets is reached; ``taken`` is the size times the copies
    before the cut.  Documents without words take nothing.  Null ids and null
    sources are values of their own; repeated rows are documents of their own.

    No source is gathered in one task: its order is cut into chunks by hash,
    and sums of chunks are carried forward.  There are as many chunks as a chunk
    has rows, so both windows grow with the square root of the input.
    """
    carry = list(docs.columns if carry is None else carry)
    return judge_mix(docs, id_col, text_col, source_col, weights, max_repeats, seed, carry).select(*with_verdict(carry, VERDICT))


def judge_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix", carry: Sequence[str] | None = None,
) -> DataFrame:
    """As ``mix``, with the carried columns in one struct ``doc``."""
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    rows = tagged(docs, "mix-rows", carry, id=F.col(f"`{id_col}`"), source=F.col(f"`{source_col}`"), size=size)
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"))
    ranked = _ranked(rows.select("row", "id", "source", "size").withColumn("key", key), weights, max_repeats)
    taken = taken_words(ranked, max_repeats)
    return rows.drop("id", "source", "size").join(taken, "row").select("doc", *VERDICT)


def _ranked(slim: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """Slim rows with their source's size and target and the running size in shuffled order."""
    chunks = math.isqrt(slim.count()) + 1
    chunk = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * chunks / float(1 << 32)).cast("long")
    slim = slim.withColumn("chunk", chunk)
    parts = slim.groupBy("source", "chunk").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "chunk", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("ahead"))
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    inside = Window.partitionBy("source", "chunk").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    running = slim.withColumn("inside", F.sum("size").over(inside)).alias("d")
    out = running.join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.chunk") == F.col("p.chunk")))
    out = out.join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return written(
        out.select("d.row", "d.id", "d.size", "d.key", (F.col("inside") + F.col("ahead")).alias("upto"), "t.source_size", "t.target"), "mix-ranked"
    )


def taken_words(ranked: DataFrame, max_repeats: int) -> DataFrame:
    """``row``, ``size``, ``source_size``, ``target``, ``taken`` after the global cut."""
    copies = range(max_repeats)
    sums = ranked.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("budget")).first()
    bins = math.isqrt(sums["rows"]) + 1

    def finish(copy: int | Column) -> Column:
        return (F.col("upto") + F.col("source_size") * copy) / F.col("target")

    def bin_of(time: Column) -> Column:
        late = F.lit(2 * bins) + F.floor(F.log2(time / 2) * bins)
        return F.when(time < 2, F.floor(time * bins)).otherwise(late).cast("long")

    entries = ranked.where("size > 0").withColumn("copy", F.explode(F.array(*[F.lit(c) for c in copies])))
    entries = entries.withColumn("finish", finish(F.col("copy"))).withColumn("bin", bin_of(F.col("finish")))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    totals = entries.groupBy("bin").agg(F.sum("size").alias("bin_size")).withColumn("upto_bin", F.sum("bin_size").over(upto))
    # the bin in which the budget ends: one row
    edge = totals.where(F.col("upto_bin") > sums["budget"]).orderBy("bin").limit(1).first()
    last = None
    place = ["finish", "key", "id", "size", "row", "copy"]
    if edge is not None:
        left = sums["budget"] - (edge["upto_bin"] - edge["bin_size"])
        running = F.sum("size").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
        in_edge = entries.where(F.col("bin") == edge["bin"]).withColumn("running", running)
        last = in_edge.where(F.col("running") <= left).agg(F.max(F.struct(*place)).alias("last")).first()["last"]
    types = {f.name: f.dataType for f in entries.schema.fields}

    def fits(copy: int) -> Column:
        if edge is None:
            return F.lit(True)
        time = finish(copy)
        early = bin_of(time) < edge["bin"]
        if last is None:
            return early
        own = F.struct(time.alias("finish"), "key", "id", "size", "row", F.lit(copy).alias("copy"))
        bound = F.struct(*[F.lit(last[c]).cast(types[c]).alias(c) for c in place])
        return early | ((bin_of(time) == edge["bin"]) & (own <= bound))

    taken = sum((F.when((F.col("size") > 0) & fits(c), F.col("size")).otherwise(0) for c in copies), F.lit(0).cast("long"))
    return ranked.select("row", "size", "source_size", "target", taken.alias("taken"))
