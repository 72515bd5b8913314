"""Exact ranks, running totals and quantiles without a one-task window.

A window that orders all rows of one group runs in one task, and a group may
hold a third of the table.  So the rows are sorted by Spark's own range
partitioning over group, order column, tie columns and row number, and written
once with the number of their range:

1. A range holds at most ``RANGE_ROWS`` rows.  The number of ranges follows
   from the rows: ranges that turn out larger are cut anew.  Equal keys are cut
   as well, as the row number is part of the order.
2. The window runs inside (group, range).
3. What earlier ranges of the same group add up to is one row per range at
   most, because only the group that a range begins with can have begun before.

The written ranges end the lineage: every reader sees the same cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_dir

RANGE_ROWS = 2_000_000


def present(col: str | Column) -> Column:
    """True where a floating value is neither null nor NaN."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isNotNull() & ~F.isnan(col)


def null_nan(col: str | Column) -> Column:
    """NaN becomes null: one kind of missing value."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(col), col)


def in_ranges(df: DataFrame, keys: Sequence[str | Column], most: int | None = None) -> DataFrame:
    """The rows with ``_range`` (numbers ascend with ``keys``) and ``_nth`` (decides equal keys)."""
    spark, most = df.sparkSession, most or RANGE_ROWS
    rows, ranges = df.withColumn("_nth", F.monotonically_increasing_id()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        path = scratch_dir(spark, "ranges")
        rows.repartitionByRange(ranges, *keys, "_nth").withColumn("_range", F.spark_partition_id()).write.parquet(path)
        out = spark.read.parquet(path)
        largest = out.groupBy("_range").count().agg(F.max("count")).first()[0] or 0
        if largest <= most:
            return out
        rows, ranges = out.drop("_range"), 2 * ranges * -(-largest // most)


def same_group(groups: Sequence[str], prefix: str = "_g") -> Column:
    """Null-safe equality of the group columns with their renamed copies."""
    cond = F.lit(True)
    for i, g in enumerate(groups):
        cond = cond & F.col(g).eqNullSafe(F.col(f"{prefix}{i}"))
    return cond


def earlier_ranges(ranged: DataFrame, groups: Sequence[str], totals: Sequence[Column], carried: Callable[[Window], Sequence[Column]]) -> DataFrame:
    """``_g0.., _in_range`` and ``carried`` columns over earlier ranges of the group: one row per range at most."""
    names = [f"_g{i}" for i in range(len(groups))]
    per_range = ranged.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], F.col("_range").alias("_in_range")).agg(*totals)
    order = Window.partitionBy(*names).orderBy("_in_range")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = per_range.select(*names, "_in_range", F.row_number().over(order).alias("_of_group"), *carried(before))
    return out.where(F.col("_of_group") > 1).drop("_of_group")


def running_totals(
    df: DataFrame,
    order: str,
    groups: Sequence[str],
    totals: dict[str, Column],
    ties: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running totals in the order of ``order`` (then ``ties``)."""
    key = F.col(order).desc() if descending else F.col(order).asc()
    given = df.select("*", *[c.alias(f"_t_{n}") for n, c in totals.items()])
    ranged = in_ranges(given, [*groups, key, *ties])
    carried = earlier_ranges(
        ranged, groups, [F.sum(f"_t_{n}").alias(f"_t_{n}") for n in totals],
        lambda before: [F.sum(f"_t_{n}").over(before).alias(f"_before_{n}") for n in totals],
    )
    inside = Window.partitionBy(*groups, "_range").orderBy(key, *ties, "_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumns({f"_s_{n}": F.sum(f"_t_{n}").over(inside) for n in totals})
    joined = summed.join(F.broadcast(carried), same_group(groups) & (F.col("_range") == F.col("_in_range")), "left")
    return joined.select(*df.columns, *[(F.col(f"_s_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in totals])


def row_numbers(
    df: DataFrame,
    order: str,
    groups: Sequence[str] = (),
    ties: Sequence[str] = (),
    descending: bool = False,
    name: str = "rank",
) -> DataFrame:
    """Exact row number per group, also for groups too large for one task."""
    return running_totals(df, order, groups, {name: F.lit(1).cast("long")}, ties, descending)


def order_values(
    df: DataFrame,
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Values at given 0-based ranks per group, plus the row count ``n_all``.

    ``ranks`` maps an output name to a function of the row count.  Equal values
    are merged before anything is sorted.  A null group is a group.
    """
    rows = df.select(*groups, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    merged = rows.groupBy(*groups, "_v").agg(F.count("*").alias("_k"))
    run = running_totals(merged, "_v", groups, {"_to": F.col("_k")})
    names = [f"_g{i}" for i in range(len(groups))]
    sizes = run.groupBy(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)]).agg(F.sum("_k").alias("n_all"))
    ranked = run.join(sizes, same_group(groups)) if groups else run.withColumn("n_all", sizes.select("n_all").scalar())

    def at(fn: Callable[[Column], Column]) -> Column:
        k = fn(F.col("n_all")).cast("long")
        return F.max(F.when((F.col("_to") - F.col("_k") <= k) & (k < F.col("_to")), F.col("_v")))

    return ranked.groupBy(*groups).agg(F.max("n_all").alias("n_all"), *[at(fn).alias(n) for n, fn in ranks.items()])


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"_hi_{name}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    rows = df.where(present(value)).select(*groups, F.col(value).cast("double").alias("_q"))
    found = order_values(rows, "_q", ranks, groups)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        at = (F.col("n_all") - 1) * F.lit(p)
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*groups, *out)


def merged_quantiles(
    merged: DataFrame, value: str, weight: str, totals: DataFrame, group: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles and ``n_unique`` from a table of distinct values and their counts.

    ``totals`` has one row per group with the number of values in ``n_all``;
    the groups are few by nature (column names).
    """
    run = running_totals(merged, value, [group], {"_to": F.col(weight)})
    rows = run.join(F.broadcast(totals.select(group, "n_all")), group)
    v, start, n = F.col(value), F.col("_to") - F.col(weight), F.col("n_all") - 1

    def at(k: Column) -> Column:
        return F.max(F.when((start <= k) & (k < F.col("_to")), v))

    picks = []
    for name, p in probs.items():
        picks += [at(F.floor(n * F.lit(p))).alias(f"_lo_{name}"), at(F.ceil(n * F.lit(p))).alias(f"_hi_{name}")]
    found = rows.groupBy(group).agg(F.max("n_all").alias("n_all"), F.count("*").alias("n_unique"), *picks)
    out = []
    for name, p in probs.items():
        lo, hi, pos = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), n * F.lit(p)
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(group, "n_unique", *out)


def top_k(
    df: DataFrame,
    k: int,
    order: Sequence[Column],
    groups: Sequence[str],
    salt_by: Sequence[str],
    rank: str = "rank",
    salts: int = 32,
) -> DataFrame:
    """First ``k`` rows per group in two steps: per salt, then over the survivors.

    Spark limits each group to ``k`` rows before either shuffle.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    first = F.row_number().over(Window.partitionBy(*groups, "_salt").orderBy(*order))
    kept = salted.withColumn("_r", first).where(F.col("_r") <= k).drop("_r", "_salt")
    second = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return kept.withColumn(rank, second).where(F.col(rank) <= k)


def hash_sample(df: DataFrame, n: int, keys: Sequence[str], cell: str | None = None) -> DataFrame:
    """At most ``n`` rows chosen by content: the smallest hash of each of ``n`` cells.

    The choice is the same on every evaluation and is found by one map-side
    combined aggregation; the chosen hashes (``n`` numbers) are broadcast.
    """
    hashed = df.withColumn("_cellhash", F.xxhash64(*keys))
    number = F.pmod(F.col("_cellhash"), F.lit(n))
    chosen = hashed.groupBy(number.alias("_cell")).agg(F.min("_cellhash").alias("_cellhash")).select("_cellhash")
    out = hashed.join(F.broadcast(chosen), "_cellhash", "left_semi")
    if cell is not None:
        out = out.withColumn(cell, number)
    # Copies of a chosen row share its hash and are taken once.
    return out.drop("_cellhash").dropDuplicates(list(keys))
