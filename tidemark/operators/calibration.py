"""Isotonic calibration of scores over ranges: the fit is a table, not a model on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions.ordering import in_ranges, null_nan
from tidemark.operators.features import View, feature_views_join
from tidemark.session import scratch_dir

#: Blocks that are sent to all tasks, 24 bytes each; more blocks meet the scores in a sorted join.
SENT_BLOCKS = 100_000
BLOCKS = "_range bigint, lo double, hi double, n bigint, total double"


@dataclass(frozen=True)
class IsotonicFit:
    """Blocks (lo, hi, n, total) of one mean each, with rising means, as a stored table."""

    path: str
    blocks: int

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(BLOCKS).parquet(self.path)


def pooled(rows: Iterator[tuple[float, float, int, float]]) -> list[list]:
    """Neighbouring blocks (lo, hi, n, total) pooled until their means rise."""
    stack: list[list] = []
    for lo, hi, n, total in rows:
        stack.append([lo, hi, n, total])
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, hi, n, total = stack.pop()
            stack[-1][1:] = [hi, stack[-1][2] + n, stack[-1][3] + total]
    return stack


def _pool_ranges(blocks: DataFrame) -> DataFrame:
    """Blocks pooled inside each range, as a stored table."""
    schema = StructType.fromDDL(BLOCKS)
    target = to_arrow_schema(schema)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at] * len(stack), pa.int64()), *[pa.array(c, f.type) for c, f in zip(zip(*stack), list(target)[1:])]], schema=target)

        for batch in batches:
            ranges = batch.column("_range").to_numpy()
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("lo", "hi", "n", "total")], strict=True))
            for number in dict.fromkeys(ranges.tolist()):
                if number != at:
                    if stack:
                        yield done()
                    at, stack = number, []
                here = [rows[i] for i in np.flatnonzero(ranges == number)]
                stack = pooled([*stack, *here])
        if stack:
            yield done()

    path = scratch_dir(blocks.sparkSession, "isotonic-blocks")
    ordered = blocks.select("_range", "lo", "hi", "n", "total").repartition("_range").sortWithinPartitions("_range", "lo")
    ordered.mapInArrow(pool, schema).write.parquet(path)
    return blocks.sparkSession.read.schema(schema).parquet(path)


def fit_isotonic(held_out: DataFrame, label: str, score: str, most: int | None = None) -> IsotonicFit:
    """The rising step function nearest to the labels (least squares, by score).

    Equal scores are merged before anything is sorted; rows without score or
    label are left out.  Each range of scores pools its own blocks; where the
    last mean of a range is above the first of the next, neighbouring ranges
    are joined and pooled again, so at most log2(ranges) rounds follow.  Pooling
    may be done in any order, so the blocks are those of one pass.  A task holds
    the blocks of its range, not its rows.
    """
    spark = held_out.sparkSession
    x, y = null_nan(F.col(score).cast("double")), null_nan(F.col(label).cast("double"))
    rows = held_out.select(x.alias("lo"), y.alias("y")).where("lo is not null and y is not null")
    merged = rows.groupBy("lo").agg(F.count("*").alias("n"), F.sum("y").alias("total")).withColumn("hi", F.col("lo"))
    blocks = _pool_ranges(in_ranges(merged, ["lo"], most).withColumn("_range", F.col("_range").cast("bigint")))
    while True:
        mean = F.col("total") / F.col("n")
        ends = blocks.groupBy("_range").agg(F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last"))
        before = F.lag("last").over(Window.orderBy("_range"))  # one row per range
        if not ends.withColumn("before", before).where(F.col("before") > F.col("first")).limit(1).count():
            break
        blocks = _pool_ranges(blocks.withColumn("_range", F.shiftright("_range", 1)))
    path = scratch_dir(spark, "isotonic-fit")
    blocks.write.parquet(path)
    return IsotonicFit(path, spark.read.schema(BLOCKS).parquet(path).count())


def apply_isotonic(df: DataFrame, fit: IsotonicFit, score: str, name: str = "calibrated", sent: int = SENT_BLOCKS) -> DataFrame:
    """Add the calibrated score in [0, 1].

    Inside a block it is the block's mean, between two blocks it rises in a
    straight line, beyond the ends it stays.  No score, or a fit without rows,
    gives null.
    """
    spark = df.sparkSession
    mean = (F.col("total") / F.col("n")).alias("y")
    x = null_nan(F.col(score).cast("double"))
    if fit.blocks <= sent:
        found = fit.table(spark).orderBy("lo").select("lo", "hi", mean).toPandas()
        knots = spark.sparkContext.broadcast((found[["lo", "hi"]].to_numpy().ravel(), np.repeat(found["y"].to_numpy(), 2)))

        @F.pandas_udf("double")
        def read(v: pd.Series) -> pd.Series:
            xs, ys = knots.value
            return pd.Series(np.where(v.isna(), np.nan, np.interp(v, xs, ys)) if len(xs) else np.full(len(v), np.nan))

        value = null_nan(read(x))
    else:
        ends = fit.table(spark).select(F.explode(F.array("lo", "hi")).alias("x"), mean).distinct().withColumn("_k", F.lit(1))
        asked = df.select(x.alias("_at")).where("_at is not null").distinct().withColumns({"_k": F.lit(1), "_back": -F.col("_at")})
        low = View(ends.select("_k", "x", F.col("x").alias("_x0"), F.col("y").alias("_y0")), ["_x0", "_y0"], ts="x")
        high = View(ends.select("_k", (-F.col("x")).alias("x"), F.col("x").alias("_x1"), F.col("y").alias("_y1")), ["_x1", "_y1"], ts="x")
        both = feature_views_join(feature_views_join(asked, [low], "_k", "_at"), [high], "_k", "_back")
        line = F.col("_y0") + (F.col("_at") - F.col("_x0")) * F.try_divide(F.col("_y1") - F.col("_y0"), F.col("_x1") - F.col("_x0"))
        at = F.when(F.col("_x0") == F.col("_x1"), F.col("_y0")).otherwise(F.coalesce(line, F.col("_y0"), F.col("_y1")))
        told = both.select("_at", at.alias("_value"))
        df = df.withColumn("_x", x).join(told, F.col("_x") == F.col("_at"), "left").drop("_x", "_at")
        value = F.col("_value")
    out = df.withColumn(name, F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))))
    return out.drop("_value")
