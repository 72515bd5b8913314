"""Column profiles and the checks that compare two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.functions.ordering import merged_quantiles, null_nan

PROFILE_QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}

# Accepted share of positive labels, per check.
CLASS_BALANCE_RANGES = {"profile": (0.10, 0.40), "raw": (0.15, 0.30), "contract": (0.05, 0.40)}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a floating column."""
    if dict(df.dtypes)[column] in ("double", "float"):
        return F.col(f"`{column}`").isNull() | F.isnan(F.col(f"`{column}`"))
    return F.col(f"`{column}`").isNull()


def to_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "column") -> DataFrame:
    """One row per (row, numeric column); NaN becomes null."""
    wide = df.select(*keep, *[null_nan(F.col(c).cast("double")).alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), name, "value")


def one_row_to_long(df: DataFrame, facts: dict[str, dict[str, Column]], key: str = "column") -> DataFrame:
    """All aggregates in one pass over ``df``, returned as one row per subject."""
    wide = df.agg(*[c.alias(f"{s}\x1f{n}") for s, cols in facts.items() for n, c in cols.items()])
    names = list(next(iter(facts.values())))
    rows = F.array(*[
        F.struct(F.lit(s).alias(key), *[F.col(f"`{s}\x1f{n}`").alias(n) for n in names]) for s in facts
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count, null count, mean and sample deviation per numeric column, in one pass."""
    def facts(c: str) -> dict[str, Column]:
        value = null_nan(F.col(c).cast("double"))
        return {
            "n_rows": F.count("*"),
            "n_null": F.count_if(value.isNull()),
            "mean": F.avg(value),
            "std": F.stddev_samp(value),
        }

    out = one_row_to_long(df, {c: facts(c) for c in columns})
    return out.withColumn("null_rate", F.try_divide(F.col("n_null"), F.col("n_rows")))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: counts, null rate, distinct values, mean, deviation, quantiles.

    Exact by default: distinct values and quantiles come from one combined
    shuffle of (column, value).  ``approximate`` uses sketches in a single pass.
    """
    columns = list(columns or [f.name for f in df.schema.fields])
    numeric = [c for c in columns if c in numeric_columns(df)]
    other = [c for c in columns if c not in numeric]
    double = F.lit(None).cast("double")

    def facts(c: str) -> dict[str, Column]:
        out = {"n_rows": F.count("*"), "n_null": F.count_if(missing(df, c))}
        value = null_nan(F.col(c).cast("double")) if c in numeric else None
        out["mean"] = F.avg(value) if value is not None else F.max(double)
        out["std"] = F.stddev_samp(value) if value is not None else F.max(double)
        if approximate:
            out["n_unique"] = F.approx_count_distinct(value if value is not None else F.col(c))
            for q, p in PROFILE_QUANTILES.items():
                out[q] = F.percentile_approx(value, p, 10000) if value is not None else F.max(double)
        return out

    base = one_row_to_long(df, {c: facts(c) for c in columns})
    base = base.withColumn("null_rate", F.try_divide(F.col("n_null"), F.col("n_rows")))
    if approximate:
        return base
    known = base.withColumn("n_all", F.col("n_rows") - F.col("n_null"))
    parts = []
    if numeric:
        long = to_long(df, numeric).where(F.col("value").isNotNull())
        merged = long.groupBy("column", "value").agg(F.count("*").alias("_k"))
        parts.append(merged_quantiles(merged, "value", "_k", known, "column", PROFILE_QUANTILES))
    if other:
        text = df.select(*[F.col(c).cast("string").alias(c) for c in other]).unpivot([], other, "column", "value")
        values = text.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.lit(1).alias("_one"))
        counted = values.groupBy("column").agg(F.count("*").alias("n_unique"))
        parts.append(counted.select("column", "n_unique", *[double.alias(q) for q in PROFILE_QUANTILES]))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # One row per column on both sides; a column without values has no distinct ones.
    out = base.join(F.broadcast(found), "column", "left")
    return out.withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))


def null_drift(reference: DataFrame, current: DataFrame, max_drift: float = 0.05) -> DataFrame:
    """Difference of the null rates of two profiles, common columns only."""
    r = reference.select("column", F.col("null_rate").alias("reference_rate"))
    c = current.select("column", F.col("null_rate").alias("current_rate"))
    out = r.join(c, "column").withColumn("drift", F.abs(F.col("current_rate") - F.col("reference_rate")))
    return out.withColumn("flag", F.col("drift") > max_drift).orderBy(F.col("drift").desc(), "column")


def mean_drift(
    reference: DataFrame, current: DataFrame, warn: float = 2.0, critical: float = 3.0
) -> DataFrame:
    """Shift of the mean in reference deviations, with a severity."""
    r = reference.select("column", F.col("mean").alias("reference_mean"), F.col("std").alias("reference_std"))
    c = current.select("column", F.col("mean").alias("current_mean"))
    z = F.abs(F.col("current_mean") - F.col("reference_mean")) / (F.col("reference_std") + 1e-8)
    out = r.join(c, "column").where("reference_mean is not null and current_mean is not null").withColumn("z", z)
    severity = F.when(F.col("z") <= warn, "ok").when(F.col("z") <= critical, "warn").otherwise("critical")
    return out.withColumns({"severity": severity, "flag": F.col("z") > critical}).orderBy(F.col("z").desc(), "column")


def class_balance(df: DataFrame, label: str, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Share of positive labels against each accepted range."""
    ranges = ranges or CLASS_BALANCE_RANGES
    rate = F.avg(null_nan(F.col(label).cast("double")))
    wide = df.agg(rate.alias("positive_rate"), F.count(label).alias("n"))
    rows = F.array(*[
        F.struct(F.lit(n).alias("range_name"), F.lit(lo).alias("low"), F.lit(hi).alias("high"))
        for n, (lo, hi) in ranges.items()
    ])
    return wide.select("n", "positive_rate", F.explode(rows).alias("r")).select(
        "n", "positive_rate", "r.*", F.col("positive_rate").between(F.col("r.low"), F.col("r.high")).alias("passed")
    )


def null_quality_report(df: DataFrame, columns: Sequence[str], max_null_rate: float = 0.05) -> DataFrame:
    """Columns above the null limit, and the share of columns that fail."""
    facts = {c: {"n_rows": F.count("*"), "n_null": F.count_if(missing(df, c))} for c in columns}
    out = one_row_to_long(df, facts).withColumn("null_rate", F.try_divide(F.col("n_null"), F.col("n_rows")))
    out = out.withColumn("failed", F.coalesce(F.col("null_rate") > max_null_rate, F.lit(False)))
    total = out.agg(F.avg(F.col("failed").cast("double")).alias("s"))
    return out.withColumn("share_failed", total.scalar())


def dataset_facets(df: DataFrame, table: str) -> DataFrame:
    """Column names, types, row count and null counts of one table."""
    types = dict(df.dtypes)
    facts = {
        f.name: {"row_count": F.count("*"), "null_count": F.count_if(F.col(f.name).isNull())} for f in df.schema.fields
    }
    out = one_row_to_long(df, facts)
    kind = F.create_map(*[F.lit(x) for item in types.items() for x in item])
    return out.select(F.lit(table).alias("table"), "column", kind[F.col("column")].alias("type"), "row_count", "null_count")
