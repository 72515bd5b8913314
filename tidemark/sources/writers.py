"""Sinks: feature tables, prediction logs, profiles and check reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import clean_categories, derive_features


def write_features(df: DataFrame, path: str, partition_by: Sequence[str] = (), clean: bool = True) -> None:
    """Clean, derive and write a feature table.

    With partition columns the rows are brought together per partition value;
    the rebalance cuts a large partition into files of the advisory size and
    keeps a small one whole.
    """
    out = derive_features(clean_categories(df) if clean else df)
    writer = out.write.mode("overwrite")
    if partition_by:
        writer = out.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by)
    writer.parquet(path)


def append_prediction_log(df: DataFrame, path: str) -> None:
    """Append predictions as JSON lines."""
    df.write.mode("append").json(path)


def save_profile(profile: DataFrame, path: str, model_version: str) -> None:
    """Store a column profile as the snapshot of one model version."""
    profile.withColumn("model_version", F.lit(model_version)).write.mode("append").partitionBy("model_version").parquet(path)


def load_profile(spark: SparkSession, path: str, model_version: str) -> DataFrame:
    """Snapshot of one model version; other versions are pruned."""
    return spark.read.parquet(path).where(F.col("model_version") == model_version)


def alignment(profile: DataFrame, serving: DataFrame) -> DataFrame:
    """Features of a stored snapshot that serving lacks or adds."""
    names = serving.sparkSession.createDataFrame([(c,) for c in serving.columns], "column string")
    missing = profile.select("column").join(names, "column", "left_anti").select("column", F.lit("missing").alias("state"))
    extra = names.join(profile.select("column"), "column", "left_anti").select("column", F.lit("extra").alias("state"))
    return missing.unionByName(extra)


def report_rows(results: DataFrame, run_id: str, check: str, subject: str, value: str, severity: str) -> DataFrame:
    """Any check result in the shape of the report table."""
    return results.select(
        F.lit(run_id).alias("run_id"), F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"),
        F.col(value).cast("double").alias("value"), F.col(severity).cast("string").alias("severity"),
    )


def append_report(rows: DataFrame, path: str) -> None:
    """Append check results as JSON lines, one folder per run."""
    rows.write.mode("append").partitionBy("run_id").json(path)
