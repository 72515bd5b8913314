"""Feedback loop: metrics per period, retrain triggers and approvals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluation import rank_metrics

MIN_EXAMPLES = 10
MIN_BATCH = 100
AUC_CHANGE = 0.02
APPROVAL_MODES = ("auto", "human", "block")


def feedback_metrics(
    df: DataFrame, label: str, score: str, decision: str, groups: Sequence[str] = (), min_examples: int = MIN_EXAMPLES
) -> DataFrame:
    """AUC, approval rate, default rate of the approved and positive rate; null when too few."""
    approved = F.col(decision) == "approve"
    plain = df.groupBy(*groups).agg(
        F.count("*").alias("n_labeled"),
        F.avg(F.coalesce(approved.cast("double"), F.lit(0.0))).alias("approval_rate"),
        F.avg(F.when(approved, F.col(label))).alias("default_rate_approved"),
        F.avg(label).alias("label_positive_rate"),
    )
    ranks = rank_metrics(df, label, score, groups)
    if groups:
        out = plain.join(ranks.select(*groups, "roc_auc"), list(groups), "left")
    else:
        out = plain.withColumn("roc_auc", ranks.select("roc_auc").scalar())
    enough = F.col("n_labeled") >= min_examples
    names = ["approval_rate", "default_rate_approved", "label_positive_rate"]
    return out.select(
        *groups, "n_labeled", F.when(enough, F.col("roc_auc")).alias("auc"), *[F.when(enough, F.col(c)).alias(c) for c in names]
    )


def retrain_reason(auc: Column, baseline: Column, n: Column, min_batch: int = MIN_BATCH, change: float = AUC_CHANGE) -> Column:
    """Why a retrain is or is not triggered."""
    delta = auc - baseline
    return (
        F.when(auc.isNull() | baseline.isNull(), "auc_unavailable")
        .when(n < min_batch, "batch_too_small")
        .when(F.abs(delta) < change, "below_threshold")
        .when(delta < 0, "degraded")
        .otherwise("improved")
    )


def is_triggered(reason: Column) -> Column:
    return reason.isin("degraded", "improved")


def approval(reason: Column, delta: Column, mode: str = "auto", min_improvement: float = 0.0) -> Column:
    """Outcome of the approval step of a triggered retrain."""
    if mode not in APPROVAL_MODES:
        raise ValueError(f"mode must be one of {APPROVAL_MODES}")
    fired = is_triggered(reason)
    if mode == "block":
        return F.when(fired, "blocked").otherwise("not_triggered")
    if mode == "human":
        return F.when(fired, "pending").otherwise("not_triggered")
    return F.when(~fired, "not_triggered").when(delta >= min_improvement, "approved").otherwise("rejected")


def closed_loop(
    metrics: DataFrame, period: str, baseline_auc: float = 0.70, mode: str = "auto", min_improvement: float = 0.0,
    min_batch: int = MIN_BATCH, change: float = AUC_CHANGE,
) -> DataFrame:
    """Run the periods in order; an approved retrain replaces the baseline.

    Input is the metric table (one row per period), so the fold is small.
    """
    item = F.struct(F.col(period).alias("period"), F.col("auc").alias("auc"), F.col("n_labeled").alias("n"))
    log_type = "array<struct<period:string,baseline_auc:double,delta:double,reason:string,approval:string>>"
    start = F.struct(F.lit(baseline_auc).alias("baseline"), F.array().cast(log_type).alias("log"))

    def step(acc: Column, x: Column) -> Column:
        reason = retrain_reason(x["auc"], acc["baseline"], x["n"], min_batch, change)
        delta = x["auc"] - acc["baseline"]
        verdict = approval(reason, delta, mode, min_improvement)
        entry = F.struct(
            x["period"].cast("string").alias("period"), acc["baseline"].alias("baseline_auc"), delta.alias("delta"),
            reason.alias("reason"), verdict.alias("approval"),
        )
        return F.struct(
            F.when(verdict == "approved", x["auc"]).otherwise(acc["baseline"]).alias("baseline"),
            F.concat(acc["log"], F.array(entry)).alias("log"),
        )

    runs = metrics.agg(F.sort_array(F.collect_list(item)).alias("items"))
    runs = runs.select(F.explode(F.aggregate("items", start, step)["log"]).alias("r")).select("r.*")
    runs = runs.withColumnRenamed("period", "_period")
    out = metrics.join(runs, F.col(period).cast("string") == F.col("_period")).drop("_period")
    return out.withColumn("triggered", is_triggered(F.col("reason")))


# Trigger kinds that fire always, and those that compare a metric.
ALWAYS = ("schedule", "manual")
COMPARED = ("data_drift", "label_drift", "volume_spike")


def ct_trigger(kind: Column, value: Column, threshold: Column) -> Column:
    """Continuous-training trigger by kind."""
    return F.when(kind.isin(*ALWAYS), True).when(kind.isin(*COMPARED), F.coalesce(value >= threshold, F.lit(False))).otherwise(False)


def auc_guard(auc: Column, baseline: Column, tolerance: float = 0.01) -> Column:
    """Passes while the AUC does not fall more than the tolerance below the baseline."""
    return auc >= baseline - tolerance


def is_regression(before: Column, after: Column, tolerance: float = 0.01) -> Column:
    return (after - before) < -tolerance
