"""Ground truth: delayed outcomes, corrections, arrival and policy checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordering import row_numbers

# Days after which an outcome counts as final, and arrival horizons.
OUTCOME_DELAY_DAYS = 90
MIN_FEEDBACK_DELAY_DAYS = 30
HORIZONS = (1, 7, 30, 90, 180)


def days_later(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(days=F.lit(days))


def confirmed_label_join(
    predictions: DataFrame, outcomes: DataFrame, key: str, predicted_at: str, outcome_at: str,
    delay_days: int = OUTCOME_DELAY_DAYS,
) -> DataFrame:
    """Inner join that keeps outcomes at least ``delay_days`` after the prediction.

    Many-to-many matches stay, as the label table defines them.  A hot key is
    split by the adaptive planner.
    """
    late_enough = F.col(outcome_at) >= days_later(F.col(predicted_at), delay_days)
    return predictions.join(outcomes, key).where(late_enough)


def confirmed_label_counts(
    predictions: DataFrame, outcomes: DataFrame, key: str, predicted_at: str, outcome_at: str,
    delay_days: int = OUTCOME_DELAY_DAYS,
) -> DataFrame:
    """Matched, confirmed and dropped pairs, in one aggregation."""
    late_enough = F.col(outcome_at) >= days_later(F.col(predicted_at), delay_days)
    pairs = predictions.select(key, predicted_at).join(outcomes.select(key, outcome_at), key)
    return pairs.agg(
        F.count("*").alias("n_matched"), F.count_if(late_enough).alias("n_confirmed"),
        F.count_if(~F.coalesce(late_enough, F.lit(False))).alias("n_dropped"),
    )


def delayed_outcome_join(
    predictions: DataFrame, outcomes: DataFrame, key: str, outcome: str, delay: str, arrival: Sequence[str],
    min_delay_days: float = MIN_FEEDBACK_DELAY_DAYS,
) -> DataFrame:
    """Every prediction with its last outcome and a ``status``.

    confirmed: an outcome exists, is known and is old enough; else provisional.
    """
    last = outcomes.groupBy(key).agg(
        F.max_by(F.struct(outcome, delay), F.struct(*arrival)).alias("_last")
    ).select(key, F.col("_last")[outcome].alias(outcome), F.col("_last")[delay].alias(delay))
    joined = predictions.join(last, key, "left")
    known = F.col(outcome).isNotNull() & (F.col(delay) >= min_delay_days)
    return joined.withColumn("status", F.when(known, "confirmed").otherwise("provisional"))


def label_corrections(df: DataFrame, key: str, ts: str, ties: Sequence[str]) -> DataFrame:
    """Mark the newest label of each key as current, older ones as superseded."""
    ranked = row_numbers(df, ts, [key], ties, descending=True, name="_rank")
    return ranked.withColumns({
        "is_current": F.col("_rank") == 1, "is_superseded": F.col("_rank") > 1,
    }).drop("_rank")


def current_labels(df: DataFrame, key: str, ts: str, ties: Sequence[str]) -> DataFrame:
    """Newest row per key; rows of one key are combined before the shuffle."""
    others = [c for c in df.columns if c != key]
    # Ties are settled toward the smaller tie-break value, as in label_corrections.
    newest = F.min_by(F.struct(*others), F.struct(-F.unix_micros(ts), *ties))
    return df.groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def label_arrival(
    df: DataFrame, observed_at: str, outcome_at: str, delay_days: int = OUTCOME_DELAY_DAYS, min_fraction: float = 0.90
) -> DataFrame:
    """Share of rows whose outcome is old enough, and whether that is enough to train."""
    late_enough = F.col(outcome_at) >= days_later(F.col(observed_at), delay_days)
    out = df.agg(F.count("*").alias("n_total"), F.count_if(late_enough).alias("n_confirmed"))
    pct = F.coalesce(F.try_divide(F.col("n_confirmed"), F.col("n_total")), F.lit(0.0))
    return out.withColumn("pct_confirmed", pct).withColumn("sufficient", F.col("pct_confirmed") >= min_fraction)


def arrival_curve(df: DataFrame, observed_at: str, outcome_at: str) -> DataFrame:
    """Share of rows with a lag of at least 1, 7, 30, 90 and 180 whole days."""
    lag = F.floor((F.unix_micros(outcome_at) - F.unix_micros(observed_at)) / 86_400_000_000)
    counts = df.agg(F.count("*").alias("n_total"), *[F.count_if(lag >= d).alias(f"_t{d}") for d in HORIZONS])
    return counts.select(
        "n_total", *[F.coalesce(F.try_divide(f"_t{d}", "n_total"), F.lit(0.0)).alias(f"t{d}") for d in HORIZONS]
    )


def label_policy_checks(
    df: DataFrame, policy: str = "policy_version", corrected: str = "is_corrected", max_rate: float = 0.05
) -> DataFrame:
    """Number of policy versions (one is consistent) and the share of corrections."""
    has_policy, has_flag = policy in df.columns, corrected in df.columns
    out = df.agg(
        F.count("*").alias("n_total"),
        # A missing version counts as one more version.
        (F.count_distinct(policy) + F.max(F.col(policy).isNull().cast("int")) if has_policy else F.max(F.lit(0)))
        .cast("long").alias("n_versions"),
        (F.count_if(corrected) if has_flag else F.max(F.lit(0))).cast("long").alias("n_corrected"),
    )
    rate = F.coalesce(F.try_divide("n_corrected", "n_total"), F.lit(0.0))
    return out.withColumns({
        "is_consistent": F.col("n_versions") == 1, "correction_rate": rate, "flag": rate > max_rate,
    })
