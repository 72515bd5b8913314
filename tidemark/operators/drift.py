"""Distribution drift and train/serve skew, all features in one plan.

Two frames become one long table (feature, is_ref, value); every metric is
keyed by feature, so there is no loop of jobs over columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.functions.ordering import running_totals
from tidemark.operators.profile import moments, to_long

BINS = 10
FLOOR = 1e-9
SMOOTH = 1e-4

# Low and high limit per drift metric.
LIMITS = {"psi": (0.10, 0.20), "ks": (0.05, 0.10), "mmd": (0.05, 0.10), "classifier_auc": (0.65, 0.70)}


def shared_numeric(reference: DataFrame, current: DataFrame) -> list[str]:
    numeric = {f.name for f in reference.schema.fields if isinstance(f.dataType, NumericType)}
    return sorted(numeric & set(current.columns))


def pair(reference: DataFrame, current: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, is_ref, value) without missing values."""
    a = to_long(reference, features, keep, "feature").withColumn("is_ref", F.lit(True))
    b = to_long(current, features, keep, "feature").withColumn("is_ref", F.lit(False))
    return a.unionByName(b).where(F.col("value").isNotNull())


def weighted(long: DataFrame) -> DataFrame:
    """Rows with their weight per side, 0 or 1."""
    if "_r" in long.columns:
        return long
    return long.select("feature", "value", F.col("is_ref").cast("long").alias("_r"), (~F.col("is_ref")).cast("long").alias("_c"))


def merged(long: DataFrame) -> DataFrame:
    """One row per (feature, distinct value) with its count per side.

    Every metric but MMD can be read from this table, so a report shuffles the
    values once.
    """
    if "_r" in long.columns:
        return long
    return long.groupBy("feature", "value").agg(
        F.count_if("is_ref").alias("_r"), F.count_if(~F.col("is_ref")).alias("_c")
    )


def _ranges(rows: DataFrame) -> DataFrame:
    """One row per feature: joint and reference range, rows per side."""
    ref, cur = F.when(F.col("_r") > 0, F.col("value")), F.when(F.col("_c") > 0, F.col("value"))
    return rows.groupBy("feature").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        F.min(ref).alias("_rlo"), F.max(ref).alias("_rhi"), F.min(cur).alias("_clo"), F.max(cur).alias("_chi"),
        F.sum("_r").alias("_n"), F.sum("_c").alias("_m"),
    )


def bin_of(v: Column, lo: Column, hi: Column) -> Column:
    """Index 0..9 of equal-width bins; the last bin is closed."""
    step = (hi - lo) / BINS
    out = F.lit(0)
    for i in range(1, BINS):
        out = out + (v >= step * i + lo).cast("int")
    return out


def _histogram(rows: DataFrame, ranges: DataFrame, lo: Column, hi: Column, inside: Column | None = None) -> DataFrame:
    """Counts per (feature, bin) and side, with the range columns of the feature."""
    rows = rows.join(F.broadcast(ranges), "feature")  # one row per column name
    if inside is not None:
        rows = rows.where(inside)
    keys = [c for c in ranges.columns if c != "feature"]
    return rows.withColumn("_bin", bin_of(F.col("value"), lo, hi)).groupBy("feature", "_bin", *keys).agg(
        F.sum("_r").alias("_r"), F.sum("_c").alias("_c")
    )


def psi_joint(long: DataFrame, min_rows: int = 5) -> DataFrame:
    """PSI over bins of the joint range; 0 with fewer than five values on a side."""
    rows = weighted(long)
    ranges = _ranges(rows)
    bins = _histogram(rows, ranges, F.col("_lo"), F.col("_hi") + 1e-9)

    def share(count: str, total: str) -> Column:
        s = F.try_divide(F.col(count), F.col(total))
        return F.when(s == 0, F.lit(FLOOR)).otherwise(s)

    p, q = share("_r", "_n"), share("_c", "_m")
    sums = bins.groupBy("feature").agg(F.sum((q - p) * F.ln(q / p)).alias("_psi"))
    out = ranges.join(F.broadcast(sums), "feature", "left")
    enough = (F.col("_n") >= min_rows) & (F.col("_m") >= min_rows)
    return out.select("feature", F.when(enough, F.col("_psi")).otherwise(F.lit(0.0)).alias("psi"))


def psi_reference(long: DataFrame) -> DataFrame:
    """PSI over bins of the reference range; rows outside count in the total only."""
    rows = weighted(long)
    ranges = _ranges(rows)
    lo, hi = F.col("_rlo"), F.col("_rhi")
    inside = (F.col("value") >= lo - 1e-8) & (F.col("value") <= hi + 1e-8)
    bins = _histogram(rows, ranges, lo, hi, inside)
    p = F.col("_r") / F.greatest("_n", F.lit(1)) + SMOOTH
    q = F.col("_c") / F.greatest("_m", F.lit(1)) + SMOOTH
    sums = bins.groupBy("feature").agg(F.sum((q - p) * F.ln(q / p)).alias("_psi"))
    constant = F.when(F.col("_clo") == F.col("_chi"), F.lit(0.0)).otherwise(F.lit(1.0))
    out = ranges.join(F.broadcast(sums), "feature", "left")
    return out.select("feature", F.when(lo == hi, constant).otherwise(F.col("_psi")).alias("psi"))


def js_distance(long: DataFrame) -> DataFrame:
    """Square root of the Jensen-Shannon divergence over joint bins."""
    rows = weighted(long)
    ranges = _ranges(rows)
    bins = _histogram(rows, ranges, F.col("_lo"), F.col("_hi"))
    total_p, total_q = F.col("_n") + BINS * SMOOTH, F.col("_m") + BINS * SMOOTH

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return (p * F.ln(p / m) + q * F.ln(q / m)) / 2

    full = term((F.col("_r") + SMOOTH) / total_p, (F.col("_c") + SMOOTH) / total_q)
    sums = bins.groupBy("feature").agg(F.sum(full).alias("_s"), F.count("*").alias("_used"))
    empty = term(SMOOTH / total_p, SMOOTH / total_q) * (BINS - F.col("_used"))
    out = ranges.join(F.broadcast(sums), "feature", "left")
    both_constant = (F.col("_rlo") == F.col("_rhi")) & (F.col("_clo") == F.col("_chi"))
    js = F.sqrt(F.greatest(F.col("_s") + empty, F.lit(0.0)))
    return out.select("feature", F.when(both_constant, F.lit(0.0)).otherwise(js).alias("js_distance"))


def _distances(long: DataFrame) -> DataFrame:
    """Per feature: rows per side, KS distance and the share of won pairs, from one pass of running totals."""
    counts = merged(long)
    run = running_totals(counts, "value", ["feature"], {"_cr": F.col("_r"), "_cc": F.col("_c")})
    totals = counts.groupBy("feature").agg(F.sum("_r").alias("n_ref"), F.sum("_c").alias("n_cur"))
    both = run.join(F.broadcast(totals), "feature")
    gap = F.abs(F.try_divide(F.col("_cr"), F.col("n_ref")) - F.try_divide(F.col("_cc"), F.col("n_cur")))
    won = F.sum(F.col("_c") * (F.col("_cr") - F.col("_r") / 2))
    out = both.groupBy("feature", "n_ref", "n_cur").agg(F.max(gap).alias("_ks"), won.alias("_won"))
    return out.withColumn("_auc", F.try_divide(F.col("_won"), F.col("n_ref").cast("double") * F.col("n_cur")))


def _at_least(n: int) -> Column:
    return (F.col("n_ref") >= n) & (F.col("n_cur") >= n)


def _ks(d: DataFrame, min_rows: int) -> DataFrame:
    return d.select("feature", "n_ref", "n_cur", F.when(_at_least(min_rows), F.col("_ks")).otherwise(F.lit(0.0)).alias("ks"))


def _auc(d: DataFrame, min_rows: int) -> DataFrame:
    return d.select("feature", F.when(_at_least(min_rows), F.col("_auc")).otherwise(F.lit(0.5)).alias("classifier_auc"))


def ks_statistic(long: DataFrame, min_rows: int = 5) -> DataFrame:
    """Largest distance of the two empirical distribution functions."""
    return _ks(_distances(long), min_rows)


def two_sample_auc(long: DataFrame, min_rows: int = 10) -> DataFrame:
    """P(current > reference) with half credit for ties, on all rows."""
    return _auc(_distances(long), min_rows)


def kolmogorov_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of a two-sample statistic."""
    t = d * F.sqrt(n.cast("double") * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t * t),
    )
    return F.when(t < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_test(long: DataFrame) -> DataFrame:
    """KS statistic with its asymptotic p-value."""
    out = ks_statistic(long, 1)
    return out.withColumn("p_value", kolmogorov_pvalue(F.col("ks"), F.col("n_ref"), F.col("n_cur")))


def fourier_frequencies(gamma: float = 1.0, n: int = 256) -> list[float]:
    """Fixed draws from the spectrum of exp(-gamma d^2), a normal law of variance 2 gamma: one from each of ``n`` equal parts, by hash."""
    shares = [(k + (int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) + 0.5) / 2**32) / n for k in range(n)]
    return [round(math.sqrt(2 * gamma) * NormalDist().inv_cdf(u), 6) for u in shares]


def mmd_rbf(long: DataFrame, gamma: float = 1.0, min_rows: int = 5) -> DataFrame:
    """Kernel distance of all rows, by random Fourier features.

    A squared distance is the mean over frequencies of the squared difference of
    two characteristic functions, so each distinct value is read once, as one
    vector of cosines and sines that is summed on the map side; nothing is
    paired.  The error is in proportion to the distance itself: with 256 fixed
    frequencies, one from each part of the spectrum, a distance near the alarm
    limits is within 0.01 of that of all pairs.
    """
    values = long.where(F.col("value").isNotNull()).groupBy("feature", "is_ref", "value").agg(F.count("*").cast("double").alias("k"))
    frequencies = F.array(*[F.lit(w) for w in fourier_frequencies(gamma)])
    turns = F.transform(frequencies, lambda w: w * F.col("value"))
    wave = array_to_vector(F.concat(F.transform(turns, F.cos), F.transform(turns, F.sin)))
    side = values.groupBy("feature", "is_ref").agg(Summarizer.mean(wave, F.col("k")).alias("mean"), F.sum("k").alias("n"))
    mean = side.groupBy("feature").agg(*[
        F.max(F.when(F.col("is_ref") == ref, c)).alias(name)
        for ref, c, name in ((True, vector_to_array("mean"), "x"), (False, vector_to_array("mean"), "y"), (True, F.col("n"), "n"), (False, F.col("n"), "m"))
    ])
    n, m, parts = F.coalesce("n", F.lit(0.0)), F.coalesce("m", F.lit(0.0)), len(fourier_frequencies(gamma))

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v) / parts

    within_x, within_y = F.try_divide(n * dot("x", "x") - 1, n - 1), F.try_divide(m * dot("y", "y") - 1, m - 1)
    mmd = F.sqrt(F.abs(within_x + within_y - 2 * dot("x", "y")))
    return mean.select("feature", F.when((n >= min_rows) & (m >= min_rows), mmd).otherwise(F.lit(0.0)).alias("mmd"))


def _severity(value: Column, low: float, high: float) -> Column:
    return F.when(value >= high, "HIGH").when(value >= low, "LOW").otherwise("NONE")


def drift_report(
    reference: DataFrame, current: DataFrame, key: str, features: Sequence[str] | None = None,
    limits: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Feature x metric with severity, for the shared numeric features."""
    limits = {**LIMITS, **(limits or {})}
    features = list(features or [c for c in shared_numeric(reference, current) if c != key])
    long = pair(reference, current, features, [key])
    counts = merged(long)
    distances = _distances(counts)
    tables = {
        "psi": psi_joint(counts), "ks": _ks(distances, 5).select("feature", "ks"),
        "mmd": mmd_rbf(long), "classifier_auc": _auc(distances, 10),
    }
    out = None
    for metric, table in tables.items():
        low, high = limits[metric]
        part = table.select(
            "feature", F.lit(metric).alias("metric"), F.col(metric).alias("value"), F.lit(high).alias("threshold"),
            _severity(F.col(metric), low, high).alias("severity"),
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("drifted", F.col("severity") != "NONE")


def drift_summary(report: DataFrame, share_ok: float = 0.20) -> DataFrame:
    """One row: drifted features, their share, any HIGH, and the verdict."""
    per_feature = report.groupBy("feature").agg(
        F.bool_or("drifted").alias("_d"), F.bool_or(F.col("severity") == "HIGH").alias("_h")
    )
    out = per_feature.agg(
        F.count_if("_d").alias("n_drifted"), F.count("*").alias("n_tested"), F.coalesce(F.bool_or("_h"), F.lit(False)).alias("overall_drifted")
    )
    share = F.col("n_drifted") / F.greatest(F.col("n_tested"), F.lit(1))
    return out.withColumn("share_drifted", share).withColumn("passed", F.col("share_drifted") <= share_ok)


def monitor_drift(long: DataFrame) -> DataFrame:
    """PSI and KS per feature with one severity, as the feature monitor uses it."""
    counts = merged(long)
    out = psi_joint(counts).join(ks_statistic(counts, 1).select("feature", "ks"), "feature")
    (pl, ph), (kl, kh) = LIMITS["psi"], LIMITS["ks"]
    high = (F.col("psi") >= ph) | (F.col("ks") >= kh)
    low = (F.col("psi") >= pl) | (F.col("ks") >= kl)
    return out.withColumn("severity", F.when(high, "HIGH").when(low, "LOW").otherwise("NONE"))


# --- train / serve skew -----------------------------------------------------

SKEW_COLUMNS = ["kind", "feature", "train_value", "serve_value", "delta", "severity"]


def schema_skew(train: DataFrame, serve: DataFrame) -> DataFrame:
    """Columns missing at serving (HIGH) and extra ones (LOW); metadata only."""
    a, b = set(train.columns), set(serve.columns)
    rows = [("schema", c, 1.0, 0.0, 1.0, "HIGH") for c in sorted(a - b)]
    rows += [("schema", c, 0.0, 1.0, 1.0, "LOW") for c in sorted(b - a)]
    schema = "kind string, feature string, train_value double, serve_value double, delta double, severity string"
    return train.sparkSession.createDataFrame(rows, schema)


def feature_skew(train: DataFrame, serve: DataFrame, features: Sequence[str]) -> DataFrame:
    """PSI and relative mean change; rows without skew are left out."""
    psi = psi_joint(pair(train, serve, features))
    a = moments(train, features).select(F.col("column").alias("feature"), F.coalesce("mean", F.lit(0.0)).alias("train_value"))
    b = moments(serve, features).select(F.col("column").alias("feature"), F.coalesce("mean", F.lit(0.0)).alias("serve_value"))
    delta = F.abs(F.col("train_value") - F.col("serve_value"))
    rel = delta / (F.abs("train_value") + 1e-9)
    psi_value = F.coalesce("psi", F.lit(0.0))
    out = a.join(b, "feature").join(psi, "feature", "left").select(
        F.lit("feature").alias("kind"), "feature", "train_value", "serve_value", delta.alias("delta"),
        F.when((psi_value >= 0.2) | (rel >= 0.25), "HIGH").when((psi_value >= 0.1) | (rel >= 0.1), "LOW")
        .otherwise("NONE").alias("severity"),
    )
    return out.where("severity <> 'NONE'")


def prediction_skew(train: DataFrame, serve: DataFrame, key: str, score: str, tolerance: float = 1e-3) -> DataFrame:
    """Largest and mean score difference of rows paired by id."""
    a = train.select(key, F.col(score).alias("_a"))
    b = serve.select(key, F.col(score).alias("_b"))
    d = F.abs(F.col("_a") - F.col("_b"))
    out = a.join(b, key, "full_outer").agg(
        F.count("_a").alias("n_train"), F.count("_b").alias("n_serve"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_unmatched"),
        F.avg("_a").alias("train_value"), F.avg("_b").alias("serve_value"),
        F.max(d).alias("max_delta"), F.avg(d).alias("mean_delta"),
    )
    empty = (F.col("n_train") == 0) | (F.col("n_serve") == 0)
    severity = (
        F.when(empty, "NONE").when(F.col("n_unmatched") > 0, "HIGH").when(F.col("max_delta") > tolerance * 10, "HIGH")
        .when(F.col("max_delta") > tolerance, "LOW").otherwise("NONE")
    )
    return out.withColumn("severity", severity)


def train_serve_skew(
    train: DataFrame, serve: DataFrame, features: Sequence[str], key: str | None = None, score: str | None = None
) -> DataFrame:
    """Schema, feature and prediction evidence in one table."""
    out = schema_skew(train, serve).unionByName(feature_skew(train, serve, features))
    if key is not None and score is not None:
        p = prediction_skew(train, serve, key, score).where("severity <> 'NONE'").select(
            F.lit("prediction").alias("kind"), F.lit("prediction").alias("feature"), "train_value", "serve_value",
            F.col("max_delta").alias("delta"), "severity",
        )
        out = out.unionByName(p)
    return out
