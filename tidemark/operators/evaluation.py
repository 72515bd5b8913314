"""Model evaluation on a scored table: ranks, bins, costs, slices, gates.

Input rows hold a 0/1 label and a score; ``groups`` (model version, slice,
period) keys every metric, so many models or slices are one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.ordering import order_values, present, row_numbers, running_totals
from tidemark.functions.hashing import md5_number

# Cost of a wrong decline and of a wrong approval.
FALSE_POSITIVE_COST = 2000.0
FALSE_NEGATIVE_COST = 8000.0

THRESHOLDS = [float(x) for x in np.linspace(0.01, 0.99, 200)]
BIN_EDGES = [float(x) for x in np.linspace(0, 1, 11)]


def _scored(df: DataFrame, label: str, score: str, groups: Sequence[str]) -> DataFrame:
    """Rows with both values, as (groups, _y, _p)."""
    return df.where(F.col(label).isNotNull() & present(F.col(score).cast("double"))).select(
        *groups, F.col(label).cast("int").alias("_y"), F.col(score).cast("double").alias("_p")
    )


# --- rank metrics -----------------------------------------------------------

def rank_metrics(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` (half credit for ties) and ``average_precision``; null if one class.

    Rows are merged per distinct score first; running totals are exact and
    never order a whole group in one task.
    """
    merged = _scored(df, label, score, groups).groupBy(*groups, "_p").agg(
        F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") == 0).alias("_neg")
    )
    run = running_totals(merged, "_p", groups, {"_cp": F.col("_pos"), "_cn": F.col("_neg")}, descending=True)
    pos, neg, cp, cn = (F.col(c) for c in ("_pos", "_neg", "_cp", "_cn"))
    total_pos, total_neg = F.sum(pos), F.sum(neg)
    lost = F.sum(pos * (cn - neg / 2))
    steps = F.sum(pos * cp / (cp + cn))
    both = (total_pos > 0) & (total_neg > 0)
    return run.groupBy(*groups).agg(
        (total_pos + total_neg).alias("n"),
        total_pos.alias("n_pos"),
        F.when(both, 1 - F.try_divide(lost, total_pos.cast("double") * total_neg)).alias("roc_auc"),
        F.when(total_pos > 0, F.try_divide(steps, total_pos)).alias("average_precision"),
    )


def roc_auc(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    return rank_metrics(df, label, score, groups).select(*groups, "n", "n_pos", "roc_auc")


def average_precision(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    return rank_metrics(df, label, score, groups).select(*groups, "n", "n_pos", "average_precision")


# --- one-pass metrics -------------------------------------------------------

def brier(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    rows = _scored(df, label, score, groups)
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg((F.col("_p") - F.col("_y")) * (F.col("_p") - F.col("_y"))).alias("brier")
    )


def _count_edges(edges: Sequence[float], passed) -> Column:
    """Number of edges for which ``passed(edge)`` holds, as plain comparisons."""
    out = F.lit(0)
    for e in edges:
        out = out + passed(F.lit(e)).cast("int")
    return out


def lower_bin(p: Column) -> Column:
    """Uniform bin 0..9; a value on an edge belongs to the lower bin."""
    return _count_edges(BIN_EDGES[1:-1], lambda e: p > e)


def upper_bin(p: Column) -> Column:
    """Uniform bin 0..9 of [lo, hi) intervals; 1.0 is in no bin."""
    return F.when((p >= 0) & (p < 1), _count_edges(BIN_EDGES[1:-1], lambda e: p >= e))


def _bins(df: DataFrame, label: str, score: str, groups: Sequence[str], bin_of) -> DataFrame:
    rows = _scored(df, label, score, groups).withColumn("bin", bin_of(F.col("_p"))).where("bin is not null")
    return rows.groupBy(*groups, "bin").agg(
        F.count("*").alias("n"), F.avg("_p").alias("mean_predicted"), F.avg("_y").alias("fraction_positive")
    )


def reliability_table(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean prediction and share of positives per non-empty bin."""
    out = _bins(df, label, score, groups, lower_bin)
    return out.withColumn("gap", F.col("fraction_positive") - F.col("mean_predicted"))


def ece_unweighted(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean absolute gap over the non-empty bins."""
    table = reliability_table(df, label, score, groups)
    return table.groupBy(*groups).agg(F.avg(F.abs("gap")).alias("calibration_error"))


def ece_weighted(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Absolute gap weighted by the share of *all* rows in the bin."""
    bins = _bins(df, label, score, groups, upper_bin)
    gap = F.abs(F.col("fraction_positive") - F.col("mean_predicted"))
    sums = bins.groupBy(*groups).agg(F.sum(F.col("n") * gap).alias("_s"))
    total = _scored(df, label, score, groups).groupBy(*groups).agg(F.count("*").alias("_all"))
    if groups:
        out = total.join(sums, list(groups), "left")
        return out.select(*groups, (F.coalesce("_s", F.lit(0.0)) / F.col("_all")).alias("ece"))
    return sums.select((F.coalesce("_s", F.lit(0.0)) / total.select("_all").scalar()).alias("ece"))


def calibration_report(df: DataFrame, label: str, before: str, after: str) -> DataFrame:
    """Calibration error and Brier score before and after, side by side."""
    long = df.select(F.col(label).alias("_l"), F.col(before).alias("before"), F.col(after).alias("after")).unpivot(
        ["_l"], ["before", "after"], "stage", "_s"
    )
    e = ece_unweighted(long, "_l", "_s", ["stage"])
    b = brier(long, "_l", "_s", ["stage"])
    one = e.join(b, "stage").groupBy().pivot("stage", ["before", "after"]).agg(
        F.max("calibration_error").alias("ece"), F.max("brier").alias("brier")
    )
    return one.withColumn("improved", F.col("after_ece") < F.col("before_ece"))


def confusion(
    df: DataFrame, label: str, score: str, threshold: float = 0.5, groups: Sequence[str] = (),
    fp_cost: float = FALSE_POSITIVE_COST, fn_cost: float = FALSE_NEGATIVE_COST,
) -> DataFrame:
    rows = _scored(df, label, score, groups)
    hit, y = F.col("_p") >= threshold, F.col("_y") == 1
    out = rows.groupBy(*groups).agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
    )
    return _rates(out, fp_cost, fn_cost)


def _rates(df: DataFrame, fp_cost: float, fn_cost: float) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({
        "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)),
        "cost": fp * F.lit(fp_cost) + fn * F.lit(fn_cost),
    })


# --- thresholds -------------------------------------------------------------

def _thresholds_at_most(p: Column) -> Column:
    """How many of the 200 thresholds are <= p: a guess by position, then corrected."""
    arr = F.array(*[F.lit(t) for t in THRESHOLDS])
    n = len(THRESHOLDS)
    step = (THRESHOLDS[-1] - THRESHOLDS[0]) / (n - 1)
    guess = F.least(F.greatest(F.floor((p - THRESHOLDS[0]) / step) + 1, F.lit(0)), F.lit(n)).cast("int")

    def at(i: Column) -> Column:
        return F.try_element_at(arr, F.when((i >= 1) & (i <= n), i).cast("int"))

    return (
        F.when((guess > 0) & (at(guess) > p), guess - 1)
        .when((guess < n) & (at(guess + 1) <= p), guess + 1)
        .otherwise(guess)
    )


def threshold_sweep(
    df: DataFrame, label: str, score: str, groups: Sequence[str] = (),
    fp_cost: float = FALSE_POSITIVE_COST, fn_cost: float = FALSE_NEGATIVE_COST,
) -> DataFrame:
    """Cost, counts, precision and recall at 200 thresholds, from one pass.

    Scores are counted per threshold index (at most 201 rows per group); the
    200 results are running sums over those counts.
    """
    rows = _scored(df, label, score, groups).withColumn("_i", _thresholds_at_most(F.col("_p")))
    counts = rows.groupBy(*groups, "_i").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    n = len(THRESHOLDS)
    steps = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_j")
    if groups:
        grid = counts.select(*groups).distinct().select(*groups, steps)
    else:
        grid = df.sparkSession.range(1).select(steps)
    renamed = counts.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)], "_i", "_pos", "_neg")
    cond = F.col("_j") == F.col("_i")
    for i, g in enumerate(groups):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    filled = grid.join(renamed, cond, "left").select(
        *groups, "_j", F.coalesce("_pos", F.lit(0)).alias("_pos"), F.coalesce("_neg", F.lit(0)).alias("_neg")
    )
    w = Window.partitionBy(*groups)
    down = w.orderBy(F.col("_j").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = filled.withColumns({
        "tp": F.sum("_pos").over(down), "fp": F.sum("_neg").over(down),
        "_p_all": F.sum("_pos").over(w), "_n_all": F.sum("_neg").over(w),
    }).where("_j > 0")
    table = F.array(*[F.lit(t) for t in THRESHOLDS])
    out = out.select(
        *groups, F.element_at(table, F.col("_j")).alias("threshold"), "tp", "fp",
        (F.col("_p_all") - F.col("tp")).alias("fn"), (F.col("_n_all") - F.col("fp")).alias("tn"),
    )
    return _rates(out, fp_cost, fn_cost)


def best_threshold(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), **costs: float) -> DataFrame:
    """Cheapest threshold, the lowest one on ties, with its counts."""
    sweep = threshold_sweep(df, label, score, groups, **costs)
    fields = ["threshold", "cost", "tp", "fp", "fn", "tn", "precision", "recall"]
    best = sweep.groupBy(*groups).agg(F.min_by(F.struct(*fields), F.struct("cost", "threshold")).alias("b"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return best.select(*groups, "b.*").withColumn("cost_per_row", F.try_divide(F.col("cost"), total))


# --- decisions --------------------------------------------------------------

def route_decision(score: Column, approve: float, decline: float) -> Column:
    """approve below the first limit, decline from the second on, else review."""
    if approve >= decline:
        raise ValueError("approve threshold must be below decline threshold")
    return F.when(score < approve, "approve").when(score >= decline, "decline").otherwise("review")


def review_band(df: DataFrame, label: str, score: str, approve: float, decline: float) -> DataFrame:
    """Rows, share and positive rate per decision; empty decisions are absent."""
    rows = _scored(df, label, score, ()).withColumn("decision", route_decision(F.col("_p"), approve, decline))
    out = rows.groupBy("decision").agg(F.count("*").alias("n"), F.avg("_y").alias("positive_rate"))
    return out.withColumn("pct", F.col("n") / out.agg(F.sum("n").alias("s")).scalar())


def routing_stats(df: DataFrame, score: str, approve: float, decline: float) -> DataFrame:
    """Share of each decision and the width of the review band."""
    d = route_decision(F.col(score), approve, decline)
    return df.agg(
        *[F.avg((d == k).cast("double")).alias(f"pct_{k}") for k in ("approve", "review", "decline")],
        F.max(F.lit(decline - approve)).alias("review_band_width"),
    )


def calibrated_band(df: DataFrame, label: str, score: str, target_review_pct: float = 0.15) -> DataFrame:
    """Band of the target width around the cheapest threshold, clipped to sane limits."""
    half = target_review_pct / 2.0

    def clip(c: Column, lo, hi) -> Column:
        return F.least(F.greatest(c, lo), hi)

    best = best_threshold(df, label, score).select("threshold")
    low = clip(F.col("threshold") - half, F.lit(0.05), F.lit(0.45))
    out = best.withColumn("_low", low)
    high = clip(F.col("threshold") + half, F.col("_low") + 0.05, F.lit(0.95))
    return out.select("threshold", F.round("_low", 3).alias("approve"), F.round(high, 3).alias("decline"))


# --- slices -----------------------------------------------------------------

def long_slices(df: DataFrame, slice_cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, slice column)."""
    text = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in slice_cols])
    return text.unpivot(list(keep), list(slice_cols), "slice_col", "slice_val")


def slice_metrics(
    df: DataFrame, label: str, score: str, slice_cols: Sequence[str], min_size: int = 50, groups: Sequence[str] = ()
) -> DataFrame:
    """Rank and calibration metrics of every slice with enough rows and both classes."""
    keep = [*groups, label, score]
    long = long_slices(df, slice_cols, keep)
    keys = [*groups, "slice_col", "slice_val"]
    ranks = rank_metrics(long, label, score, keys)
    ece = ece_unweighted(long, label, score, keys)
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    out = ranks.where((F.col("n") >= min_size) & both).join(ece, keys)
    return out.withColumn("positive_rate", F.col("n_pos") / F.col("n"))


def slice_gaps(slices: DataFrame, overall: DataFrame, metric: str = "roc_auc", warn: float = 0.05) -> DataFrame:
    """Distance of each slice to the overall metric (a one-row table)."""
    out = slices.withColumn("overall", overall.select(metric).scalar())
    out = out.withColumn("gap", F.col("overall") - F.col(metric))
    return out.withColumn("flag", F.col("gap") > warn)


def slice_auc_gap(slices: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Largest minus smallest slice AUC; 0 with fewer than two slices."""
    spread = F.when(F.count("roc_auc") >= 2, F.max("roc_auc") - F.min("roc_auc")).otherwise(F.lit(0.0))
    return slices.groupBy(*groups).agg(spread.alias("slice_auc_gap"))


def worst_n(df: DataFrame, metric: str, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` lowest rows by a metric, ties in key order."""
    return df.orderBy(F.col(metric).asc_nulls_last(), *keys).limit(n)


# --- champion and challenger ------------------------------------------------

@dataclass(frozen=True)
class GateLimits:
    """Hard gates of a model version and the gain a challenger needs."""

    min_auc: float = 0.75
    max_ece: float = 0.05
    max_slice_gap: float = 0.10
    champion_delta: float = 0.005
    max_cost: float | None = None


def model_metrics(
    df: DataFrame, label: str, score: str, version: str, slice_col: str | None = None, threshold: float = 0.5
) -> DataFrame:
    """AUC, ECE, Brier, slice gap and cost of every model version in one plan."""
    # Everything that is a sum comes from one pass: per version and bin, then per version.
    rows = _scored(df, label, score, [version])
    y, p = F.col("_y"), F.col("_p")
    bins = rows.withColumn("_bin", upper_bin(p)).groupBy(version, "_bin").agg(
        F.count("*").alias("_n"), F.sum(y).alias("_sy"), F.sum(p).alias("_sp"), F.sum((p - y) * (p - y)).alias("_se"),
        F.count_if((p >= threshold) & (y == 0)).alias("_fp"), F.count_if((p < threshold) & (y == 1)).alias("_fn"),
    )
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_sy") - F.col("_sp"))).otherwise(F.lit(0.0))
    sums = bins.groupBy(version).agg(
        F.sum("_n").alias("n"), (F.sum(gap) / F.sum("_n")).alias("ece"), (F.sum("_se") / F.sum("_n")).alias("brier"),
        (F.sum("_fp") * FALSE_POSITIVE_COST + F.sum("_fn") * FALSE_NEGATIVE_COST).alias("cost"),
    )
    # Ranks of the whole version and of its slices are groups of the same plan.
    whole = F.lit(None).cast("string")
    parts = F.array(whole) if slice_col is None else F.array(whole, F.col(slice_col).cast("string"))
    keyed = df.select(version, label, score, F.explode(parts).alias("_slice"))
    if slice_col is not None:
        keyed = df.where(F.col(slice_col).isNotNull()).select(version, label, score, F.explode(parts).alias("_slice")).unionByName(
            df.where(F.col(slice_col).isNull()).select(version, label, score, whole.alias("_slice"))
        )
    ranks = rank_metrics(keyed, label, score, [version, "_slice"])
    is_slice = F.col("_slice").isNotNull() & (F.col("n") >= 30)
    slice_auc = F.when(is_slice, F.col("roc_auc"))
    per_version = ranks.groupBy(version).agg(
        F.max(F.when(F.col("_slice").isNull(), F.col("roc_auc"))).alias("roc_auc"),
        F.when(F.count(slice_auc) >= 2, F.max(slice_auc) - F.min(slice_auc)).otherwise(F.lit(0.0)).alias("slice_auc_gap"),
    )
    return sums.join(per_version, version).select(version, "n", "roc_auc", "ece", "brier", "cost", "slice_auc_gap")


def gate_versions(metrics: DataFrame, version: str, limits: GateLimits = GateLimits()) -> DataFrame:
    """Run the versions through the gates in version order.

    The first passing version becomes champion; a later one replaces it when
    its AUC gain reaches the required delta.  One row per version goes in, so
    the fold runs over the small metric table, not over data.
    """
    auc = F.col("roc_auc")
    fails = [
        F.when(auc < limits.min_auc, "auc"),
        F.when(F.col("ece") > limits.max_ece, "ece"),
        F.when(F.col("slice_auc_gap") > limits.max_slice_gap, "slice_auc_gap"),
    ]
    if limits.max_cost is not None:
        fails.append(F.when(F.col("cost") > limits.max_cost, "cost"))
    judged = metrics.withColumn("failures", F.filter(F.array(*fails), lambda f: f.isNotNull()))
    item = F.struct(F.col(version).alias("v"), auc.alias("auc"), (F.size("failures") == 0).alias("ok"))
    start = F.struct(
        F.lit(None).cast("double").alias("champion_auc"),
        F.array().cast("array<struct<v:string,champion_auc:double,promoted:boolean>>").alias("log"),
    )

    def step(acc: Column, x: Column) -> Column:
        better = acc["champion_auc"].isNull() | (x["auc"] - acc["champion_auc"] >= limits.champion_delta)
        won = F.coalesce(x["ok"] & better, F.lit(False))
        entry = F.struct(
            x["v"].cast("string").alias("v"), acc["champion_auc"].alias("champion_auc"), won.alias("promoted")
        )
        return F.struct(
            F.when(won, x["auc"]).otherwise(acc["champion_auc"]).alias("champion_auc"),
            F.concat(acc["log"], F.array(entry)).alias("log"),
        )

    runs = judged.agg(F.sort_array(F.collect_list(item)).alias("items")).select(
        F.explode(F.aggregate("items", start, step)["log"]).alias("r")
    ).select(F.col("r.v").alias("_v"), F.col("r.champion_auc").alias("champion_auc"), F.col("r.promoted").alias("promoted"))
    out = judged.join(runs, F.col(version).cast("string") == F.col("_v")).drop("_v")
    return out.withColumn("delta", F.col("roc_auc") - F.col("champion_auc"))


def compare_versions(metrics: DataFrame, version: str, champion: str, challenger: str, min_gain: float = 0.0) -> DataFrame:
    """Champion against challenger: a tie stays with the champion; promotion needs ``min_gain``."""
    a = metrics.where(F.col(version) == champion).select(F.col("roc_auc").alias("champion_auc"))
    out = metrics.where(F.col(version) == challenger).select(F.col("roc_auc").alias("challenger_auc"))
    out = out.withColumn("champion_auc", a.scalar())
    out = out.withColumn("delta", F.col("challenger_auc") - F.col("champion_auc"))
    return out.withColumns({
        "winner": F.when(F.col("delta") > 0, "challenger").otherwise("champion"),
        "should_promote": F.col("delta") >= min_gain,
    })


# --- splits -----------------------------------------------------------------

def ordered_split(df: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """Add ``split``: consecutive shares of the rows in key order.

    Cut keys come from exact ranks; the split itself is a plain filter, so no
    row is moved.  Keys are unique; shares are cumulative limits in order.
    """
    names = list(shares)
    limits = np.cumsum([shares[n] for n in names])[:-1]
    ranks = {f"_cut{i}": (lambda n, q=float(q): F.floor(n * F.lit(round(q, 12)))) for i, q in enumerate(limits)}
    cuts = order_values(df.select(key), key, ranks)
    part = F.lit(names[-1])
    for i in reversed(range(len(limits))):
        cut = cuts.select(f"_cut{i}").scalar()
        part = F.when(F.col(key) < cut, names[i]).otherwise(part)
    return df.withColumn("split", part)


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 3, seed: int = 42, test_every: int = 5) -> DataFrame:
    """Add ``fold`` (0..k-1) and ``split`` (80/20), both stratified by the label."""
    h = md5_number(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    ranked = row_numbers(df.withColumn("_h", h), "_h", [label], [key], name="_r")
    return ranked.withColumns({
        "fold": F.pmod(F.col("_r") - 1, F.lit(k)).cast("int"),
        "split": F.when(F.pmod(F.col("_r") - 1, F.lit(test_every)) == 0, "test").otherwise("train"),
    }).drop("_h", "_r")
