"""Service and usage logs: latency, objectives, metrics, cost, traces, quotas."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import md5_bucket
from tidemark.functions.ordering import order_values, quantiles, running_totals, same_group

LATENCY_QUANTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}
# Upper bounds of the latency histogram in milliseconds.
LATENCY_BUCKETS = (5, 10, 25, 50, 100, 250, 500, 1000)


def last_n_rows(df: DataFrame, n: int, ts: str, key: str, groups: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows of each group, by an exact cut position and a filter.

    Only the cut is computed from ranks; no group is sorted in one task.
    """
    at = F.struct(F.col(ts), F.col(key))
    keyed = df.withColumn("_at", at)
    cut = order_values(
        keyed.select(*groups, "_at"), "_at", {"_cut": lambda c: F.greatest(c - n, F.lit(0))}, groups
    )
    if not groups:
        return keyed.where(F.col("_at") >= cut.select("_cut").scalar()).drop("_at")
    cut = cut.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_cut")
    return keyed.join(cut, same_group(groups)).where(F.col("_at") >= F.col("_cut")).select(*df.columns)


def latency_summary(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Count, mean and p50/p90/p95/p99 per label."""
    base = df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    q = quantiles(df, value, LATENCY_QUANTILES, groups)
    if groups:
        q = q.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], *LATENCY_QUANTILES)
        out = base.join(q, same_group(groups), "left").select(*base.columns, *LATENCY_QUANTILES)
    else:
        out = base.select("n", "mean", *[q.select(c).scalar().alias(c) for c in LATENCY_QUANTILES])
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("mean", *LATENCY_QUANTILES)}
    return out.withColumns(zero)


@dataclass(frozen=True)
class LatencyLimits:
    p95_ms: float = 200.0
    p99_ms: float = 500.0
    error_rate: float = 0.01


def sla_check(summary: DataFrame, error_rate: Column, limits: LatencyLimits = LatencyLimits()) -> DataFrame:
    """Latency summary against the limits of a load test."""
    return summary.withColumns({
        "p95_ok": F.col("p95") <= limits.p95_ms, "p99_ok": F.col("p99") <= limits.p99_ms,
        "errors_ok": error_rate <= limits.error_rate,
    }).withColumn("passed", F.col("p95_ok") & F.col("p99_ok") & F.col("errors_ok"))


# --- service level objectives -------------------------------------------------

@dataclass(frozen=True)
class Objectives:
    p99_ms: float = 500.0
    max_error_rate: float = 0.01
    min_auc: float = 0.72
    max_freshness_hours: float = 26.0
    min_approval: float = 0.60
    max_approval: float = 0.80
    max_default_rate: float = 0.35


def budget_status(consumed: Column) -> Column:
    return (
        F.when(consumed >= 1.0, "EXHAUSTED").when(consumed >= 0.9, "RED").when(consumed >= 0.5, "YELLOW").otherwise("GREEN")
    )


def _burn(value: Column, o: Objectives) -> dict[str, tuple[Column, Column, float]]:
    """Objective -> (compliant, consumed budget, target); the burn rule differs per objective."""
    def cap(c: Column) -> Column:
        return F.least(F.lit(1.0), c)

    approval_ok = value.between(o.min_approval, o.max_approval)
    return {
        "p99_latency": (
            value <= o.p99_ms,
            F.when(value <= o.p99_ms, 0.0).otherwise(cap((value - o.p99_ms) / o.p99_ms)), o.p99_ms),
        "error_rate": (
            value <= o.max_error_rate,
            F.when(value <= o.max_error_rate, value / max(o.max_error_rate, 1e-9)).otherwise(F.lit(1.0)), o.max_error_rate),
        "model_auc": (value >= o.min_auc, cap(F.greatest(F.lit(0.0), o.min_auc - value) / max(o.min_auc, 1e-9)), o.min_auc),
        "feature_freshness": (
            value <= o.max_freshness_hours,
            F.when(value <= o.max_freshness_hours, 0.0).otherwise(F.lit(1.0)), o.max_freshness_hours),
        "approval_rate": (
            approval_ok,
            F.when(approval_ok, 0.0).when(value < o.min_approval, cap((o.min_approval - value) / o.min_approval))
            .otherwise(cap((value - o.max_approval) / (1.0 - o.max_approval + 1e-9))), o.min_approval),
        "default_rate": (
            value <= o.max_default_rate,
            F.when(value <= o.max_default_rate, 0.0).otherwise(F.lit(1.0)), o.max_default_rate),
    }


OBJECTIVES = ("p99_latency", "error_rate", "model_auc", "feature_freshness", "approval_rate", "default_rate")


def slo_report(metrics: DataFrame, groups: Sequence[str] = (), objectives: Objectives = Objectives()) -> DataFrame:
    """Wide metric rows (one per window) to one row per objective with its budget.

    Metrics that are absent or null are not judged.
    """
    names = [n for n in OBJECTIVES if n in metrics.columns]
    long = metrics.select(*groups, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        list(groups), names, "slo", "value"
    ).where(F.col("value").isNotNull())
    rules = _burn(F.col("value"), objectives)

    def pick(i: int) -> Column:
        out = F.lit(None)
        for n in names:
            part = rules[n][i]
            out = F.when(F.col("slo") == n, part if isinstance(part, Column) else F.lit(part)).otherwise(out)
        return out

    out = long.withColumns({"compliant": pick(0), "consumed": pick(1), "target": pick(2)})
    out = out.withColumn("status", budget_status(F.col("consumed")))
    return out.withColumn("blocks_gate", F.col("status").isin("RED", "EXHAUSTED"))


# --- metrics and panels -------------------------------------------------------

def service_metrics(df: DataFrame, latency: str, is_error: Column, prefix: str = "mlops") -> DataFrame:
    """Counters, mean latency and the cumulative histogram as (name, le, value)."""
    v = F.col(latency)
    facts = {
        "prediction_requests_total": F.count("*"), "prediction_errors_total": F.count_if(is_error),
        "prediction_latency_ms_avg": F.coalesce(F.avg(v), F.lit(0.0)),
        "prediction_latency_ms_sum": F.coalesce(F.sum(v), F.lit(0.0)), "prediction_latency_ms_count": F.count(v),
    }
    buckets = {str(b): F.count_if(v <= b) for b in LATENCY_BUCKETS}
    buckets["+Inf"] = F.count(v)
    wide = df.agg(
        *[c.cast("double").alias(n) for n, c in facts.items()], *[c.cast("double").alias(f"le_{b}") for b, c in buckets.items()]
    )
    rows = [F.struct(F.lit(f"{prefix}_{n}").alias("name"), F.lit("").alias("le"), F.col(n).alias("value")) for n in facts]
    rows += [
        F.struct(F.lit(f"{prefix}_prediction_latency_ms_bucket").alias("name"), F.lit(b).alias("le"), F.col(f"`le_{b}`").alias("value"))
        for b in buckets
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def gauges(named: dict[str, DataFrame], prefix: str = "mlops") -> DataFrame:
    """Gauge tables (label, value) under their metric names, e.g. drift score or freshness."""
    out = None
    for name, df in named.items():
        label, value = df.columns
        part = df.select(F.lit(f"{prefix}_{name}").alias("name"), F.col(label).cast("string").alias("le"), F.col(value).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def bucket_quantile(counts: Sequence[Column], q: float, bounds: Sequence[float] = LATENCY_BUCKETS) -> Column:
    """Quantile interpolated inside its histogram bucket.

    ``counts`` are cumulative, the last one for all values; beyond the highest
    finite bound that bound is returned.
    """
    total = counts[-1]
    rank = total * F.lit(q)
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, below = (0.0, F.lit(0)) if i == 0 else (float(bounds[i - 1]), counts[i - 1])
        inside = F.lit(low) + (bounds[i] - low) * F.try_divide(rank - below, counts[i] - below)
        out = F.when(counts[i] >= rank, inside).otherwise(out)
    return F.when(total > 0, out)


def panels(df: DataFrame, ts: str, latency: str, is_error: Column, minutes: int = 60) -> DataFrame:
    """Request rate, error ratio and interpolated p50/p99 per time window."""
    v = F.col(latency)
    out = df.groupBy(F.window(ts, f"{minutes} minutes").alias("w")).agg(
        F.count("*").alias("n"), F.count_if(is_error).alias("n_errors"),
        *[F.count_if(v <= b).alias(f"b{b}") for b in LATENCY_BUCKETS], F.count(v).alias("all"),
    )
    counts = [F.col(f"b{b}") for b in LATENCY_BUCKETS] + [F.col("all")]
    return out.select(
        F.col("w.start").alias("window_start"), "n", (F.col("n") / (minutes * 60)).alias("request_rate"),
        (F.col("n_errors") / F.col("n")).alias("error_ratio"),
        bucket_quantile(counts, 0.5).alias("p50"), bucket_quantile(counts, 0.99).alias("p99"),
    )


# Channel per kind of monitor.
ALERT_CHANNELS = {"operational": "#oncall-infra", "ml": "#ml-alerts", "business": "#business-risk"}


def alert_rollup(results: Sequence[DataFrame]) -> DataFrame:
    """Check results (name, kind, passed, value, threshold, severity) with their alert routing."""
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    channel = F.lit(None).cast("string")
    for kind, name in ALERT_CHANNELS.items():
        channel = F.when(F.col("kind") == kind, name).otherwise(channel)
    failed = ~F.col("passed")
    return out.withColumns({
        "channel": channel, "should_alert": failed & (F.col("severity") != "info"),
        "blocks_gate": failed & (F.col("severity") == "critical"),
    })


# --- cost, traces, quotas -----------------------------------------------------

def token_cost(
    df: DataFrame, prices: DataFrame, groups: Sequence[str], model: str = "model",
    prompt: str = "prompt_tokens", completion: str = "completion_tokens",
) -> DataFrame:
    """Tokens and cost per group from a price table with one row per model."""
    priced = df.join(prices, model)  # a small price table is broadcast by its size
    cost = F.col(prompt) / 1000.0 * F.col("price_prompt") + F.col(completion) / 1000.0 * F.col("price_completion")
    return priced.groupBy(*groups).agg(
        F.count("*").alias("n_requests"), F.sum(prompt).alias("prompt_tokens"),
        F.sum(completion).alias("completion_tokens"), F.sum(cost).alias("cost_usd"),
    )


def eval_economics(requests: Column, rate: float, unit_cost: float) -> dict[str, Column]:
    """Cost of judging a sample of the traffic against judging all of it."""
    n = F.floor(requests * F.lit(rate)).cast("long")
    return {
        "eval_count": n, "sampled_cost": n * F.lit(unit_cost), "full_cost": requests * F.lit(unit_cost),
        "savings": requests * F.lit(unit_cost) - n * F.lit(unit_cost),
    }


def trace_rollup(spans: DataFrame) -> DataFrame:
    """Per trace: duration of the root spans, tokens of the model calls, span count."""
    root = F.col("parent_span_id").isNull() | (F.col("parent_span_id") == "")
    call = F.col("kind") == "llm_call"
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("n_spans"),
        F.coalesce(F.sum(F.when(root, F.col("duration_ms"))), F.lit(0.0)).alias("duration_ms"),
        F.coalesce(F.sum(F.when(call, F.col("prompt_tokens") + F.col("completion_tokens"))), F.lit(0)).alias("tokens"),
    )


def quota_usage(df: DataFrame, key: str, ts: str, tokens: str, max_requests: int, max_tokens: int) -> DataFrame:
    """Requests and tokens per key and day; over only when strictly above a limit."""
    out = df.groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"))
    over = (F.col("requests") > max_requests) | (F.col("tokens") > max_tokens)
    return out.withColumn("over_quota", over)


def budget_alerts(
    df: DataFrame, ts: str, spend: str, daily_budget: float, ties: Sequence[str] = (), thresholds: Sequence[float] = (0.5, 0.8, 1.0)
) -> DataFrame:
    """When the running spend of each day first reaches each share of the budget.

    Spend adds up as decimals, so the running total does not depend on the
    order in which chunks are combined.
    """
    rows = df.withColumns({"_day": F.to_date(ts), "_amount": F.col(spend).cast("decimal(20,6)")})
    run = running_totals(rows, ts, ["_day"], {"_spent": F.col("_amount")}, ties)
    use = F.col("_spent").cast("double") / daily_budget
    hit = [F.min(F.when(use >= t, F.col(ts))).alias(f"reached_{int(t * 100)}") for t in thresholds]
    out = run.groupBy(F.col("_day").alias("day")).agg(F.max("_spent").cast("double").alias("spent"), *hit)
    return out.withColumns({
        "utilization": F.col("spent") / daily_budget, "over_budget": F.col("spent") / daily_budget > 1.0,
    })


def quality_drift(
    df: DataFrame, score: str, ts: str, key: str, groups: Sequence[str], n: int = 100,
    threshold: float = 0.10, alert_threshold: float = 0.15,
) -> DataFrame:
    """Mean of the newest ``n`` scores against the mean of all earlier ones."""
    at = F.struct(F.col(ts), F.col(key))
    keyed = df.withColumn("_at", at)
    cut = order_values(
        keyed.select(*groups, "_at"), "_at", {"_cut": lambda c: F.greatest(c - n, F.lit(0))}, groups
    ).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_cut")
    recent = F.col("_at") >= F.col("_cut")
    out = keyed.join(cut, same_group(groups)).groupBy(*groups).agg(
        F.avg(F.when(~recent, F.col(score))).alias("historical_mean"), F.avg(F.when(recent, F.col(score))).alias("recent_mean")
    )
    drop = F.try_divide(F.col("historical_mean") - F.col("recent_mean"), F.col("historical_mean"))
    out = out.withColumn("drift", drop)
    return out.withColumns({
        "has_drifted": F.coalesce(F.col("drift") > threshold, F.lit(False)),
        "alerting": F.coalesce((F.col("drift") > threshold) & (F.col("drift") > alert_threshold), F.lit(False)),
    })


# --- sampling and routing -----------------------------------------------------

def eval_sampled(index: Column, strategy: str, rate: float = 0.05, nth: int = 20) -> Column:
    """Whether a request is judged online: every nth, or a share by hash bucket.

    An integer index is its own hash; a string key uses the MD5 bucket.
    """
    if strategy == "every_nth":
        return F.pmod(index, F.lit(nth)) == 0
    if strategy not in ("fixed_rate", "adaptive"):
        raise ValueError("strategy must be every_nth, fixed_rate or adaptive")
    return F.pmod(index, F.lit(100)) < rate * 100


def ab_variant(request_id: Column, split_b: float = 0.5) -> Column:
    """Variant of a request by a reproducible hash bucket."""
    return F.when(md5_bucket(request_id) < split_b * 100, "B").otherwise("A")


def route_by_ceiling(df: DataFrame, score: str, routes: Sequence[tuple[str, float]]) -> DataFrame:
    """Cheapest route whose ceiling covers the score; null marks "no route"."""
    out = F.lit(None).cast("string")
    for name, ceiling in sorted(routes, key=lambda r: r[1], reverse=True):
        out = F.when(F.col(score) <= ceiling, name).otherwise(out)
    return df.withColumn("route", out)
