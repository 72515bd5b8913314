"""Service, cost and routing queries on events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import drift as dr
from tidemark.operators import profile as pf
from tidemark.operators import service as sv
from tidemark.plans.drift import FEATURES, LONG_SQL, PSI_SQL
from tidemark.plans.quality import periods
from tidemark.plans.registry import Tables, query

_Q = ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in sv.LATENCY_QUANTILES.items())


@query(
    "a35_latency_summary",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i FROM events)
        SELECT event_type, count(*)::bigint AS n, round(avg(value), 6) AS mean, {_Q},
               quantile_cont(value, 0.95) <= 160 AS p95_ok, quantile_cont(value, 0.99) <= 500 AS p99_ok
        FROM r WHERE i <= 1000 GROUP BY 1""",
)
def latency_summary(t: Tables):
    recent = sv.last_n_rows(t.events, 1000, "ts", "event_id", ["event_type"])
    out = sv.latency_summary(recent, "value", ["event_type"])
    out = sv.sla_check(out, F.lit(0.0), sv.LatencyLimits(160, 500))
    return out.select(
        "event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", *sv.LATENCY_QUANTILES)], "p95_ok", "p99_ok"
    )


@query(
    "a36_slo_report",
    """
    WITH d AS (SELECT ts::date AS day, quantile_cont(value, 0.99) AS p99_latency, avg((event_type = 'error')::int) * 0.05 AS error_rate,
                 avg((value < 60)::int) AS approval_rate, avg((value > 100)::int) * 2 AS default_rate,
                 hour(max(ts)) + 3 AS feature_freshness, 0.7 + day(ts::date) / 1000 AS model_auc FROM events GROUP BY 1),
    l AS (SELECT day, 'p99_latency' AS slo, p99_latency AS value FROM d UNION ALL SELECT day, 'error_rate', error_rate FROM d UNION ALL
          SELECT day, 'approval_rate', approval_rate FROM d UNION ALL SELECT day, 'default_rate', default_rate FROM d UNION ALL
          SELECT day, 'feature_freshness', feature_freshness FROM d UNION ALL SELECT day, 'model_auc', model_auc FROM d),
    c AS (SELECT *, CASE slo WHEN 'p99_latency' THEN value <= 200 WHEN 'error_rate' THEN value <= 0.01 WHEN 'model_auc' THEN value >= 0.72
               WHEN 'feature_freshness' THEN value <= 26 WHEN 'approval_rate' THEN value BETWEEN 0.6 AND 0.8 ELSE value <= 0.35 END AS ok FROM l),
    b AS (SELECT *, CASE WHEN slo = 'error_rate' THEN CASE WHEN ok THEN value / 0.01 ELSE 1.0 END
               WHEN slo = 'model_auc' THEN greatest(0, 0.72 - value) / 0.72 WHEN ok THEN 0.0
               WHEN slo = 'p99_latency' THEN least(1.0, (value - 200) / 200)
               WHEN slo = 'approval_rate' THEN CASE WHEN value < 0.6 THEN (0.6 - value) / 0.6 ELSE least(1.0, (value - 0.8) / (0.2 + 1e-9)) END
               ELSE 1.0 END AS consumed FROM c)
    SELECT day::varchar AS day, slo, round(value, 9) AS value, ok AS compliant, round(consumed, 9)::double AS consumed,
           CASE WHEN consumed >= 1 THEN 'EXHAUSTED' WHEN consumed >= 0.9 THEN 'RED' WHEN consumed >= 0.5 THEN 'YELLOW' ELSE 'GREEN' END AS status
    FROM b
    """,
)
def slo_report(t: Tables):
    rows = t.events.withColumn("day", F.to_date("ts"))
    daily = rows.groupBy("day").agg(
        (F.avg((F.col("event_type") == "error").cast("int")) * 0.05).alias("error_rate"),
        F.avg((F.col("value") < 60).cast("int")).alias("approval_rate"),
        (F.avg((F.col("value") > 100).cast("int")) * 2).alias("default_rate"),
        (F.hour(F.max("ts")) + 3).alias("feature_freshness"),
    ).withColumn("model_auc", F.lit(0.7) + F.dayofmonth("day") / 1000)
    p99 = sv.latency_summary(rows, "value", ["day"]).select("day", F.col("p99").alias("p99_latency"))
    out = sv.slo_report(daily.join(p99, "day"), ["day"], sv.Objectives(p99_ms=200.0))
    return out.select(
        F.col("day").cast("string").alias("day"), "slo", F.round("value", 9).alias("value"), "compliant",
        F.round("consumed", 9).alias("consumed"), "status",
    )


_BUCKETS = " UNION ALL ".join(
    f"SELECT 'mlops_prediction_latency_ms_bucket' AS name, '{b}' AS le, count_if(value <= {b})::double AS value FROM events"
    for b in sv.LATENCY_BUCKETS
)


@query(
    "a37_service_metrics",
    f"""
    WITH {LONG_SQL}, {PSI_SQL}, m AS (
      SELECT 'mlops_prediction_requests_total' AS name, '' AS le, count(*)::double AS value FROM events UNION ALL
      SELECT 'mlops_prediction_errors_total', '', count_if(event_type = 'error') FROM events UNION ALL
      SELECT 'mlops_prediction_latency_ms_avg', '', avg(value) FROM events UNION ALL
      SELECT 'mlops_prediction_latency_ms_sum', '', sum(value) FROM events UNION ALL
      SELECT 'mlops_prediction_latency_ms_count', '', count(value) FROM events UNION ALL
      {_BUCKETS} UNION ALL SELECT 'mlops_prediction_latency_ms_bucket', '+Inf', count(value) FROM events UNION ALL
      SELECT 'mlops_drift_score', feature, psi FROM psi)
    SELECT name, le, round(value, 4) AS value FROM m
    """,
)
def service_metrics(t: Tables):
    base = sv.service_metrics(t.events, "value", F.col("event_type") == "error")
    a, b = periods(t)
    drift = dr.psi_joint(dr.pair(a, b, FEATURES))
    out = base.unionByName(sv.gauges({"drift_score": drift}))
    return out.withColumn("value", F.round("value", 4))


def _bucket_sql(q: float) -> str:
    out = "CASE WHEN total = 0 THEN NULL"
    bounds = sv.LATENCY_BUCKETS
    for i, b in enumerate(bounds):
        low, below = (0, "0") if i == 0 else (bounds[i - 1], f"b{bounds[i - 1]}")
        out += f" WHEN b{b} >= total * {q}::double THEN {low} + ({b} - {low}) * ((total * {q}::double - {below}) / (b{b} - {below}))"
    return out + f" ELSE {bounds[-1]} END"


@query(
    "a38_rate_and_quantile_panels",
    f"""
    WITH w AS (SELECT date_trunc('hour', ts) AS w, count(*)::bigint AS n, count_if(event_type = 'error') AS e, count(value) AS total,
               {", ".join(f"count_if(value <= {b}) AS b{b}" for b in sv.LATENCY_BUCKETS)} FROM events GROUP BY 1)
    SELECT epoch_us(w) AS window_us, n, round(n / 3600, 9) AS request_rate, round(e / n, 9) AS error_ratio,
           round({_bucket_sql(0.5)}, 6)::double AS p50, round({_bucket_sql(0.99)}, 6)::double AS p99 FROM w
    """,
)
def panels(t: Tables):
    out = sv.panels(t.events, "ts", "value", F.col("event_type") == "error", 60)
    return out.select(
        F.unix_micros("window_start").alias("window_us"), "n", F.round("request_rate", 9).alias("request_rate"),
        F.round("error_ratio", 9).alias("error_ratio"), F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"),
    )


@query(
    "a39_alert_rollup",
    f"""
    WITH {LONG_SQL}, {PSI_SQL},
    r AS (SELECT feature AS name, 'ml' AS kind, psi < 0.1 AS passed, psi AS value, 0.1::double AS threshold,
                 CASE WHEN psi >= 0.2 THEN 'critical' ELSE 'warning' END AS severity FROM psi UNION ALL
          SELECT 'errors', 'operational', count_if(event_type = 'error') / count(*) <= 0.01, count_if(event_type = 'error') / count(*), 0.01, 'critical' FROM events UNION ALL
          SELECT 'toxic_' || range_name, 'business', avg(toxic) BETWEEN low AND high, avg(toxic), high, 'info' FROM labels,
            (VALUES ('profile', 0.10, 0.40::double), ('raw', 0.15, 0.30), ('contract', 0.05, 0.40)) v(range_name, low, high) GROUP BY range_name, low, high)
    SELECT name, kind, passed, round(value, 6) AS value, threshold, severity,
           CASE kind WHEN 'operational' THEN '#oncall-infra' WHEN 'ml' THEN '#ml-alerts' ELSE '#business-risk' END AS channel,
           NOT passed AND severity <> 'info' AS should_alert, NOT passed AND severity = 'critical' AS blocks_gate FROM r
    """,
)
def alert_rollup(t: Tables):
    a, b = periods(t)
    psi = F.col("psi")
    drift = dr.psi_joint(dr.pair(a, b, FEATURES)).select(
        F.col("feature").alias("name"), F.lit("ml").alias("kind"), (psi < 0.1).alias("passed"), psi.alias("value"),
        F.lit(0.1).alias("threshold"), F.when(psi >= 0.2, "critical").otherwise("warning").alias("severity"),
    )
    rate = F.avg((F.col("event_type") == "error").cast("double"))
    errors = t.events.agg(rate.alias("value")).select(
        F.lit("errors").alias("name"), F.lit("operational").alias("kind"), (F.col("value") <= 0.01).alias("passed"), "value",
        F.lit(0.01).alias("threshold"), F.lit("critical").alias("severity"),
    )
    balance = pf.class_balance(t.labels, "toxic").select(
        F.concat(F.lit("toxic_"), "range_name").alias("name"), F.lit("business").alias("kind"), "passed",
        F.col("positive_rate").alias("value"), F.col("high").alias("threshold"), F.lit("info").alias("severity"),
    )
    return sv.alert_rollup([drift, errors, balance]).withColumn("value", F.round("value", 6))


def usage(t: Tables):
    """Turns as requests: words as tokens, two models, five tenants."""
    words = F.size(F.split("text", " "))
    user = F.col("role") != "assistant"
    return t.conversations.select(
        "conv_id", "turn", "role",
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "small").otherwise("large").alias("model"),
        F.concat(F.lit("tenant"), F.pmod("conv_id", F.lit(5)).cast("string")).alias("tenant"),
        F.when(user, words).otherwise(F.lit(0)).alias("prompt_tokens"),
        F.when(user, F.lit(0)).otherwise(words).alias("completion_tokens"),
    )


USAGE_SQL = """
    u AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN 'small' ELSE 'large' END AS model, 'tenant' || (conv_id % 5) AS tenant,
                 CASE WHEN role <> 'assistant' THEN len(string_split(text, ' ')) ELSE 0 END AS prompt_tokens,
                 CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) ELSE 0 END AS completion_tokens FROM conversations)
"""


@query(
    "a40_token_cost",
    f"""WITH {USAGE_SQL}, c AS (SELECT model, tenant, count(*)::bigint AS n_requests, sum(prompt_tokens)::bigint AS prompt_tokens,
          sum(completion_tokens)::bigint AS completion_tokens,
          sum(prompt_tokens / 1000.0 * CASE model WHEN 'small' THEN 0.5 ELSE 3.0 END
              + completion_tokens / 1000.0 * CASE model WHEN 'small' THEN 1.5 ELSE 15.0 END) AS cost_usd FROM u GROUP BY 1, 2)
        SELECT model, tenant, n_requests, prompt_tokens, completion_tokens, round(cost_usd, 6)::double AS cost_usd,
               floor(n_requests * 0.05::double)::bigint AS eval_count, round(floor(n_requests * 0.05::double) * 0.02, 6)::double AS sampled_cost,
               round(n_requests * 0.02, 6)::double AS full_cost, round((n_requests - floor(n_requests * 0.05::double)) * 0.02, 6)::double AS savings FROM c""",
)
def token_cost(t: Tables):
    prices = t.spark.createDataFrame(
        [("small", 0.5, 1.5), ("large", 3.0, 15.0)], "model string, price_prompt double, price_completion double"
    )
    out = sv.token_cost(usage(t), prices, ["model", "tenant"])
    out = out.withColumns(sv.eval_economics(F.col("n_requests"), 0.05, 0.02))
    return out.withColumns({c: F.round(c, 6) for c in ("cost_usd", "sampled_cost", "full_cost", "savings")})


def spans(t: Tables):
    u = usage(t)
    return u.select(
        F.col("conv_id").alias("trace_id"), F.concat_ws("-", "conv_id", "turn").alias("span_id"),
        F.when(F.col("turn") < 2, "").otherwise(F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1)).alias("parent_span_id"),
        F.when(F.col("role") == "assistant", "llm_call").when(F.col("role") == "user", "retrieval").otherwise("tool_call").alias("kind"),
        "prompt_tokens", "completion_tokens", ((F.col("prompt_tokens") + F.col("completion_tokens")) * 2.5).alias("duration_ms"),
    )


@query(
    "a41_trace_rollup",
    f"""WITH {USAGE_SQL} SELECT conv_id AS trace_id, count(*)::bigint AS n_spans,
        coalesce(sum((prompt_tokens + completion_tokens) * 2.5) FILTER (turn < 2), 0)::double AS duration_ms,
        coalesce(sum(prompt_tokens + completion_tokens) FILTER (role = 'assistant'), 0)::bigint AS tokens FROM u GROUP BY 1""",
)
def trace_rollup(t: Tables):
    return sv.trace_rollup(spans(t))


@query(
    "a42_quota_usage",
    """SELECT user_id, ts::date::varchar AS day, count(*)::bigint AS requests, sum(json_extract(props, '$.k')::bigint)::bigint AS tokens,
       count(*) > 4 OR sum(json_extract(props, '$.k')::bigint) > 200 AS over_quota FROM events GROUP BY 1, 2""",
)
def quota_usage(t: Tables):
    rows = t.events.withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))
    out = sv.quota_usage(rows, "user_id", "ts", "tokens", 4, 200)
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "a42_budget_alerts",
    """WITH r AS (SELECT ts::date AS day, ts, sum(value::decimal(20, 6)) OVER (PARTITION BY ts::date ORDER BY ts, event_id
         ROWS UNBOUNDED PRECEDING)::double AS spent FROM events),
       d AS (SELECT day, max(spent) AS spent, min(ts) FILTER (spent / 16000 >= 0.5) AS a, min(ts) FILTER (spent / 16000 >= 0.8) AS b,
               min(ts) FILTER (spent / 16000 >= 1.0) AS c FROM r GROUP BY 1)
       SELECT day::varchar AS day, spent, coalesce(epoch_us(a), -1) AS at_50, coalesce(epoch_us(b), -1) AS at_80,
              coalesce(epoch_us(c), -1) AS at_100, round(spent / 16000, 9) AS utilization, spent / 16000 > 1.0 AS over_budget FROM d""",
)
def budget_alerts(t: Tables):
    out = sv.budget_alerts(t.events, "ts", "value", 16000.0, ["event_id"])
    return out.select(
        F.col("day").cast("string").alias("day"), "spent",
        *[F.coalesce(F.unix_micros(f"reached_{p}"), F.lit(-1)).alias(f"at_{p}") for p in (50, 80, 100)],
        F.round("utilization", 9).alias("utilization"), "over_budget",
    )


@query(
    "a49_quality_drift",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i FROM events),
       m AS (SELECT event_type, avg(value) FILTER (i > 200) AS h, avg(value) FILTER (i <= 200) AS r FROM r GROUP BY 1)
       SELECT event_type, round(h, 6) AS historical_mean, round(r, 6) AS recent_mean, round((h - r) / h, 6) AS drift,
              coalesce((h - r) / h > 0.02, false) AS has_drifted, coalesce((h - r) / h > 0.02 AND (h - r) / h > 0.05, false) AS alerting FROM m""",
)
def quality_drift(t: Tables):
    out = sv.quality_drift(t.events, "value", "ts", "event_id", ["event_type"], 200, 0.02, 0.05)
    return out.withColumns({c: F.round(c, 6) for c in ("historical_mean", "recent_mean", "drift")})


@query(
    "p13_eval_sampler",
    """SELECT event_id, event_id % 20 = 0 AS every_nth, event_id % 100 < 5 AS fixed_rate FROM events""",
)
def eval_sampler(t: Tables):
    e = F.col("event_id")
    return t.events.select(
        "event_id", sv.eval_sampled(e, "every_nth").alias("every_nth"), sv.eval_sampled(e, "fixed_rate").alias("fixed_rate")
    )


@query(
    "p14_ab_assign",
    """WITH a AS (SELECT CASE WHEN ('0x' || substr(md5(conv_id || ':' || turn), 1, 8))::bigint % 100 < 30 THEN 'B' ELSE 'A' END AS variant,
                         length(text) AS n FROM conversations)
       SELECT variant, count(*)::bigint AS n, sum(n)::bigint AS chars FROM a GROUP BY 1""",
)
def ab_assign(t: Tables):
    key = F.concat_ws(":", "conv_id", "turn")
    rows = t.conversations.select(sv.ab_variant(key, 0.3).alias("variant"), F.length("text").alias("chars"))
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query(
    "j9_route_by_ceiling",
    """SELECT conv_id, turn, length(text) / 1000 AS complexity, CASE WHEN length(text) / 1000 <= 0.2 THEN 'cheap'
       WHEN length(text) / 1000 <= 0.6 THEN 'standard' WHEN length(text) / 1000 <= 1.0 THEN 'premium' ELSE 'none' END AS route FROM conversations""",
)
def route_by_ceiling(t: Tables):
    rows = t.conversations.select("conv_id", "turn", (F.length("text") / 1000).alias("complexity"))
    out = sv.route_by_ceiling(rows, "complexity", [("standard", 0.6), ("cheap", 0.2), ("premium", 1.0)])
    return out.withColumn("route", F.coalesce("route", F.lit("none")))
