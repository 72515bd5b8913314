"""Feature-table queries: derivation, point-in-time joins, latest values."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators.stored_features import store_view, stored_view_join
from tidemark.plans.registry import Tables, micros, query

START = datetime(2024, 1, 1)
NOW = datetime(2024, 1, 31)


def purchases(t: Tables):
    return t.events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")


def history(t: Tables, *kinds: str):
    """Events as feature rows; a value above 100 counts as unknown."""
    rows = t.events
    rows = rows.where(F.col("event_type").isin(*kinds)) if kinds else rows.where(F.col("event_type") != "purchase")
    return rows.select(
        F.col("event_id").alias("src_id"),
        "user_id",
        F.col("ts").alias("feature_ts"),
        F.when(F.col("value") <= 100, F.col("value")).alias("amount"),
        F.col("event_type").alias("kind"),
    )


_POINT_IN_TIME_SQL = """
    SELECT p.event_id, p.user_id, epoch_us(p.ts) AS ts_us,
           CASE WHEN h.value <= 100 THEN h.value END AS amount, h.event_type AS kind, coalesce(h.event_id, -1) AS src_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') h
      ON p.user_id = h.user_id AND p.ts >= h.ts
    """


@query("j1_point_in_time_join", _POINT_IN_TIME_SQL)
def point_in_time(t: Tables):
    out = ft.point_in_time_join(
        purchases(t), history(t), "user_id", ["amount", "kind", "src_id"], "ts", "feature_ts", ties=["src_id"]
    )
    return out.select("event_id", "user_id", micros("ts").alias("ts_us"), "amount", "kind",
                      F.coalesce("src_id", F.lit(-1)).alias("src_id"))


@query("j1_point_in_time_stored", _POINT_IN_TIME_SQL)
def point_in_time_stored(t: Tables):
    """The same join against a stored view, whose side is not shuffled again."""
    view = store_view(history(t), "user_id", ["amount", "kind", "src_id"], "feature_ts", ["src_id"], timedelta(days=1), buckets=8)
    out = stored_view_join(purchases(t), view, "user_id", "ts")
    return out.select("event_id", "user_id", micros("ts").alias("ts_us"), "amount", "kind", F.coalesce("src_id", F.lit(-1)).alias("src_id"))


_SERVICE_SQL = """
    SELECT p.event_id, p.user_id,
           c.value AS click_value, coalesce(c.event_id, -1) AS click_id,
           CASE WHEN p.ts - v.ts <= INTERVAL 1 DAY THEN v.value END AS view_value,
           coalesce(CASE WHEN p.ts - v.ts <= INTERVAL 1 DAY THEN v.event_id END, -1) AS view_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
      ON p.user_id = c.user_id AND p.ts >= c.ts
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
      ON p.user_id = v.user_id AND p.ts >= v.ts
"""


@query("j2_feature_service_stored", _SERVICE_SQL)
def feature_service_stored(t: Tables):
    """Two stored views joined in turn."""
    out = purchases(t)
    for kind, max_age in (("click", None), ("view", timedelta(days=1))):
        rows = t.events.where(F.col("event_type") == kind).select(
            "user_id", F.col("ts").alias("feature_ts"), F.col("value").alias(f"{kind}_value"), F.col("event_id").alias(f"{kind}_id"))
        view = store_view(rows, "user_id", [f"{kind}_value", f"{kind}_id"], "feature_ts", [f"{kind}_id"], timedelta(days=1), buckets=8)
        out = stored_view_join(out, view, "user_id", "ts", max_age)
    return out.select("event_id", "user_id", "click_value", F.coalesce("click_id", F.lit(-1)).alias("click_id"),
                      "view_value", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


@query("j2_feature_service_join", _SERVICE_SQL)
def feature_service(t: Tables):
    def view(kind: str, max_age=None):
        rows = t.events.where(F.col("event_type") == kind).select(
            "user_id", F.col("ts").alias("feature_ts"),
            F.col("value").alias(f"{kind}_value"), F.col("event_id").alias(f"{kind}_id"),
        )
        return ft.View(rows, [f"{kind}_value", f"{kind}_id"], "feature_ts", [f"{kind}_id"], max_age)

    out = ft.feature_views_join(
        purchases(t), [view("click"), view("view", timedelta(days=1))], "user_id", "ts"
    )
    return out.select("event_id", "user_id", "click_value", "view_value",
                      *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("click_id", "view_id")])


@query(
    "w1_latest_value_table",
    """
    SELECT user_id, arg_max(CASE WHEN value <= 100 THEN value END, ts) AS amount,
           arg_max(event_type, ts) AS kind, count(*)::bigint AS n_rows,
           epoch_us(max(ts)) AS last_us, epoch_us(max(ts)) + 86400000000 AS expire_us
    FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31'
    GROUP BY user_id
    """,
)
def latest_value_table(t: Tables):
    rows = t.events.select(
        "user_id", "ts", "event_id", F.when(F.col("value") <= 100, F.col("value")).alias("amount"), F.col("event_type").alias("kind")
    )
    out = ft.latest_values(rows, "user_id", ["amount", "kind"], "ts", START, NOW, timedelta(days=1), ties=["event_id"])
    return out.select(
        "user_id", "amount", "kind", "n_rows", micros("last_ts").alias("last_us"), micros("expire_at").alias("expire_us")
    )


@query(
    "w2_interval_plan",
    """
    WITH b AS (SELECT event_type, date_trunc('day', min(ts)) AS since, max(ts) AS until FROM events GROUP BY event_type)
    SELECT event_type, epoch_us(s) AS start_us, epoch_us(least(s + INTERVAL 36 HOUR, until)) AS end_us
    FROM (SELECT event_type, until, unnest(generate_series(since, until, INTERVAL 36 HOUR)) AS s FROM b)
    WHERE s < until
    """,
)
def interval_plan(t: Tables):
    bounds = t.events.groupBy("event_type").agg(
        F.date_trunc("day", F.min("ts")).alias("since"), F.max("ts").alias("until")
    )
    out = ft.split_interval(bounds, "since", "until", 36)
    return out.select("event_type", micros("start").alias("start_us"), micros("end").alias("end_us"))


@query(
    "w3_incremental_backfill",
    """
    SELECT (floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000))::bigint AS interval_id, user_id,
           arg_max(CASE WHEN value <= 100 THEN value END, ts) AS amount, arg_max(event_type, ts) AS kind,
           count(*)::bigint AS n_rows, epoch_us(max(ts)) AS last_us
    FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY ALL
    """,
)
def incremental_backfill(t: Tables):
    rows = t.events.select(
        "user_id", "ts", "event_id", F.when(F.col("value") <= 100, F.col("value")).alias("amount"), F.col("event_type").alias("kind")
    )
    out = ft.incremental_backfill(rows, "user_id", ["amount", "kind"], "ts", START, 24, ties=["event_id"])
    return out.select("interval_id", "user_id", "amount", "kind", "n_rows", micros("last_ts").alias("last_us"))


@query(
    "w6_freshness_status",
    """
    WITH views AS (SELECT DISTINCT event_type AS view FROM events UNION SELECT 'absent'),
    last AS (SELECT event_type AS view, max(ts) AS m FROM events GROUP BY 1),
    aged AS (SELECT view, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(m)) / 3600000000.0 AS age_hours
             FROM views LEFT JOIN last USING (view))
    SELECT view, round(age_hours, 6)::double AS age_hours,
           CASE WHEN age_hours < 0.3 THEN 'FRESH' WHEN age_hours < 0.6 THEN 'STALE' ELSE 'MISSING' END AS status
    FROM aged
    """,
)
def freshness(t: Tables):
    expected = t.events.select(F.col("event_type").alias("view")).distinct().unionByName(
        t.spark.range(1).select(F.lit("absent").alias("view"))
    )
    rows = t.events.withColumnRenamed("event_type", "view")
    out = ft.freshness_status(rows, "view", "ts", NOW, 0.3, 2.0, expected)
    return out.select("view", F.round("age_hours", 6).alias("age_hours"), "status")


@query(
    "j5_online_lookup",
    """
    WITH last AS (SELECT user_id, arg_max(value, ts) AS value, arg_max(event_type, ts) AS kind, max(ts) AS m
                  FROM events WHERE ts <= TIMESTAMP '2024-01-29' GROUP BY 1)
    SELECT c.c_custkey AS user_id,
           CASE WHEN TIMESTAMP '2024-01-29' <= m + INTERVAL 12 HOUR THEN value END AS value,
           CASE WHEN TIMESTAMP '2024-01-29' <= m + INTERVAL 12 HOUR THEN kind END AS kind
    FROM customer c LEFT JOIN last ON c.c_custkey = last.user_id
    """,
)
def online_lookup(t: Tables):
    at = datetime(2024, 1, 29)
    rows = t.events.withColumnRenamed("event_type", "kind")
    table = ft.latest_values(rows, "user_id", ["value", "kind"], "ts", None, at, timedelta(hours=12))
    return ft.online_lookup(t.customer.select(F.col("c_custkey").alias("user_id")), table, "user_id", ["value", "kind"], at)


@query(
    "p1_clean_categories",
    """
    SELECT o_orderkey,
           CASE WHEN code IN (0, 5, 6) THEN 4 ELSE code END AS education,
           CASE WHEN status = 0 THEN 3 ELSE status END AS marriage
    FROM (SELECT o_orderkey, substr(o_orderpriority, 1, 1)::int AS code,
                 CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS status FROM orders)
    """,
)
def clean_categories(t: Tables):
    rows = t.orders.select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("education"),
        F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("marriage"),
    )
    return ft.clean_categories(rows, {"education": ft.EDUCATION_CODES, "marriage": ft.MARRIAGE_CODES})


# The raw credit columns played by lineitem: status codes from small integers
# (one of them sometimes unknown), bills from prices, payments from discounts.
def credit_rows(t: Tables):
    q, p, d, x = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return t.spread("lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ID"),
        (q * 1000).alias("LIMIT_BAL"),
        (F.col("l_linenumber") - 2).alias("PAY_0"),
        F.when(q < 40, (F.floor(d * 100) - 2)).cast("int").alias("PAY_2"),
        (F.floor(x * 100) - 1).cast("int").alias("PAY_3"),
        *[F.pmod(F.col("l_suppkey"), F.lit(k)).cast("int").alias(f"PAY_{k}") for k in (4, 5, 6)],
        *[(p * k / 4 - 9000).alias(f"BILL_AMT{k}") for k in range(1, 7)],
        *[(p * d * k / 6).alias(f"PAY_AMT{k}") for k in range(1, 7)],
    )


CREDIT_SQL = """
    SELECT l_orderkey * 8 + l_linenumber AS ID, l_quantity * 1000 AS LIMIT_BAL, l_linenumber - 2 AS PAY_0,
           CASE WHEN l_quantity < 40 THEN (floor(l_discount * 100) - 2)::int END AS PAY_2,
           (floor(l_tax * 100) - 1)::int AS PAY_3,
           (l_suppkey % 4)::int AS PAY_4, (l_suppkey % 5)::int AS PAY_5, (l_suppkey % 6)::int AS PAY_6,
           {bills}, {payments}
    FROM lineitem
""".format(
    bills=", ".join(f"l_extendedprice * {k} / 4 - 9000 AS BILL_AMT{k}" for k in range(1, 7)),
    payments=", ".join(f"l_extendedprice * l_discount * {k} / 6 AS PAY_AMT{k}" for k in range(1, 7)),
)
_DELAYS = "[PAY_0, PAY_2, PAY_3, PAY_4, PAY_5, PAY_6]"


@query(
    "p2_derive_features",
    f"""
    WITH r AS ({CREDIT_SQL})
    SELECT ID AS id, round(BILL_AMT1 / (LIMIT_BAL + 1), 6) AS utilization_rate,
           round(PAY_AMT1 / (abs(BILL_AMT1) + 1), 6) AS payment_ratio,
           list_max({_DELAYS})::double AS max_delay, round(list_avg({_DELAYS}), 6) AS avg_delay,
           len(list_filter({_DELAYS}, lambda v: v > 0))::double AS consecutive_delays,
           round((BILL_AMT1 - BILL_AMT6) / (abs(BILL_AMT6) + 1), 6) AS bill_trend,
           round(({' + '.join(f'PAY_AMT{k}' for k in range(1, 7))})
                 / ({' + '.join(f'abs(BILL_AMT{k})' for k in range(1, 7))} + 1), 6) AS total_payment_ratio
    FROM r
    """,
)
def derive_features(t: Tables):
    out = ft.derive_features(credit_rows(t))
    exact = ["max_delay", "consecutive_delays"]
    rounded = ["utilization_rate", "payment_ratio", "avg_delay", "bill_trend", "total_payment_ratio"]
    return out.select(F.col("ID").alias("id"), *exact, *[F.round(c, 6).alias(c) for c in rounded])


@query(
    "p3_on_demand_transform",
    """
    SELECT event_id, round(coalesce(u, 0) * 0.7 + (1 - coalesce(p, 0)) * 0.3, 6) AS composite_risk_score,
           coalesce(u, 0) > 0.8 AS high_utilization
    FROM (SELECT event_id, CASE WHEN value <= 100 THEN value / 100 END AS u,
                 json_extract(props, '$.k')::double / 100 AS p FROM events)
    """,
)
def on_demand(t: Tables):
    rows = t.events.select(
        "event_id",
        F.when(F.col("value") <= 100, F.col("value") / 100).alias("u"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("p"),
    )
    out = ft.on_demand(rows, ft.composite_risk(F.col("u"), F.col("p")))
    return out.select("event_id", F.round("composite_risk_score", 6).alias("composite_risk_score"), "high_utilization")
