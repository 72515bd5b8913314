"""Batch twins of the streaming jobs, and streaming runs over files of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.service import LATENCY_BUCKETS

from tidemark.plans.registry import Tables, query
from tidemark.session import scratch_dir
from tidemark.streaming import limits, push, windows


def event_stream(t: Tables, *columns: str):
    """The events table, one file or a folder of them, as a file stream with UTC event time."""
    path = f"{t.sf_dir}/events.parquet"
    # a stream takes a folder, or a pattern that may match one file
    rows = t.spark.readStream.schema(t.spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(path[:-1] + "[t]")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select(*columns) if columns else rows


#: Events arrive eleven days at a time; every 20th comes three arrivals late.
_PART = "(day(ts) - 1) // 11 + CASE WHEN event_id % 20 = 0 THEN 3 ELSE 0 END"


def arriving(t: Tables):
    """The events as a file stream, and functions that each let the next part of them arrive."""
    part = F.floor((F.dayofmonth("ts") - 1) / 11) + F.when(F.col("event_id") % 20 == 0, 3).otherwise(0)
    folder, rows = scratch_dir(t.spark, "arriving"), t.events.withColumn("part", part.cast("int"))

    def arrive(k: int):
        return lambda: rows.where(F.col("part") == k).drop("part").write.mode("append").parquet(folder)

    arrive(0)()  # the source looks for its folder when it is made
    return t.spark.readStream.schema(t.events.schema).parquet(folder), [lambda: None, *[arrive(k) for k in range(1, 6)]]


def sources(t: Tables):
    """Known push sources; purchases are not one of them."""
    return t.events.where("event_type <> 'purchase'").select(F.col("event_type").alias("source_name")).distinct()


def push_events(rows):
    """Events with the feature payload of the push schema; some are broken."""
    k = F.get_json_object("props", "$.k")
    amount = F.when(F.col("event_type") == "error", '"bad"').otherwise(F.col("value").cast("string"))
    text = F.concat(
        F.lit('{"tx_count_last_hour": '), k, F.lit(', "last_tx_amount": '), amount,
        F.when(F.col("event_type") == "click", F.concat(F.lit(', "session_duration_s": '), k, F.lit(".5"))).otherwise(""), F.lit("}"),
    )
    return rows.select("event_id", "user_id", "ts", F.col("event_type").alias("source_name"), text.alias("payload"))


@query(
    "r1_push_ingest",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'type:last_tx_amount:string' ELSE '' END AS errors
       FROM events WHERE event_type = 'error'""",
)
def push_ingest(t: Tables):
    """A streaming run over the events file; the result is the quarantine table."""
    base = scratch_dir(t.spark, "push")
    run = push.start_push_ingest(
        push_events(event_stream(t)), sources(t), f"{base}/log", f"{base}/bad", f"{base}/checkpoint", "user_id", "ts", "event_id"
    )
    run.awaitTermination()
    rejected = t.spark.read.schema("event_id long, errors array<string>").parquet(f"{base}/bad")
    return rejected.select("event_id", F.array_join("errors", ";").alias("errors"))


@query(
    "r2_push_latest_upsert",
    """WITH g AS (SELECT * FROM events WHERE event_type NOT IN ('purchase', 'error')),
       n AS (SELECT user_id, arg_max(event_id, ts) AS event_id FROM g GROUP BY 1),
       l AS (SELECT g.user_id, g.ts, json_extract(props, '$.k')::double AS k, value, event_type FROM g JOIN n USING (event_id))
       SELECT user_id, 'tx_count_last_hour' AS feature, k AS value, epoch_us(ts) AS ts_us, epoch_us(ts) + 3600000000 AS expire_us FROM l UNION ALL
       SELECT user_id, 'last_tx_amount', value, epoch_us(ts), epoch_us(ts) + 3600000000 FROM l UNION ALL
       SELECT user_id, 'session_duration_s', k + 0.5, epoch_us(ts), epoch_us(ts) + 3600000000 FROM l WHERE event_type = 'click'""",
)
def push_latest(t: Tables):
    """One flush over all good events: the newest event of each key names its features."""
    good, _ = push.split_valid(push.with_errors(push.route(push_events(t.spread("events")), sources(t))))
    deltas = push.delta_rows(push.newest_per_key(good, "user_id", "ts", "event_id"), "user_id", "ts").withColumn("batch_id", F.lit(0))
    out = push.fold_deltas(deltas, "user_id")
    return out.select("user_id", "feature", "value", F.unix_micros("ts").alias("ts_us"), F.unix_micros("expire_at").alias("expire_us"))


@query(
    "r2_push_latest_stream",
    f"""WITH g AS (SELECT *, {_PART} AS part FROM events WHERE event_type NOT IN ('purchase', 'error')),
       n AS (SELECT part, user_id, arg_max(event_id, (ts, -event_id)) AS event_id FROM g GROUP BY 1, 2),
       l AS (SELECT g.user_id, g.ts, g.part, json_extract(props, '$.k')::double AS k, value, event_type FROM g JOIN n USING (event_id)),
       f AS (SELECT user_id, ts, part, 'tx_count_last_hour' AS feature, k AS value FROM l UNION ALL SELECT user_id, ts, part, 'last_tx_amount', value FROM l
             UNION ALL SELECT user_id, ts, part, 'session_duration_s', k + 0.5 FROM l WHERE event_type = 'click')
       SELECT user_id, feature, arg_max(value, (ts, part)) AS value, epoch_us(max(ts)) AS ts_us FROM f GROUP BY 1, 2""",
)
def push_latest_stream(t: Tables):
    """A streaming run over six arrivals: each micro-batch is merged into the latest table; older events that come late overwrite nothing newer."""
    root = scratch_dir(t.spark, "latest")
    stream, parts = arriving(t)
    for arrive in parts:
        arrive()
        push.start_latest_merge(push_events(stream), root, f"{root}-checkpoint", "user_id", "ts", "event_id", sources(t), buckets=8).awaitTermination()
    return push.read_latest(t.spark, root, "user_id").select("user_id", "feature", "value", F.unix_micros("ts").alias("ts_us"))


@query(
    "r3_stream_routing",
    """SELECT event_type AS source_name, count(*)::bigint AS n, event_type <> 'purchase' AS known FROM events GROUP BY 1""",
)
def stream_routing(t: Tables):
    return push.routing_counts(push_events(t.spread("events")), sources(t))


@query(
    "r4_hourly_feature_windows",
    """WITH w AS (SELECT user_id, ts, value, unnest(generate_series(0, 11)) AS i, time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM events),
       s AS (SELECT user_id, ts, value, b - i * INTERVAL 5 MINUTE AS start FROM w)
       SELECT user_id, epoch_us(start) AS start_us, count(*)::bigint AS tx_count_last_hour, arg_max(value, ts) AS last_tx_amount FROM s GROUP BY 1, 2""",
)
def hourly_windows(t: Tables):
    out = windows.hourly_features(t.events, "ts", "user_id", "value", ties=["event_id"])
    return out.select("user_id", F.unix_micros("window_start").alias("start_us"), "tx_count_last_hour", "last_tx_amount")


_ON_TIME = """w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS closed FROM events WHERE event_id % 20 <> 0)"""


@query(
    "r4_hourly_windows_stream",
    f"""WITH {_ON_TIME}, b AS (SELECT event_id, user_id, ts, value, unnest(generate_series(0, 11)) AS i, time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM events),
       s AS (SELECT event_id, user_id, ts, value, b - i * INTERVAL 5 MINUTE AS start FROM b)
       SELECT user_id, epoch_us(start) AS start_us, count(*)::bigint AS tx_count_last_hour, arg_max(value, (ts, event_id)) AS last_tx_amount
       FROM s, w WHERE event_id % 20 <> 0 OR start + INTERVAL 1 HOUR > closed GROUP BY 1, 2""",
)
def hourly_windows_stream(t: Tables):
    """A streaming run over six arrivals; events that come three arrivals late find their windows closed by the watermark and are dropped."""
    stream, parts = arriving(t)
    out = windows.hourly_features(stream, "ts", "user_id", "value", ties=["event_id"], updates=True)
    last = windows.run_updates(out, scratch_dir(t.spark, "hourly-windows"), ["user_id", "window_start"], parts)
    return last.select("user_id", F.unix_micros("window_start").alias("start_us"), "tx_count_last_hour", "last_tx_amount")


@query(
    "r5_sliding_rate_limit",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
       s AS (SELECT user_id, event_id, n, true AS allowed, [us] AS accepted FROM e WHERE n = 1 UNION ALL
             SELECT user_id, event_id, n, len(kept) < 2, CASE WHEN len(kept) < 2 THEN list_append(kept, us) ELSE kept END FROM (
               SELECT e.user_id, e.event_id, e.n, e.us, list_filter(s.accepted, lambda x: x > e.us - 86400000000) AS kept
               FROM e JOIN s ON e.user_id = s.user_id AND e.n = s.n + 1))
       SELECT user_id AS client, event_id AS key, allowed, 2 - len(accepted) AS remaining FROM s""",
)
def rate_limit(t: Tables):
    """Each decision depends on the accepted requests before it."""
    return limits.rate_limit(t.events, "user_id", "ts", "event_id", max_requests=2, window_seconds=24 * 3600.0)


@query(
    "r6_online_ttl_state",
    """WITH l AS (SELECT user_id, arg_max(value, ts) AS value, arg_max(event_type IN ('click', 'view'), ts) AS pushed, max(ts) AS m FROM events GROUP BY 1)
       SELECT user_id, value, pushed, epoch_us(m) AS written_us, epoch_us(m) + CASE WHEN pushed THEN 3600000000 ELSE 86400000000 END AS expire_us FROM l""",
)
def ttl_state(t: Tables):
    rows = t.events.withColumn("is_push", F.col("event_type").isin("click", "view"))
    out = limits.expiring_table(rows, "user_id", "value", "ts", "is_push", ["event_id"])
    return out.select("user_id", "value", "pushed", F.unix_micros("written_at").alias("written_us"), F.unix_micros("expire_at").alias("expire_us"))


@query(
    "r6_ttl_state_stream",
    f"""WITH {_ON_TIME}, e AS (SELECT user_id, ts, event_id, value, event_type IN ('click', 'view') AS pushed FROM events, w WHERE event_id % 20 <> 0 OR ts > closed),
        l AS (SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(pushed, (ts, event_id)) AS pushed, epoch_us(max(ts)) AS us FROM e GROUP BY 1),
        x AS (SELECT *, us + CASE WHEN pushed THEN 3600000000 ELSE 86400000000 END AS expire_us FROM l)
        SELECT user_id, value, us AS written_us, expire_us, expire_us <= (SELECT epoch_us(max(ts)) - 600000000 FROM events) AS expired FROM x""",
)
def ttl_state_stream(t: Tables):
    """A streaming run over six arrivals with one value and one timer per key; late events are dropped, old values expire with the watermark."""
    stream, parts = arriving(t)
    given = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(given, None)
    t.spark.conf.set(given, limits.ROCKSDB)
    try:
        rows = stream.withColumn("is_push", F.col("event_type").isin("click", "view"))
        out = limits.stream_expiring_table(rows, "user_id", "value", "ts", "is_push", "event_id")
        last = windows.run_updates(out, scratch_dir(t.spark, "expiring"), ["key"], parts, ties=["us", "expired"])
    finally:
        t.spark.conf.set(given, before) if before else t.spark.conf.unset(given)
    return last.select(F.col("key").alias("user_id"), "value", F.col("us").alias("written_us"), "expire_us", "expired")


@query(
    "r7_streaming_service_metrics",
    "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, count(*)::bigint AS n, count_if(event_type = 'error')::bigint AS n_errors, "
    "round(count_if(event_type = 'error') / count(*), 9) AS error_ratio, round(avg(value), 6) AS latency_mean, "
    + ", ".join(f"count_if(value <= {b})::bigint AS le_{b}" for b in LATENCY_BUCKETS) + " FROM events GROUP BY 1",
)
def service_windows(t: Tables):
    out = windows.service_windows(t.events, "ts", "value", F.col("event_type") == "error")
    return out.select(
        F.unix_micros("window_start").alias("start_us"), "n", "n_errors", F.round("error_ratio", 9).alias("error_ratio"),
        F.round("latency_mean", 6).alias("latency_mean"), *[f"le_{b}" for b in LATENCY_BUCKETS],
    )


@query(
    "r7_service_metrics_stream",
    f"""WITH {_ON_TIME} SELECT epoch_us(date_trunc('hour', ts)) AS start_us, count(*)::bigint AS n, count_if(event_type = 'error')::bigint AS n_errors,
        round(avg(value), 6) AS latency_mean, quantile_disc(value, 0.5) AS latency_p50, quantile_disc(value, 0.95) AS latency_p95, quantile_disc(value, 0.99) AS latency_p99
        FROM events, w WHERE event_id % 20 <> 0 OR date_trunc('hour', ts) + INTERVAL 1 HOUR > closed GROUP BY 1""",
)
def service_windows_stream(t: Tables):
    """A streaming run over six arrivals with a quantile sketch as state of each window; late events are dropped."""
    stream, parts = arriving(t)
    out = windows.service_windows(stream, "ts", "value", F.col("event_type") == "error")
    last = windows.run_updates(out, scratch_dir(t.spark, "service-windows"), ["window_start"], parts)
    return last.select(F.unix_micros("window_start").alias("start_us"), "n", "n_errors", F.round("latency_mean", 6).alias("latency_mean"), *windows.LATENCY_QUANTILES)


@query(
    "r7_push_health",
    """SELECT epoch_us(date_trunc('hour', ts)) AS start_us, max(value * 2) AS max_lag_ms, round(avg((event_type = 'error')::int), 9) AS drop_rate,
       max(value * 2) > 500 AS lag_alert, avg((event_type = 'error')::int) > 0.001 AS drop_alert FROM events GROUP BY 1""",
)
def push_health(t: Tables):
    """Lag played by the value: twice as many milliseconds."""
    rows = t.events.withColumn("received", F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 2000).cast("long")))
    out = windows.push_health(rows, "ts", "received", F.col("event_type") == "error")
    return out.select(
        F.unix_micros("window_start").alias("start_us"), "max_lag_ms", F.round("drop_rate", 9).alias("drop_rate"), "lag_alert", "drop_alert"
    )
