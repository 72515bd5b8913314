"""Push features: validated ingest, routing and the latest-value log.

A stream of JSON payloads is checked, routed by source and folded into a log
of per-batch deltas; the latest-value table is a view over that log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.contracts import push_event_errors

# Schema of the transaction push source.
TX_REQUIRED = ("tx_count_last_hour", "last_tx_amount")
TX_TYPES = {"tx_count_last_hour": "int", "last_tx_amount": "float", "session_duration_s": "float"}


def with_errors(
    events: DataFrame, payload: str = "payload", required: Sequence[str] = TX_REQUIRED, types: dict[str, str] = TX_TYPES,
    key: str | None = None,
) -> DataFrame:
    """Add the validation errors of each event; an empty or missing key is an error too."""
    return push_event_errors(events, payload, required, types, key)


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and rejected events."""
    return events.where(F.size("errors") == 0), events.where(F.size("errors") > 0)


def route(events: DataFrame, sources: DataFrame, by: str = "source_name") -> DataFrame:
    """Events of known sources only; ``sources`` holds one row per source."""
    return events.join(sources.select(by), by, "left_semi")


def routing_counts(events: DataFrame, sources: DataFrame, by: str = "source_name") -> DataFrame:
    """Events per source and whether the source is known."""
    known = sources.select(by).withColumn("known", F.lit(True))
    counts = events.groupBy(by).agg(F.count("*").alias("n"))
    return counts.join(known, by, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def newest_per_key(events: DataFrame, key: str, ts: str, order: str, payload: str = "payload") -> DataFrame:
    """The newest event of each key (the first one on equal times)."""
    newest = F.max_by(F.struct(payload, ts, order), F.struct(F.col(ts), -F.col(order)))
    return events.groupBy(key).agg(newest.alias("_n")).select(key, "_n.*")


def delta_rows(newest: DataFrame, key: str, ts: str, payload: str = "payload") -> DataFrame:
    """One row per key and named feature of the newest event: ``text`` as sent, ``value`` where it is a number."""
    named = newest.select(key, F.col(ts).alias("ts"), F.explode(F.from_json(payload, "map<string,string>")).alias("feature", "text"))
    return named.withColumn("value", F.col("text").try_cast("double"))


def write_delta(events: DataFrame, batch_id: int, path: str, key: str, ts: str, order: str) -> None:
    """Fold one micro-batch into the log; a repeated batch replaces itself."""
    rows = delta_rows(newest_per_key(events, key, ts, order), key, ts).withColumn("batch_id", F.lit(batch_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def latest_features(spark: SparkSession, path: str, key: str, ttl_seconds: int = 3600) -> DataFrame:
    """Latest value per key and feature over the whole log, with its expiry.

    A feature named by an older event stays until a newer event names it.
    """
    return fold_deltas(spark.read.parquet(path), key, ttl_seconds)


def fold_deltas(deltas: DataFrame, key: str, ttl_seconds: int = 3600) -> DataFrame:
    newest = deltas.groupBy(key, "feature").agg(F.max(F.struct("ts", "batch_id", "value", "text")).alias("_n"))
    out = newest.select(key, "feature", "_n.value", "_n.text", "_n.ts")
    return out.withColumn("expire_at", F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_seconds)))


def compact(spark: SparkSession, log: str, base: str, key: str) -> None:
    """Rewrite the log as one delta per (key, feature) in a new folder."""
    latest = latest_features(spark, log, key).select(key, "ts", "feature", "value", "text").withColumn("batch_id", F.lit(-1).cast("bigint"))
    latest.write.mode("errorifexists").partitionBy("batch_id").parquet(base)


#: Buckets of keys in the latest table: a batch rewrites the buckets that it touches.
LATEST_BUCKETS = 64
LATEST = "ts timestamp, feature string, value double, text string"


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """``bucket, version`` of the newest merge; no rows before the first."""
    every = spark.read.schema("bucket int, version bigint, batch bigint").parquet(f"{root}/manifest")
    return every.where(F.col("batch") == every.agg(F.max("batch")).scalar()).select("bucket", "version")


def start_latest(spark: SparkSession, root: str) -> None:
    """An empty latest table under ``root``; batch ids of merges start at 0."""
    empty = spark.createDataFrame([], "bucket int, version bigint, batch bigint")
    empty.write.mode("ignore").parquet(f"{root}/manifest")


def read_latest(spark: SparkSession, root: str, key: str, key_type: str = "bigint") -> DataFrame:
    """The latest value of every key and feature as of the newest complete merge."""
    current = _manifest(spark, root)  # one row per bucket
    if current.isEmpty():
        return spark.createDataFrame([], f"{key} {key_type}, {LATEST}")
    data = spark.read.schema(f"{key} {key_type}, {LATEST}, version bigint, bucket int").parquet(f"{root}/data")
    return data.join(F.broadcast(current), ["version", "bucket"]).drop("version", "bucket")


def merge_latest(deltas: DataFrame, batch_id: int, root: str, key: str, buckets: int = LATEST_BUCKETS) -> bool:
    """Merge one batch of ``delta_rows`` into the latest table; False where this batch was merged before.

    The newest time wins per key and feature, the batch itself on equal times;
    features that a batch does not name stay.  Only buckets that the batch
    touches are written, as files of a new version.  One small manifest file
    then names the version of every bucket; readers follow the newest manifest,
    so they see all of a merge or nothing of it.  A merge that broke off before
    is written over, and a batch that comes again after its manifest changes
    nothing.
    """
    spark = deltas.sparkSession
    done = spark.read.schema("bucket int, version bigint, batch bigint").parquet(f"{root}/manifest").agg(F.max("batch")).first()[0]
    if done is not None and batch_id <= done:
        return False
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = deltas.select(key, "ts", "feature", "value", "text", bucket.alias("bucket"), F.lit(1).alias("_new"))
    current = _manifest(spark, root)
    if done is not None:
        data = spark.read.schema(f"{key} {dict(deltas.dtypes)[key]}, {LATEST}, version bigint, bucket int").parquet(f"{root}/data")
        touched = new.select("bucket").distinct()  # a row per bucket at most, as in the manifest
        held = data.join(F.broadcast(current.join(touched, "bucket")), ["version", "bucket"]).drop("version").withColumn("_new", F.lit(0))
        new = new.unionByName(held)
    newest = new.groupBy("bucket", key, "feature").agg(F.max_by(F.struct("ts", "value", "text"), F.struct("ts", "_new")).alias("_n"))
    rows = newest.select(key, "_n.ts", "feature", "_n.value", "_n.text", "bucket")
    # a bucket is one file, or several where it is large
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/version={batch_id}")
    written = spark.read.schema("bucket int").parquet(f"{root}/data/version={batch_id}").select("bucket").distinct()
    kept = current.join(written, "bucket", "left_anti")
    manifest = kept.unionByName(written.withColumn("version", F.lit(batch_id).cast("bigint"))).coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{root}/manifest/batch={batch_id}")
    return True


def start_latest_merge(
    stream: DataFrame, root: str, checkpoint: str, key: str, ts: str, order: str, sources: DataFrame | None = None, buckets: int = LATEST_BUCKETS,
):
    """Start a stream that merges the good events of each micro-batch into the latest table under ``root``.

    The number of buckets must stay the same for the life of a table.
    """
    start_latest(stream.sparkSession, root)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = route(batch, sources) if sources is not None else batch
        good, _ = split_valid(with_errors(rows, key=key))
        merge_latest(delta_rows(newest_per_key(good, key, ts, order), key, ts), batch_id, root, key, buckets)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_push_ingest(
    stream: DataFrame, sources: DataFrame | None, log: str, quarantine: str, checkpoint: str,
    key: str, ts: str, order: str, on_batch: Callable[[int, dict], None] | None = None,
):
    """Start the ingest: check, route, quarantine the rejects, append the delta.

    Runs until the available files are used up.  The checked batch is kept while
    both sinks read it; counts come from an observation on the way.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"push_{batch_id}")
        rows = route(batch, sources) if sources is not None else batch
        rows = with_errors(rows, key=key).observe(
            seen, F.count("*").alias("n_events"), F.count_if(F.size("errors") > 0).alias("n_dropped")
        )
        rows = rows.persist()
        good, bad = split_valid(rows)
        write_delta(good, batch_id, log, key, ts, order)
        bad.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(quarantine)
        rows.unpersist()
        if on_batch is not None:
            on_batch(batch_id, seen.get)

    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
