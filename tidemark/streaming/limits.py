"""Sliding rate limit and values that expire: state per key."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tidemark.session import scratch_dir

MAX_REQUESTS = 100
WINDOW_SECONDS = 60.0


def with_demand(requests: DataFrame, window_us: int) -> DataFrame:
    """``_client, _us, _key`` with ``_span`` (number of the window-long span of time) and ``_demand``: requests of the client in the window that ends here, this one included.

    A request also stands in the span after its own, so that each (client, span)
    has all that its windows reach back to, and no ordered group is longer than two spans.
    """
    spans = requests.withColumn("_span", F.floor(F.col("_us") / F.lit(window_us)))
    both = spans.withColumn("_shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_span", F.col("_span") + F.col("_shift"))
    own = Window.partitionBy("_client", "_span")
    place = F.row_number().over(own.orderBy("_us", "_key"))
    left_behind = F.count("*").over(own.orderBy("_us").rangeBetween(Window.unboundedPreceding, -window_us))
    return both.withColumn("_demand", place - left_behind).where("_shift = 0").drop("_shift")


def rate_limit(
    df: DataFrame, client: str, ts: str, key: str, max_requests: int = MAX_REQUESTS, window_seconds: float = WINDOW_SECONDS
) -> DataFrame:
    """(client, key, allowed, remaining) for every request, in the order of time and key per client.

    Whether a request is accepted depends on the accepted ones before it, but
    most need no look at them: where the demand of a window, rejected requests
    included, is within the limit, its last request is accepted, and while no
    demand of the last two windows was above the limit, all counted ones were.
    So time is cut into spans as long as the window.  Only spans with an
    overflow, and the one after, are read in order, starting one span before;
    such stretches are streamed through a task each, with at most
    ``max_requests`` times as state.  All else is windows of two spans at most,
    also for a client that sends a third of all requests.

    A null client is a client; a request without a time is answered with nulls.
    """
    window_us = int(window_seconds * 1_000_000)
    kinds = dict(df.dtypes)
    given = df.select(F.col(client).alias("_client"), F.unix_micros(ts).alias("_us"), F.col(key).alias("_key"))
    path = scratch_dir(df.sparkSession, "request-demand")
    with_demand(given.where("_us is not null"), window_us).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    full = rows.where(F.col("_demand") > max_requests).select("_client", "_span").distinct()
    # neighbouring full spans are one stretch; one row per client and span
    stretch = F.col("_span") - F.row_number().over(Window.partitionBy("_client").orderBy("_span"))
    reach = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_off")
    touched = full.withColumn("_stretch", stretch).select(F.col("_client").alias("_c"), F.col("_span").alias("_full"), "_stretch", reach)
    touched = touched.groupBy("_c", (F.col("_full") + F.col("_off")).alias("_s"), "_stretch").agg(F.max(F.col("_off") >= 0).alias("_decides"))
    joined = rows.join(touched, F.col("_client").eqNullSafe(F.col("_c")) & (F.col("_span") == F.col("_s")), "left")
    calm = ~F.coalesce(F.col("_decides"), F.lit(False))
    # a span before one stretch may be the last of another, which then decides it
    decided = touched.where("_decides").select(F.col("_c").alias("_dc"), F.col("_s").alias("_ds"))
    loose = joined.where(calm).join(decided, F.col("_client").eqNullSafe(F.col("_dc")) & (F.col("_span") == F.col("_ds")), "left_anti")
    quiet = loose.select("_client", "_key", F.lit(True).alias("allowed"), (F.lit(max_requests) - F.col("_demand")).cast("long").alias("remaining"))

    schema = StructType.fromDDL(f"_client {kinds[client]}, _key {kinds[key]}, allowed boolean, remaining long")
    target = to_arrow_schema(schema)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, accepted = None, deque()
        for batch in batches:
            allowed, remaining = [], []
            for at, us in zip(zip(*[batch.column(c).to_pylist() for c in ("_client", "_stretch")], strict=True), batch.column("_us").to_pylist(), strict=True):
                if at != current:
                    current, accepted = at, deque()
                while accepted and accepted[0] <= us - window_us:
                    accepted.popleft()
                ok = len(accepted) < max_requests
                if ok:
                    accepted.append(us)
                allowed.append(ok)
                remaining.append(max_requests - len(accepted))
            out = [batch.column("_client"), batch.column("_key"), pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, schema=target).filter(batch.column("_decides"))

    ordered = joined.where("_stretch is not null").select("_client", "_stretch", "_us", "_key", "_decides")
    ordered = ordered.repartition("_client", "_stretch").sortWithinPartitions("_client", "_stretch", "_us", "_key")
    busy = ordered.mapInArrow(decide, schema)
    untimed = given.where("_us is null").select("_client", "_key", F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("long").alias("remaining"))
    return quiet.unionByName(busy).unionByName(untimed).select(F.col("_client").alias("client"), F.col("_key").alias("key"), "allowed", "remaining")


class RateLimiter(StatefulProcessor):
    """Accepted request times per client as list state; the list is bounded by the limit.

    All rows of a client in a micro-batch are put in time order first.  With
    ``idle_seconds``, a client that stays away for so long is forgotten.
    """

    def __init__(self, max_requests: int = MAX_REQUESTS, window_seconds: float = WINDOW_SECONDS, idle_seconds: float | None = None):
        self.max_requests = max_requests
        self.window_us = int(window_seconds * 1_000_000)
        self.idle_ms = None if idle_seconds is None else int(max(window_seconds, idle_seconds) * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("accepted", StructType([StructField("us", LongType())]), self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        accepted = deque(t[0] for t in self.times.get())
        arrived = list(rows)
        if arrived:
            batch = pd.concat(arrived).sort_values(["us", "request"], kind="stable")
            allowed, remaining = [], []
            for us in batch["us"]:
                while accepted and accepted[0] <= us - self.window_us:
                    accepted.popleft()
                ok = len(accepted) < self.max_requests
                if ok:
                    accepted.append(int(us))
                allowed.append(ok)
                remaining.append(max(0, self.max_requests - len(accepted)))
            yield pd.DataFrame({"client": [key[0]] * len(batch), "request": batch["request"].to_numpy(), "allowed": allowed, "remaining": remaining})
        if accepted:
            self.times.put([(t,) for t in accepted])
        else:
            self.times.clear()

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_rate_limit(
    stream: DataFrame, max_requests: int = MAX_REQUESTS, window_seconds: float = WINDOW_SECONDS, idle_seconds: float | None = None
) -> DataFrame:
    """Streaming form on (client bigint, request bigint, us bigint); needs the RocksDB state store.

    Set ``idle_seconds`` on a stream that runs on; a run over the files at hand
    would wait for the clients to expire.
    """
    out = "client bigint, request bigint, allowed boolean, remaining bigint"
    return stream.groupBy("client").transformWithStateInPandas(
        RateLimiter(max_requests, window_seconds, idle_seconds), out, "append", "None" if idle_seconds is None else "ProcessingTime"
    )


class ExpiringValues(StatefulProcessor):
    """Last value per key with a state time-to-live; a read after expiry finds nothing."""

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", StructType([StructField("v", DoubleType()), StructField("us", LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.value.get() if self.value.exists() else None
        newest = before
        for batch in rows:
            top = batch.loc[batch["us"].idxmax()]
            if newest is None or int(top["us"]) > newest[1]:
                newest = (float(top["value"]), int(top["us"]))
        self.value.update(newest)
        yield pd.DataFrame({"key": [key[0]], "value": [newest[0]], "us": [newest[1]], "had_value": [before is not None]})

    def close(self) -> None:
        pass


def stream_expiring_values(stream: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Streaming form on (key bigint, value double, us bigint); needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(
        ExpiringValues(ttl_seconds), "key bigint, value double, us bigint, had_value boolean", "update", "ProcessingTime"
    )


#: Groups of keys that share a state, a timer and one Python call per micro-batch.
KEY_GROUPS = 512


class ValuesExpiringInEventTime(StatefulProcessor):
    """Newest value per key, forgotten once the watermark passes its expiry; a timer tells when.

    The state of a group of keys is a list with one value for each key, and one
    timer at the first expiry, so that calls grow with groups and not with keys.
    A null key is the key 0 with ``none`` set.
    """

    COLUMNS = {"none": bool, "key": "int64", "value": "float64", "us": "int64", "nth": "int64", "expire_us": "int64"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = {bool: BooleanType(), "int64": LongType(), "float64": DoubleType()}
        self.values = handle.getListState("values", StructType([StructField(n, kinds[k]) for n, k in self.COLUMNS.items()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._held()
        now, told = before, []
        for batch in rows:
            top = self._newest(batch[list(self.COLUMNS)]).astype(self.COLUMNS)
            told.append(top[["none", "key"]])
            # of equal rows the one that was there first stays
            now = self._newest(pd.concat([top, now], ignore_index=True))
        self._keep(now, self._first(before))
        yield self._told(now.merge(pd.concat(told).drop_duplicates(), on=["none", "key"]), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        over = held["expire_us"] // 1000 <= timerValues.getCurrentWatermarkInMs()
        self._keep(held[~over], expiredTimerInfo.getExpiryTimeInMs())
        yield self._told(held[over], True)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.values.get()), columns=list(self.COLUMNS)).astype(self.COLUMNS)

    def _newest(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["none", "key", "us", "nth"])
        return rows[~rows.duplicated(["none", "key"], keep="last")]

    def _first(self, rows: pd.DataFrame) -> int | None:
        return int(rows["expire_us"].min()) // 1000 if len(rows) else None

    def _keep(self, rows: pd.DataFrame, timer: int | None) -> None:
        """Make these rows the state; ``timer`` is the one that stands."""
        if (first := self._first(rows)) != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if len(rows):
            self.values.put([*rows.itertuples(index=False, name=None)])
        else:
            self.values.clear()

    def _told(self, rows: pd.DataFrame, expired: bool) -> pd.DataFrame:
        keys = rows["key"].astype("Int64").mask(rows["none"].astype(bool))
        return rows[["value", "us", "expire_us"]].assign(key=keys, expired=expired)[["key", "value", "us", "expire_us", "expired"]]

    def close(self) -> None:
        pass


def stream_expiring_table(stream: DataFrame, key: str, value: str, ts: str, pushed: str, order: str, watermark: str = "10 minutes") -> DataFrame:
    """Streaming form of ``expiring_table``: ``key, value, us, expire_us, expired`` for each key that a batch changes.

    Rows later than the watermark are dropped.  A value expires an hour after
    its event time where it was pushed, a day after where it came from batch,
    as the watermark goes; a newer value takes its place and its expiry.  Needs
    the RocksDB state store.
    """
    us = F.unix_micros(ts)
    ttl = F.when(F.col(pushed), PUSH_TTL_SECONDS).otherwise(BATCH_TTL_SECONDS).cast("long") * 1_000_000
    given = F.col(key).cast("long")
    rows = stream.withWatermark(ts, watermark).select(
        F.pmod(F.xxhash64(given), F.lit(KEY_GROUPS)).alias("keys"), given.isNull().alias("none"), F.coalesce(given, F.lit(0).cast("long")).alias("key"),
        F.col(value).cast("double").alias("value"), F.col(ts).alias("ts"), us.alias("us"), F.col(order).cast("long").alias("nth"), (us + ttl).alias("expire_us"))
    out = "key bigint, value double, us bigint, expire_us bigint, expired boolean"
    return rows.groupBy("keys").transformWithStateInPandas(ValuesExpiringInEventTime(), out, "update", "EventTime")


# Time to live of batch and pushed features.
BATCH_TTL_SECONDS = 24 * 3600
PUSH_TTL_SECONDS = 3600


def expiring_table(df: DataFrame, key: str, value: str, ts: str, pushed: str, ties: Sequence[str] = ()) -> DataFrame:
    """Last value per key with its expiry: one hour when pushed, a day when from batch.

    Value and source come from one row; of equal times ``ties`` decide.
    """
    newest = F.max_by(F.struct(F.col(value).alias("value"), F.col(pushed).alias("pushed"), F.col(ts).alias("written_at")), F.struct(ts, *ties))
    last = df.groupBy(key).agg(newest.alias("_n")).select(key, "_n.*")
    ttl = F.when(F.col("pushed"), PUSH_TTL_SECONDS).otherwise(BATCH_TTL_SECONDS)
    return last.withColumn("expire_at", F.col("written_at") + F.make_dt_interval(secs=ttl))
