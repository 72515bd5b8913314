"""Windowed features and service metrics, the same code for batch and stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import LongType, StructType

from tidemark.operators.service import LATENCY_BUCKETS
from tidemark.operators.sketches import KLL_SIZE
from tidemark.streaming.limits import KEY_GROUPS

# Alert limits of the push path.
MAX_LAG_MS = 500
MAX_DROP_RATE = 0.001
MAX_ONLINE_AGE_S = 300


def hourly_features(
    df: DataFrame, ts: str, key: str, amount: str, width: str = "1 hour", slide: str = "5 minutes", watermark: str = "10 minutes",
    ties: Sequence[str] = (), updates: bool = False,
) -> DataFrame:
    """Count and last amount per key and sliding window; ``ties`` decide equal times.

    On a stream, rows later than the watermark are dropped and a window is
    emitted once it is closed; on a table the watermark has no effect.

    ``updates`` is for streams in update mode, which emit the windows that a
    batch changes: the same rows, but rows are shuffled and kept once per slide
    instead of once per window.  It needs whole numbers as key and ties, numbers
    as amount, a width of whole slides and no other watermark in the query.
    """
    if updates and df.isStreaming:
        return _pane_updates(df.withWatermark(ts, watermark), ts, key, amount, width, slide, watermark, ties)
    rows = df.withWatermark(ts, watermark) if df.isStreaming else df
    out = rows.groupBy(F.window(ts, width, slide).alias("w"), key).agg(
        F.count("*").alias("tx_count_last_hour"), F.max_by(amount, F.struct(ts, *ties)).alias("last_tx_amount")
    )
    return out.select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tx_count_last_hour", "last_tx_amount")


def _pane_updates(
    rows: DataFrame, ts: str, key: str, amount: str, width: str, slide: str, watermark: str, ties: Sequence[str]
) -> DataFrame:
    kinds = dict(rows.dtypes)
    width_us, slide_us, delay_us = (pd.Timedelta(x).value // 1000 for x in (width, slide, watermark))
    if width_us % slide_us:
        raise ValueError("updates need a width of whole slides")
    given = F.col(key).cast("long")
    zero = F.lit(0).cast("long")
    # the event time that Spark judges lateness by is the end of a row's last window
    slim = rows.withColumn("_w", F.window(ts, width, slide)).where(F.unix_micros("_w.start") > F.unix_micros(ts) - slide_us).select(
        F.pmod(F.xxhash64(given), F.lit(KEY_GROUPS)).alias("keys"), given.isNull().cast("long").alias("none"), F.coalesce(given, zero).alias("key"),
        F.window_time("_w").alias("until"), F.unix_micros(ts).alias("us"),
        F.col(amount).isNull().cast("long").alias("empty"), F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("amount"),
        *[F.col(c).isNotNull().cast("long").alias(f"known{i}") for i, c in enumerate(ties)],
        *[F.coalesce(F.col(c).cast("long"), zero).alias(f"tie{i}") for i, c in enumerate(ties)],
    )
    panes = Panes(width_us, slide_us, delay_us, len(ties))
    told = slim.groupBy("keys").applyInPandasWithState(panes.update, Panes.STRETCH, panes.schema(), "update", "EventTimeTimeout")
    start = F.col("start") * F.lit(slide_us)
    last = F.when(F.col("empty") == 0, F.coalesce("amount", F.lit(float("nan"))))
    return told.withColumn("start", F.explode(F.sequence("first", "last"))).select(
        F.when(F.col("none") == 0, F.col("key")).cast(kinds[key]).alias(key), F.timestamp_micros(start).alias("window_start"),
        F.timestamp_micros(start + F.lit(width_us)).alias("window_end"), F.col("n").alias("tx_count_last_hour"),
        last.cast(kinds[amount]).alias("last_tx_amount"),
    )


class Panes:
    """Sliding windows of a group of keys, put together from panes as long as the slide.

    A pane has the count and the newest row of one key in one slide of time.  It
    is part of the windows that start from ``since`` up to its own start: those
    that were open when its rows came.  Panes are state until the last of these
    windows is closed.  Emitted are stretches of windows, ``first`` to ``last``,
    that have the same rows.  Times of panes and windows are counted in slides.
    """

    PANE = ("none", "key", "pane", "since")
    STRETCH = "none bigint, key bigint, first bigint, last bigint, n bigint, empty bigint, amount double"

    def __init__(self, width_us: int, slide_us: int, delay_us: int, ties: int):
        self.width_us, self.slide_us, self.delay_us = width_us, slide_us, delay_us
        self.order = ["us", *[f"{c}{i}" for i in range(ties) for c in ("known", "tie")]]
        self.columns = [*self.PANE, "n", *self.order, "empty", "amount"]

    def schema(self) -> str:
        return ", ".join(f"{c} array<{'double' if c == 'amount' else 'bigint'}>" for c in self.columns)

    def update(self, key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        closed_us = state.getCurrentWatermarkMs() * 1000
        first_open = (closed_us - self.width_us) // self.slide_us + 1
        every = []
        if state.exists:
            held = {c: np.array(v, "float64" if c == "amount" else "int64") for c, v in zip(self.columns, state.get, strict=True)}
            every.append(held | {"fresh": np.zeros_like(held["n"])})
        for batch in batches:
            rows = {c: batch[c].to_numpy() for c in ("none", "key", *self.order, "empty", "amount")}
            # the watermark after this batch is no earlier than this
            closed_us = max(closed_us, int(rows["us"].max()) // 1000 * 1000 - self.delay_us)
            rows["pane"] = rows["us"] // self.slide_us
            rows["since"] = np.maximum(rows["pane"] - self.width_us // self.slide_us + 1, first_open)
            rows["n"] = rows["fresh"] = np.ones_like(rows["pane"])
            every.append(self._merged(_where(rows, rows["since"] <= rows["pane"])))
        now = every[0] if len(every) == 1 else self._merged({c: np.concatenate([x[c] for x in every]) for c in every[0]})
        if now["fresh"].any():
            yield self._stretches(now)
        kept = _where(now, now["pane"] * self.slide_us + self.width_us > closed_us)
        if len(kept["pane"]):
            state.update(tuple(kept[c].tolist() for c in self.columns))
            state.setTimeoutTimestamp((int(kept["pane"].max()) * self.slide_us + self.width_us) // 1000)
        elif state.exists:
            state.remove()

    def _merged(self, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """One row per pane and ``since``: counts add up, the newest row stays."""
        if not len(rows["n"]):
            return rows
        by = np.lexsort([rows[c] for c in reversed([*self.PANE, *self.order])])
        starts = _changes(*[rows[c][by] for c in self.PANE])
        out = _where(rows, by[np.append(starts[1:], len(by)) - 1])
        return out | {"n": np.add.reduceat(rows["n"][by], starts), "fresh": np.maximum.reduceat(rows["fresh"][by], starts)}

    def _stretches(self, panes: dict[str, np.ndarray]) -> pd.DataFrame:
        """The windows that fresh panes are part of; neighbours with the same rows are one row."""
        panes = _where(panes, np.lexsort([panes[c] for c in reversed(["none", "key", *self.order])]))
        rank = np.arange(len(panes["n"]))
        whose = np.zeros_like(rank)
        whose[_changes(panes["none"], panes["key"])[1:]] = 1
        # a pane comes in at ``since`` and goes out after its own start
        whose, at = np.tile(np.cumsum(whose), 2), np.concatenate([panes["since"], panes["pane"] + 1])
        by = np.lexsort([at, whose])
        whose, at = whose[by], at[by]
        inside, changed = (np.cumsum(np.concatenate([panes[c], -panes[c]])[by]) for c in ("n", "fresh"))
        # later rows lie in later panes, so the newest pane that came in is the last one to go out
        newest = np.maximum.accumulate(np.concatenate([rank, np.zeros_like(rank)])[by])
        point = _changes(whose, at)[1:] - 1
        point = point[changed[point] > 0]
        top = newest[point]
        return pd.DataFrame({
            "none": panes["none"][top], "key": panes["key"][top], "first": at[point], "last": at[point + 1] - 1, "n": inside[point],
            "empty": panes["empty"][top], "amount": panes["amount"][top],
        })


def _where(rows: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {c: x[which] for c, x in rows.items()}


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before, the first row included."""
    differs = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(0, np.flatnonzero(differs) + 1)


#: Latency quantiles per window, read from a sketch that is exact up to KLL_SIZE requests.
LATENCY_QUANTILES = {"latency_p50": 0.5, "latency_p95": 0.95, "latency_p99": 0.99}


def service_windows(
    df: DataFrame, ts: str, latency: str, is_error: Column, width: str = "1 hour", watermark: str = "10 minutes"
) -> DataFrame:
    """Counts, error ratio, mean latency, quantiles and histogram per window.

    The state of a window is its counts and one quantile sketch of bounded size.
    """
    rows = df.withWatermark(ts, watermark) if df.isStreaming else df
    v = F.col(latency)
    out = rows.groupBy(F.window(ts, width).alias("w")).agg(
        F.count("*").alias("n"), F.count_if(is_error).alias("n_errors"), F.avg(v).alias("latency_mean"),
        F.kll_sketch_agg_double(v.cast("double"), F.lit(KLL_SIZE)).alias("sketch"), F.count(v).alias("n_timed"),
        *[F.count_if(v <= b).alias(f"le_{b}") for b in LATENCY_BUCKETS],
    )
    return out.select(
        F.col("w.start").alias("window_start"), "n", "n_errors", (F.col("n_errors") / F.col("n")).alias("error_ratio"),
        "latency_mean", *[F.when(F.col("n_timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(q) for q, p in LATENCY_QUANTILES.items()],
        *[f"le_{b}" for b in LATENCY_BUCKETS],
    )


def run_updates(
    out: DataFrame, folder: str, keys: Sequence[str], arrivals: Sequence[Callable[[], None]] = (lambda: None,), ties: Sequence[str] = (),
) -> DataFrame:
    """Run a stream over the files at hand, once after each of ``arrivals``; the last row that it emitted per ``keys``, ``ties`` within a batch.

    A run goes on from the checkpoint of the one before.  Each micro-batch writes what it changed into its own folder, so
    a repeated batch replaces itself.
    """
    spark = out.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/windows/batch={batch_id}")

    writer = out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    for arrive in arrivals:
        arrive()
        writer.start().awaitTermination()
    every = spark.read.schema(StructType([*out.schema.fields]).add("batch", LongType())).parquet(f"{folder}/windows")
    if ties:
        last = every.groupBy(*keys).agg(F.max_by(F.struct(*out.columns), F.struct("batch", *ties)).alias("_w"))
        return last.select("_w.*")
    # column by column, numbers and times are hashed and need no sort as structs do
    return every.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in out.columns if c not in keys]).select(*out.columns)


def push_health(df: DataFrame, ts: str, received: str, dropped: Column, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Push lag and drop rate per window against their limits."""
    rows = df.withWatermark(ts, watermark) if df.isStreaming else df
    lag = (F.unix_micros(received) - F.unix_micros(ts)) / 1000
    out = rows.groupBy(F.window(ts, width).alias("w")).agg(
        F.max(lag).alias("max_lag_ms"), F.avg(dropped.cast("double")).alias("drop_rate")
    )
    return out.select(
        F.col("w.start").alias("window_start"), "max_lag_ms", "drop_rate",
        (F.col("max_lag_ms") > MAX_LAG_MS).alias("lag_alert"), (F.col("drop_rate") > MAX_DROP_RATE).alias("drop_alert"),
    )
