"""Feature tables: derivation, point-in-time joins, latest-value tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ordering import earlier_ranges, in_ranges, null_nan, same_group

# Category codes and their replacement.
EDUCATION_CODES = {0: 4, 5: 4, 6: 4}
MARRIAGE_CODES = {0: 3}

PAY_STATUS = ["PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6"]
BILLS = [f"BILL_AMT{i}" for i in range(1, 7)]
PAYMENTS = [f"PAY_AMT{i}" for i in range(1, 7)]


# --- row-local derivation -------------------------------------------------

def clean_categories(df: DataFrame, codes: dict[str, dict[int, int]] | None = None) -> DataFrame:
    """Map rare category codes to the collecting code, leave the rest alone."""
    codes = codes or {"EDUCATION": EDUCATION_CODES, "MARRIAGE": MARRIAGE_CODES}
    for column, mapping in codes.items():
        df = df.replace(mapping, subset=[column])
    return df


def derive_features(
    df: DataFrame,
    limit: str = "LIMIT_BAL",
    status: Sequence[str] = PAY_STATUS,
    bills: Sequence[str] = BILLS,
    payments: Sequence[str] = PAYMENTS,
) -> DataFrame:
    """Seven row-local features; missing values are skipped, as in a frame mean."""
    kinds = dict(df.dtypes)

    def known(c: str) -> Column:
        # Only floating columns can hold NaN.
        return null_nan(c) if kinds[c] in ("double", "float") else F.col(c).cast("double")

    def total(values: Sequence[Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])

    # Sums of plain columns stay in generated code; arrays and lambdas would not.
    delays = [known(c) for c in status]
    n_delays = total([v.isNotNull().cast("double") for v in delays])
    first_bill, last_bill = F.col(bills[0]), F.col(bills[-1])
    return df.withColumns({
        "utilization_rate": F.try_divide(first_bill, F.col(limit) + 1),
        "payment_ratio": F.col(payments[0]) / (F.abs(first_bill) + 1),
        "max_delay": F.greatest(*delays),
        "avg_delay": F.try_divide(total(delays), n_delays),
        "consecutive_delays": total([(v > 0).cast("double") for v in delays]),
        "bill_trend": (first_bill - last_bill) / (F.abs(last_bill) + 1),
        "total_payment_ratio": total([known(c) for c in payments]) / (total([F.abs(known(c)) for c in bills]) + 1),
    })


def on_demand(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """Features computed after the lookup, as column expressions."""
    return df.withColumns(outputs)


def composite_risk(util: Column, pay: Column) -> dict[str, Column]:
    """Built-in on-demand transform: weighted score and a high-use flag."""
    used = F.coalesce(util, F.lit(0.0))
    return {
        "composite_risk_score": used * 0.7 + (F.lit(1.0) - F.coalesce(pay, F.lit(0.0))) * 0.3,
        "high_utilization": used > 0.8,
    }


# --- point-in-time joins --------------------------------------------------

def point_in_time_join(
    entities: DataFrame,
    features: DataFrame,
    key: str,
    columns: Sequence[str],
    entity_ts: str = "event_timestamp",
    feature_ts: str = "event_timestamp",
    ties: Sequence[str] = (),
    max_age: timedelta | None = None,
) -> DataFrame:
    """Latest feature row at or before each entity row.

    Takes the whole row: a null in the newest row is not filled from an older
    one.  Equal feature timestamps are decided by ``ties`` (last wins).  Every
    entity row is kept once.  Rows are sorted in ranges of (key, time); the row
    open at the start of a range is one per range and is broadcast.
    """
    return feature_views_join(
        entities, [View(features, columns, feature_ts, ties, max_age)], key, entity_ts
    )


@dataclass
class View:
    """One feature table of a point-in-time join."""

    df: DataFrame
    columns: Sequence[str]
    ts: str = "event_timestamp"
    ties: Sequence[str] = ()
    max_age: timedelta | None = None


def feature_views_join(entities: DataFrame, views: Sequence[View], key: str, entity_ts: str = "event_timestamp") -> DataFrame:
    """Point-in-time join of several views on the same key, in one shuffle."""
    wanted: dict[str, int] = {}
    for i, view in enumerate(views):
        for c in view.columns:
            wanted.setdefault(c, i)  # a feature named twice is taken from its first view
    clash = set(wanted) & set(entities.columns)
    if clash:
        raise ValueError(f"feature columns already in the entity table: {sorted(clash)}")

    def slot(i: int) -> str:
        return f"_view{i}"

    # Row type per view: timestamp, tie-break columns, values.
    packed = [
        F.struct(F.col(v.ts).alias("_ts"), *[F.col(c).alias(f"_tie{j}") for j, c in enumerate(v.ties)],
                 *[F.col(c) for c in v.columns])
        for v in views
    ]
    entity_row = F.struct(*[F.col(c) for c in entities.columns])
    rows = entities.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(entity_ts).alias("_at"), F.lit(1).alias("_side"), entity_row.alias("_entity")
    )
    for i, v in enumerate(views):
        part = v.df.where(F.col(key).isNotNull() & F.col(v.ts).isNotNull()).select(
            F.col(key).alias("_key"), F.col(v.ts).alias("_at"), F.lit(0).alias("_side"), packed[i].alias(slot(i))
        )
        rows = rows.unionByName(part, allowMissingColumns=True)

    slots = [slot(i) for i in range(len(views))]
    joined = _last_in_ranges(rows, slots)
    picked = []
    for c, i in wanted.items():
        row = F.col(slot(i))
        value = row[c]
        if views[i].max_age is not None:
            age_ok = F.col("_at") - row["_ts"] <= F.lit(views[i].max_age)
            value = F.when(age_ok, value)
        picked.append(value.alias(c))
    # A row without a key can match nothing but is kept.
    found = joined.select("_entity.*", *picked)
    orphan = entities.where(F.col(key).isNull())
    return found.unionByName(orphan, allowMissingColumns=True)


def _last_in_ranges(rows: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Last row of each view per entity row; the newest of earlier ranges is carried on."""
    order = ["_at", "_side", *slots]
    ranged = in_ranges(rows, ["_key", *order])
    opened = earlier_ranges(
        ranged, ["_key"], [F.max(s).alias(s) for s in slots],
        lambda before: [F.last(s, ignorenulls=True).over(before).alias(f"{s}_open") for s in slots],
    )
    inside = Window.partitionBy("_key", "_range").orderBy(*order, "_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.select(
        "_key", "_range", "_at", "_side", "_entity", *[F.last(s, ignorenulls=True).over(inside).alias(s) for s in slots]
    ).where(F.col("_side") == 1)
    joined = seen.join(F.broadcast(opened), same_group(["_key"]) & (F.col("_range") == F.col("_in_range")), "left")
    return joined.select("_at", "_side", "_entity", *[F.coalesce(F.col(s), F.col(f"{s}_open")).alias(s) for s in slots])


# --- latest-value tables --------------------------------------------------

def latest_values(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    ts: str = "event_timestamp",
    start: datetime | None = None,
    end: datetime | None = None,
    ttl: timedelta | None = None,
    written_at: datetime | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Last non-null value of every column per key over [start, end].

    Rows with equal times are decided by ``ties``, the largest wins.

    ``max_by`` combines on the map side, so a hot key costs one row per task.
    """
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end))
    out = df.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, *ties))).alias(c) for c in columns],
        F.max(ts).alias("last_ts"),
        F.count("*").alias("n_rows"),
    )
    if ttl is not None:
        stamp = F.lit(written_at) if written_at is not None else F.col("last_ts")
        out = out.withColumn("expire_at", stamp + F.lit(ttl))
    return out


def online_lookup(
    requests: DataFrame, table: DataFrame, key: str, columns: Sequence[str], now: datetime, expire: str = "expire_at"
) -> DataFrame:
    """Stored value per requested row, null where missing or expired."""
    live = F.col(expire).isNull() | (F.lit(now) <= F.col(expire))
    side = table.select(key, *[F.when(live, F.col(c)).alias(c) for c in columns])
    return requests.join(side, key, "left")


def interval_plan(spark: SparkSession, since: datetime, until: datetime, hours: int = 24) -> DataFrame:
    """Steps of ``hours`` over [since, until); the last one may be short."""
    if hours <= 0:
        raise ValueError("hours must be positive")
    one = spark.range(1).select(F.lit(since).alias("since"), F.lit(until).alias("until"))
    return split_interval(one, "since", "until", hours)


def split_interval(df: DataFrame, since: str, until: str, hours: int) -> DataFrame:
    """Replace each [since, until) row by its steps of ``hours``."""
    step = F.make_dt_interval(hours=F.lit(hours))
    keep = [c for c in df.columns if c not in (since, until)]
    return (
        df.where(F.col(since) < F.col(until))
        .select(*keep, F.col(until).alias("_until"), F.explode(F.sequence(since, until, step)).alias("start"))
        .where(F.col("start") < F.col("_until"))
        .select(*keep, "start", F.least(F.col("start") + step, F.col("_until")).alias("end"))
    )


def incremental_backfill(
    df: DataFrame, key: str, columns: Sequence[str], ts: str, since: datetime, hours: int = 24, until: datetime | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Latest non-null values per key and half-open interval, all intervals in one job; ``ties`` decide equal times."""
    seconds = hours * 3600
    origin = F.unix_seconds(F.lit(since).cast("timestamp"))
    rows = df.where(F.col(ts) >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col(ts) < F.lit(until))
    index = F.floor((F.unix_seconds(F.col(ts).cast("timestamp")) - origin) / seconds)
    rows = rows.withColumn("interval_id", index.cast("long"))
    return rows.groupBy("interval_id", key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, *ties))).alias(c) for c in columns],
        F.max(ts).alias("last_ts"),
        F.count("*").alias("n_rows"),
    ).withColumn("interval_start", F.timestamp_seconds(F.col("interval_id") * seconds + origin))


def freshness_status(
    df: DataFrame, view: str, ts: str, now: datetime, threshold_hours: float = 25.0, stale_multiplier: float = 3.0,
    expected: DataFrame | None = None,
) -> DataFrame:
    """Age of the newest row per view: FRESH, STALE or MISSING."""
    if stale_multiplier <= 1.0:
        raise ValueError("stale_multiplier must be > 1.0")
    last = df.groupBy(view).agg(F.max(ts).alias("last_ts"))
    if expected is not None:
        last = expected.select(view).distinct().join(last, view, "left")
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 3.6e9
    return last.withColumn("age_hours", age).withColumn(
        "status",
        F.when(F.col("age_hours") < threshold_hours, "FRESH")
        .when(F.col("age_hours") < threshold_hours * stale_multiplier, "STALE")
        .otherwise("MISSING"),
    )


def apply_user_transform(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """User code on whole Arrow batches, for what column expressions cannot say."""
    return df.mapInPandas(lambda batches: (fn(b) for b in batches), schema)
