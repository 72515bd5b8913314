"""Feature views stored for repeated point-in-time joins.

A view is stored once, bucketed by key and span of time and sorted by time.
Each span of a key also holds one carried row, the newest of earlier spans, so
an entity row finds all that it may need under its own (key, span): joins move
the entity rows only, and the history of a busy key lies in as many buckets as
it has spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import scratch_dir


@dataclass(frozen=True)
class StoredView:
    """A stored view: table name, key, feature columns, length of a span in microseconds, and its newest span."""

    table: str
    columns: tuple[str, ...]
    span_us: int
    last_span: int


def store_view(
    df: DataFrame, key: str, columns: Sequence[str], ts: str = "event_timestamp", ties: Sequence[str] = (), span: timedelta = timedelta(days=1),
    buckets: int = 64, table: str | None = None,
) -> StoredView:
    """Store the rows of a view; rows without key or time are left out, as no join can find them.

    ``span`` should be so long that a key has a few rows in it: an entity row
    meets the rows of its span.  A key is carried through every span from its
    first row to the newest span of the view, one row each.
    """
    span_us = span // timedelta(microseconds=1)
    us = F.unix_micros(ts)
    value = F.struct(F.col(ts).alias("_ts"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(ties)], *[F.col(c) for c in columns])
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("_key"), F.floor(us / F.lit(span_us)).alias("_span"), us.alias("_us"), value.alias("_row"))
    last = rows.agg(F.max("_span")).first()[0]
    order = F.struct("_us", *[F.col(f"_row._tie{i}") for i in range(len(ties))])
    newest = rows.groupBy("_key", "_span").agg(F.max_by(F.struct("_us", "_row"), order).alias("_n"))
    # a key has at most one row per span here
    until = F.coalesce(F.lead("_span").over(Window.partitionBy("_key").orderBy("_span")), F.lit(last).cast("bigint") + 1)
    carried = newest.withColumn("_until", until).select("_key", F.explode(F.sequence(F.col("_span") + 1, "_until")).alias("_span"), "_n._us", "_n._row")
    name = table or f"view_{uuid.uuid4().hex}"
    stored = rows.unionByName(carried).repartition(buckets, "_key", "_span")
    writer = stored.write.bucketBy(buckets, "_key", "_span").sortBy("_key", "_span", "_us").option("path", scratch_dir(df.sparkSession, name))
    writer.saveAsTable(name)
    return StoredView(name, tuple(columns), span_us, -1 if last is None else last)


def stored_view_join(entities: DataFrame, view: StoredView, key: str, entity_ts: str = "event_timestamp", max_age: timedelta | None = None) -> DataFrame:
    """Every entity row with the newest row of the view at or before its time, as ``point_in_time_join``.

    Columns of rows without a match, or with one older than ``max_age``, are
    null.  Ties on time go by the tie columns that the view was stored with.
    The stored side is neither shuffled nor sorted.
    """
    clash = set(view.columns) & set(entities.columns)
    if clash:
        raise ValueError(f"feature columns already in the entity table: {sorted(clash)}")
    stored = entities.sparkSession.table(view.table)
    n_ties = sum(f.name.startswith("_tie") for f in stored.schema["_row"].dataType.fields)
    at = F.unix_micros(entity_ts)
    span = F.least(F.floor(at / F.lit(view.span_us)), F.lit(view.last_span + 1))
    asked = entities.select(
        F.struct(*[F.col(c) for c in entities.columns]).alias("_entity"), F.col(key).alias("_key"), span.alias("_span"), at.alias("_at"),
        F.monotonically_increasing_id().alias("_nth"))
    known = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    f = stored.select(F.col("_key").alias("_fkey"), F.col("_span").alias("_fspan"), "_us", "_row")
    met = asked.where(known).join(f, (F.col("_key") == F.col("_fkey")) & (F.col("_span") == F.col("_fspan")) & (F.col("_us") <= F.col("_at")), "left")
    order = F.struct("_us", *[F.col(f"_row._tie{i}") for i in range(n_ties)])
    # grouped by the join keys too: the rows already lie together
    best = met.groupBy("_key", "_span", "_nth").agg(F.any_value("_entity").alias("_entity"), F.max_by("_row", order).alias("_row"))
    fresh = F.lit(True) if max_age is None else F.col(f"_entity.{entity_ts}") - F.col("_row._ts") <= F.lit(max_age)
    found = best.select("_entity.*", *[F.when(fresh, F.col(f"_row.{c}")).alias(c) for c in view.columns])
    return found.unionByName(asked.where(~known).select("_entity.*"), allowMissingColumns=True)
