"""Hand tables for joins, latest values, intervals and derived features."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import features as ft
from tidemark.operators.stored_features import store_view, stored_view_join


def day(n, h=0):
    return datetime(2023, 1, 1) + timedelta(days=n, hours=h)


HISTORY = [("C1", day(0), 0.10, 1), ("C1", day(150), None, 2), ("C1", day(150), 0.40, 3), ("C2", day(10), 0.50, 4), ("C2", day(20), None, 5)]
ENTITIES = [("C1", day(60), 1), ("C1", day(150), 2), ("C1", day(-1), 3), ("C2", day(30), 4), ("C9", day(30), 5), (None, day(30), 6)]


def test_point_in_time_join(spark):
    e = spark.createDataFrame(ENTITIES, "id string, ts timestamp, row int")
    f = spark.createDataFrame(HISTORY, "id string, fts timestamp, ratio double, seq int")
    out = ft.point_in_time_join(e, f, "id", ["ratio", "seq"], "ts", "fts", ties=["seq"])
    got = {r["row"]: (r["ratio"], r["seq"]) for r in out.collect()}
    # Equal times match, ties go to the larger sequence, a null in the newest row stays null.
    assert got == {1: (0.10, 1), 2: (0.40, 3), 3: (None, None), 4: (None, 5), 5: (None, None), 6: (None, None)}


def test_max_age_and_shared_views(spark):
    e = spark.createDataFrame(ENTITIES, "id string, ts timestamp, row int")
    f = spark.createDataFrame(HISTORY, "id string, fts timestamp, ratio double, seq int")
    views = [ft.View(f, ["ratio"], "fts", ["seq"], timedelta(days=30)), ft.View(f.withColumnRenamed("seq", "other"), ["other", "ratio"], "fts", ["other"])]
    got = {r["row"]: (r["ratio"], r["other"]) for r in ft.feature_views_join(e, views, "id", "ts").collect()}
    assert got[1] == (None, 1) and got[2] == (0.40, 3)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    feats=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), min_size=1, max_size=40),
    ents=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30)), min_size=1, max_size=15),
)
def test_join_equals_brute_force(spark, feats, ents):
    f = spark.createDataFrame([(k, day(t), i) for i, (k, t) in enumerate(feats)], "id int, fts timestamp, seq int")
    e = spark.createDataFrame([(k, day(t), i) for i, (k, t) in enumerate(ents)], "id int, ts timestamp, row int")
    out = ft.point_in_time_join(e, f, "id", ["seq"], "ts", "fts", ties=["seq"]).collect()
    assert len(out) == len(ents)
    for r in out:
        seen = [(t, i) for i, (k, t) in enumerate(feats) if k == r["id"] and day(t) <= r["ts"]]
        assert r["seq"] == (max(seen)[1] if seen else None)


def test_latest_values_take_the_last_known_value_per_column(spark):
    df = spark.createDataFrame([("a", day(1), 1.0, None), ("a", day(2), None, 5.0), ("b", day(1), None, None)], "k string, ts timestamp, x double, y double")
    got = {r["k"]: (r["x"], r["y"], r["n_rows"]) for r in ft.latest_values(df, "k", ["x", "y"], "ts").collect()}
    assert got == {"a": (1.0, 5.0, 2), "b": (None, None, 1)}


def test_lookup_respects_expiry(spark):
    table = ft.latest_values(spark.createDataFrame([("a", day(1), 1.0)], "k string, ts timestamp, x double"), "k", ["x"], "ts", ttl=timedelta(hours=2))
    asked = spark.createDataFrame([("a",), ("z",)], "k string")
    value = lambda now: {r["k"]: r["x"] for r in ft.online_lookup(asked, table, "k", ["x"], now).collect()}
    assert value(day(1, 2)) == {"a": 1.0, "z": None}
    assert value(day(1, 3)) == {"a": None, "z": None}


def test_interval_plan(spark):
    rows = ft.interval_plan(spark, day(0), day(1, 12), 24).collect()
    assert [(r["start"], r["end"]) for r in rows] == [(day(0), day(1)), (day(1), day(1, 12))]
    assert ft.interval_plan(spark, day(1), day(1)).count() == 0


def test_backfill_reads_a_boundary_row_once(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), 2.0)], "k string, ts timestamp, x double")
    rows = ft.incremental_backfill(df, "k", ["x"], "ts", day(0)).orderBy("interval_id").collect()
    assert [(r["interval_id"], r["x"], r["n_rows"]) for r in rows] == [(0, 1.0, 1), (1, 2.0, 1)]


def test_derived_features_skip_missing_values(spark):
    cols = ["LIMIT_BAL", *ft.PAY_STATUS, *ft.BILLS, *ft.PAYMENTS]
    row = [999.0, 2, None, -1, 0, 1, None, 500.0, 0.0, 0.0, 0.0, 0.0, -99.0, 250.0, 0.0, None, 0.0, 0.0, 0.0]
    schema = ", ".join(f"{c} {'int' if c.startswith('PAY_') and 'AMT' not in c else 'double'}" for c in cols)
    r = ft.derive_features(spark.createDataFrame([tuple(row)], schema)).first()
    assert r["utilization_rate"] == 0.5 and r["max_delay"] == 2 and r["avg_delay"] == 0.5 and r["consecutive_delays"] == 2
    assert r["bill_trend"] == pytest.approx(5.99) and r["total_payment_ratio"] == pytest.approx(250 / 600)


def test_freshness(spark):
    df = spark.createDataFrame([("a", day(9, 12)), ("b", day(8)), ("c", day(1))], "v string, ts timestamp")
    want = spark.createDataFrame([(x,) for x in "abcd"], "v string")
    got = {r["v"]: r["status"] for r in ft.freshness_status(df, "v", "ts", day(10), expected=want).collect()}
    assert got == {"a": "FRESH", "b": "STALE", "c": "MISSING", "d": "MISSING"}


def test_stored_view_equals_the_join(spark):
    e = spark.createDataFrame(ENTITIES + [("C1", None, 7)], "id string, ts timestamp, row int")
    f = spark.createDataFrame([*HISTORY, (None, day(1), 0.9, 8), ("C1", None, 0.9, 9)], "id string, fts timestamp, ratio double, seq int")
    view = store_view(f, "id", ["ratio", "seq"], "fts", ["seq"], timedelta(days=40), buckets=3)
    got = {r["row"]: (r["ratio"], r["seq"]) for r in stored_view_join(e, view, "id", "ts").collect()}
    assert got == {1: (0.10, 1), 2: (0.40, 3), 3: (None, None), 4: (None, 5), 5: (None, None), 6: (None, None), 7: (None, None)}
    late = spark.createDataFrame([("C2", day(900), 1)], "id string, ts timestamp, row int")
    assert stored_view_join(late, view, "id", "ts").first()["seq"] == 5
    assert stored_view_join(late, view, "id", "ts", timedelta(days=30)).first()["seq"] is None
    none = store_view(f.where("false"), "id", ["ratio"], "fts")
    assert stored_view_join(e, none, "id", "ts").where("ratio is null").count() == 7


def test_stored_view_of_a_busy_key(spark):
    """A key with a third of all rows; several spans, equal times, entities repeated."""
    rng = random.Random(3)
    hist = [(0 if k % 3 == 0 else k % 50, day(0) + timedelta(minutes=rng.randrange(20_000)), k) for k in range(3000)]
    asked = [(rng.choice([0, rng.randrange(60)]), day(0) + timedelta(minutes=rng.randrange(-100, 30_000)), k) for k in range(400)]
    f = spark.createDataFrame(hist, "id int, fts timestamp, seq int")
    view = store_view(f, "id", ["seq"], "fts", ["seq"], timedelta(hours=6), buckets=4)
    per_bucket = spark.table(view.table).where("_key = 0").groupBy("_span").count().count()
    assert per_bucket > 50  # the busy key lies under as many bucket keys as it has spans
    got = {r["row"]: r["seq"] for r in stored_view_join(spark.createDataFrame(asked, "id int, ts timestamp, row int"), view, "id", "ts").collect()}
    for i, ts, row in asked:
        seen = [(t, s) for k, t, s in hist if k == i and t <= ts]
        assert got[row] == (max(seen)[1] if seen else None)


def test_stored_side_is_not_shuffled(spark):
    f = spark.createDataFrame([(k % 7, day(k % 90), k) for k in range(500)], "id int, fts timestamp, seq int")
    view = store_view(f, "id", ["seq"], "fts", ["seq"], timedelta(days=10), buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.createDataFrame([(k % 7, day(k % 120), k) for k in range(300)], "id int, ts timestamp, row int")
        plan = stored_view_join(e, view, "id", "ts")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
