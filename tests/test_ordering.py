"""Exact ranks, totals and quantiles, against numpy."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import ordering
from tidemark.functions.ordering import hash_sample, in_ranges, order_values, quantiles, row_numbers, running_totals, top_k


def skewed(n=3000, seed=1):
    """One group holds two thirds of the rows; values repeat."""
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.66 else rng.choice("abc"), round(rng.lognormvariate(0, 2), 1)) for i in range(n)]


def test_row_numbers_match_a_sort(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "id int, g string, v double")
    for descending in (False, True):
        got = {r["id"]: r["rank"] for r in row_numbers(df, "v", ["g"], ["id"], descending).collect()}
        want = {}
        for g in {r[1] for r in rows}:
            part = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2] if descending else r[2], r[0]))
            want.update({r[0]: i + 1 for i, r in enumerate(part)})
        assert got == want


def test_running_totals_without_groups(spark):
    rows = skewed(800)
    df = spark.createDataFrame(rows, "id int, g string, v double")
    out = running_totals(df, "v", [], {"t": F.col("id")}, ["id"]).collect()
    total, want = 0, {}
    for i, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        total += i
        want[i] = total
    assert {r["id"]: r["t"] for r in out} == want


def test_quantiles_equal_numpy(spark):
    rows = skewed()
    df = spark.createDataFrame(rows + [(-1, "a", None), (-2, "a", float("nan"))], "id int, g string, v double")
    probs = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in quantiles(df, "v", probs, ["g"]).collect():
        values = [x[2] for x in rows if x[1] == r["g"]]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(values, p * 100), abs=1e-9)


def test_order_values_of_structs(spark):
    df = spark.createDataFrame(skewed(500), "id int, g string, v double").withColumn("at", F.struct("v", "id"))
    cut = order_values(df.select("at"), "at", {"first": lambda n: F.lit(0), "last": lambda n: n - 1}).first()
    ordered = sorted((r[2], r[0]) for r in skewed(500))
    assert (tuple(cut["first"]), tuple(cut["last"]), cut["n_all"]) == (ordered[0], ordered[-1], 500)


def test_ranges_follow_from_the_rows(spark):
    """Equal keys, and a key with five times, are cut like all others."""
    rows = [(i, f"k{i % 200}", 1.0) for i in range(4000)] + [(i, "hot", float(i % 5)) for i in range(6000)]
    ranged = in_ranges(spark.createDataFrame(rows, "id int, g string, v double"), ["g", "v"], most=500)
    sizes = [r["count"] for r in ranged.groupBy("g", "_range").count().collect()]
    assert max(sizes) <= 500 and sum(sizes) == len(rows)


def test_totals_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    rows = [(i, None if i % 3 else "a", float(i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = {r["id"]: r["rank"] for r in row_numbers(df, "v", ["g"], ["id"]).collect()}
    want = {}
    for g in (None, "a"):
        want.update({r[0]: n + 1 for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])))})
    assert got == want


def test_top_k_and_hash_sample(spark):
    df = spark.createDataFrame(skewed(1000), "id int, g string, v double")
    best = top_k(df, 3, [F.col("v").desc(), F.col("id").asc()], ["g"], ["id"]).collect()
    for g in {r["g"] for r in best}:
        want = sorted((r for r in skewed(1000) if r[1] == g), key=lambda r: (-r[2], r[0]))[:3]
        assert [r["id"] for r in sorted((b for b in best if b["g"] == g), key=lambda b: b["rank"])] == [w[0] for w in want]
    copies = spark.createDataFrame([(1, 1.0)] * 400 + [(i, float(i)) for i in range(600)], "id int, v double")
    picked = hash_sample(copies, 50, ["id", "v"])
    assert picked.count() <= 50 and picked.count() == picked.distinct().count()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), p=st.floats(0, 1))
def test_quantile_property(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert quantiles(df, "v", {"q": p}).first()["q"] == pytest.approx(np.percentile(values, p * 100), rel=1e-9, abs=1e-6)


def test_no_cross_join_and_no_single_task_window_over_rows(spark):
    plan = row_numbers(spark.createDataFrame(skewed(2000), "id int, g string, v double"), "v", ["g"], ["id"])
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "hashpartitioning(g" in plan and "_range" in plan
