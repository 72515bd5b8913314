"""Contracts, labels, feedback, logs and governance on hand tables."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration as cal
from tidemark.operators import contracts as ct
from tidemark.operators import feedback as fb
from tidemark.operators import governance as gv
from tidemark.operators import labels as lb
from tidemark.operators import models as md
from tidemark.operators import service as sv
from tidemark.sources import readers as rd
from tidemark.sources import writers as wr

T0 = datetime(2024, 1, 1)


def test_row_violations_collects_all(spark):
    rules = (ct.Rule("id", "bigint", above=0, unique=True), ct.Rule("x", "double", low=0, high=1), ct.Rule("c", "string", allowed=("a", "b")), ct.Rule("n", "int"))
    df = spark.createDataFrame([(1, 0.0, "a", "1"), (1, 1.0, "z", "x"), (0, float("nan"), None, None), (5, 2.0, "b", "2")], "id long, x double, c string, n string")
    got = sorted((r["id"], r["column"], r["check"]) for r in ct.row_violations(df, ct.Contract("t", rules), ["id"]).collect())
    assert got == sorted([
        (1, "id", "unique"), (1, "id", "unique"), (1, "c", "allowed"), (1, "n", "type"), (0, "id", "above"), (0, "x", "not_null"),
        (0, "c", "not_null"), (0, "n", "not_null"), (5, "x", "range"),
    ])


def test_enforcement_modes(spark):
    rules = (ct.Rule("x", "double", low=0),)
    df = spark.createDataFrame([(1, 1.0), (2, -1.0)], "id long, x double")
    strict = ct.enforce(df, ct.Contract("t", rules, created_at=T0), ["id"], T0 + timedelta(hours=25))
    assert [r["id"] for r in strict.passed.collect()] == [1] and strict.summary.first()["is_stale"]
    with pytest.raises(ct.GateFailed):
        ct.finish(strict)
    warn = ct.enforce(df, ct.Contract("t", rules, mode="warn"), ["id"], T0)
    assert warn.passed.count() == 2
    ct.finish(warn)
    with pytest.raises(ValueError):
        ct.Contract("t", rules, mode="loud")


def test_gate_raises_with_every_failure(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    out = ct.validation_gate(df, [ct.Rule("x", "double"), ct.Rule("y", "int")], [ct.StatCheck("min_rows", low=10)])
    with pytest.raises(ct.GateFailed, match="3 failed"):
        ct.raise_on_failure(out)


def test_push_errors(spark):
    rows = ['{"a": 1, "b": 2}', '{"a": null, "b": 1.5}', '{"a": true, "b": "x"}', '{"b": 1}', "{oops"]
    df = spark.createDataFrame([(r,) for r in rows], "payload string")
    out = [r["errors"] for r in ct.push_event_errors(df, "payload", ["a"], {"a": "int", "b": "float"}).collect()]
    assert out == [[], [], ["type:b:string"], ["missing:a"], ["malformed"]]


def test_outcome_exactly_at_the_delay_and_duplicates(spark):
    p = spark.createDataFrame([(1, T0), (2, T0), (3, T0)], "id int, at timestamp")
    o = spark.createDataFrame([(1, T0 + timedelta(days=90)), (1, T0 + timedelta(days=89)), (2, T0)], "id int, out timestamp")
    assert [r["id"] for r in lb.confirmed_label_join(p, o, "id", "at", "out").collect()] == [1]
    assert lb.confirmed_label_counts(p, o, "id", "at", "out").first().asDict() == {"n_matched": 3, "n_confirmed": 1, "n_dropped": 2}
    late = spark.createDataFrame([(1, 1, 30.0, 1), (1, None, 60.0, 2), (2, 0, 30.0, 1), (3, 1, 29.0, 1)], "id int, label int, delay double, seq int")
    got = {r["id"]: r["status"] for r in lb.delayed_outcome_join(p, late, "id", "label", "delay", ["seq"]).collect()}
    assert got == {1: "provisional", 2: "confirmed", 3: "provisional"}


def test_corrections(spark):
    df = spark.createDataFrame([(1, T0, 1, "r1"), (2, T0, 1, "r2"), (2, T0 + timedelta(days=1), 0, "r3"), (2, T0 + timedelta(days=1), 1, "r4")], "id int, ts timestamp, y int, row string")
    out = {r["row"]: (r["is_current"], r["is_superseded"]) for r in lb.label_corrections(df, "id", "ts", ["row"]).collect()}
    assert out == {"r1": (True, False), "r2": (False, True), "r3": (True, False), "r4": (False, True)}
    assert sorted(r["row"] for r in lb.current_labels(df, "id", "ts", ["row"]).collect()) == ["r1", "r3"]


def test_arrival_and_policy(spark):
    df = spark.createDataFrame([(T0, T0 + timedelta(days=d), "v1", False) for d in (-3, 1, 30, 200)], "o timestamp, e timestamp, policy_version string, is_corrected boolean")
    c = lb.arrival_curve(df, "o", "e").first()
    assert (c["t1"], c["t30"], c["t180"]) == (0.75, 0.5, 0.25)
    assert lb.label_policy_checks(df).first()["is_consistent"] and not lb.label_policy_checks(df.drop("policy_version")).first()["is_consistent"]


def test_feedback_needs_ten_rows_and_loop_moves_the_baseline(spark):
    rows = [(1, 0.9, "decline"), (0, 0.1, "approve")] * 4
    df = spark.createDataFrame(rows, "y int, p double, d string")
    assert fb.feedback_metrics(df, "y", "p", "d").first()["auc"] is None
    more = fb.feedback_metrics(df.unionByName(df), "y", "p", "d").first()
    assert (more["auc"], more["approval_rate"], more["default_rate_approved"]) == (1.0, 0.5, 0.0)
    m = spark.createDataFrame([(1, 0.71, 500), (2, 0.75, 500), (3, 0.74, 500), (4, 0.60, 50), (5, 0.60, 500)], "w int, auc double, n_labeled long")
    got = [(r["reason"], r["approval"], r["baseline_auc"]) for r in fb.closed_loop(m, "w").orderBy("w").collect()]
    assert got == [
        ("below_threshold", "not_triggered", 0.70), ("improved", "approved", 0.70), ("below_threshold", "not_triggered", 0.75),
        ("batch_too_small", "not_triggered", 0.75), ("degraded", "rejected", 0.75),
    ]


def test_latency_last_n_and_bucket_quantile(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(seconds=i), float(i), "a") for i in range(100)], "id int, ts timestamp, v double, g string")
    last = sv.last_n_rows(df, 10, "ts", "id", ["g"])
    assert sorted(r["id"] for r in last.collect()) == list(range(90, 100))
    assert sorted(r["id"] for r in sv.last_n_rows(df, 10, "ts", "id").collect()) == list(range(90, 100))
    nulls = df.withColumn("g", F.when(F.col("id") % 2 == 0, "a"))
    assert {r["g"]: r["p50"] for r in sv.latency_summary(nulls, "v", ["g"]).collect()} == {"a": 49.0, None: 50.0}
    assert sorted(r["id"] for r in sv.last_n_rows(nulls, 2, "ts", "id", ["g"]).collect()) == [96, 97, 98, 99]
    assert sv.quality_drift(nulls, "v", "ts", "id", ["g"], 5).count() == 2
    s = sv.latency_summary(df, "v").first()
    assert s["p50"] == pytest.approx(49.5) and s["p99"] == pytest.approx(98.01)
    empty = sv.latency_summary(df.where("false"), "v").first()
    assert (empty["n"], empty["mean"], empty["p99"]) == (0, 0.0, 0.0)
    p = sv.panels(df, "ts", "v", F.lit(False), 60).first()
    assert p["p50"] == pytest.approx(25 + 25 * (50 - 26) / 25) and p["error_ratio"] == 0.0


def test_budget_and_slo(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(hours=i), 10.0) for i in range(12)], "id int, ts timestamp, v double")
    r = sv.budget_alerts(df, "ts", "v", 100.0, ["id"]).first()
    assert r["reached_50"] == T0 + timedelta(hours=4) and r["reached_100"] == T0 + timedelta(hours=9) and r["over_budget"]
    m = spark.createDataFrame([(750.0, 0.0095, 0.95)], "p99_latency double, error_rate double, approval_rate double")
    got = {x["slo"]: (x["compliant"], round(x["consumed"], 6), x["status"]) for x in sv.slo_report(m).collect()}
    assert got == {"p99_latency": (False, 0.5, "YELLOW"), "error_rate": (True, 0.95, "RED"), "approval_rate": (False, 0.75, "YELLOW")}


def test_prediction_log_quarantine(spark, tmp_path):
    good = '{"prediction_id":"p1","correlation_id":"c","entity_key":"e","model_version":"v","score":0.5,"decision":"review","features":{"a":1.5},"prediction_ts":"2024-01-01T00:00:00"}'
    lines = [good, "{broken", good.replace("0.5", "1.5"), good.replace("review", "maybe"), good.replace('"entity_key":"e",', ""), good.replace("2024-01-01T00:00:00", "soon"), ""]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = rd.read_prediction_log(spark, str(tmp_path / "log.jsonl"))
    assert rd.good_predictions(log).count() == 2
    assert sorted(r["problem"] for r in rd.quarantined_predictions(log).collect()) == ["decision", "malformed", "missing_key", "score_range"]
    flagged = rd.good_predictions(log).where("bad_timestamp").collect()
    assert len(flagged) == 1 and flagged[0]["prediction_ts"] is None


def test_raw_scan_checks_rows_and_columns(spark, tmp_path):
    path = str(tmp_path / "raw.csv")
    (tmp_path / "raw.csv").write_text("ID, limit_bal ,SEX,EDUCATION,MARRIAGE,AGE,PAY_1,DEFAULT_PAYMENT_NEXT_MONTH\n1,10.5,1,2,1,30,-1,0\n")
    row = rd.raw_credit_scan(spark, path, min_rows=1).first()
    assert (row["LIMIT_BAL"], row["PAY_0"]) == (10.5, -1)
    with pytest.raises(rd.SourceError):
        rd.raw_credit_scan(spark, path)
    (tmp_path / "bad.csv").write_text("ID,AGE\n1,2\n")
    with pytest.raises(rd.SourceError, match="missing"):
        rd.raw_credit_scan(spark, str(tmp_path / "bad.csv"))


def test_offline_scan_is_inclusive_pushes_down_and_may_be_empty(spark, tmp_path):
    path = str(tmp_path / "f")
    spark.createDataFrame([(i, T0 + timedelta(days=i), 1.0) for i in range(5)], "id int, event_timestamp timestamp, unused double").write.parquet(path)
    df = rd.offline_scan(spark, rd.DataSource("s", "parquet", path), T0 + timedelta(days=1), T0 + timedelta(days=3)).select("id")
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 3]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_timestamp" in plan and "unused" not in plan
    gone = rd.DataSource("s", "parquet", str(tmp_path / "none"), schema="id int, event_timestamp timestamp")
    assert rd.offline_scan(spark, gone, missing_ok=True).count() == 0


def test_batch_job_skips_completed_runs(spark, tmp_path):
    df = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    args = (df, lambda b: b["x"] / 20, ["x"], "v1", str(tmp_path / "out"), str(tmp_path / "manifest"), "r1")
    assert md.run_batch_job(*args) and not md.run_batch_job(*args) and md.run_batch_job(*args, force=True)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 20 and out.where("predicted_label = 1").count() == 10


def test_governance(spark):
    parts = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    runs = spark.createDataFrame([("a", "failed"), ("a", "completed"), ("b", "failed")], "p string, status string")
    got = {r["p"]: (r["status"], r["run"]) for r in gv.backfill_plan(parts, runs, "p", rerun_failed=False).collect()}
    assert got == {"a": ("complete", False), "b": ("failed", False), "c": ("missing", True)}
    mats = spark.createDataFrame([("raw", "x"), ("model", "")], "asset string, checksum string")
    assert sorted((r["asset"], r["issue"]) for r in gv.lineage_audit(mats, ["raw", "report"]).collect()) == [("model", "missing_checksum"), ("report", "missing_asset")]
    old = spark.createDataFrame([("a", "bigint", True, False), ("b", "string", False, True), ("c", "bigint", True, False)], "field string, type string, required boolean, nullable boolean")
    new = spark.createDataFrame([("a", "string", False, False), ("b", "string", False, False), ("d", "bigint", False, False)], "field string, type string, required boolean, nullable boolean")
    assert sorted((r["field"], r["change"]) for r in gv.schema_compat(old, new).collect()) == [
        ("a", "became_optional"), ("a", "type_changed"), ("b", "became_non_nullable"), ("c", "removed_required"), ("d", "added_optional")]
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    assert gv.idempotent([df, df.repartition(5)]).first()["idempotent"] and not gv.idempotent([df, df.where("id > 0")]).first()["idempotent"]


def test_profile_store_and_alignment(spark, tmp_path):
    from tidemark.operators.profile import column_profile

    df = spark.createDataFrame([(1.0, 2.0), (3.0, None)], "x double, y double")
    wr.save_profile(column_profile(df), str(tmp_path / "p"), "v1")
    wr.save_profile(column_profile(df.where("x > 1")), str(tmp_path / "p"), "v2")
    loaded = wr.load_profile(spark, str(tmp_path / "p"), "v2")
    assert {r["column"]: r["n_rows"] for r in loaded.collect()} == {"x": 1, "y": 1}
    assert sorted(tuple(r) for r in wr.alignment(loaded, df.drop("y").withColumn("z", F.lit(1))).collect()) == [("y", "missing"), ("z", "extra")]


def plain_isotonic(points):
    """Greatest least mean: the best rising fit at each distinct score."""
    merged = {}
    for x, y in points:
        n, t = merged.get(x, (0, 0.0))
        merged[x] = (n + 1, t + y)
    xs = sorted(merged)
    n = np.cumsum([0] + [merged[x][0] for x in xs])
    t = np.cumsum([0] + [merged[x][1] for x in xs])
    mean = lambda j, k: (t[k + 1] - t[j]) / (n[k + 1] - n[j])
    ys = [max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i in range(len(xs))]
    return xs, ys


@pytest.mark.parametrize(("most", "sent"), [(10, 0), (9, 1000)])
def test_isotonic_over_ranges(spark, most, sent):
    """Pooling reaches over range borders; sent blocks and the sorted join read the same line."""
    rng = random.Random(most)
    for shape in (lambda x: x, lambda x: 1 - x, lambda x: float(x > 0.6)):
        points = [(x, float(rng.random() < shape(x))) for x in (round(rng.random(), 2) for _ in range(400))]
        held = spark.createDataFrame([*points, (None, 1.0), (float("nan"), 0.0), (0.5, None)], "s double, y double")
        fit = cal.fit_isotonic(held, "y", "s", most)
        xs, ys = plain_isotonic(points)
        asked = [*xs, 0.0, -3.0, 1.5, 0.333, 0.0055, 0.9999]
        df = spark.createDataFrame([(k, x) for k, x in enumerate(asked)] + [(-1, None), (-2, float("nan"))], "k int, s double")
        got = {r["k"]: r["calibrated"] for r in cal.apply_isotonic(df, fit, "s", sent=sent).collect()}
        assert got.pop(-1) is None and got.pop(-2) is None
        assert [got[k] for k in range(len(asked))] == pytest.approx(np.interp(asked, xs, ys).tolist())
    none = cal.fit_isotonic(held.where("false"), "y", "s")
    assert {r["calibrated"] for r in cal.apply_isotonic(df, none, "s", sent=sent).collect()} == {None}


def test_calibration_and_outliers(spark):
    rows = [(float(i) / 200, int(i > 120)) for i in range(200)]
    df = spark.createDataFrame(rows, "score double, y int")
    for method in ("isotonic", "sigmoid"):
        out = md.calibrate_scores(df, md.fit_calibrator(df, "y", "score", method), "score").agg(F.min("calibrated"), F.max("calibrated")).first()
        assert 0.0 <= out[0] <= out[1] <= 1.0
    train = spark.range(2000).select((F.rand(1) - 0.5).alias("a"), (F.rand(2) - 0.5).alias("b"))
    far = spark.createDataFrame([(9.0, 9.0)] * 10, "a double, b double")
    near = md.outlier_report(train, train, ["a", "b"], trees=20).first()
    assert near["ood_fraction"] == pytest.approx(0.05, abs=0.02)
    assert md.outlier_report(train, far, ["a", "b"], trees=20).first()["ood_fraction"] == 1.0
