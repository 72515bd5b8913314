"""The registered queries: names, coverage and agreement with SQL at the smallest scale."""

import os

import pytest
from harness import check, duck

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
INVENTORY = (
    [f"s{i}" for i in range(1, 8)] + [f"p{i}" for i in range(1, 16)] + [f"j{i}" for i in range(1, 14)] + [f"a{i}" for i in range(1, 53)]
    + [f"w{i}" for i in range(1, 9)] + [f"t{i}" for i in range(1, 6)] + [f"x{i}" for i in range(1, 6)] + [f"r{i}" for i in range(1, 8)]
    + [f"u{i}" for i in range(1, 7)]
)
ROWS_ONLY = {
    "x5_reference_text_scores", "u2_train_classifier", "u3_cross_validated_search", "u5_outlier_report",
}
# One query per area keeps the suite short; the harness runs all of them.
COMPARED = [
    "j1_point_in_time_join", "w3_incremental_backfill", "p5_row_contract_check", "a6_validation_gate", "a16_drift_report", "a25_threshold_sweep",
    "a32_champion_challenger", "j4_delayed_outcome_join", "a31_retrain_decision", "a36_slo_report", "t4_bm25_top_k", "a51_payload_schema_compat",
    "r2_push_latest_upsert", "t5_vector_index", "j10_semantic_cache_near", "r5_sliding_rate_limit", "a18_snapshot_skew", "a1_profile_by_day",
    "u4_calibrate_scores", "r2_push_latest_stream", "r4_hourly_windows_stream", "r6_ttl_state_stream", "r7_service_metrics_stream",
    "p10_injection_scan_many", "j1_point_in_time_stored", "j2_feature_service_stored",
]


def test_every_operator_is_registered():
    names = {n for n in entry_module.queries() if not n.startswith("op") and n != "pipeline"}
    assert {n.split("_")[0] for n in names} == set(INVENTORY)
    assert names - set(entry_module.oracle_sql()) == ROWS_ONLY


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, name):
    result = check(spark, duck(SF), SF, name, entry_module.queries(), entry_module.oracle_sql())
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_spread_tables_have_tasks_for_their_rows(spark, tmp_path, monkeypatch):
    """The tasks of a spread table follow its rows, so that none grows with the table; rows stay as they are."""
    from tidemark.plans import registry

    spark.range(1000).selectExpr("id % 300 AS k", "id").coalesce(1).write.parquet(f"{tmp_path}/lines.parquet")
    tables = registry.Tables(spark, str(tmp_path))
    assert tables.spread("lines").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(registry, "SPREAD_ROWS", 50)
    wide = tables.spread("lines")
    assert wide.rdd.getNumPartitions() == 20
    assert sorted(r["id"] for r in wide.collect()) == list(range(1000))
