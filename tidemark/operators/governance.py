"""Lineage, backfill, payload compatibility and table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Assets a complete training run leaves behind.
REQUIRED_ASSETS = (
    "raw_credit_data", "validated_data", "feature_dataset", "trained_model", "validation_report", "champion_model",
)
TRACE_FIELDS = ("prediction_id", "model_version", "mlflow_run_id", "code_sha", "data_version", "artifact_sha256")
PROVENANCE_FIELDS = ("answer_id", "prompt_version", "embedding_model", "index_version_id", "llm_version")


def backfill_plan(partitions: DataFrame, manifest: DataFrame, key: str, rerun_failed: bool = True) -> DataFrame:
    """Status and whether to run, per partition; a completed run wins over a failed one."""
    state = manifest.groupBy(key).agg(
        F.bool_or(F.col("status") == "completed").alias("_done"), F.bool_or(F.col("status") == "failed").alias("_bad")
    )
    out = partitions.join(state, key, "left")
    status = F.when(F.col("_done"), "complete").when(F.col("_bad"), "failed").otherwise("missing")
    run = (F.col("status") == "missing") | ((F.col("status") == "failed") & F.lit(rerun_failed))
    return out.withColumn("status", status).withColumn("run", run).drop("_done", "_bad")


def lineage_audit(materialisations: DataFrame, required: Sequence[str] = REQUIRED_ASSETS, asset: str = "asset", checksum: str = "checksum") -> DataFrame:
    """One row per issue: a required asset is absent or an asset has no checksum."""
    spark = materialisations.sparkSession
    wanted = spark.createDataFrame([(a,) for a in required], f"{asset} string")
    absent = wanted.join(materialisations.select(asset), asset, "left_anti").select(
        asset, F.lit("missing_asset").alias("issue")
    )
    bare = materialisations.where(F.col(checksum).isNull() | (F.col(checksum) == "")).select(
        asset, F.lit("missing_checksum").alias("issue")
    ).distinct()
    return absent.unionByName(bare)


def _filled(df: DataFrame, columns: Sequence[str]):
    """True where every text is non-empty and every array or map holds something."""
    ok = F.lit(True)
    kinds = dict(df.dtypes)
    for c in columns:
        held = F.size(c) > 0 if kinds[c].startswith(("array", "map")) else F.col(c) != ""
        ok = ok & F.coalesce(held, F.lit(False))
    return ok


def traceability(df: DataFrame, fields: Sequence[str] = TRACE_FIELDS, features: str = "features") -> DataFrame:
    """Add whether a prediction can be traced to code, data, model and features."""
    return df.withColumn("fully_traceable", _filled(df, [*fields, features]))


def provenance_gate(df: DataFrame, min_eval_score: float = 0.7) -> DataFrame:
    """Four checks over a provenance log in one pass: (check, passed, n_failed)."""
    complete = _filled(df, [*PROVENANCE_FIELDS, "retrieved_chunk_ids"]) & F.col("guardrails_active")
    failed = {
        "provenance_complete": ~complete, "eval_threshold": F.col("eval_score") < min_eval_score,
        "guardrails_active": ~F.col("guardrails_active"), "cost_tracked": F.col("cost_usd") <= 0,
    }
    wide = df.agg(*[F.count_if(c).alias(n) for n, c in failed.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_failed")) for n in failed])
    return wide.select(F.explode(rows).alias("r")).select("r.*").withColumn("passed", F.col("n_failed") == 0)


def observed_schema(df: DataFrame, payload: str, period: str) -> DataFrame:
    """Fields of a JSON column per period: type, always present, ever null."""
    total = df.groupBy(period).agg(F.count("*").alias("_n"))
    fields = df.select(period, F.explode(F.from_json(payload, "map<string,variant>")).alias("field", "_v"))
    kind = F.regexp_extract(F.schema_of_variant("_v"), "^[A-Z]+", 0)
    seen = fields.select(period, "field", F.when(kind != "VOID", F.lower(kind)).alias("_type"))
    out = seen.groupBy(period, "field").agg(
        F.count("*").alias("_present"), F.min("_type").alias("_t1"), F.max("_type").alias("_t2"),
        F.bool_or(F.col("_type").isNull()).alias("nullable"),
    ).join(F.broadcast(total), period)  # one row per period
    same = F.coalesce(F.col("_t1"), F.lit("null"))
    return out.select(
        period, "field", F.when(F.col("_t1") == F.col("_t2"), same).when(F.col("_t1").isNull(), "null").otherwise("mixed").alias("type"),
        (F.col("_present") == F.col("_n")).alias("required"), "nullable",
    )


def schema_compat(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, change, kind) between two field tables; kind is breaking, warning or compatible."""
    o = old.select("field", F.col("type").alias("o_type"), F.col("required").alias("o_req"), F.col("nullable").alias("o_null"))
    n = new.select("field", F.col("type").alias("n_type"), F.col("required").alias("n_req"), F.col("nullable").alias("n_null"))
    both = o.join(n, "field", "full_outer")
    gone, added = F.col("n_type").isNull(), F.col("o_type").isNull()
    kept = ~gone & ~added

    def change(cond, name: str, kind: str):
        return F.when(cond, F.struct(F.lit(name).alias("change"), F.lit(kind).alias("kind")))

    changes = F.array(
        change(gone & F.col("o_req"), "removed_required", "breaking"),
        change(gone & ~F.col("o_req"), "removed_optional", "warning"),
        change(added & F.col("n_req"), "added_required", "breaking"),
        change(added & ~F.col("n_req"), "added_optional", "compatible"),
        change(kept & (F.col("o_type") != F.col("n_type")), "type_changed", "breaking"),
        change(kept & ~F.col("o_req") & F.col("n_req"), "became_required", "breaking"),
        change(kept & F.col("o_req") & ~F.col("n_req"), "became_optional", "compatible"),
        change(kept & F.col("o_null") & ~F.col("n_null"), "became_non_nullable", "breaking"),
        change(kept & ~F.col("o_null") & F.col("n_null"), "became_nullable", "compatible"),
    )
    return both.select("field", F.explode(F.filter(changes, lambda c: c.isNotNull())).alias("c")).select("field", "c.*")


def row_number_of(columns: Sequence[str]) -> Column:
    """A number of 60 bits from the MD5 of a row; nulls are marked and texts carry their length."""
    parts = []
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        parts.append(F.when(text.isNull(), "~").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-insensitive content sum; equal tables give equal rows."""
    content = F.sum(row_number_of(df.columns))
    out = df.agg(F.count("*").alias("n_rows"), F.coalesce(content, F.lit(0).cast("decimal(38,0)")).alias("content"))
    return out.withColumn("fingerprint", F.sha2(F.concat_ws(":", "n_rows", "content"), 256))


def idempotent(runs: Sequence[DataFrame]) -> DataFrame:
    """Whether several runs produced the same table."""
    prints = None
    for i, run in enumerate(runs):
        one = table_fingerprint(run).select(F.lit(i).alias("run"), "n_rows", "fingerprint")
        prints = one if prints is None else prints.unionByName(one)
    return prints.agg(
        F.count("*").alias("n_runs"), F.count_distinct("fingerprint").alias("n_distinct"), F.min("n_rows").alias("min_rows"),
        F.max("n_rows").alias("max_rows"),
    ).withColumn("idempotent", F.col("n_distinct") == 1)
