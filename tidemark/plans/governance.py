"""Source, sink, lineage and fingerprint queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import drift as dr
from tidemark.operators import governance as gv
from tidemark.operators import profile as pf
from tidemark.plans.drift import FEATURES, LONG_SQL, PSI_SQL
from tidemark.plans.features import CREDIT_SQL, credit_rows
from tidemark.plans.quality import PAYLOAD_SQL, payload, periods
from tidemark.plans.registry import Tables, query
from tidemark.session import scratch_dir
from tidemark.sources import readers as rd
from tidemark.sources import writers as wr

_RAW_SQL = f"""raw AS (SELECT *, ID % 2 + 1 AS SEX, ID % 7 AS EDUCATION, ID % 4 AS MARRIAGE, ID % 60 + 20 AS AGE,
                (ID % 5 = 0)::int AS DEFAULT_PAYMENT_NEXT_MONTH FROM ({CREDIT_SQL}))"""


def raw_rows(t: Tables):
    """Lines as raw credit rows, with the remaining columns of the contract."""
    def mod(n: int):
        return F.pmod(F.col("ID"), F.lit(n))

    return credit_rows(t).withColumns({
        "SEX": mod(2) + 1, "EDUCATION": mod(7), "MARRIAGE": mod(4), "AGE": mod(60) + 20,
        "DEFAULT_PAYMENT_NEXT_MONTH": (mod(5) == 0).cast("int"),
    })


@query(
    "s1_raw_credit_scan",
    f"""WITH {_RAW_SQL} SELECT ID AS id, LIMIT_BAL AS limit_bal, PAY_0 AS pay_0, coalesce(PAY_2, -99)::bigint AS pay_2, EDUCATION AS education, AGE AS age,
        round(BILL_AMT1, 6) AS bill_amt1, DEFAULT_PAYMENT_NEXT_MONTH::bigint AS target FROM raw""",
)
def raw_credit_scan(t: Tables):
    """The lines as a CSV file with untidy column names, read back by the scan."""
    path = scratch_dir(t.spark, "raw-csv")
    rows = raw_rows(t).withColumnRenamed("PAY_0", "pay_1 ").withColumnRenamed("AGE", " age")
    rows.write.csv(path, header=True)
    out = rd.raw_credit_scan(t.spark, path, min_rows=1)
    return out.select(
        F.col("ID").alias("id"), F.col("LIMIT_BAL").alias("limit_bal"), F.col("PAY_0").alias("pay_0"),
        F.coalesce("PAY_2", F.lit(-99)).alias("pay_2"), F.col("EDUCATION").alias("education"), F.col("AGE").alias("age"),
        F.round("BILL_AMT1", 6).alias("bill_amt1"), F.col("DEFAULT_PAYMENT_NEXT_MONTH").alias("target"),
    )


@query(
    "s2_offline_scan",
    """SELECT event_id, user_id, epoch_us(ts) AS ts_us, value FROM events
       WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""",
)
def offline_scan(t: Tables):
    source = rd.DataSource("events", "parquet", f"{t.sf_dir}/events.parquet", "ts", "user_id")
    out = rd.offline_scan(t.spark, source, datetime(2024, 1, 5), datetime(2024, 1, 20, 12))
    return out.select("event_id", "user_id", F.unix_micros("ts").alias("ts_us"), "value")


@query(
    "s3_feature_sink",
    f"""WITH {_RAW_SQL}, c AS (SELECT ID, CASE WHEN EDUCATION IN (0, 5, 6) THEN 4 ELSE EDUCATION END AS education,
          CASE WHEN MARRIAGE = 0 THEN 3 ELSE MARRIAGE END AS marriage, BILL_AMT1 / (LIMIT_BAL + 1) AS u FROM raw)
        SELECT education::int AS education, marriage, count(*)::bigint AS n, round(avg(u), 6) AS utilization FROM c GROUP BY 1, 2""",
)
def feature_sink(t: Tables):
    """Written partitioned by education, read back and summarised."""
    path = scratch_dir(t.spark, "features")
    wr.write_features(raw_rows(t), path, ["EDUCATION"])
    return t.spark.read.parquet(path).groupBy(F.col("EDUCATION").alias("education"), F.col("MARRIAGE").alias("marriage")).agg(
        F.count("*").alias("n"), F.round(F.avg("utilization_rate"), 6).alias("utilization")
    )


@query(
    "s4_prediction_log",
    """WITH p AS (SELECT event_id, value / 300 AS score, json_extract(props, '$.k')::int AS k, event_type FROM events)
       SELECT event_id::varchar AS prediction_id, round(score, 9) AS score,
              CASE WHEN event_type = 'view' THEN 'malformed' WHEN event_type = 'signup' AND k < 50 THEN 'missing_key' WHEN score > 1 THEN 'score_range'
                   WHEN k = 7 THEN 'decision' ELSE '' END AS problem,
              coalesce(event_type = 'view' OR k % 10 = 3, false) AS bad_timestamp
       FROM p WHERE event_type <> 'view'
       UNION ALL SELECT '', NULL, 'malformed', true FROM p WHERE event_type = 'view'""",
)
def prediction_log(t: Tables):
    """Events as log lines; views are broken lines, some sign-ups lack a key."""
    path = scratch_dir(t.spark, "log")
    k = F.get_json_object("props", "$.k").cast("int")
    entry = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("prediction_id"), F.lit("c").alias("correlation_id"), F.col("user_id").cast("string").alias("entity_key"),
        F.when((F.col("event_type") != "signup") | (k >= 50), "v1").alias("model_version"), (F.col("value") / 300).alias("score"),
        F.when(k == 7, "maybe").otherwise("review").alias("decision"),
        F.when(F.pmod(k, F.lit(10)) == 3, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("prediction_ts"),
    ))
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("{broken "), F.col("event_id"))).otherwise(entry)
    t.events.select(line.alias("value")).write.text(path)
    log = rd.read_prediction_log(t.spark, path)
    return log.select(
        F.coalesce("prediction_id", F.lit("")).alias("prediction_id"), F.round("score", 9).alias("score"),
        F.coalesce("problem", F.lit("")).alias("problem"), "bad_timestamp",
    )


@query(
    "s5_stats_snapshot_store",
    f"""WITH {LONG_SQL}
        SELECT 'v2' AS model_version, feature AS "column", count(*)::bigint AS n_rows, (count(*) - count(v))::bigint AS n_null,
               round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(DISTINCT v)::bigint AS n_unique, round(quantile_cont(v, 0.5), 6) AS p50
        FROM long WHERE NOT is_ref GROUP BY 2""",
)
def snapshot_store(t: Tables):
    """Two versions saved, the second one loaded."""
    path = scratch_dir(t.spark, "profiles")
    for version, rows in zip(("v1", "v2"), periods(t)):
        wr.save_profile(pf.column_profile(rows), path, version)
    out = wr.load_profile(t.spark, path, "v2")
    return out.select("model_version", "column", "n_rows", "n_null", "n_unique", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50")])


@query(
    "s7_report_sink",
    f"""WITH {LONG_SQL}, {PSI_SQL} SELECT 'run-1' AS run_id, 'psi' AS "check", feature AS subject, round(psi, 6) AS value,
        CASE WHEN psi >= 0.2 THEN 'HIGH' ELSE 'NONE' END AS severity FROM psi""",
)
def report_sink(t: Tables):
    path = scratch_dir(t.spark, "reports")
    a, b = periods(t)
    psi = dr.psi_joint(dr.pair(a, b, FEATURES)).withColumn("severity", F.when(F.col("psi") >= 0.2, "HIGH").otherwise("NONE"))
    wr.append_report(wr.report_rows(psi, "run-1", "psi", "feature", "psi", "severity"), path)
    schema = "check string, subject string, value double, severity string, run_id string"
    return t.spark.read.schema(schema).json(path).withColumn("value", F.round("value", 6))


@query(
    "j12_backfill_plan",
    """WITH p AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders),
       m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, bool_or(o_orderkey % 50 = 0) AS done, bool_or(o_orderkey % 20 = 1) AS bad FROM orders GROUP BY 1)
       SELECT month, CASE WHEN done THEN 'complete' WHEN bad THEN 'failed' ELSE 'missing' END AS status, NOT done AS run FROM p LEFT JOIN m USING (month)""",
)
def backfill_plan(t: Tables):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    state = F.when(F.pmod("o_orderkey", F.lit(50)) == 0, "completed").when(F.pmod("o_orderkey", F.lit(20)) == 1, "failed")
    manifest = t.orders.select(month, state.alias("status"))
    return gv.backfill_plan(t.orders.select(month).distinct(), manifest, "month")


@query(
    "j13_lineage_audit",
    """WITH m AS (SELECT DISTINCT CASE quality * 2 + toxic WHEN 0 THEN 'raw_credit_data' WHEN 1 THEN 'validated_data' WHEN 2 THEN 'feature_dataset' ELSE 'trained_model' END AS asset,
                  quality * 2 + toxic = 1 AS bare FROM labels)
       SELECT asset, 'missing_asset' AS issue FROM (VALUES ('raw_credit_data'), ('validated_data'), ('feature_dataset'), ('trained_model'),
         ('validation_report'), ('champion_model')) v(asset) WHERE asset NOT IN (SELECT asset FROM m)
       UNION ALL SELECT asset, 'missing_checksum' FROM m WHERE bare""",
)
def lineage_audit(t: Tables):
    code = F.col("quality") * 2 + F.col("toxic")
    name = F.element_at(F.array(*[F.lit(a) for a in gv.REQUIRED_ASSETS[:4]]), code + 1)
    rows = t.labels.select(name.alias("asset"), F.when(code != 1, F.sha2(F.col("doc_id").cast("string"), 256)).otherwise("").alias("checksum"))
    return gv.lineage_audit(rows)


@query(
    "j13_provenance_gate",
    """WITH r AS (SELECT quality / 2 + 0.4 AS eval_score, toxic = 0 AS active, CASE WHEN d.doc_id % 11 = 0 THEN 0 ELSE 0.01 END AS cost,
         lang <> 'de' AND toxic = 0 AS complete FROM documents d JOIN labels USING (doc_id))
       SELECT "check", n_failed::bigint AS n_failed, passed FROM (SELECT 'provenance_complete' AS "check", count_if(NOT complete)::bigint AS n_failed, count_if(NOT complete) = 0 AS passed FROM r UNION ALL
         SELECT 'eval_threshold', count_if(eval_score < 0.7), count_if(eval_score < 0.7) = 0 FROM r UNION ALL
         SELECT 'guardrails_active', count_if(NOT active), count_if(NOT active) = 0 FROM r UNION ALL
         SELECT 'cost_tracked', count_if(cost <= 0), count_if(cost <= 0) = 0 FROM r)""",
)
def provenance_gate(t: Tables):
    rows = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("answer_id"), F.array(F.col("doc_id").cast("string")).alias("retrieved_chunk_ids"),
        F.lit("p1").alias("prompt_version"), F.when(F.col("lang") == "de", "").otherwise("encoder").alias("embedding_model"),
        F.lit("v1").alias("index_version_id"), F.lit("m1").alias("llm_version"), (F.col("quality") / 2 + 0.4).alias("eval_score"),
        F.when(F.pmod("doc_id", F.lit(11)) == 0, 0.0).otherwise(0.01).alias("cost_usd"), (F.col("toxic") == 0).alias("guardrails_active"),
    )
    return gv.provenance_gate(rows)


@query(
    "j13_traceability",
    """SELECT event_id::varchar AS prediction_id, event_type <> 'view' AND json_extract(props, '$.k')::int >= 10 AS fully_traceable FROM events""",
)
def traceability(t: Tables):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.select(
        F.col("event_id").cast("string").alias("prediction_id"), F.lit("v1").alias("model_version"), F.lit("run").alias("mlflow_run_id"),
        F.when(F.col("event_type") != "view", "abc").alias("code_sha"), F.lit("d1").alias("data_version"), F.lit("f00").alias("artifact_sha256"),
        F.when(k >= 10, F.create_map(F.lit("k"), k)).otherwise(F.create_map().cast("map<string,int>")).alias("features"),
    )
    return gv.traceability(rows).select("prediction_id", "fully_traceable")


@query(
    "a51_payload_schema_compat",
    f"""
    WITH {PAYLOAD_SQL}, q AS (SELECT CASE WHEN event_type IN ('click', 'purchase') THEN 'old' ELSE 'new' END AS period, payload
                              FROM p WHERE event_type <> 'signup'),
    n AS (SELECT period, count(*) AS n FROM q GROUP BY 1),
    f AS (SELECT period, unnest(json_keys(payload)) AS field, payload FROM q),
    k AS (SELECT period, field, json_type(payload, '$.' || field) AS t FROM f),
    c AS (SELECT period, field, CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'bigint' WHEN t = 'DOUBLE' THEN 'decimal' WHEN t = 'VARCHAR' THEN 'string' END AS t FROM k),
    s AS (SELECT period, field, min(t) AS t1, max(t) AS t2, count(*) AS present, bool_or(t IS NULL) AS nullable FROM c GROUP BY 1, 2),
    o AS (SELECT field, CASE WHEN t1 = t2 THEN t1 WHEN t1 IS NULL THEN 'null' ELSE 'mixed' END AS type, present = n AS required, nullable, period FROM s JOIN n USING (period)),
    j AS (SELECT coalesce(a.field, b.field) AS field, a.type AS ot, b.type AS nt, a.required AS oreq, b.required AS nreq, a.nullable AS onul, b.nullable AS nnul
          FROM (SELECT * FROM o WHERE period = 'old') a FULL OUTER JOIN (SELECT * FROM o WHERE period = 'new') b ON a.field = b.field)
    SELECT field, 'removed_required' AS change, 'breaking' AS kind FROM j WHERE nt IS NULL AND oreq UNION ALL
    SELECT field, 'removed_optional', 'warning' FROM j WHERE nt IS NULL AND NOT oreq UNION ALL
    SELECT field, 'added_required', 'breaking' FROM j WHERE ot IS NULL AND nreq UNION ALL
    SELECT field, 'added_optional', 'compatible' FROM j WHERE ot IS NULL AND NOT nreq UNION ALL
    SELECT field, 'type_changed', 'breaking' FROM j WHERE ot <> nt UNION ALL
    SELECT field, 'became_required', 'breaking' FROM j WHERE NOT oreq AND nreq UNION ALL
    SELECT field, 'became_optional', 'compatible' FROM j WHERE oreq AND NOT nreq UNION ALL
    SELECT field, 'became_non_nullable', 'breaking' FROM j WHERE onul AND NOT nnul UNION ALL
    SELECT field, 'became_nullable', 'compatible' FROM j WHERE NOT onul AND nnul
    """,
)
def payload_compat(t: Tables):
    """Clicks and purchases as the old period, errors and views as the new one."""
    rows = payload(t).where("event_type <> 'signup'").withColumn(
        "period", F.when(F.col("event_type").isin("click", "purchase"), "old").otherwise("new")
    )
    seen = gv.observed_schema(rows, "payload", "period")
    return gv.schema_compat(seen.where("period = 'old'"), seen.where("period = 'new'"))


# Columns whose texts are the same on every engine.
FINGERPRINTED = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "lineitem": ["l_orderkey", "l_linenumber", "l_returnflag"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


def _fingerprint_sql(name: str, columns: list[str]) -> str:
    parts = " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '~')" for c in columns)
    number = f"coalesce(sum(('0x' || substr(md5({parts}), 1, 15))::bigint), 0)"
    return f"""SELECT '{name}' AS "table", count(*) AS n_rows, sha256(count(*) || ':' || {number}) AS fingerprint FROM {name}"""


@query("a52_table_fingerprint", " UNION ALL ".join(_fingerprint_sql(n, c) for n, c in FINGERPRINTED.items()))
def table_fingerprint(t: Tables):
    out = None
    for name, columns in FINGERPRINTED.items():
        one = gv.table_fingerprint(getattr(t, name).select(*columns)).select(F.lit(name).alias("table"), "n_rows", "fingerprint")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "a52_idempotency",
    "SELECT 2::bigint AS n_runs, 1::bigint AS n_distinct, count(*)::bigint AS min_rows, count(*)::bigint AS max_rows, true AS idempotent FROM orders",
)
def idempotency(t: Tables):
    """The same table in two row orders."""
    return gv.idempotent([t.orders, t.orders.repartition(7, "o_custkey")])
