"""Profile and contract queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import contracts as ct
from tidemark.operators import profile as pf
from tidemark.operators import sketches as sk
from tidemark.plans.registry import Tables, query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(template: str, names, sep=" UNION ALL ") -> str:
    return sep.join(template.replace("{c}", n) for n in names)


@query(
    "a1_column_profile",
    _each(
        """SELECT '{c}' AS "column", count(*)::bigint AS n_rows, (count(*) - count({c}))::bigint AS n_null,
           round((count(*) - count({c})) / count(*), 9)::double AS null_rate, count(DISTINCT {c})::bigint AS n_unique,
           round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
           round(quantile_cont({c}, 0.05), 6) AS p5, round(quantile_cont({c}, 0.25), 6) AS p25,
           round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
           round(quantile_cont({c}, 0.95), 6) AS p95
           FROM (SELECT l_quantity, l_extendedprice, CASE WHEN l_discount > 0 THEN l_discount END AS l_discount, l_tax
                 FROM lineitem)""",
        NUMBERS,
    )
    + """ UNION ALL SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), 0.0, count(DISTINCT l_returnflag),
         NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem""",
)
def column_profile(t: Tables):
    rows = t.spread("lineitem").select(
        "l_quantity", "l_extendedprice", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"),
        "l_tax", "l_returnflag",
    )
    out = pf.column_profile(rows)
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "std", *pf.PROFILE_QUANTILES)]
    return out.select("column", "n_rows", "n_null", F.round("null_rate", 9).alias("null_rate"), "n_unique", *rounded)


@query(
    "a1_profile_by_day",
    _each(
        """SELECT '{c}' AS "column", count(*)::bigint AS n_rows, (count(*) - count({c}))::bigint AS n_null,
           round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, true AS n_unique_close, true AS quantiles_close
           FROM (SELECT l_quantity, l_extendedprice, CASE WHEN l_discount > 0 THEN l_discount END AS l_discount, l_tax FROM lineitem)""",
        NUMBERS,
    )
    + """ UNION ALL SELECT 'l_returnflag', count(*), count(*) - count(l_returnflag), NULL, NULL, true, true FROM lineitem""",
)
def profile_by_day(t: Tables):
    """One row of sketches per ship date and column, merged over all days; estimates held against exact values."""
    rows = t.lineitem.select(
        "l_quantity", "l_extendedprice", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"), "l_tax", "l_returnflag", "l_shipdate")
    out = sk.sketched_profile(sk.merge_profiles(sk.profile_sketches(rows, by=["l_shipdate"])))
    exact = pf.column_profile(rows.drop("l_shipdate")).select("column", F.col("n_unique").alias("exact_unique"))
    bounds = sk.exact_bounds(rows, NUMBERS, 2 * sk.rank_error())
    held = F.lit(True)
    for q in pf.PROFILE_QUANTILES:
        held = held & F.coalesce(F.col(q).between(F.col(f"{q}_low"), F.col(f"{q}_high")), F.col(q).isNull())
    close = F.abs(F.col("n_unique") / F.col("exact_unique") - 1) <= 0.04  # five standard errors
    return out.join(exact, "column").join(bounds, "column", "left").select(
        "column", "n_rows", "n_null", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), close.alias("n_unique_close"), held.alias("quantiles_close"))


def periods(t: Tables, *columns: str):
    """Events of the first and of the later days, with a nullable amount and an hour."""
    rows = t.events.select(
        "ts",
        F.when(F.col("value") <= 100, F.col("value")).alias("amount"),
        F.when((F.col("event_type") != "error") | (F.dayofmonth("ts") <= 15), F.hour("ts").cast("double")).alias("hour"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    rows = rows.withColumn("k", F.when(F.dayofmonth("ts") > 15, F.col("k") * 1.5).otherwise(F.col("k")))
    first = F.dayofmonth("ts") <= 15
    columns = columns or ("amount", "hour", "k")
    return rows.where(first).select(*columns), rows.where(~first).select(*columns)


PERIODS_SQL = """
    base AS (SELECT day(ts) <= 15 AS is_ref, CASE WHEN value <= 100 THEN value END AS amount,
                    CASE WHEN event_type <> 'error' OR day(ts) <= 15 THEN hour(ts)::double END AS hour,
                    json_extract(props, '$.k')::double * CASE WHEN day(ts) > 15 THEN 1.5 ELSE 1 END AS k FROM events),
    long AS (SELECT is_ref, 'amount' AS feature, amount AS v FROM base UNION ALL
             SELECT is_ref, 'hour', hour FROM base UNION ALL SELECT is_ref, 'k', k FROM base)
"""


@query(
    "a2_null_drift",
    f"""
    WITH {PERIODS_SQL}, r AS (SELECT feature, is_ref, 1 - count(v) / count(*) AS rate FROM long GROUP BY 1, 2)
    SELECT a.feature AS "column", round(a.rate, 9) AS reference_rate, round(b.rate, 9) AS current_rate,
           round(abs(b.rate - a.rate), 9) AS drift, abs(b.rate - a.rate) > 0.05 AS flag
    FROM r a JOIN r b ON a.feature = b.feature AND a.is_ref AND NOT b.is_ref
    """,
)
def null_drift(t: Tables):
    a, b = periods(t)
    out = pf.null_drift(pf.moments(a, a.columns), pf.moments(b, b.columns))
    return out.select("column", *[F.round(c, 9).alias(c) for c in ("reference_rate", "current_rate", "drift")], "flag")


@query(
    "a3_mean_drift",
    f"""
    WITH {PERIODS_SQL}, r AS (SELECT feature, is_ref, avg(v) AS m, stddev_samp(v) AS s FROM long GROUP BY 1, 2),
    z AS (SELECT a.feature, a.m AS rm, a.s AS rs, b.m AS cm, abs(b.m - a.m) / (a.s + 1e-8) AS z
          FROM r a JOIN r b ON a.feature = b.feature AND a.is_ref AND NOT b.is_ref)
    SELECT feature AS "column", round(rm, 6) AS reference_mean, round(rs, 6) AS reference_std, round(cm, 6) AS current_mean,
           round(z, 6) AS z, CASE WHEN z <= 2 THEN 'ok' WHEN z <= 3 THEN 'warn' ELSE 'critical' END AS severity,
           z > 3 AS flag FROM z
    """,
)
def mean_drift(t: Tables):
    a, b = periods(t)
    out = pf.mean_drift(pf.moments(a, a.columns), pf.moments(b, b.columns))
    numbers = ("reference_mean", "reference_std", "current_mean", "z")
    return out.select("column", *[F.round(c, 6).alias(c) for c in numbers], "severity", "flag")


@query(
    "a4_class_balance",
    """
    WITH r AS (SELECT avg(toxic) AS p, count(toxic)::bigint AS n FROM labels)
    SELECT n, round(p, 9) AS positive_rate, range_name, low, high, p BETWEEN low AND high AS passed
    FROM r, (VALUES ('profile', 0.10::double, 0.40::double), ('raw', 0.15, 0.30), ('contract', 0.05, 0.40)) v(range_name, low, high)
    """,
)
def class_balance(t: Tables):
    out = pf.class_balance(t.labels, "toxic")
    return out.withColumn("positive_rate", F.round("positive_rate", 9))


STATS = [
    ct.StatCheck("min_rows", low=100), ct.StatCheck("null_rate", "l_discount", high=0.05),
    ct.StatCheck("positive_rate", "returned", 0.01, 0.7), ct.StatCheck("mean_range", "l_extendedprice", 5000, 40000),
    ct.StatCheck("std_positive", "l_tax"), ct.StatCheck("std_positive", "one"), ct.StatCheck("no_inf", "ratio"),
    ct.StatCheck("null_rate", "absent", high=0.0),
]


def stat_rows(t: Tables):
    return t.lineitem.select(
        "l_extendedprice", "l_tax", "l_quantity", "l_returnflag",
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"), F.lit(1.0).alias("one"),
        F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(float("inf")).alias("ratio"),
    )


STAT_SQL = """
    rows AS (SELECT l_extendedprice, l_tax, l_quantity, l_returnflag, CASE WHEN l_discount > 0 THEN l_discount END AS l_discount,
             (l_returnflag = 'R')::int AS returned, 1.0::double AS one,
             CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 'inf'::double END AS ratio FROM lineitem),
    stats AS (
      SELECT '' AS "column", 'min_rows' AS "check", count(*)::double AS value, count(*) >= 100 AS passed FROM rows UNION ALL
      SELECT 'l_discount', 'null_rate', 1 - count(l_discount) / count(*), 1 - count(l_discount) / count(*) <= 0.05 FROM rows UNION ALL
      SELECT 'returned', 'positive_rate', avg(returned), avg(returned) BETWEEN 0.01 AND 0.7 FROM rows UNION ALL
      SELECT 'l_extendedprice', 'mean_range', avg(l_extendedprice), avg(l_extendedprice) BETWEEN 5000 AND 40000 FROM rows UNION ALL
      SELECT 'l_tax', 'std_positive', stddev_samp(l_tax), stddev_samp(l_tax) > 0 FROM rows UNION ALL
      SELECT 'one', 'std_positive', stddev_samp(one), stddev_samp(one) > 0 FROM rows UNION ALL
      SELECT 'ratio', 'no_inf', count_if(isinf(ratio))::double, count_if(isinf(ratio)) = 0 FROM rows)
"""


@query(
    "a5_statistical_checks",
    f"""WITH {STAT_SQL} SELECT "column", "check", round(value, 6) AS value, passed FROM stats""",
)
def statistical_checks(t: Tables):
    return ct.statistical_checks(stat_rows(t), STATS).withColumn("value", F.round("value", 6))


GATE_RULES = [
    ct.Rule("l_extendedprice", "double", low=1000, high=90000), ct.Rule("l_discount", "double"),
    ct.Rule("l_returnflag", "string", allowed=("A", "N")), ct.Rule("l_quantity", "int", low=2, high=49),
    ct.Rule("absent", "int"), ct.Rule("optional", "int", required=False),
]
_SCHEMA_SQL = """
    SELECT 'l_extendedprice' AS "column", 'type' AS "check", 0::bigint AS n_failed UNION ALL
    SELECT 'l_extendedprice', 'null', count_if(l_extendedprice IS NULL) FROM rows UNION ALL
    SELECT 'l_extendedprice', 'below_min', count_if(l_extendedprice < 1000) FROM rows UNION ALL
    SELECT 'l_extendedprice', 'above_max', count_if(l_extendedprice > 90000) FROM rows UNION ALL
    SELECT 'l_discount', 'type', 0 UNION ALL SELECT 'l_discount', 'null', count_if(l_discount IS NULL) FROM rows UNION ALL
    SELECT 'l_returnflag', 'type', 0 UNION ALL SELECT 'l_returnflag', 'null', count_if(l_returnflag IS NULL) FROM rows UNION ALL
    SELECT 'l_returnflag', 'not_allowed', count_if(l_returnflag NOT IN ('A', 'N')) FROM rows UNION ALL
    SELECT 'l_quantity', 'type', 0 UNION ALL SELECT 'l_quantity', 'null', count_if(l_quantity IS NULL) FROM rows UNION ALL
    SELECT 'l_quantity', 'below_min', count_if(l_quantity < 2) FROM rows UNION ALL
    SELECT 'l_quantity', 'above_max', count_if(l_quantity > 49) FROM rows UNION ALL
    SELECT 'absent', 'missing', 1
"""


@query(
    "p6_schema_check",
    f"""WITH {STAT_SQL}, s AS ({_SCHEMA_SQL})
        SELECT "column", "check", n_failed::bigint AS n_failed, n_failed = 0 AS passed FROM s""",
)
def schema_check(t: Tables):
    return ct.schema_check(stat_rows(t), GATE_RULES)


@query(
    "a6_validation_gate",
    f"""WITH {STAT_SQL}, s AS ({_SCHEMA_SQL})
        SELECT "column", "check", n_failed::double AS value, n_failed = 0 AS passed FROM s
        UNION ALL SELECT "column", "check", round(value, 6), passed FROM stats""",
)
def validation_gate(t: Tables):
    return ct.validation_gate(stat_rows(t), GATE_RULES, STATS).withColumn("value", F.round("value", 6))


@query(
    "a7_bounds_quality",
    """
    WITH rows AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_discount > 0 THEN l_discount END AS l_discount FROM lineitem)
    SELECT 'l_quantity' AS feature, 0.0::double AS null_rate, round(count_if(l_quantity > 45) / count(*), 9) AS out_of_range_rate,
           min(l_quantity) AS min_value, max(l_quantity) AS max_value, count_if(l_quantity > 45) = 0 AS passed FROM rows
    UNION ALL SELECT 'l_extendedprice', 0, 0, min(l_extendedprice), max(l_extendedprice), true FROM rows
    UNION ALL SELECT 'l_discount', round(1 - count(l_discount) / count(*), 9), 0, min(l_discount), max(l_discount),
           1 - count(l_discount) / count(*) <= 0.05 FROM rows
    UNION ALL SELECT 'absent', 1, 0, NULL, NULL, false
    """,
)
def bounds_quality(t: Tables):
    rows = t.lineitem.withColumn("l_discount", F.when(F.col("l_discount") > 0, F.col("l_discount")))
    out = ct.bounds_quality(
        rows,
        [("l_quantity", 0, 45, 0.0), ("l_extendedprice", 0, None, 0.05), ("l_discount", 0, 1, 0.05), ("absent", 0, 1, 0.05)],
    )
    return out.withColumns({c: F.round(c, 9) for c in ("null_rate", "out_of_range_rate")})


@query(
    "a8_null_quality_report",
    f"""
    WITH {PERIODS_SQL}, r AS (SELECT feature, count(*)::bigint AS n_rows, (count(*) - count(v))::bigint AS n_null FROM long GROUP BY 1)
    SELECT feature AS "column", n_rows, n_null, round(n_null / n_rows, 9) AS null_rate, n_null / n_rows > 0.05 AS failed,
           round(avg((n_null / n_rows > 0.05)::int) OVER (), 9) AS share_failed FROM r
    """,
)
def null_quality(t: Tables):
    a, b = periods(t)
    out = pf.null_quality_report(a.unionByName(b), a.columns)
    return out.withColumns({c: F.round(c, 9) for c in ("null_rate", "share_failed")})


@query(
    "p15_infinite_columns",
    """
    WITH rows AS (SELECT CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE '-inf'::double END AS ratio FROM lineitem)
    SELECT 'ratio' AS "column", count_if(isinf(ratio))::bigint AS n_infinite FROM rows HAVING count_if(isinf(ratio)) > 0
    """,
)
def infinite_columns(t: Tables):
    ratio = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(float("-inf"))
    return ct.infinite_columns(t.lineitem.withColumn("ratio", ratio))


LINE_CONTRACT = ct.Contract(
    "line",
    (
        ct.Rule("line_id", "bigint", above=0, unique=True), ct.Rule("l_extendedprice", "double", low=1000, high=90000),
        ct.Rule("l_discount", "double"), ct.Rule("l_returnflag", "string", allowed=("A", "N")),
        ct.Rule("code", "int"),
    ),
    created_at=datetime(2024, 1, 1), max_age_hours=24,
)


def line_rows(t: Tables):
    return t.spread("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), "l_partkey", "l_extendedprice", "l_returnflag",
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_tax") > 0, F.col("l_linenumber").cast("string")).otherwise(F.lit("none")).alias("code"),
    )


_LINES_SQL = """
    rows AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, l_partkey, l_extendedprice, l_returnflag,
             CASE WHEN l_discount > 0 THEN l_discount END AS l_discount,
             CASE WHEN l_tax > 0 THEN l_linenumber::varchar ELSE 'none' END AS code FROM lineitem),
    bad AS (
      SELECT line_id, l_partkey, 'line_id' AS "column", 'above' AS "check" FROM rows WHERE line_id <= 0 UNION ALL
      SELECT line_id, l_partkey, 'line_id', 'unique' FROM rows
        WHERE line_id IN (SELECT line_id FROM rows GROUP BY 1 HAVING count(*) > 1) UNION ALL
      SELECT line_id, l_partkey, 'l_extendedprice', 'range' FROM rows WHERE l_extendedprice NOT BETWEEN 1000 AND 90000 UNION ALL
      SELECT line_id, l_partkey, 'l_discount', 'not_null' FROM rows WHERE l_discount IS NULL UNION ALL
      SELECT line_id, l_partkey, 'l_returnflag', 'allowed' FROM rows WHERE l_returnflag NOT IN ('A', 'N') UNION ALL
      SELECT line_id, l_partkey, 'code', 'type' FROM rows WHERE try_cast(code AS int) IS NULL)
"""


@query("p5_row_contract_check", f"""WITH {_LINES_SQL} SELECT line_id, l_partkey, "column", "check" FROM bad""")
def row_contract(t: Tables):
    return ct.row_violations(line_rows(t), LINE_CONTRACT, ["line_id", "l_partkey"]).drop("value")


@query(
    "p7_contract_enforcement",
    f"""WITH {_LINES_SQL}, per_row AS (SELECT line_id, l_partkey, count(*) AS n FROM bad GROUP BY 1, 2)
        SELECT 'line' AS contract, '1' AS version, 'strict' AS mode, count(*)::bigint AS n_bad_rows, sum(n)::bigint AS n_violations,
               24.5::double AS age_hours, true AS is_stale, sum(n) = 0 AS passed FROM per_row""",
)
def contract_enforcement(t: Tables):
    return ct.enforce(line_rows(t), LINE_CONTRACT, ["line_id", "l_partkey"], datetime(2024, 1, 2, 0, 30)).summary


# One payload per event type: number, string, null, absent field, fraction for an integer.
def payload(t: Tables):
    amount = F.when(F.col("event_type") == "error", F.lit(', "last_tx_amount": "bad"')).when(
        F.col("event_type") == "signup", F.lit(', "last_tx_amount": null')
    ).when(F.col("event_type") == "view", F.lit("")).otherwise(
        F.concat(F.lit(', "last_tx_amount": '), F.col("value").cast("string"))
    )
    k = F.get_json_object("props", "$.k")
    count = F.when(F.col("event_type") == "click", F.concat(k, F.lit(".5"))).otherwise(k)
    return t.spread("events").select(
        "event_id", "user_id", "ts", "event_type",
        F.concat(F.lit('{"tx_count_last_hour": '), count, amount, F.lit("}")).alias("payload"),
    )


PAYLOAD_SQL = """
    p AS (SELECT event_id, user_id, ts, event_type, '{"tx_count_last_hour": ' || json_extract(props, '$.k')
            || CASE WHEN event_type = 'click' THEN '.5' ELSE '' END
            || CASE event_type WHEN 'error' THEN ', "last_tx_amount": "bad"' WHEN 'signup' THEN ', "last_tx_amount": null'
               WHEN 'view' THEN '' ELSE ', "last_tx_amount": ' || value END || '}' AS payload FROM events)
"""
PUSH_REQUIRED = ["tx_count_last_hour", "last_tx_amount"]
PUSH_FIELDS = {"tx_count_last_hour": "int", "last_tx_amount": "float", "session_duration_s": "float"}


@query(
    "p8_push_event_check",
    f"""
    WITH {PAYLOAD_SQL}, k AS (SELECT *, json_type(payload, '$.tx_count_last_hour') AS a, json_type(payload, '$.last_tx_amount') AS b FROM p)
    SELECT event_id, array_to_string(list_filter([
        CASE WHEN a IS NULL THEN 'missing:tx_count_last_hour' END, CASE WHEN b IS NULL THEN 'missing:last_tx_amount' END,
        CASE WHEN a NOT IN ('UBIGINT', 'BIGINT', 'BOOLEAN', 'NULL') THEN 'type:tx_count_last_hour:decimal' END,
        CASE WHEN b NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN', 'NULL') THEN 'type:last_tx_amount:string' END],
        lambda e: e IS NOT NULL), ';') AS errors FROM k
    """,
)
def push_event_check(t: Tables):
    out = ct.push_event_errors(payload(t), "payload", PUSH_REQUIRED, PUSH_FIELDS)
    return out.select("event_id", F.array_join("errors", ";").alias("errors"))


_FACETS = {
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
               ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
}


@query(
    "s6_dataset_facets",
    " UNION ALL ".join(
        f"""SELECT '{tab}' AS "table", '{c}' AS "column", '{k}' AS type, count(*)::bigint AS row_count,
            (count(*) - count({c}))::bigint AS null_count FROM {tab}"""
        for tab, cols in _FACETS.items() for c, k in cols
    ),
)
def dataset_facets(t: Tables):
    out = None
    for name in _FACETS:
        one = pf.dataset_facets(getattr(t, name), name)
        out = one if out is None else out.unionByName(one)
    return out
