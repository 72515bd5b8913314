"""The real contracts of the credit data: raw rows, features and label batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import contracts as ct
from tidemark.operators import features as ft
from tidemark.plans.governance import _RAW_SQL, raw_rows
from tidemark.plans.registry import Tables, query

_DELAYS = "[PAY_0, PAY_2, PAY_3, PAY_4, PAY_5, PAY_6]"
_DERIVED_SQL = f"""{_RAW_SQL}, rows AS (
    SELECT *, BILL_AMT1 / (LIMIT_BAL + 1) AS utilization_rate, PAY_AMT1 / (abs(BILL_AMT1) + 1) AS payment_ratio, list_max({_DELAYS})::double AS max_delay,
           list_avg({_DELAYS}) AS avg_delay, len(list_filter({_DELAYS}, lambda v: v > 0))::double AS consecutive_delays,
           (BILL_AMT1 - BILL_AMT6) / (abs(BILL_AMT6) + 1) AS bill_trend,
           ({' + '.join(f'PAY_AMT{k}' for k in range(1, 7))}) / ({' + '.join(f'abs(BILL_AMT{k})' for k in range(1, 7))} + 1) AS total_payment_ratio
    FROM raw)"""
_LABEL_SQL = """rows AS (
    SELECT l_orderkey - 20 AS applicant_id, l_linenumber % 3 AS label, CASE WHEN l_returnflag = 'R' THEN 'other' ELSE 'synthetic' END AS label_source,
           CASE WHEN l_tax > 0 THEN 'p1' END AS policy_version, 'a' AS label_timestamp, 'b' AS observation_date, 'c' AS outcome_date, l_discount > 0 AS is_corrected
    FROM lineitem)"""


def contract_sql(contract: ct.Contract, rows: str, key: str) -> str:
    """The violations of every rule as one union, in SQL."""
    parts = []
    for r in contract.rules:
        value = f"try_cast({r.column} AS {r.type})"
        conds = {"type": f"{r.column} IS NOT NULL AND {value} IS NULL"}
        if not r.nullable:
            conds["not_null"] = f"{r.column} IS NULL"
        if r.low is not None and r.high is not None:
            conds["range"] = f"{value} NOT BETWEEN {r.low} AND {r.high}"
        elif r.low is not None:
            conds["low"] = f"{value} < {r.low}"
        elif r.high is not None:
            conds["high"] = f"{value} > {r.high}"
        if r.above is not None:
            conds["above"] = f"{value} <= {r.above}"
        if r.allowed:
            conds["allowed"] = f"{value} NOT IN ({', '.join(map(repr, r.allowed))})"
        if r.unique:
            conds["unique"] = f"{r.column} IN (SELECT {r.column} FROM rows GROUP BY 1 HAVING count(*) > 1)"
        parts += [f"""SELECT {key}, '{r.column}' AS "column", '{n}' AS "check" FROM rows WHERE {c}""" for n, c in conds.items()]
    return f"WITH {rows} " + " UNION ALL ".join(parts)


@query("p5_raw_contract", contract_sql(ct.RAW_CONTRACT, f"{_RAW_SQL}, rows AS (SELECT * FROM raw)", "ID AS id"))
def raw_contract(t: Tables):
    """Violations of the 25-column raw contract."""
    return ct.row_violations(raw_rows(t), ct.RAW_CONTRACT, ["ID"]).drop("value").withColumnRenamed("ID", "id")


@query("p5_feature_contract", contract_sql(ct.FEATURE_CONTRACT, _DERIVED_SQL, "ID AS id"))
def feature_contract(t: Tables):
    """Violations of the 32-column feature contract."""
    return ct.row_violations(ft.derive_features(raw_rows(t)), ct.FEATURE_CONTRACT, ["ID"]).drop("value").withColumnRenamed("ID", "id")


@query("p5_label_contract", contract_sql(ct.LABEL_CONTRACT, _LABEL_SQL, "applicant_id"))
def label_contract(t: Tables):
    """Violations of the 8-column label batch contract."""
    rows = t.spread("lineitem").select(
        (F.col("l_orderkey") - 20).alias("applicant_id"), (F.col("l_linenumber") % 3).alias("label"),
        F.when(F.col("l_returnflag") == "R", "other").otherwise("synthetic").alias("label_source"), F.when(F.col("l_tax") > 0, "p1").alias("policy_version"),
        F.lit("a").alias("label_timestamp"), F.lit("b").alias("observation_date"), F.lit("c").alias("outcome_date"), (F.col("l_discount") > 0).alias("is_corrected"),
    )
    return ct.row_violations(rows, ct.LABEL_CONTRACT, ["applicant_id"]).drop("value")
