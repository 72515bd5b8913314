"""Drift and skew queries: first half of the month against the second."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import contracts as ct
from tidemark.operators import drift as dr
from tidemark.operators import features as ft
from tidemark.operators import sketches as sk
from tidemark.plans.quality import PERIODS_SQL, periods
from tidemark.plans.registry import Tables, query

FEATURES = ["amount", "hour", "k"]
# Lines per feature without missing values.
LONG_SQL = f"{PERIODS_SQL}, lv AS (SELECT feature, is_ref, v FROM long WHERE v IS NOT NULL)"
_RANGE = """
    rg AS (SELECT feature, min(v) AS lo, max(v) AS hi, min(v) FILTER (is_ref) AS rlo, max(v) FILTER (is_ref) AS rhi,
                  count(*) FILTER (is_ref) AS n, count(*) FILTER (NOT is_ref) AS m FROM lv GROUP BY 1)"""


def _hist(lo: str, hi: str, where: str = "true") -> str:
    return f"""
    hb AS (SELECT feature, len(list_filter(range(1, 10), lambda i: v >= ({hi} - {lo}) / 10 * i + {lo})) AS bin, is_ref, n, m
           FROM lv JOIN rg USING (feature) WHERE {where}),
    hc AS (SELECT feature, bin, n, m, count_if(is_ref) AS r, count_if(NOT is_ref) AS c FROM hb GROUP BY 1, 2, 3, 4)"""


PSI_SQL = f"""{_RANGE}, {_hist('lo', '(hi + 1e-9)')},
    ps AS (SELECT feature, CASE WHEN r = 0 THEN 1e-9 ELSE r / n END AS p, CASE WHEN c = 0 THEN 1e-9 ELSE c / m END AS q FROM hc),
    psi AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM ps GROUP BY 1)"""
KS_SQL = """
    kd AS (SELECT feature, v, count_if(is_ref) AS r, count_if(NOT is_ref) AS c FROM lv GROUP BY 1, 2),
    kr AS (SELECT *, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER t AS n, sum(c) OVER t AS m FROM kd
           WINDOW w AS (PARTITION BY feature ORDER BY v), t AS (PARTITION BY feature)),
    ks AS (SELECT feature, any_value(n)::bigint AS n_ref, any_value(m)::bigint AS n_cur, max(abs(cr / n - cc / m)) AS ks FROM kr GROUP BY 1)"""
AUC_SQL = """
    ad AS (SELECT feature, v, count_if(NOT is_ref) AS pos, count_if(is_ref) AS neg FROM lv GROUP BY 1, 2),
    ar AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY v DESC) AS cn FROM ad),
    auc AS (SELECT feature, 1 - sum(pos * (cn - neg / 2)) / (sum(pos)::double * sum(neg)) AS auc FROM ar GROUP BY 1)"""


def period_rows(t: Tables):
    """Both periods as one long table."""
    a, b = periods(t)
    return dr.pair(a, b, FEATURES)


def keyed_periods(t: Tables):
    """The same two frames with the event id as row key."""
    rows = t.events.select(
        "event_id", "ts", F.when(F.col("value") <= 100, F.col("value")).alias("amount"),
        F.when((F.col("event_type") != "error") | (F.dayofmonth("ts") <= 15), F.hour("ts").cast("double")).alias("hour"),
        (F.get_json_object("props", "$.k").cast("double") * F.when(F.dayofmonth("ts") > 15, 1.5).otherwise(1.0)).alias("k"),
    )
    first = F.dayofmonth("ts") <= 15
    return rows.where(first).drop("ts"), rows.where(~first).drop("ts")


_MMD = f"""
    {PERIODS_SQL},
    mw AS (SELECT feature, w, sum(cos(w * v)) FILTER (is_ref) AS cx, sum(sin(w * v)) FILTER (is_ref) AS sx, sum(cos(w * v)) FILTER (NOT is_ref) AS cy,
             sum(sin(w * v)) FILTER (NOT is_ref) AS sy, count(*) FILTER (is_ref) AS n, count(*) FILTER (NOT is_ref) AS m
           FROM long, (SELECT unnest({dr.fourier_frequencies()}) AS w) WHERE v IS NOT NULL GROUP BY 1, 2),
    mk AS (SELECT feature, max(n)::double AS n, max(m)::double AS m, avg(cx * cx + sx * sx) AS xx, avg(cy * cy + sy * sy) AS yy, avg(cx * cy + sx * sy) AS xy FROM mw GROUP BY 1),
    mmd AS (SELECT feature, sqrt(abs((xx - n) / (n * (n - 1)) + (yy - m) / (m * (m - 1)) - 2 * xy / (n * m))) AS mmd FROM mk)
"""


@query("a9_psi_joint", f"WITH {LONG_SQL}, {PSI_SQL} SELECT feature, round(psi, 9) AS psi FROM psi")
def psi_joint(t: Tables):
    return dr.psi_joint(period_rows(t)).withColumn("psi", F.round("psi", 9))


@query(
    "a10_psi_reference",
    f"""WITH {LONG_SQL}, {_RANGE}, {_hist('rlo', 'rhi', 'v >= rlo - 1e-8 AND v <= rhi + 1e-8')},
        ps AS (SELECT feature, r / n + 1e-4 AS p, c / m + 1e-4 AS q FROM hc)
        SELECT feature, round(sum((q - p) * ln(q / p)), 9) AS psi FROM ps GROUP BY 1""",
)
def psi_reference(t: Tables):
    return dr.psi_reference(period_rows(t)).withColumn("psi", F.round("psi", 9))


@query("a11_ks_statistic", f"WITH {LONG_SQL}, {KS_SQL} SELECT feature, n_ref, n_cur, round(ks, 9) AS ks FROM ks")
def ks_statistic(t: Tables):
    return dr.ks_statistic(period_rows(t)).withColumn("ks", F.round("ks", 9))


@query(
    "a12_ks_test",
    f"""WITH {LONG_SQL}, {KS_SQL}, kt AS (SELECT *, ks * sqrt(n_ref::double * n_cur / (n_ref + n_cur)) AS t FROM ks)
        SELECT feature, n_ref, n_cur, round(ks, 9) AS ks, round(CASE WHEN t < 0.2 THEN 1.0 ELSE least(greatest(
          list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * t * t))), 0.0), 1.0) END, 9)::double AS p_value
        FROM kt""",
)
def ks_test(t: Tables):
    return dr.ks_test(period_rows(t)).withColumns({c: F.round(c, 9) for c in ("ks", "p_value")})


@query(
    "a13_js_distance",
    f"""WITH {LONG_SQL}, {_RANGE}, {_hist('lo', 'hi')},
        g AS (SELECT feature, n, m, unnest(range(0, 10)) AS bin FROM rg),
        f AS (SELECT g.feature, (coalesce(r, 0) + 1e-4) / (g.n + 1e-3) AS p, (coalesce(c, 0) + 1e-4) / (g.m + 1e-3) AS q
              FROM g LEFT JOIN hc ON g.feature = hc.feature AND g.bin = hc.bin)
        SELECT feature, round(sqrt(sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2)), 9) AS js_distance
        FROM f GROUP BY 1""",
)
def js_distance(t: Tables):
    return dr.js_distance(period_rows(t)).withColumn("js_distance", F.round("js_distance", 9))


@query("a14_mmd_rbf", f"WITH {_MMD} SELECT feature, round(mmd, 6) AS mmd FROM mmd")
def mmd_rbf(t: Tables):
    a, b = keyed_periods(t)
    return dr.mmd_rbf(dr.pair(a, b, FEATURES, ["event_id"])).withColumn("mmd", F.round("mmd", 6))


@query("a15_two_sample_auc", f"WITH {LONG_SQL}, {AUC_SQL} SELECT feature, round(auc, 9) AS classifier_auc FROM auc")
def two_sample_auc(t: Tables):
    return dr.two_sample_auc(period_rows(t)).withColumn("classifier_auc", F.round("classifier_auc", 9))


_REPORT = f"""{_MMD}, lv AS (SELECT feature, is_ref, v FROM long WHERE v IS NOT NULL), {PSI_SQL}, {KS_SQL}, {AUC_SQL},
    all_m AS (SELECT feature, 'psi' AS metric, psi AS value, 0.1 AS low, 0.2 AS high FROM psi UNION ALL
              SELECT feature, 'ks', ks, 0.05, 0.1 FROM ks UNION ALL SELECT feature, 'mmd', mmd, 0.05, 0.1 FROM mmd UNION ALL
              SELECT feature, 'classifier_auc', auc, 0.65, 0.7 FROM auc),
    rep AS (SELECT *, CASE WHEN value >= high THEN 'HIGH' WHEN value >= low THEN 'LOW' ELSE 'NONE' END AS severity FROM all_m)"""


@query(
    "a16_drift_report",
    f"""WITH {_REPORT} SELECT feature, metric, round(value, 6) AS value, high::double AS threshold, severity,
        severity <> 'NONE' AS drifted FROM rep""",
)
def drift_report(t: Tables):
    a, b = keyed_periods(t)
    return dr.drift_report(a, b, "event_id", FEATURES).withColumn("value", F.round("value", 6))


@query(
    "a16_drift_summary",
    f"""WITH {_REPORT}, f AS (SELECT feature, bool_or(severity <> 'NONE') AS d, bool_or(severity = 'HIGH') AS h FROM rep GROUP BY 1)
        SELECT count_if(d)::bigint AS n_drifted, count(*)::bigint AS n_tested, bool_or(h) AS overall_drifted,
               round(count_if(d) / count(*), 9) AS share_drifted, count_if(d) / count(*) <= 0.2 AS passed FROM f""",
)
def drift_summary(t: Tables):
    a, b = keyed_periods(t)
    out = dr.drift_summary(dr.drift_report(a, b, "event_id", FEATURES))
    return out.withColumn("share_drifted", F.round("share_drifted", 9))


_FEATURE_SKEW = f"""
    mo AS (SELECT feature, avg(v) FILTER (is_ref) AS tv, avg(v) FILTER (NOT is_ref) AS sv FROM lv GROUP BY 1),
    fs AS (SELECT 'feature' AS kind, feature, tv, sv, abs(tv - sv) AS d,
             CASE WHEN psi >= 0.2 OR abs(tv - sv) / (abs(tv) + 1e-9) >= 0.25 THEN 'HIGH'
                  WHEN psi >= 0.1 OR abs(tv - sv) / (abs(tv) + 1e-9) >= 0.1 THEN 'LOW' ELSE 'NONE' END AS severity
           FROM mo JOIN psi USING (feature))"""


@query(
    "a17_train_serve_skew",
    f"""WITH {LONG_SQL}, {PSI_SQL}, {_FEATURE_SKEW}
        SELECT 'schema' AS kind, 'segment' AS feature, 1.0::double AS train_value, 0.0::double AS serve_value, 1.0::double AS delta, 'HIGH' AS severity
        UNION ALL SELECT 'schema', 'trace', 0.0, 1.0, 1.0, 'LOW'
        UNION ALL SELECT kind, feature, round(tv, 6), round(sv, 6), round(d, 6), severity FROM fs WHERE severity <> 'NONE'""",
)
def train_serve_skew(t: Tables):
    a, b = periods(t)
    out = dr.train_serve_skew(a.withColumn("segment", F.lit("x")), b.withColumn("trace", F.lit("y")), FEATURES)
    return out.withColumns({c: F.round(c, 6) for c in ("train_value", "serve_value", "delta")})


@query(
    "j8_paired_prediction_skew",
    """
    WITH a AS (SELECT o_orderkey, o_totalprice / 600000 AS p FROM orders WHERE o_orderstatus <> 'P'),
    b AS (SELECT o_orderkey, o_totalprice / 600000 + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.005 ELSE 0 END AS q
          FROM orders WHERE o_orderstatus <> 'O')
    SELECT count(p)::bigint AS n_train, count(q)::bigint AS n_serve, count_if(p IS NULL OR q IS NULL)::bigint AS n_unmatched,
           round(avg(p), 9) AS train_value, round(avg(q), 9) AS serve_value, round(max(abs(p - q)), 9) AS max_delta,
           round(avg(abs(p - q)), 9) AS mean_delta, 'HIGH' AS severity
    FROM a FULL OUTER JOIN b USING (o_orderkey)
    """,
)
def prediction_skew(t: Tables):
    base = t.orders.withColumn("p", F.col("o_totalprice") / 600000)
    shift = F.when(F.col("o_orderpriority") == "1-URGENT", 0.005).otherwise(0.0)
    a = base.where("o_orderstatus <> 'P'")
    b = base.where("o_orderstatus <> 'O'").withColumn("p", F.col("p") + shift)
    out = dr.prediction_skew(a, b, "o_orderkey", "p")
    return out.withColumns({c: F.round(c, 9) for c in ("train_value", "serve_value", "max_delta", "mean_delta")})


@query(
    "a18_snapshot_skew",
    f"""WITH {LONG_SQL}, {_RANGE}, {KS_SQL},
        hb AS (SELECT feature, is_ref, v BETWEEN rlo - 1e-8 AND rhi + 1e-8 AS inside, len(list_filter(range(1, 10), lambda i: v >= (rhi - rlo) / 10 * i + rlo)) AS bin
               FROM lv JOIN rg USING (feature)),
        g AS (SELECT feature, n, m, unnest(range(0, 10)) AS bin FROM rg),
        c AS (SELECT g.feature, g.n, g.m, count_if(is_ref) AS r, count_if(NOT is_ref AND inside) AS i, count_if(NOT is_ref) AS p
              FROM g LEFT JOIN hb ON g.feature = hb.feature AND g.bin = hb.bin GROUP BY g.feature, g.n, g.m, g.bin),
        w AS (SELECT feature, n, m, r / n + 1e-4 AS x, i / m + 1e-4 AS y, (r + 1e-4) / (n + 1e-3) AS a, (p + 1e-4) / (m + 1e-3) AS b FROM c),
        s AS (SELECT feature, n, m, sum((y - x) * ln(y / x)) AS psi, sqrt(sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2) AS js FROM w GROUP BY 1, 2, 3),
        t AS (SELECT s.*, ks * sqrt(n::double * m / (n + m)) AS t FROM s JOIN ks USING (feature)),
        k AS (SELECT *, CASE WHEN t < 0.2 THEN 1.0 ELSE list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * t * t))) END AS p FROM t)
        SELECT 'v1' AS model_version, feature, n, m, round(psi, 9) AS psi, round(js, 9) AS js_distance, true AS ks_within_error,
               CASE WHEN psi > 0.2 THEN 'major' WHEN psi > 0.1 OR p < 0.05 THEN 'moderate' ELSE 'stable' END AS severity FROM k""",
)
def snapshot_skew(t: Tables):
    """The second half of the month against the first: a snapshot once, one row of sketches per day and feature, merged; KS held against the exact one."""
    a, b = periods(t)
    snapshot = sk.take_snapshot(a, FEATURES, "v1")
    days = sk.summarize_current(b.withColumn("day", F.pmod(F.xxhash64(*b.columns), F.lit(15))), snapshot, FEATURES, ["day"])
    out = sk.snapshot_skew(sk.merge_summaries(days), snapshot)
    exact = dr.ks_statistic(period_rows(t), 1).select("feature", F.col("ks").alias("exact_ks"))
    near = (F.abs(F.col("ks") - F.col("exact_ks")) <= sk.ks_error()).alias("ks_within_error")
    return out.join(exact, "feature").select(
        "model_version", "feature", "n", "m", F.round("psi", 9).alias("psi"), F.round("js_distance", 9).alias("js_distance"), near, "severity")


BOUNDS = [("amount", 0, 90, 0.2), ("hour", 0, 23, 0.05), ("k", 0, 150, 0.05)]


@query(
    "w7_feature_monitor_report",
    f"""WITH {LONG_SQL}, {PSI_SQL}, {KS_SQL}, cur AS (SELECT feature, v FROM long WHERE NOT is_ref),
        q AS (SELECT feature, 1 - count(v) / count(*) AS nr, count_if((feature = 'amount' AND v > 90) OR (feature = 'hour' AND v > 23)
              OR (feature = 'k' AND v > 150)) / count(*) AS oor FROM cur GROUP BY 1),
        fr AS (SELECT event_type, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3600000000.0 AS age FROM events GROUP BY 1)
        SELECT 'freshness' AS kind, event_type AS subject,
               CASE WHEN age < 0.3 THEN 'FRESH' WHEN age < 0.9 THEN 'STALE' ELSE 'MISSING' END AS status,
               age < 0.9 AS passed FROM fr
        UNION ALL SELECT 'quality', feature, CASE WHEN ok THEN 'PASSED' ELSE 'FAILED' END, ok FROM (
          SELECT feature, nr <= CASE WHEN feature = 'amount' THEN 0.2 ELSE 0.05 END AND oor = 0 AS ok FROM q)
        UNION ALL SELECT 'drift', feature, sev, sev <> 'HIGH' FROM (SELECT feature, CASE WHEN psi >= 0.2 OR ks >= 0.1 THEN 'HIGH'
          WHEN psi >= 0.1 OR ks >= 0.05 THEN 'LOW' ELSE 'NONE' END AS sev FROM psi JOIN ks USING (feature))""",
)
def feature_monitor(t: Tables):
    a, b = periods(t)
    fresh = ft.freshness_status(
        t.events.withColumnRenamed("event_type", "view"), "view", "ts", datetime(2024, 1, 31), 0.3
    )
    return monitor_report(fresh, ct.bounds_quality(b, BOUNDS), dr.monitor_drift(dr.pair(a, b, FEATURES)))


def monitor_report(fresh, quality, drift):
    """Freshness, quality and drift results as one table; a row fails on MISSING, FAILED or HIGH."""
    parts = [
        fresh.select(F.lit("freshness").alias("kind"), F.col("view").alias("subject"), "status", (F.col("status") != "MISSING").alias("passed")),
        quality.select(F.lit("quality").alias("kind"), F.col("feature").alias("subject"),
                       F.when(F.col("passed"), "PASSED").otherwise("FAILED").alias("status"), "passed"),
        drift.select(F.lit("drift").alias("kind"), F.col("feature").alias("subject"), F.col("severity").alias("status"),
                     (F.col("severity") != "HIGH").alias("passed")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
