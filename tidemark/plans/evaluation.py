"""Model-evaluation queries on a scored lineitem table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.plans.registry import Tables, query


def scored(t: Tables):
    """Label: returned line.  Two scores: by price (many values) and by discount (few values)."""
    return t.spread("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_extendedprice") / 120000).alias("score"),
        F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("score_b"),
        F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").alias("line_no"),
    )


def versions(t: Tables):
    """The two scores as rows of two model versions."""
    return scored(t).unpivot(["line_id", "label", "status", "line_no"], ["score", "score_b"], "model_version", "p")


SCORED_SQL = """
    s AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, (l_returnflag = 'R')::int AS label, l_extendedprice / 120000 AS score,
                 least(l_discount * 10, 1.0) AS score_b, l_linestatus AS status, l_linenumber AS line_no FROM lineitem),
    v AS (SELECT line_id, label, status, line_no, 'score' AS model_version, score AS p FROM s UNION ALL
          SELECT line_id, label, status, line_no, 'score_b', score_b FROM s)
"""
_LOWER = "[" + ", ".join(repr(e) for e in ev.BIN_EDGES[1:-1]) + "]::double[]"


def rank_sql(source: str, keys: str, p: str = "p", y: str = "label") -> str:
    """CTEs d, r, rk: rank metrics per key from counts per distinct score."""
    on = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    cols = f"{keys}, " if keys else ""
    return f"""
    d AS (SELECT {cols}{p} AS p, count_if({y} = 1) AS pos, count_if({y} = 0) AS neg FROM {source} GROUP BY ALL),
    r AS (SELECT *, sum(pos) OVER ({on} ORDER BY p DESC) AS cp, sum(neg) OVER ({on} ORDER BY p DESC) AS cn FROM d),
    rk AS (SELECT {cols}sum(pos + neg)::bigint AS n, sum(pos)::bigint AS n_pos,
             CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN 1 - sum(pos * (cn - neg / 2)) / (sum(pos)::double * sum(neg)) END AS roc_auc,
             CASE WHEN sum(pos) > 0 THEN sum(pos * cp / (cp + cn)) / sum(pos) END AS average_precision
           FROM r {group})"""


def ece_sql(source: str, keys: str, p: str = "p", y: str = "label") -> str:
    cols = f"{keys}, " if keys else ""
    return f"""
    bins AS (SELECT {cols}len(list_filter({_LOWER}, lambda e: {p} > e)) AS bin, avg({p}) AS mp, avg({y}) AS fp, count(*) AS n
             FROM {source} GROUP BY ALL),
    ece AS (SELECT {cols}avg(abs(fp - mp)) AS calibration_error FROM bins {f'GROUP BY {keys}' if keys else ''})"""


@query(
    "a19_roc_auc",
    f"WITH {SCORED_SQL}, {rank_sql('v', 'model_version')} SELECT model_version, n, n_pos, round(roc_auc, 9) AS roc_auc FROM rk",
)
def roc_auc(t: Tables):
    return ev.roc_auc(versions(t), "label", "p", ["model_version"]).withColumn("roc_auc", F.round("roc_auc", 9))


@query(
    "a20_average_precision",
    f"""WITH {SCORED_SQL}, {rank_sql('s', '', 'score')}
        SELECT n, n_pos, round(average_precision, 9) AS average_precision FROM rk""",
)
def average_precision(t: Tables):
    out = ev.average_precision(scored(t), "label", "score")
    return out.withColumn("average_precision", F.round("average_precision", 9))


@query(
    "a21_brier",
    f"""WITH {SCORED_SQL} SELECT model_version, count(*)::bigint AS n, round(avg((p - label) * (p - label)), 9) AS brier
        FROM v GROUP BY 1""",
)
def brier(t: Tables):
    return ev.brier(versions(t), "label", "p", ["model_version"]).withColumn("brier", F.round("brier", 9))


@query(
    "a22_ece_unweighted",
    f"""WITH {SCORED_SQL}, {ece_sql('v', 'model_version')}
        SELECT model_version, round(calibration_error, 9) AS calibration_error FROM ece""",
)
def ece_unweighted(t: Tables):
    out = ev.ece_unweighted(versions(t), "label", "p", ["model_version"])
    return out.withColumn("calibration_error", F.round("calibration_error", 9))


_WECE = f"""
    wb AS (SELECT model_version, CASE WHEN p >= 0 AND p < 1 THEN len(list_filter({_LOWER}, lambda e: p >= e)) END AS bin,
                  label, p FROM v),
    wg AS (SELECT model_version, bin, count(*) AS n, abs(avg(label) - avg(p)) AS gap FROM wb WHERE bin IS NOT NULL GROUP BY 1, 2),
    wece AS (SELECT model_version, sum(n * gap) / any_value(total) AS ece
             FROM wg JOIN (SELECT model_version, count(*) AS total FROM v GROUP BY 1) USING (model_version) GROUP BY 1)"""


@query("a23_ece_weighted", f"WITH {SCORED_SQL}, {_WECE} SELECT model_version, round(ece, 9) AS ece FROM wece")
def ece_weighted(t: Tables):
    return ev.ece_weighted(versions(t), "label", "p", ["model_version"]).withColumn("ece", F.round("ece", 9))


_COUNTS = """count_if(p >= {t} AND label = 1)::bigint AS tp, count_if(p >= {t} AND label = 0)::bigint AS fp,
             count_if(p < {t} AND label = 1)::bigint AS fn, count_if(p < {t} AND label = 0)::bigint AS tn"""
_RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
            CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, fp * 2000.0::double + fn * 8000.0::double AS cost"""


@query(
    "a24_confusion_cost",
    f"""WITH {SCORED_SQL}, c AS (SELECT model_version, {_COUNTS.format(t='0.5')} FROM v GROUP BY 1)
        SELECT model_version, tp, fp, fn, tn, {_RATES} FROM c""",
)
def confusion(t: Tables):
    return ev.confusion(versions(t), "label", "p", 0.5, ["model_version"])


_GRID = "(SELECT unnest([" + ", ".join(repr(x) for x in ev.THRESHOLDS) + "]::double[]) AS threshold) g"
_SWEEP = f"""
    sw AS (SELECT model_version, threshold, {_COUNTS.format(t='threshold')} FROM v, {_GRID} GROUP BY 1, 2),
    swr AS (SELECT *, {_RATES} FROM sw)"""


@query(
    "a25_threshold_sweep",
    f"WITH {SCORED_SQL}, {_SWEEP} SELECT model_version, threshold, tp, fp, fn, tn, precision, recall, cost FROM swr",
)
def threshold_sweep(t: Tables):
    return ev.threshold_sweep(versions(t), "label", "p", ["model_version"])


@query(
    "a26_best_threshold",
    f"""WITH {SCORED_SQL}, {_SWEEP},
        b AS (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY cost, threshold) AS r FROM swr)
        SELECT model_version, threshold, cost, tp, fp, fn, tn, precision, recall, cost / (tp + fp + fn + tn) AS cost_per_row
        FROM b WHERE r = 1""",
)
def best_threshold(t: Tables):
    return ev.best_threshold(versions(t), "label", "p", ["model_version"])


_ROUTE = "CASE WHEN score < 0.2 THEN 'approve' WHEN score >= 0.6 THEN 'decline' ELSE 'review' END"


@query("p4_route_decision", f"WITH {SCORED_SQL} SELECT line_id, score, {_ROUTE} AS decision FROM s")
def route_decision(t: Tables):
    return scored(t).select("line_id", "score", ev.route_decision(F.col("score"), 0.2, 0.6).alias("decision"))


@query(
    "a27_review_band",
    f"""WITH {SCORED_SQL}, {_SWEEP},
        b AS (SELECT threshold FROM swr WHERE model_version = 'score' ORDER BY cost, threshold LIMIT 1),
        lo AS (SELECT threshold, least(greatest(threshold - 0.075, 0.05), 0.45) AS a FROM b),
        band AS (SELECT threshold, round(a, 3) AS approve, round(least(greatest(threshold + 0.075, a + 0.05), 0.95), 3) AS decline FROM lo),
        r AS (SELECT {_ROUTE} AS decision, label FROM s)
        SELECT decision, count(*)::bigint AS n, round(avg(label), 9) AS positive_rate,
               round(count(*) / sum(count(*)) OVER (), 9)::double AS pct, any_value(approve) AS band_approve,
               any_value(decline) AS band_decline
        FROM r, band GROUP BY decision""",
)
def review_band(t: Tables):
    rows = scored(t)
    band = ev.calibrated_band(rows, "label", "score")
    out = ev.review_band(rows, "label", "score", 0.2, 0.6)
    return out.select(
        "decision", "n", *[F.round(c, 9).alias(c) for c in ("positive_rate", "pct")],
        band.select("approve").scalar().alias("band_approve"), band.select("decline").scalar().alias("band_decline"),
    )


@query(
    "a28_reliability_table",
    f"""WITH {SCORED_SQL}, {ece_sql('v', 'model_version')}
        SELECT model_version, bin::int AS bin, n::bigint AS n, round(mp, 9) AS mean_predicted, round(fp, 9) AS fraction_positive,
               round(fp - mp, 9) AS gap FROM bins""",
)
def reliability(t: Tables):
    out = ev.reliability_table(versions(t), "label", "p", ["model_version"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean_predicted", "fraction_positive", "gap")})


@query(
    "a28_calibration_report",
    f"""WITH {SCORED_SQL}, {ece_sql('v', 'model_version')},
        b AS (SELECT model_version, avg((p - label) * (p - label)) AS brier FROM v GROUP BY 1),
        j AS (SELECT max(CASE WHEN model_version = 'score' THEN calibration_error END) AS eb,
                     max(CASE WHEN model_version = 'score_b' THEN calibration_error END) AS ea,
                     max(CASE WHEN model_version = 'score' THEN brier END) AS bb,
                     max(CASE WHEN model_version = 'score_b' THEN brier END) AS ba FROM ece JOIN b USING (model_version))
        SELECT round(eb, 9) AS before_ece, round(bb, 9) AS before_brier, round(ea, 9) AS after_ece,
               round(ba, 9) AS after_brier, ea < eb AS improved FROM j""",
)
def calibration_report(t: Tables):
    out = ev.calibration_report(scored(t), "label", "score", "score_b")
    return out.withColumns({c: F.round(c, 9) for c in ("before_ece", "before_brier", "after_ece", "after_brier")})


def scored_docs(t: Tables):
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("label"), F.least(F.col("n_chars") / 8000, F.lit(1.0)).alias("p")
    )


_DOCS = """
    docs AS (SELECT doc_id, lang, source, quality AS label, least(n_chars / 8000, 1.0) AS p FROM documents JOIN labels USING (doc_id)),
    sl AS (SELECT label, p, 'lang' AS slice_col, lang AS slice_val FROM docs UNION ALL SELECT label, p, 'source', source FROM docs)
"""
_SLICES = f"""{_DOCS}, {rank_sql('sl', 'slice_col, slice_val')}, {ece_sql('sl', 'slice_col, slice_val')},
    m AS (SELECT * FROM rk JOIN ece USING (slice_col, slice_val) WHERE n >= {{min}} AND n_pos > 0 AND n_pos < n)"""


@query(
    "a29_slice_metrics",
    f"""WITH {_SLICES.format(min=10)},
        o AS (SELECT 1 - sum(pos * (cn - neg / 2)) / (sum(pos)::double * sum(neg)) AS overall FROM (
              SELECT pos, neg, sum(neg) OVER (ORDER BY p DESC) AS cn FROM (
              SELECT p, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM docs GROUP BY p)))
        SELECT slice_col, slice_val, n, n_pos, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision,
               round(calibration_error, 9) AS calibration_error, round(n_pos / n, 9) AS positive_rate,
               round(overall, 9) AS overall, round(overall - roc_auc, 9) AS gap, overall - roc_auc > 0.05 AS flag FROM m, o""",
)
def slice_metrics(t: Tables):
    rows = scored_docs(t)
    slices = ev.slice_metrics(rows, "label", "p", ["lang", "source"], 10)
    out = ev.slice_gaps(slices, ev.roc_auc(rows, "label", "p"))
    numbers = ("roc_auc", "average_precision", "calibration_error", "positive_rate", "overall", "gap")
    return out.withColumns({c: F.round(c, 9) for c in numbers})


@query(
    "t3_worst_n",
    f"""WITH {_SLICES.format(min=10)} SELECT slice_col, slice_val, n, round(roc_auc, 9) AS roc_auc
        FROM m ORDER BY m.roc_auc, slice_col, slice_val LIMIT 5""",
)
def worst_n(t: Tables):
    slices = ev.slice_metrics(scored_docs(t), "label", "p", ["lang", "source"], 10)
    out = ev.worst_n(slices, "roc_auc", ["slice_col", "slice_val"], 5)
    return out.select("slice_col", "slice_val", "n", F.round("roc_auc", 9).alias("roc_auc"))


@query(
    "a32_champion_challenger",
    f"""WITH {SCORED_SQL}, {rank_sql('v', 'model_version')}, {_WECE},
        c AS (SELECT model_version, {_COUNTS.format(t='0.5')} FROM v GROUP BY 1),
        b AS (SELECT model_version, avg((p - label) * (p - label)) AS brier FROM v GROUP BY 1),
        x AS (SELECT model_version, status, p, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM v GROUP BY ALL),
        y AS (SELECT *, sum(neg) OVER (PARTITION BY model_version, status ORDER BY p DESC) AS cn FROM x),
        z AS (SELECT model_version, status, 1 - sum(pos * (cn - neg / 2)) / (sum(pos)::double * sum(neg)) AS a FROM y GROUP BY 1, 2
              HAVING sum(pos + neg) >= 30 AND sum(pos) > 0 AND sum(neg) > 0),
        gap AS (SELECT model_version, CASE WHEN count(*) >= 2 THEN max(a) - min(a) ELSE 0 END AS g FROM z GROUP BY 1),
        m AS (SELECT model_version, n, roc_auc, ece, brier, fp * 2000.0::double + fn * 8000.0::double AS cost, g
              FROM rk JOIN wece USING (model_version) JOIN c USING (model_version) JOIN b USING (model_version) JOIN gap USING (model_version)),
        f AS (SELECT *, array_to_string(list_filter([CASE WHEN roc_auc < 0.49 THEN 'auc' END, CASE WHEN ece > 0.3 THEN 'ece' END,
              CASE WHEN g > 0.10 THEN 'slice_auc_gap' END], lambda k: k IS NOT NULL), ';') AS failures FROM m),
        first AS (SELECT * FROM f WHERE model_version = 'score'), w AS (SELECT CASE WHEN failures = '' THEN roc_auc END AS ca FROM first)
        SELECT f.model_version, n, round(roc_auc, 9) AS roc_auc, round(ece, 9) AS ece, round(brier, 9) AS brier, cost,
               round(g, 9) AS slice_auc_gap, failures,
               round(CASE WHEN f.model_version = 'score_b' THEN ca END, 9) AS champion_auc,
               failures = '' AND (f.model_version = 'score' OR ca IS NULL OR roc_auc - ca >= 0.0001) AS promoted
        FROM f, w""",
)
def champion_challenger(t: Tables):
    metrics = ev.model_metrics(versions(t), "label", "p", "model_version", "status")
    out = ev.gate_versions(metrics, "model_version", ev.GateLimits(0.49, 0.3, 0.10, 0.0001))
    numbers = ("roc_auc", "ece", "brier", "slice_auc_gap", "champion_auc")
    return out.select(
        "model_version", "n", "cost", *[F.round(c, 9).alias(c) for c in numbers],
        F.array_join("failures", ";").alias("failures"), "promoted",
    )


@query(
    "t1_ordered_split",
    """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CASE WHEN i < floor(n * 0.6::double) THEN 'train' WHEN i < floor(n * 0.8::double) THEN 'calibration'
           ELSE 'test' END AS split FROM r
    """,
)
def ordered_split(t: Tables):
    return ev.ordered_split(t.orders.select("o_orderkey"), "o_orderkey", {"train": 0.6, "calibration": 0.2, "test": 0.2})


@query(
    "t2_stratified_folds",
    """
    WITH h AS (SELECT doc_id, quality, ('0x' || substr(md5(doc_id || ':42'), 1, 8))::bigint AS h FROM labels),
    r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) - 1 AS i FROM h)
    SELECT doc_id, quality, (i % 3)::int AS fold, CASE WHEN i % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM r
    """,
)
def stratified_folds(t: Tables):
    return ev.stratified_folds(t.labels.select("doc_id", "quality"), "quality", "doc_id")
