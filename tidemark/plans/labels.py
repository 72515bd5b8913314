"""Label and feedback-loop queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import feedback as fb
from tidemark.operators import labels as lb
from tidemark.operators.evaluation import route_decision
from tidemark.plans.registry import Tables, query


def predictions(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("predicted_at"))


def outcomes(t: Tables):
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", F.col("l_shipdate").alias("outcome_at"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("label"),
        F.col("l_quantity").alias("delay_days"),
    )


_PAIRS = "orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(
    "j3_confirmed_label_join",
    f"""SELECT o_orderkey AS id, l_linenumber, l_partkey, epoch_us(o_orderdate) AS predicted_us, epoch_us(l_shipdate) AS outcome_us
        FROM {_PAIRS} WHERE l_shipdate >= o_orderdate + INTERVAL 90 DAY""",
)
def confirmed_label_join(t: Tables):
    out = lb.confirmed_label_join(predictions(t), outcomes(t), "id", "predicted_at", "outcome_at")
    return out.select(
        "id", "l_linenumber", "l_partkey", F.unix_micros("predicted_at").alias("predicted_us"),
        F.unix_micros("outcome_at").alias("outcome_us"),
    )


@query(
    "j3_confirmed_label_counts",
    f"""SELECT count(*)::bigint AS n_matched, count_if(l_shipdate >= o_orderdate + INTERVAL 90 DAY)::bigint AS n_confirmed,
        count_if(NOT (l_shipdate >= o_orderdate + INTERVAL 90 DAY))::bigint AS n_dropped FROM {_PAIRS}""",
)
def confirmed_label_counts(t: Tables):
    return lb.confirmed_label_counts(predictions(t), outcomes(t), "id", "predicted_at", "outcome_at")


_LAST = """last AS (SELECT l_orderkey AS id, arg_max_null(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END, k) AS label,
           arg_max(l_quantity, k) AS delay_days
           FROM (SELECT *, row(l_shipdate, l_linenumber, l_partkey) AS k FROM lineitem) GROUP BY 1)"""


@query(
    "j4_delayed_outcome_join",
    f"""WITH {_LAST} SELECT o_orderkey AS id, coalesce(label, -1) AS label, delay_days,
        CASE WHEN label IS NOT NULL AND delay_days >= 30 THEN 'confirmed' ELSE 'provisional' END AS status
        FROM orders LEFT JOIN last ON o_orderkey = last.id""",
)
def delayed_outcome_join(t: Tables):
    out = lb.delayed_outcome_join(
        predictions(t), outcomes(t), "id", "label", "delay_days", ["outcome_at", "l_linenumber", "l_partkey"]
    )
    return out.select("id", F.coalesce("label", F.lit(-1)).alias("label"), "delay_days", "status")


def label_rows(t: Tables):
    return t.orders.select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("labelled_at"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.when(F.col("o_orderdate") < "1998-01-01", "v1").otherwise("v2").alias("policy_version"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_corrected"),
    )


_RANKED = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)"


@query(
    "w4_label_corrections",
    f"""SELECT o_custkey AS id, o_orderkey AS row_id, r = 1 AS is_current, r > 1 AS is_superseded
        FROM (SELECT *, {_RANKED} AS r FROM orders)""",
)
def label_corrections(t: Tables):
    out = lb.label_corrections(label_rows(t), "id", "labelled_at", ["row_id"])
    return out.select("id", "row_id", "is_current", "is_superseded")


@query(
    "w5_current_labels",
    f"""SELECT o_custkey AS id, o_orderkey AS row_id, (o_orderstatus = 'F')::int AS label
        FROM (SELECT *, {_RANKED} AS r FROM orders) WHERE r = 1""",
)
def current_labels(t: Tables):
    return lb.current_labels(label_rows(t), "id", "labelled_at", ["row_id"]).select("id", "row_id", "label")


@query(
    "a33_label_arrival",
    f"""WITH c AS (SELECT count(*)::bigint AS n, count_if(l_shipdate >= o_orderdate + INTERVAL 90 DAY)::bigint AS k FROM {_PAIRS})
        SELECT n AS n_total, k AS n_confirmed, round(k / n, 9) AS pct_confirmed, k / n >= 0.9 AS sufficient FROM c""",
)
def label_arrival(t: Tables):
    pairs = predictions(t).join(outcomes(t), "id")
    return lb.label_arrival(pairs, "predicted_at", "outcome_at").withColumn("pct_confirmed", F.round("pct_confirmed", 9))


@query(
    "a33_arrival_curve",
    "WITH l AS (SELECT floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000) AS lag FROM " + _PAIRS + ") SELECT "
    + "count(*)::bigint AS n_total, "
    + ", ".join(f"round(count_if(lag >= {d}) / count(*), 9) AS t{d}" for d in lb.HORIZONS) + " FROM l",
)
def arrival_curve(t: Tables):
    pairs = predictions(t).join(outcomes(t), "id")
    out = lb.arrival_curve(pairs, "predicted_at", "outcome_at")
    return out.select("n_total", *[F.round(f"t{d}", 9).alias(f"t{d}") for d in lb.HORIZONS])


@query(
    "a34_label_policy_checks",
    """WITH c AS (SELECT count(*)::bigint AS n, count(DISTINCT CASE WHEN o_orderdate < '1998-01-01' THEN 'v1' ELSE 'v2' END)::bigint AS v,
         count_if(o_orderpriority = '1-URGENT')::bigint AS k FROM orders)
       SELECT n AS n_total, v AS n_versions, k AS n_corrected, v = 1 AS is_consistent, round(k / n, 9) AS correction_rate,
              k / n > 0.05 AS flag FROM c""",
)
def label_policy_checks(t: Tables):
    return lb.label_policy_checks(label_rows(t)).withColumn("correction_rate", F.round("correction_rate", 9))


def feedback_rows(t: Tables):
    """Events as labelled predictions per week: score from the value, label from the payload."""
    k = F.get_json_object("props", "$.k").cast("double")
    week = F.floor((F.dayofmonth("ts") - 1) / 7).cast("int")
    score = F.least(F.col("value") / 200, F.lit(1.0))
    return t.events.select(
        week.alias("week"), score.alias("score"),
        # Early weeks: the payload decides; later ones lean on the value.
        ((k + F.col("value") * week / 4) > 60).cast("int").alias("label"),
        route_decision(score, 0.2, 0.6).alias("decision"),
    )


FEEDBACK_SQL = """
    fb AS (SELECT ((day(ts) - 1) // 7)::int AS week, least(value / 200, 1.0) AS score,
                  ((json_extract(props, '$.k')::double + value * ((day(ts) - 1) // 7) / 4) > 60)::int AS label,
                  CASE WHEN value / 200 < 0.2 THEN 'approve' WHEN least(value / 200, 1.0) >= 0.6 THEN 'decline' ELSE 'review' END AS decision
           FROM events),
    fd AS (SELECT week, score AS p, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM fb GROUP BY ALL),
    fr AS (SELECT *, sum(neg) OVER (PARTITION BY week ORDER BY p DESC) AS cn FROM fd),
    fa AS (SELECT week, 1 - sum(pos * (cn - neg / 2)) / (sum(pos)::double * sum(neg)) AS auc FROM fr GROUP BY 1),
    fm AS (SELECT week, count(*)::bigint AS n_labeled, avg((decision = 'approve')::int) AS approval_rate,
                  avg(label) FILTER (decision = 'approve') AS default_rate_approved, avg(label) AS label_positive_rate FROM fb GROUP BY 1),
    f AS (SELECT * FROM fm JOIN fa USING (week))
"""
_METRICS = ("auc", "approval_rate", "default_rate_approved", "label_positive_rate")


@query(
    "a30_feedback_metrics",
    f"WITH {FEEDBACK_SQL} SELECT week, n_labeled, " + ", ".join(f"round({c}, 9) AS {c}" for c in _METRICS) + " FROM f",
)
def feedback_metrics(t: Tables):
    out = fb.feedback_metrics(feedback_rows(t), "label", "score", "decision", ["week"])
    return out.withColumns({c: F.round(c, 9) for c in _METRICS})


@query(
    "a31_retrain_decision",
    f"""WITH RECURSIVE {FEEDBACK_SQL}, s AS (SELECT week, auc, n_labeled FROM f),
        step AS (
          SELECT -1 AS week, 0.7::double AS baseline, NULL::double AS was, NULL::double AS auc, 0::bigint AS n_labeled, '' AS reason
          UNION ALL
          SELECT s.week, CASE WHEN s.n_labeled >= 100 AND s.auc - step.baseline >= 0.02 THEN s.auc ELSE step.baseline END,
                 step.baseline, s.auc, s.n_labeled,
                 CASE WHEN s.n_labeled < 100 THEN 'batch_too_small' WHEN abs(s.auc - step.baseline) < 0.02 THEN 'below_threshold'
                      WHEN s.auc < step.baseline THEN 'degraded' ELSE 'improved' END
          FROM step JOIN s ON s.week = step.week + 1)
        SELECT week, n_labeled, round(auc, 9) AS auc, round(was, 9) AS baseline_auc, round(auc - was, 9) AS delta, reason,
               CASE WHEN reason NOT IN ('degraded', 'improved') THEN 'not_triggered' WHEN auc - was >= 0 THEN 'approved' ELSE 'rejected' END AS approval,
               reason IN ('degraded', 'improved') AS triggered, auc >= was - 0.01 AS auc_guard, auc - was < -0.01 AS regression
        FROM step WHERE week >= 0""",
)
def retrain_decision(t: Tables):
    metrics = fb.feedback_metrics(feedback_rows(t), "label", "score", "decision", ["week"]).select("week", "n_labeled", "auc")
    out = fb.closed_loop(metrics, "week")
    out = out.withColumns({
        "auc_guard": fb.auc_guard(F.col("auc"), F.col("baseline_auc")),
        "regression": fb.is_regression(F.col("baseline_auc"), F.col("auc")),
    })
    return out.withColumns({c: F.round(c, 9) for c in ("auc", "baseline_auc", "delta")})
