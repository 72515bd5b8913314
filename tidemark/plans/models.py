"""Scoring, training and behaviour queries on lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calibration as cal
from tidemark.operators import models as md
from tidemark.operators.evaluation import confusion, rank_metrics
from tidemark.plans.evaluation import SCORED_SQL, scored
from tidemark.plans.registry import Tables, query

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(t: Tables):
    return t.spread("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), *FEATURES,
        ((F.col("l_extendedprice") / 100000 + F.col("l_discount") * 4 + F.col("l_tax")) > 0.7).cast("int").alias("label"),
    )


def linear_model(x):
    """A fixed linear score, as a user's predict function would be."""
    return (x["l_quantity"] / 100 + x["l_extendedprice"] / 400000 + x["l_discount"] * 2).clip(0, 1)


@query(
    "u1_batch_score",
    """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS line_id,
         greatest(least(l_quantity / 100 + l_extendedprice / 400000 + l_discount * 2, 1), 0) AS score FROM lineitem)
       SELECT line_id, round(score, 9) AS score, (score >= 0.5)::int AS predicted_label, 'v1' AS model_version FROM s""",
)
def batch_score(t: Tables):
    out = md.batch_score(lines(t), linear_model, FEATURES, "v1")
    return out.select("line_id", F.round("score", 9).alias("score"), "predicted_label", "model_version")


def train_and_held_out(t: Tables):
    rows = lines(t)
    held = F.pmod(F.xxhash64("line_id"), F.lit(5)) == 0
    return rows.where(~held), rows.where(held)


@query("u2_train_classifier")
def train_classifier(t: Tables):
    """Rows only.  Few shallow trees, so that the check stays short; all rows are used."""
    train, held = train_and_held_out(t)
    model = md.train_classifier(train, FEATURES, "label", trees=5, step=0.3, depth=3)
    out = md.positive_probability(model, held)
    ranks = rank_metrics(out, "label", "score")
    c = confusion(out, "label", "score")
    return ranks.select("n", "roc_auc", "average_precision", *[c.select(x).scalar().alias(x) for x in ("tp", "fp", "fn", "tn")])


@query("u3_cross_validated_search")
def cross_validated_search(t: Tables):
    """Rows only: two trials over three stratified folds."""
    space = {"maxIter": (2, 3), "stepSize": (0.1, 0.3), "maxDepth": (2, 3), "subsamplingRate": (0.8, 1.0)}
    return md.cross_validated_search(lines(t), FEATURES, "label", "line_id", trials=2, space=space)


@query(
    "u4_calibrate_scores",
    f"""WITH {SCORED_SQL},
        a AS (SELECT line_id, label, round(score, 3) AS x FROM s),
        d AS (SELECT x, count(*) AS n, sum(label) AS s, row_number() OVER (ORDER BY x) AS i FROM a WHERE line_id % 2 = 0 GROUP BY x),
        c AS (SELECT *, sum(n) OVER (ORDER BY x) AS cn, sum(s) OVER (ORDER BY x) AS cs FROM d),
        p AS (SELECT l.i AS j, h.i, (h.cs - l.cs + l.s) / (h.cn - l.cn + l.n) AS mean FROM c l JOIN c h ON h.i >= l.i),
        m AS (SELECT i, max(low) AS y FROM (SELECT i, min(mean) OVER (PARTITION BY j ORDER BY i DESC) AS low FROM p) GROUP BY i),
        f AS (SELECT x, y FROM c JOIN m USING (i)),
        u AS (SELECT DISTINCT x FROM a),
        b AS (SELECT u.x, l.x AS x0, l.y AS y0, h.x AS x1, h.y AS y1 FROM u ASOF LEFT JOIN f l ON u.x >= l.x ASOF LEFT JOIN f h ON u.x <= h.x)
        SELECT line_id, label, x AS score,
               round(CASE WHEN x0 = x1 THEN y0 ELSE coalesce(y0 + (x - x0) * (y1 - y0) / (x1 - x0), y0, y1) END, 9) AS isotonic FROM a JOIN b USING (x)""",
)
def calibrate_scores(t: Tables):
    """Isotonic calibration fitted on one half, applied to all rows; the twin is the formula of greatest least means."""
    rows = scored(t).select("line_id", "label", F.round("score", 3).alias("score"))
    fit = cal.fit_isotonic(rows.where("line_id % 2 = 0"), "label", "score")
    return cal.apply_isotonic(rows, fit, "score", "isotonic").withColumn("isotonic", F.round("isotonic", 9))


@query(
    "u4_sigmoid_calibration",
    f"""WITH {SCORED_SQL} SELECT count(*) FILTER (line_id % 2 = 0)::bigint AS n_fitted, count(*)::bigint AS n, true AS sums_agree, true AS weighted_sums_agree FROM s""",
)
def sigmoid_calibration(t: Tables):
    """Sigmoid calibration; at the best fit, scores and labels of the fitted rows agree in sum and in sum weighted by score."""
    rows = scored(t).select("line_id", "label", "score")
    fitted = F.col("line_id") % 2 == 0
    out = md.calibrate_scores(rows, md.fit_calibrator(rows.where(fitted), "label", "score", "sigmoid"), "score", "sigmoid")
    off = F.when(fitted, F.col("sigmoid") - F.col("label"))
    return out.agg(
        F.count_if(fitted).alias("n_fitted"), F.count("*").alias("n"), (F.abs(F.avg(off)) < 1e-4).alias("sums_agree"),
        (F.abs(F.avg(off * F.col("score"))) < 1e-4).alias("weighted_sums_agree"),
    )


@query("u5_outlier_report")
def outlier_report(t: Tables):
    """Rows only: the trees are random."""
    train, held = train_and_held_out(t)
    return md.outlier_report(train, held, FEATURES)


def linear_score(c):
    return F.least(F.greatest(c["l_quantity"] / 100 + c["l_extendedprice"] / 400000 + c["l_discount"] * 2, F.lit(0.0)), F.lit(1.0))


_NOISE = "* (1 + (('0x' || substr(md5(line_id || ':{c}'), 1, 8))::bigint % 10001 / 10000.0::double * 2 - 1) * 0.3)"
_F = "greatest(least({q} / 100 + {p} / 400000 + {d} * 2, 1), 0)"


@query(
    "u6_behaviour_checks",
    f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, l_quantity, l_extendedprice, l_discount FROM lineitem),
        s AS (SELECT {_F.format(q='l_quantity', p='l_extendedprice', d='l_discount')} AS plain,
                {_F.format(q='l_quantity', p='l_extendedprice', d='0.0')} AS lo, {_F.format(q='l_quantity', p='l_extendedprice', d='0.1')} AS hi,
                {_F.format(q=f"l_quantity {_NOISE.format(c='l_quantity')}", p=f"l_extendedprice {_NOISE.format(c='l_extendedprice')}", d=f"l_discount {_NOISE.format(c='l_discount')}")} AS noisy,
                {_F.format(q='1.0', p='l_extendedprice', d='l_discount')} AS a, {_F.format(q='2.0', p='l_extendedprice', d='l_discount')} AS b FROM r),
        c AS (SELECT count(*)::bigint AS n, stddev_pop(plain) AS sd, count_if(hi < lo)::bigint AS m, count_if(abs(noisy - plain) > 0.05)::bigint AS ro,
                count_if(abs(a - b) > 0.02)::bigint AS i FROM s)
        SELECT 'monotonicity' AS "check", m AS violations, m = 0 AS passed, n, round(sd, 9) AS stdev FROM c UNION ALL
        SELECT 'robustness', ro, ro = 0, n, round(sd, 9) FROM c UNION ALL SELECT 'invariance', i, i = 0, n, round(sd, 9) FROM c UNION ALL
        SELECT 'confidence', CASE WHEN sd >= 0.05 THEN 0 ELSE 1 END, sd >= 0.05, n, round(sd, 9) FROM c""",
)
def behaviour_checks(t: Tables):
    out = md.behaviour_checks(
        lines(t), linear_score, FEATURES[:3], "line_id", ("l_discount", 0.0, 0.1), ("l_quantity", 1.0, 2.0), noise=0.3
    )
    return out.withColumn("stdev", F.round("stdev", 9))
