"""Batch scoring, training, search, calibration, outliers and behaviour checks."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions.hashing import md5_bucket
from tidemark.functions.ordering import quantiles
from tidemark.operators.calibration import IsotonicFit, apply_isotonic, fit_isotonic
from tidemark.operators.evaluation import stratified_folds
from tidemark.operators.governance import table_fingerprint

# --- batch scoring ------------------------------------------------------------


def batch_score(df: DataFrame, predict: Callable[[pd.DataFrame], np.ndarray], features: Sequence[str], version: str, threshold: float = 0.5) -> DataFrame:
    """Input plus score, label and model version; ``predict`` sees Arrow batches of the features alone.

    Set ``spark.sql.execution.arrow.maxRecordsPerBatch`` for the chunk size;
    the model travels with the function.
    """
    names = list(features)

    @F.pandas_udf("double")
    def score(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(np.asarray(predict(rows[names]), dtype=float))

    out = df.withColumn("score", score(F.struct(*[F.col(f"`{c}`") for c in names])))
    return out.withColumns({"predicted_label": (F.col("score") >= threshold).cast("int"), "model_version": F.lit(version)})


MANIFEST = "run_id string, status string, n_rows bigint, fingerprint string"


def run_batch_job(
    df: DataFrame, predict: Callable[[pd.DataFrame], np.ndarray], features: Sequence[str], version: str,
    output: str, manifest: str, run_id: str, force: bool = False,
) -> bool:
    """Action: score and write, then record the run; skip a run that is already complete.

    The manifest row is appended only after the output is committed.
    """
    spark = df.sparkSession
    if not force and _is_complete(spark, manifest, run_id):
        return False
    batch_score(df, predict, features, version).write.mode("overwrite").parquet(f"{output}/run_id={run_id}")
    written = spark.read.parquet(f"{output}/run_id={run_id}")
    table_fingerprint(written).select(
        F.lit(run_id).alias("run_id"), F.lit("completed").alias("status"), "n_rows", "fingerprint"
    ).write.mode("append").json(manifest)
    return True


def _is_complete(spark: SparkSession, manifest: str, run_id: str) -> bool:
    try:
        done = spark.read.schema(MANIFEST).json(manifest)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return not done.where((F.col("run_id") == run_id) & (F.col("status") == "completed")).isEmpty()


# --- training -----------------------------------------------------------------

# Default boosting parameters.
TREES, STEP, DEPTH, SUBSAMPLE = 300, 0.05, 6, 0.8


def with_class_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight positives by negatives / positives."""
    ratio = df.agg(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("w"))
    return df.withColumn("_weight", F.when(F.col(label) == 1, ratio.scalar()).otherwise(F.lit(1.0)))


def train_classifier(
    train: DataFrame, features: Sequence[str], label: str, trees: int = TREES, step: float = STEP, depth: int = DEPTH,
    subsample: float = SUBSAMPLE, seed: int = 42,
) -> PipelineModel:
    """Action: fit boosted trees with class weights."""
    gbt = GBTClassifier(
        labelCol=label, weightCol="_weight", featuresCol="_features", maxIter=trees, stepSize=step, maxDepth=depth,
        subsamplingRate=subsample, seed=seed, cacheNodeIds=False,
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    return Pipeline(stages=[assembler, gbt]).fit(with_class_weight(train, label))


def positive_probability(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("_features", "rawPrediction", "probability", "prediction")


SEARCH_SPACE = {
    "maxIter": (50, 100, 200, 300), "stepSize": (0.01, 0.05, 0.1, 0.2), "maxDepth": (3, 4, 6, 8),
    "subsamplingRate": (0.6, 0.8, 1.0), "minInstancesPerNode": (1, 10, 50), "featureSubsetStrategy": ("auto", "sqrt", "onethird"),
}


def cross_validated_search(
    df: DataFrame, features: Sequence[str], label: str, key: str, trials: int = 20, folds: int = 3, seed: int = 42,
    space: dict[str, Sequence] | None = None, parallelism: int = 4,
) -> DataFrame:
    """Action: seeded random search over boosting parameters by cross-validated AUC.

    Folds are the label-stratified ones, given to the validator as a column.
    """
    space = space or SEARCH_SPACE
    rng = random.Random(seed)
    gbt = GBTClassifier(labelCol=label, featuresCol="_features", weightCol="_weight", seed=seed)
    picks = [{name: rng.choice(list(values)) for name, values in space.items()} for _ in range(trials)]
    grid = [{gbt.getParam(n): v for n, v in pick.items()} for pick in picks]
    rows = stratified_folds(with_class_weight(df, label), label, key, folds, seed)
    rows = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(rows)
    rows = rows.select("_features", label, "_weight", "fold").persist()
    try:
        cv = CrossValidator(
            estimator=gbt, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label),
            numFolds=folds, foldCol="fold", seed=seed, parallelism=parallelism,
        )
        model = cv.fit(rows)
    finally:
        rows.unpersist()
    results = [(i, float(a), ", ".join(f"{n}={v}" for n, v in sorted(p.items()))) for i, (a, p) in enumerate(zip(model.avgMetrics, picks))]
    out = df.sparkSession.createDataFrame(results, "trial int, auc double, params string")
    return out.withColumn("is_best", F.col("auc") == max(r[1] for r in results))


# --- calibration --------------------------------------------------------------

def fit_calibrator(held_out: DataFrame, label: str, score: str, method: str = "isotonic"):
    """Action: fit a score calibrator on held-out rows."""
    rows = held_out.select(F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("_s"))
    if method == "isotonic":
        return fit_isotonic(rows, "label", "_s")
    if method == "sigmoid":
        vec = VectorAssembler(inputCols=["_s"], outputCol="_f")
        return Pipeline(stages=[vec, LogisticRegression(featuresCol="_f", labelCol="label", maxIter=200, tol=1e-9)]).fit(rows)
    raise ValueError("method must be isotonic or sigmoid")


def calibrate_scores(df: DataFrame, model, score: str, name: str = "calibrated") -> DataFrame:
    """Add the calibrated score, clipped to [0, 1]; scores beyond the fitted range take its ends."""
    if isinstance(model, IsotonicFit):
        return apply_isotonic(df, model, score, name)
    out = model.transform(df.withColumn("_s", F.col(score).cast("double")))
    out = out.withColumn(name, F.least(F.greatest(vector_to_array("probability")[1], F.lit(0.0)), F.lit(1.0)))
    return out.select(*df.columns, name)


# --- outliers -----------------------------------------------------------------

TREE_ROWS = 256
N_TREES = 100


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def fit_isolation_trees(df: DataFrame, features: Sequence[str], trees: int = N_TREES, rows: int = TREE_ROWS, seed: int = 42) -> list:
    """Action: isolation trees, each grown in its own task on at most ~``rows`` sampled rows.

    The samples are disjoint and chosen by hash: their size is part of the
    method, and so is the size of what reaches the driver.
    """
    names = list(features)
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    # by row, not by content: copies count as often as they stand in the table
    numbered = clean.withColumn("_row", F.xxhash64(F.monotonically_increasing_id()))
    picked = numbered.orderBy("_row").limit(trees * rows).withColumn("_tree", F.pmod(F.xxhash64("_row"), F.lit(trees)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        x = pdf[names].to_numpy(dtype=float)
        x = x[np.lexsort(x.T)]
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(len(x), 2)))
        nodes: list[list[float]] = []  # feature (-1: leaf), cut, left, right, depth + mean path

        def build(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + _average_path(len(part))])
            low, high = part.min(axis=0), part.max(axis=0)
            useful = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or len(useful) == 0:
                return at
            f = int(rng.choice(useful))
            cut = float(rng.uniform(low[f], high[f]))
            left = part[:, f] < cut
            a, b = build(part[left], depth + 1), build(part[~left], depth + 1)
            nodes[at] = [f, cut, a, b, 0.0]
            return at

        if len(x):
            build(x, 0)
        flat = np.array(nodes, dtype=float).reshape(-1).tolist()
        return pd.DataFrame({"tree": [tree], "n": [len(x)], "nodes": [flat]})

    grown = picked.groupBy("_tree").applyInPandas(grow, "tree int, n int, nodes array<double>").collect()
    return [(r["n"], np.array(r["nodes"]).reshape(-1, 5)) for r in sorted(grown, key=lambda r: r["tree"])]


def isolation_scores(df: DataFrame, features: Sequence[str], forest: list, name: str = "raw_score") -> DataFrame:
    """Add the isolation score (-1 is most unusual), batch by batch with broadcast trees."""
    names = list(features)
    sent = df.sparkSession.sparkContext.broadcast(forest)
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = sent.value
        scale = _average_path(float(np.mean([n for n, _ in trees]))) or 1.0
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            total = np.zeros(len(x))
            for _, nodes in trees:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = nodes[at, 0].astype(int)
                    moving = np.flatnonzero(f >= 0)
                    if len(moving) == 0:
                        break
                    here = at[moving]
                    left = x[moving, f[moving]] < nodes[here, 1]
                    at[moving] = np.where(left, nodes[here, 2], nodes[here, 3]).astype(int)
                total += nodes[at, 4]
            yield batch.assign(**{name: -(2.0 ** (-(total / len(trees)) / scale))})

    return df.mapInPandas(score, schema)


def outlier_report(train: DataFrame, current: DataFrame, features: Sequence[str], contamination: float = 0.05, trees: int = N_TREES) -> DataFrame:
    """Action (fits the trees): outlier share, mean, 5th percentile and count of ``current``.

    The zero of the decision score is the training percentile at ``contamination``.
    """
    forest = fit_isolation_trees(train, features, trees)
    if not forest:
        raise ValueError("no complete training rows")
    columns = [F.col(c).cast("double").alias(c) for c in features]
    fitted = isolation_scores(train.select(*columns), features, forest)
    offset = quantiles(fitted, "raw_score", {"offset": contamination}).select("offset")
    scored = isolation_scores(current.select(*columns), features, forest).withColumn("decision", F.col("raw_score") - offset.scalar())
    low = quantiles(scored, "decision", {"p5": 0.05}).select("p5")
    return scored.agg(
        F.avg((F.col("decision") < 0).cast("double")).alias("ood_fraction"), F.avg("decision").alias("mean_score"),
        F.count("*").alias("n_samples"),
    ).withColumn("p5_score", low.scalar())


# --- behaviour ----------------------------------------------------------------

ScoreFn = Callable[[dict[str, Column]], Column]


def behaviour_checks(
    df: DataFrame, score: ScoreFn, features: Sequence[str], key: str, monotone: tuple[str, float, float], swap: tuple[str, object, object],
    rising: bool = True, noise: float = 0.01, max_delta: float = 0.05, tolerance: float = 0.02, min_stdev: float = 0.05,
) -> DataFrame:
    """Monotonicity, robustness, invariance and spread of a scoring expression, in one pass.

    Perturbed copies are columns of the same row; the noise of a feature comes
    from a hash of row id and feature name.
    """
    base = {c: F.col(c) for c in features}
    m, low, high = monotone
    s_low, s_high = score({**base, m: F.lit(low)}), score({**base, m: F.lit(high)})
    wrong_way = (s_high < s_low) if rising else (s_high > s_low)

    def shaken(c: str) -> Column:
        u = md5_bucket(F.concat_ws(":", F.col(key), F.lit(c)), 10001) / 10000.0
        return F.col(c) * (1 + (u * 2 - 1) * noise)

    plain = score(base)
    noisy = score({c: shaken(c) for c in features})
    f, a, b = swap
    swapped = F.abs(score({**base, f: F.lit(a)}) - score({**base, f: F.lit(b)}))
    wide = df.agg(
        F.count("*").alias("n"), F.count_if(wrong_way).alias("monotonicity"),
        F.count_if(F.abs(noisy - plain) > max_delta).alias("robustness"), F.count_if(swapped > tolerance).alias("invariance"),
        F.stddev_pop(plain).alias("stdev"),
    )
    rows = [F.struct(F.lit(c).alias("check"), F.col(c).alias("violations"), (F.col(c) == 0).alias("passed")) for c in ("monotonicity", "robustness", "invariance")]
    spread = F.coalesce(F.col("stdev"), F.lit(0.0)) >= min_stdev
    rows.append(F.struct(F.lit("confidence").alias("check"), F.when(spread, 0).otherwise(1).cast("long").alias("violations"), spread.alias("passed")))
    return wide.select("n", "stdev", F.explode(F.array(*rows)).alias("r")).select("r.*", "n", "stdev")
