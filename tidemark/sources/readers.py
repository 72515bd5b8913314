"""Sources: raw credit files, feature sources, prediction logs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Expected rows (95% of 30,000 must be there) and required columns.
EXPECTED_ROWS = 30_000
REQUIRED_COLUMNS = (
    "ID", "LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE", "PAY_0", "DEFAULT_PAYMENT_NEXT_MONTH",
)
FRACTIONAL = ("LIMIT_BAL", "BILL_AMT", "PAY_AMT")


class SourceError(ValueError):
    """A source does not hold what it must."""


def normalise_names(df: DataFrame) -> DataFrame:
    """Column names stripped and upper-cased; PAY_1 becomes PAY_0 where that is absent."""
    names = [c.strip().upper() for c in df.columns]
    if "PAY_1" in names and "PAY_0" not in names:
        names = ["PAY_0" if n == "PAY_1" else n for n in names]
    return df.toDF(*names)


def raw_credit_scan(spark: SparkSession, path: str, min_rows: int = int(EXPECTED_ROWS * 0.95), check_rows: bool = True) -> DataFrame:
    """CSV with header to typed columns; no inference pass.

    Action: one count, unless ``check_rows`` is off because a later profile
    counts the rows anyway.
    """
    df = normalise_names(spark.read.csv(path, header=True))
    absent = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if absent:
        raise SourceError(f"columns missing after normalisation: {absent}")
    typed = df.select(*[
        F.col(c).try_cast("double" if c.startswith(FRACTIONAL) else "bigint").alias(c) for c in df.columns
    ])
    if check_rows:
        n = df.count()
        if n < min_rows:
            raise SourceError(f"expected at least {min_rows} rows, got {n}")
    return typed


SOURCE_TYPES = ("parquet", "csv", "push", "request")


@dataclass(frozen=True)
class DataSource:
    """A named feature source."""

    name: str
    type: str
    path: str
    timestamp_field: str = "event_timestamp"
    entity_field: str = "entity_id"
    schema: str | None = None

    def __post_init__(self) -> None:
        if self.type not in SOURCE_TYPES:
            raise ValueError(f"type must be one of {SOURCE_TYPES}")


def offline_scan(
    spark: SparkSession, source: DataSource, start: datetime | None = None, end: datetime | None = None,
    missing_ok: bool = False,
) -> DataFrame:
    """Rows of a file source with both ends of the time range included.

    The filter is on the stored column, so it reaches the scan.
    """
    if source.type not in ("parquet", "csv"):
        raise ValueError("only parquet and csv sources are read in batch")
    reader = spark.read.schema(source.schema) if source.schema else spark.read
    try:
        df = reader.parquet(source.path) if source.type == "parquet" else reader.csv(source.path, header=True)
    except Exception as e:
        if missing_ok and source.schema and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], source.schema)
        raise
    ts = source.timestamp_field
    kind = dict(df.dtypes)[ts]
    stored = F.col(ts) if kind.startswith("timestamp") else F.to_timestamp(ts)

    def bound(value: datetime):
        # The literal takes the stored type, so that no cast hides the column from the scan.
        return F.lit(value).cast("timestamp_ntz") if kind == "timestamp_ntz" else F.lit(value).cast("timestamp")

    if start is not None:
        df = df.where(stored >= bound(start))
    if end is not None:
        df = df.where(stored <= bound(end))
    return df.withColumn(ts, stored.cast("timestamp"))


PREDICTION_SCHEMA = T.StructType([
    T.StructField("prediction_id", T.StringType()), T.StructField("correlation_id", T.StringType()),
    T.StructField("entity_key", T.StringType()), T.StructField("model_version", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("decision", T.StringType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("prediction_ts", T.StringType()), T.StructField("latency_ms", T.DoubleType()),
    T.StructField("environment", T.StringType()), T.StructField("_corrupt_record", T.StringType()),
])
PREDICTION_KEYS = ("prediction_id", "correlation_id", "entity_key", "model_version", "score", "decision")
DECISIONS = ("approve", "review", "decline")


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """Every log line with ``problem`` (null when good).

    A timestamp that cannot be parsed is null and flagged, never "now".
    """
    raw = spark.read.schema(PREDICTION_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return check_predictions(raw)


def check_predictions(raw: DataFrame) -> DataFrame:
    """Parsed log rows with the first problem found."""
    absent = F.lit(False)
    for c in PREDICTION_KEYS:
        absent = absent | F.col(c).isNull()
    problem = (
        F.when(F.col("_corrupt_record").isNotNull(), "malformed")
        .when(absent, "missing_key")
        .when(F.col("prediction_id") == "", "empty_id")
        .when(~F.col("score").between(0.0, 1.0), "score_range")
        .when(~F.col("decision").isin(*DECISIONS), "decision")
    )
    ts = F.try_to_timestamp("prediction_ts")
    return raw.withColumns({
        "problem": problem, "prediction_ts": ts, "bad_timestamp": ts.isNull(),
        "latency_ms": F.coalesce("latency_ms", F.lit(0.0)), "environment": F.coalesce("environment", F.lit("prod")),
    })


def good_predictions(log: DataFrame) -> DataFrame:
    return log.where(F.col("problem").isNull()).drop("problem", "_corrupt_record")


def quarantined_predictions(log: DataFrame) -> DataFrame:
    return log.where(F.col("problem").isNotNull())
