"""Named queries over the benchmark tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import configure

#: Rows of a spread table in one task, about.
SPREAD_ROWS = 1_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables as DataFrames; event time as a UTC timestamp."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        for field in df.schema.fields:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
        return df


    def spread(self, name: str) -> DataFrame:
        """The table with its rows spread over tasks where its scan has fewer than cores, or than its rows need."""
        df = getattr(self, name)
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
        if df.rdd.getNumPartitions() < tasks:
            return df.repartition(tasks, df.columns[0])
        return df


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(Tables(spark, str(sf_dir).rstrip("/")))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def micros(col: str):
    """Event time as a number, the same on every engine and time zone."""
    return F.unix_micros(F.col(col))
