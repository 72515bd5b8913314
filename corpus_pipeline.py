"""A training corpus in five stages: quality rules, exact and near copies, mixing, packing.

Each stage reads the documents that the one before kept, as a Parquet table in
the shared folder, and returns documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import judge_exact
from tidemark.llm.mixing import judge_mix
from tidemark.llm.near_dedup import one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import judge_quality
from tidemark.llm.queries import END_ID, TOKENIZERS, table
from tidemark.session import scratch_dir


def _kept(judged: DataFrame) -> DataFrame:
    """Documents that stay, with their own columns, whatever their names."""
    return judged.where("kept").select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the certified rules of their language."""
    return _kept(judge_quality(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest id."""
    return _kept(judge_exact(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or up to three times."""
    mixed = judge_mix(docs).where("taken > 0")
    copies = F.sequence(F.lit(1).cast("long"), F.floor(F.col("taken") / F.col("size")))
    return mixed.select("doc", F.explode(copies)).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return pack(docs, f"{TOKENIZERS}/byte_bpe_50k.json", END_ID, 1024)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixture), ("packing", packing)]

#: Tokenizing and packing can't be told in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
