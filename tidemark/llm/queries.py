"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import sql
from tidemark.llm.chat import format_trees, masked_text, read_turns, thread_nodes
from tidemark.llm.common import text_of, written
from tidemark.llm.conversation_repair import repair_conversations
from tidemark.llm.damage import with_faults, with_planted_runs
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.license_scan import scan_licences, train
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.packing import pack
from tidemark.llm.periodic_runs import periodic_runs, strongest
from tidemark.llm.pu_quality import quality_scores
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.token_output import read_tokens, write_tokens
from tidemark.llm.warc import convert_arc, read_warc, with_referred, write_arc
from tidemark.session import configure, scratch_dir


#: Where the vocabulary files lie; they are never copied.
TOKENIZERS = "/opt/tokenizers"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays; texts are compared unchanged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(text_of("text").cast("binary"), 256))
    return exact_dedup(docs, carry=["doc_id", "text_sha256"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; cutoffs certified per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs, table(spark, sf_dir, "labels"), carry=["doc_id"]).drop("rules_failed")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages of 20 words or more that start earlier."""
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written in blocks and read back."""
    path = scratch_dir(spark, "token-output")
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, f"{TOKENIZERS}/word_bpe_49k.json", END_ID, folded=True)
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return read_tokens(spark, path).select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, _ = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near copies: four-word shingles, similarity 0.8."""
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"], size=4, percent=80)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, sources weighing 1, 2, 3 in turn."""
    return mix(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 1024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, f"{TOKENIZERS}/byte_bpe_50k.json", END_ID, 1024)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, with digests read back from the output."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    out = format_trees(thread_nodes(given.unionByName(added)))
    back = out.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that the paragraphs of every document name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licences(docs, train(docs))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, and its text without their repeats; a tenth of the texts has a planted run."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), carry=["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = found.withColumn("best", strongest("runs"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after the query has damaged its rows."""
    given = table(spark, sf_dir, "conversations")
    report = repair_conversations(with_faults(given))
    said = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    report = report.withColumn("repaired_sha256", F.sha2(said.cast("binary"), 256)).withColumnRenamed("conv_id", "_id").drop("repaired")
    # a conversation that lost all its rows is reported too
    ids = given.select("conv_id").distinct()
    whole = ids.join(report, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    none = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return whole.fillna(none | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as legacy archives, converted to WARC and read back, equal payloads stored once."""
    legacy = write_arc(table(spark, sf_dir, "pages"), scratch_dir(spark, "arc"))
    records = written(read_warc(convert_arc(legacy, scratch_dir(spark, "warc"))), "warc-rows")
    return with_referred(records).select(
        "page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline over ``documents``."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup, "op2_quality_rules": op2_quality_rules, "op3_substring_dedup": op3_substring_dedup,
    "op4_token_output": op4_token_output,
    "op5_quality_classifier": op5_quality_classifier, "op6_near_dedup": op6_near_dedup, "op7_mixing": op7_mixing,
    "op8_packing": op8_packing, "op9_chat_format": op9_chat_format,
    "op10_license_scan": op10_license_scan, "op11_periodic_runs": op11_periodic_runs, "op12_conversation_repair": op12_conversation_repair, "op13_warc": op13_warc, "pipeline": pipeline,
}
ORACLES = {"op1_exact_dedup": sql.OP1, "op2_quality_rules": sql.OP2, "op3_substring_dedup": sql.OP3, "op7_mixing": sql.OP7, "op9_chat_format": sql.OP9,
           "op11_periodic_runs": sql.OP11, "op12_conversation_repair": sql.OP12, "op13_warc": sql.OP13}
