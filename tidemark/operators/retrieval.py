"""Retrieval over document tables: filters, ranking, fusion, chunking, evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.functions.hashing import short_sha256
from tidemark.functions.ordering import top_k
from tidemark.operators.governance import row_number_of
from tidemark.functions.text import (
    chunk_count, fixed_chunks, missing_names, pattern_hits, recursive_chunks, render, sentences, terms,
)

# Default phrases of the injection scan, all of one risk and severity.
INJECTION_PHRASES = ("ignore previous instructions", "disregard the above", "you are now", "system prompt:")
PROMPT_INJECTION = "LLM01"
OPERATORS = ("eq", "in", "gte", "lte")


# --- filters ------------------------------------------------------------------

def metadata_filter(df: DataFrame, tenant: str, filters: Sequence[tuple[str, str, object]] = (), tenant_col: str = "tenant_id") -> DataFrame:
    """Conjunction of (field, operator, value); the tenant condition is always part of it."""
    conds = [F.col(tenant_col) == tenant]
    for field, op, value in filters:
        if op not in OPERATORS:
            raise ValueError(f"operator must be one of {OPERATORS}")
        c = F.col(field)
        conds.append({"eq": lambda: c == value, "in": lambda: c.isin(list(value)),
                      "gte": lambda: c >= value, "lte": lambda: c <= value}[op]())
    return df.where(reduce(lambda a, b: a & b, conds))


def injection_scan(df: DataFrame, text: str, patterns: Sequence[str] = INJECTION_PHRASES) -> DataFrame:
    """Add the phrases found and whether the text is safe."""
    return df.withColumn("hits", pattern_hits(F.col(text), patterns)).withColumn("is_safe", F.size("hits") == 0)


#: Characters of patterns that are sent to the tasks at once; longer lists are further passes over the texts.
PATTERN_CHARS = 8_000_000


def injection_scan_many(df: DataFrame, text: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """As ``injection_scan`` for a table of any number of patterns: ``hits`` holds the found ones in their order as text.

    All patterns are looked for in one pass over a text with one automaton, so
    the time follows the text and not the number of patterns.  Case is ignored;
    patterns that differ only in case are found together, empty and null ones
    never.  A null text has no hits.
    """
    spark = df.sparkSession
    listed = patterns.select(F.col(pattern).alias("p"), F.lower(pattern).alias("low")).where(F.length("p") > 0).distinct()
    sizes = listed.agg(F.sum(F.length("p"))).first()[0] or 0
    passes = -(-sizes // PATTERN_CHARS)
    found = []
    for k in range(passes):
        block = listed.where(F.pmod(F.xxhash64("p"), F.lit(passes)) == k).collect()  # about PATTERN_CHARS characters
        found.append(_automaton_hits(spark.sparkContext.broadcast([(r["low"], r["p"]) for r in block]))(F.lower(F.col(text))))
    hits = F.array_sort(F.concat(*found)) if found else F.array().cast("array<string>")
    return df.withColumn("hits", hits).withColumn("is_safe", F.size("hits") == 0)


def _automaton_hits(sent):
    @F.pandas_udf("array<string>")
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spelled: dict[str, list[str]] = {}
        for low, p in sent.value:
            spelled.setdefault(low, []).append(p)
        automaton = ahocorasick.Automaton()
        for low, names in spelled.items():
            automaton.add_word(low, names)
        automaton.make_automaton()
        for some in texts:
            # a pattern inside a longer match ends at the same place and is told as well
            yield pd.Series([sorted({p for _, names in automaton.iter(t) for p in names}) if t else [] for t in some.fillna("")])

    return hits


def trust_gate(df: DataFrame, trust: str, minimum: float = 0.5) -> DataFrame:
    return df.where(F.col(trust) >= minimum)


def stale_documents(df: DataFrame, updated_at: str, ttl_days: int, now: datetime) -> DataFrame:
    """Add the age in days and whether it is above the limit."""
    age = F.datediff(F.lit(now), F.col(updated_at))
    return df.withColumn("age_days", age).withColumn("is_stale", F.col("age_days") > ttl_days)


def sweep_stale(documents: DataFrame, updates: DataFrame, key: str, updated_at: str, ttl_days: int, now: datetime) -> DataFrame:
    """Documents without those whose last update is too old."""
    last = updates.groupBy(key).agg(F.max(updated_at).alias(updated_at))
    stale = stale_documents(last, updated_at, ttl_days, now).where("is_stale").select(key)
    return documents.join(stale, key, "left_anti")


def acl_filter(documents: DataFrame, acl: DataFrame, key: str, tenant: str, role: str) -> DataFrame:
    """Documents whose access list names the tenant and the role; no entry means no access."""
    allowed = acl.where((F.col("tenant_id") == tenant) & F.array_contains("allowed_roles", role)).select(key)
    return documents.join(allowed, key, "left_semi")


def poisoning_suspects(
    acl: DataFrame, retrievals: DataFrame, key: str, ts: str, trust: str, now: datetime,
    min_trust: float = 0.3, max_per_hour: int = 1000,
) -> DataFrame:
    """Documents with low trust or too many retrievals in the last hour."""
    end = F.lit(now)
    recent = retrievals.where((F.col(ts) > end - F.expr("INTERVAL 1 HOUR")) & (F.col(ts) <= end))
    counts = recent.groupBy(key).agg(F.count("*").alias("retrievals"))
    out = acl.join(counts, key, "left").withColumn("retrievals", F.coalesce("retrievals", F.lit(0)))
    return out.where((F.col(trust) < min_trust) | (F.col("retrievals") > max_per_hour))


# --- ranking ------------------------------------------------------------------

QUERY_BLOCK = 2048
#: Similarities that a task holds at once.
SIMILARITIES_AT_ONCE = 1 << 20


def _blocks(rows: DataFrame, key: str, block: int) -> Iterator[list]:
    """Action: the rows in lists of at most ``block``, one hash range at a time."""
    total = rows.count()
    passes = max(1, -(-total // block))
    numbered = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(passes)))
    for i in range(passes):
        found = numbered.where(F.col("_block") == i).drop("_block").collect()
        for start in range(0, len(found), block):
            yield found[start:start + block]


def vector_top_k(
    vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, k: int = 10,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact cosine top-k per query vector: (query, key, similarity, rank).

    Action: reads the query vectors, in blocks of at most ``block`` rows that
    are sent to the tasks.  More queries than one block are further passes over
    the vectors.  Each Arrow batch keeps its own best ``k`` per query, so only
    candidates are shuffled.
    """
    spark = vectors.sparkSession
    names = queries.select(F.col(query).cast("string").alias("_q"), F.col(query_vector).cast("array<double>").alias("_v"))
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vec"))
    out = None
    for part in _blocks(names, "_q", block):
        sent = spark.sparkContext.broadcast(([r["_q"] for r in part], np.array([r["_v"] for r in part], dtype=np.float64)))
        found = rows.mapInPandas(_batch_scorer(sent, k), "query string, _key string, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query string, _key string, similarity double")
    key_type = dict(vectors.dtypes)[key]
    out = out.withColumn("_key", F.col("_key").cast(key_type))
    order = [F.round("similarity", 9).desc(), F.col("_key").asc()]
    best = top_k(out, k, order, ["query"], ["_key"])
    return best.select(
        F.col("query").cast(dict(queries.dtypes)[query]).alias(query), F.col("_key").alias(key), "similarity", "rank"
    )


def _batch_scorer(sent, k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = sent.value
        norms = np.linalg.norm(matrix, axis=1)
        unit = matrix / np.where(norms == 0, 1, norms)[:, None]
        for batch in batches:
            if batch.empty:
                continue
            rows = np.array(batch["_vec"].tolist(), dtype=np.float64)
            length = np.linalg.norm(rows, axis=1)
            rows /= np.where(length == 0, 1, length)[:, None]
            keys = batch["_key"].astype(str).to_numpy()
            top = min(k, len(keys))
            each = max(1, SIMILARITIES_AT_ONCE // len(keys))
            for first in range(0, len(names), each):
                sims = rows @ unit[first : first + each].T
                # Ties at the cut stay in: the exact order is settled in the final step.
                cut = np.partition(sims, len(keys) - top, axis=0)[len(keys) - top]
                r, q = np.nonzero(sims >= cut - 1e-9)
                yield pd.DataFrame({"query": np.array(names, dtype=object)[q + first], "_key": keys[r], "similarity": sims[r, q]})
    return score


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group, summed on the map side."""
    out = df.groupBy(group).agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("_c"))
    return out.select(group, vector_to_array("_c").alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)

    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rrf_fuse(rank_lists: Sequence[DataFrame], query: str, doc: str, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over all lists that hold the document."""
    if k <= 0:
        raise ValueError("k must be positive")
    rows = [r.select(query, doc, (1.0 / (k + F.col("rank"))).alias("_s")) for r in rank_lists]
    merged = reduce(lambda a, b: a.unionByName(b), rows)
    return merged.groupBy(query, doc).agg(F.sum("_s").alias("rrf_score"), F.count("*").alias("n_lists"))


def rerank_gain(candidates: DataFrame, query: str, doc: str, initial: str, score: str, k: int = 10) -> DataFrame:
    """Final rank by the rerank score, the best ``k`` per query, and who moved up."""
    order = [F.col(score).desc(), F.col(initial).asc(), F.col(doc).asc()]
    out = top_k(candidates, k, order, [query], [doc], rank="final_rank")
    return out.withColumn("improved", F.col("final_rank") < F.col(initial))


# --- caches -------------------------------------------------------------------

def semantic_cache_match(
    requests: DataFrame, cache: DataFrame, key: str, similarity: str, threshold: float = 0.95
) -> DataFrame:
    """Cached response where the hash is known and the similarity reaches the entry's limit."""
    limit = F.coalesce(F.col("threshold"), F.lit(threshold)) if "threshold" in cache.columns else F.lit(threshold)
    entries = cache.select(key, "response", limit.alias("_limit"))
    out = requests.join(entries, key, "left")
    hit = F.coalesce(F.col(similarity) >= F.col("_limit"), F.lit(False))
    return out.select(*requests.columns, F.when(hit, F.col("response")).alias("response"), hit.alias("hit"))


def hit_rate(matched: DataFrame) -> DataFrame:
    out = matched.agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"))
    return out.withColumn("hit_rate", F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)))


def cache_invalidate(cache: DataFrame, version: str, version_col: str = "index_version_id") -> DataFrame:
    """Entries that stay once one index version is dropped."""
    return cache.where(F.col(version_col) != version)


def content_hash(text: Column) -> Column:
    return short_sha256(text, 12)


def cache_key(query_hash: Column, index_version: Column, prompt_version: Column) -> Column:
    return F.concat_ws(":", query_hash, index_version, prompt_version)


# --- chunks and index versions ------------------------------------------------

STRATEGIES = ("fixed_size", "sentence", "recursive")


def chunk_documents(
    df: DataFrame, doc: str, text: str, strategy: str = "fixed_size", size: int = 512, overlap: int = 50
) -> DataFrame:
    """(doc, chunk_no, chunk) by one of three strategies; a narrow operation."""
    pieces = {
        "fixed_size": lambda: fixed_chunks(F.col(text), size, overlap),
        "sentence": lambda: sentences(F.col(text)),
        "recursive": lambda: recursive_chunks(F.col(text), size, overlap),
    }
    if strategy not in pieces:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    return df.select(F.col(doc), F.posexplode(pieces[strategy]()).alias("chunk_no", "chunk"))


def index_version(chunks: DataFrame, documents: DataFrame, version: str, model: str, strategy: str) -> DataFrame:
    """One row: counts, the short hash of the build and a content fingerprint."""
    n_docs = documents.agg(F.count("*").alias("n"))
    print_ = F.sum(row_number_of(chunks.columns))
    out = chunks.agg(F.count("*").alias("num_chunks"), F.coalesce(print_, F.lit(0).cast("decimal(38,0)")).alias("fingerprint"))
    out = out.withColumn("num_documents", n_docs.scalar())
    raw = F.concat_ws(":", F.lit(model), F.lit(strategy), F.col("num_chunks").cast("string"))
    return out.select(
        F.lit(version).alias("version_id"), "num_documents", "num_chunks", content_hash(raw).alias("content_hash"), "fingerprint"
    )


def chunk_experiment(df: DataFrame, text: str, relevance: str, configs: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Mean chunks per document and mean relevance per (strategy, size, overlap).

    Chunks are counted inside the row; nothing is exploded.
    """
    def count(strategy: str, size: int, overlap: int) -> Column:
        if strategy == "fixed_size":
            return F.when(F.length(text) > 0, chunk_count(F.length(text), size, overlap)).otherwise(F.lit(0))
        if strategy == "sentence":
            return F.size(sentences(F.col(text)))
        return F.size(recursive_chunks(F.col(text), size, overlap))

    aggs = [F.avg(count(*c)).alias(f"c{i}") for i, c in enumerate(configs)]
    wide = df.agg(F.avg(relevance).alias("_rel"), *aggs)
    rows = [
        F.struct(F.lit(s).alias("strategy"), F.lit(n).alias("chunk_size"), F.lit(o).alias("chunk_overlap"), F.col(f"c{i}").alias("mean_chunks_per_doc"))
        for i, (s, n, o) in enumerate(configs)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r"), "_rel").select("r.*", F.col("_rel").alias("mean_relevance"))


# --- prompts ------------------------------------------------------------------

def production_prompt(prompts: DataFrame) -> DataFrame:
    """Greatest production version string per prompt name."""
    live = prompts.where(F.col("status") == "production")
    return live.groupBy("name").agg(F.max_by("template", "version").alias("template"), F.max("version").alias("version"))


def render_template(df: DataFrame, template: Column, values: Column) -> DataFrame:
    """Add the rendered prompt, or the names that are missing."""
    return df.withColumns({"rendered": render(template, values), "missing": missing_names(template, values)})


# --- text scores --------------------------------------------------------------

def _lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence with one bit per word of ``a``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = places.get(w, 0)
        row = ((row + (row & m)) | (row & ~m)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(LongType())
def lcs_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common subsequence length of two word arrays, whole arrays, per Arrow batch."""
    return pd.Series([_lcs_length(list(x), list(y)) for x, y in zip(a, b)])


def reference_text_scores(df: DataFrame, output: str, expected: str) -> DataFrame:
    """Exact match and ROUGE-L (F1 of the common subsequence) of output and expected text."""
    rows = df.withColumns({"_a": terms(F.coalesce(output, F.lit(""))), "_b": terms(F.coalesce(expected, F.lit("")))})
    rows = rows.withColumn("_l", lcs_words("_a", "_b"))
    p, r = F.try_divide(F.col("_l"), F.size("_a")), F.try_divide(F.col("_l"), F.size("_b"))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.withColumns({
        "exact_match": (F.col(output) == F.col(expected)).cast("int"), "rouge_l": f1,
    }).drop("_a", "_b", "_l")


# --- evaluation ---------------------------------------------------------------

def rag_scores(df: DataFrame, weight_semantic: float = 0.5) -> DataFrame:
    """Row scores of grounded answers from judge columns."""
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) == 0, F.lit(1.0)).otherwise(F.try_divide(F.col(part), F.col(whole)))

    return df.withColumns({
        "faithfulness": share("num_supported_claims", "num_claims"),
        "context_relevance": share("num_relevant_chunks", "num_chunks"),
        "correctness": weight_semantic * F.col("semantic_similarity") + (1 - weight_semantic) * F.col("factual_overlap"),
    })


def rag_report(scores: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Means, their mean, and how many rows fail in which way."""
    means = {c: F.coalesce(F.avg(c), F.lit(0.0)) for c in ("faithfulness", "context_relevance", "correctness")}
    out = scores.groupBy(*groups).agg(
        F.count("*").alias("n"), *[v.alias(f"mean_{c}") for c, v in means.items()],
        F.count_if(F.col("faithfulness") < 0.7).alias("hallucination"),
        F.count_if(F.col("context_relevance") < 0.5).alias("poor_retrieval"),
        F.count_if(F.col("correctness") < 0.6).alias("wrong_answer"),
    )
    return out.withColumn("overall", (F.col("mean_faithfulness") + F.col("mean_context_relevance") + F.col("mean_correctness")) / 3)


def eval_report(df: DataFrame, groups: Sequence[str], score: str = "score", max_score: str = "max_score", threshold: float = 0.7) -> DataFrame:
    """Mean normalised score and pass rate per dataset and method."""
    normal = F.col(score) / F.col(max_score)
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(normal).alias("mean_score"), F.avg((normal >= threshold).cast("double")).alias("pass_rate")
    )


def eval_by_slice(df: DataFrame, fields: Sequence[str], score: str, threshold: float = 0.7) -> DataFrame:
    """Mean score per (field, value), failing slices and the worst one marked."""
    text = df.select(score, *[F.col(c).cast("string").alias(c) for c in fields])
    long = text.unpivot([score], list(fields), "slice_field", "slice_value")
    out = long.groupBy("slice_field", "slice_value").agg(F.avg(score).alias("mean_score"), F.count("*").alias("num_examples"))
    key = F.struct(F.col("mean_score"), F.col("slice_field"), F.col("slice_value"))
    worst = out.agg(F.min(key).alias("w"))
    return out.withColumn("failing", F.col("mean_score") < threshold).withColumn("is_worst", key == worst.scalar())


def recall_at_k(retrieved: DataFrame, expected: DataFrame, query: str, doc: str, k: int = 10) -> DataFrame:
    """Recall and failure kind per query, from long (query, doc[, rank]) tables.

    Queries whose expected set is large are never gathered into arrays.
    """
    want = expected.select(query, doc).distinct()
    got = retrieved.where(F.col("rank") <= k).select(query, doc).distinct().withColumn("_hit", F.lit(1))
    out = want.join(got, [query, doc], "left").groupBy(query).agg(
        F.count("*").alias("n_expected"), F.count("_hit").alias("n_found")
    )
    return _failure_kind(out.withColumn("recall", F.col("n_found") / F.col("n_expected")))


def recall_of_arrays(df: DataFrame, retrieved: str, expected: str, k: int = 10) -> DataFrame:
    """The same where each row already holds both id arrays."""
    top = F.slice(F.col(retrieved), 1, k)
    want = F.array_distinct(expected)
    found = F.size(F.array_intersect(top, want))
    recall = F.coalesce(F.try_divide(found, F.size(want)), F.lit(0.0))
    return _failure_kind(df.withColumns({"n_expected": F.size(want), "n_found": found, "recall": recall}))


def _failure_kind(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("recall") == 1.0, "none").when(F.col("n_found") == 0, "no_relevant_doc").otherwise("ranking_failure")
    return df.withColumn("failure", kind)


def recall_summary(results: DataFrame) -> DataFrame:
    """Mean recall and queries per failure kind."""
    return results.groupBy("failure").agg(F.count("*").alias("n")).withColumn(
        "mean_recall", results.agg(F.avg("recall").alias("m")).scalar()
    )


def guardrail_report(
    df: DataFrame, query: str, context: str, output: str, trust: str, patterns: Sequence[tuple[str, str]], min_trust: float = 0.5
) -> DataFrame:
    """Per query: phrases in context and output, trust, the verdict and the risks."""
    names = [p for p, _ in patterns]
    rows = df.withColumns({"_ctx": pattern_hits(F.coalesce(context, F.lit("")), names),
                           "_out": pattern_hits(F.coalesce(output, F.lit("")), names)})
    by_risk: dict[str, list[str]] = {}
    for p, risk in patterns:
        by_risk.setdefault(risk, []).append(p)
    both = F.array_union("_ctx", "_out")
    risks = {r: F.bool_or(F.arrays_overlap(both, F.array(*[F.lit(p) for p in ps]))) for r, ps in by_risk.items()}
    out = rows.groupBy(query).agg(
        F.sum(F.size("_ctx")).alias("context_hits"), F.sum(F.size("_out")).alias("output_hits"),
        F.bool_and(F.col(trust) >= min_trust).alias("trust_passed"), *[c.alias(f"_r_{r}") for r, c in risks.items()],
    )
    listed = F.filter(F.array(*[F.when(F.col(f"_r_{r}"), r) for r in sorted(risks)]), lambda x: x.isNotNull())
    safe = (F.col("context_hits") == 0) & (F.col("output_hits") == 0) & F.col("trust_passed")
    return out.select(query, "context_hits", "output_hits", "trust_passed", safe.alias("is_safe"), listed.alias("risks"))
