"""Retrieval queries on documents, benchmark, embeddings and conversations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions.hashing import md5_bucket
from tidemark.operators import retrieval as rt
from tidemark.operators.text_index import TextIndex, build_text_index, search_text_index
from tidemark.operators.vectors import build_vector_index, search_vector_index, semantic_cache_near
from tidemark.plans.registry import Tables, query

NOW = datetime(2024, 1, 31)
PATTERNS = ["ignore previous instructions", "disregard the above", "you are now", "system prompt:", "Copyright", "license"]


def corpus(t: Tables):
    """Documents with tenant and trust; sources are the tenants."""
    return t.documents.select(
        "doc_id", "text", "lang", "n_chars", F.col("source").alias("tenant_id"),
        (F.pmod("n_chars", F.lit(100)) / 100).alias("trust"),
    )


_CORPUS = "corpus AS (SELECT doc_id, text, lang, n_chars, source AS tenant_id, (n_chars % 100) / 100 AS trust FROM documents)"


@query(
    "p9_metadata_filter",
    f"""WITH {_CORPUS} SELECT doc_id, lang, n_chars FROM corpus
        WHERE tenant_id = 'src1' AND lang IN ('en', 'fr') AND n_chars >= 300 AND n_chars <= 9000 AND lang = 'en'""",
)
def metadata_filter(t: Tables):
    out = rt.metadata_filter(
        corpus(t), "src1", [("lang", "in", ["en", "fr"]), ("n_chars", "gte", 300), ("n_chars", "lte", 9000), ("lang", "eq", "en")]
    )
    return out.select("doc_id", "lang", "n_chars")


_HITS = "list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(text), '{p.lower()}') THEN '{p}' END" for p in PATTERNS
) + "], lambda p: p IS NOT NULL)"


@query("p10_injection_scan", f"SELECT doc_id, array_to_string({_HITS}, ';') AS hits, len({_HITS}) = 0 AS is_safe FROM documents")
def injection_scan(t: Tables):
    out = rt.injection_scan(t.documents, "text", PATTERNS)
    return out.select("doc_id", F.array_join("hits", ";").alias("hits"), "is_safe")


@query(
    "p10_injection_scan_many",
    """WITH w AS (SELECT list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
       p AS (SELECT DISTINCT array_to_string(list_slice(w, i, i + 1), ' ') AS pattern FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)),
       h AS (SELECT doc_id, pattern FROM documents, p WHERE contains(lower(text), lower(pattern))),
       f AS (SELECT doc_id, count(*)::bigint AS n_hits, string_agg(pattern, ';' ORDER BY pattern) AS hits FROM h GROUP BY 1)
       SELECT doc_id, coalesce(n_hits, 0) AS n_hits, coalesce(hits, '') AS hits, n_hits IS NULL AS is_safe FROM documents LEFT JOIN f USING (doc_id)""",
)
def injection_scan_many(t: Tables):
    """Every pair of neighbouring words of the benchmark as a pattern, over a thousand of them."""
    words = F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    patterns = t.benchmark.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(pairs).alias("pattern")).distinct()
    out = rt.injection_scan_many(t.documents.select("doc_id", "text"), "text", patterns)
    return out.select("doc_id", F.size("hits").cast("long").alias("n_hits"), F.array_join("hits", ";").alias("hits"), "is_safe")


@query("p11_trust_gate", f"WITH {_CORPUS} SELECT doc_id, trust FROM corpus WHERE trust >= 0.5")
def trust_gate(t: Tables):
    return rt.trust_gate(corpus(t), "trust").select("doc_id", "trust")


def updates(t: Tables):
    return t.events.select(F.col("user_id").alias("doc_id"), F.col("ts").alias("updated_at"))


@query(
    "p12_stale_document_sweep",
    """WITH s AS (SELECT user_id AS doc_id FROM events GROUP BY 1 HAVING date_diff('day', max(ts)::date, DATE '2024-01-31') > 1)
       SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)""",
)
def stale_sweep(t: Tables):
    out = rt.sweep_stale(t.documents, updates(t), "doc_id", "updated_at", 1, NOW)
    return out.select("doc_id", "lang")


def access(t: Tables):
    roles = F.when(F.pmod("n_chars", F.lit(3)) == 0, F.array(F.lit("viewer"))).otherwise(F.array(F.lit("viewer"), F.lit("editor")))
    # A fifth of the documents has no entry, which means no access.
    return corpus(t).where(F.col("trust") >= 0.2).select("doc_id", "tenant_id", roles.alias("allowed_roles"), "trust")


@query(
    "j6_acl_semi_join",
    f"WITH {_CORPUS} SELECT doc_id, lang FROM corpus WHERE trust >= 0.2 AND tenant_id = 'src2' AND n_chars % 3 <> 0",
)
def acl_semi_join(t: Tables):
    return rt.acl_filter(t.documents, access(t), "doc_id", "src2", "editor").select("doc_id", "lang")


@query(
    "a48_poisoning_suspects",
    f"""WITH {_CORPUS}, c AS (SELECT user_id AS doc_id, count(*) AS n FROM events
          WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1)
        SELECT doc_id, trust, coalesce(n, 0)::bigint AS retrievals FROM corpus LEFT JOIN c USING (doc_id)
        WHERE trust >= 0.2 AND (trust < 0.3 OR coalesce(n, 0) > 1)""",
)
def poisoning(t: Tables):
    reads = t.events.select(F.col("user_id").alias("doc_id"), "ts")
    out = rt.poisoning_suspects(access(t), reads, "doc_id", "ts", "trust", datetime(2024, 1, 15, 12), 0.3, 1)
    return out.select("doc_id", "trust", "retrievals")


_TERMS = r"list_filter(string_split(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def bm25_sql(name: str, k: int, k1: float, b: float) -> str:
    p = name + "_"
    return f"""
    {p}w AS (SELECT doc_id, {_TERMS.format(t='text')} AS w FROM documents),
    {p}s AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM {p}w),
    {p}q AS (SELECT item_id, unnest(list_distinct({_TERMS.format(t='text')})) AS t FROM benchmark),
    {p}x AS (SELECT doc_id, len(w) AS len, unnest(w) AS t FROM {p}w),
    {p}p AS (SELECT doc_id, len, t, count(*) AS tf FROM {p}x WHERE t IN (SELECT t FROM {p}q) GROUP BY 1, 2, 3),
    {p}d AS (SELECT t, count(*) AS df FROM {p}p GROUP BY 1),
    {p}c AS (SELECT item_id, doc_id, sum(tf * ({k1} + 1)::double / (tf + {k1}::double * (1 - {b}::double + {b}::double * len / avg_len))
               * ln(1 + (n - df + 0.5::double) / (df + 0.5::double))) AS score
             FROM {p}p JOIN {p}q USING (t) JOIN {p}d USING (t), {p}s GROUP BY 1, 2),
    {p}r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {p}c),
    {name} AS (SELECT item_id, doc_id, score, rank FROM {p}r WHERE rank <= {k})"""


def indexed(t: Tables) -> TextIndex:
    return build_text_index(t.documents, "doc_id", "text")


def bm25(t: Tables, index: TextIndex, k: int = 50, k1: float = 1.2, b: float = 0.75):
    return search_text_index(index, t.benchmark, "item_id", "text", k, k1, b).withColumnRenamed("doc", "doc_id")


@query(
    "t4_bm25_top_k",
    f"WITH {bm25_sql('a', 50, 1.2, 0.75)} SELECT item_id, doc_id, round(score, 6) AS score, rank::int AS rank FROM a",
)
def bm25_top_k(t: Tables):
    return bm25(t, indexed(t)).withColumn("score", F.round("score", 6))


@query(
    "j7_rrf_fuse",
    f"""WITH {bm25_sql('a', 50, 1.2, 0.75)}, {bm25_sql('z', 50, 2.0, 0.0)}
        SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9)::double AS rrf_score, count(*)::bigint AS n_lists
        FROM (SELECT * FROM a UNION ALL SELECT * FROM z) GROUP BY 1, 2""",
)
def rrf_fuse(t: Tables):
    index = indexed(t)
    out = rt.rrf_fuse([bm25(t, index), bm25(t, index, 50, 2.0, 0.0)], "item_id", "doc_id")
    return out.withColumn("rrf_score", F.round("rrf_score", 9))


@query(
    "w8_rerank_gain",
    f"""WITH {bm25_sql('a', 50, 1.2, 0.75)},
        c AS (SELECT item_id, doc_id, rank, ('0x' || substr(md5(item_id || ':' || doc_id), 1, 8))::bigint % 1000 AS s FROM a),
        f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, rank, doc_id) AS final_rank FROM c)
        SELECT item_id, doc_id, rank::int AS initial_rank, s::bigint AS rerank_score, final_rank::int AS final_rank, final_rank < rank AS improved
        FROM f WHERE final_rank <= 10""",
)
def rerank_gain(t: Tables):
    score = md5_bucket(F.concat_ws(":", "item_id", "doc_id"), 1000)
    rows = bm25(t, indexed(t)).select("item_id", "doc_id", F.col("rank").alias("initial_rank"), score.alias("rerank_score"))
    return rt.rerank_gain(rows, "item_id", "doc_id", "initial_rank", "rerank_score", 10)


_CENTROIDS = """
    e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings),
    x AS (SELECT label, unnest(v) AS m, unnest(range(1, len(v) + 1)) AS i FROM e),
    m AS (SELECT label, i, avg(m) AS m FROM x GROUP BY 1, 2),
    cent AS (SELECT label AS query, list(m ORDER BY i) AS c FROM m GROUP BY 1)"""
_TOP = f"""{_CENTROIDS},
    sims AS (SELECT query, vec_id, label, list_cosine_similarity(v, c) AS similarity FROM e, cent),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM sims)"""


def label_top(t: Tables, k: int):
    queries = rt.centroids(t.embeddings, "label", "embedding").select(F.col("label").alias("query"), "centroid")
    return rt.vector_top_k(t.embeddings, queries, "vec_id", "embedding", "query", "centroid", k)


@query(
    "t5_vector_top_k",
    f"WITH {_TOP} SELECT query, vec_id, round(similarity, 6) AS similarity, rank::int AS rank FROM rk WHERE rank <= 10",
)
def vector_top_k(t: Tables):
    return label_top(t, 10).withColumn("similarity", F.round("similarity", 6))


@query(
    "t5_vector_index",
    """SELECT vec_id AS query, least((SELECT count(*) FROM embeddings), 10)::int AS n_found, vec_id AS best, true AS recall_reached
       FROM embeddings WHERE vec_id % 100 = 0""",
)
def vector_index(t: Tables):
    """Neighbours by the stored index of every row whose id is divisible by 100, held against the exact ones."""
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked"))
    index = build_vector_index(t.embeddings, "vec_id", "embedding")
    found = search_vector_index(index, asked, "query", "asked", 10)
    exact = rt.vector_top_k(t.embeddings, asked, "vec_id", "embedding", "query", "asked", 10).select("query", F.col("vec_id").alias("key"), F.lit(1).alias("is_exact"))
    each = found.join(exact, ["query", "key"], "left").groupBy("query").agg(
        F.count("*").cast("int").alias("n_found"), F.max(F.when(F.col("rank") == 1, F.col("key"))).alias("best"), F.count("is_exact").alias("hits"))
    recall = each.agg(F.sum("hits") / F.sum("n_found")).scalar()
    return each.select("query", "n_found", "best", (recall >= 0.9).alias("recall_reached"))


@query(
    "a46_recall_at_k",
    f"""WITH {_TOP}, h AS (SELECT query, count(*)::bigint AS n_found FROM rk WHERE rank <= 50 AND query = label GROUP BY 1),
        w AS (SELECT label AS query, count(*)::bigint AS n_expected FROM e GROUP BY 1),
        r AS (SELECT query, n_expected, coalesce(n_found, 0) AS n_found, coalesce(n_found, 0) / n_expected AS recall FROM w LEFT JOIN h USING (query))
        SELECT query, n_expected, n_found, round(recall, 9) AS recall,
               CASE WHEN recall = 1 THEN 'none' WHEN n_found = 0 THEN 'no_relevant_doc' ELSE 'ranking_failure' END AS failure,
               round(avg(recall) OVER (), 9) AS mean_recall FROM r""",
)
def recall_at_k(t: Tables):
    expected = t.embeddings.select(F.col("label").alias("query"), "vec_id")
    results = rt.recall_at_k(label_top(t, 50), expected, "query", "vec_id", 50)
    summary = rt.recall_summary(results).select("failure", "mean_recall")
    out = results.join(summary, "failure")
    return out.withColumns({c: F.round(c, 9) for c in ("recall", "mean_recall")})


@query(
    "j10_semantic_cache_match",
    f"""WITH {_CENTROIDS}, r AS (SELECT vec_id, label, list_cosine_similarity(v, c) AS similarity FROM e JOIN cent ON label = query)
        SELECT vec_id, round(similarity, 6) AS similarity, CASE WHEN label < 7 AND similarity >= 0.15 THEN 'answer ' || label END AS response,
               label < 7 AND similarity >= 0.15 AS hit,
               round(count_if(label < 7 AND similarity >= 0.15) OVER () / count(*) OVER (), 9) AS hit_rate FROM r""",
)
def semantic_cache(t: Tables):
    center = rt.centroids(t.embeddings, "label", "embedding")
    requests = t.embeddings.join(center, "label").select(
        "vec_id", F.col("label").alias("query_hash"), rt.cosine(F.col("embedding"), F.col("centroid")).alias("similarity")
    )
    cached = center.where("label < 7").select(
        F.col("label").alias("query_hash"), F.concat(F.lit("answer "), F.col("label").cast("string")).alias("response")
    )
    out = rt.semantic_cache_match(requests, cached, "query_hash", "similarity", 0.15)
    rate = rt.hit_rate(out).select("hit_rate")
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"), "response", "hit", F.round(rate.scalar(), 9).alias("hit_rate"))


@query(
    "j10_semantic_cache_near",
    """WITH e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings),
       r AS (SELECT vec_id, list_transform(v, lambda x, i: x + ((vec_id * 31 + i * 17) % 13 - 6) * (0.004 + 0.002 * (vec_id % 5))) AS v FROM e),
       p AS (SELECT r.vec_id, e.vec_id AS entry, round(list_cosine_similarity(r.v, e.v), 9) AS similarity FROM r, e WHERE label < 7),
       b AS (SELECT * FROM p WHERE similarity >= 0.95 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, entry) = 1)
       SELECT r.vec_id, round(similarity, 6) AS similarity, 'answer ' || entry AS response, entry IS NOT NULL AS hit,
              round(count(entry) OVER () / count(*) OVER (), 9) AS hit_rate FROM r LEFT JOIN b USING (vec_id)""",
)
def semantic_cache_nearest(t: Tables):
    """Questions near a cached one, up to noise, get its answer; the similarity is found, not given."""
    noise = lambda x, i: x + (F.pmod(F.col("vec_id") * 31 + (i + 1) * 17, F.lit(13)) - 6) * (0.004 + 0.002 * F.pmod("vec_id", F.lit(5)))
    asked = t.embeddings.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), noise).alias("asked"))
    cached = t.embeddings.where("label < 7").select(
        F.col("vec_id").alias("entry"), "embedding", F.concat(F.lit("answer "), F.col("vec_id").cast("string")).alias("response"))
    out = semantic_cache_near(asked, cached, "vec_id", "asked", "entry", "embedding", 0.95).drop("asked")
    rate = rt.hit_rate(out).select("hit_rate")
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"), "response", "hit", F.round(rate.scalar(), 9).alias("hit_rate"))


@query(
    "j11_cache_invalidate",
    """WITH c AS (SELECT left(sha256(text), 12) AS query_hash, 'index-' || source AS index_version_id, 'prompt-' || lang AS prompt_version FROM documents)
       SELECT query_hash || ':' || index_version_id || ':' || prompt_version AS key,
              (SELECT count(*) FROM c WHERE index_version_id = 'index-src1')::bigint AS n_removed
       FROM c WHERE index_version_id <> 'index-src1'""",
)
def cache_invalidate(t: Tables):
    cache = t.documents.select(
        rt.content_hash(F.col("text")).alias("query_hash"), F.concat(F.lit("index-"), "source").alias("index_version_id"),
        F.concat(F.lit("prompt-"), "lang").alias("prompt_version"),
    )
    removed = cache.agg(F.count_if(F.col("index_version_id") == "index-src1").alias("n"))
    left = rt.cache_invalidate(cache, "index-src1")
    key = rt.cache_key(F.col("query_hash"), F.col("index_version_id"), F.col("prompt_version"))
    return left.select(key.alias("key"), removed.scalar().alias("n_removed"))


@query(
    "x1_chunk_documents",
    """WITH n AS (SELECT doc_id, text, greatest(ceil((length(text) - 512) / 462), 0)::int + 1 AS n FROM documents WHERE length(text) > 0)
       SELECT doc_id, i::int AS chunk_no, substr(text, (i * 462 + 1)::int, 512) AS chunk FROM (SELECT doc_id, text, unnest(range(0, n)) AS i FROM n)""",
)
def chunk_fixed(t: Tables):
    return rt.chunk_documents(t.spread("documents"), "doc_id", "text", "fixed_size", 512, 50)


_SENTENCES = r"list_filter(string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query(
    "x1_chunk_sentences",
    f"""WITH s AS (SELECT doc_id, {_SENTENCES.format(t='text')} AS p FROM documents)
        SELECT doc_id, i::int AS chunk_no, p[i + 1] AS chunk FROM (SELECT doc_id, p, unnest(range(0, len(p))) AS i FROM s)""",
)
def chunk_sentences(t: Tables):
    return rt.chunk_documents(t.spread("documents"), "doc_id", "text", "sentence")


def _refine_sql(source: str, split: str) -> str:
    return f"list_filter(flatten(list_transform({source}, lambda p: CASE WHEN length(p) <= 512 THEN [p] ELSE {split} END)), lambda z: z <> '')"


_FIXED = "list_transform(range(0, greatest(ceil((length(p) - 512) / 462), 0)::int + 1), lambda k: substr(p, (k * 462 + 1)::int, 512))"
_RECURSIVE = _refine_sql(
    _refine_sql(_refine_sql(_refine_sql("[text]", "string_split(p, chr(10) || chr(10))"), "string_split(p, chr(10))"), _SENTENCES.format(t="p")),
    _FIXED,
)


@query(
    "x1_chunk_recursive",
    f"""WITH s AS (SELECT doc_id, {_RECURSIVE} AS p FROM documents)
        SELECT doc_id, i::int AS chunk_no, p[i + 1] AS chunk FROM (SELECT doc_id, p, unnest(range(0, len(p))) AS i FROM s)""",
)
def chunk_recursive(t: Tables):
    return rt.chunk_documents(t.spread("documents"), "doc_id", "text", "recursive", 512, 50)


_COUNT = "CASE WHEN length(text) > 0 THEN greatest(ceil((length(text) - {s}) / ({s} - {o})), 0) + 1 ELSE 0 END"


@query(
    "x2_index_version_build",
    f"""WITH c AS (SELECT sum({_COUNT.format(s=512, o=50)})::bigint AS n, count(*)::bigint AS d FROM documents)
        SELECT 'v1' AS version_id, d AS num_documents, n AS num_chunks, left(sha256('encoder:fixed_size:' || n), 12) AS content_hash FROM c""",
)
def index_version(t: Tables):
    chunks = rt.chunk_documents(t.spread("documents"), "doc_id", "text", "fixed_size", 512, 50)
    return rt.index_version(chunks, t.documents, "v1", "encoder", "fixed_size").drop("fingerprint")


@query(
    "x3_content_hash",
    """SELECT doc_id, left(sha256(text), 12) AS content_hash, left(sha256(text), 12) || ':' || source || ':' || lang AS cache_key FROM documents""",
)
def content_hash(t: Tables):
    h = rt.content_hash(F.col("text"))
    return t.documents.select("doc_id", h.alias("content_hash"), rt.cache_key(h, F.col("source"), F.col("lang")).alias("cache_key"))


@query(
    "x4_render_template",
    """SELECT conv_id, turn, CASE WHEN role <> 'system' THEN 'As ' || role || ' in turn ' || turn || ': ' || text || '!' ELSE '' END AS rendered,
       CASE WHEN role = 'system' THEN 'text' ELSE '' END AS missing, '1.9' AS version FROM conversations""",
)
def render_template(t: Tables):
    prompts = t.spark.createDataFrame(
        [("chat", "1.10", "Old {role}", "production"), ("chat", "1.9", "As {role} in turn {turn}: {text}!", "production"),
         ("chat", "2.0", "Draft {role}", "draft")],
        "name string, version string, template string, status string",
    )
    live = rt.production_prompt(prompts)
    given = F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string"))
    values = F.when(F.col("role") == "system", given).otherwise(F.map_concat(given, F.create_map(F.lit("text"), F.col("text"))))
    rows = t.conversations.withColumns({
        "_template": live.select("template").scalar(), "version": live.select("version").scalar(), "_values": values,
    })
    out = rt.render_template(rows, F.col("_template"), F.col("_values"))
    return out.select(
        "conv_id", "turn", F.coalesce("rendered", F.lit("")).alias("rendered"), F.array_join("missing", ";").alias("missing"), "version"
    )


@query("x5_reference_text_scores")
def reference_text_scores(t: Tables):
    """Rows only: each reply against the turn before it."""
    reply = t.conversations.select("conv_id", "turn", F.col("text").alias("output"))
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("expected"))
    out = rt.reference_text_scores(reply.join(before, ["conv_id", "turn"]), "output", "expected")
    return out.select("conv_id", "turn", "exact_match", "rouge_l")


@query(
    "a50_chunk_experiment",
    f"""WITH j AS (SELECT text, quality FROM documents LEFT JOIN labels USING (doc_id)),
        a AS (SELECT avg(quality) AS rel, avg({_COUNT.format(s=256, o=25)}) AS c0, avg({_COUNT.format(s=512, o=50)}) AS c1,
                     avg(len({_SENTENCES.format(t='text')})) AS c2, avg(len({_RECURSIVE})) AS c3 FROM j)
        SELECT strategy, chunk_size, chunk_overlap, round(mean_chunks_per_doc, 6) AS mean_chunks_per_doc, round(rel, 6) AS mean_relevance FROM (
          SELECT 'fixed_size' AS strategy, 256 AS chunk_size, 25 AS chunk_overlap, c0 AS mean_chunks_per_doc, rel FROM a UNION ALL
          SELECT 'fixed_size', 512, 50, c1, rel FROM a UNION ALL SELECT 'sentence', 512, 0, c2, rel FROM a UNION ALL
          SELECT 'recursive', 512, 50, c3, rel FROM a)""",
)
def chunk_experiment(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    out = rt.chunk_experiment(
        rows, "text", "quality", [("fixed_size", 256, 25), ("fixed_size", 512, 50), ("sentence", 512, 0), ("recursive", 512, 50)]
    )
    return out.withColumns({c: F.round(c, 6) for c in ("mean_chunks_per_doc", "mean_relevance")})


def judged(t: Tables):
    """Judge values as columns of the labelled documents."""
    n = F.col("n_chars")
    claims = F.pmod(n, F.lit(7))
    chunks = F.pmod(n, F.lit(5))
    good = F.col("quality") == 1
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "lang", "source", "quality", "toxic", claims.alias("num_claims"),
        F.when(good, claims).otherwise(F.floor(claims / 2)).alias("num_supported_claims"),
        chunks.alias("num_chunks"), F.least(chunks, F.lit(2)).alias("num_relevant_chunks"),
        (F.pmod(n, F.lit(100)) / 100).alias("semantic_similarity"), F.when(good, 0.9).otherwise(0.4).alias("factual_overlap"),
    )


_JUDGED = """
    j AS (SELECT doc_id, lang, source, quality, toxic, n_chars % 7 AS nc, CASE WHEN quality = 1 THEN n_chars % 7 ELSE floor(n_chars % 7 / 2) END AS sc,
                 n_chars % 5 AS nk, least(n_chars % 5, 2) AS rk, (n_chars % 100) / 100 AS sem, CASE WHEN quality = 1 THEN 0.9 ELSE 0.4 END::double AS fact
          FROM documents JOIN labels USING (doc_id)),
    sc AS (SELECT *, CASE WHEN nc = 0 THEN 1.0 ELSE sc / nc END AS f, CASE WHEN nk = 0 THEN 1.0 ELSE rk / nk END AS c,
                  0.5 * sem + 0.5 * fact AS a FROM j)
"""


@query(
    "a43_rag_scores",
    f"""WITH {_JUDGED} SELECT lang, count(*)::bigint AS n, round(avg(f), 6) AS mean_faithfulness, round(avg(c), 6) AS mean_context_relevance,
        round(avg(a), 6) AS mean_correctness, count_if(f < 0.7)::bigint AS hallucination, count_if(c < 0.5)::bigint AS poor_retrieval,
        count_if(a < 0.6)::bigint AS wrong_answer, round((avg(f) + avg(c) + avg(a)) / 3, 6) AS overall FROM sc GROUP BY 1""",
)
def rag_scores(t: Tables):
    out = rt.rag_report(rt.rag_scores(judged(t)), ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_faithfulness", "mean_context_relevance", "mean_correctness", "overall")})


@query(
    "a44_eval_report",
    f"""WITH {_JUDGED}, r AS (SELECT lang AS dataset, CASE WHEN toxic = 1 THEN 'judge' ELSE 'exact_match' END AS method, sem * 5 / 5 AS s FROM sc)
        SELECT dataset, method, count(*)::bigint AS n, round(avg(s), 6) AS mean_score, round(avg((s >= 0.7)::int), 6) AS pass_rate FROM r GROUP BY 1, 2""",
)
def eval_report(t: Tables):
    rows = judged(t).select(
        F.col("lang").alias("dataset"), F.when(F.col("toxic") == 1, "judge").otherwise("exact_match").alias("method"),
        (F.col("semantic_similarity") * 5).alias("score"), F.lit(5.0).alias("max_score"),
    )
    out = rt.eval_report(rows, ["dataset", "method"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "pass_rate")})


@query(
    "a45_eval_by_slice",
    f"""WITH {_JUDGED}, l AS (SELECT 'lang' AS slice_field, lang AS slice_value, a FROM sc UNION ALL SELECT 'source', source, a FROM sc),
        m AS (SELECT slice_field, slice_value, avg(a) AS s, count(*)::bigint AS num_examples FROM l GROUP BY 1, 2)
        SELECT slice_field, slice_value, round(s, 6) AS mean_score, num_examples, s < 0.7 AS failing,
               row_number() OVER (ORDER BY s, slice_field, slice_value) = 1 AS is_worst FROM m""",
)
def eval_by_slice(t: Tables):
    out = rt.eval_by_slice(rt.rag_scores(judged(t)), ["lang", "source"], "correctness")
    return out.withColumn("mean_score", F.round("mean_score", 6))


GUARDS = [("tion", "LLM02"), ("system prompt:", "LLM01"), ("ing the", "LLM01"), ("eau", "LLM08")]


def _guard_hits(col: str) -> str:
    return " + ".join(f"contains(lower(coalesce({col}, '')), '{p}')::int" for p, _ in GUARDS)


def _guard_risk(risk: str) -> str:
    return " OR ".join(f"contains(lower(coalesce(c, '') || chr(1) || coalesce(o, '')), '{p}')" for p, r in GUARDS if r == risk)


@query(
    "a47_guardrail_report",
    f"""WITH r AS (SELECT conv_id, CASE WHEN role <> 'assistant' THEN text END AS c, CASE WHEN role = 'assistant' THEN text END AS o,
          CASE WHEN length(text) % 17 = 0 THEN 0.4 ELSE 0.9 END AS trust FROM conversations),
        g AS (SELECT conv_id, sum({_guard_hits('c')})::bigint AS ch, sum({_guard_hits('o')})::bigint AS oh, bool_and(trust >= 0.5) AS tp,
          bool_or({_guard_risk('LLM01')}) AS r1, bool_or({_guard_risk('LLM02')}) AS r2, bool_or({_guard_risk('LLM08')}) AS r8 FROM r GROUP BY 1)
        SELECT conv_id, ch AS context_hits, oh AS output_hits, tp AS trust_passed, ch = 0 AND oh = 0 AND tp AS is_safe,
          concat_ws(';', CASE WHEN r1 THEN 'LLM01' END, CASE WHEN r2 THEN 'LLM02' END, CASE WHEN r8 THEN 'LLM08' END) AS risks FROM g""",
)
def guardrail_report(t: Tables):
    reply = F.col("role") == "assistant"
    rows = t.conversations.select(
        "conv_id", F.when(~reply, F.col("text")).alias("context"), F.when(reply, F.col("text")).alias("output"),
        F.when(F.pmod(F.length("text"), F.lit(17)) == 0, 0.4).otherwise(0.9).alias("trust"),
    )
    out = rt.guardrail_report(rows, "conv_id", "context", "output", "trust", GUARDS)
    return out.withColumn("risks", F.array_join("risks", ";"))
