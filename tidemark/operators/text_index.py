"""Inverted index over documents, and BM25 ranking on it.

The index is dealt by document: a shard holds the postings of some documents
that were read together, one row per (shard, term), so a term that stands in
every document is one short row in each shard, and building shuffles no
posting.  A search sends blocks of queries to the shards and only reads
postings of asked terms; a shard scores a query's documents term by term, the
rarest first, and stops to take in new documents once no unseen one can reach
the best ``k``.  At most ``k`` documents a query, and ties at the cut, leave a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from tidemark.functions.ordering import top_k
from tidemark.functions.text import terms
from tidemark.session import scratch_dir

#: Postings of a shard, about, and queries of a block; both bound what a task holds.
SHARD_POSTINGS = 2_000_000
QUERY_BLOCK = 1024
#: Terms in one Arrow batch of postings, and words (one longer document is taken alone) that are counted at once.
TERMS_AT_ONCE = 5_000
WORDS_AT_ONCE = 200_000


@dataclass(frozen=True)
class TextIndex:
    """A stored index: ``postings`` by shard and term, ``terms`` with their document counts, ``shards``, and the corpus totals."""

    path: str
    documents: int
    mean_words: float

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def _stretches(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """First and last + 1 of runs of documents with about ``WORDS_AT_ONCE`` words."""
    ends, first = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, side="right")))
        yield first, last
        first = last


class _Shard:
    """Postings of the documents that a task has read since its last shard; terms are kept as numbers, their names once a stretch."""

    def __init__(self) -> None:
        self.docs, self.names, self.codes, self.rows, self.tfs, self.words, self.size, self.count, self.known = [], [], [], [], [], [], 0, 0, 0

    def add(self, docs: pa.Array, lists: pa.Array) -> None:
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        n = max(len(words.dictionary), 1)
        both = np.repeat(np.arange(len(docs)), sizes) * n + words.indices.to_numpy()
        both, tfs = np.unique(both, return_counts=True)
        row = both // n
        self.docs.append(docs)
        self.names.append(words.dictionary)
        self.codes.append((both % n + self.known).astype(np.int32))
        self.rows.append((row + self.count).astype(np.int32))
        self.tfs.append(tfs.astype(np.int32))
        self.words.append(sizes[row].astype(np.int32))
        self.known += len(words.dictionary)
        self.count += len(docs)
        self.size += len(row)

    def postings(self, number: int, target: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row per term, in the order of the terms."""
        terms = pa.concat_arrays(self.names).dictionary_encode()
        by_name = pc.sort_indices(terms.dictionary)
        place = np.empty(len(by_name), dtype=np.int32)
        place[by_name.to_numpy()] = np.arange(len(by_name), dtype=np.int32)
        code = place[terms.indices.to_numpy()][np.concatenate(self.codes)]
        order = np.argsort(code, kind="stable")
        ends = np.searchsorted(code[order], np.arange(len(by_name) + 1))
        docs, rows, tfs, words = pa.concat_arrays(self.docs), np.concatenate(self.rows)[order], np.concatenate(self.tfs)[order], np.concatenate(self.words)[order]
        names = terms.dictionary.take(by_name)
        for low in range(0, len(by_name), TERMS_AT_ONCE):
            high = min(low + TERMS_AT_ONCE, len(by_name))
            a, z = ends[low], ends[high]
            at = pa.array((ends[low : high + 1] - a).astype(np.int32))
            columns = [docs.take(pa.array(rows[a:z])), pa.array(tfs[a:z]), pa.array(words[a:z])]
            lists = [pa.ListArray.from_arrays(at, c).cast(f.type) for c, f in zip(columns, list(target)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(high - low, number)), names.slice(low, high - low), *lists], schema=target)


def build_text_index(documents: DataFrame, doc: str, text: str, path: str | None = None, shard_postings: int = SHARD_POSTINGS) -> TextIndex:
    """The index of all documents under ``path``; document ids are unique, a null text has no terms.

    Each task makes shards of the documents that it reads; only the document
    counts of the terms are shuffled, pre-added per task.
    """
    spark = documents.sparkSession
    path = path or scratch_dir(spark, "text-index")
    words = documents.select(F.col(doc).alias("doc"), F.coalesce(terms(F.col(text)), F.array().cast("array<string>")).alias("terms"))
    kind = words.schema["doc"].dataType
    schema = StructType().add("shard", LongType()).add("term", StringType()).add("docs", ArrayType(kind)).add(
        "tfs", ArrayType(IntegerType())).add("words", ArrayType(IntegerType()))
    target = to_arrow_schema(schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            docs, lists = batch.column("doc"), batch.column("terms")
            for first, last in _stretches(lists):
                shard.add(docs.slice(first, last - first), lists.slice(first, last - first))
                if shard.size >= shard_postings:
                    yield from shard.postings(number, target)
                    shard, number = _Shard(), number + 1
        if shard.size:
            yield from shard.postings(number, target)

    # in the order of the terms within a shard: a search skips the pages without an asked term
    words.mapInArrow(gather, schema).write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    occurring = F.aggregate("tfs", F.lit(0).cast("long"), lambda n, tf: n + tf)
    counts = stored.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.sum(occurring).alias("n_words"))
    counts.write.mode("overwrite").parquet(f"{path}/terms")
    stored.select("shard").distinct().write.mode("overwrite").parquet(f"{path}/shards")
    n_words = spark.read.parquet(f"{path}/terms").agg(F.sum("n_words")).first()[0] or 0
    total = documents.count()
    return TextIndex(path, total, n_words / max(total, 1))


def best_documents(lists: list[tuple[float, np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of documents that hold the best ``k``, from each term's (bound, document numbers, scores).

    Terms go by their bound, the largest score that one of their postings has,
    from the highest on.  Once the ``k``-th best score so far is above what all
    terms left can add, no document outside the ones seen can enter, and the
    terms left only add to those.
    """
    lists = sorted(lists, key=lambda x: -x[0])
    rest = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0.0)
    score, seen, closed = np.zeros(size), np.zeros(size, dtype=bool), False
    for i, (_, docs, scores) in enumerate(lists):
        if not closed and i and np.count_nonzero(seen) >= k:
            kth = np.partition(score[seen], -k)[-k]
            closed = kth > rest[i] + 1e-6
        if closed:
            inside = seen[docs]
            docs, scores = docs[inside], scores[inside]
        score[docs] += scores
        seen[docs] = True
    found = np.flatnonzero(seen)
    if len(found) > k:
        kth = np.partition(score[found], -k)[-k]
        found = found[score[found] >= kth - 1e-8]  # ties at the cut are settled at the end
    return found, score[found]


def search_text_index(index: TextIndex, queries: DataFrame, query: str, query_text: str, k: int = 50, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25: ``query, doc, score, rank``; equal scores go by document id.

    A term counts once a query.  A query without a known term has no row.  Neither vocabulary nor
    queries are gathered: query terms meet the stored terms in a join, and
    blocks of queries meet the shards' postings of their terms.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term"))
    n = index.documents
    weight = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    weighed = asked.join(index.table(spark, "terms"), "term").select(
        F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), "term", "query", weight.alias("idf"))
    path = scratch_dir(spark, "asked-terms")
    weighed.write.parquet(path)
    wanted = spark.read.parquet(path).groupBy("block", "term").agg(F.first("idf").alias("idf"))
    postings = index.table(spark, "postings")
    read = postings.join(wanted, "term").select("shard", "block", "term", "idf", "docs", "tfs", "words")
    per_block = spark.read.parquet(path).groupBy("block", "query").agg(F.collect_list("term").alias("terms"))
    # every shard sees every query: shards by blocks are few rows, which then meet the queries of their block
    pairs = index.table(spark, "shards").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    per_shard = pairs.join(per_block, "block")
    doc_type = postings.schema["docs"].dataType.elementType
    schema = StructType([weighed.schema["query"]]).add("doc", doc_type).add("score", DoubleType())
    target, mean = to_arrow_schema(schema), index.mean_words

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return target.empty_table()
        flat = held["docs"].combine_chunks().flatten()
        codes = flat.dictionary_encode()
        number = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = held["docs"].combine_chunks().value_lengths().to_numpy()
        tf = held["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        length = held["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        worth = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)) * np.repeat(held["idf"].to_numpy(), sizes)
        ends = np.cumsum(sizes)
        lists = {
            t: (float(worth[end - size : end].max()), number[end - size : end], worth[end - size : end])
            for t, end, size in zip(held["term"].to_pylist(), ends.tolist(), sizes.tolist(), strict=True)
        }
        rows, documents, scores = [], [], []
        for i, words in enumerate(asked["terms"].to_pylist()):
            own = [lists[t] for t in words if t in lists]
            if own:
                found, value = best_documents(own, len(codes.dictionary), k)
                rows.append(np.full(len(found), i))
                documents.append(found)
                scores.append(value)
        if not rows:
            return target.empty_table()
        return pa.Table.from_arrays([
            asked["query"].take(pa.array(np.concatenate(rows))), codes.dictionary.take(pa.array(np.concatenate(documents))), pa.array(np.concatenate(scores))
        ], schema=target)

    found = per_shard.groupBy("shard", "block").cogroup(read.groupBy("shard", "block")).applyInArrow(score, schema)
    # scores are rounded so that the order of additions cannot decide
    best = top_k(found, k, [F.round("score", 9).desc(), F.col("doc").asc()], ["query"], ["doc"])
    return best.select(F.col("query").alias(query), "doc", "score", "rank")
