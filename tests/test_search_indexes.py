"""Vector index, similarity join and inverted index against brute force."""

import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import retrieval as rt
from tidemark.operators import text_index, vectors
from tidemark.operators.text_index import best_documents, build_text_index, search_text_index
from tidemark.operators.vectors import bands_for, build_vector_index, nearest_above, search_vector_index, semantic_cache_near

VECTORS = "id long, v array<float>"


def clustered(n, dim=24, clusters=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return [(k, (centres[k % clusters] + 0.7 * rng.standard_normal(dim)).tolist()) for k in range(n)]


def plain_top(rows, asked, k):
    at = np.array([v for _, v in rows])
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    out = {}
    for q, v in asked:
        sims = at @ (np.array(v) / np.linalg.norm(v))
        out[q] = [rows[i][0] for i in sorted(range(len(rows)), key=lambda i: (-round(sims[i], 9), rows[i][0]))[:k]]
    return out


@pytest.fixture(scope="module")
def stored(spark):
    rows = clustered(3000)
    rows += [(10_000 + k, rows[5][1]) for k in range(1500)]  # a third of all rows is one vector
    df = spark.createDataFrame(rows + [(20_000, None), (20_001, []), (20_002, [0.0] * 24), (20_003, [float("nan")] * 24)], VECTORS)
    return rows, df, build_vector_index(df, "id", "v")


def test_vector_index_recall(spark, stored):
    rows, df, index = stored
    asked = [r for r in rows if r[0] % 100 == 0]
    want = plain_top(rows, asked, 10)
    got = search_vector_index(index, df.where("id % 100 = 0"), "id", "v", 10).collect()
    found = {q: [r["key"] for r in sorted(got, key=lambda r: r["rank"]) if r["id"] == q] for q in want}
    assert {r["id"] for r in got} == set(want)  # rows without a direction ask nothing
    recall = sum(len(set(found[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.9 and index.probes < len(index.centres)


def test_vector_index_holds_every_row_and_all_cells_are_exact(spark, stored):
    rows, df, index = stored
    ids = index.blocks(spark).select(F.explode("right_ids").alias("id")).collect()
    assert Counter(r["id"] for r in ids) == Counter(k for k, _ in rows)
    asked = rows[:40]
    got = search_vector_index(index, spark.createDataFrame(asked, VECTORS), "id", "v", 7, probes=len(index.centres)).collect()
    want = plain_top(rows, asked, 7)
    assert {(r["id"], r["rank"]): r["key"] for r in got} == {(q, i + 1): x for q, xs in want.items() for i, x in enumerate(xs)}


def test_vector_search_reads_only_probed_cells(spark, stored):
    _, df, index = stored
    plan = index.blocks(spark).where(F.col("cell").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    one = search_vector_index(index, df.where("id = 7"), "id", "v", 3, probes=1).collect()
    assert [r["key"] for r in one][0] == 7


def test_vector_index_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    index = build_vector_index(none, "id", "v")
    assert search_vector_index(index, spark.createDataFrame([(1, [1.0])], VECTORS), "id", "v").count() == 0


def test_band_plan():
    for threshold in (0.3, 0.8, 0.95, 0.999):
        bits, bands = bands_for(threshold)
        same = 1 - math.acos(threshold) / math.pi
        assert (1 - same**bits) ** bands <= 1e-9 and bands <= 256
    assert bands_for(1.0) == (16, 1) and bands_for(-1.0) == (0, 1)


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_nearest_above_equals_all_pairs(spark, threshold):
    rng = np.random.default_rng(1)
    right = clustered(400, seed=5)
    right += [(1000 + k, right[3][1]) for k in range(300)]
    left = [(k, (np.array(right[k % 400][1]) + rng.standard_normal(24) * rng.choice([0.05, 0.3, 0.9])).tolist()) for k in range(500)]
    left += [(2000 + k, left[3][1]) for k in range(300)] + [(5000, None), (5001, [0.0] * 24)]
    got = nearest_above(spark.createDataFrame(left, VECTORS), spark.createDataFrame(right, VECTORS), "id", "v", "id", "v", threshold)
    known = [(q, v) for q, v in left if v and any(v)]
    best = plain_top(right, known, 1)
    by_id = dict(right)
    want = {}
    for q, v in known:
        w = by_id[best[q][0]]
        sim = float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
        if round(sim, 9) >= threshold:
            want[q] = best[q][0]
    assert {r["left_id"]: r["right_id"] for r in got.collect()} == want and 0 < len(want) < len(known)


def test_near_cache(spark):
    cache = spark.createDataFrame([(1, [1.0, 0.0], "one"), (2, [0.0, 1.0], "two"), (3, [0.0, 2.0], "twin"), (4, None, "none")], "e long, v array<double>, response string")
    asked = spark.createDataFrame([(7, [2.0, 0.1]), (8, [1.0, 1.0]), (9, None), (10, [0.0, 5.0])], "r long, q array<double>")
    got = {r["r"]: (r["response"], r["hit"]) for r in semantic_cache_near(asked, cache, "r", "q", "e", "v").collect()}
    assert got == {7: ("one", True), 8: (None, False), 9: (None, False), 10: ("two", True)}
    assert rt.hit_rate(semantic_cache_near(asked, cache, "r", "q", "e", "v")).first()["hit_rate"] == 0.5
    assert semantic_cache_near(asked, cache.where("false"), "r", "q", "e", "v").where("hit").count() == 0


def plain_bm25(docs, asked, k, k1, b):
    words = {d: (t or "").split() for d, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for q, text in asked:
        scores = {}
        for d, ws in words.items():
            tf = Counter(ws)
            s = sum(tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ws) / mean)) * math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) for t in set(text.split()) if tf[t])
            if s > 0:
                scores[d] = s
        out[q] = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:k]
    return out


@pytest.mark.parametrize(("k", "k1", "b", "shards"), [(5, 1.2, 0.75, 300), (50, 2.0, 0.0, 1), (1, 1.2, 1.0, 1_000_000)])
def test_text_index_equals_the_formula(spark, k, k1, b, shards):
    rng = random.Random(k)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(5000)]
    docs = [(d, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) + " common") for d in range(600)] + [(600 + d, "same text here common") for d in range(200)]
    docs += [(900, None), (901, "")]
    asked = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(30)] + [("all", "common same"), ("no", "unknown"), ("twice", "w1 w1 common common")]
    index = build_text_index(spark.createDataFrame(docs, "d long, text string").repartition(5), "d", "text", shard_postings=shards)
    got = search_text_index(index, spark.createDataFrame(asked, "q string, t string"), "q", "t", k, k1, b).collect()
    want = plain_bm25(docs, asked, k, k1, b)
    assert {(r["q"], r["rank"]): r["doc"] for r in got} == {(q, i + 1): d for q, ds in want.items() for i, d in enumerate(ds)}


def test_best_documents_closes_early():
    """Once no unseen document can enter, postings of frequent terms take in none, and no score is lost."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, k = 300, int(rng.integers(1, 20))
        lists = []
        for _ in range(int(rng.integers(1, 9))):
            docs = np.flatnonzero(rng.random(n) < rng.choice([0.01, 0.1, 0.9]))
            if len(docs):
                worth = rng.random(len(docs)) * rng.choice([0.1, 1, 10])
                lists.append((worth.max(), docs, worth))
        if not lists:
            continue
        whole = np.zeros(n)
        for _, docs, worth in lists:
            whole[docs] += worth
        found, score = best_documents(lists, n, k)
        assert np.allclose(whole[found], score)
        best = np.sort(whole[whole > 0])[::-1][:k]
        assert np.allclose(np.sort(score)[::-1][:k], best)


def test_text_index_of_nothing(spark):
    none = spark.createDataFrame([], "d long, text string")
    asked = spark.createDataFrame([("q", "a")], "q string, t string")
    assert search_text_index(build_text_index(none, "d", "text"), asked, "q", "t").count() == 0
    index = build_text_index(spark.createDataFrame([(1, "a")], "d long, text string"), "d", "text")
    assert search_text_index(index, asked.where("false"), "q", "t").count() == 0


def test_long_batches_of_documents_are_counted_in_stretches():
    """Words of a batch are counted about WORDS_AT_ONCE at a time; a stretch more or less changes no posting."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rng = random.Random(2)
    lists = pa.array([[], [f"w{k}" for k in range(text_index.WORDS_AT_ONCE + 5)], []] + [rng.choices(["a", "b", "é", "z"], k=rng.randint(0, 900)) for _ in range(600)], pa.list_(pa.string()))
    docs, sizes = pa.array(range(len(lists))), lists.value_lengths().to_numpy()
    runs = list(text_index._stretches(lists))
    assert [a for a, _ in runs] == [0] + [z for _, z in runs[:-1]] and runs[-1][1] == len(lists)
    assert all(z == a + 1 or sizes[a:z].sum() <= text_index.WORDS_AT_ONCE for a, z in runs) and len(runs) > 2
    target = to_arrow_schema(StructType.fromDDL("shard long, term string, docs array<long>, tfs array<int>, words array<int>"))
    once, parts = text_index._Shard(), text_index._Shard()
    once.add(docs, lists)
    for a, z in runs:
        parts.add(docs.slice(a, z - a), lists.slice(a, z - a))
    told = [pa.Table.from_batches(s.postings(3, target)).to_pylist() for s in (once, parts)]
    assert told[0] == told[1] and once.size == parts.size
    at = {r["term"]: r for r in told[0]}
    plain = [Counter(x) for x in lists.to_pylist()]
    for term in ("a", "é", "w7"):
        held = [(d, c[term], sum(c.values())) for d, c in enumerate(plain) if c[term]]
        assert list(zip(at[term]["docs"], at[term]["tfs"], at[term]["words"], strict=True)) == held
    assert [r["term"] for r in told[0]] == sorted(at)


def test_exact_neighbours_hold_few_similarities_at_once():
    rng = np.random.default_rng(8)
    held, asked = rng.standard_normal((5000, 8)), rng.standard_normal((2048, 8))
    batch = pd.DataFrame({"_key": np.arange(5000), "_vec": list(held)})
    sent = SimpleNamespace(value=([str(q) for q in range(2048)], asked))
    tracemalloc.start()
    found = pd.concat(rt._batch_scorer(sent, 3)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64_000_000
    sims = (held / np.linalg.norm(held, axis=1, keepdims=True)) @ (asked / np.linalg.norm(asked, axis=1, keepdims=True)).T
    best = np.argsort(-sims, axis=0)[:3]
    assert len(found) == 3 * 2048
    got = found.groupby("query")["_key"].agg(set)
    assert all(got[str(q)] == {str(k) for k in best[:, q]} for q in range(0, 2048, 97))


def test_copies_for_probed_cells_are_made_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "COPIES_AT_ONCE", 7)
    monkeypatch.setattr(vectors, "SIMILARITIES_AT_ONCE", 40)
    centres = np.linalg.qr(np.random.default_rng(2).standard_normal((12, 12)))[0]
    rows = clustered(50, dim=12)
    packed = vectors._packed(spark.createDataFrame(rows, "id long, v array<double>").select("id", vectors.unit("v").alias("vector")))
    for cells in (1, 5, 12):
        got = {(r["id"], r["place"]): r["grp"] for r in vectors._near_cells(packed, centres, cells).select("id", "grp", "place").collect()}
        assert got == {(k, p): int(c) for k, v in rows for p, c in enumerate(np.argsort(-(centres @ np.array(v)))[:cells])}
