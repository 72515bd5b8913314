"""Retrieval against brute force; streaming runs and their batch twins."""

import json
import math
import os
import random
from collections import Counter, deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import terms
from tidemark.operators import retrieval as rt
from tidemark.operators import service as sv
from tidemark.operators.text_index import build_text_index, search_text_index
from tidemark.streaming import limits, push, windows

T0 = datetime(2024, 1, 1)
DOCS = [(1, "The cat sat on the mat. The end!"), (2, "A dog; a DOG and a cat"), (3, ""), (4, "Été à la plage, été"), (5, "the the the the cat")]


def test_bm25_equals_the_formula(spark):
    docs = spark.createDataFrame(DOCS, "d int, text string")
    asked = spark.createDataFrame([(10, "cat the the"), (11, "été dog"), (12, "unknown")], "q int, text string")
    index = build_text_index(docs, "d", "text", shard_postings=2)
    got = {(r["q"], r["doc"]): (r["score"], r["rank"]) for r in search_text_index(index, asked, "q", "text", k=2).collect()}
    words = {d: [w for w in "".join(c.lower() if c.isalnum() else " " for c in t).split()] for d, t in DOCS}
    avg = sum(map(len, words.values())) / len(words)
    want = {}
    for q, text in ((10, {"cat", "the"}), (11, {"été", "dog"})):
        scores = {}
        for d, ws in words.items():
            tf, s = Counter(ws), 0.0
            for t in text:
                df = sum(t in w for w in words.values())
                if tf[t]:
                    s += math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / avg))
            if s:
                scores[d] = s
        for i, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:2]):
            want[q, d] = (pytest.approx(scores[d]), i + 1)
    assert got == want


def test_vector_top_k_with_ties_and_blocks(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)] + [(50, [0.0] * 4), (51, [1.0, 0.0, 0.0, 0.0]), (52, [2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(vecs, "id int, v array<float>").repartition(3)
    asked = spark.createDataFrame([("x", [1.0, 0.0, 0.0, 0.0]), ("y", [0.0, 1.0, 1.0, 0.0])], "q string, v array<double>")
    m = np.array([v for _, v in vecs], dtype=np.float32).astype(float)
    norm = np.linalg.norm(m, axis=1)
    for block in (1, 100):
        out = rt.vector_top_k(df, asked, "id", "v", "q", "v", 5, block).collect()
        for q, v in (("x", [1, 0, 0, 0]), ("y", [0, 1, 1, 0])):
            sim = m @ np.array(v) / np.where(norm == 0, 1, norm) / np.linalg.norm(v)
            want = sorted(range(53), key=lambda i: (-round(sim[i], 9), i))[:5]
            assert [r["id"] for r in sorted((r for r in out if r["q"] == q), key=lambda r: r["rank"])] == want


def test_chunks_cover_whole_texts(spark):
    text = "One two. Three! " * 40 + "\n\n" + "x" * 150
    df = spark.createDataFrame([(1, text), (2, ""), (3, "short")], "d int, t string")
    fixed = [r["chunk"] for r in rt.chunk_documents(df, "d", "t", "fixed_size", 50, 10).where("d = 1").orderBy("chunk_no").collect()]
    assert fixed[0] + "".join(c[10:] for c in fixed[1:]) == text and all(len(c) <= 50 for c in fixed)
    rec = [r["chunk"] for r in rt.chunk_documents(df, "d", "t", "recursive", 60, 0).where("d = 1").orderBy("chunk_no").collect()]
    assert max(map(len, rec)) <= 60 and sum(c.count("x") for c in rec) == 150
    assert rt.chunk_documents(df, "d", "t", "fixed_size", 50, 10).where("d = 2").count() == 0
    with pytest.raises(ValueError):
        rt.chunk_documents(df, "d", "t", "fixed_size", 50, 50)


def test_rouge_equals_dynamic_programming(spark):
    pairs = [("the cat sat", "the cat sat"), ("a b c d e", "b d x e a"), ("", "a"), (" ".join("ab"[i % 2] for i in range(300)), " ".join("aab"[i % 3] for i in range(200)))]
    df = spark.createDataFrame(pairs, "o string, e string")

    def rouge(a, b):
        a, b = a.split(), b.split()
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        n = t[-1][-1]
        return 2 * n / (len(a) + len(b)) if n else 0.0

    for r in rt.reference_text_scores(df, "o", "e").collect():
        assert r["rouge_l"] == pytest.approx(rouge(r["o"], r["e"])) and r["exact_match"] == int(r["o"] == r["e"])


def test_template_filters_and_recall(spark):
    df = spark.createDataFrame([("Hi {name}, {x}!", {"name": "{x}", "x": "1"}), ("{a}{b}", {"a": "1"})], "t string, v map<string,string>")
    assert [(r["rendered"], r["missing"]) for r in rt.render_template(df, F.col("t"), F.col("v")).collect()] == [("Hi {x}, 1!", []), (None, ["b"])]
    docs = spark.createDataFrame([("d1", "t1", 3), ("d2", "t2", 3), ("d3", "t1", 9)], "d string, tenant_id string, n int")
    assert [r["d"] for r in rt.metadata_filter(docs, "t1", [("n", "lte", 5)]).collect()] == ["d1"]
    acl = spark.createDataFrame([("d1", "t1", ["viewer"]), ("d2", "t2", ["viewer"])], "d string, tenant_id string, allowed_roles array<string>")
    assert [r["d"] for r in rt.acl_filter(docs.select("d"), acl, "d", "t1", "viewer").collect()] == ["d1"]
    assert rt.acl_filter(docs.select("d"), acl, "d", "t1", "editor").count() == 0
    rows = spark.createDataFrame([(["a", "b", "c"], ["a", "c", "c"]), (["x"], ["a"]), (["a"], ["a"])], "r array<string>, e array<string>")
    assert [(r["recall"], r["failure"]) for r in rt.recall_of_arrays(rows, "r", "e", 2).collect()] == [(0.5, "ranking_failure"), (0.0, "no_relevant_doc"), (1.0, "none")]
    lists = [spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q int, d string, rank int"), spark.createDataFrame([(1, "b", 1)], "q int, d string, rank int")]
    assert {r["d"]: r["rrf_score"] for r in rt.rrf_fuse(lists, "q", "d").collect()} == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61})


def test_routes_and_traces(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (2.0,)], "s double")
    assert [r["route"] for r in sv.route_by_ceiling(df, "s", [("big", 1.0), ("small", 0.3)]).collect()] == ["small", "big", None]
    spans = spark.createDataFrame([("t", "", "llm_call", 5, 6, 10.0), ("t", "a", "llm_call", 1, 1, 4.0), ("t", "a", "retrieval", 9, 9, 3.0)],
                                  "trace_id string, parent_span_id string, kind string, prompt_tokens int, completion_tokens int, duration_ms double")
    r = sv.trace_rollup(spans).first()
    assert (r["duration_ms"], r["tokens"], r["n_spans"]) == (10.0, 13, 3)


def allow(times, limit, window):
    kept, out = deque(), []
    for t in times:
        while kept and kept[0] <= t - window:
            kept.popleft()
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def request_times(seed=3, n=400):
    rng = np.random.default_rng(seed)
    return {c: np.cumsum(rng.choice([0.0, 1.0, 5.0, 70.0], size=n, p=[0.2, 0.5, 0.25, 0.05])).tolist() for c in (1, 2)}


def test_rate_limit_equals_a_loop(spark):
    times = request_times()
    rows = [(c, c * 1000 + i, T0 + timedelta(seconds=t)) for c, ts in times.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "client int, req int, ts timestamp").repartition(5)
    got = {r["key"]: r["allowed"] for r in limits.rate_limit(df, "client", "ts", "req", 5, 60.0).collect()}
    for c, ts in times.items():
        assert [got[c * 1000 + i] for i in range(len(ts))] == allow(ts, 5, 60.0)
    assert not all(got.values())


def plain_limit(rows, most, window_us):
    out, accepted = {}, {}
    for c, k, us in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        kept = [x for x in accepted.get(c, []) if x > us - window_us]
        ok = len(kept) < most
        accepted[c] = kept + [us] * ok
        out[k] = (ok, most - len(accepted[c]))
    return out


@pytest.mark.parametrize(("most", "every"), [(1, 40), (3, 20), (8, 12), (200, 5)])
def test_rate_limit_of_bursts(spark, most, every):
    """Calm and crowded stretches, equal times, a client with a third of all requests, a null client."""
    rng = random.Random(most)
    rows, k = [], 0
    for c, n in ((1, 1500), (2, 400), (None, 300), (3, 1)):
        us = 0
        for _ in range(n):
            us += rng.choice([0, 0, 1_000_000, every * 1_000_000, 60_000_000, 59_999_999]) if rng.random() < 0.3 else rng.randint(0, 2 * every * 1_000_000)
            rows.append((c, k, us))
            k += 1
    df = spark.createDataFrame(rows + [(1, -1, None)], "client long, req long, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {r["key"]: (r["allowed"], r["remaining"]) for r in limits.rate_limit(df.repartition(6), "client", "ts", "req", most, 60.0).collect()}
    assert got.pop(-1) == (None, None)
    assert got == plain_limit(rows, most, 60_000_000)


def test_only_crowded_stretches_are_read_in_order(spark):
    """Of a busy client's calm requests none goes through the ordered pass."""
    rows = [(1, k, 1_000_000 * k) for k in range(5000)] + [(1, 10_000 + k, 2_000_000_000) for k in range(50)]
    df = spark.createDataFrame(rows, "client long, req long, us long").withColumn("ts", F.timestamp_micros("us"))
    demand = limits.with_demand(df.select(F.col("client").alias("_client"), F.col("us").alias("_us"), F.col("req").alias("_key")), 60_000_000)
    full = {r["_span"] for r in demand.where("_demand > 70").collect()}
    assert full == {33, 34} and demand.count() == len(rows)  # two of 84 minutes
    got = {r["key"]: (r["allowed"], r["remaining"]) for r in limits.rate_limit(df, "client", "ts", "req", 70, 60.0).collect()}
    assert got == plain_limit(rows, 70, 60_000_000)


def write_json(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    # Files are read in the order of their modification time.
    stamp = 1_600_000_000 + 10 * int(name.split(".")[0])
    os.utime(folder / name, (stamp, stamp))


def run_to_table(query, name, spark, mode):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_streaming_rate_limit_keeps_state_across_batches(spark, tmp_path):
    times = request_times(5, 120)[1]
    for b in range(3):
        write_json(tmp_path / "in", f"{b}.json", [{"client": 1, "request": i, "us": int(t * 1e6)} for i, t in enumerate(times) if i // 40 == b])
    stream = spark.readStream.schema("client bigint, request bigint, us bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {r["request"]: r["allowed"] for r in run_to_table(limits.stream_rate_limit(stream, 5, 60.0), "limited", spark, "append")}
    assert [got[i] for i in range(len(times))] == allow(times, 5, 60.0)


def test_streaming_values_keep_the_newest(spark, tmp_path):
    write_json(tmp_path / "in", "0.json", [{"key": 1, "value": 1.0, "us": 1}, {"key": 1, "value": 2.0, "us": 5}])
    stream = spark.readStream.schema("key bigint, value double, us bigint").json(str(tmp_path / "in"))
    # One batch: with a time to live, an available-now run never counts as finished.
    q = limits.stream_expiring_values(stream, 3600).writeStream.format("memory").queryName("expiring").outputMode("update").trigger(once=True).start()
    assert q.awaitTermination(60)
    assert [(r["value"], r["had_value"]) for r in spark.table("expiring").collect()] == [(2.0, False)]


def test_push_ingest_over_batches(spark, tmp_path):
    def event(i, user, minute, source, **features):
        return {"event_id": i, "user_id": user, "ts": (T0 + timedelta(minutes=minute)).isoformat(), "source_name": source, "payload": json.dumps(features)}

    write_json(tmp_path / "in", "0.json", [
        event(1, 1, 0, "tx", tx_count_last_hour=1, last_tx_amount=5.0, session_duration_s=9.0), event(2, 1, 5, "tx", tx_count_last_hour=2, last_tx_amount=6.0),
        event(3, 2, 0, "tx", tx_count_last_hour="x", last_tx_amount=1.0), event(4, 3, 0, "other", tx_count_last_hour=1, last_tx_amount=1.0)])
    write_json(tmp_path / "in", "1.json", [event(5, 1, 3, "tx", tx_count_last_hour=7, last_tx_amount=7.0, session_duration_s=8.0)])
    stream = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp, source_name string, payload string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    known = spark.createDataFrame([("tx",)], "source_name string")
    counts = {}
    q = push.start_push_ingest(stream, known, str(tmp_path / "log"), str(tmp_path / "bad"), str(tmp_path / "cp"), "user_id", "ts", "event_id", counts.__setitem__)
    assert q.awaitTermination(120)
    # The second batch is older: it only adds the feature the newer event did not name.
    got = {(r["user_id"], r["feature"]): r["value"] for r in push.latest_features(spark, str(tmp_path / "log"), "user_id").collect()}
    assert got == {(1, "tx_count_last_hour"): 2.0, (1, "last_tx_amount"): 6.0, (1, "session_duration_s"): 8.0}
    assert [r["event_id"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [3]
    assert counts[0] == {"n_events": 3, "n_dropped": 1}
    push.compact(spark, str(tmp_path / "log"), str(tmp_path / "base"), "user_id")
    again = {(r["user_id"], r["feature"]): r["value"] for r in push.latest_features(spark, str(tmp_path / "base"), "user_id").collect()}
    assert again == got


def test_streaming_windows_equal_their_batch_twin(spark, tmp_path):
    rows = [{"user": i % 2, "ts": (T0 + timedelta(minutes=7 * i)).isoformat(), "v": float(i)} for i in range(40)]
    write_json(tmp_path / "in", "0.json", rows[:20])
    write_json(tmp_path / "in", "1.json", rows[20:])
    schema = "user int, ts timestamp, v double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    table = spark.read.schema(schema).json(str(tmp_path / "in"))
    got = {tuple(r) for r in run_to_table(windows.hourly_features(stream, "ts", "user", "v"), "hourly", spark, "append")}
    want = {tuple(r) for r in windows.hourly_features(table, "ts", "user", "v").collect()}
    # Append mode holds back only the windows the watermark has not closed.
    closed = T0 + timedelta(minutes=7 * 39) - timedelta(minutes=10)
    assert got and got <= want and {w for w in want if w[2] <= closed} <= got
    s = {tuple(r) for r in run_to_table(windows.service_windows(stream, "ts", "v", F.col("v") > 30), "served", spark, "append")}
    assert s and s <= {tuple(r) for r in windows.service_windows(table, "ts", "v", F.col("v") > 30).collect()}


def test_terms_split_on_anything_but_letters_and_digits(spark):
    df = spark.createDataFrame([("Ça-va? 2x, OK__",)], "t string")
    assert df.select(terms(F.col("t")).alias("w")).first()["w"] == ["ça", "va", "2x", "ok"]


def test_latest_merge_replays_and_late_batches(spark, tmp_path):
    """A repeated batch changes nothing, a broken one is written over, older values overwrite nothing newer."""
    root = str(tmp_path / "latest")
    push.start_latest(spark, root)
    assert push.read_latest(spark, root, "user_id").count() == 0

    def deltas(*rows):
        df = spark.createDataFrame([(u, T0 + timedelta(minutes=m), f, v) for u, m, f, v in rows], "user_id long, ts timestamp, feature string, value double")
        return df.withColumn("text", F.col("value").cast("string"))

    def now():
        return {(r["user_id"], r["feature"]): r["value"] for r in push.read_latest(spark, root, "user_id").collect()}

    first = deltas((1, 10, "a", 1.0), (1, 10, "b", 2.0), (2, 5, "a", 3.0))
    assert push.merge_latest(first, 0, root, "user_id") and not push.merge_latest(deltas((1, 99, "a", 9.0)), 0, root, "user_id")
    assert now() == {(1, "a"): 1.0, (1, "b"): 2.0, (2, "a"): 3.0}
    # files of a merge that broke off before its manifest are not seen, and then replaced
    deltas((1, 50, "a", 7.0)).withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"{root}/data/version=1")
    assert now()[1, "a"] == 1.0
    assert push.merge_latest(deltas((1, 3, "a", 8.0), (1, 10, "b", 4.0), (3, 1, "c", 5.0)), 1, root, "user_id")
    assert now() == {(1, "a"): 1.0, (1, "b"): 4.0, (2, "a"): 3.0, (3, "c"): 5.0}
    assert push.merge_latest(deltas((2, 6, "a", 6.0)).where("false"), 2, root, "user_id")
    assert len(now()) == 4


def test_windows_drop_late_rows(spark, tmp_path):
    def write(name, rows):
        spark.createDataFrame([(k, T0 + timedelta(minutes=m), v) for k, m, v in rows], "k int, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    write("p=0", [(1, 1, 1.0), (1, 59, 3.0), (1, 70, 9.0)])
    stream = spark.readStream.schema("k int, ts timestamp, v double, p int").parquet(str(tmp_path / "in"))
    out = windows.service_windows(stream, "ts", "v", F.col("v") > 5, "1 hour", "10 minutes")
    arrivals = [lambda: None, lambda: write("p=1", [(1, 65, 2.0), (1, 300, 1.0)]), lambda: write("p=2", [(1, 301, 4.0)]), lambda: write("p=3", [(1, 2, 100.0), (1, 241, 7.0)])]
    got = windows.run_updates(out, str(tmp_path / "run"), ["window_start"], arrivals).orderBy("window_start").collect()
    assert [(r["n"], r["n_errors"], r["latency_p50"], r["latency_p95"]) for r in got] == [(2, 0, 1.0, 3.0), (2, 1, 2.0, 9.0), (1, 1, 7.0, 7.0), (2, 0, 1.0, 4.0)]


def test_window_updates_come_from_panes(spark, tmp_path, monkeypatch, capsys):
    """Emitted batch by batch as by Spark's own windows, rows late for some of their windows too; states grow with groups of keys, not with windows."""
    monkeypatch.setattr(windows, "KEY_GROUPS", 5)
    rng, big = random.Random(4), 2**60 + 1
    shape = "k long, ts timestamp, v double, n long"
    keys, values = [0, 1, 2, 3, None, big, big + 1], [None, float("nan"), -0.0, 2.5, 1e300]

    def rows(low, high, n, start):
        times = [T0 + timedelta(minutes=rng.randint(low, high), microseconds=rng.choice([0, 1, 999_999])) for _ in range(n)]
        return [(rng.choice(keys), t, rng.choice([*values, float(start + i)]), start + i) for i, t in enumerate(times)]

    parts = [
        rows(0, 90, 150, 0) + [(1, None, 1.0, -1), (0, T0, 7.0, None), (0, T0, 8.0, -5), (7, T0 + timedelta(days=-2), 3.0, -6)],
        rows(60, 130, 60, 1000),  # the watermark is at 80 minutes
        [(big, T0 + timedelta(minutes=61), 5.0, -2), (9, T0 + timedelta(minutes=1), 9.0, -3)],
        rows(-30, 110, 80, 2000) + [(2, T0 + timedelta(minutes=600), 1.0, 1)],
        rows(520, 560, 30, 3000) + [(3, T0 + timedelta(minutes=2000), 1.0, 3)],
    ]

    def run(name, **kind):
        def write(i):
            return lambda: spark.createDataFrame(parts[i], shape).coalesce(1).write.parquet(str(tmp_path / name / "in" / f"p={i}"))

        write(0)()
        stream = spark.readStream.schema(f"{shape}, p int").parquet(str(tmp_path / name / "in"))
        out = windows.hourly_features(stream, "ts", "k", "v", ties=["n"], **kind)
        last = windows.run_updates(out, str(tmp_path / name / "run"), ["k", "window_start"], [lambda: None, *map(write, range(1, len(parts)))])
        assert last.columns == out.columns
        told = spark.read.parquet(str(tmp_path / name / "run" / "windows"))
        assert told.groupBy("batch", "k", "window_start").count().where("count > 1").isEmpty()
        return out.dtypes, sorted(map(repr, last.collect())), sorted(map(repr, told.select("batch", *out.columns).collect())), last

    want, got = run("windows"), run("panes", updates=True)
    assert len(want[2]) > 400 and got[:3] == want[:3]
    got[3].explain()
    assert "SortAggregate" not in capsys.readouterr().out
    state = spark.read.format("statestore").option("path", str(tmp_path / "panes" / "run" / "checkpoint")).load()
    assert state.count() <= 5
    with pytest.raises(ValueError, match="whole slides"):
        windows.hourly_features(spark.readStream.schema(shape).parquet(str(tmp_path / "panes" / "in")), "ts", "k", "v", slide="7 minutes", updates=True)


def test_expiring_values_of_many_keys(spark, tmp_path, monkeypatch):
    """Keys share states and timers: each has its own newest value and expiry, a null key too; calls grow with groups of keys."""
    monkeypatch.setattr(limits, "KEY_GROUPS", 3)
    shape, big = "k long, ts timestamp, v double, push boolean, n long", 2**60

    def write(name, rows):
        made = [(k, T0 + timedelta(minutes=m), v, push, n) for k, m, v, push, n in rows]
        spark.createDataFrame(made, shape).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    write("p=0", [(k, 0, float(k), k % 2 == 0, k) for k in range(40)] + [(None, 1, 5.0, True, 7), (big, 2, 1.0, False, 1), (big + 1, 2, None, False, 1), (0, 0, -1.0, True, -1)])
    stream = spark.readStream.schema(f"{shape}, p int").parquet(str(tmp_path / "in"))
    out = limits.stream_expiring_table(stream, "k", "v", "ts", "push", "n")
    assert len({r["keys"] for r in spark.range(40).selectExpr("pmod(xxhash64(id), 3) keys").collect()}) == 3
    # key 1 gets a newer value, key 3 an older one; then the watermark passes the pushed values' hour; last comes a row that is too late
    arrivals = [lambda: None, lambda: write("p=1", [(1, 30, 100.0, True, 0), (3, -5, 9.0, True, 0), (-1, 75, 0.0, True, 0)]), lambda: write("p=2", [(-1, 200, 1.0, False, 0)]),
                lambda: write("p=3", [(5, 20, 50.0, True, 0), (2, 195, 20.0, False, 0)])]
    got = windows.run_updates(out, str(tmp_path / "run"), ["key"], arrivals, ties=["us", "expired"]).collect()
    minute = {r["key"]: (round((r["us"] / 1e6 - T0.timestamp()) / 60), r["value"], r["expired"]) for r in got}
    want = {k: (0, float(k), k % 2 == 0) for k in range(40)}
    want |= {1: (30, 100.0, True), 2: (195, 20.0, False), None: (1, 5.0, True), big: (2, 1.0, False), big + 1: (2, None, False), -1: (200, 1.0, False)}
    assert minute == want and all(r["expire_us"] - r["us"] in (3_600_000_000, 86_400_000_000) for r in got)
    state = spark.read.format("statestore").option("stateVarName", "values").option("path", str(tmp_path / "run" / "checkpoint")).load()
    assert state.select("key").distinct().count() <= 3


def test_scan_for_many_patterns(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAB é\n") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "aaaa"]
    patterns = ["".join(rng.choice("abAB é") for _ in range(rng.randint(1, 4))) for _ in range(300)] + ["", None, "aa", "aaa", "AA"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    listed = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = {d: sorted({p for p in patterns if p and t and p.lower() in t.lower()}) for d, t in enumerate(texts)}
    for chars in (8_000_000, 200):
        monkeypatch.setattr(rt, "PATTERN_CHARS", chars)
        got = rt.injection_scan_many(docs, "text", listed).collect()
        assert {r["d"]: r["hits"] for r in got} == want and all(r["is_safe"] == (not want[r["d"]]) for r in got)
    assert rt.injection_scan_many(docs, "text", listed.where("false")).where("not is_safe").count() == 0
