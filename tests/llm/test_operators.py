"""The corpus operators against brute force, on odd rows, empty tables and clashing names."""

import collections
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odd_documents import COLUMNS, VOCABULARY, odd_rows, prose
from tidemark.llm import graph
from tidemark.llm import near_dedup as near_dedup_module
from tidemark.llm import tokens
from tidemark.llm.chat import best_paths, format_trees, format_turns, masked_text, read_turns, thread_nodes
from tidemark.llm.common import SHUFFLE_CLEANUP, written
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.graph import components, joined_components
from tidemark.llm.license_scan import scan_licences, train
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_dedup
from tidemark.llm.packing import pack, plan_bins
from tidemark.llm.pu_quality import estimate_prior, fit, predict, quality_scores
from tidemark.llm.quality_rules import binomial_tail, quality_rules, select_cutoffs
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.token_output import read_tokens, write_tokens
from tidemark.llm.tokens import Encoder, encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# --- exact copies ---------------------------------------------------------

def test_exact_dedup(odd):
    got = exact_dedup(odd).collect()
    groups = collections.defaultdict(list)
    for r in odd_rows():
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(odd_rows()) and got[0]["row"] == "r"
    for text, ids in groups.items():
        own = [r for r in got if (r["text"] or "") == text]
        known = [i for i in ids if i is not None]
        assert {r["keep_id"] for r in own} == {max(known) if known else None}
        assert {r["group_size"] for r in own} == {len(ids)} and sum(r["kept"] for r in own) == 1


def test_exact_dedup_of_nothing(none):
    assert exact_dedup(none).count() == 0


# --- quality rules --------------------------------------------------------

def plain_base(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_base(odd, labels):
    got = quality_rules(odd, labels).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        want = plain_base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"])  # too few labels certify nothing


def test_quality_of_nothing(none, labels):
    assert quality_rules(none, labels).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 300), (3, 500), (40, 5000), (0, 1), (19, 100_000)]
    df = spark.createDataFrame(cases, "k long, n long").select(binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p"), "k", "n")
    for r in df.collect():
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.k + 1))
        assert r["p"] == pytest.approx(want, rel=1e-6)


def test_cutoffs_reject_bad_and_keep_good(spark):
    rng = random.Random(1)
    rows = []
    for k in range(6000):
        good = k % 5 > 0
        rows.append(("en", "symbols", int(rng.random() * 8) if good else 40 + int(rng.random() * 500), good, k % 2 == 0))
        rows.append(("en", "noise", int(rng.random() * 900), good, k % 2 == 0))
        if k < 40:
            rows.append(("few", "symbols", 0 if good else 500, good, k % 2 == 0))
    found = select_cutoffs(spark.createDataFrame(rows, "stratum string, rule string, value long, good boolean, certify boolean")).collect()
    assert [(r["stratum"], r["rule"]) for r in found] == [("en", "symbols")] and 8 <= found[0]["cutoff"] <= 40


# --- repeated passages ----------------------------------------------------

def plain_substring(rows, window=20):
    split = [(i if i is not None else -(1 << 63), words(t)) for i, t in rows]
    first = {}
    for i, w in sorted(split, key=lambda x: x[0]):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, w in split:
        gone = {k for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] != (i, s) for k in range(s, s + window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def passages(n=60):
    rng = random.Random(9)
    shared = [prose(rng, k) for k in (19, 20, 21, 33, 60)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), prose(rng, rng.randint(0, 9))]
        rows.append((rng.randint(0, 2 * n) * 10 + i % 10, "\n".join(parts)))
    return rows


@pytest.mark.parametrize("which", ["passages", "odd"])
def test_substring_dedup(spark, which):
    rows = passages() if which == "passages" else [r[:2] for r in odd_rows()]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got)
    assert have == collections.Counter((i, *x) for (i, _), x in zip(rows, plain_substring(rows), strict=True))
    assert all(sum(s["length"] for s in r["removed"]) == r["n_removed"] for r in got)


def test_substring_dedup_of_nothing(none):
    assert substring_dedup(none).count() == 0


# --- token output and packing ---------------------------------------------

ODD_TEXTS = ["", " ", "a \n b", "x \x1c\x85 y", "don't  it's\r\n\r\nHELLO", "<|endoftext|> a <|startoftext|>b", "a\u00a0 b \u0301c", "日本語 テスト。 x.y,z!! 12", "ΑΣ. İx", "\t\tb  \n\n\nd ", " .", ".a", "é . a"]
ODD_TEXTS += ["<|ENDOFTEXT|>", "a<|EndOfText|>b C", "<|endoftext|> <|ENDOFTEXT|> X", "<|StartOfText|>", *[f"{c}{m} {c.lower()}{m} A{c}{m}" for c, m in zip("JHTWYK", "\u030c\u0331\u0308\u030a\u030a\u0301")]]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    whole = Tokenizer.from_file(f"{VOCABULARY}/{name}")
    texts = ODD_TEXTS + [r[1] or "" for r in odd_rows()]
    got = encoder(f"{VOCABULARY}/{name}", name.startswith("word")).documents(pa.array(texts), 2)
    assert [x.tolist() for x in got] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_known_pieces_take_little_memory(monkeypatch):
    encode = Encoder(f"{VOCABULARY}/byte_bpe_50k.json")
    given = random.Random(3)
    texts = pa.array([" ".join("".join(given.choices("abcdefghij", k=9)) for _ in range(1000)) for _ in range(60)])
    first = [x.tolist() for x in encode.documents(texts, 2)]
    encode.forget()
    tracemalloc.start()
    again = [len(x) for x in encode.documents(texts, 2)]
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert again == [len(x) for x in first] and held < 6 << 20  # 60,000 pieces; a Python object each takes more
    monkeypatch.setattr(tokens, "KEPT_PIECES", 5000)
    assert [x.tolist() for x in encode.documents(texts, 2)] == first


def test_token_files(spark, odd, tmp_path):
    path, vocabulary = str(tmp_path / "t"), f"{VOCABULARY}/word_bpe_49k.json"
    write_tokens(odd, path, vocabulary, 2, folded=True, shard_bytes=20_000)
    whole = Tokenizer.from_file(vocabulary)
    rows = sorted(((r[0], [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert sum(len(r[1]) for r in rows) == sum(len(r["ids"]) // 4 for r in got)
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == at and ids in [x for i, x in rows if i == r["doc_id"]]
        at += len(ids)
    assert {r["doc_id"] for r in read_tokens(spark, path, (3, 5)).collect()} == {3, 4, 5}


def test_token_files_of_nothing(spark, none, tmp_path):
    write_tokens(none, str(tmp_path / "t"), f"{VOCABULARY}/word_bpe_49k.json", 2)
    assert read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_plan_is_near_the_bound():
    rng = random.Random(5)
    for counts in ({rng.randint(1, 1024): rng.randint(1, 50) for _ in range(300)}, {600: 10, 424: 10}, {342: 6}, {1: 5000}, {}):
        plan = plan_bins(counts, 1024)
        placed = collections.Counter()
        for pattern, n in plan:
            assert sum(pattern) <= 1024 and sum(3 * x > 1024 for x in pattern) <= 2
            for x in pattern:
                placed[x] += n
        assert placed == collections.Counter({k: v for k, v in counts.items() if v})
    assert sum(n for _, n in plan_bins({600: 10, 424: 10}, 1024)) == 10


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_packing(rows, request):
    docs = request.getfixturevalue(rows)
    whole = Tokenizer.from_file(f"{VOCABULARY}/byte_bpe_50k.json")
    got = pack(docs, f"{VOCABULARY}/byte_bpe_50k.json").collect()
    if rows == "none":
        assert got == []
        return
    ids = {(r[0], r[1]): [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in odd_rows()}
    assert sum(r["length"] for r in got) == sum(len(ids[(r[0], r[1])]) for r in odd_rows())
    for r in got:
        raws = [np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes() for (i, _), x in ids.items() if i == r["doc_id"]]
        assert r["ids_crc32"] in map(zlib.crc32, raws) and (r["piece"] == 0 or r["length"] == 1024)
    for _, own in collections.defaultdict(list, {s: [r for r in got if r["sequence_id"] == s] for s in {r["sequence_id"] for r in got}}).items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


# --- quality classifier ---------------------------------------------------

def test_pu_risk_and_prior():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (6000, 3)), rng.normal(-1.5, 1, (6000, 3))
    unlabelled = np.concatenate([good[:2800], bad[:1200]])
    model = fit(good[3000:5000], unlabelled, np.concatenate([good[5000:], bad[5000:]]), np.repeat([1.0, 0.0], 1000))
    assert 0.55 <= model["prior"] <= 0.85
    assert (predict(model, good[5000:]) > 0.5).mean() > 0.97 and (predict(model, bad[5000:]) < 0.5).mean() > 0.97
    assert 0.5 < estimate_prior(good[:3000, 0], unlabelled[:, 0]) < 0.95


def test_quality_scores_on_odd_rows(odd, none, labels):
    scored, _ = quality_scores(odd, labels)
    rows = scored.collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert quality_scores(none, labels)[0].count() == 0
    assert {r["score"] for r in quality_scores(odd, labels.limit(0))[0].collect()} == {0.5}


# --- near copies ----------------------------------------------------------

def plain_near(rows, size, percent=80):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(low))
        sets.append({tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i)] if sets[i] else [r[0]]
        known = [x for x in ids if x is not None]
        out.append((r[0], len(sets[i]), min(known) if known else None))
    return out


def families(n=30):
    rng = random.Random(4)
    rows = []
    for f in range(n):
        base = prose(rng, rng.choice([3, 12, 60, 200])).split()
        for _ in range(rng.randint(1, 7)):
            copy = [w if rng.random() > rng.choice([0.0, 0.01, 0.04]) else "other" for w in base]
            rows.append((len(rows) * 3 % 101 + f, " ".join(copy)))
    return rows


@pytest.mark.parametrize("which,size", [("odd", 5), ("families", 4)])
def test_near_dedup(spark, which, size):
    rows = families() if which == "families" else odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string" if which == "families" else COLUMNS)
    got = near_dedup(docs, size=size).collect()
    have = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)
    assert have == collections.Counter(plain_near(rows, size))
    if which == "odd":
        empty = [r for r in got if not r["n_shingles"]]
        assert all(r["kept"] for r in empty) and got[0]["row"] == "r"


def star(n, first=0, base=True, seed=3, changed=5):
    """A base text and ``n`` copies, each with a few words of its own: 0.8 or more to the base, less to each other."""
    rng = random.Random(seed)
    own = [f"w{seed}x{k}" for k in range(203)]
    rows = [(first, " ".join(own))] if base else []
    for k in range(1, n + 1):
        text = list(own)
        for place in rng.sample(range(4, 199, 5), changed):
            text[place] = f"c{seed}x{k}x{place}"
        rows.append((first + k, " ".join(text)))
    return rows


@pytest.mark.parametrize("n", [50, 300, 1000])
def test_near_dedup_of_a_star(spark, n):
    rows = star(n)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=4).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == collections.Counter(plain_near(rows, 4))
    assert [r["doc_id"] for r in got if r["kept"]] == [0]


def test_near_dedup_in_a_crowd(spark, monkeypatch):
    """Pairs and a second star inside a crowd that links with nothing, in many blocks."""
    monkeypatch.setattr(near_dedup_module, "BLOCK_ROWS", 50)
    rows = star(300, base=False)
    rows += [(1000 + i, f"{text} tail") for i, text in rows[::10]]
    rows += star(80, first=2000, seed=4)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=4).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == collections.Counter(plain_near(rows, 4))


def test_near_dedup_of_nothing(none):
    assert near_dedup(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (7, 7), (300, 301), (300, 301)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(101)} | {400: 400, 500: 400, 300: 300, 301: 300}


# --- mixing ---------------------------------------------------------------

def test_mixing(odd):
    got = mix(odd).collect()
    again = {(r["doc_id"], r["text"]): r["taken"] for r in mix(odd).collect()}
    total = sum(len(words(r[1])) for r in odd_rows())
    sizes = collections.Counter()
    for r in odd_rows():
        sizes[r[3]] += len(words(r[1]))
    assert len(got) == len(odd_rows()) and got[0]["row"] == "r"
    targets = {r["source"]: r["target"] for r in got}
    assert sum(targets.values()) == pytest.approx(total)
    for r in got:
        assert (r["source_size"], r["size"]) == (sizes[r["source"]], len(words(r["text"])))
        assert r["target"] <= 3 * r["source_size"] + 1e-9 and r["taken"] <= 3 * r["size"]
    assert sum(r["taken"] for r in got) <= total and all(again[(r["doc_id"], r["text"])] is not None for r in got)


def test_mixing_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(5, 40)), rng.choice(["a", "a", "a", "b", None])) for i in range(1500)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in ("a", "b", None):
        own = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.02)


def test_mixing_of_nothing(none):
    assert mix(none).count() == 0


# --- chat -----------------------------------------------------------------

def test_best_paths(spark):
    rows = [("t", 1, None, 0.5), ("t", 2, 1, 0.1), ("t", 3, 1, 0.9), ("t", 4, 2, 0.9), ("t", 5, 3, 0.0), ("t", 6, 5, 0.0), ("u", 9, 77, None), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0), (None, 1, None, 1.0)]
    paths = best_paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double"), top=2).collect()
    found = collections.defaultdict(list)
    for r in sorted(paths, key=lambda r: r["depth"]):
        found[(r["tree"], r["rank"])].append(r["node"])
    # 1-2-4 scores 1.5; 1-3-5-6 scores 1.4; a cycle has no root
    assert found == {("t", 1): [1, 2, 4], ("t", 2): [1, 3, 5, 6], ("u", 1): [9], (None, 1): [1]}


def test_chat_round_trip(spark):
    hard = ["", None, "</s>[INST] ok [/INST]", "\\<|turn|>a\n<|end|>\\", "x\\", "<", "[[\\\\", "a" * 5000, "é\U0001f600<b>"]
    rows = [(c, k // 2, ("user", "assistant", None)[k % 3], t) for c in (1, None) for k, t in enumerate(hard)]
    df = spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string")
    out = format_trees(thread_nodes(df)).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    for r in out.collect():
        own = sorted(((t, role or None, x) for c, t, role, x in [*rows, rows[0]] if c == r["tree"]), key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or ""))
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(b or "", c or "") for _, b, c in own]
        assert r["loss"] == "".join(c or "" for _, b, c in own if b == "assistant")
        assert r["formatted"].count("<|turn|>") == len(own) and "</s>" not in r["formatted"] and "[INST]" not in r["formatted"]
    assert format_trees(thread_nodes(df.limit(0))).count() == 0
    assert format_turns(spark.createDataFrame([(1, 1, "assistant", "x")], "k int, place int, role string, text string"), ["k"]).first()["loss_spans"][0]["length"] == 1


# --- licences -------------------------------------------------------------

def test_licence_scan(spark, odd, none):
    rng = random.Random(8)
    docs = [(i, prose(rng, 40) + "\n" + prose(rng, 30)) for i in range(80)]
    named = {
        100: "Licensed under the Apache License, Version 2.0.", 101: "Released under the MIT License.", 102: "Licensed under CC BY-NC 4.0.",
        103: "This work is licensed under the GNU General Public License, version 3.", 104: "The licence fee was raised again this year.",
    }
    docs += [(i, prose(rng, 30) + "\n" + t) for i, t in named.items()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = train(df)
    got = {r["doc_id"]: r for r in scan_licences(df, model).collect()}
    assert {i: got[i]["licences"] for i in named} == {100: "Apache-2.0", 101: "MIT", 102: "CC-BY-NC", 103: "GPL", 104: ""}
    assert all(got[i]["licences"] == "" and got[i]["n_paragraphs"] == 2 for i in range(80))
    assert scan_licences(odd, model).count() == len(odd_rows()) and scan_licences(none, model).count() == 0


def test_stars_take_no_round_and_leave_nothing(spark, monkeypatch):
    """Links that are stars already need no round; written tables leave no shuffle files; further links join what is known."""
    made = []
    monkeypatch.setattr(graph, "written", lambda df, name: made.append(name) or written(df, name))
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def left():
        return set(re.findall(r"shuffle_(\d+)_", disk.getAllFiles().mkString(" ")))

    stars = spark.createDataFrame([(k // 50 * 1000, 1000 * (k // 50) + k + 1) for k in range(200)], "a long, b long")
    before, given = left(), spark.conf.get(SHUFFLE_CLEANUP, None)
    root = components(stars)
    assert made == ["links"]
    written(stars.groupBy("a").count(), "counts")
    written(stars.groupBy("a").count().join(stars, "a"), "joined")
    until = time.time() + 30
    while left() - before and time.time() < until:
        spark.sparkContext._jvm.java.lang.Thread.sleep(200)
    assert left() <= before and root.count() == 204 and spark.conf.get(SHUFFLE_CLEANUP, None) == given
    more = spark.createDataFrame([(1, 1000), (7000, 8000), (2050, 3000)], "a long, b long")
    want = {tuple(r) for r in components(stars.unionByName(more)).collect()}
    assert {tuple(r) for r in joined_components(root, more).collect()} == want
    assert {tuple(r) for r in joined_components(root, more.where("false")).collect()} == {tuple(r) for r in root.collect()}
