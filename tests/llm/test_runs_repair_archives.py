"""Run detection, conversation repair and archives against plain versions, on odd rows, empty tables and clashing names."""

import gzip
import hashlib
import heapq
import io
import random
import re

import numpy as np
import pytest
from odd_documents import COLUMNS, odd_rows

from tidemark.llm import conversation_repair, warc
from tidemark.llm.conversation_repair import least_edits, repair_conversations
from tidemark.llm.damage import with_faults, with_planted_runs
from tidemark.llm.periodic_runs import periodic_runs, runs_in, strongest
from tidemark.llm.warc import arc_records, convert_arc, index_arc, read_warc, warc_date, with_referred, write_arc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs --------------------------------------------------------

def plain_runs(words, min_words=24, min_repeats=3):
    """Stretches of equal words q apart for every q; the smallest q of a stretch is its period."""
    found = {}
    for q in range(len(words) // min_repeats, 0, -1):
        s = 0
        while s < len(words) - q:
            e = s
            while e < len(words) - q and words[e] == words[e + q]:
                e += 1
            if e > s and e - s + q >= max(min_words, min_repeats * q):
                found[s, e - s + q] = q
            s = max(e, s + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("min_words", [3, 6, 24])
def test_runs_of_numbers(min_words):
    rng = random.Random(min_words)
    for _ in range(600):
        words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            a, p, e = rng.randint(0, len(words)), rng.randint(1, 40), rng.randint(0, len(words))
            for i in range(a, e):
                words[i] = words[a + (i - a) % p]
        got = [tuple(r) for r in runs_in(np.array(words, dtype=np.int64), min_words, 3).tolist()]
        assert sorted(got) == plain_runs(words, min_words)
        assert got == sorted(got, key=lambda r: (r[0], r[2]))


def test_runs_of_odd_rows(spark, odd, none):
    rng = random.Random(4)
    extra = [(100 + k, " ".join(rng.choice("ab") for _ in range(rng.randint(20, 200))), *[None] * 8) for k in range(60)]
    extra += [(200, "x " * 2000, *[None] * 8), (201, "line one\tof five words\n" * 300, *[None] * 8), (202, "\x1c \x85 \u2003 " * 30, *[None] * 8)]
    docs = odd.withColumnRenamed("kept", "runs").unionByName(spark.createDataFrame(extra, COLUMNS).withColumnRenamed("kept", "runs"))
    got = periodic_runs(docs).withColumn("best", strongest("runs")).collect()
    assert len(got) == len(odd_rows()) + len(extra) and got[0]["row"] == "r"
    for r in got:
        words = WORD.findall(r["text"] or "")
        want = plain_runs(words) if len(words) < 10_000 else []  # the longest has no word twice in a row of 24
        assert (r["n_words"], [tuple(x) for x in r["runs"]]) == (len(words), sorted(want, key=lambda x: (x[0], x[2])))
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["kept_text"] == " ".join(w for i, w in enumerate(words) if i not in gone)
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (tuple(r["best"]) if r["best"] else None) == best
    assert periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(none, min_repeats=2)


def test_runs_across_batches(spark):
    """Documents named together and alone give the same runs."""
    rows = [(k, "a b c d e " * (5 + k % 40)) for k in range(300)]
    for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect():
        assert [tuple(x) for x in r["runs"]] == [(0, 5 * (5 + r["doc_id"] % 40), 5)]


def test_planted_runs(spark, odd):
    import zlib

    got = {(r["doc_id"], r["text"]) for r in with_planted_runs(odd).collect()}
    want = set()
    for i, text, *_ in odd_rows():
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is None or h % 10:
            want.add((i, text or ""))
            continue
        g = h // 10
        if n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        want.add((i, " ".join(words)))
    assert got == want and any(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in odd_rows())


# --- conversation repair --------------------------------------------------

def plain_edits(rows):
    """Cheapest first search over all edits, audits kept as texts."""
    def may_begin(s):
        return re.fullmatch(r"s?(ua)*u?", s)

    found, least, heap = [], {}, [(0, "", 0, "")]
    while heap:
        cost, audit, k, roles = heapq.heappop(heap)
        if found and cost > found[0][0]:
            break
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            found.append((cost, audit))
            continue
        if least.setdefault((k, roles[-1:]), cost) < cost:
            continue
        options = [(2, "I", k, x) for x in "ua"]
        if k < len(rows):
            initial, gone, short = rows[k]
            options.append((3, "D", k + 1, ""))
            if not gone:
                options += [(2 + short, "R", k + 1, x) for x in "ua"] + [(short, "K", k + 1, initial)] * bool(initial)
        for more, letter, at, role in options:
            if may_begin(roles + role):
                heapq.heappush(heap, (cost + more, audit + letter, at, roles + role))
    return min(found)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_least_edits(monkeypatch, block):
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", block)
    rng = random.Random(block)
    for _ in range(400):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 8))]
        rows = [(i, gone, short and not gone) for i, gone, short in rows]
        assert least_edits(rows) == plain_edits(rows)


def test_blocks_do_not_matter(monkeypatch):
    rng = random.Random(9)
    rows = [(rng.choice("suax"), rng.random() < 0.1, False) for _ in range(3000)]
    whole = least_edits(rows)
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", 5000)
    assert whole == least_edits(rows)


def plain_report(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    seen, faults, judged = set(), [], []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
        judged.append((role[:1], faults[-1] in ("blank", "duplicate"), faults[-1] == "truncated"))
    turns = {t for t, *_ in rows if t is not None}
    cost, audit = plain_edits(judged)
    out, k, state = [], 0, ""
    for letter in audit:
        if letter != "D":
            needed = "assistant" if state == "u" else "user"
            role = rows[k][1] if letter == "K" else needed
            out.append((role, "" if letter == "I" else rows[k][2]))
            state = role[0]
        k += letter != "I"
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, out


def test_repair_of_odd_rows(spark):
    rng = random.Random(7)
    texts = ["Yes.", "No", "", " \n", None, "What?\n", "x" * 100_000 + "!", "é ", "Yes."]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", None, "", "tool", "us\ner"]), rng.choice(texts), "c", 1.0)
            for c in [*range(60), None] for _ in range(rng.randint(1, 7))]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, audit string, cost double")
    got = repair_conversations(df.repartition(3)).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        want = plain_report([x[1:4] for x in rows if x[0] == r["conv_id"]])
        said = [(x["role"], x["text"]) for x in r["repaired"]]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], said) == want
    assert repair_conversations(df.where("false")).count() == 0


def test_planted_faults(spark):
    import zlib

    rows = [(c, t, "system", "One. Two!") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    got = with_faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        want += [(c, t, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


# --- archives -------------------------------------------------------------

def arc(version, records):
    fields = warc.ARC_FIELDS[version]
    body = f"{version} 0 old\n{fields}\n".encode()
    rest = "text/plain" if version == 1 else "text/plain 200 - - 0 x.arc"
    return f"filedesc://x.arc 0.0.0.0 19990102030405 {rest} {len(body)}\n".encode() + body + b"\n" + b"".join(records)


def test_legacy_headers():
    http = b"HTTP/1.0 200 OK\nX-Page-Id: 5\n\nhello\nhttp://trap/ 1.1.1.1 20000101000000 text/html 3\nabc"
    v1 = arc(1, [b"http://a/b c 1.2.3.4 19970203 text/html; charset=x %d\n" % len(http) + http + b"\n", b"not a header\n", b"dns:a 0.0.0.0 20000101000000 text/dns 2\nok\n"])
    got = list(arc_records(io.BytesIO(v1)))
    assert [r["url"] for r in got] == ["filedesc://x.arc", "http://a/b c", "dns:a"]
    assert got[1]["block"] == http and got[1]["type"] == "text/html; charset=x" and not got[1]["cut"]
    v2 = arc(2, [b"http://a/ 1.2.3.4 20000101000000 text/html 404 sum - 77 x.arc %d\n" % len(http) + http + b"\n", b"http://b/ 1.2.3.4 20000101000000 no-type 200 - - 9 x.arc 50\nshort"])
    got = list(arc_records(io.BytesIO(v2)))
    assert [(r["url"], r["cut"]) for r in got] == [("filedesc://x.arc", False), ("http://a/", False), ("http://b/", True)]
    assert warc_date("19970203") == "1997-02-03T00:00:00Z" and warc_date("20010203040506123") == "2001-02-03T04:05:06Z"


def test_foreign_archives(spark, tmp_path):
    """Plain and gzip files of both versions; other protocols, cut files and files without records."""
    page = b"HTTP/1.0 200 OK\r\nX-Page-Id: 5\r\nContent-Length: 2000\r\n\r\n" + b"x" * 2000
    one = arc(1, [b"http://a/ 1.2.3.4 19970203040506 text/html %d\n" % len(page) + page + b"\n", b"dns:a 0.0.0.0 20000101000000 text/dns 2\nok\n"])
    two = arc(2, [b"http://b/ 1.2.3.4 20000101000000 text/html 200 s - 7 x.arc %d\n" % len(page) + page.replace(b"5", b"9", 1)])
    cut = arc(1, [b"http://c/ 1.2.3.4 19970203040506 text/html 500\nHTTP/1.0 200 OK\r\n\r\nhalf"])
    for name, data in (("one.arc", one), ("two.arc.gz", gzip.compress(two)), ("cut.arc", cut), ("empty.arc", b"")):
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "archive string")
    out = convert_arc(paths, str(tmp_path / "out"))
    rows = with_referred(read_warc(out)).collect()
    assert all(r["sound"] for r in rows)
    by_url = {r["url"]: r for r in rows}
    assert {u: r["type"] for u, r in by_url.items()} == {"http://a/": "revisit", "dns:a": "resource", "http://b/": "response", "http://c/": "response"}
    assert by_url["http://a/"]["refers_page"] == 9 and by_url["http://a/"]["payload_bytes"] == 2000 and by_url["http://a/"]["date"] == "1997-02-03T04:05:06Z"
    text = b"".join(gzip.decompress(open(r["archive"], "rb").read()) for r in out.collect())
    assert text.count(b"WARC-Truncated: length") == 1 and text.count(b"x" * 2000) == 1
    again = read_warc(convert_arc(paths, str(tmp_path / "again"))).select("record").collect()
    assert {r["record"] for r in again} == {r["record"] for r in rows}


def test_archives_of_odd_pages(spark, tmp_path):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    bodies = [None, "", "short", long, long, long, long[:999], long[:999], "WARC/1.1\r\n\r\nHTTP/1.1 " * 60, "\r\n\r\n" + long, "é" * 500, "é" * 500, "x" * 3_000_000]
    rows = [(k if k != 4 else None, (f"http://h/{k}", None, "http://h/a b\n")[k % 3], b, "u", 1) for k, b in enumerate(bodies)]
    rows += [rows[3], (99, "http://h/99", long, "u", 1)] + [(1000 + k, "http://hot/", "hot " * 400, "u", 1) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, archive int").repartition(5)
    legacy = write_arc(pages, str(tmp_path / "arc"), archive_bytes=3_000)
    assert legacy.count() > 5 and index_arc(legacy).count() == len(rows)
    got = with_referred(read_warc(convert_arc(legacy, str(tmp_path / "warc"), archive_bytes=3_000))).collect()
    assert len(got) == len(rows) and all(r["sound"] for r in got)
    last = {}
    for k, _, b, *_ in rows:
        last[b or ""] = max(last.get(b or "", -1), -1 if k is None else k)
    want = []
    for k, _, b, *_ in rows:
        data = (b or "").encode()
        again = len(data) >= 1000 and k != last[b or ""]
        want.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[b or ""] if again else None))
    found = [(r["page_id"], r["payload_bytes"], r["payload_sha1"], r["type"], r["refers_page"]) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert convert_arc(write_arc(pages.where("false"), str(tmp_path / "none")), str(tmp_path / "nothing")).count() == 0
