"""Repeated passages by difference-cover anchors.

Any two equal windows of ``WINDOW`` words share an anchor: the cover positions
modulo 13 contain two of every distance, so some offset below 13 is a cover
position in both documents, and the ``WINDOW - 12`` words from there are equal.
Only anchors (4 of 13 positions) are compared over the whole corpus.  Windows
that hold an anchor found twice are then extended to their full length and
compared by 128-bit hashes of whole windows; the first of each stays.

Documents are worked on in batches of about ``BATCH_BYTES``, hashes in buckets
of about as many.  Between them go packed arrays, one row per batch and bucket,
and back one bit per entry.  A passage that a third of all documents hold is
one entry per batch, not one per document.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import many, text_of
from tidemark.llm.spans import STEP_BYTES, Hashes, words

WINDOW = 20
#: A perfect difference set: every distance modulo PERIOD is met once.
COVER, PERIOD = (0, 1, 3, 9), 13
BATCH_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20

RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:bigint,length:bigint>>"


@lru_cache(maxsize=1)
def _hashes() -> tuple[Hashes, Hashes, Hashes]:
    return Hashes(1), Hashes(2), Hashes(3)


def _word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of all words, about ``STEP_BYTES`` at a time."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + STEP_BYTES, side="right")))
        low = starts[at]
        out[at:to] = _hashes()[0].texts(data[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def _window_values(values: np.ndarray, starts: np.ndarray, width: int, which: int) -> np.ndarray:
    """Hashes of ``width`` words from each of the ascending ``starts``."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = int(np.searchsorted(starts, starts[at] + (STEP_BYTES >> 2), side="right"))
        low, some = starts[at], starts[at:to] - starts[at]
        out[at:to] = _hashes()[which].slices(values[low : starts[to - 1] + width], some, some + width)
        at = to
    return out


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


class Batch:
    """The documents of one batch, in an order that every pass finds again."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        lowest = -(1 << 63)
        ids = [lowest if i is None else i for i in table["doc_id"].to_pylist()]
        texts = table["text"].cast(pa.large_binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.window, self.buckets, self.anchor = window, buckets, window - PERIOD + 1
        self.given = [table["doc_id"][k].as_py() for k in order]
        self.texts = [texts[k] for k in order]
        self.ids = np.array([ids[k] for k in order], np.int64)
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        offsets = np.append(0, np.cumsum([len(t) for t in self.texts])).astype(np.int64)
        starts, ends, self.first = words(data, offsets)
        self.values = _word_values(data, starts, ends)
        count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.place = np.arange(len(starts)) - self.first[self.doc]
        self.left = count[self.doc] - self.place
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        long = count[self.doc] >= window
        self.anchors = np.flatnonzero(long & (self.left >= self.anchor) & cover[self.place % PERIOD])
        hashed = _window_values(self.values, self.anchors, self.anchor, 1)
        self.distinct, self.code, self.times = np.unique(hashed, return_inverse=True, return_counts=True)
        self.cuts = np.searchsorted(self.distinct, _limits(buckets))

    def anchor_blobs(self) -> list[tuple[int, bytes]]:
        """Distinct anchor hashes by bucket, ascending, 6 bytes each."""
        short = (self.distinct >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        return [(b, short[a:z].tobytes()) for b, (a, z) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)) if z > a]

    def candidates(self, masks: dict[int, bytes]) -> None:
        """Windows that hold a repeated anchor, and for each the first equal one of this batch."""
        again = self.times > 1
        for b, raw in masks.items():
            a, z = self.cuts[b], self.cuts[b + 1]
            again[a:z] |= _flags(raw, z - a)
        hit = np.zeros(len(self.values) + 1, np.int64)
        hit[self.anchors + 1] = again[self.code]
        hit = np.cumsum(hit)
        starts = np.flatnonzero(self.left >= self.window)
        starts = starts[hit[np.minimum(starts + PERIOD, len(self.values))] > hit[starts]]
        self.starts = starts
        self.key_a, self.key_b = (_window_values(self.values, starts, self.window, k) for k in (1, 2))
        self.key_b = (self.key_b >> np.uint64(32)).astype(np.uint32)
        self.own = (self.ids[self.doc[starts]], self.place[starts])
        self.leader = _leaders(self.key_a, self.key_b, *self.own)
        self.leads = np.flatnonzero(self.leader == np.arange(len(starts)))
        bucket = np.searchsorted(_limits(self.buckets)[1:-1], self.key_a[self.leads], side="right")
        self.sorted = self.leads[np.argsort(bucket, kind="stable")]
        self.ends = np.append(0, np.cumsum(np.bincount(bucket, minlength=self.buckets)))

    def window_blobs(self) -> list[tuple[int, bytes]]:
        packer = zstandard.ZstdCompressor(level=1)
        out = []
        for b in range(self.buckets):
            own = self.sorted[self.ends[b] : self.ends[b + 1]]
            if len(own):
                doc, place = self.own[0][own], self.own[1][own]
                parts = (self.key_a[own], self.key_b[own], np.diff(doc, prepend=np.int64(0)), np.diff(place, prepend=np.int64(0)).astype(np.int32))
                out.append((b, packer.compress(b"".join(p.tobytes() for p in parts))))
        return out

    def removed(self, masks: dict[int, bytes]) -> np.ndarray:
        """Per word: whether a window that starts earlier elsewhere covers it."""
        gone = np.zeros(len(self.starts), bool)
        for b, raw in masks.items():
            own = self.sorted[self.ends[b] : self.ends[b + 1]]
            gone[own] = _flags(raw, len(own))
        later = (self.own[0] != self.own[0][self.leader]) | (self.own[1] != self.own[1][self.leader])
        at = self.starts[later | gone[self.leader]]
        edge = np.zeros(len(self.values) + 1, np.int64)
        edge[at] += 1
        np.subtract.at(edge, at + self.window, 1)
        return np.cumsum(edge)[:-1] > 0


@lru_cache(maxsize=4)
def _limits(buckets: int) -> np.ndarray:
    return np.array([min(b * (1 << 64) // buckets, (1 << 64) - 1) for b in range(buckets + 1)], np.uint64)


def _leaders(key_a: np.ndarray, key_b: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each entry the index of the first entry (by document, place) with its key."""
    order = np.lexsort((place, doc, key_b, key_a))
    a, b = key_a[order], key_b[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    return out


def _packed(batch: int, blobs: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({
        "batch": pa.array([batch] * len(blobs), pa.int64()), "bucket": pa.array([b for b, _ in blobs], pa.int64()),
        "body": pa.array([x for _, x in blobs], pa.binary()),
    })


PACKED = "batch long, bucket long, body binary"


def _answers(table: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    """One bit per entry for each packed row; rows without a set bit are left out."""
    some = [k for k, f in enumerate(flags) if f.any()]
    took = table.take(pa.array(some, pa.int64()))
    return pa.table({"batch": took["batch"], "bucket": took["bucket"], "body": pa.array([_bits(flags[k]) for k in some], pa.binary())})


def repeated_anchors(table: pa.Table) -> pa.Table:
    """Which entries of one bucket occur in two batches or more."""
    blobs = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in table["body"].to_pylist()]
    wide = np.zeros((sum(len(x) for x in blobs), 8), np.uint8)
    wide[:, :6] = np.concatenate(blobs)
    _, code, times = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    return _answers(table, np.split(times[code] > 1, np.cumsum([len(x) for x in blobs])[:-1]))


def later_windows(table: pa.Table) -> pa.Table:
    """Which entries of one bucket start later than an equal window of another batch."""
    opener = zstandard.ZstdDecompressor()
    parts, sizes = [], []
    for x in table["body"].to_pylist():
        raw = opener.decompress(x)
        n = len(raw) // 24
        sizes.append(n)
        parts.append((
            np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n), np.cumsum(np.frombuffer(raw, np.int64, n, 12 * n)),
            np.cumsum(np.frombuffer(raw, np.int32, n, 20 * n).astype(np.int64)),
        ))
    key_a, key_b, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    leader = _leaders(key_a, key_b, doc, place)
    later = (doc != doc[leader]) | (place != place[leader])
    return _answers(table, np.split(later, np.cumsum(sizes)[:-1]))


def _masks(table: pa.Table, kind: int) -> dict[int, bytes]:
    rows = zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["body"].to_pylist(), strict=True)
    return {b: x for k, b, x in rows if k == kind}


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, removed`` of every document.

    Words covered by a window of ``window`` words that also starts earlier
    (smaller id, or same id and earlier start) go; kept words are joined by one
    blank; ``removed`` has the runs of removed words.  Null texts have no words.
    A null id is the smallest.  Rows with the same id are one place: of equal
    windows at the same start in them none is earlier, so repeated rows keep
    their words.  An empty table gives an empty result.
    """
    if window < PERIOD + 3:
        raise ValueError(f"windows need {PERIOD + 3} words or more")
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    total = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    least = 4 * spark.sparkContext.defaultParallelism
    batches, buckets = max(least, many(total, BATCH_BYTES)), max(least, many(total, BUCKET_BYTES))
    batch = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(batches)).alias("batch")
    # one exchange of the texts serves all three passes
    texts = given.select(batch, "doc_id", "text").groupBy("batch")

    def anchors(table: pa.Table) -> pa.Table:
        return _packed(table["batch"][0].as_py(), Batch(table, window, buckets).anchor_blobs())

    def extended(left: pa.Table, right: pa.Table) -> Batch:
        found = Batch(left, window, buckets)
        found.candidates(_masks(right, 1))
        return found

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        return _packed(left["batch"][0].as_py(), extended(left, right).window_blobs())

    def result(left: pa.Table, right: pa.Table) -> pa.Table:
        found = extended(left, right)
        gone = found.removed(_masks(right, 2))
        rows: dict[str, list] = {"doc_id": found.given, "n_words": [], "n_removed": [], "kept_text": [], "removed": []}
        for k, text in enumerate(found.texts):
            own = gone[found.first[k] : found.first[k + 1]]
            split = text.split()
            rows["n_words"].append(len(split))
            rows["n_removed"].append(int(own.sum()))
            rows["kept_text"].append(b" ".join([w for w, g in zip(split, own.tolist(), strict=True) if not g] if own.any() else split).decode())
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
            rows["removed"].append([{"start": int(a), "length": int(z - a)} for a, z in zip(edge[::2], edge[1::2], strict=True)])
        run = pa.struct([("start", pa.int64()), ("length", pa.int64())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(run)]
        return pa.table({name: pa.array(column, kind) for (name, column), kind in zip(rows.items(), kinds, strict=True)})

    first = texts.applyInArrow(anchors, PACKED).groupBy("bucket").applyInArrow(repeated_anchors, PACKED)
    first = first.select("batch", F.lit(1).alias("kind"), "bucket", "body")
    second = texts.cogroup(first.groupBy("batch")).applyInArrow(windows, PACKED)
    second = second.groupBy("bucket").applyInArrow(later_windows, PACKED).select("batch", F.lit(2).alias("kind"), "bucket", "body")
    return texts.cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(result, RESULT)
