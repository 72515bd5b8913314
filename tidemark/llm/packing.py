"""Best-fit packing with large-item matching, planned on the histogram of lengths.

Only lengths matter, and there are at most ``capacity`` of them.  The plan is
made from how often each length occurs: a bounded table, at any input size.
The pieces then take their places by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_of, written
from tidemark.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ids with the end id, cut into ``capacity`` where longer.

    All pieces of a cut document are full but the first, which holds the rest.
    ``part`` and ``nth`` number the pieces of one length within a task.  Null
    texts count as empty; null ids and repeated rows are kept as they are.
    """
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            out = []
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encoder(vocabulary).documents(b["text"], end_id), strict=True):
                raw, n = ids.astype("<u4").tobytes(), len(ids)
                at, piece = 0, 0
                while at < n:
                    length = n % capacity or capacity if at == 0 else capacity
                    out.append((doc_id, piece, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), part, int(seen[length])))
                    seen[length] += 1
                    at, piece = at + length, piece + 1
            if out:
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return written(given.mapInArrow(cut, PIECES), "pack-pieces")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many sequences follow each.

    Lengths above a third of the capacity pair at most two to a sequence: from
    the longest on, each takes the longest partner that still fits.  Shorter
    lengths, longest first, go where the gap that remains is smallest.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[list]] = defaultdict(list)
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        for b in (x for x in large if x <= a and a + x <= capacity):
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                gaps[capacity - a - b].append([(a, b), n])
                left[a] -= n
                left[b] -= n
        if left[a]:
            gaps[capacity - a].append([(a,), left[a]])
            left[a] = 0
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count, gap = left[s], s
        while count and gap <= capacity:
            groups = gaps.get(gap)
            if not groups:
                gap += 1
                continue
            pattern, n = groups[-1]
            placed = min(n, count)
            if placed == n:
                groups.pop()
            else:
                groups[-1][1] -= placed
            gaps[gap - s].append([(*pattern, s), placed])
            count -= placed
            # a gap that still holds s comes first again, being smaller
            gap = max(s, min(gap, gap - s))
        each = capacity // s
        if count // each:
            gaps[capacity - each * s].append([(s,) * each, count // each])
        if count % each:
            gaps[capacity - count % each * s].append([(s,) * (count % each), 1])
    return [(tuple(p), n) for g in sorted(gaps) for p, n in gaps[g] if n]


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset): runs of places for pieces of one length."""
    ranks: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            out.append((length, ranks[length], ranks[length] + n, first, offset))
            ranks[length] += n
            offset += length
        first += n
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    An empty table gives an empty result; ties of length are interchangeable.
    """
    pieces = cut_pieces(docs, vocabulary, end_id, capacity, id_col, text_col)
    by_part = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slots_of(plan_bins(counts, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = by_part.select("part", "length", before.alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    runs = docs.sparkSession.createDataFrame(slots, "for_length long, low long, high long, first long, offset long")
    # the plan's runs are bounded by the lengths there can be, not by the rows
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("for_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"
    )
