"""Runs of repeated words inside a document, found with a dictionary of basic factors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import struct_of, text_of, with_verdict

#: Words that are named together; a longer document is named alone.
BATCH_WORDS = 1 << 18

ADDED = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept_text string"
VERDICT = ["n_words", "runs", "kept_text"]


def basic_factors(names: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per power of two L: ``L``, a name per position for its block of L, then positions and distances to the next equal block.

    Blocks that occur once get a negative name of their own: they equal nothing,
    and no longer block over them needs a look.  Levels end when all occur once.
    """
    at, length = np.arange(len(names)), 1
    key = names
    while len(at):
        # stable: equal blocks stand side by side in the order of their positions
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        shared = ~(new & np.concatenate([new[1:], [True]]))
        at, name = at[shared], (np.cumsum(new) - 1)[shared]
        if not len(at):
            return
        block = -1 - np.arange(len(names))
        block[at] = name
        same = name[1:] == name[:-1]
        yield length, block, at[:-1][same], (at[1:] - at[:-1])[same]
        first = np.sort(at)
        first = first[first + length < len(names)]
        first = first[block[first + length] >= 0]
        at, key = first, block[first] * np.int64(len(names)) + block[first + length]
        length *= 2


def runs_in(names: np.ndarray, min_words: int, min_repeats: int) -> np.ndarray:
    """All runs as rows of (start, length, period) by start and period.

    In a run of period q, for the power of two L in (q / 2, q], some block of L
    words occurs once in each period, so that its next occurrence is q away.
    Next occurrences at a distance from L up to 2 L thus propose every period.
    Neighbours with one distance are one progression, which is extended once.
    A proposed period is the smallest of its run: a smaller one would divide it
    and bring the next occurrence nearer.
    """
    levels, proposed = [], []
    for length, block, at, gap in basic_factors(names):
        levels.append((length, block))
        near = (gap >= length) & (gap < 2 * length)
        at, gap = at[near], gap[near]
        order = np.lexsort((at, gap))
        at, gap = at[order], gap[order]
        head = np.ones(len(at), dtype=bool)
        head[1:] = (gap[1:] != gap[:-1]) | (at[1:] != at[:-1] + 1)
        proposed.append(np.stack([at[head], gap[head]], axis=1))
    if not levels:
        return np.empty((0, 3), dtype=np.int64)
    at, period = np.concatenate(proposed).T
    end, start = at.copy(), at.copy()
    for length, block in reversed(levels):
        fits = np.flatnonzero(end + period + length <= len(names))
        fits = fits[block[end[fits]] == block[(end + period)[fits]]]
        end[fits] += length
        fits = np.flatnonzero(start >= length)
        fits = fits[block[start[fits] - length] == block[(start + period)[fits] - length]]
        start[fits] -= length
    size = end - start + period
    whole = size >= np.maximum(min_words, min_repeats * period)
    found = np.unique(np.stack([start[whole], size[whole], period[whole]], axis=1), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _judged(texts: list[list[bytes]], min_words: int, min_repeats: int) -> Iterator[tuple[list[dict], bytes]]:
    """Runs and kept words of documents whose words are named together."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    flat = np.empty(int(ends[-1]), dtype=object)
    flat[:] = [w for words in texts for w in words]
    codes, known = pd.factorize(flat)
    # a word of another document is another word, so no block or run crosses a border
    names = codes + np.repeat(np.arange(len(texts)), sizes) * np.int64(len(known))
    runs = runs_in(names, min_words, min_repeats)
    steps = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(steps)[:-1] == 0
    cuts = np.searchsorted(runs[:, 0], np.concatenate([[0], ends]))
    for k, words in enumerate(texts):
        low = int(ends[k] - sizes[k])
        own = [{"start": s - low, "length": n, "period": p} for s, n, p in runs[cuts[k] : cuts[k + 1]].tolist()]
        if own:
            stays = kept[low : low + len(words)]
            words = [w for w, stay in zip(words, stays, strict=True) if stay]
        yield own, b" ".join(words)


def periodic_runs(docs: DataFrame, text_col: str = "text", carry: Sequence[str] | None = None, min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """The rows' ``carry`` columns (default all) with ``n_words``, ``runs`` and ``kept_text``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch of at
    least ``min_words`` words and ``min_repeats`` times its smallest period (at
    least 3) that neither neighbour extends; ``runs`` lists them by start and
    period.  ``kept_text`` joins with one space the words that no run contains
    after its first period.

    A null or empty text has no words, no runs and an empty ``kept_text``.  Rows
    are judged one by one: ties and repeated rows give equal results, an empty
    table an empty one.  An input column named like an added one is replaced.
    Nothing is shuffled; a document of n words takes O(n) memory a level, and a
    level more only while blocks of that length repeat in it.
    """
    if min_repeats < 3:
        raise ValueError("min_repeats must be at least 3: shorter runs need not show their period")
    carry = list(docs.columns if carry is None else carry)
    packed = docs.select(struct_of(carry).alias("doc"), text_of(text_col).alias("text"))
    schema = StructType([packed.schema["doc"], *StructType.fromDDL(ADDED).fields])
    target = to_arrow_schema(schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, low = batch.column(1), 0
            while low < batch.num_rows:
                texts, total = [], 0
                while low + len(texts) < batch.num_rows and (not texts or total < BATCH_WORDS):
                    # bytes split at the ASCII blanks only, which are those of the contract
                    texts.append(given[low + len(texts)].as_py().encode().split())
                    total += len(texts[-1])
                runs, kept = zip(*_judged(texts, min_words, min_repeats), strict=True)
                out = [
                    batch.column(0).slice(low, len(texts)), pa.array([len(w) for w in texts], pa.int64()),
                    pa.array(list(runs), target.field("runs").type), pa.array(kept, pa.binary()).cast(target.field("kept_text").type),
                ]
                yield pa.RecordBatch.from_arrays(out, schema=target)
                low += len(texts)

    return packed.mapInArrow(judge, schema).select(*with_verdict(carry, VERDICT))


def strongest(runs: str) -> Column:
    """The run with the greatest length / period, ties to the smaller start, then period; null without a run."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def higher(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, none, higher)
