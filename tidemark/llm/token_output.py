"""Token ids as compressed documents: one zstandard dictionary, a frame per document, an offset index per block.

The format is a table of blocks, so it lies in any store that Spark writes:
``shard, block, start, first_id, last_id, dict_hash, width, doc_ids, n_tokens,
offsets, frames``.  ``frames[offsets[i]:offsets[i + 1]]`` is the frame of
document i, its ids little-endian in ``width`` bytes each.  Shards and blocks
follow the order of the ids of documents; ``start`` counts the tokens of the
shard before the block.  The dictionary lies beside it with its hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, many, text_of, written
from tidemark.llm.tokens import encoder

#: Text bytes of a shard; documents and id bytes of a block.
SHARD_BYTES = 8 << 20
BLOCK_DOCUMENTS, BLOCK_BYTES = 512, 1 << 20
#: The dictionary: its size, and the bounded sample of documents (in hash order,
#: each of at most so many bytes) that trains it.  It changes sizes, never ids.
DICT_BYTES, DICT_SAMPLE, DICT_DOC_BYTES = 32 << 10, 500, 32 << 10
LEVEL = 3

BLOCKS = (
    "shard long, block long, start long, first_id long, last_id long, dict_hash string, width int, doc_ids array<bigint>, "
    "n_tokens array<bigint>, offsets array<bigint>, frames binary"
)


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def train_dictionary(docs: DataFrame, text_col: str, vocabulary: str, end_id: int, width: int, folded: bool) -> bytes:
    """A dictionary from serialized ids of a sample of whole documents; plain content where the sample is too small."""
    short = docs.where(F.octet_length(text_col) <= DICT_DOC_BYTES)
    sample = bounded_sample(short.select("doc_id", F.col(text_col).alias("text")), DICT_SAMPLE, ["doc_id", "text"])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"ids": pa.array([serialized(x, width) for x in encoder(vocabulary, folded).documents(b["text"], end_id)], pa.binary())})

    found = [bytes(r.ids) for r in sample.mapInArrow(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, found).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(found))[-DICT_BYTES:]


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2,
    folded: bool = False, shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encode all documents in ascending order of their id and write dictionary and blocks to ``path``.

    Null texts count as empty and hold the end id alone; null ids come first;
    rows with the same id follow each other as documents of their own.  An
    empty table writes a dictionary and no block.  ``folded``: see ``Encoder``.
    """
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    plain = train_dictionary(given, "text", vocabulary, end_id, width, folded)
    dict_hash = hashlib.sha256(plain).hexdigest()
    spark = docs.sparkSession
    spark.createDataFrame([(dict_hash, bytearray(plain))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(plain))
        block, start, held = 0, 0, []

        def made() -> pa.RecordBatch:
            sizes = [len(f) for _, _, f in held]
            tokens = [n for _, n, _ in held]
            row = {
                "shard": shard, "block": block, "start": start, "first_id": held[0][0], "last_id": held[-1][0], "dict_hash": dict_hash, "width": width,
                "doc_ids": [d for d, _, _ in held], "n_tokens": tokens, "offsets": np.append(0, np.cumsum(sizes)).tolist(),
                "frames": b"".join(f for _, _, f in held),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        size = 0
        for b in batches:
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encoder(vocabulary, folded).documents(b["text"], end_id), strict=True):
                held.append((doc_id, len(ids), packer.compress(serialized(ids, width))))
                size += len(ids) * width
                if len(held) == BLOCK_DOCUMENTS or size >= BLOCK_BYTES:
                    yield made()
                    block, start, held, size = block + 1, start + sum(n for _, n, _ in held), [], 0
        if held:
            yield made()

    schema = pa.schema([
        ("shard", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dict_hash", pa.string()),
        ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary()),
    ])
    total = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ordered = given.repartitionByRange(many(total, shard_bytes), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The dictionary, checked against its hash: one row of bounded size."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row.dictionary)).hexdigest() != row.dict_hash:
        raise ValueError("the dictionary does not fit its hash")
    return bytes(row.dictionary)


def read_tokens(spark: SparkSession, path: str, ids_between: tuple[int, int] | None = None) -> DataFrame:
    """``doc_id, start, ids`` of all documents, or of those with an id in a range.

    ``ids`` are unsigned 32-bit little-endian bytes, ``start`` counts the tokens
    of all documents before.  For a range only the blocks that touch it are
    read, and only its documents' frames are opened.
    """
    plain = read_dictionary(spark, path)
    dict_hash = hashlib.sha256(plain).hexdigest()
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    # one short row per shard
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = written(totals.select("shard", before.alias("base")), "token-bases")
    low, high = ids_between or (None, None)
    if ids_between:
        blocks = blocks.where((F.col("last_id") >= low) & (F.col("first_id") <= high))
    placed = blocks.join(bases, "shard").select("base", "start", "dict_hash", "width", "doc_ids", "n_tokens", "offsets", "frames")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain))
        for b in batches:
            for row in b.to_pylist():
                if row["dict_hash"] != dict_hash:
                    raise ValueError("the block needs another dictionary")
                kind, at, view = "<u2" if row["width"] == 2 else "<u4", row["offsets"], memoryview(row["frames"])
                starts = row["base"] + row["start"] + np.cumsum([0, *row["n_tokens"][:-1]])
                own = [k for k, d in enumerate(row["doc_ids"]) if low is None or d is not None and low <= d <= high]
                ids = [np.frombuffer(opener.decompress(view[at[k] : at[k + 1]]), kind).astype("<u4").tobytes() for k in own]
                yield pa.record_batch({
                    "doc_id": pa.array([row["doc_ids"][k] for k in own], pa.int64()), "start": pa.array(starts[own], pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                })

    return placed.mapInArrow(documents, "doc_id long, start long, ids binary")
