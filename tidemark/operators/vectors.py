"""Approximate search over a stored vector index, and similarity joins with a threshold.

Both reduce to one step: vectors of both sides that share a group (a cell of the
index, a band of sign bits) are packed into blocks, blocks of one group meet in
a join, and each pair of blocks is one matrix product that hands on the best
partners of each left vector only.  A crowded group is many blocks, which the
planner may deal to many tasks; no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructType

from tidemark.functions.ordering import hash_sample, top_k
from tidemark.session import scratch_dir

#: Vectors in a block: a block of 1024 numbers each holds 4 MB.
BLOCK = 512
#: Rows that the cells are learned from, and cells at most; both bound what the driver and the tasks hold.
SAMPLE_ROWS = 100_000
MOST_CELLS = 4096
#: Similarities and copies of vectors that a task makes at once.
SIMILARITIES_AT_ONCE = 1 << 20
COPIES_AT_ONCE = 1 << 13
#: Vectors whose exact neighbours decide how many cells a search probes.
CALIBRATION_ROWS = 256


def unit(vector: str | Column) -> Column:
    """The vector with length 1; null for a null, empty or zero vector, or one with a null or NaN in it."""
    v = F.col(vector) if isinstance(vector, str) else vector
    v = v.cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((size > 0) & ~F.isnan(size), F.transform(v, lambda x: x / size))


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, computed once."""
    path = scratch_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _packed(rows: DataFrame) -> DataFrame:
    """Unit vectors ``id, vector`` with each vector as the bytes of its numbers, which Spark moves without looking at them."""
    schema = StructType([rows.schema["id"]]).add("vector", BinaryType())
    target = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32) * 8
            data = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([batch.column(0), data], schema=target)

    return rows.mapInArrow(pack, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed vectors of one length as rows."""
    if not len(column):
        return np.empty((0, 1))
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.float64, (ends[-1] - ends[0]) // 8, ends[0]).reshape(len(column), -1)


def _blocks(rows: DataFrame, side: str) -> DataFrame:
    """``grp, {side}_ids, {side}_vectors``: rows (grp, id, vector) packed into blocks of about ``BLOCK`` of one group."""
    sizes = rows.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    dealt = rows.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")))
    packed = dealt.groupBy("grp", "block").agg(F.collect_list(F.struct("id", "vector")).alias("all"))
    return packed.select("grp", F.col("all.id").alias(f"{side}_ids"), F.col("all.vector").alias(f"{side}_vectors"))


def best_in_groups(left: DataFrame, right: DataFrame, k: int, at_least: float = -2.0, packed: bool = False) -> DataFrame:
    """``left_id, right_id, similarity``: per block of the right side the best ``k`` partners of each left vector, ties at the cut included.

    Both sides have ``grp, id, vector`` with packed unit vectors; the right one may come packed.
    A pair that shares several groups may come several times.
    """
    blocks = _blocks(left, "left").join(right if packed else _blocks(right, "right"), "grp").drop("grp")
    ids = {c: blocks.schema[c].dataType.elementType for c in ("left_ids", "right_ids")}
    schema = StructType().add("left_id", ids["left_ids"]).add("right_id", ids["right_ids"]).add("similarity", DoubleType())
    target = to_arrow_schema(schema)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                a, b, c, d = (batch.column(name)[n].values for name in ("left_ids", "left_vectors", "right_ids", "right_vectors"))
                sims = _matrix(b) @ _matrix(d).T
                top = min(k, len(c))
                cut = np.partition(sims, len(c) - top, axis=1)[:, len(c) - top]
                i, j = np.nonzero((sims >= cut[:, None] - 1e-9) & (sims >= at_least - 1e-9))
                yield pa.RecordBatch.from_arrays([a.take(pa.array(i)), c.take(pa.array(j)), pa.array(sims[i, j])], schema=target)

    return blocks.mapInArrow(best, schema)


# --- inverted-file index ------------------------------------------------------

@dataclass(frozen=True)
class VectorIndex:
    """A stored index: blocks of unit vectors in folders by cell, the cells' centres, and the cells that a search probes."""

    path: str
    centres: np.ndarray
    probes: int
    schema: StructType

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/blocks")


def _near_cells(rows: DataFrame, centres: np.ndarray, cells: int) -> DataFrame:
    """``id, vector, grp``: each vector once for each of its nearest ``cells`` cells, as ``place`` from 0."""
    schema = StructType([*rows.schema.fields]).add("grp", IntegerType()).add("place", IntegerType())
    target = to_arrow_schema(schema)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = max(1, min(SIMILARITIES_AT_ONCE // len(centres), COPIES_AT_ONCE // min(cells, len(centres))))
        for whole in batches:
            for first in range(0, whole.num_rows, each):
                batch = whole.slice(first, each)
                sims = _matrix(batch.column(1)) @ centres.T
                order = np.argsort(-sims, axis=1, kind="stable")[:, :cells]
                row = np.repeat(np.arange(len(order)), order.shape[1])
                place = np.tile(np.arange(order.shape[1]), len(order))
                for low in range(0, len(row), COPIES_AT_ONCE):
                    some = slice(low, low + COPIES_AT_ONCE)
                    taken = pa.array(row[some])
                    out = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(order.ravel()[some], pa.int32()), pa.array(place[some], pa.int32())]
                    yield pa.RecordBatch.from_arrays(out, schema=target)

    return rows.mapInArrow(near, schema)


def build_vector_index(
    vectors: DataFrame, key: str, vector: str, path: str | None = None, cells: int | None = None, recall: float = 0.95, k: int = 10,
) -> VectorIndex:
    """Every vector stored by its nearest cell; the probes that reach ``recall`` at ``k`` are measured.

    Cells are centres of k-means on at most ``SAMPLE_ROWS`` vectors chosen by a
    hash of their key, as many as the square root of the rows says, ``MOST_CELLS``
    at most.  Every row is indexed.  The exact ``k`` neighbours of
    ``CALIBRATION_ROWS`` vectors are looked up, and the search will probe as many
    cells as hold ``recall`` of them.  Vectors that have no direction (null,
    empty, zero) are left out: no search can find them.  Vectors must be of one
    length.

    Rows of a crowded cell are dealt over tasks and files by key.
    """
    spark = vectors.sparkSession
    path = path or scratch_dir(spark, "vector-index")
    given = vectors.select(F.col(key).alias("id"), unit(vector).alias("vector")).where("vector is not null")
    rows = _stored(_packed(given), "unit-vectors")
    total = rows.count()
    number = cells or max(1, min(MOST_CELLS, round(math.sqrt(total))))
    if total:
        sample = _stored(hash_sample(given, min(SAMPLE_ROWS, total), ["id"]), "vector-sample").select(array_to_vector("vector").alias("features"))
        model = KMeans(k=min(number, total), seed=1, maxIter=10, distanceMeasure="cosine", initMode="random").fit(sample)
        centres = np.array(model.clusterCenters())
        centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    else:
        centres = np.zeros((1, 1))
    placed = _near_cells(rows, centres, 1).drop("place")
    packed = _blocks(placed, "right").withColumnRenamed("grp", "cell")
    # by cell and first key: a crowded cell becomes several files, a small one no more than one
    packed.repartitionByRange("cell", F.element_at("right_ids", 1)).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/blocks")
    index = VectorIndex(path, centres, len(centres), StructType([packed.schema[c] for c in ("right_ids", "right_vectors", "cell")]))
    if not total:
        return index
    asked = _stored(hash_sample(rows, CALIBRATION_ROWS, ["id"]), "vector-calibration")
    return replace(index, probes=_probes(index, asked, k, recall))


def _probes(index: VectorIndex, asked: DataFrame, k: int, recall: float) -> int:
    """Cells to probe so that ``recall`` of the exact neighbours of ``asked`` lie in them."""
    spark = asked.sparkSession
    stored = index.blocks(spark)
    all_cells = best_in_groups(asked.select(F.lit(0).alias("grp"), "id", "vector"), stored.withColumn("grp", F.lit(0)).drop("cell"), k, packed=True)
    exact = top_k(all_cells, k, [F.col("similarity").desc(), F.col("right_id").asc()], ["left_id"], ["right_id"])
    homes = stored.select("cell", F.explode("right_ids").alias("right_id"))
    found = exact.join(homes, "right_id").select("left_id", F.col("cell").alias("grp"))
    places = _near_cells(asked, index.centres, len(index.centres)).select(F.col("id").alias("left_id"), "grp", "place")
    counts = found.join(places, ["left_id", "grp"]).groupBy("place").count().orderBy("place").collect()  # one row a cell at most
    total, reached = sum(r["count"] for r in counts), 0
    for r in counts:
        reached += r["count"]
        if reached >= recall * total:
            return r["place"] + 1
    return len(index.centres)


def search_vector_index(index: VectorIndex, queries: DataFrame, query: str, query_vector: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """``query, key, similarity, rank``: the best ``k`` vectors in the cells that a query probes.

    Only folders of probed cells are read, and only best partners of each block
    are shuffled.  Queries are never gathered; a query without a direction finds
    nothing.  Ties go to the smaller key; fewer than ``k`` rows come where the
    cells hold fewer.
    """
    spark = queries.sparkSession
    asked = _packed(queries.select(F.col(query).alias("id"), unit(query_vector).alias("vector")).where("vector is not null"))
    probing = _near_cells(asked, index.centres, probes or index.probes).drop("place")
    wanted = [r["grp"] for r in probing.select("grp").distinct().collect()]  # numbers of cells, MOST_CELLS at most
    stored = index.blocks(spark).where(F.col("cell").isin(wanted)).withColumnRenamed("cell", "grp")
    found = best_in_groups(probing, stored, k, packed=True)
    best = top_k(found, k, [F.round("similarity", 9).desc(), F.col("right_id").asc()], ["left_id"], ["right_id"])
    return best.select(F.col("left_id").alias(query), F.col("right_id").alias("key"), "similarity", "rank")


# --- joins with a threshold ---------------------------------------------------

#: Chance to miss a pair at the threshold, and sign bits of a band at most.
MISSED = 1e-9
BAND_BITS = 16


def bands_for(threshold: float, missed: float = MISSED, bits: int = BAND_BITS) -> tuple[int, int]:
    """Bits of a band and number of bands, so that a pair at ``threshold`` shares none with chance ``missed`` at most.

    A random plane parts two vectors with the chance angle / pi.  Long bands keep
    groups small, many bands cost copies of the rows: the most bits up to ``bits``
    that need no more than 256 bands are taken.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    for n in range(bits, 0, -1):
        missing = 1 - same**n  # chance of one band to part such a pair
        bands = 1 if missing <= 0 else math.inf if missing >= 1 else math.ceil(math.log(missed) / math.log(missing))
        if bands <= 256:
            return n, bands
    return 0, 1  # so low a threshold leaves nothing to part: one group


def _in_bands(rows: DataFrame, bits: int, bands: int, seed: int = 7) -> DataFrame:
    """Rows (id, vector) once per band with ``grp``, the band's number and its sign bits."""
    schema = StructType().add("grp", LongType()).add("id", rows.schema["id"].dataType).add("vector", rows.schema["vector"].dataType)
    target = to_arrow_schema(schema)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("vector"))
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((matrix.shape[1], bits * bands))
            signs = ((matrix @ planes) > 0).reshape(len(matrix), bands, bits)
            codes = signs @ (1 << np.arange(bits)) + np.arange(bands) * (1 << bits) if bits else np.zeros((len(matrix), 1))
            for band in range(codes.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(codes[:, band].astype(np.int64)), batch.column("id"), batch.column("vector")], schema=target)

    return rows.mapInArrow(sign, schema)


def nearest_above(left: DataFrame, right: DataFrame, left_id: str, left_vector: str, right_id: str, right_vector: str, threshold: float) -> DataFrame:
    """``left_id, right_id, similarity``: for each left row the most similar right row at ``threshold`` or more, where there is one.

    Candidates share the signs of one band of random planes, and their
    similarity is then computed exactly; see ``bands_for`` for the chance of a
    miss.  Vectors that stand several times on a side are compared once (on the
    right the smallest id stands for them), so copies cost nothing.  Ties go to
    the smaller id; rows without a direction match nothing.
    """
    given = {
        side: _stored(_packed(rows.select(F.col(key).alias("id"), unit(vector).alias("vector")).where("vector is not null")), f"similar-{side}")
        for side, rows, key, vector in (("left", left, left_id, left_vector), ("right", right, right_id, right_vector))
    }
    # groups of about a block on the right: bands grow by a bit when its rows double
    bits, bands = bands_for(threshold, bits=max(4, min(BAND_BITS, math.ceil(math.log2(max(1, given["right"].count()) / BLOCK)))))
    first = given["right"].groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector")
    each = given["left"].groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector")
    found = best_in_groups(_in_bands(each, bits, bands), _in_bands(first, bits, bands), 1, threshold)
    best = top_k(found.where(F.round("similarity", 9) >= threshold), 1, [F.round("similarity", 9).desc(), F.col("right_id").asc()], ["left_id"], ["right_id"])
    # every left row has the match of its vector
    twins = given["left"].join(each.withColumnRenamed("id", "first"), "vector").select("id", "first")
    return twins.join(best, F.col("first") == F.col("left_id")).select(F.col("id").alias("left_id"), "right_id", "similarity")


def semantic_cache_near(
    requests: DataFrame, cache: DataFrame, request: str, request_vector: str, entry: str, entry_vector: str, threshold: float = 0.95,
) -> DataFrame:
    """Requests with ``similarity``, ``response`` and ``hit``: the answer of the nearest cached question at ``threshold`` or more.

    ``cache`` has ``response``.  Requests have unique ids; those without a match,
    or without a vector, are misses.  See ``nearest_above`` for ties and copies.
    """
    near = nearest_above(requests, cache, request, request_vector, entry, entry_vector, threshold)
    answers = cache.select(F.col(entry).alias("right_id"), "response")
    found = near.join(answers, "right_id").select(F.col("left_id").alias(request), "similarity", "response")
    return requests.join(found, request, "left").withColumn("hit", F.col("similarity").isNotNull())
