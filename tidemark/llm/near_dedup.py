"""Near duplicates by a MinHash LSH forest: sorted signature orders and their neighbours.

A signature has 128 values.  Order t sorts all distinct texts by the values
from 4t on, round and round.  Neighbours in an order that share a prefix of four
values or more are candidates: in a thin region these are all texts with that
prefix.  Candidates are confirmed on full sets.

A prefix that more texts share than a neighbour window holds is a crowded run.
Its texts are first paired with one of them only.  Those that this leaves apart
are sorted again among themselves, where those side by side share the longest
prefix, so the depth follows the crowd.  Where the run is not one
component yet, all are compared with the run's best linked text, and those of
different components then with each other, in blocks of bounded size: no pair
with a common prefix is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidemark.llm.common import condensed, parted, struct_of, tagged, text_key, text_of, with_verdict, written
from tidemark.llm.graph import components, joined_components
from tidemark.llm.spans import LOWER, Hashes, steps, words

VALUES, ORDERS, PREFIX, DEPTH = 128, 32, 4, 24
#: Neighbours before a text, in each order, that it is paired with.
NEIGHBOURS = 4
#: Pairs whose signatures agree in less than the threshold minus this are no
#: candidates: more than five standard deviations at 128 values.
MARGIN = 0.2
#: Partners per text that are confirmed first; the rest only where they may join two components.
FIRST = 2
#: Rows, and bytes of shingle sets, of a block of a crowded run.
BLOCK_ROWS, BLOCK_BYTES = 1024, 16 << 20

VERDICT = ["n_shingles", "component_id", "kept"]


@lru_cache(maxsize=1)
def _hashes() -> tuple[Hashes, Hashes, np.ndarray, np.ndarray]:
    made = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (2, VALUES), dtype=np.uint64)
    return Hashes(5), Hashes(6), made[0] * np.uint64(2) + np.uint64(1), made[1]


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per step of texts: shingle hashes, and the offsets of each text's own.

    Letters A to Z count as small.  A text with fewer words than ``size`` has its
    whole sequence as one shingle; one without words has none.
    """
    by_byte, by_word, _, _ = _hashes()
    for _, _, data, offsets in steps(texts):
        starts, ends, first = words(data, offsets)
        values = by_byte.texts(LOWER[data], starts, ends)
        count = np.diff(first)
        made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
        at = np.repeat(first[:-1], made) + np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made)
        width = np.repeat(np.minimum(count, size), made)
        yield by_word.slices(values, at, at + width), np.append(0, np.cumsum(made))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 16-bit MinHash values for each text with shingles, zeros for the others."""
    _, _, times, plus = _hashes()
    some = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, VALUES), ">u2")
    if len(some):
        low = np.empty((len(some), VALUES), np.uint64)
        for k in range(VALUES):
            low[:, k] = np.minimum.reduceat(hashes * times[k] + plus[k], offsets[some])
        out[some] = ((low * times[0]) >> np.uint64(48)).astype(">u2")
    return out


def _sketches(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, keys, marks = [], [], []
            for hashes, offsets in shingle_sets(b["text"], size):
                signed = signatures(hashes, offsets)
                for k in range(len(offsets) - 1):
                    own = np.unique(hashes[offsets[k] : offsets[k + 1]])
                    count.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    marks.append(signed[k].tobytes() if len(own) else None)
            yield pa.record_batch({
                "row": b["row"], "id": b["id"], "digest": b["digest"], "n_shingles": pa.array(count, pa.int64()), "key": pa.array(keys, pa.binary()), "signature": pa.array(marks, pa.binary()),
            })

    return sketch


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each signature once per order, turned to begin with that order's values."""
    for b in batches:
        rows = b["row"].to_numpy(zero_copy_only=False)
        signed = np.frombuffer(b"".join(b["signature"].to_pylist()), ">u2").reshape(len(rows), VALUES)
        for t in range(ORDERS):
            turned = np.ascontiguousarray(np.roll(signed, -t * (VALUES // ORDERS), axis=1)[:, :DEPTH])
            body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DEPTH), len(rows), [None, pa.py_buffer(turned)]).cast(pa.binary())
            yield pa.record_batch({"tree": pa.array(np.full(len(rows), t, np.int32)), "turned": body, "row": pa.array(rows)})


def _neighbours(everywhere: bool):
    """Pairs of sorted rows with a common prefix: of all rows the next ones, or of the first rows of a run all up to ``NEIGHBOURS`` apart."""
    width, reach = 2 * PREFIX, 1 if everywhere else NEIGHBOURS

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key, row, rank = np.zeros(0, np.int32), np.zeros(0, "<u8"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            body = np.frombuffer(b"".join(b["turned"].to_pylist()), np.uint8).reshape(b.num_rows, 2 * DEPTH)
            tree = np.concatenate([tree, b["tree"].to_numpy(zero_copy_only=False)])
            key = np.concatenate([key, np.ascontiguousarray(body[:, :width]).view("<u8").ravel()])
            row = np.concatenate([row, b["row"].to_numpy(zero_copy_only=False)])
            held, place = len(rank), np.arange(len(row))
            begins = np.append(True, (key[1:] != key[:-1]) | (tree[1:] != tree[:-1]))
            since = np.maximum.accumulate(np.where(begins, place, 0))
            # the first run may have begun in an earlier batch
            rank = place - since + np.where(since == 0, rank[0] if held else 0, 0)
            left, right = [], []
            for lag in range(1, reach + 1):
                at = place[max(held, lag) :]
                at = at[(rank[at] >= lag) & (everywhere | (rank[at] <= NEIGHBOURS))]
                left.append(row[at - lag])
                right.append(row[at])
            a, c = np.concatenate(left), np.concatenate(right)
            yield pa.record_batch({"a": pa.array(np.minimum(a, c)), "b": pa.array(np.maximum(a, c))})
            tree, key, row, rank = tree[-NEIGHBOURS:], key[-NEIGHBOURS:], row[-NEIGHBOURS:], rank[-NEIGHBOURS:]

    return pair


def neighbour_pairs(signed: DataFrame, everywhere: bool = False) -> DataFrame:
    """``a, b``: rows that are neighbours, once for each order; at most eight partners per row and order."""
    sorted_rows = signed.select("row", "signature").mapInArrow(_orders, "tree int, turned binary, row long")
    parts = signed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_rows = sorted_rows.repartitionByRange(int(parts), "tree", "turned", "row").sortWithinPartitions("tree", "turned", "row")
    return sorted_rows.mapInArrow(_neighbours(everywhere), "a long, b long")


def candidate_pairs(signed: DataFrame, crowded: DataFrame) -> DataFrame:
    """``a, b, votes``: pairs of the first neighbours of each run, and of the rows of each crowded run with its hub."""
    with_hub = crowded.where("row <> hub").select(F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b"))
    return neighbour_pairs(signed).unionByName(with_hub).groupBy("a", "b").agg(F.count("*").alias("votes"))


def _pairs_with(pairs: DataFrame, of_row: DataFrame, column: str) -> DataFrame:
    """Pairs with ``column`` of both rows as ``left`` and ``right``."""
    a, b = (of_row.select(F.col("row").alias(k), F.col(column).alias(side)) for k, side in (("a", "left"), ("b", "right")))
    return pairs.join(a, "a").join(b, "b")


def likely(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures agree in at least ``threshold - MARGIN`` of their values."""
    least = int((threshold - MARGIN) * VALUES)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(-1, VALUES) for c in ("left", "right"))
            keep = pa.array((left == right).sum(axis=1) >= least)
            yield b.select(["a", "b", "votes"]).filter(keep)

    return _pairs_with(pairs, signed, "signature").select("a", "b", "votes", "left", "right").mapInArrow(alike, "a long, b long, votes long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= ``percent`` * union of their full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["left"], b["right"], strict=True):
                left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _pairs_with(pairs, sets, "shingles").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def _sets(size: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.unique(h[a:z]).tobytes() for h, at in shingle_sets(b["text"], size) for a, z in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch({"row": b["row"], "bytes": pa.array([len(x) for x in out], pa.int64()), "shingles": pa.array(out, pa.binary())})

    return made


def _sets_of(texts: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``row, bytes, shingles`` of ``members`` (row, digest), from the texts by their digests."""
    near, _ = parted(texts, "digest", members)
    # copies of a text are merged where they are read
    one = near.groupBy("digest").agg(F.first("text").alias("text")).join(members, "digest")
    return written(one.select("row", "text").mapInArrow(_sets(size), "row long, bytes long, shingles binary"), "near-sets")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each signature's prefix in each order."""
    for b in batches:
        signed = np.frombuffer(b"".join(b["signature"].to_pylist()), ">u2").reshape(b.num_rows, VALUES)
        for t in range(ORDERS):
            head = np.ascontiguousarray(np.roll(signed, -t * (VALUES // ORDERS), axis=1)[:, :PREFIX]).view("<i8").ravel()
            yield pa.record_batch({"tree": pa.array(np.full(b.num_rows, t, np.int32)), "head": pa.array(head), "row": b["row"]})


def crowded_runs(signed: DataFrame) -> DataFrame:
    """``run, row, hub``: the rows of each prefix that more rows share than a neighbour window holds.

    The hub is the row with the least hash, so that runs with common rows mostly share their hub.
    """
    heads = signed.select("row", "signature").mapInArrow(_prefixes, "tree int, head long, row long").select(F.xxhash64("tree", "head").alias("run"), "row")
    runs = heads.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("row").alias("h"), "row")).alias("least"))
    runs = written(runs.where(F.col("n") > NEIGHBOURS + 1).select("run", F.col("least.row").alias("hub")), "near-runs")
    some, _ = parted(heads, "run", runs)
    return written(some.join(runs, "run"), "near-crowded")


def _open_runs(crowded: DataFrame, root: DataFrame) -> DataFrame:
    """``run, row, root, hub_root`` of the runs that hold several components; of runs with the same rows, one."""
    here = crowded.join(root.withColumnRenamed("node", "row"), "row", "left").select("run", "row", "hub", F.coalesce("root", "row").alias("root"))
    runs = here.groupBy("run").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("mark"),
        F.max(F.when(F.col("row") == F.col("hub"), F.col("root"))).alias("hub_root"),
    )
    once = runs.where("low <> high").groupBy("n", "mark").agg(F.min(F.struct("run", "hub_root")).alias("one")).select("one.*")
    return written(here.drop("hub").join(once, "run"), "near-open")


def _linked(percent: int):
    """Confirmed links of a cell that join two components: of side 0 with side 1, or inside side 0 where it is alone."""

    def compare(cell: pa.Table) -> pa.Table:
        side, row = (cell[c].to_numpy() for c in ("side", "row"))
        _, group = np.unique(cell["root"].to_numpy(), return_inverse=True)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for c in cell["shingles"].chunks for v in c]
        size = np.array([len(x) for x in sets])
        at = np.append(0, np.cumsum(size))
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        own, two = np.zeros(int(codes.max()) + 1, bool), bool((side == 1).any())
        a, b = [], []
        for x in np.flatnonzero(side == 0):
            other = group != group[x]
            other &= side == 1 if two else np.arange(len(row)) > x
            if not other.any():
                continue
            mine = codes[at[x] : at[x + 1]]
            own[mine] = True
            common = np.add.reduceat(own[codes], at[:-1], dtype=np.int64)
            own[mine] = False
            for y in np.flatnonzero(other & (100 * common >= percent * (size + size[x] - common))):
                if group[y] != group[x]:
                    a.append(min(row[x], row[y]))
                    b.append(max(row[x], row[y]))
                    group[group == group[y]] = group[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """``key, blocks``: how many blocks the rows of a key make."""
    count = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES))
    return rows.groupBy(key).agg(count.cast("int").alias("blocks"))


def _compared(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` found in cells ``key, i, j, side, row, root``."""
    filled = cells.join(sets.select("row", "shingles"), "row")
    return written(filled.groupBy("key", "i", "j").applyInArrow(_linked(percent), "a long, b long").distinct(), "near-links")


def hub_links(rows: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the rows of each run with its row that has the most links."""
    degree = found.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count("*").alias("degree"))
    ranked = rows.join(degree, "row", "left")
    hubs = ranked.groupBy("run").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), F.col("row").alias("hub"), F.col("root").alias("hub_root"))).alias("best"))
    pairs = rows.drop("hub_root").join(hubs.select("run", "best.hub", "best.hub_root"), "run").where("root <> hub_root").select("hub", "hub_root", "row", "root").distinct()
    pairs = written(pairs.join(sets.select("row", "bytes"), "row"), "near-hubs")
    blocks = written(_blocks(pairs, "hub").join(pairs.select("hub", "hub_root").distinct(), "hub"), "near-blocks")
    spread = pairs.join(blocks.select("hub", "blocks"), "hub").select(
        F.col("hub").alias("key"), F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"), "row", "root"
    )
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    heads = blocks.select(F.col("hub").alias("key"), each.alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("hub").alias("row"), F.col("hub_root").alias("root"))
    return _compared(spread.unionByName(heads), sets, percent)


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each run: every block of its rows meets every other."""
    sized = written(rows.join(sets.select("row", "bytes"), "row"), "near-sized")
    dealt = sized.join(_blocks(sized, "run"), "run").withColumn("own", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    met = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select(
        F.col("run").alias("key"), F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), (F.col("own") > F.col("met")).cast("int").alias("side"), "row", "root"
    )
    return _compared(cells, sets, percent)


def _between(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that do not lie in one component."""
    for end in ("a", "b"):
        pairs = pairs.join(root.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))).drop("root_a", "root_b")


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()


def links(texts: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, root`` of all distinct texts that are linked with another.

    ``texts`` has ``digest, text``; ``signed`` has ``row, digest, signature`` of
    the distinct texts.  Each text's best partners are confirmed first.  Of the
    other candidates only those between different components can change the
    result; all of them are confirmed then.  Crowded runs that still hold several
    components are sorted again, and then compared as a whole.
    """
    digests, known = signed.select("row", "digest"), None

    def with_sets(members: DataFrame) -> DataFrame:
        """Sets of these rows and of all before."""
        nonlocal known
        lack = members if known is None else members.join(known.select("row"), "row", "left_anti")
        made = _sets_of(texts, digests.join(lack, "row", "left_semi"), size)
        known = made if known is None else known.unionByName(made)
        return known

    crowded = crowded_runs(signed)
    pairs = written(likely(written(candidate_pairs(signed, crowded), "near-pairs"), signed, percent / 100), "near-likely")
    sets = with_sets(_members(pairs))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row"), "a", "b", "votes")
    # at most eight partners a row and order, and the hubs' rows
    best = Window.partitionBy("row").orderBy(F.col("votes").desc(), "a", "b")
    strong = written(ends.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= FIRST).select("a", "b").distinct(), "near-strong")
    found = written(confirmed(strong, sets, percent), "near-links")
    rest = pairs.select("a", "b").join(strong, ["a", "b"], "left_anti")
    root = components(found)
    more = written(confirmed(_between(rest, root), sets, percent), "near-links")
    found, root = found.unionByName(more), joined_components(root, more)
    rows = _open_runs(crowded, root)
    if rows.isEmpty():
        return root
    apart = written(signed.join(rows.where("root <> hub_root").select("row").distinct(), "row", "left_semi"), "near-apart")
    pairs = neighbour_pairs(apart, everywhere=True).groupBy("a", "b").agg(F.count("*").alias("votes"))
    pairs = written(likely(written(_between(pairs, root), "near-pairs"), apart, percent / 100), "near-likely")
    more = written(confirmed(pairs.select("a", "b"), with_sets(_members(pairs)), percent), "near-links")
    found, root = found.unionByName(more), joined_components(root, more)
    rows = _open_runs(crowded, root)
    if rows.isEmpty():
        return root
    sets = with_sets(rows.select("row").distinct())
    root = joined_components(root, hub_links(rows, found, sets, percent))
    rows = _open_runs(crowded, root)
    return root if rows.isEmpty() else joined_components(root, block_links(rows, sets, percent))


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None, size: int = 5, percent: int = 80,
) -> DataFrame:
    """The rows' ``carry`` columns (default all) with ``n_shingles``, ``component_id`` and ``kept``.

    Sets are distinct shingles of ``size`` words; texts link at a Jaccard
    similarity of ``percent`` or more.  ``component_id`` is the smallest id
    reachable; a null id ranks behind all others.  Exactly one row of a
    component is kept, also where ids or whole rows repeat.  Null texts and
    texts without words have an empty set and link with nothing.  An input
    column named like a verdict column is replaced.
    """
    carry = list(docs.columns if carry is None else carry)
    return judge_near(docs, id_col, text_col, carry, size, percent).select(*with_verdict(carry, VERDICT))


def judge_near(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None, size: int = 5, percent: int = 80,
) -> DataFrame:
    """As ``near_dedup``, with the carried columns in one struct ``doc``.

    Where only the id is carried, no text is written or shuffled for it.
    """
    carry = list(docs.columns if carry is None else carry)
    if set(carry) == {id_col}:
        judged = near_verdict(docs, F.col(f"`{id_col}`"), text_of(text_col), size, percent)
        return judged.select(F.struct(*[F.col("id").alias(c) for c in carry]).alias("doc"), *VERDICT)
    rows = tagged(docs, "near-rows", list(dict.fromkeys([*carry, id_col, text_col])))
    judged = near_verdict(rows, F.col(f"doc.`{id_col}`"), text_of(f"doc.`{text_col}`"), size, percent, F.col("row"))
    if len(rows.schema["doc"].dataType.names) > len(carry):
        rows = rows.select("row", F.struct(*[F.col(f"doc.`{c}`").alias(c) for c in carry]).alias("doc"))
    return rows.join(judged.select("row", *VERDICT), "row").select("doc", *VERDICT)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that ``near_dedup`` keeps, with all their columns.

    The verdict lists what goes; a bitmap lets all rows that surely stay pass
    where they are read, so only dropped documents are shuffled.  Of rows with
    equal id and text that hold the one to keep, any one stays.
    """
    given, text = F.col(f"`{id_col}`"), text_of(text_col)
    judged = near_verdict(docs, given, text, size, percent)
    which = F.xxhash64("id", "digest").alias("which")
    listed = judged.groupBy("id", "digest").agg(F.count("*").alias("n"), F.count_if("kept").alias("stay")).where("stay < n").select("id", "digest", "stay", which)
    listed = written(listed, "near-dropped")
    rows = docs.select(struct_of(docs.columns).alias("doc"), given.alias("id"), text_key(text).alias("digest")).select("doc", "id", "digest", which)
    maybe, sure = parted(rows, "which", listed)
    d, g = maybe.alias("d"), listed.alias("g")
    same = (F.col("d.which") == F.col("g.which")) & F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.digest") == F.col("g.digest"))
    met = d.join(g, same, "left").select("d.doc", "d.id", "d.digest", "g.stay")
    one = met.where("stay > 0").groupBy("id", "digest").agg(F.first("doc").alias("doc"))
    return sure.select("doc").unionByName(met.where("stay is null").select("doc")).unionByName(one.select("doc")).select("doc.*")


def near_verdict(docs: DataFrame, id_of: Column, text: Column, size: int, percent: int, row: Column | None = None) -> DataFrame:
    """``row, id, digest`` of the text and ``VERDICT`` of each document, as a written table; all others written for it are removed."""
    given = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"), id_of.alias("id"), text_key(text).alias("digest"), text.alias("text"),
    )
    binary = [StructField(c, BinaryType()) for c in ("digest", "key", "signature")]
    shape = StructType([
        StructField("row", LongType()), StructField("id", given.schema["id"].dataType), binary[0], StructField("n_shingles", LongType()), *binary[1:],
    ])

    def judged() -> DataFrame:
        # rows are numbered here, once
        sketches = written(given.mapInArrow(_sketches(size), shape), "near-sketches")
        slim = sketches.drop("signature")
        best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
        sets = written(slim.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), best), "near-distinct")
        signed = written(sketches.join(sets.select(F.col("node").alias("row")), "row", "left_semi").select("row", "digest", "signature"), "near-signatures")
        root = links(given.select("digest", "text"), signed, size, percent)
        placed = written(sets.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-placed")
        leads = placed.groupBy("root").agg(F.min("best").alias("lead"))
        by_key = written(placed.join(leads, "root").select("key", "lead"), "near-leads")
        return slim.join(by_key, "key", "left").select(
            "row", "id", "digest", "n_shingles", F.coalesce("lead.id", "id").alias("component_id"), F.coalesce(F.col("lead.row") == F.col("row"), F.lit(True)).alias("kept")
        )

    return condensed(docs.sparkSession, judged, "near-verdict")
