"""Words, row tags and written tables shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_dir

#: White space and words of every contract: ASCII blanks only.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text as an array."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


#: Folders of the tables written inside the innermost ``condensed``.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


#: Lets Spark delete the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries in this block leave no shuffle files."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and the shuffles before it are removed.

    A lost executor costs no recomputation of what stands before, and columns
    such as row tags keep the value that was written.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def condensed(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of ``make()`` as a written table; the tables written on the way to it are removed."""
    outer = _passing.set([])
    try:
        result = make()
        path = scratch_dir(spark, name)
        with shuffles_removed(spark):
            result.write.parquet(path)
    finally:
        passed = _passing.get()
        _passing.reset(outer)
        for folder in passed:
            remove(spark, folder)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return spark.read.schema(result.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that the library itself has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """128 bits of SHA-256 of a text: equal keys stand for equal texts."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def struct_of(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def tagged(docs: DataFrame, name: str, carry: Sequence[str] | None = None, **more: Column) -> DataFrame:
    """Rows as ``row`` (unique number), ``doc`` (the carried columns, all by default, as a struct), then ``more``.

    The struct keeps columns of any name apart from those that operators add.
    """
    packed = docs.select(
        F.monotonically_increasing_id().alias("row"), struct_of(docs.columns if carry is None else carry).alias("doc"),
        *[c.alias(k) for k, c in more.items()],
    )
    return written(packed, name)


def with_verdict(docs_columns: list[str], verdict: list[str]) -> list[Column]:
    """Columns of ``doc`` but those that a verdict column replaces, then the verdict."""
    return [F.col(f"doc.`{c}`").alias(c) for c in docs_columns if c not in verdict] + [F.col(c) for c in verdict]


def many(total: int, each: int) -> int:
    """How many parts of about ``each`` a total makes, at least one."""
    return max(1, -(-int(total) // each))


#: Slots of a broadcast filter on keys, 64 to a row: its size holds at any input.
KEY_SLOTS = 1 << 24


def parted(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have a key of ``keys``, and those that surely have none.

    ``keys`` sets bits of a broadcast bitmap of fixed size.  Wide rows without a
    match then need no shuffle; a full bitmap lets rows through, never drops one.
    """
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(KEY_SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    bits = keys.where(F.col(key).isNotNull()).groupBy(F.shiftright(slot, 6).alias("_high")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.join(F.broadcast(bits), F.shiftright(slot, 6) == F.col("_high"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return tuple(marked.where(c).select(*[F.col(f"`{x}`") for x in rows.columns]) for c in (hit, ~hit))


def bounded_sample(rows: DataFrame, most: int, keys: Sequence[str]) -> DataFrame:
    """The first ``most`` rows in the order of a hash of ``keys``.

    Rows are counted first, and only about twice as many as asked for, those
    with the smallest hashes, go on to be sorted: what is gathered does not grow
    with the input.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    share = min(1.0, (2 * most + 500) / max(rows.count(), 1))
    return rows.where(place < int(share * (1 << 40))).orderBy(place, *keys).limit(most)
