"""What several corpus operators need: scratch tables, global order, key filters, components."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: 64-bit words of the broadcast key filter: 131,072 rows whatever the input holds.
FILTER_WORDS = 1 << 17
#: Folders that written() has made inside the current scope(); None outside of any.
_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: rows and bytes of the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function whose freed memory goes back to the system.

    Python workers are reused; without this, each keeps the most that any earlier task needed. Large arrays
    get their own mappings, and what Arrow and the allocator still hold is given up at the task's end.
    """

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        except (AttributeError, OSError):  # another C library: only the hints are lost
            libc = None
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc:
                libc.malloc_trim(0)

    return run


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a local folder serves a local master (one machine, as in tests); a cluster raises.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}/hexcast-scratch"
    return shared.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (tables := _TABLES.get()) is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Inside, written() notes its tables for forget(); those of lazy results made elsewhere are not touched."""
    before = _TABLES.set([])
    try:
        yield
    finally:
        _TABLES.reset(before)


def forget(spark: SparkSession, but: DataFrame | None = None) -> None:
    """Delete the tables that written() has made in this scope(), except those that `but` reads.

    Call it when a result has been written: results are lazy and read these tables until then.
    """
    tables = _TABLES.get()
    if not tables:
        return
    used = {f.split("/part-")[0].rsplit("/", 1)[-1] for f in but.inputFiles()} if but is not None else set()
    kept = [p for p in tables if p.rsplit("/", 1)[-1] in used]
    for p in set(tables) - set(kept):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    tables[:] = kept


def in_order(items: DataFrame, *order: str) -> DataFrame:
    """Range-partition items by the order columns and write them with their place.

    Adds __part (range partition; ascending with the order) and __tie (breaks ties between equal
    rows, so a value that fills a third of the table still spreads over many partitions).
    """
    spark = items.sparkSession
    ranged = items.withColumn("__tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(width(spark), *order, "__tie")
    return written(ranged.withColumn("__part", F.spark_partition_id()), "ordered")


def with_prefix_sums(ordered: DataFrame, order: list[str], size: str) -> DataFrame:
    """Global exclusive prefix sums over the output of in_order().

    Adds __before (sum of size over all earlier rows), __row (number of earlier rows) and __total.
    Only one row per partition meets in one task; the rest is summed within its partition.
    """
    parts = ordered.groupBy("__part").agg(F.sum(size).alias("__s"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    bases = parts.select(
        "__part",
        F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s0"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.sum("__s").over(everything).alias("__total"),
    )
    within = Window.partitionBy("__part").orderBy(*order, "__tie")
    so_far = F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0))
    # bases has one row per range partition, so its size is bounded by the partition count
    placed = ordered.join(F.broadcast(bases), "__part")
    placed = placed.withColumn("__before", F.col("__s0") + so_far - F.col(size))
    placed = placed.withColumn("__row", F.col("__n0") + F.row_number().over(within) - 1)
    return placed.drop("__s0", "__n0")


def _filter_word(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(FILTER_WORDS))


def _filter_mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(2))
    bit = lambda k: F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), bit(k))
    return one(0).bitwiseOR(one(1)).bitwiseOR(one(2))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A blocked Bloom filter of the keys: at most FILTER_WORDS rows (__word, __bits)."""
    masks = keys.select(_filter_word(F.col(key)).alias("__word"), _filter_mask(F.col(key)).alias("__mask"))
    return masks.groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))


def maybe_with_keys(rows: DataFrame, key: str, filter_: DataFrame) -> DataFrame:
    """Drop rows whose key is surely not in the filter, before anything is shuffled.

    The filter's size is fixed (FILTER_WORDS), so broadcasting it is bounded; as the keys grow it lets
    more rows through and an exact join must follow.
    """
    joined = rows.withColumn("__word", _filter_word(F.col(key))).join(F.broadcast(filter_), "__word")
    mask = _filter_mask(F.col(key))
    return joined.where(F.col("__bits").bitwiseAND(mask) == mask).drop("__word", "__bits")


def split_by_filter(rows: DataFrame, key: str, filter_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not in the filter, all others); null keys are among the first."""
    bits = filter_.select(F.struct("__word", "__bits").alias("__filter"))
    inner = rows.select(F.struct("*").alias("__row_of"), F.col(key).alias("__filter_key"))
    flagged = inner.join(F.broadcast(bits), _filter_word(F.col("__filter_key")) == F.col("__filter.__word"), "left")
    mask = _filter_mask(F.col("__filter_key"))
    maybe = F.coalesce(F.col("__filter_key").isNotNull() & (F.col("__filter.__bits").bitwiseAND(mask) == mask), F.lit(False))
    return flagged.where(~maybe).select("__row_of.*"), flagged.where(maybe).select("__row_of.*")


def without_keys(rows: DataFrame, drop: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not among drop's; a null equals a null.

    Rows that the bounded broadcast filter clears pass without a shuffle; only the others meet drop in an
    exact anti join over all keys.
    """
    kinds = dict(drop.dtypes)
    drop = written(drop.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct(), "dropped")
    marks = drop.select(F.xxhash64(*drop.columns).alias("__mark"))
    marked = rows.withColumn("__mark", F.xxhash64(*[F.col(k).cast(kinds[k]) for k in keys]))
    passed, maybe = split_by_filter(marked, "__mark", key_filter(marks, "__mark"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return passed.unionByName(maybe.join(drop, same, "left_anti")).select(*rows.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (node, component); component is the least node id.

    Alternating large-star and small-star steps (Kiveris et al., 2014); each round is written to the
    shared folder, and only counts reach the driver. Rounds grow with the logarithm of the diameter.
    """
    def meet(e: DataFrame, least: DataFrame) -> DataFrame:
        # by a hash of the node: a join with an exchange of its own, which adaptive execution may split at a hub
        left = e.withColumn("__h", F.xxhash64("a"))
        right = least.select(F.xxhash64("a").alias("__h2"), F.col("a").alias("__a2"), "m")
        return left.join(right, (F.col("__h") == F.col("__h2")) & (F.col("a") == F.col("__a2")))

    def star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a node moves to the node's least neighbour
        large = meet(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = meet(large, low).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return small.where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = written(e, "edges")
    last = mark(e)
    while last[0]:
        e = written(star(e), "edges")
        now = mark(e)
        if now == last:
            break
        last = now
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
