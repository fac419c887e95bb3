"""Helpers the operators of this subpackage share.

Operators select the columns they need before anything else, so extra columns of
the input, whatever their names, never meet the columns an operator makes.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_BYTES``, so that long texts do not fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def leave_no_memory() -> None:
    """Give what a finished task has freed back to the system. Python workers serve many
    tasks and stages; without this each keeps the largest of all its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def tidy(run):
    """The function of a ``mapInArrow``, which leaves no memory behind when it ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            leave_no_memory()

    return wrapped


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text); a null text is an empty one."""
    bound_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts fill about ``limit`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def id_type(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def held_out(doc_id: Column) -> Column:
    """The fold no model learns from: one document in four, by its id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fresh(df: DataFrame, name: str) -> str:
    """A column name the frame does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    """The cluster's own measure of how far to cut the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_least(df: DataFrame, keys: list[str], value: Column, out: str, how: str = "min") -> DataFrame:
    """``df`` with the least ``value`` of each group (or the sum) as column ``out``. Groups may
    be of any size: rows meet the result per salt, and the salts of one group are as many as
    there are shuffle partitions at most."""
    fold = {"min": F.min, "sum": F.sum}[how]
    salt, part = fresh(df, "salt"), fresh(df, "salt_part")
    salted = df.withColumn(out, value).withColumn(salt, F.pmod(F.xxhash64(*df.columns), F.lit(shuffle_parts(df.sparkSession))))
    some = salted.groupBy(*keys, salt).agg(fold(out).alias(part))
    whole = some.groupBy(*keys).agg(fold(part).alias(out))
    return salted.drop(out).join(some.select(*keys, salt).join(whole, keys), [*keys, salt]).drop(salt)


FILTER_BITS = 25


def likely_among(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be an id of ``ids`` (its first column), so that
    a join with few ids need not move all rows. The filter is a bitmap of 2^25 bits at most
    (4 MB, whatever the number of ids) and lets other rows through as it fills up."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << FILTER_BITS)) + 1
    spots = ids.select(place(ids.columns[0]).alias("p")).select(F.bitmap_bucket_number("p").alias("bucket"), F.bitmap_bit_position("p").alias("bit"))
    bucket, bits = fresh(df, "bitmap_bucket"), fresh(df, "bitmap_bits")
    bitmap = spots.groupBy(F.col("bucket").alias(bucket)).agg(F.bitmap_construct_agg("bit").alias(bits))
    marked = df.join(F.broadcast(bitmap), F.bitmap_bucket_number(place(column)) == F.col(bucket))
    bit = F.bitmap_bit_position(place(column))
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return marked.where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop(bucket, bits)
