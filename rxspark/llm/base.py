"""Shared plumbing: reading tables, hold-out remainders, tables in the shared folder, Arrow chunks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

#: Bytes of text handled at once by the Arrow operators; one longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bits that mark ids, in pieces of 32768 bits: 4 MB, whatever the number of ids.
MARKS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``mod``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def materialize(df: DataFrame, name: str, compression: str = "snappy", buckets: tuple[str, int] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a result computed once, which
    survives lost executors.  The table is dropped when the driver's Python ends.  ``buckets``: a column and a
    number of buckets; grouping by that column then needs no shuffle."""
    spark = df.sparkSession
    path = shared.fresh(spark, name)
    if buckets:
        named = f"rx_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets[1], buckets[0]).option("path", path).option("compression", compression).saveAsTable(named)
        atexit.register(_forget, spark, named)
        return spark.table(named)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, named: str) -> None:
    """The catalogue's entry of a table, if the session is still there."""
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {named}")


def among(df: DataFrame, column: str, ids: DataFrame, own: str, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``column`` is one of ``ids`` (column ``own``), and few others that share a mark with one; or those that
    have no mark, of which none is.  Ids are reduced to ``MARKS`` bits that every task has, so that rows with long texts
    aren't shuffled to meet them: the few that are left can be joined."""
    mark = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(MARKS)) + 1
    known = ids.where(F.col(own).isNotNull()).select(mark(own).alias("mark"))
    pieces = known.groupBy(F.bitmap_bucket_number("mark").alias("rx_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("mark")).alias("rx_bits"))
    marked = df.withColumn("rx_mark", mark(column)).withColumn("rx_piece", F.bitmap_bucket_number("rx_mark"))
    marked = marked.join(F.broadcast(pieces), "rx_piece", "inner" if inside else "left")  # at most MARKS / 32768 rows of 4 KB
    has = F.expr("conv(hex(substring(rx_bits, cast(bitmap_bit_position(rx_mark) div 8 as int) + 1, 1)), 16, 10) & shiftleft(1, cast(bitmap_bit_position(rx_mark) % 8 as int)) <> 0")
    return marked.where(has if inside else ~F.coalesce(has, F.lit(False))).select(*df.columns)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes in ``column``; a row is never divided."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    release()


def release() -> None:
    """Give freed memory back to the system: Python workers wait for their next task beside the executor's JVM, and what
    their allocators keep counts against the same container."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
