"""Results as files: cleaned datasets, statistics, keyed results and their merging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists

BATCH, SNAPSHOT = "rx_batch", "rx_snapshot"


def write_entries(valid: DataFrame, path: str) -> None:
    """Cleaned entries as JSON lines, a folder for each source path; files of one name in different folders stay apart."""
    valid.withColumn("source", F.col("path")).write.mode("overwrite").partitionBy("source").json(path)


def as_array(valid: DataFrame) -> DataFrame:
    """(path, json): each file's entries as one JSON array in order, for datasets whose files fit a row."""
    entry = F.struct("entry_idx", F.struct("expr", "yes", "no", F.col("validation_error").alias("_validation_error")).alias("e"))
    return valid.groupBy("path").agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])).alias("json"))


def write_stats(stats: DataFrame, path: str, single: bool = False) -> None:
    """Statistics by file; ``single``: one JSON object keyed by file, as a text file."""
    if not single:
        stats.write.mode("overwrite").json(path)
        return
    rest = F.struct(*(c for c in stats.columns if c != "path"))
    stats.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", rest.alias("stats")))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def upsert(results: DataFrame, path: str, index: str = "index") -> DataFrame:
    """Store results whose index isn't stored yet, one for each index, in a folder of their own below ``path``; returns what was
    stored, read back."""
    spark = results.sparkSession
    if exists(spark, path):
        results = pending(results, spark.read.parquet(path), index)
    own = f"{path}/{BATCH}={uuid.uuid4().hex}"
    results.dropDuplicates([index]).write.parquet(own)
    return spark.read.schema(results.schema).parquet(own)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All that ``upsert`` has stored below ``path``."""
    return spark.read.parquet(path).drop(BATCH)


def write_snapshots(results: DataFrame, path: str, every: int = 50, index: str = "index") -> None:
    """Results with the snapshot that first holds them: one is taken at each index that ``every`` divides, 0 included, and one
    at the end.  A row is written once, however many snapshots hold it."""
    results.withColumn(SNAPSHOT, F.ceil(F.col(index) / every).cast("long")).write.mode("overwrite").partitionBy(SNAPSHOT).parquet(path)


def read_snapshot(spark: SparkSession, path: str, number: int) -> DataFrame:
    """Snapshot ``number`` (from 0): the results up to index ``number * every``; only their folders are read."""
    return spark.read.parquet(path).where(F.col(SNAPSHOT) <= number).drop(SNAPSHOT)


def pending(work: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """Work whose key isn't done."""
    return work.join(done.select(key), key, "left_anti")


def merge(parts: DataFrame, path: str, index: str = "index") -> DataFrame:
    """Keyed parts as one dataset in order of index; the last range of indices is the last file."""
    parts.repartitionByRange(index).sortWithinPartitions(index).write.mode("overwrite").parquet(path)
    return parts.sparkSession.read.parquet(path)


def dataset_statistics(results: DataFrame) -> DataFrame:
    """Totals, and averages for a pattern to one decimal."""
    n = lambda c: F.sum(F.size(c)).cast("long")
    return results.agg(F.count("*").alias("patterns"), n("yes").alias("yes_total"), n("no").alias("no_total"), F.round(F.avg(F.size("yes")), 1).alias("yes_avg"), F.round(F.avg(F.size("no")), 1).alias("no_avg"))
