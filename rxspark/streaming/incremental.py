"""Incremental runs over folders that grow: each file is validated once, each index generated once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.validate import validate
from ..sources.ingest import entries


def validate_new_files(spark: SparkSession, source: str, target: str, checkpoint: str, seconds: float | None = None, once: bool = True) -> StreamingQuery:
    """Validates files that came since the last run and appends their entries to ``target`` (Parquet).  The checkpoint
    remembers what was read; ``once`` stops when nothing is left."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(source)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), "value").where(~F.col("path").contains("temp_results"))

    def append(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        validate(entries(batch), seconds=seconds).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def extract_responses(work: DataFrame, responses: DataFrame, done: DataFrame | None = None, index: str = "index") -> DataFrame:
    """(index, response) still to be processed: work that has a response and is not done."""
    open_ = work if done is None else work.join(done.select(index), index, "left_anti")
    return open_.join(responses, index)
