"""Conversion of files as they arrive in a folder (an extension; batch conversion does not need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.convert import convert
from ..sources.files import as_inputs

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of inputs; each path once, within a day of event time."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["path"])


def convert_arrivals(spark: SparkSession, folder: str, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the jobs of each batch of arrivals to output, as Parquet in a folder for each batch."""

    def batch(files: DataFrame, number: int) -> None:
        inputs = as_inputs(files).withColumn("doc_id", F.xxhash64("path"))
        convert(inputs).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = arrivals(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
