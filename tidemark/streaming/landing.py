"""Landed pages as a stream: each new page file is exploded once and appended; the checkpoint is the resume point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import exploded_pages


def page_stream(spark: SparkSession, folder: str, record: T.StructType, files_per_batch: int = 100) -> DataFrame:
    page = T.StructType([T.StructField("status", T.StringType()), T.StructField("total", T.LongType()), T.StructField("count", T.LongType()), T.StructField("records", T.ArrayType(record))])
    raw = spark.readStream.schema(page).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return exploded_pages(raw.select("*", F.col("_metadata.file_name").alias("page_file")))


def land(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Everything that has arrived, exactly once, then stop."""
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
