"""Opening file streams and running them to completion into shared storage."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coord.session import checkpoint_dir


def open_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of a parquet table; its schema is taken from the stored files.

    The path is given as a pattern that matches only itself, because the file source accepts a table stored
    as one file only in that form.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    path = f"{folder}/[{name[0]}]{name[1:]}"
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_time(df: DataFrame, delay: str, column: str = "ts") -> DataFrame:
    """Cast the event time for watermarking (which needs an instant) and declare how late it may be."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there now (append mode) into parquet files and return them as a table."""
    spark = stream.sparkSession
    folder = run_folder(spark, name)
    q = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", folder + "/out").option("checkpointLocation", folder + "/state").start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder + "/out")
