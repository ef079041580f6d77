"""Cells that keep arriving: an optional extension, as the batch operators above need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from typeloom.operators.nearest import nearest_centroid


def arriving(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_arrivals(cells: DataFrame, key: str = "cell_id", time: str = "extracted_at", delay: str = "30 days") -> DataFrame:
    """Each cell once, however often it comes within the watermark's delay."""
    at = F.col(time).cast("timestamp")
    return cells.withColumn(time, at).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def ink_by_window(cells: DataFrame, width: str = "1 hour", delay: str = "30 days") -> DataFrame:
    """(window, font_hash, cells, filled) in tumbling windows; what comes later than the delay is left out."""
    timed = cells.withColumn("extracted_at", F.col("extracted_at").cast("timestamp")).withWatermark("extracted_at", delay)
    return timed.groupBy(F.window("extracted_at", width), "font_hash").agg(F.count("*").alias("cells"), F.count_if(F.col("mask") != 0).alias("filled"))


def assigned_stream(cells: DataFrame, centroids: DataFrame, vector: str, out: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch is assigned to the nearest centroids and written below its own batch number, so a repeated batch
    replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        nearest_centroid(batch, "cell_id", vector, centroids).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
