"""Table access: one place that knows where a table's Parquet lies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "fonts", "glyphs", "cell_grids", "cells", "samples", "meta_records", "file_checks", "grid_files", "eval_items",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temp views for the ad-hoc SQL surface."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
