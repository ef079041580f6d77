"""Writers: every result is a Parquet, JSON or CSV table; layouts replace the folders and shards of loose files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions.text import safe_label


def by_split(rows: DataFrame, path: str, label: str | None = None) -> None:
    """Pictures below their split, and below their label if one is named."""
    keys = ["split"]
    if label:
        rows, keys = rows.withColumn("label_dir", safe_label(F.col(label))), ["split", "label_dir"]
    rows.write.mode("errorifexists").partitionBy(*keys).parquet(path)


def sharded(rows: DataFrame, path: str, shard_size: int) -> None:
    """Files of at most shard_size rows."""
    rows.write.mode("errorifexists").option("maxRecordsPerFile", shard_size).parquet(path)


def manifest(cells: DataFrame, path: str) -> None:
    cells.select("cell_id", "glyph_id", "font_hash", "cell_row", "cell_col", "is_empty").write.mode("errorifexists").json(path)


def assignment(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.select("cell_id", "primitive_id").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def predictions(rows: DataFrame, path: str, append: bool = False) -> None:
    """One JSON line a file with its ranked labels."""
    rows.write.mode("append" if append else "errorifexists").json(path)


def grid_export(grids: DataFrame, splits: DataFrame, labels: DataFrame, stats: DataFrame, path: str, run: dict[str, str]) -> None:
    """The token grids with their splits, label map, statistics and the parameters of the run."""
    grids.write.mode("errorifexists").parquet(f"{path}/grids")
    splits.write.mode("errorifexists").parquet(f"{path}/splits")
    labels.write.mode("errorifexists").json(f"{path}/label_map")
    stats.write.mode("errorifexists").json(f"{path}/stats")
    grids.sparkSession.createDataFrame(sorted(run.items()), "key string, value string").write.mode("errorifexists").json(f"{path}/run")


def report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A small report as a single file."""
    writer = rows.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def metrics_log(rows: DataFrame, path: str) -> None:
    """Appends epochs to a log."""
    rows.write.mode("append").option("header", True).csv(path)


def dense_labels(cells: DataFrame, hole: int = 65535) -> DataFrame:
    """(cell_id, v array<int>, label): unpacked cells with their label, ``hole`` where there is none."""
    from typeloom.functions.bits import unpack

    return cells.select("cell_id", unpack(F.col("mask")).alias("v"), F.coalesce("primitive_id", F.lit(hole)).alias("label"))


def weights(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """A model's arrays, one row each."""
    rows = [(name, list(a.shape), [float(x) for x in a.ravel()]) for name, a in sorted(arrays.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, v array<double>").write.mode("errorifexists").parquet(path)
