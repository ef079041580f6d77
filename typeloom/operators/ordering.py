"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeloom.storage import Stage


def ranked(rows: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Adds each row's place, from 0, in the order of ``key``, which must be unique.

    Rows are range-partitioned and written once, as the borders are sampled and must be the same for both uses: the
    partitions' row counts, one row each, give every partition's first rank, and rows are numbered within theirs.
    """
    stage = Stage(rows.sparkSession, "ranked")
    placed = stage.keep(rows.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranges")
    before = placed.groupBy("__part").agg(F.count("*").alias("__k")).withColumn("__before", F.sum("__k").over(Window.orderBy("__part")) - F.col("__k")).drop("__k")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return placed.withColumn(name, within).join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def running_total(rows: DataFrame, group: str, order: str, weight: str, name: str = "upto") -> DataFrame:
    """Adds the sum of ``weight`` over the rows of the group up to and with this one, in ``order``, unique within a group.

    As in ``ranked``, rows are range-partitioned and written once. The sums of each group in each partition, a few rows a
    group, give what lies before a partition; no group is gathered in one task.
    """
    stage = Stage(rows.sparkSession, "running")
    placed = stage.keep(rows.repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(group, "__part").agg(F.sum(weight).alias("__k"))
    before = sums.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), (F.sum("__k").over(Window.partitionBy(group).orderBy("__part")) - F.col("__k")).alias("__before"))
    within = F.sum(weight).over(Window.partitionBy(group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.withColumn(name, within).join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before", "__g", "__p")
