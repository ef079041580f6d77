"""Histograms, weights and other counting aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.operators.ordering import ranked, running_total

POPULATION_EDGES = (0, 10, 100, 1_000, 10_000, 100_000, 1_000_000_000)
CLASS_EDGES = (0, 1, 2, 5, 10, 20, 50, 100, 1_000_000)


def filled_histogram(spark: SparkSession, rows: DataFrame, value: str, size: int) -> DataFrame:
    """(value, n, pct) for 0..size-1, zeros included; other values are left out."""
    counts = rows.filter((F.col(value) >= 0) & (F.col(value) < size)).groupBy(F.col(value).cast("bigint").alias("value")).agg(F.count("*").alias("n"))
    every = spark.range(size).withColumnRenamed("id", "value").join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return every.withColumn("pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), total), F.lit(0.0)), 9))


def bucket(value: Column, edges: tuple[int, ...]) -> Column:
    """The number of the half-open range [edge, next edge) that holds the value; the last one is open, null below the first."""
    out = F.when(value < edges[0], F.lit(None))
    for i in range(len(edges) - 1):
        out = out.when(value < edges[i + 1], i) if i < len(edges) - 2 else out.when(value >= edges[i], i)
    return out


def bucketed(histogram: DataFrame, edges: tuple[int, ...] = POPULATION_EDGES) -> DataFrame:
    """(bucket, values, population, population_pct) over a filled histogram."""
    of = histogram.withColumn("bucket", bucket(F.col("n"), edges)).groupBy("bucket").agg(F.count("*").alias("values"), F.sum("n").alias("population"))
    pct = F.try_divide(100.0 * F.col("population"), F.sum("population").over(Window.partitionBy()))
    return of.withColumn("population_pct", F.round(F.coalesce(pct, F.lit(0.0)), 9))


def top_frequencies(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k commonest values, ties by value."""
    return rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def class_weights(rows: DataFrame, label: str, alpha: float = 0.5, labels: DataFrame | None = None) -> DataFrame:
    """(label, n, weight): (N/(n+1))^alpha, scaled to a mean of 1 over the labels seen; 0 for those of ``labels`` never seen."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    if labels is not None:
        seen = class_weights(rows, label, alpha)
        return labels.select(label).distinct().join(seen, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    every = Window.partitionBy()
    raw = counts.withColumn("w", F.pow(F.sum("n").over(every) / (F.col("n") + 1.0), F.lit(alpha)))
    return raw.select(label, "n", F.round(F.col("w") / F.avg("w").over(every), 9).alias("weight"))


def _counted(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, k, upto, n): each distinct value's count, the rows up to it, and the rows of the group."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    ran = running_total(counts, group, value, "k")
    sizes = ran.groupBy(group).agg(F.sum("k").alias("n")).withColumnRenamed(group, "__group")
    return ran.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the middle value, or the mean of the two middle ones; no group's values are gathered in one task."""
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    at = lambda place: F.max(F.when((place < F.col("upto")) & (place >= F.col("upto") - F.col("k")), F.col(value)))
    return _counted(rows, group, value).groupBy(group).agg(((at(low) + at(high)) / 2).alias("median"))


def order_statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, low, high, mean, p50, p90, p95) with the elements at n//2, floor(.9n)-1 and floor(.95n)-1 of the sorted values.

    A position of -1 wraps to the last element. The positions are found by counting: values are counted first, and
    running counts over the distinct values of a group, in ranges, show which one stands at a position, so no group is
    collected.
    """
    ran = _counted(rows, group, value)

    def at(position: Column) -> Column:
        place = F.when(position < 0, F.col("n") - 1).otherwise(position)
        return F.max(F.when((place < F.col("upto")) & (place >= F.col("upto") - F.col("k")), F.col(value)))

    n = F.col("n")
    return ran.groupBy(group).agg(
        F.max("n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.sum(F.col(value) * F.col("k")) / F.max("n"), 6).alias("mean"),
        at(F.floor(n / 2)).alias("p50"), at(F.floor(n * F.lit(0.9)) - 1).alias("p90"), at(F.floor(n * F.lit(0.95)) - 1).alias("p95"),
    )


def dense_labels(rows: DataFrame, label: str) -> DataFrame:
    """(label, idx): distinct labels numbered from 0 in code-point order."""
    distinct = rows.select(label).filter(F.col(label).isNotNull() & (F.trim(label) != "")).distinct()
    return ranked(distinct, label, "idx")


def minimum_support(rows: DataFrame, label: str, least: int) -> DataFrame:
    """The rows whose label occurs at least so often."""
    kept = rows.groupBy(label).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(label)
    return rows.join(kept, label, "left_semi")
