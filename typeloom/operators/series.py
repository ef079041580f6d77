"""Ordered analytics over short series: moving averages, running bests, pivots, schedules, prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_average(rows: DataFrame, group: str, order: str, value: str, width: int) -> DataFrame:
    """Adds ``smooth``: the mean over width rows around each; even widths reach one further back. Nulls don't count; a frame
    of nulls gives the row's own value."""
    half = width // 2
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-half, half if width % 2 else half - 1)
    return rows.withColumn("smooth", F.coalesce(F.avg(value).over(w), F.col(value)) if width > 1 else F.col(value))


def running_best(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds ``best`` (of the rows before) and ``improved``."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = rows.withColumn("best", F.max(value).over(w))
    return best.withColumn("improved", F.col("best").isNull() | (F.col(value) > F.col("best")))


def early_stop(rows: DataFrame, group: str, order: str, value: str, delta: float, patience: int, mode: str = "max") -> DataFrame:
    """(group, best, stop_at): the place of the first of ``patience`` steps in a row without an improvement of more than delta.

    ``mode``: whether larger (``max``) or smaller (``min``) values are better.

    What counts as an improvement depends on the ones before, so this is a fold over the ordered series; a series is one
    run's epochs. ``stop_at`` is the last folded order value, null if the run was never stopped.
    """
    if mode not in ("max", "min"):
        raise ValueError(f"unknown mode {mode}")
    series = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"))
    kind = f"struct<best:double,bad:int,stop:{dict(rows.dtypes)[order]}>"
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(None).cast(dict(rows.dtypes)[order]).alias("stop")).cast(kind)

    def step(acc, x):  # noqa: ANN001, ANN202
        better = acc["best"].isNull() | (x["v"] > acc["best"] + delta if mode == "max" else x["v"] < acc["best"] - delta)
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        going = F.struct(F.when(better, x["v"]).otherwise(acc["best"]).alias("best"), bad.cast("int").alias("bad"), F.when(bad >= patience, x["o"]).alias("stop")).cast(kind)
        return F.when(acc["stop"].isNotNull(), acc).otherwise(going)

    done = series.withColumn("a", F.aggregate("s", start, step))
    return done.select(group, F.col("a.best").alias("best"), F.col("a.stop").alias("stop_at"))


def wide(rows: DataFrame, key: str, phase: str, phases: list[str], value: str, order: str) -> DataFrame:
    """One row a key with one column a phase; of several values the last in ``order`` stays."""
    return rows.groupBy(key).pivot(phase, phases).agg(F.max_by(value, order))


def best_kept(rows: DataFrame, score: str, order: str, k: int) -> DataFrame:
    """The k best rows, earlier ones first on ties."""
    return rows.orderBy(F.desc(score), order).limit(k)


def prefix_offsets(rows: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """Adds ``start`` and ``end``, the running positions of consecutive pieces."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum(length).over(w)).withColumn("start", F.col("end") - F.col(length))


def plateau_rates(rows: DataFrame, group: str, order: str, value: str, base: float, factor: float, patience: int, least: float = 0.0) -> DataFrame:
    """(group, rates array<double>): the rate after each step; it falls by ``factor`` whenever ``patience`` steps in a row brought no
    smaller value, never below ``least``. A series is one run's epochs."""
    series = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(float(base)).alias("rate"), F.array().cast("array<double>").alias("all"))

    def step(acc, x):  # noqa: ANN001, ANN202
        better = acc["best"].isNull() | (x["v"] < acc["best"])
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        falls = bad > patience
        rate = F.when(falls, F.greatest(acc["rate"] * factor, F.lit(float(least)))).otherwise(acc["rate"])
        return F.struct(F.when(better, x["v"]).otherwise(acc["best"]).alias("best"), F.when(falls, 0).otherwise(bad).alias("bad"), rate.alias("rate"), F.concat(acc["all"], F.array(rate)).alias("all"))

    return series.select(group, F.aggregate("s", start, step, lambda a: a["all"]).alias("rates"))
