"""Splits, samples and per-group selections, all in a seeded hash order that every engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.operators.ordering import ranked

TRAIN_SHARE = 0.86
BUCKET_DIGITS = 3  # hex digits of the hash that name a bucket
PRECEDENCE = {"train": 0, "val": 1, "test": 2}


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def stratified_split(rows: DataFrame, key: str, label: str, seed: int = 0, train: float = TRAIN_SHARE, val: float = 0.1, test: float = 0.04) -> DataFrame:
    """(key, label, split): within each label train gets max(1, floor(n*train)); the rest goes to val and test as val:test.

    With val + test = 0 the rest is val. Ranks within a label are made in two steps, over buckets of the hash and within a
    bucket, so a label with a third of all rows is not sorted in one task.
    """
    hashed = rows.select(key, label).withColumn("__h", hash_order(F.col(key), seed)).withColumn("__b", F.substring("__h", 1, BUCKET_DIGITS))
    sums = hashed.groupBy(label, "__b").agg(F.count("*").alias("__k"))
    by_label = Window.partitionBy(label)
    before = F.sum("__k").over(by_label.orderBy("__b")) - F.col("__k")
    base = sums.select(F.col(label).alias("__l"), F.col("__b").alias("__c"), before.alias("__before"), F.sum("__k").over(by_label).alias("n"))
    inner = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))
    ranked = hashed.withColumn("__in", inner).join(base, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__c"))).withColumn("rank", F.col("__before") + F.col("__in"))
    n_train = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(train)))
    rest = F.col("n") - n_train
    n_val = F.floor(rest * F.lit(val / (val + test))) if val + test > 0 else rest
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.select(key, label, split.alias("split"))


def group_split(rows: DataFrame, group: str, seed: int = 0, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """(group, split) over the distinct groups, half-even rounding of the counts. The groups are the fonts or sources, of which
    there are few against the rows."""
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("the ratios must sum to 1")
    groups = rows.select(group).filter(F.col(group).isNotNull()).distinct()
    n = F.count("*").over(Window.partitionBy())
    ranked = groups.withColumn("rank", F.row_number().over(Window.orderBy(hash_order(F.col(group), seed), group))).withColumn("n", n)
    n_train = F.bround(F.col("n") * F.lit(train))
    n_val = F.least(F.bround(F.col("n") * F.lit(val)), F.col("n") - n_train)
    return ranked.select(group, F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test").alias("split"))


def hash_split(key: Column, seed: int = 0, train: float = 0.8, val: float = 0.1) -> Column:
    u = unit_hash(key, seed)
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def first_claim(listed: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, split): of the splits that list a key, train comes before val before test."""
    rank = F.when(F.col(split) == "train", 0).when(F.col(split) == "val", 1).otherwise(2)
    return listed.filter(F.col(split).isin(*PRECEDENCE)).groupBy(key).agg(F.min_by(split, rank).alias("split"))


def sample_k(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows in hash order, kept as a bounded heap in each task; k <= 0 keeps all."""
    return rows if k <= 0 else rows.orderBy(hash_order(F.col(key), seed), key).limit(k)


def per_group_first(rows: DataFrame, group: str, key: str, n: int, seed: int | None = None) -> DataFrame:
    """The first n of each group by key, or in hash order; 0 keeps all. Spark keeps n rows a group before the shuffle."""
    if n <= 0:
        return rows
    order = [F.col(key)] if seed is None else [hash_order(F.col(key), seed), F.col(key)]
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__rank") <= n).drop("__rank")


def downsampled(rows: DataFrame, key: str, thinned: Column, p: float, seed: int = 0) -> DataFrame:
    """Every row that isn't ``thinned``, and a share p of those that are."""
    return rows.filter(~F.coalesce(thinned, F.lit(False)) | (unit_hash(F.col(key), seed) < p))


def every_nth(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows 0, n, 2n... in key order."""
    return ranked(rows, key, "__at").filter(F.col("__at") % n == 0).drop("__at")


def selected(rows: DataFrame, key: str, ids: DataFrame | None = None, nth: int = 0, k: int = 0, seed: int = 0, first: int = 10) -> DataFrame:
    """Given ids win over every nth, that over k at random, that over the first ten."""
    if ids is not None:
        return rows.join(ids, key, "left_semi")
    if nth > 0:
        return every_nth(rows, key, nth)
    return sample_k(rows, key, k, seed) if k > 0 else rows.orderBy(key).limit(first)


def token_dropout(grid: Column, key: Column, p: float, seed: int = 0) -> Column:
    """Each token becomes 0 with probability p, the same ones whenever it is computed."""
    limit = int(p * 1_000_000)
    return F.transform(grid, lambda x, i: F.when(F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(1_000_000)) < limit, F.lit(0)).otherwise(x))
