"""A uniform sample of fixed size from data that arrives in pieces of unknown total."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.storage import Stage

COARSE = 3  # hex digits of the bucket names that are counted first
BUCKET_ROWS = 50_000  # about so many rows in a bucket that is shuffled


def place(record: Column, seed: int) -> Column:
    """A record's place in the random permutation: 128 hashed bits, the same wherever and whenever it arrives."""
    return F.md5(F.concat(F.lit(f"{seed}:"), record.cast("string")))


def fixed_sample(spark: SparkSession, rows: DataFrame, record: str, k: int, seed: int = 0) -> DataFrame:
    """(position, record): k distinct records, every set of k equally likely; all of them if there are fewer.

    The permutation is laid out in buckets. A record's bucket is the head of its hash and its place within the bucket the
    rest of it, so a record that came twice lies at one place and counts once. A first pass counts rows by bucket. Only
    the buckets that can hold the first k positions are then made distinct and put in order; prefix sums of the bucket
    counts give the positions. If doubled rows make those buckets too small, as many more are taken. Nulls are no records.
    Ties of the hash go by the record. An empty table gives no rows, and so does k = 0. Further columns are ignored.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    stage = Stage(spark, "fixed-sample")
    laid = rows.select(F.col(record).alias("record")).filter("record IS NOT NULL").withColumn("h", place(F.col("record"), seed))
    head = F.substring("h", 1, COARSE)
    counts = sorted((r["b"], r["n"]) for r in laid.groupBy(head.alias("b")).agg(F.count("*").alias("n")).collect())  # at most 16**COARSE rows
    total = sum(n for _, n in counts)
    digits = max(COARSE, math.ceil(math.log(max(1, total / BUCKET_ROWS), 16)))
    want = k + 4 * math.sqrt(k) + 16
    while True:
        # the smallest hash head beyond the wanted rows, interpolated within its coarse bucket
        seen, cutoff = 0.0, None
        for b, n in counts:
            if seen + n >= want:
                step = 16 ** (digits - COARSE)
                inside = math.ceil((want - seen) / n * step)
                at = int(b, 16) * step + inside
                cutoff = f"{at:0{digits}x}" if at < 16**digits else None
                break
            seen += n
        near = laid.filter(F.col("h") < cutoff) if cutoff else laid
        unique = stage.keep(near.distinct(), "first-buckets")
        if not cutoff or unique.count() >= k:
            break
        want *= 2
    bucket = F.substring("h", 1, digits)
    unique = unique.withColumn("bucket", bucket)
    sizes = unique.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))  # one row a bucket
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "record"))
    placed = unique.withColumn("rank", rank).join(before, "bucket").select((F.col("before") + F.col("rank")).alias("position"), F.col("record").alias(record))
    return placed.filter(F.col("position") <= k)


def merged_sample(sample: DataFrame, piece: DataFrame, record: str, k: int, seed: int = 0) -> DataFrame:
    """(record) after one more piece: the sample so far and the piece's records, cut to the first k places.

    The first k places of a union are among the first k of its parts, so samples of pieces can be merged in any order.
    """
    both = sample.select(record).unionByName(piece.select(record)).filter(F.col(record).isNotNull()).distinct()
    return both.orderBy(place(F.col(record), seed), record).limit(k)
