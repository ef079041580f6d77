"""How often every distinct term occurs, in how many records, and which terms are too rare or too common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.storage import Stage

RANGE = 1024  # identifiers in one count array
UNASSIGNED = (-1, 65535)
MIN_RECORDS, MAX_SHARE = 3, 0.5


def dictionary(stage: Stage, terms: DataFrame) -> tuple[DataFrame, int]:
    """(term, code) with dense codes in the order of the terms, and the number of terms.

    Terms are range-partitioned and numbered within each partition; the partitions' sizes, one row each, give the offsets.
    """
    kind = terms.schema["term"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            codes = pa.array(np.arange(n, n + batch.num_rows, dtype=np.int64))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * batch.num_rows, pa.int32()), codes], ["term", "part", "at"])

    parts = int(stage.spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = terms.select("term").distinct().repartitionByRange(parts, "term").sortWithinPartitions("term")
    local = stage.keep(ordered.mapInArrow(number, f"term {kind}, part int, at bigint"), "dictionary")
    sizes = sorted((r["part"], r["n"]) for r in local.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    base = stage.spark.createDataFrame(offsets, "part int, base bigint")
    return local.join(F.broadcast(base), "part").select("term", (F.col("at") + F.col("base")).alias("code")), total


_SUMS = "range_id bigint, spots array<int>, occurrences array<bigint>, records array<bigint>"


def _by_range(batches: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, used places, sums) from (range, place, occurrences, records) in order of the range; one count array is held."""
    now, sums = -1, np.zeros((2, RANGE), np.int64)
    for ranges, spots, n, present in batches:
        cuts = np.nonzero(np.diff(ranges, prepend=-1))[0]
        for a, b in zip(cuts, np.append(cuts[1:], len(ranges))):
            if ranges[a] != now:
                if (used := np.nonzero(sums[0])[0]).size:
                    yield now, used, sums[:, used]
                now, sums = int(ranges[a]), np.zeros((2, RANGE), np.int64)
            np.add.at(sums[0], spots[a:b], n[a:b])
            np.add.at(sums[1], spots[a:b], present[a:b])
    if (used := np.nonzero(sums[0])[0]).size:
        yield now, used, sums[:, used]


def block_arrays(encoded: DataFrame) -> DataFrame:
    """(range_id, spots, occurrences, records): the counts of each task, a row for every identifier range it met.

    A task sorts its rows by code and so holds one count array at a time, however many terms there are. Only used places
    are passed on.
    """

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ((b.column(i).to_numpy(zero_copy_only=False) for i in range(3)) for b in batches if b.num_rows)
        for key, used, sums in _by_range((code // RANGE, code % RANGE, n, present) for code, n, present in columns):
            yield pa.RecordBatch.from_pydict(
                {"range_id": pa.array([key], pa.int64()), "spots": pa.array([used], pa.list_(pa.int32())), "occurrences": pa.array([sums[0]], pa.list_(pa.int64())), "records": pa.array([sums[1]], pa.list_(pa.int64()))}
            )

    return encoded.select("code", "n", "present").sortWithinPartitions("code").mapInArrow(accumulate, _SUMS)


def summed(arrays: DataFrame) -> DataFrame:
    """(code, occurrences, records): arrays of a range added up as they come, one range at a time.

    A range has at most one array a task, whatever share of all rows its terms have.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                if b.num_rows:
                    spots, n, present = (b.column(i).flatten().to_numpy() for i in (1, 2, 3))
                    yield np.repeat(b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy())), spots, n, present

        for key, used, sums in _by_range(rows()):
            yield pa.RecordBatch.from_arrays([pa.array(key * RANGE + used), pa.array(sums[0]), pa.array(sums[1])], ["code", "occurrences", "records"])

    parted = arrays.repartition("range_id").sortWithinPartitions("range_id")
    return parted.mapInArrow(add, "code bigint, occurrences bigint, records bigint")


def term_counts(spark: SparkSession, rows: DataFrame, occurrence: str, record: str, term: str, min_records: int = MIN_RECORDS, max_share: float = MAX_SHARE) -> DataFrame:
    """(term, occurrences, records, mark) for every distinct non-null term.

    ``occurrence`` identifies a place where a term stands: rows that came twice count once; a place that came with two
    terms counts for both. ``records`` counts distinct non-null values of ``record``. ``mark`` is ``rare`` for terms in
    fewer than ``min_records`` records, else ``common`` for terms in more than ``max_share`` of the records that have a
    term, else null. An empty table gives no rows.
    """
    stage = Stage(spark, "term-counts")
    named = rows.select(F.col(occurrence).alias("o"), F.col(record).alias("r"), F.col(term).alias("term")).filter("term IS NOT NULL AND o IS NOT NULL")
    # both aggregations combine within the map tasks, so neither a hot term nor a hot record gathers in one task
    places = named.distinct()
    per = stage.keep(places.groupBy("r", "term").agg(F.count("*").alias("n")), "record-terms")
    codes, _ = dictionary(stage, per)
    codes = stage.keep(codes, "codes")
    present = F.col("r").isNotNull().cast("bigint")
    encoded = per.join(codes, "term").select("code", "n", present.alias("present"))
    counts = summed(block_arrays(encoded)).join(codes, "code")
    n_records = per.filter("r IS NOT NULL").select("r").distinct().count()
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > max_share * n_records, "common")
    return counts.select("term", "occurrences", "records", mark.alias("mark"))


def primitive_counts(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """``term_counts`` of cells.primitive_id over distinct cells, by glyph; null, -1 and 65535 are unassigned."""
    assigned = cells.filter(~F.col("primitive_id").isin(*UNASSIGNED))
    return term_counts(spark, assigned, "cell_id", "glyph_id", "primitive_id").withColumnRenamed("term", "primitive_id")
