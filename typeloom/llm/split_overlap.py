"""Evaluation samples whose glyphs appear, exactly or almost, in training."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.fm_index import FMIndex
from typeloom.llm.grids import folded, value_sets
from typeloom.llm.near_duplicates import THRESHOLD
from typeloom.storage import Stage, balanced, open_shared

SHARD_DOCS = 32_768  # evaluation contents in one index
BLOCK_DOCS = 32_768  # training contents that a task holds while it goes through the indexes
_CHUNK = 2048


def split_name(col: Column) -> Column:
    """train, val or test, however spelled; null for null and for anything else."""
    start = F.regexp_extract(F.lower(col), r"^\s*(train|val|test)", 1)
    return F.when(start != "", start)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    offsets = array.offsets.to_numpy().astype(np.int64)
    return array.flatten().to_numpy(), offsets - offsets[0]


def index_shards(stage: Stage, evaluation: DataFrame, shards: int) -> str:
    """Writes one index for each shard of the (fp, vals) rows, each into a folder of its own, and returns the path."""

    def build(rows: pa.Table) -> pa.Table:
        values, offsets = _lists(rows["vals"])
        blob = FMIndex.build(values, offsets).dumps()
        docs = pa.array([rows["fp"].to_pylist()], pa.list_(pa.binary()))
        return pa.table({"shard": rows["shard"][:1], "docs": docs, "blob": pa.array([blob], pa.binary())})

    path = stage.path("indexes")
    named = evaluation.withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(shards)).cast("int"))
    named.groupBy("shard").applyInArrow(build, "shard int, docs array<binary>, blob binary").write.partitionBy("shard").parquet(path)
    return path


def streamed(training: DataFrame, path: str, shards: int, share: float) -> DataFrame:
    """(fp_t, fp_e, spans, matched, longest, sim): training contents through every evaluation index.

    Training isn't shuffled or copied: each task holds a block of its own rows and loads one index after the other from the
    shared folder, so it needs room for one block and one index, however many there are of either.
    """

    def index(shard: int, held: dict) -> tuple[FMIndex, list[bytes]] | None:
        if shard not in held:
            held.clear()
            rows = open_shared(f"{path}/shard={shard}")
            held[shard] = (FMIndex.loads(rows["blob"][0].as_py()), rows["docs"][0].as_py()) if rows is not None and rows.num_rows else None
        return held[shard]

    def through(block: list[pa.RecordBatch], held: dict) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(block)
        values, offsets = _lists(rows["vals"])
        fps = rows["fp"].to_pylist()
        for shard in range(shards):
            if (loaded := index(shard, held)) is None:
                continue
            fm, docs = loaded
            for at in range(0, len(fps), _CHUNK):
                part = offsets[at : at + _CHUNK + 1]
                q, doc, spans, matched, longest, sim = fm.matches(values[part[0] : part[-1]], part, share)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([fps[at + i] for i in q], pa.binary()), pa.array([docs[i] for i in doc], pa.binary()),
                        pa.array(spans, pa.int32()), pa.array(matched, pa.int32()), pa.array(longest, pa.int32()), pa.array(sim, pa.float64()),
                    ],
                    ["fp_t", "fp_e", "spans", "matched", "longest", "sim"],
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        held: dict = {}  # the index read last
        for batch in batches:
            block.append(batch)
            if sum(b.num_rows for b in block) >= BLOCK_DOCS:
                yield from through(block, held)
                block = []
        if block:
            yield from through(block, held)

    return balanced(training.select("fp", "vals")).mapInArrow(search, "fp_t binary, fp_e binary, spans int, matched int, longest int, sim double")


def named_samples(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", "glyph_id", "source", split_name(F.col("split")).alias("split")).filter("split IS NOT NULL AND sample_id IS NOT NULL")


def content_overlaps(stage: Stage, samples: DataFrame, cell_grids: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``listed`` samples, ``members(glyph_id, fp)`` of listed glyphs, and ``matches`` between training and evaluation contents."""
    listed = stage.keep(named_samples(samples), "samples")
    in_train = listed.filter("glyph_id IS NOT NULL").groupBy("glyph_id").agg(F.bool_or(F.col("split") == "train").alias("t"), F.bool_or(F.col("split") != "train").alias("e"))
    # glyphs that no sample lists fall away before their grids are written; the rest is a copy of the grids at most
    named = stage.keep(value_sets(cell_grids).join(in_train, "glyph_id"), "sets")
    members = named.select("glyph_id", "fp").distinct()
    sides = named.groupBy("fp").agg(F.bool_or("t").alias("t"), F.bool_or("e").alias("e"))
    _, classes = folded(named, "vals")
    contents = stage.keep(classes.join(sides, "fp"), "contents")
    n_e = contents.filter("e").count()
    shards = max(1, -(-n_e // SHARD_DOCS))
    path = index_shards(stage, contents.filter("e").select("fp", "vals"), shards)
    return listed, members, stage.keep(streamed(contents.filter("t"), path, shards, threshold), "matches")


def overlaps(spark: SparkSession, samples: DataFrame, cell_grids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(train_id, eval_id, split, source, kind): training samples and the val or test samples they give away.

    ``kind`` is ``glyph`` for the same glyph, ``copy`` for another glyph with the same values and ``near`` for one that
    shares at least ``threshold`` of all values; all three come out of the index, as a glyph's own grid is an exact match.
    The split and source are the evaluation sample's. Samples without a split or id never count, labels never matter; a
    null glyph_id is no glyph. A sample whose glyph has no grid that counts overlaps with nothing, not even with another
    sample of its glyph. Samples that are listed twice under different ids are different samples. Empty tables give no
    rows.
    """
    stage = Stage(spark, "split-overlap")
    listed, members, matches = content_overlaps(stage, samples, cell_grids, threshold)
    train = listed.filter("split = 'train'").select(F.col("sample_id").alias("train_id"), F.col("glyph_id").alias("gt"))
    held = listed.filter("split <> 'train'").select(F.col("sample_id").alias("eval_id"), F.col("glyph_id").alias("ge"), "split", "source")
    of_t = train.join(members.select(F.col("glyph_id").alias("gt"), F.col("fp").alias("fp_t")), "gt")
    of_e = held.join(members.select(F.col("glyph_id").alias("ge"), F.col("fp").alias("fp_e")), "ge")
    kind = F.when(F.col("gt") == F.col("ge"), 0).when(F.col("fp_t") == F.col("fp_e"), 1).otherwise(2)
    every = matches.select("fp_t", "fp_e").join(of_t, "fp_t").join(of_e, "fp_e").select("train_id", "eval_id", "split", "source", kind.alias("kind"))
    best = every.groupBy("train_id", "eval_id").agg(F.first("split").alias("split"), F.first("source").alias("source"), F.min("kind").alias("kind"))
    return best.withColumn("kind", F.element_at(F.array(F.lit("glyph"), F.lit("copy"), F.lit("near")), F.col("kind") + 1))


def report(spark: SparkSession, samples: DataFrame, cell_grids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(split, source, n_samples, n_leaked, n_exact, n_pairs, n_values) over the evaluation samples.

    n_exact: by a glyph or copy; n_pairs: pairs with a training sample; n_values: the values that the merged spans of those
    pairs cover (the largest cover where a glyph has several grids). Nothing is spelled out by pairs of samples: glyphs with the same
    grids are counted as one, so a glyph that is listed n times in training and m times in evaluation makes one row.
    """
    stage = Stage(spark, "split-report")
    listed, members, matches = content_overlaps(stage, samples, cell_grids, threshold)
    # a glyph's grids, as one name; nearly always it has one
    kinds = members.groupBy("glyph_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.count("*").alias("n"))
    kinds = kinds.select("glyph_id", F.md5(F.concat("a", "b", F.concat_ws(",", "x", "n").cast("binary"))).alias("grids"))
    of = stage.keep(members.join(kinds, "glyph_id"), "kinds").select("fp", "grids").distinct()
    named = listed.join(kinds, "glyph_id", "left")
    in_train = named.filter("split = 'train' AND grids IS NOT NULL").groupBy(F.col("grids").alias("gt")).agg(F.count("*").alias("n_t"))
    pairs = matches.join(of.select(F.col("fp").alias("fp_t"), F.col("grids").alias("gt")), "fp_t").join(of.select(F.col("fp").alias("fp_e"), F.col("grids").alias("ge")), "fp_e")
    pairs = pairs.groupBy("gt", "ge").agg(F.bool_or(F.col("fp_t") == F.col("fp_e")).alias("same"), F.max("matched").alias("matched"))
    per = pairs.join(in_train, "gt").groupBy("ge").agg(F.sum("n_t").alias("pairs"), F.bool_or("same").alias("exact"), F.sum(F.col("n_t") * F.col("matched")).alias("cover"))
    seen = named.filter("split <> 'train'").join(per, F.col("grids") == F.col("ge"), "left")
    count = lambda c: F.count_if(c).cast("bigint")
    return seen.groupBy("split", "source").agg(
        F.count("*").alias("n_samples"), count(F.col("pairs") > 0).alias("n_leaked"), count(F.coalesce("exact", F.lit(False))).alias("n_exact"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("cover"), F.lit(0)).alias("n_values"),
    )


def span_report(spark: SparkSession, samples: DataFrame, cell_grids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(glyph_t, glyph_e, n_spans, n_values, longest, sim): the merged spans of each pair of overlapping contents.

    glyph_t and glyph_e are the smallest glyphs that hold the training and the evaluation content.
    """
    stage = Stage(spark, "split-spans")
    _, members, matches = content_overlaps(stage, samples, cell_grids, threshold)
    first = stage.keep(members.groupBy("fp").agg(F.min("glyph_id").alias("g")), "first")
    of_t, of_e = first.select(F.col("fp").alias("fp_t"), F.col("g").alias("glyph_t")), first.select(F.col("fp").alias("fp_e"), F.col("g").alias("glyph_e"))
    named = matches.join(of_t, "fp_t").join(of_e, "fp_e")
    return named.select("glyph_t", "glyph_e", F.col("spans").alias("n_spans"), F.col("matched").alias("n_values"), "longest", F.round("sim", 9).alias("sim"))
