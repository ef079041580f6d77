"""Similarity join on sets: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

The path from sets to pairs:

1. ``signatures``: each element falls into one of ``k`` bins by one hash and the bin keeps its smallest hash. Empty bins
   borrow from a bin chosen by a probe sequence that is the same for all sets (optimal densification), so every bin
   agrees between two sets with the probability of their Jaccard similarity.
2. ``banded``: ``bands`` x ``rows`` bins are hashed to bucket names. A pair at similarity s shares a bucket with
   probability 1-(1-s^rows)^bands.
3. ``star_edges``: a bucket gives a star around each of its first ``STARS`` records, in a random order of its own. A bucket
   of m records gives at most STARS x m edges, so the work is linear in the bucket entries, however large a bucket is. A
   bucket of up to STARS+1 records is covered by its stars: each of its pairs is an edge.
4. Edges are folded, held against exact bounds (sizes, and a sketch where one is given) and measured exactly.
5. Larger buckets are looked at again. Their centres are random, so the share of links among the edges to them is that
   among all pairs. Where it is under ``DENSE``, strangers crowd the bucket: its entries get ``SPLIT`` new names from
   fresh bands, each of ``SPLIT_ROWS`` further samples, and form stars again. Unlike records part there, like ones meet under
   another name. Where it is higher, the pairs are results for the most part. ``complete`` then spells them out, at no more
   than 1/DENSE pairs for a link; without it the stars stand for them, which is enough for what is connected.
   A bucket that is still crowded after ``LEVELS`` splits agrees in rows + LEVELS x SPLIT_ROWS samples and counts as dense.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from typeloom.storage import Stage, balanced

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PROBES = 64
STARS = 16
SPLIT, SPLIT_ROWS, LEVELS = 8, 4, 5
DENSE, ASKED = 0.125, 4  # share of links among the edges to the first ASKED centres

Signer = Callable[[pa.Array, int], np.ndarray]


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over uint64."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x ^= x >> np.uint64(30)
        x *= _MIX1
        x ^= x >> np.uint64(27)
        x *= _MIX2
        x ^= x >> np.uint64(31)
    return x


def probe_table(k: int, seed: int, probes: int = PROBES) -> np.ndarray:
    """probe_table[t, i]: the bin that bin i asks at its t-th attempt; 2-universal in (i, t), the same for all sets."""
    at = np.arange(probes * k, dtype=np.uint64)
    return (mix64(at, seed + 7) % np.uint64(k)).astype(np.int64).reshape(probes, k)


def densify(sig: np.ndarray, empty: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Fills empty bins by optimal densification. A row without any full bin stays as it is."""
    todo_r, todo_c = np.nonzero(empty & ~empty.all(axis=1)[:, None])
    for t in range(len(probes)):
        if not len(todo_r):
            return sig
        ask = probes[t, todo_c]
        ok = ~empty[todo_r, ask]
        sig[todo_r[ok], todo_c[ok]] = sig[todo_r[ok], ask[ok]]
        todo_r, todo_c = todo_r[~ok], todo_c[~ok]
    for r, c in zip(todo_r, todo_c):  # sets of very few elements: walk on from the bin, which every set does alike
        full = np.nonzero(~empty[r])[0]
        sig[r, c] = sig[r, full[np.searchsorted(full, c) % len(full)]]
    return sig


def set_signatures(values: np.ndarray, offsets: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Signatures of the sets values[offsets[i]:offsets[i+1]] of 64-bit integers, none of them empty."""
    n = len(offsets) - 1
    h = mix64(values.view(np.uint64), seed)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    slot = row * k + (h % np.uint64(k)).astype(np.int64)
    order = np.lexsort((h, slot))
    slot, h = slot[order], h[order]
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    sig = np.zeros(n * k, np.uint64)
    full = np.zeros(n * k, bool)
    sig[slot[first]], full[slot[first]] = h[first], True
    return densify(sig.reshape(n, k), ~full.reshape(n, k), probe_table(k, seed))


def band_names(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket name for each band; the band's number is part of it."""
    n = len(sig)
    x = sig[:, : bands * rows].reshape(n, bands, rows)
    out = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64), 99)[None, :], (n, bands)).copy()
    for j in range(rows):
        out = mix64(out ^ x[:, :, j], j + 1)
    return out.view(np.int64)


def banded(classes: DataFrame, payload: str, signer: Signer, bands: int, rows: int) -> DataFrame:
    """(bucket, id, size), ``bands`` rows for each of ``classes(id, size, payload)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                names = band_names(signer(part.column(2), 0), bands, rows)
                ids, sizes = (np.repeat(part.column(i).to_numpy(), bands) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(names.ravel()), pa.array(ids), pa.array(sizes)], ["bucket", "id", "size"])

    return balanced(classes.select("id", "size", payload)).mapInArrow(run, "bucket bigint, id bigint, size int")


def split(entries: DataFrame, classes: DataFrame, payload: str, signer: Signer, level: int) -> DataFrame:
    """(bucket, id, size): SPLIT finer buckets for each of ``entries``, named by the old bucket and a band of fresh samples."""
    crowded = entries.groupBy("id").agg(F.collect_list("bucket").alias("old"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fresh = band_names(signer(part.column(2), level), SPLIT, SPLIT_ROWS)
                old = part.column(3)
                owner = np.repeat(np.arange(len(part)), np.diff(old.offsets.to_numpy()))
                names = mix64(old.flatten().to_numpy().view(np.uint64)[:, None] ^ fresh[owner].view(np.uint64), 100 + level).view(np.int64)
                ids, sizes = (np.repeat(part.column(i).to_numpy()[owner], SPLIT) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(names.ravel()), pa.array(ids), pa.array(sizes)], ["bucket", "id", "size"])

    return classes.select("id", "size", payload).join(crowded, "id").mapInArrow(run, "bucket bigint, id bigint, size int")


def _edges(entries: DataFrame, centres: DataFrame, threshold: float) -> DataFrame:
    """(bucket, id_a, id_b) between the entries of a bucket and its ``centres(bucket, centre, csize)``, if the sizes allow it."""
    pairs = entries.join(centres, "bucket").filter(
        (F.struct(F.xxhash64("bucket", "id"), "id") > F.struct(F.xxhash64("bucket", "centre"), "centre")) & (F.least("size", "csize") >= threshold * F.greatest("size", "csize") - 1e-9)
    )
    return pairs.select("bucket", F.least("id", "centre").alias("id_a"), F.greatest("id", "centre").alias("id_b"))


def heads(entries: DataFrame) -> DataFrame:
    """(bucket, centre, csize, rank): the first STARS + 2 records of each bucket that has two or more.

    They are found by a window group limit, which each task applies before the shuffle: no bucket is sorted in one task.
    """
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("bucket", "id"), "id")
    first = entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= STARS + 2)
    some = first.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).filter("n > 1")
    return some.select("bucket", F.col("id").alias("centre"), F.col("size").alias("csize"), "rank")


def similar_pairs(
    stage: Stage,
    classes: DataFrame,
    payload: str,
    signer: Signer,
    measured: Callable[[DataFrame], DataFrame],
    threshold: float,
    bands: int,
    rows: int,
    bounded: Callable[[DataFrame], DataFrame] | None = None,
    complete: bool = True,
) -> DataFrame:
    """(fp_a, fp_b, sim), fp_a < fp_b: the pairs of different records of ``classes(id, fp, size, payload)`` with sim >= threshold.

    ``id`` is a 64-bit hash of ``fp`` that only the candidates go by: should two records share one, both are measured.
    ``signer(column, level)`` gives the signature matrix of an Arrow column; levels are independent of each other.
    ``measured`` turns (id_a, id_b, fp_a, fp_b, pa, pb), with both payloads, into (id_a, id_b, fp_a, fp_b, sim); ``bounded``
    drops edges (id_a, id_b) that cannot reach the threshold.
    """
    a = classes.select(F.col("id").alias("id_a"), F.col("fp").alias("fa"), F.col(payload).alias("pa"))
    b = classes.select(F.col("id").alias("id_b"), F.col("fp").alias("fb"), F.col(payload).alias("pb"))

    def links_of(edges: DataFrame) -> DataFrame:
        edges = edges.select("id_a", "id_b").distinct()
        if bounded is not None:
            edges = stage.keep(bounded(edges), "bounded")
        sided = edges.join(a, "id_a").join(b, "id_b")
        sided = sided.select("id_a", "id_b", F.least("fa", "fb").alias("fp_a"), F.greatest("fa", "fb").alias("fp_b"), "pa", "pb")
        return stage.keep(measured(sided).filter(F.col("sim") >= threshold), "links")

    entries = stage.keep(banded(classes, payload, signer, bands, rows), "buckets")
    parts = []
    for level in range(1, LEVELS + 2):
        first = stage.keep(heads(entries), "heads")
        # at most STARS rows a bucket on this side, so the adaptive skew join splits a bucket with a third of all records
        parts.append(links_of(_edges(entries, first.filter(F.col("rank") <= STARS), threshold)))
        crowded = first.filter(F.col("rank") == STARS + 2).select("bucket")
        if not crowded.limit(1).count():
            break
        entries, done = stage.keep(entries.join(crowded, "bucket", "left_semi"), "crowded"), entries
        stage.drop(done)  # the largest table of all; links are written already
        asked = _edges(entries, first.filter(F.col("rank") <= ASKED).join(crowded, "bucket", "left_semi"), 0.0)
        hits = asked.join(parts[-1].select("id_a", "id_b", F.lit(1).alias("hit")), ["id_a", "id_b"], "left")
        dense = hits.groupBy("bucket").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
        dense = stage.keep(dense.filter(F.col("share") >= (DENSE if level <= LEVELS else 0.0)).select("bucket"), "dense")
        if complete:
            whole = entries.join(dense, "bucket", "left_semi")
            parts.append(links_of(_edges(whole, whole.select("bucket", F.col("id").alias("centre"), F.col("size").alias("csize")), threshold)))
        entries = entries.join(dense, "bucket", "left_anti")
        if level > LEVELS or not entries.limit(1).count():
            break
        entries = stage.keep(split(entries, classes, payload, signer, level), "buckets")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    found = found.select("fp_a", "fp_b", "sim")
    return found if len(parts) == 1 else found.dropDuplicates(["fp_a", "fp_b"])
