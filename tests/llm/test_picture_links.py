import random

import numpy as np

from tests.llm.conftest import GRID
from typeloom.llm import density_peaks
from typeloom.storage import Stage


def _family(n, seed=3):
    """n pictures around one shape, most pairs of them just alike (about 0.71), and n/2 solitary ones."""
    rng = random.Random(seed)
    some = lambda k: rng.getrandbits(64) & some(k - 1) if k else -1  # noqa: E731 - each bit with 2**-k
    shape = [rng.getrandbits(64) if rng.random() < 0.4 else 0 for _ in range(256)]
    rows = []
    for g in range(n):
        rows.append([c ^ (some(4) | some(5)) if c else c for c in shape])
    rows += [[rng.getrandbits(64) if rng.random() < 0.4 else 0 for _ in range(256)] for _ in range(n // 2)]
    signed = [[c - (1 << 64) if c >= 1 << 63 else c for c in r] for r in rows]
    return [(g, None, None, None, c, 1, "x", 2, "y") for g, c in enumerate(signed)], n


def _links(rows):
    bits = np.array([np.unpackbits(np.array(r[4], np.int64).view(np.uint8)) for r in rows], np.float32)
    common = bits @ bits.T
    on = np.diag(common)
    alike = common >= 0.7 * (on[:, None] + on[None, :] - common)
    return {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(alike, 1)))}


def test_density_counts_every_link_of_a_crowded_family(spark):
    rows, n = _family(400)
    want = _links(rows)
    assert 20 * n < len(want) < n * (n - 1) / 2
    rho = {g: 1 for g in range(n)}
    for pair in want:
        for g in pair:
            rho[g] += 1
    found = density_peaks.clusters(spark, spark.createDataFrame(rows, GRID)).collect()
    assert {r.glyph_id: r.rho for r in found} == {g: x for g, x in rho.items() if x > 1}


def _found(spark, rows):
    members, links = density_peaks.picture_links(Stage(spark, "t", tidy=True), spark.createDataFrame(rows, GRID), 0.7)
    glyph = {bytes(r.fp): r.glyph_id for r in members.collect()}
    got = [tuple(sorted((glyph[bytes(r.fp_a)], glyph[bytes(r.fp_b)]))) for r in links.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_few_bands_and_pairs_at_a_time_find_the_same(spark, monkeypatch):
    rows, _ = _family(30)
    want = _links(rows)
    monkeypatch.setattr(density_peaks, "ENTRIES", 1)
    monkeypatch.setattr(density_peaks, "LEAST_BANDS", 20)
    monkeypatch.setattr(density_peaks, "PORTION", 1)
    monkeypatch.setattr(density_peaks, "_PAIRS", 7)
    assert want and _found(spark, rows) == want


def test_a_bucket_over_many_batches(spark):
    """A solid bucket of 300 entries in batches of 7, between others."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sketch = bytes([200] * 64)
        rows = [(1, 12_800, i, sketch) for i in range(300)] + [(b, 12_800, 1000 * b + 1000 + i, sketch) for b in (0, 2, 3) for i in range(5)]
        df = spark.createDataFrame(rows, "bucket long, size int, id long, sketch binary")
        got = [tuple(r) for r in density_peaks._candidates(df, 0.7).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = {}
    for b, _, i, _ in rows:
        ids.setdefault(b, []).append(i)
    want = {(x, y) for v in ids.values() for x in v for y in v if x < y}
    assert set(got) == want and len(got) == len(want)


def test_sketches_of_full_squares_bound_from_above():
    size = np.array([16_384, 16_384])
    found = list(density_peaks.bucket_pairs(np.zeros(2, np.int64), size, np.full((2, 64), 255, np.uint8), 1.0))
    assert sum(len(i) for i, _ in found) == 1


def test_a_tidy_stage_leaves_no_shuffle_files(spark):
    files = lambda: {f for f in map(str, spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")) if "/shuffle_" in f}
    before = files()
    Stage(spark, "t", tidy=True).keep(spark.range(1000).repartition(3, "id"), "t")
    assert files() <= before
